"""Classifiers of regions by their features: training, prediction, storage."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Classifier:
    """Labels in their order, means and deviations of the features, and the weights."""

    labels: list[str]
    mean: list[float]
    scale: list[float]
    model: LogisticRegressionModel
    accuracy: float | None = None
    counts: dict[str, int] = field(default_factory=dict)

    def vector(self, features: Column) -> Column:
        scaled = F.zip_with(features, F.array(*map(F.lit, self.mean)), lambda x, m: x.cast("double") - m)
        return array_to_vector(F.zip_with(scaled, F.array(*map(F.lit, self.scale)), lambda x, s: x / s))


def _fit(rows: DataFrame, labels: list[str], iterations: int) -> Classifier:
    n = rows.count()
    size = len(rows.first()["features"])
    told = rows.agg(*(F.avg(F.col("features")[i].cast("double")).alias(f"m{i}") for i in range(size)), *(F.stddev_pop(F.col("features")[i].cast("double")).alias(f"s{i}") for i in range(size))).first()
    mean, scale = [told[f"m{i}"] for i in range(size)], [told[f"s{i}"] or 1.0 for i in range(size)]
    out = Classifier(labels, mean, scale, None)
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    ready = rows.select(out.vector(F.col("features")).alias("features"), place.cast("double").alias("label"))
    # the penalty of one over the rows is what a unit penalty on the sum of losses is on their mean
    out.model = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=iterations, family="multinomial" if len(labels) > 2 else "binomial").fit(ready)
    return out


def train(rows: DataFrame, least: int = 2, folds: int = 3, iterations: int = 1000) -> Classifier:
    """A classifier of rows (id, label, features); blank labels don't count.

    Fewer than two labels, or one with fewer rows than the least, is an error. ``accuracy`` is the mean over folds that
    hold every label alike, of which there are no more than the smallest label has rows.
    """
    rows = rows.where("trim(label) <> '' AND features IS NOT NULL").select("id", "label", "features")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("training needs at least two labels")
    if min(counts.values()) < least:
        raise ValueError(f"every label needs at least {least} rows: {counts}")
    labels = sorted(counts)
    out = _fit(rows, labels, iterations)
    out.counts = counts
    k = min(folds, min(counts.values()))
    if k >= 2:
        held = rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(k)))
        scores = []
        for fold in range(k):
            train_rows, test_rows = held.where(F.col("fold") != fold), held.where(F.col("fold") == fold)
            if train_rows.select("label").distinct().count() == len(labels):
                told = predict(_fit(train_rows, labels, iterations), test_rows).select(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a")).first()
                if told["a"] is not None:
                    scores.append(told["a"])
        out.accuracy = sum(scores) / len(scores) if scores else None
    return out


def predict(model: Classifier, rows: DataFrame) -> DataFrame:
    """rows with ``probabilities``, a list of (label, p) from the likeliest on, equal ones in the order of the labels, and ``predicted``, the first label."""
    scored = model.model.setFeaturesCol("_x").transform(rows.withColumn("_x", model.vector(F.col("features"))))
    p = vector_to_array("probability")
    told = F.transform(F.sequence(F.lit(0), F.lit(len(model.labels) - 1)), lambda i: F.struct((-F.element_at(p, i + 1)).alias("minus"), i.alias("i"), F.element_at(F.array(*map(F.lit, model.labels)), i + 1).alias("label")))
    listed = F.transform(F.array_sort(told), lambda x: F.struct(x["label"].alias("label"), (-x["minus"]).alias("p")))
    return scored.withColumn("probabilities", listed).withColumn("predicted", F.col("probabilities")[0]["label"]).select(*rows.columns, "probabilities", "predicted")


def label_metric(model: Classifier, label: str):
    """A function of a frame with features that adds ``value``, the label's probability; an unknown label is an error."""
    if label not in model.labels:
        raise ValueError(f"unknown label {label!r}; there are {', '.join(model.labels)}")

    def told(rows: DataFrame) -> DataFrame:
        own = F.filter("probabilities", lambda x: x["label"] == label)[0]["p"]
        return predict(model, rows).withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), own))).drop("probabilities", "predicted")

    return told


def save(model: Classifier, folder: str, name: str) -> str:
    """Writes the model below a folder, its description last: a model without one is none. Returns its path."""
    path = f"{folder.rstrip('/')}/{name}/{time.time_ns()}"
    model.model.write().save(f"{path}/weights")
    meta = {"name": name, "labels": model.labels, "mean": model.mean, "scale": model.scale, "accuracy": model.accuracy, "counts": model.counts}
    spark = SparkSession.getActiveSession()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta.json")
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, False)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    return path


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, labels, accuracy) of the models below a folder, in the order of their paths; descriptions that can't be read are left out."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").text(folder, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/meta.json$", "").alias("path"), "value")
    told = texts.withColumn("m", F.from_json("value", "name STRING, labels ARRAY<STRING>, accuracy DOUBLE")).where("m.name IS NOT NULL AND m.labels IS NOT NULL")
    return told.select("path", "m.name", "m.labels", "m.accuracy").orderBy("path")


def load(spark: SparkSession, path: str) -> Classifier:
    meta = json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first()[0])
    return Classifier(meta["labels"], meta["mean"], meta["scale"], LogisticRegressionModel.load(f"{path}/weights"), meta["accuracy"], meta["counts"])


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with their columns as one vector."""
    return VectorAssembler(inputCols=columns, outputCol="vector").transform(rows)
