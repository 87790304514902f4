"""Rows as CSV, JSON and GeoJSON texts.

A rendered text is one string, so these are for what a viewer exports: a slide's rows. Whole tables are written by
``lines`` as one text a row, in as many files as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry, strings


def csv_cell(value: Column, kind: str) -> Column:
    """A value as a CSV cell: nested ones as compact JSON, NULL empty, quoted where it holds a comma, a quote or a line's end."""
    text = F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(line) of each row, without the header; columns that rows lack are empty."""
    kinds = dict(rows.dtypes)
    cells = [csv_cell(F.col(c), kinds[c]) if c in kinds else F.lit("") for c in columns or rows.columns]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def csv_text(rows: DataFrame, order: str, columns: Sequence[str] | None = None, end: str = "\n") -> DataFrame:
    """(text): a header and the rows in an order; without rows and columns given, empty."""
    names = list(columns or rows.columns)
    kinds = dict(rows.dtypes)
    cells = [csv_cell(F.col(c), kinds[c]) if c in kinds else F.lit("") for c in names]
    told = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(",", *cells).alias("line")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(x["line"], F.lit(end))), "")
    header = F.lit(",".join(names) + end)
    return told.select((F.concat(header, body) if columns else F.when(F.size("r") > 0, F.concat(header, body)).otherwise("")).alias("text"))


def json_text(rows: DataFrame, order: str, pretty: bool = False) -> DataFrame:
    """(text): the rows as a JSON list in an order, with the fields that are null."""
    told = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*rows.columns).alias("v")))), lambda x: x["v"]).alias("r"))
    return told.select(F.to_json("r", {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("text"))


def _pairs(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"], p["y"]))


def feature(mpp: Column) -> Column:
    """A region (id, kind, label, notes, points, x0 to y1) as a GeoJSON feature's text; an empty label gives no classification."""
    shape = geometry.shape_ring(F.col("kind"), F.col("points"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    label = F.coalesce("label", F.lit(""))
    plain = [F.col("id").alias("roi_id"), "kind", label.alias("label"), F.coalesce("notes", F.lit("")).alias("notes"), mpp.alias("mpp")]
    properties = F.when(label == "", F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(*plain, F.struct(label.alias("name")).alias("classification")), {"ignoreNullFields": "false"}))
    outline = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(_pairs(shape)).alias("coordinates")))
    return F.concat(F.lit('{"type":"Feature","geometry":'), outline, F.lit(',"properties":'), properties, F.lit("}"))


def features(rois: DataFrame, mpp: Column) -> DataFrame:
    """(id, feature) of every region that has a box."""
    return rois.dropna(subset=["x0", "y0", "x1", "y1"]).select("id", feature(mpp).alias("feature"))


def feature_collection(told: DataFrame) -> DataFrame:
    """(text) of the features in the order of their ids."""
    listed = told.agg(F.array_sort(F.collect_list(F.struct("id", "feature"))).alias("r"))
    return listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("r", lambda x: x["feature"]), ","), F.lit("]}")).alias("text"))


def prompt(p: Column) -> Column:
    """A payload as a text for a reader: the region, its box, its patch and its statistics."""
    box = lambda i: F.element_at(p["roi"]["bbox_level0"], i + 1)
    unknown = lambda x, text: F.when(x.isNull(), "unknown").otherwise(text)
    stat = lambda path: F.coalesce(F.get_json_object(p["stats"], path), F.lit("0"))
    lines = [
        F.lit("### ROI selection"),
        F.concat(F.lit("- Slide: "), p["slide_name"], F.lit(" (level-0 dimensions: "), F.element_at(p["slide_dimensions"], 1), F.lit("x"), F.element_at(p["slide_dimensions"], 2), F.lit(" px)")),
        F.concat(F.lit("- Microns-per-pixel: "), unknown(p["mpp"], p["mpp"].cast("string"))),
        F.concat(F.lit("- Approx magnification: "), unknown(p["magnification"], F.concat(strings.one_decimal(p["magnification"]), F.lit("x")))),
        F.concat(F.lit("- ROI kind: "), p["roi"]["kind"]),
        F.concat(F.lit("- ROI bbox (level-0 px): x0="), box(0), F.lit(", y0="), box(1), F.lit(", x1="), box(2), F.lit(", y1="), box(3), F.lit(" ("), box(2) - box(0), F.lit("x"), box(3) - box(1), F.lit(" px)")),
        F.concat(F.lit("- Patch image: "), p["patch_path"]),
        F.concat(F.lit("- Tissue fraction: "), stat("$.tissue_fraction")),
        F.concat(F.lit("- Created at: "), p["created_at"]),
    ]
    return F.concat_ws("\n", *lines)


def write_lines(told: DataFrame, column: str, path: str) -> None:
    """Appends a column of texts to a folder, a line each."""
    told.select(column).write.mode("append").text(path)
