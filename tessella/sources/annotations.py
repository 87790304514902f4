"""Annotation documents as rows: GeoJSON, ASAP XML and line-by-line histories.

Each reader takes a frame with an id and a text, so that files come in by ``spark.read.text(..., wholetext=True)`` and
documents of a table as they are. What can't be imported is listed with its reason, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import geometry

_FEATURES = "array<struct<type:STRING,geometry:STRUCT<type:STRING,coordinates:STRING>,properties:STRUCT<name:STRING,objectType:STRING,classification:STRING>>>"
_RINGS = "array<array<array<double>>>"
_FLAT = ("Point", "MultiPoint", "LineString", "MultiLineString")


def _ring(pairs: Column) -> Column:
    """The outline of a ring of pairs; NULL where a pair is short or there are fewer than three different points."""
    fine = F.forall(pairs, lambda p: F.coalesce(F.try_element_at(p, F.lit(1)).isNotNull() & F.try_element_at(p, F.lit(2)).isNotNull(), F.lit(False)))
    return F.when(fine, geometry.outline(F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def geojson(documents: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, feature, part, label, notes, points, reason, holes) of GeoJSON documents: collections, lists and lone features.

    A polygon is one region by its outer ring, a multipolygon one a part; ``holes`` counts polygons whose inner rings were
    left out. Rows with a ``reason`` are what was skipped: geometry without area, degenerate rings, unreadable documents.
    """
    doc = F.trim(F.col(text))
    kind = F.get_json_object(doc, "$.type")
    # a document that doesn't parse has no type, and as a list no elements either
    listed = F.when(kind == "FeatureCollection", F.get_json_object(doc, "$.features")).when(kind == "Feature", F.concat(F.lit("["), doc, F.lit("]"))).when(doc.startswith("["), doc)
    parsed = F.from_json(listed, _FEATURES)
    readable = F.try_parse_json(doc).isNotNull()
    told = documents.select(key, readable.alias("readable"), F.when(readable, parsed).alias("features"))
    bad = told.where("features IS NULL").select(key, F.lit(0).alias("feature"), F.when(F.col("readable"), "not a GeoJSON FeatureCollection").otherwise("unreadable GeoJSON").alias("reason"))
    each = told.select(key, F.posexplode("features").alias("feature", "f"))
    g = F.col("f.geometry.type")
    single, many = F.from_json("f.geometry.coordinates", _RINGS), F.from_json("f.geometry.coordinates", f"array<{_RINGS}>")
    parts = F.when(g == "Polygon", F.array(single)).when(g == "MultiPolygon", many)
    label = F.coalesce(F.nullif(F.get_json_object("f.properties.classification", "$.name"), F.lit("")), F.col("f.properties.name"), F.lit(""))
    notes = F.concat(F.lit("imported from GeoJSON"), F.coalesce(F.concat(F.lit(" ("), F.col("f.properties.objectType"), F.lit(")")), F.lit("")))
    shaped = each.select(key, "feature", g.alias("g"), label.alias("label"), notes.alias("notes"), F.transform(parts, lambda rings: F.struct(_ring(F.try_element_at(rings, F.lit(1))).alias("points"), (F.size(rings) > 1).cast("int").alias("hole"))).alias("parts"))
    sound = F.filter("parts", lambda p: p["points"].isNotNull())
    shaped = shaped.withColumns({"sound": sound, "holes": F.aggregate("parts", F.lit(0), lambda s, p: s + p["hole"])})
    regions = shaped.where(F.size("sound") > 0).select(key, "feature", F.posexplode("sound").alias("part", "p"), "label", "notes", "holes")
    kept = regions.select(key, "feature", "part", "label", "notes", "p.points", F.lit(None).cast("string").alias("reason"), F.when(F.col("part") == 0, F.col("holes")).otherwise(0).alias("holes"))
    why = F.when(F.col("g").isNull(), "feature without geometry").when(F.col("g").isin(*_FLAT), F.concat("g", F.lit(" has no area"))).when(F.col("g").isin("Polygon", "MultiPolygon"), "degenerate polygon").otherwise(F.concat(F.lit("unsupported geometry "), "g"))
    lost = shaped.where(F.coalesce(F.size("sound"), F.lit(0)) <= 0).select(key, "feature", why.alias("reason"))
    skipped = lost.unionByName(bad).select(key, "feature", F.lit(0).alias("part"), *(F.lit(None).cast("string").alias(c) for c in ("label", "notes")), F.lit(None).cast("array<struct<x:double,y:double>>").alias("points"), "reason", F.lit(0).alias("holes"))
    return kept.unionByName(skipped)


_ASAP = "Annotations STRUCT<Annotation: ARRAY<STRUCT<_Name: STRING, _Type: STRING, _PartOfGroup: STRING, Coordinates: STRUCT<Coordinate: ARRAY<STRUCT<_Order: STRING, _X: STRING, _Y: STRING>>>>>>"


def asap(documents: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, annotation, label, notes, points, reason) of ASAP XML documents; vertices go by their order's number, else by their place."""
    parsed = documents.select(key, F.from_xml(F.col(text), _ASAP, {"mode": "PERMISSIVE"}).alias("d"))
    each = parsed.select(key, F.posexplode_outer("d.Annotations.Annotation").alias("annotation", "a"))
    vertices = F.transform("a.Coordinates.Coordinate", lambda c, i: F.struct(F.coalesce(c["_Order"].try_cast("int"), i).alias("order"), i.alias("place"), c["_X"].try_cast("double").alias("x"), c["_Y"].try_cast("double").alias("y")))
    kind, group, name = (F.trim(F.coalesce(f"a.{c}", F.lit(""))) for c in ("_Type", "_PartOfGroup", "_Name"))
    told = each.select(key, F.coalesce("annotation", F.lit(0)).alias("annotation"), F.col("a").isNull().alias("none"), kind.alias("kind"), group.alias("group"), name.alias("name"), F.array_sort(vertices).alias("v"))
    points = F.transform("v", lambda p: F.struct(p["x"], p["y"]))
    broken = F.exists("v", lambda p: p["x"].isNull() | p["y"].isNull())
    few = F.coalesce(F.size(F.array_distinct(points)), F.lit(0)) < 3
    why = (
        F.when(F.col("none"), "unreadable ASAP XML")
        .when(F.col("kind") == "Dot", "Dot has no area")
        .when(~F.col("kind").isin("", "Polygon", "Rectangle", "Spline"), F.concat(F.lit("unsupported ASAP type "), "kind"))
        .when(F.coalesce(broken, F.lit(False)), "malformed coordinate")
        .when(few, "degenerate annotation")
    )
    label = F.when(F.lower("group").isin("", "none"), "").otherwise(F.col("group"))
    notes = F.concat(F.lit("imported from ASAP XML"), F.when(F.col("name") != "", F.concat(F.lit(" ("), "name", F.lit(")"))).otherwise(""))
    told = told.withColumn("reason", why)
    fine = F.col("reason").isNull()
    return told.select(key, "annotation", F.when(fine, label).alias("label"), F.when(fine, notes).alias("notes"), F.when(fine, points).alias("points"), "reason")


def skip_counts(rows: DataFrame) -> DataFrame:
    """(reason, n) of what was skipped."""
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def summaries(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, summary): a line a document on what was imported and what wasn't, reasons in their order."""
    reasons = rows.where("reason IS NOT NULL").groupBy(key, "reason").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("why"), F.sum("n").alias("lost"))
    held = rows.groupBy(key).agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.sum("holes").alias("holes")).join(reasons, key, "left")
    detail = F.array_join(F.transform("why", lambda w: F.concat(w["n"], F.lit(" "), w["reason"])), ", ")
    parts = F.array(F.concat("kept", F.lit(" annotation(s) imported")), F.concat("lost", F.lit(" skipped ("), detail, F.lit(")")), F.when(F.col("holes") > 0, F.concat("holes", F.lit(" polygon(s) had interior rings (holes); only the outer outline was imported"))))
    return held.select(key, F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ").alias("summary"))


PAYLOAD = "slide_name STRING, slide_dimensions ARRAY<BIGINT>, mpp DOUBLE, magnification DOUBLE, roi STRUCT<kind: STRING, points_level0: ARRAY<ARRAY<DOUBLE>>, bbox_level0: ARRAY<BIGINT>>, patch_path STRING, stats STRING, created_at STRING, roi_id BIGINT"


def history(lines: DataFrame, line: str = "line") -> DataFrame:
    """The payloads of a history's lines, with the lines' other columns; blank, torn and incomplete lines are left out."""
    told = lines.where(F.trim(line) != "").withColumn("payload", F.from_json(line, PAYLOAD))
    needed = [f for f in ("slide_name", "slide_dimensions", "mpp", "magnification", "roi", "patch_path", "stats", "created_at")]
    whole = F.try_parse_json(line).isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, needed)), F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")))) == 0)
    return told.where(whole).drop(line)


def latest(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """The last payload of a history by the order of its lines."""
    return history(lines, line).orderBy(F.desc(order)).limit(1)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of files with ``seq``, their order within a file: Spark reads a file's splits in order, so the ids rise along it."""
    return lines.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("place"))).drop("place")


def read_history(spark, path: str) -> DataFrame:
    """(path, seq, payload) of a folder of histories."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return history(numbered(lines))
