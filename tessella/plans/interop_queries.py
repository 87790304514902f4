"""Queries of annotation documents and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query
from tessella.sinks import exports
from tessella.sources import annotations

_SQUARE = "concat('[[', cast(x0 AS int), ',', cast(y0 AS int), '],[', cast(x1 AS int), ',', cast(y0 AS int), '],[', cast(x1 AS int), ',', cast(y1 AS int), '],[', cast(x0 AS int), ',', cast(y0 AS int), ']]')"
_GEOJSON = f"""CASE id % 9
    WHEN 0 THEN concat('{{"type": "FeatureCollection", "features": [{{"type": "Feature", "geometry": {{"type": "Polygon", "coordinates": [', {_SQUARE}, ']}}, "properties": {{"objectType": "annotation", "classification": {{"name": "Tumor"}}}}}}]}}')
    WHEN 1 THEN concat('{{"type": "Feature", "geometry": {{"type": "Polygon", "coordinates": [', {_SQUARE}, ', [[1,1],[2,1],[2,2],[1,1]]]}}, "properties": {{"name": "by name"}}}}')
    WHEN 2 THEN '[{{"type": "Feature", "geometry": {{"type": "Point", "coordinates": [1, 2]}}, "properties": {{}}}}, {{"type": "Feature", "geometry": {{"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}}}]'
    WHEN 3 THEN concat('{{"type": "Feature", "geometry": {{"type": "MultiPolygon", "coordinates": [[', {_SQUARE}, '], [[[5,5],[5,5],[6,6],[5,5]]], [', {_SQUARE}, ']]}}, "properties": {{}}}}')
    WHEN 4 THEN '{{"type": "Feature", "geometry": {{"type": "Polygon", "coordinates": [[[1,1],[2,2],[1,1]]]}}, "properties": {{}}}}'
    WHEN 5 THEN '{{not json' WHEN 6 THEN '{{"type": "Feature", "properties": {{}}}}' WHEN 7 THEN '{{"type": "Topology"}}'
    ELSE '{{"type": "Feature", "geometry": {{"type": "Curve", "coordinates": []}}}}' END"""


def _geojson(t: Tables) -> DataFrame:
    return annotations.geojson(t("rois").select("id", F.expr(_GEOJSON).alias("text")))


@query("""SELECT id, CAST(p AS INTEGER) AS part, CASE id % 9 WHEN 0 THEN 'Tumor' WHEN 1 THEN 'by name' ELSE '' END AS label, CASE id % 9 WHEN 0 THEN 'imported from GeoJSON (annotation)' ELSE 'imported from GeoJSON' END AS notes, 3 AS n, CAST(CAST(x1 AS INTEGER) AS DOUBLE) AS right_x, CASE id % 9 WHEN 1 THEN 1 ELSE 0 END AS holes
    FROM rois, range(2) r(p) WHERE id % 9 IN (0, 1, 3) AND (p = 0 OR id % 9 = 3)""")
def geojson_regions(t: Tables) -> DataFrame:
    told = _geojson(t).where("reason IS NULL")
    return told.select("id", "part", "label", "notes", F.size("points").alias("n"), F.element_at("points", 2)["x"].alias("right_x"), "holes")


_WHY = "CASE id % 9 WHEN 2 THEN CASE f WHEN 0 THEN 'Point has no area' ELSE 'LineString has no area' END WHEN 4 THEN 'degenerate polygon' WHEN 5 THEN 'unreadable GeoJSON' WHEN 6 THEN 'feature without geometry' WHEN 7 THEN 'not a GeoJSON FeatureCollection' ELSE 'unsupported geometry Curve' END"


@query(f"SELECT {_WHY} AS reason, count(*) AS n FROM rois, range(2) r(f) WHERE id % 9 IN (2, 4, 5, 6, 7, 8) AND (f = 0 OR id % 9 = 2) GROUP BY 1")
def geojson_skips(t: Tables) -> DataFrame:
    return annotations.skip_counts(_geojson(t))


@query("""SELECT id, CASE id % 9 WHEN 0 THEN '1 annotation(s) imported' WHEN 1 THEN '1 annotation(s) imported; 1 polygon(s) had interior rings (holes); only the outer outline was imported' WHEN 2 THEN '0 annotation(s) imported; 2 skipped (1 LineString has no area, 1 Point has no area)' WHEN 3 THEN '2 annotation(s) imported'
    WHEN 4 THEN '0 annotation(s) imported; 1 skipped (1 degenerate polygon)' WHEN 5 THEN '0 annotation(s) imported; 1 skipped (1 unreadable GeoJSON)' WHEN 6 THEN '0 annotation(s) imported; 1 skipped (1 feature without geometry)' WHEN 7 THEN '0 annotation(s) imported; 1 skipped (1 not a GeoJSON FeatureCollection)' ELSE '0 annotation(s) imported; 1 skipped (1 unsupported geometry Curve)' END AS summary FROM rois""")
def import_summaries(t: Tables) -> DataFrame:
    return annotations.summaries(_geojson(t))


_DOT = """<Coordinate Order="0" X="1" Y="2"/>"""
_ASAP = """concat('<?xml version="1.0"?><ASAP_Annotations><Annotations><Annotation Name="A', id, '" Type="', CASE id % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Rectangle' WHEN 2 THEN 'Dot' ELSE 'Arc' END, '" PartOfGroup="', if(id % 8 = 0, 'None', 'Tumor'), '" Color="#F4FA58"><Coordinates>',
    '<Coordinate Order="2" X="', cast(x1 AS int), '" Y="', cast(y1 AS int), '"/><Coordinate Order="0" X="', cast(x0 AS int), '" Y="', cast(y0 AS int), '"/><Coordinate Order="1" X="', if(id % 5 = 0, 'oops', cast(cast(x1 AS int) AS string)), '" Y="', cast(y0 AS int), '"/></Coordinates></Annotation>',
    '<Annotation Name="" Type="Spline" PartOfGroup="metastases"><Coordinates><Coordinate X="1" Y="1"/><Coordinate X="1" Y="1"/><Coordinate X="2" Y="3"/></Coordinates></Annotation></Annotations><AnnotationGroups><Group Name="Tumor" PartOfGroup="None"/></AnnotationGroups></ASAP_Annotations>')"""


@query("""SELECT id, 0 AS annotation, CASE WHEN id % 4 < 2 AND id % 5 <> 0 THEN CASE WHEN id % 8 = 0 THEN '' ELSE 'Tumor' END END AS label, CASE WHEN id % 4 < 2 AND id % 5 <> 0 THEN concat('imported from ASAP XML (A', id, ')') END AS notes, CASE WHEN id % 4 < 2 AND id % 5 <> 0 THEN CAST(CAST(x0 AS INTEGER) AS DOUBLE) END AS first_x,
    CASE WHEN id % 4 < 2 AND id % 5 <> 0 THEN CAST(CAST(y1 AS INTEGER) AS DOUBLE) END AS last_y, CASE id % 4 WHEN 2 THEN 'Dot has no area' WHEN 3 THEN 'unsupported ASAP type Arc' ELSE CASE WHEN id % 5 = 0 THEN 'malformed coordinate' END END AS reason FROM rois UNION ALL SELECT id, 1, NULL, NULL, NULL, NULL, 'degenerate annotation' FROM rois""")
def asap_regions(t: Tables) -> DataFrame:
    """Annotations of XML documents, vertices in the order that they are numbered in."""
    told = annotations.asap(t("rois").select("id", F.expr(_ASAP).alias("text")))
    return told.select("id", "annotation", "label", "notes", F.element_at("points", 1)["x"].alias("first_x"), F.element_at("points", -1)["y"].alias("last_y"), "reason")


_LINE = """CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN '{"slide_name": "torn", "slide_dim' WHEN 2 THEN '{"slide_name": "short"}' ELSE concat('{"slide_name": "s', slide_id, '", "slide_dimensions": [100, 200], "mpp": ', if(id % 4 = 0, 'null', '0.5'), ', "magnification": 40.0, "roi": {"kind": "', kind, '", "points_level0": [[1, 2], [3, 4]], "bbox_level0": [1, 2, 3, 4]}, "patch_path": "/p/', id, '.png", "stats": {"tissue_fraction": 0.25}, "created_at": "2024-01-01T00:00:00+00:00"', if(id % 5 = 0, concat(', "roi_id": ', id), ''), '}') END"""


@query("""SELECT id, concat('s', slide_id) AS slide_name, kind, CASE WHEN id % 4 = 0 THEN NULL ELSE 0.5 END AS mpp, CASE WHEN id % 5 = 0 THEN id END AS roi_id, CAST(3 AS BIGINT) AS x1, '0.25' AS tissue FROM rois WHERE id % 6 > 2""")
def history_payloads(t: Tables) -> DataFrame:
    """Payloads of a history with blank, torn and incomplete lines."""
    told = annotations.history(t("rois").select("id", F.expr(_LINE).alias("line")))
    return told.select("id", "payload.slide_name", F.col("payload.roi.kind").alias("kind"), "payload.mpp", "payload.roi_id", F.element_at("payload.roi.bbox_level0", 3).alias("x1"), F.get_json_object("payload.stats", "$.tissue_fraction").alias("tissue"))


@query("""SELECT id, concat('s', slide_id) AS slide_name FROM rois WHERE id % 6 > 2 ORDER BY id DESC LIMIT 1""")
def history_latest(t: Tables) -> DataFrame:
    told = annotations.latest(t("rois").select("id", F.expr(_LINE).alias("line")), "id")
    return told.select("id", "payload.slide_name")


def _exported(t: Tables) -> DataFrame:
    points = F.expr("CASE kind WHEN 'polygon' THEN array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1)) WHEN 'rect' THEN array(named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y0)) END")
    own = t("rois").withColumns({"points": points, "notes": F.when(F.col("id") % 2 == 0, "n"), "x0": F.when(F.col("has_bbox") == 1, F.col("x0"))})
    mpp = t("slides").select(F.col("id").alias("slide_id"), "mpp")
    return own.join(mpp, "slide_id", "left")


@query("""SELECT r.id, r.kind, r.label, CASE WHEN r.label = '' THEN NULL ELSE r.label END AS class, CASE WHEN r.id % 2 = 0 THEN 'n' ELSE '' END AS notes, s.mpp, CASE r.kind WHEN 'polygon' THEN 4 ELSE 5 END AS n, CAST(CASE WHEN r.label = '' THEN 5 ELSE 6 END AS INTEGER) AS n_properties FROM rois r LEFT JOIN slides s ON r.slide_id = s.id WHERE has_bbox = 1""")
def geojson_features(t: Tables) -> DataFrame:
    """Regions exported as features, read back; those without a box are left out, an empty label has no class, an unknown resolution is null."""
    own = _exported(t)
    told = exports.features(own, F.col("mpp")).withColumn("p", F.get_json_object("feature", "$.properties"))
    read = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<array<double>>>")
    fields = F.from_json("p", "kind STRING, label STRING, notes STRING, mpp DOUBLE, classification STRUCT<name: STRING>")
    return told.withColumn("f", fields).select("id", "f.kind", "f.label", F.col("f.classification.name").alias("class"), "f.notes", "f.mpp", F.size(F.element_at(read, 1)).alias("n"), F.size(F.json_object_keys("p")).alias("n_properties"))


@query("""SELECT concat('id,slide_id,slide_name,kind,label', chr(13), chr(10), coalesce(string_agg(concat(r.id, ',', r.slide_id, ',', chr(34), s.name, ', ', chr(34), chr(34), 'x', chr(34), chr(34), chr(34), ',', r.kind, ',', r.label, chr(13), chr(10)), '' ORDER BY r.id), '')) AS text FROM rois r JOIN slides s ON r.slide_id = s.id WHERE r.slide_id = 4""")
def rois_as_csv(t: Tables) -> DataFrame:
    """A slide's regions as the text of a CSV file, with the slide's name in quotes where it needs them."""
    own = t("rois").where("slide_id = 4").join(t("slides").select(F.col("id").alias("slide_id"), F.concat("name", F.lit(', "x"')).alias("slide_name")), "slide_id")
    return exports.csv_text(own, "id", ["id", "slide_id", "slide_name", "kind", "label"], "\r\n")


@query("""SELECT concat('[', coalesce(string_agg(concat('{"id":', r.id, ',"kind":"', r.kind, '","label":', CASE WHEN r.label = '' THEN 'null' ELSE concat('"', r.label, '"') END, ',"box":[', CAST(x0 AS BIGINT), ',', CAST(y0 AS BIGINT), ']}'), ',' ORDER BY r.id), ''), ']') AS text FROM rois r WHERE r.slide_id = 4""")
def rois_as_json(t: Tables) -> DataFrame:
    own = t("rois").where("slide_id = 4").select("id", "kind", F.nullif("label", F.lit("")).alias("label"), F.array(F.col("x0").cast("long"), F.col("y0").cast("long")).alias("box"))
    return exports.json_text(own, "id")


@query("""SELECT id, concat(id, ',', CASE WHEN label = '' THEN '' ELSE label END, ',', CASE WHEN id % 3 = 0 THEN '' ELSE concat('"[', CAST(x0 AS BIGINT), ',', CAST(y0 AS BIGINT), ']"') END) AS line FROM rois""")
def stats_csv_lines(t: Tables) -> DataFrame:
    """A line for every region: NULL is empty, a list one cell of compact JSON."""
    own = t("rois").select("id", F.nullif("label", F.lit("")).alias("label"), F.when(F.col("id") % 3 != 0, F.array(F.col("x0").cast("long"), F.col("y0").cast("long"))).alias("box"))
    kinds = dict(own.dtypes)
    return own.select("id", F.concat_ws(",", *(exports.csv_cell(F.col(c), kinds[c]) for c in own.columns)).alias("line"))
