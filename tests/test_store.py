"""Merges, cascades, snapshots, geometry, strings and documents against expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry, jsonx, strings
from tessella.operators import relational as R
from tessella.operators import store as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_box_of_rectangle_and_circle(spark):
    points = F.expr("array(named_struct('x', 10.2D, 'y', 20.7D), named_struct('x', 110.9D, 'y', 220.1D))")
    assert tuple(one(spark, geometry.bbox(F.lit("rect"), points), a=1)) == (10, 20, 111, 221)
    circle = F.expr("array(named_struct('x', 100D, 'y', 100D), named_struct('x', 130D, 'y', 100D))")
    assert tuple(one(spark, geometry.bbox(F.lit("circle"), circle), a=1)) == (70, 70, 130, 130)
    assert one(spark, geometry.bbox(F.lit("rect"), F.expr("cast(array() AS array<struct<x:double,y:double>>)")), a=1) is None


def test_magnification_levels_and_grid(spark):
    assert [one(spark, geometry.magnification(F.lit(m), F.lit(d)), a=1) for m, d in ((2.0, 1), (2.0, 4), (0.25, 1))] == [10.0, 2.5, 80.0]
    assert one(spark, geometry.magnification(F.lit(0.0), F.lit(1)), a=1) is None
    assert [one(spark, geometry.max_level(F.lit(w), F.lit(h)), a=1) for w, h in ((6000, 4000), (1, 1), (1024, 1), (1025, 1))] == [13, 0, 10, 11]
    for tile, down, want in ((128, 4, (2, 2)), (100, 1, (11, 8))):
        cols, rows = geometry.grid_shape(F.lit(1024), F.lit(768), tile, down)
        assert (one(spark, cols, a=1), one(spark, rows, a=1)) == want


def test_barcodes_and_paths(spark):
    want = {
        "TCGA-BH-A18H-01A-01-TSA.uuid.svs": ("TCGA", "TCGA-BH-A18H", "TCGA-BH-A18H-01A", "01", "Primary Tumor", "TSA"),
        "dir/tcga-bh-a18h-11A-01-TS1.svs": ("TCGA", "TCGA-BH-A18H", "TCGA-BH-A18H-11A", "11", "Solid Tissue Normal", "TS1"),
        "d\\HCM-ABCD-A18H12-07": ("HCM", "HCM-ABCD-A18H12", "HCM-ABCD-A18H12-07", "07", "Additional Metastatic", None),
        "TCGA-BH-A18H-05A": ("TCGA", "TCGA-BH-A18H", "TCGA-BH-A18H-05A", "05", None, None),
        "TCGA-BH-A18H": ("TCGA", "TCGA-BH-A18H", None, None, None, None),
        "not-a-barcode.svs": (None,) * 6,
        "": (None,) * 6,
    }
    for text, parts in want.items():
        assert tuple(one(spark, strings.barcode(F.lit(text)), a=1)) == parts
    assert one(spark, strings.safe_component(F.lit("gdc:../a b/._x  y_."), "f"), a=1) == "x__y"
    assert one(spark, strings.safe_component(F.lit("..."), "f"), a=1) == "f"
    assert one(spark, strings.stated_mpp(F.lit("a|MPP = 0.4942|b")), a=1) == 0.4942
    assert [one(spark, strings.percent(F.lit(d), F.lit(t)), a=1) for d, t in ((1, 8), (5, 2), (1, 0))] == [12, 100, None]
    assert one(spark, strings.storage_path(F.lit("P"), F.lit(None).cast("string"), F.lit("id"), F.lit("x/TCGA-BH-A18H-01A.svs")), a=1) == "P/TCGA-BH-A18H/TCGA-BH-A18H-01A.svs"
    assert one(spark, strings.storage_path(F.lit(None).cast("string"), F.lit(""), F.lit("a/../id"), F.lit(None).cast("string")), a=1) == "unknown-project/unknown-case/id.svs"


def test_malformed_documents_are_empty(spark):
    texts = ['{"tissue_fraction": 0.5}', "{not json", "[1]", "{}", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(jsonx.has_keys(F.col("t")).alias("k"), jsonx.stats(F.col("t"))["tissue_fraction"].alias("v"))
    assert [tuple(r) for r in df.collect()] == [(True, 0.5), (False, None), (False, None), (False, None), (False, None)]


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", 0.5, "p"), (2, "b", 0.5, None)], "id int, name string, mpp double, path string")
    new = spark.createDataFrame([(1, "A", None, None), (3, "c", 1.0, "q")], "id int, name string, mpp double, path string")
    got = {r["id"]: tuple(r)[1:] for r in S.merge(old, new, ["id"], overwrite=["mpp"], keep_if_null=["path"], backfill=["name"]).collect()}
    assert got == {1: ("a", None, "p", "updated"), 2: ("b", 0.5, None, "kept"), 3: ("c", 1.0, "q", "inserted")}
    assert S.insert_ignore(old, new, ["id"]).count() == 3


def test_snapshots_and_cascade(spark, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"))
    slides = spark.createDataFrame([(1,), (2,)], "id int")
    rois = spark.createDataFrame([(10, 1), (11, 2)], "id int, slide_id int")
    log = spark.createDataFrame([(5, 1), (6, 2)], "id int, slide_id int")
    assert store.version() == 0 and store.commit({"slides": slides, "rois": rois, "log": log}) == 1
    left = S.delete_cascade({n: store.read(n) for n in ("slides", "rois", "log")}, slides.where("id = 1"), "slides", {"rois": ("slides", "slide_id")}, {"log": ("slides", "slide_id")})
    assert store.commit(left) == 2
    assert [r["id"] for r in store.read("rois").collect()] == [11] and store.read("rois", 1).count() == 2
    assert {r["id"]: r["slide_id"] for r in store.read("log").collect()} == {5: None, 6: 2}


def test_deviation_needs_two_values(spark):
    rows = spark.createDataFrame([("a", 0.4), ("a", 0.6), ("b", 1.0)], "label string, v double")
    got = {r["label"]: (r["v_mean"], r["v_sd"]) for r in R.label_summary(rows, ["v"]).collect()}
    assert got == {"a": (0.5, pytest.approx(0.1)), "b": (1.0, None)}


def test_overlaps_against_all_pairs(spark):
    import random

    random.seed(5)
    boxes = [(i, 0, x := random.random() * 100, y := random.random() * 100, x + random.random() * 30, y + random.random() * 30) for i in range(60)]
    df = spark.createDataFrame(boxes, "id int, slide_id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["a_id"], r["b_id"]) for r in R.overlaps(df, df, 16.0).where("a_id < b_id").collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want


def test_sizes_of_nothing(spark):
    assert [one(spark, geometry.physical(F.lit(p), F.lit(m)), a=1) for p, m in ((0.0, 0.5), (-3.0, 0.5), (2.0, 0.5))] == [0.0, 0.0, 1.0]
    assert one(spark, geometry.physical(F.lit(2.0), F.lit(None).cast("double")), a=1) is None
    assert one(spark, geometry.area_mm2(F.lit(0.0), F.lit(5.0)), a=1) is None and one(spark, geometry.area_mm2(F.lit(1000.0), F.lit(1000.0)), a=1) == 1.0


def test_rows_without_a_key_stay_alone(spark):
    rows = spark.createDataFrame([(1, "k"), (2, None), (3, "k"), (4, None)], "id int, key string")
    assert {r["id"]: r["keeper"] for r in R.remap_to_keeper(rows, ["key"]).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert [tuple(r) for r in R.duplicates(rows, ["key"]).collect()] == [("k", 2, 1)]


def test_a_torn_version_is_never_read_or_written(spark, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"))
    one_row = spark.createDataFrame([(1,)], "id int")
    assert store.commit({"t": one_row}) == 1
    one_row.write.parquet(str(tmp_path / "store" / "v2" / "t"))  # a crash before the marker
    assert store.version() == 1 and store.commit({"t": one_row.unionByName(one_row)}, {"t": ["id"]}) == 3
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 1


def test_ids_follow_each_other(spark):
    rows = spark.range(1000).repartition(7).select("id").withColumnRenamed("id", "x")
    assert sorted(r["id"] for r in S.allocate_ids(rows, 40).collect()) == list(range(41, 1041))


def test_migrations_run_in_order_once(spark, tmp_path):
    from tessella.operators import maintenance as M

    store = S.Snapshots(spark, str(tmp_path / "store"))
    store.commit({"t": spark.createDataFrame([(1, "a")], "id int, name string")})
    steps = {2: lambda t: {"t": t["t"].withColumn("x", F.lit(2))}, 3: lambda t: {"t": t["t"].withColumn("y", F.col("x") + 1)}}
    assert M.migrate(store, ["t"], steps, 1) == 3 and tuple(store.read("t").first()) == (1, "a", 2, 3)
    assert M.migrate(store, ["t"], steps, 3) == 3 and store.version() == 2
    full = M.completed(store.read("t"), spark.createDataFrame([], "id int, z double").schema)
    assert full.dtypes[-1] == ("z", "double") and M.schema_diff(store.read("t").schema, full.schema) == [("lost", "z")]
    told = {r["check"]: r["n"] for r in M.doctor({"t": full, "u": spark.createDataFrame([(5,), (1,)], "t_id int")}, {("u", "t_id"): "t"}).collect()}
    assert told == {"rows t": 1, "rows u": 2, "dangling u.t_id": 1}


def test_images_below_a_folder(spark, tmp_path):
    from tessella.operators import maintenance as M

    for name in ("b.SVS", "sub/a.png", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert [(r["name"], r["size"]) for r in M.ingest(spark, str(tmp_path)).collect()] == [("b.SVS", 5), ("a.png", 5)]
    assert [r["name"] for r in M.ingest(spark, str(tmp_path), recursive=False).collect()] == ["b.SVS"]


def test_tools_answer_in_json(spark, tmp_path):
    import json

    from tessella.operators.tools import Tools

    store = S.Snapshots(spark, str(tmp_path / "store"))
    store.commit({"slides": spark.createDataFrame([(1, "s", 100, 200, 0.5)], "id long, name string, width int, height int, mpp double"), "rois": spark.createDataFrame([(7, 1, "a", None), (8, 1, "b", "n")], "id long, slide_id long, label string, notes string"), "interactions": spark.createDataFrame([], "kind string, payload string, roi_id long")})
    tools = Tools(store, 1, lambda: None, {"nuclei": True})
    assert tools.get_current_selection() == "NO_SELECTION" and json.loads(tools.get_analysis_capabilities()) == {"nuclei": True}
    assert json.loads(tools.get_slide_info())["annotation_count"] == 2 and Tools(store, None).get_slide_info() == "NO_SLIDE"
    assert json.loads(tools.annotate_roi(7, label="new")) == {"id": 7, "slide_id": 1, "label": "new", "notes": None}
    assert "not found" in tools.annotate_roi(99) and "invalid" in tools.annotate_roi("x")
    assert [r["id"] for r in json.loads(tools.query_annotations(limit=0))] == [7] and [r["id"] for r in json.loads(tools.query_annotations("b", "many"))] == [8]
    assert store.read("interactions").first()["kind"] == "label_set" and Tools(store, None).query_annotations() == "[]"
