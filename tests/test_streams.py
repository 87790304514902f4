"""Streams of the store's log, fed by files."""

import json

from pyspark.sql import functions as F

from tessella.sources import annotations
from tessella.streaming import interactions as I


def run(df, spark, mode="append", name="out"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).json(str(folder))


def test_only_moved_viewports_come_through(spark, tmp_path):
    schema = "session_id long, id long, created_at timestamp, cx double, cy double, ds double, width int, height int"
    steps = [(1000.0, 2.0, 400), (1000.5, 2.005, 400), (1010.0, 2.0, 400), (1010.0, 2.5, 400), (1010.0, 2.5, 401)]
    rows = [(1, i, None, x, 800.0, ds, w, 300) for i, (x, ds, w) in enumerate(steps)] + [(2, 9, None, 0.0, 0.0, 1.0, 1, 1)]
    got = run(I.viewport_moves(stream(spark, tmp_path / "in", rows, schema)), spark, name="moves")
    assert sorted((r["session_id"], r["id"]) for r in got) == [(1, 0), (1, 2), (1, 3), (1, 4), (2, 9)]


def test_windows_and_sessions(spark, tmp_path):
    from datetime import datetime

    schema = "session_id long, kind string, created_at timestamp"
    at = [datetime(2024, 1, 1, h, m) for h, m in ((0, 5), (0, 20), (1, 30), (1, 50))]
    events = stream(spark, tmp_path / "in", [(1, "open", t) for t in at], schema)
    assert sorted(r["n"] for r in run(I.by_window(events), spark, "complete", "windows")) == [2, 2]
    assert sorted(r["n"] for r in run(I.by_session(events), spark, "complete", "sessions")) == [2, 2]


def test_history_survives_a_torn_line(spark, tmp_path):
    whole = {"slide_name": "s", "slide_dimensions": [1, 2], "mpp": None, "magnification": None, "roi": {"kind": "rect", "points_level0": [], "bbox_level0": [1, 2, 3, 4]}, "patch_path": "p", "stats": {"tissue_fraction": 0.5}, "created_at": "t"}
    lines = [json.dumps(whole), "", json.dumps(whole | {"slide_name": "u", "roi_id": 4}), json.dumps(whole)[:40]]
    (tmp_path / "h.jsonl").write_text("\n".join(lines))
    got = sorted((r["seq"], r["payload"]["slide_name"], r["payload"]["roi_id"]) for r in annotations.read_history(spark, str(tmp_path / "h.jsonl")).collect())
    assert got == [(1, "s", None), (3, "u", 4)]
    told = run(I.payloads(spark.readStream.text(str(tmp_path))), spark, name="payloads")
    assert sorted(r["slide_name"] for r in told) == ["s", "u"]


def test_stale_results_and_progress(spark):
    results, now = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.4)], "slide_id int, version int, v double"), spark.createDataFrame([(1, 3)], "slide_id int, version int")
    assert [r["v"] for r in I.fresh(results, now).collect()] == [0.5]
    told = []
    progress = I.Progress(3, lambda done, total: told.append((done, total)) or 1 / 0)
    progress.batch(spark.range(2), 0)
    progress.batch(spark.range(2), 1)
    assert told == [(2, 3), (3, 3)]


def test_prompt_names_what_is_unknown(spark):
    from tessella.sinks import exports

    line = json.dumps({"slide_name": "s", "slide_dimensions": [10, 20], "mpp": None, "magnification": 40.0, "roi": {"kind": "rect", "points_level0": [[1, 2]], "bbox_level0": [1, 2, 4, 8]}, "patch_path": "p", "stats": {"tissue_fraction": 0.5}, "created_at": "t"})
    df = annotations.history(spark.createDataFrame([(line,)], "line string"))
    text = df.select(exports.prompt(F.col("payload"))).first()[0]
    assert "- Microns-per-pixel: unknown" in text and "40.0x" in text and "(3x6 px)" in text
