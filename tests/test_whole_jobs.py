"""Queries over whole tables: every row takes part, against expectations worked out apart from their SQL."""

import math
import statistics
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessella.functions import strings
from tessella.operators import relational as R
from tessella.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def table(name):
    return pq.read_table(DATA / f"{name}.parquet").to_pylist()


def test_every_measurement_has_a_version(spark):
    got = QUERIES["measurement_history"](spark, str(DATA)).collect()
    want = Counter((r["l_orderkey"], r["l_returnflag"]) for r in table("lineitem"))
    assert Counter((r["annotation_id"], r["name"]) for r in got) == want
    versions = {(r["annotation_id"], r["name"], r["version"]) for r in got}
    assert versions == {(*k, i) for k, n in want.items() for i in range(1, n + 1)}


def test_every_region_is_measured(spark):
    got = {r["id"]: r for r in QUERIES["measure_box"](spark, str(DATA)).collect()}
    n_slides = len(table("supplier"))
    mpp = {r["s_suppkey"]: None if r["s_suppkey"] % 5 == 4 else 0.25 * (1 + r["s_suppkey"] % 3) for r in table("supplier")}
    orders = table("orders")
    assert len(got) == len(orders) and {mpp.get(r["o_custkey"] % n_slides) for r in orders} >= {None, 0.25}
    for r in orders:
        w, h, m, own = 50 + r["o_custkey"] % 450, 50 + r["o_orderkey"] % 300, mpp.get(r["o_custkey"] % n_slides), got[r["o_orderkey"]]
        assert (own["width_px"], own["height_px"]) == (w, h)
        want = (None,) * 3 if m is None else (w * m, h * m, math.hypot(w, h) * m)
        assert all(a == b if b is None else math.isclose(a, b) for a, b in zip((own["width_um"], own["height_um"], own["diagonal_um"]), want, strict=True))


def split(total, workers):
    n = max(1, min(workers, 16, total))
    sizes = [total // n + (i < total % n) for i in range(n)] if total > 0 else []
    return [(sum(sizes[:i]), sum(sizes[: i + 1]) - 1) for i in range(len(sizes))]


def test_ranges_of_a_file(spark):
    cases = [(10, 4), (3, 8), (1, 1), (0, 4), (-5, 4), (100, 0), (100, 40), (2**53 + 3, 16)]
    assert split(10, 4) == [(0, 2), (3, 5), (6, 7), (8, 9)]
    df = spark.createDataFrame(cases, "total long, workers int").select("total", "workers", strings.split_ranges(F.col("total"), F.col("workers")).alias("r"))
    for r in df.collect():
        assert [tuple(x) for x in r["r"]] == split(r["total"], r["workers"])


def test_every_file_is_split_by_its_own_size(spark):
    got = sorted(tuple(r) for r in QUERIES["byte_ranges"](spark, str(DATA)).collect())
    held = {r["c_custkey"] for r in table("customer")}
    assert got == sorted((r["o_orderkey"], i, *x) for r in table("orders") if r["o_custkey"] in held for i, x in enumerate(split(math.floor(r["o_totalprice"]), 8)))


def test_statistics_of_every_dimension(spark):
    values = {}
    for r in table("embeddings"):
        for dim, v in enumerate(r["embedding"]):
            values.setdefault((r["label"], dim), []).append(v)
    got = {(r["label"], r["dim"]): r for r in QUERIES["feature_stats_by_label"](spark, str(DATA)).collect()}
    assert got.keys() == values.keys() and max(d for _, d in got) > 8
    for k, own in values.items():
        assert abs(got[k]["mean_v"] - statistics.fmean(own)) < 1e-5 and abs(got[k]["sd_v"] - statistics.pstdev(own)) < 1e-5


def test_viewports_change_by_centre_zoom_or_size(spark):
    steps = [(1000.0, 800.0, 2.0, 400, True), (1000.5, 800.0, 2.005, 400, False), (1010.0, 800.0, 2.0, 400, True), (1010.0, 800.0, 2.5, 400, True), (1010.0, 800.0, 2.5, 401, True), (1011.25, 800.0, 2.5, 401, True), (1012.0, 800.0, 2.5, 401, False), (1012.0, 800.0, 2.53, 401, True), (1012.0, 800.0, 0.0, 401, True), (1012.0, 800.0, 1.0, 401, False)]
    df = spark.createDataFrame([(1, i, x, y, ds, w, 300, want) for i, (x, y, ds, w, want) in enumerate(steps)] + [(2, 99, 0.0, 0.0, 1.0, 1, 1, True)], "s int, id int, cx double, cy double, ds double, width int, height int, want boolean")
    assert all(r["changed"] == r["want"] for r in R.viewport_changed(df, "s", ["id"]).collect())


def test_viewport_changes_of_every_session(spark):
    got = QUERIES["viewport_changes"](spark, str(DATA)).collect()
    assert {r["session_id"]: r["n"] for r in got} == Counter(r["user_id"] for r in table("events"))
    assert 0 < sum(r["changes"] for r in got) < sum(r["n"] for r in got)


def test_of_equally_late_resolutions_the_first_counts(spark, tmp_path):
    for f in DATA.iterdir():
        if f.stem != "lineitem":
            (tmp_path / f.name).symlink_to(f)
    held = pq.read_table(DATA / "lineitem.parquet")
    lines = [(-1, 3, 0.1), (-1, 3, 0.2), (-1, 5, None), (-2, 1, None), (-3, None, 0.3), (-3, None, 0.4), (None, 2, 0.5), (None, 2, 0.6), (0, 7, 0.7), (0, 7, 0.8), (1, 6, 0.9)]
    odd = pa.table({c: pa.array([r[i] for r in lines], held.schema.field(c).type) for i, c in enumerate(("l_orderkey", "l_linenumber", "l_discount"))})
    for c in held.column_names:
        if c not in odd.column_names:
            odd = odd.append_column(c, held[c][: len(lines)])
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    pq.write_table(odd.select(held.column_names), folder / "a.parquet")  # Spark reads the larger file first
    pq.write_table(held, folder / "b.parquet")
    connection = duckdb.connect()
    connection.sql("SET threads = 1")
    connection.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = connection.sql(ORACLES["resolutions_recorded"]).fetchall()
    got = [tuple(r) for r in QUERIES["resolutions_recorded"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(-1, 1, 0.1), (-2, 1, None), (-3, None, None), (None, 0, 0.5), (0, 1, 0.7), (1, 0, 0.9)} <= set(got)
