"""Pixel operators against numpy on small images, and the classifier on separable rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import models as M
from tessella.operators import pixels as P


@pytest.fixture(scope="module")
def image():
    """White with dark violet discs; 48 x 32."""
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:32, 0:48]
    out = np.full((32, 48, 3), 240.0) + rng.normal(0, 4, (32, 48, 3))
    for cx, cy, r in ((10, 10, 5), (30, 8, 4), (24, 24, 6), (45, 30, 1)):
        out[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = (90, 50, 130)
    return np.clip(out, 0, 255).astype(np.int64)


@pytest.fixture(scope="module")
def pixels(spark, image):
    rows = [(1, x, y, *map(int, image[y, x])) for y in range(32) for x in range(48)]
    return spark.createDataFrame(rows, "slide long, px long, py long, r long, g long, b long").cache()


def test_blur_is_the_variance_of_the_laplacian(pixels, image):
    g = (image @ np.array([19595, 38470, 7471]) + 32768) // 65536
    p = np.pad(g, 1, mode="symmetric").astype(float)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    got = P.blur(pixels, ["slide"]).first()
    assert got["blur"] == pytest.approx(lap.var()) and got["brightness"] == pytest.approx(image.mean()) and not got["blurry"]


def test_nuclei_are_the_discs(pixels, image):
    dark = int((image[..., 0] == 90).sum())
    got = P.nuclei(pixels, ["slide"], least=20).first()
    lone = int((image[28:, 43:, 0] == 90).sum())
    assert got["count"] == 3 and got["mean_area"] == pytest.approx((dark - lone) / 3) and got["coverage"] == pytest.approx((dark - lone) / image[..., 0].size)


def test_an_image_of_one_colour_has_no_nuclei(spark):
    flat = spark.createDataFrame([(1, x, y, 200, 200, 200) for x in range(5) for y in range(5)], "slide long, px long, py long, r long, g long, b long")
    assert tuple(P.nuclei(flat, ["slide"]).first())[1:] == (0.0, 0.0, 0.0)
    assert P.otsu(flat, ["slide"], P.gray().cast("double")).first()["threshold"] is None


def test_blobs_touch_by_their_sides(spark):
    on = ["##..#", "#...#", "..#..", ".##.."]
    df = spark.createDataFrame([(1, x, y, c == "#") for y, row in enumerate(on) for x, c in enumerate(row)], "slide long, px long, py long, on boolean")
    assert sorted(r["area"] for r in P.blobs(df, ["slide"], F.col("on"), 1).collect()) == [2, 3, 3]


def test_an_empty_shape_falls_back_to_the_tissue(pixels, image):
    lum = image @ np.array(P.LUMA)
    got = P.region_stats(pixels, ["slide"], F.lit(False)).first()
    assert got["mean_r"] == pytest.approx(image[lum < 229.5][:, 0].mean()) and got["tissue"] == pytest.approx((lum < 229.5).mean())
    ring = P.in_ring([(0, 0), (8, 0), (8, 8), (0, 8)])
    assert P.region_stats(pixels.where(ring), ["slide"], F.lit(True)).first()["n"] == 64


def test_stains_go_to_the_reference_and_back(pixels):
    own = P.stain_reference(pixels, "macenko")
    same = P.normalized(pixels, "macenko", own).join(pixels.select("px", "py", F.col("r").alias("was")), ["px", "py"])
    assert same.select(F.avg(F.abs(F.col("r") - F.col("was")))).first()[0] < 12
    assert np.array(own["stain_matrix"])[0][0] >= np.array(own["stain_matrix"])[1][0] and len(own["max_conc"]) == 2
    with pytest.raises(ValueError, match="macenko"):
        P.normalized(pixels, "unheard of")
    flat = P.reinhard(pixels, ["slide"]).withColumn("l", P.lab()[0]).agg(F.avg("l"), F.stddev_pop("l")).first()
    assert flat[0] == pytest.approx(62, abs=3)


def test_there_are_56_features(pixels):
    got = P.feature_vector(pixels, ["slide"]).first()["features"]
    assert len(got) == 56 and all(np.isfinite(got)) and sum(got[15:23]) == pytest.approx(1) and got[41] == 3


def test_the_scale_begins_and_ends_as_it_should(spark):
    ends = spark.createDataFrame([(0,), (255,)], "s int").select(*(P.colour(F.col("s"), i).alias(str(i)) for i in range(3)))
    assert [tuple(r) for r in ends.collect()] == [(68, 1, 84), (253, 231, 37)]


def test_tiles_that_fail_are_told(spark):
    def metric(row):
        if row["x"] == 2:
            raise ValueError("no")
        return row["x"] / 2

    got = spark.range(4).withColumnRenamed("id", "x").mapInPandas(lambda it: P.sweep(it, metric), "x long, value double, error string").collect()
    assert {r["x"]: (r["value"], r["error"]) for r in got} == {0: (0.0, None), 1: (0.5, None), 2: (None, "ValueError: no"), 3: (1.5, None)}


def test_classifier(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], [float(v) for v in rng.normal(3 * (i % 2), 1, 4)]) for i in range(60)] + [(99, " ", [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    model = M.train(df)
    assert model.counts == {"a": 30, "b": 30} and model.accuracy > 0.9
    told = M.predict(model, df.where("id < 60")).collect()
    assert sum(r["predicted"] == r["label"] for r in told) > 55
    assert all(abs(sum(p["p"] for p in r["probabilities"]) - 1) < 1e-9 and r["probabilities"][0]["p"] >= r["probabilities"][1]["p"] for r in told)
    with pytest.raises(ValueError, match="unknown label"):
        M.label_metric(model, "c")
    with pytest.raises(ValueError, match="two labels"):
        M.train(df.where("label = 'a'"))
    path = M.save(model, str(tmp_path), "m")
    (tmp_path / "m" / "broken").mkdir()
    (tmp_path / "m" / "broken" / "meta.json").write_text("{not json")
    assert [r["name"] for r in M.listed(spark, str(tmp_path)).collect()] == ["m"]
    again = M.label_metric(M.load(spark, path), "a")(df.where("id = 0")).first()["value"]
    assert again == pytest.approx(next(p["p"] for r in told if r["id"] == 0 for p in r["probabilities"] if p["label"] == "a"))


def test_image_files_become_tiles_and_pixels(spark, tmp_path):
    import struct
    import zlib

    from tessella.sources import rasters

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in image)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.txt").write_text("no image")
    assert sorted(r["format"] or "" for r in rasters.formats(spark, str(tmp_path)).collect()) == ["", "png"]
    cut = rasters.tiles(rasters.images(spark, str(tmp_path)), 16)
    assert sorted((r["col"], r["row"], r["width"], r["height"]) for r in cut.collect()) == [(0, 0, 16, 16), (0, 1, 16, 4), (1, 0, 14, 16), (1, 1, 14, 4)]
    got = {(r["px"], r["py"]): (r["r"], r["g"], r["b"]) for r in rasters.pixels(cut, 16).collect()}
    assert got == {(x, y): tuple(map(int, image[y, x])) for y in range(20) for x in range(30)}
    edge = rasters.region(rasters.pixels(cut, 16), ["path"], 28, 18, 4, 4).collect()
    assert len(edge) == 16 and sum((r["r"], r["g"], r["b"]) == (255, 255, 255) for r in edge) >= 12


def test_the_synthetic_slide_is_the_same_each_time(spark):
    from tessella.sources import rasters

    one, two = (sorted(map(tuple, rasters.synthetic(spark, 200, 40).collect())) for _ in range(2))
    assert one == two and len(one) == 8000 and min(r[2] for r in one) < 110 < 220 < max(r[2] for r in one)
