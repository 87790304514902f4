"""Queries of viewports, tiles, regions and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry, selections
from tessella.plans.registry import Tables, query

_POINTS = """CASE kind WHEN 'circle' THEN array(named_struct('x', x0, 'y', y0), named_struct('x', x0 + 40, 'y', y0 + 30))
    WHEN 'rect' THEN array(named_struct('x', x1 + 0.75D, 'y', y1 + 0.25D), named_struct('x', x0 + 0.25D, 'y', y0 + 0.5D))
    ELSE array(named_struct('x', x0 - 300, 'y', y0 + 0.5D), named_struct('x', x1, 'y', y1 + 0.25D), named_struct('x', x0 + 10, 'y', y1 + 7)) END"""


def _shapes(t: Tables) -> DataFrame:
    return t("rois").withColumn("points", F.expr(_POINTS))


@query("""SELECT id, CAST(greatest(0, floor(CASE kind WHEN 'circle' THEN x0 - 50 WHEN 'rect' THEN x0 + 0.25 ELSE least(x0 - 300, x1) END)) AS BIGINT) AS x0, CAST(greatest(0, floor(CASE kind WHEN 'circle' THEN y0 - 50 WHEN 'rect' THEN y0 + 0.5 ELSE y0 + 0.5 END)) AS BIGINT) AS y0,
    CAST(greatest(0, ceil(CASE kind WHEN 'circle' THEN x0 + 50 WHEN 'rect' THEN x1 + 0.75 ELSE greatest(x1, x0 + 10) END)) AS BIGINT) AS x1, CAST(greatest(0, ceil(CASE kind WHEN 'circle' THEN y0 + 50 WHEN 'rect' THEN y1 + 0.25 ELSE y1 + 7 END)) AS BIGINT) AS y1 FROM rois""")
def roi_bbox(t: Tables) -> DataFrame:
    return _shapes(t).select("id", geometry.bbox(F.col("kind"), F.col("points")).alias("b")).select("id", "b.*")


@query("""SELECT id, CAST(CASE kind WHEN 'circle' THEN 65 WHEN 'rect' THEN 5 ELSE 4 END AS INTEGER) AS n, round(CASE kind WHEN 'circle' THEN 65 * x0 + 50 WHEN 'rect' THEN 3 * (x0 + 0.25) + 2 * (x1 + 0.75) ELSE 2 * (x0 - 300) + x1 + x0 + 10 END, 4) AS sum_x,
    round(CASE kind WHEN 'circle' THEN 65 * y0 WHEN 'rect' THEN 3 * (y0 + 0.5) + 2 * (y1 + 0.25) ELSE 2 * (y0 + 0.5) + 2 * y1 + 7.25 END, 4) AS sum_y FROM rois""")
def shape_rings(t: Tables) -> DataFrame:
    ring = geometry.shape_ring(F.col("kind"), F.col("points"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    total = lambda axis: F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[axis]), 4)
    return _shapes(t).withColumn("ring", ring).select("id", F.size("ring").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("SELECT id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, least(greatest(greatest(greatest(5 * (x1 - x0), 1) / (1024 * 0.8), greatest(9 * (y1 - y0), 1) / (768 * 0.8)), 1.0), 4.0) AS ds FROM (SELECT id, x0, x0 + (x1 - x0) AS x1, y0, y1 FROM rois) r")
def jump_viewports(t: Tables) -> DataFrame:
    """Viewports that regions fill, of boxes five times as wide and nine times as high around the same centre."""
    x, y, w, h = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, 5 * (F.col("x1") - F.col("x0")), 9 * (F.col("y1") - F.col("y0"))
    told = geometry.jump(x - w / 2, y - h / 2, x + w / 2, y + h / 2, F.lit(1024), F.lit(768), F.lit(4.0))
    return t("rois").select("id", told.alias("v")).select("id", F.round("v.cx", 6).alias("cx"), F.round("v.cy", 6).alias("cy"), F.round("v.ds", 9).alias("ds"))


_BARS = ", ".join(f"({float(c)}, {i})" for i, c in enumerate(geometry.SCALE_BARS))


@query(f"""SELECT id, ds, um FROM (SELECT s.id, d.ds, b.um, row_number() OVER (PARTITION BY s.id, d.ds ORDER BY abs(b.um / (s.mpp * d.ds) - 1000 / 5.0), b.i) AS place FROM slides s, (VALUES (1.0), (4.0), (7.5), (32.0)) d(ds), (VALUES {_BARS}) b(um, i) WHERE s.mpp IS NOT NULL) x WHERE place = 1
    UNION ALL SELECT s.id, d.ds, NULL FROM slides s, (VALUES (1.0), (4.0), (7.5), (32.0)) d(ds) WHERE s.mpp IS NULL""")
def scale_bars(t: Tables) -> DataFrame:
    own = t("slides").withColumn("ds", F.explode(F.array(*map(F.lit, (1.0, 4.0, 7.5, 32.0)))))
    return own.select("id", "ds", geometry.scale_bar(F.col("mpp"), F.col("ds"), F.lit(1000)).alias("um"))


_PYRAMID = (1.0, 3.9936, 15.9744, 63.8976)
_LEVEL = lambda target: f"CASE WHEN {target} < 1 THEN 0 WHEN {target} < 3.9936 THEN 0 WHEN {target} < 15.9744 THEN 1 WHEN {target} < 63.8976 THEN 2 ELSE 3 END"


@query(f"SELECT id, {_LEVEL('(x1 - x0) / 7')} AS level FROM rois")
def pyramid_level(t: Tables) -> DataFrame:
    return t("rois").select("id", geometry.best_level(F.array(*map(F.lit, _PYRAMID)), (F.col("x1") - F.col("x0")) / 7).alias("level"))


@query(f"""SELECT id, ds, {_LEVEL('ds')} AS level, CAST(ceil(w / d) AS BIGINT) AS read_w, CAST(ceil(h / d) AS BIGINT) AS read_h FROM (SELECT *, CASE {_LEVEL('ds')} WHEN 0 THEN 1.0 WHEN 1 THEN 3.9936 WHEN 2 THEN 15.9744 ELSE 63.8976 END AS d FROM
    (SELECT id, 40 * (x1 - x0) AS w, 3 * (y1 - y0) AS h, greatest(1.0, greatest(40 * (x1 - x0), 3 * (y1 - y0)) / 1024.0) AS ds FROM rois) x) y""")
def patch_plans(t: Tables) -> DataFrame:
    """Where the patch of a region is read: the target downsample, the level for it and the size there."""
    w, h = 40 * (F.col("x1") - F.col("x0")), 3 * (F.col("y1") - F.col("y0"))
    own = t("rois").select("id", w.alias("w"), h.alias("h"), F.greatest(F.lit(1.0), F.greatest(w, h) / 1024.0).alias("ds"))
    pyramid = F.array(*map(F.lit, _PYRAMID))
    level = geometry.best_level(pyramid, F.col("ds"))
    d = F.element_at(pyramid, F.col("level") + 1)
    return own.withColumn("level", level).select("id", "ds", "level", F.ceil(F.col("w") / d).cast("long").alias("read_w"), F.ceil(F.col("h") / d).cast("long").alias("read_h"))


_TILES = "SELECT s.id, s.width, s.height, CAST((s.id * 5 + k) % 20 - 1 AS INTEGER) AS level, CAST((s.id + k * 3) % 5 AS INTEGER) AS col, CAST(k % 4 - CASE WHEN k = 11 THEN 5 ELSE 0 END AS INTEGER) AS n_row FROM slides s, range(12) r(k)"
_BOXES = f"""SELECT *, CAST(col * 254 - CASE WHEN col > 0 THEN 1 ELSE 0 END AS BIGINT) AS x0, CAST(n_row * 254 - CASE WHEN n_row > 0 THEN 1 ELSE 0 END AS BIGINT) AS y0, CAST(least((col + 1) * 254, lw) + CASE WHEN col < cols - 1 THEN 1 ELSE 0 END AS BIGINT) AS x1,
    CAST(least((n_row + 1) * 254, lh) + CASE WHEN n_row < n_rows - 1 THEN 1 ELSE 0 END AS BIGINT) AS y1 FROM (SELECT *, ceil(lw / 254.0) AS cols, ceil(lh / 254.0) AS n_rows FROM (SELECT *, greatest(1, ceil(width / ds)) AS lw, greatest(1, ceil(height / ds)) AS lh FROM
    (SELECT *, CAST(2 ** (17 - level) AS DOUBLE) AS ds FROM ({_TILES}) a) b) c) d WHERE level BETWEEN 0 AND 17 AND col >= 0 AND col < cols AND n_row >= 0 AND n_row < n_rows"""


def _tiles(t: Tables) -> DataFrame:
    own = t("slides").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).selectExpr("id", "width", "height", "cast((id * 5 + k) % 20 - 1 AS int) AS level", "cast((id + k * 3) % 5 AS int) AS col", "cast(k % 4 - if(k = 11, 5, 0) AS int) AS n_row")
    box = geometry.tile_box(F.col("width"), F.col("height"), geometry.max_level(F.col("width"), F.col("height")), F.col("level"), F.col("col"), F.col("n_row"))
    return own.withColumn("box", box).where("box IS NOT NULL")


@query(f"SELECT id, level, col, n_row, x0, y0, x1, y1, x1 - x0 AS out_w, y1 - y0 AS out_h, ds FROM ({_BOXES}) t")
def tile_boxes(t: Tables) -> DataFrame:
    """Boxes of tiles of a virtual pyramid; tiles out of range are none."""
    return _tiles(t).select("id", "level", "col", "n_row", "box.*")


@query(f"""SELECT id, level, col, n_row, CAST(CASE WHEN coarse THEN -1 ELSE src END AS INTEGER) AS src_level, CASE WHEN coarse THEN 64.0 ELSE d END AS src_ds, CAST(round_even(x0 * ds / CASE WHEN coarse THEN 64.0 ELSE d END, 0) AS BIGINT) AS rx0, CAST(round_even(x1 * ds / CASE WHEN coarse THEN 64.0 ELSE d END, 0) AS BIGINT) AS rx1, NOT coarse AND pixels > 3000000 AS refused
    FROM (SELECT *, pixels > 100000 AND ds >= 64 AS coarse FROM (SELECT *, greatest(1, round_even(x1 * ds / d, 0) - round_even(x0 * ds / d, 0)) * greatest(1, round_even(y1 * ds / d, 0) - round_even(y0 * ds / d, 0)) AS pixels FROM
    (SELECT *, CASE src WHEN 0 THEN 1.0 WHEN 1 THEN 3.9936 WHEN 2 THEN 15.9744 ELSE 63.8976 END AS d FROM (SELECT *, {_LEVEL('ds')} AS src FROM ({_BOXES}) t) u) v) w) x""")
def tile_reads(t: Tables) -> DataFrame:
    """Where tiles are read in a real pyramid with fractional downsamples."""
    plan = geometry.tile_read(F.col("box"), F.array(*map(F.lit, _PYRAMID)), 100_000, 64.0, 3_000_000)
    told = _tiles(t).select("id", "level", "col", "n_row", plan.alias("p"))
    return told.select("id", "level", "col", "n_row", F.col("p.level").alias("src_level"), F.col("p.ds").alias("src_ds"), F.col("p.x0").alias("rx0"), F.col("p.x1").alias("rx1"), F.col("p.refused").alias("refused"))


@query("SELECT id, round(cx / 50000 - width * ds / 50000 / 2, 9) AS x, round(cy / 50000 - height * ds / 50000 / 2, 9) AS y, round(width * ds / 50000, 9) AS w, round(height * ds / 50000, 9) AS h, round(cx, 5) AS cx, round(cy, 5) AS cy, round(ds, 7) AS ds FROM viewports")
def viewport_bounds(t: Tables) -> DataFrame:
    """Viewports as rectangles in units of the slide's width, and back."""
    width = F.lit(50000.0)
    there = t("viewports").withColumn("b", geometry.bounds_of_viewport(*(F.col(c) for c in ("cx", "cy", "ds", "width", "height")), width))
    back = there.withColumn("v", geometry.viewport_of_bounds(*(F.col(f"b.{c}") for c in "xywh"), F.col("width"), F.col("height"), width))
    return back.select("id", *(F.round(f"b.{c}", 9).alias(c) for c in "xywh"), F.round("v.cx", 5).alias("cx"), F.round("v.cy", 5).alias("cy"), F.round("v.ds", 7).alias("ds"))


@query("SELECT id, round((100 - cx) / ds + width / 2.0, 6) AS vx, round((200 - cy) / ds + height / 2.0, 6) AS vy, 100.0 AS x, 200.0 AS y, (100 - cx) / ds + width / 2.0 >= width OR (100 - cx) / ds + width / 2.0 + 5 < 0 OR (200 - cy) / ds + height / 2.0 >= height OR (200 - cy) / ds + height / 2.0 + 5 < 0 AS hidden FROM viewports")
def viewport_points(t: Tables) -> DataFrame:
    """A point in every viewport's pixels and back, and whether a box of five pixels there is off the screen."""
    view = [F.col(c) for c in ("cx", "cy", "ds", "width", "height")]
    own = t("viewports").withColumn("p", geometry.to_view(F.lit(100), F.lit(200), *view)).withColumn("s", geometry.to_slide(F.col("p.x"), F.col("p.y"), *view))
    hidden = geometry.outside(F.col("p.x"), F.col("p.y"), F.col("p.x") + 5, F.col("p.y") + 5, F.col("width"), F.col("height"))
    return own.select("id", F.round("p.x", 6).alias("vx"), F.round("p.y", 6).alias("vy"), F.round("s.x", 6).alias("x"), F.round("s.y", 6).alias("y"), hidden.alias("hidden"))


_SELECTION = """CASE id % 7 WHEN 0 THEN concat('{"kind": "rect", "points_level0": [[', cx, ', ', cy, '], [', cx - 20, ', ', cy + 30, ']]}') WHEN 1 THEN concat('{"kind": "polygon", "points_level0": [[', cx, ', ', cy, '], [', cx + 9, ', ', cy, '], [', cx, ', ', cy + 5, ']]}')
    WHEN 2 THEN concat('{"kind": "rect", "points_level0": [[', cx, ', ', cy, ']]}') WHEN 3 THEN concat('{"kind": "polygon", "points_level0": [[', cx, ', ', cy, '], [1, 2]]}') WHEN 4 THEN concat('{"kind": "measure", "points_level0": [[', cx, ', ', cy, '], [', cx + 3, ', ', cy - 4, ']]}')
    WHEN 5 THEN '{"kind": "rect", "points_level0": [[NaN, 1], [2, 3]]}' ELSE '{not json' END"""


@query("""SELECT id, CASE id % 7 WHEN 0 THEN 'rect' WHEN 1 THEN 'polygon' END AS kind, CASE id % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS n, CASE id % 7 WHEN 0 THEN cx - 20 WHEN 1 THEN cx END AS first_x, CASE id % 7 WHEN 0 THEN CAST(greatest(0, ceil(cx)) AS BIGINT) WHEN 1 THEN CAST(ceil(cx + 9) AS BIGINT) END AS box_x1,
    CASE WHEN id % 7 = 4 THEN sqrt(25.0) END AS measured, CAST(id % 3 AS BIGINT) AS clicked FROM viewports""")
def parsed_selections(t: Tables) -> DataFrame:
    """Reported selections: what isn't a usable region is none, a measurement is only measured."""
    own = t("viewports").withColumn("text", F.expr(_SELECTION)).select("*", selections.selection(F.col("text")).alias("s"), selections.measured(F.col("text")).alias("m"))
    corner = lambda i, axis: F.try_element_at("m", F.lit(i))[axis]
    told = F.hypot(corner(2, "x") - corner(1, "x"), corner(2, "y") - corner(1, "y"))
    box = geometry.bbox(F.col("s.kind"), F.col("s.points"))
    clicked = selections.clicked(F.concat(F.col("id") % 3, F.lit("#"), F.col("id")))
    return own.select("id", "s.kind", F.when(F.col("s").isNotNull(), F.size("s.points")).alias("n"), F.try_element_at("s.points", F.lit(1))["x"].alias("first_x"), box["x1"].alias("box_x1"), told.alias("measured"), clicked.alias("clicked"))


_DRAWN = """CASE id % 5 WHEN 0 THEN '{"range": {"x": [300, 100], "y": [50, 250]}}' WHEN 1 THEN '{"lasso": {"x": [10, 20, 30, 40], "y": [5, 5, 25]}}' WHEN 2 THEN '{"lasso": {"x": [10, 20], "y": [5, 5]}}' WHEN 3 THEN '{"range": {"x": [1], "y": [2, 3]}}' ELSE NULL END"""


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'rect' WHEN 1 THEN 'polygon' END AS kind, round(CASE id % 5 WHEN 0 THEN cx + (100 - width / 2.0) * ds WHEN 1 THEN cx + (10 - width / 2.0) * ds END, 6) AS first_x, round(CASE id % 5 WHEN 0 THEN cx + (200 - width / 2.0) * ds WHEN 1 THEN NULL END, 6) AS circle_x,
    round(CASE id % 5 WHEN 0 THEN 100 * ds END, 6) AS radius, CASE WHEN id % 5 = 0 THEN 2 WHEN id % 5 = 1 THEN 3 END AS n FROM viewports""")
def drawn_regions(t: Tables) -> DataFrame:
    """Boxes and lassos drawn on a figure as regions at level 0, boxes also as circles."""
    view = [F.col(c) for c in ("cx", "cy", "ds", "width", "height")]
    own = t("viewports").withColumn("s", selections.drawn(F.expr(_DRAWN)))
    own = own.withColumn("points", F.transform("s.points", lambda p: geometry.to_slide(p["x"], p["y"], *view)))
    own = own.withColumn("r", selections.as_region(F.col("s.kind"), F.col("points"))).withColumn("c", F.when(F.col("s.kind") == "box", selections.as_region(F.col("s.kind"), F.col("points"), as_circle=True)))
    at = lambda c, i: F.try_element_at(f"{c}.points", F.lit(i))["x"]
    return own.select("id", "r.kind", F.round(at("r", 1), 6).alias("first_x"), F.round(at("c", 1), 6).alias("circle_x"), F.round(at("c", 2) - at("c", 1), 6).alias("radius"), F.when(F.col("r").isNotNull(), F.size("r.points")).alias("n"))


@query("""SELECT r.id, r.kind, s.name AS slide, CAST(s.width AS BIGINT) AS width, s.mpp, CAST(7 AS BIGINT) AS n_keys FROM rois r JOIN slides s ON r.slide_id = s.id""")
def selection_contracts(t: Tables) -> DataFrame:
    """The seven fields of a selection, written as JSON and read back; the resolution's field is there also where it is unknown."""
    own = _shapes(t).join(t("slides").select(F.col("id").alias("slide_id"), F.col("name").alias("slide"), "width", "height", "mpp"), "slide_id")
    text = selections.contract(F.col("kind"), F.col("points"), F.lit(4.0), F.col("slide"), F.col("width"), F.col("height"), F.col("mpp"))
    told = own.select("id", text.alias("text")).withColumn("d", F.from_json("text", "kind STRING, slide STRING, slide_dimensions ARRAY<BIGINT>, mpp DOUBLE"))
    return told.select("id", "d.kind", "d.slide", F.element_at("d.slide_dimensions", 1).alias("width"), "d.mpp", F.size(F.json_object_keys("text")).cast("long").alias("n_keys"))


@query("SELECT id, greatest(1.0, greatest(width, height) / (256 * 48.0)) AS sweep_ds, (mpp + (mpp + 0.5)) / 2 AS mean_mpp, greatest(1.0, ceil(width / 4096.0) * 4096.0 / width) AS cover_x, CAST(floor(3 * 256 * 2.5) AS BIGINT) AS cell_x0, CAST(floor(4 * 256 * 2.5) AS BIGINT) AS cell_x1 FROM slides")
def sweep_geometry(t: Tables) -> DataFrame:
    """The downsample of a sweep over a slide, the mean of two resolutions, how much of the slide a grid covers, and a cell's box."""
    w, h = F.col("width"), F.col("height")
    cols, _ = geometry.grid_shape(w, h, 256, 16)
    cell = lambda g: F.floor(F.lit(g) * 256 * 2.5).cast("long")
    return t("slides").select("id", F.greatest(F.lit(1.0), F.greatest(w, h) / (256 * 48.0)).alias("sweep_ds"), geometry.mean_mpp(F.col("mpp"), F.col("mpp") + 0.5).alias("mean_mpp"), F.greatest(F.lit(1.0), cols * 4096.0 / w).alias("cover_x"), cell(3).alias("cell_x0"), cell(4).alias("cell_x1"))
