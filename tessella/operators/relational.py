"""Queries on the store as frames: summaries, viewports, pages, histories, catalogues, duplicates, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import geometry, jsonx


def stats_rows(rois: DataFrame, slides: DataFrame) -> DataFrame:
    """A flat row for each region: size in micrometres from its box and its slide's resolution, and its parsed statistics."""
    s = jsonx.stats(F.col("stats_json"))
    flat = rois.join(slides.select(F.col("id").alias("slide_id"), "mpp"), "slide_id", "left").withColumn("s", s)
    w, h = geometry.physical(F.col("x1") - F.col("x0"), F.col("mpp")), geometry.physical(F.col("y1") - F.col("y0"), F.col("mpp"))
    rgb = [jsonx.finite(F.try_element_at("s.mean_rgb", F.lit(i))).alias(n) for i, n in ((1, "mean_r"), (2, "mean_g"), (3, "mean_b"))]
    return flat.select("id", "slide_id", "label", w.alias("width_um"), h.alias("height_um"), geometry.area_mm2(w, h).alias("area_mm2"), *rgb, jsonx.finite(F.col("s.he_deconvolution.hematoxylin_mean")).alias("hema"), jsonx.finite(F.col("s.he_deconvolution.eosin_mean")).alias("eosin"), jsonx.finite(F.col("s.tissue_fraction")).alias("tissue"), jsonx.has_keys(F.col("stats_json")).alias("has_stats"))


def label_summary(rows: DataFrame, columns: Sequence[str], key: str = "label") -> DataFrame:
    """Per label: rows, and mean and population deviation of each column, the latter NULL under two values. NULL is the empty label."""
    told = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.count(c) >= 2, F.stddev_pop(c)).alias(f"{c}_sd"))]
    return rows.groupBy(F.coalesce(key, F.lit("")).alias(key)).agg(F.count("*").alias("n"), *told)


def in_viewport(rois: DataFrame, slide_id: int, view: tuple[float, float, float, float], limit: int = 2000) -> DataFrame:
    return rois.where((F.col("slide_id") == slide_id) & (F.col("has_bbox") == 1) & geometry.intersects("x0", "y0", "x1", "y1", view)).orderBy("id").limit(limit)


def page(rows: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def recent(rows: DataFrame, limit: int = 50, kind: str | None = None) -> DataFrame:
    return (rows.where(F.col("kind") == kind) if kind else rows).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def where_given(rows: DataFrame, **equal: object) -> DataFrame:
    """Equality on the columns that have a value; None and '' don't filter."""
    for column, value in equal.items():
        if value not in (None, ""):
            rows = rows.where(F.col(column) == value)
    return rows


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last by the order's columns: the greatest struct, so that each task sends one row a key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in (*order, *rest))).select(*rows.columns)


def duplicates(rows: DataFrame, keys: Sequence[str], member: str = "id") -> DataFrame:
    """Keys with several members: how many and the smallest, which is the keeper. A key with a NULL in it is no key."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("keeper")).where("n > 1")


def remap_to_keeper(rows: DataFrame, keys: Sequence[str], member: str = "id") -> DataFrame:
    """Each row with the keeper of its key, itself where it has no key or shares it with none.

    Keepers come from an aggregate, so that a large group isn't gathered in one task; only keys with several members are
    joined back, which Spark broadcasts as long as they are few.
    """
    keepers = duplicates(rows, keys, member).select(*keys, "keeper")
    return rows.join(keepers, list(keys), "left").withColumn("keeper", F.coalesce("keeper", member))


def overlaps(a: DataFrame, b: DataFrame, cell: float, keys: Sequence[str] = ("slide_id",)) -> DataFrame:
    """Pairs (a_id, b_id) of boxes that overlap: both sides go to the grid cells they touch and meet there by equality; a pair counts in the cell of its intersection's corner."""

    def binned(df: DataFrame, name: str) -> DataFrame:
        cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int"))
        own = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        out = own.withColumn("gx", F.explode(cells(f"{name}_x0", f"{name}_x1")))
        return out.withColumn("gy", F.explode(cells(f"{name}_y0", f"{name}_y1")))

    met = binned(a, "a").join(binned(b, "b"), [*keys, "gx", "gy"])
    box = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    here = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("gx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("gy"))
    return met.where(box & here)


def dangling(children: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows that refer to a parent that isn't there."""
    return children.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def viewport_changed(rows: DataFrame, session: str, order: Sequence[str], center_px: float = 0.5, zoom: float = 0.01) -> DataFrame:
    """Each viewport (cx, cy, ds, width, height) with ``changed``: against the one before in the session its size differs, its centre moved by center_px at the new downsample, or its zoom by a share.

    The first of a session always counts; a downsample that isn't positive (the new one) or is 0 (the old one) stands for 1.
    """
    old = F.lag(F.struct("cx", "cy", "ds", "width", "height")).over(Window.partitionBy(session).orderBy(*order))
    ds = F.when(F.col("ds") > 0, F.col("ds")).otherwise(1.0)
    old_ds = F.when(F.col("_old.ds") != 0, F.col("_old.ds")).otherwise(1.0)
    resized = (F.col("width") != F.col("_old.width")) | (F.col("height") != F.col("_old.height"))
    moved = F.hypot(F.col("cx") - F.col("_old.cx"), F.col("cy") - F.col("_old.cy")) / ds >= center_px
    changed = F.when(F.col("_old").isNull(), True).otherwise(resized | moved | (F.abs(ds / old_ds - 1.0) >= zoom))
    return rows.withColumn("_old", old).withColumn("changed", changed).drop("_old")
