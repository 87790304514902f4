"""Regions, viewports, grids and pyramids as column expressions; all geometry is in level-0 pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(kind: Column, points: Column) -> Column:
    """struct(x0, y0, x1, y1) of a region with points array<struct<x,y>>: rectangles and polygons by their corners, circles by centre and rim.

    Rounded outward and clipped at 0; NULL without points, and for a circle without a rim point.
    """
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    cx, cy = F.try_element_at(xs, F.lit(1)), F.try_element_at(ys, F.lit(1))
    radius = F.hypot(F.try_element_at(xs, F.lit(2)) - cx, F.try_element_at(ys, F.lit(2)) - cy)
    circle = kind == "circle"
    low = lambda c, v: F.greatest(F.lit(0), F.floor(F.when(circle, c - radius).otherwise(F.array_min(v)))).cast("long")
    high = lambda c, v: F.greatest(F.lit(0), F.ceil(F.when(circle, c + radius).otherwise(F.array_max(v)))).cast("long")
    return F.when(F.size(points) > 0, F.struct(low(cx, xs).alias("x0"), low(cy, ys).alias("y0"), high(cx, xs).alias("x1"), high(cy, ys).alias("y1")))


def intersects(x0: str, y0: str, x1: str, y1: str, view: tuple[float, float, float, float]) -> Column:
    """Inclusive overlap with a viewport; four plain comparisons, so that they reach the scan."""
    a, b, c, d = view
    return (F.col(x0) <= c) & (F.col(x1) >= a) & (F.col(y0) <= d) & (F.col(y1) >= b)


def patch_mpp(mpp: Column, w: Column, h: Column, patch_w: Column, patch_h: Column) -> Column:
    return mpp * F.greatest(w / patch_w, h / patch_h)


def magnification(mpp: Column, downsample: Column) -> Column:
    """2 um a pixel at downsample 1 is 10x; NULL without a positive resolution."""
    return F.when((mpp > 0) & (downsample > 0), F.lit(20.0) / (mpp * downsample))


def physical(pixels: Column, mpp: Column) -> Column:
    """Micrometres; unknown resolutions give NULL, negative lengths count as 0."""
    return F.when(mpp != 0, F.greatest(F.lit(0), pixels) * mpp)


def area_mm2(width_um: Column, height_um: Column) -> Column:
    """NULL where either side is 0 or unknown."""
    return F.when((width_um != 0) & (height_um != 0), width_um * height_um / 1e6)


def grid_shape(width: Column, height: Column, tile: int, downsample: float) -> tuple[Column, Column]:
    cell = tile * downsample
    return F.greatest(F.lit(1), F.ceil(width / cell)).cast("long"), F.greatest(F.lit(1), F.ceil(height / cell)).cast("long")


def max_level(width: Column, height: Column) -> Column:
    """The least n with 2**n at least the longer side, by the number's bits: exact at powers of two."""
    return F.length(F.bin(F.greatest(width, height) - 1)).cast("int") - F.when(F.greatest(width, height) == 1, 1).otherwise(0)


def ring(cx: Column, cy: Column, radius: Column, corners: int = 64) -> Column:
    """A closed polygon for a circle."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct((cx + radius * F.cos(i * (2 * 3.141592653589793 / corners))).alias("x"), (cy + radius * F.sin(i * (2 * 3.141592653589793 / corners))).alias("y")))
    return F.concat(turn, F.slice(turn, 1, 1))


def geometry_key(kind: Column, points: Column) -> Column:
    """sha256 of compact JSON of the kind and the points rounded half to even."""
    told = F.transform(points, lambda p: F.concat(F.lit("["), F.bround(p["x"]).cast("long").cast("string"), F.lit(","), F.bround(p["y"]).cast("long").cast("string"), F.lit("]")))
    return F.sha2(F.concat(F.lit('["'), kind, F.lit('",['), F.array_join(told, ","), F.lit("]]")), 256)


def best_level(downsamples: Column, target: Column) -> Column:
    """The last level, of an ascending array of downsamples, before the first one above the target; 0 if there is none."""
    fits = F.filter(F.sequence(F.lit(0), F.size(downsamples) - 1), lambda i: F.forall(F.slice(downsamples, F.lit(1), i + 1), lambda d: d <= target))
    return F.coalesce(F.array_max(fits), F.lit(0))


# Lengths of scale bars in micrometres.
SCALE_BARS = (10, 20, 50, 100, 200, 500, 1000, 2000, 5000)


def scale_bar(mpp: Column, downsample: Column, width: Column, lengths: tuple[int, ...] = SCALE_BARS) -> Column:
    """The length whose bar comes closest to a fifth of an image's width; of equally close ones the first."""
    off = lambda c: F.abs(c / (mpp * downsample) - width / 5.0)
    told = F.array(*[F.struct(off(F.lit(float(c))).alias("off"), F.lit(i).alias("i"), F.lit(float(c)).alias("um")) for i, c in enumerate(lengths)])
    return F.when((mpp > 0) & (downsample > 0), F.array_min(told)["um"])


def jump(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, most: Column, fill: float = 0.8) -> Column:
    """struct(cx, cy, ds) of a viewport of a size in pixels that a box fills so far; ds from 1 to the most."""
    w, h = F.greatest(x1 - x0, F.lit(1.0)), F.greatest(y1 - y0, F.lit(1.0))
    ds = F.greatest(w / (width * fill), h / (height * fill))
    return F.struct(((x0 + x1) / 2.0).alias("cx"), ((y0 + y1) / 2.0).alias("cy"), F.least(F.greatest(ds, F.lit(1.0)), F.greatest(most, F.lit(1.0))).alias("ds"))


def viewport_of_bounds(x: Column, y: Column, w: Column, h: Column, box_w: Column, box_h: Column, slide_width: Column) -> Column:
    """struct(cx, cy, ds, width, height) from a rectangle in units of the slide's width, which both axes use; NULL unless its width is positive and all is finite."""
    cw, ch = F.greatest(F.lit(1), F.bround(box_w).cast("int")), F.greatest(F.lit(1), F.bround(box_h).cast("int"))
    cx, cy, ds = (x + w / 2.0) * slide_width, (y + h / 2.0) * slide_width, w * slide_width / cw
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite(cx) & finite(cy) & finite(ds) & (w > 0) & (ds > 0), F.struct(cx.alias("cx"), cy.alias("cy"), ds.alias("ds"), cw.alias("width"), ch.alias("height")))


def bounds_of_viewport(cx: Column, cy: Column, ds: Column, width: Column, height: Column, slide_width: Column) -> Column:
    """struct(x, y, w, h): the inverse of ``viewport_of_bounds``."""
    w, h = width * ds / slide_width, height * ds / slide_width
    return F.struct((cx / slide_width - w / 2.0).alias("x"), (cy / slide_width - h / 2.0).alias("y"), w.alias("w"), h.alias("h"))


def to_view(x: Column, y: Column, cx: Column, cy: Column, ds: Column, width: Column, height: Column) -> Column:
    """struct(x, y): a level-0 point in a viewport's pixels."""
    return F.struct(((x - cx) / ds + width / 2.0).alias("x"), ((y - cy) / ds + height / 2.0).alias("y"))


def to_slide(x: Column, y: Column, cx: Column, cy: Column, ds: Column, width: Column, height: Column) -> Column:
    """struct(x, y): a point in a viewport's pixels at level 0."""
    return F.struct(((x - width / 2.0) * ds + cx).alias("x"), ((y - height / 2.0) * ds + cy).alias("y"))


def outside(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Whether a box in an image's pixels shows none of itself; touching the right or lower edge is outside."""
    return (x1 < 0) | (y1 < 0) | (x0 >= width) | (y0 >= height)


def mean_mpp(x: Column, y: Column) -> Column:
    """The mean of the resolutions along both axes where both are given."""
    return (x + y) / 2.0


def tile_box(width: Column, height: Column, top: Column, level: Column, col: Column, row: Column, tile: int = 254, overlap: int = 1) -> Column:
    """struct(x0, y0, x1, y1, out_w, out_h, ds) of a virtual pyramid's tile in its level's pixels, overlap only where it has a neighbour; NULL out of range."""
    ds = F.pow(F.lit(2.0), top - level)
    lw, lh = F.greatest(F.lit(1), F.ceil(width / ds)), F.greatest(F.lit(1), F.ceil(height / ds))
    cols, rows = F.ceil(lw / tile), F.ceil(lh / tile)
    low = lambda i: i * tile - F.when(i > 0, overlap).otherwise(0)
    high = lambda i, n, size: F.least((i + 1) * tile, size) + F.when(i < n - 1, overlap).otherwise(0)
    x0, y0, x1, y1 = low(col), low(row), high(col, cols, lw), high(row, rows, lh)
    fits = (level >= 0) & (level <= top) & (col >= 0) & (col < cols) & (row >= 0) & (row < rows)
    whole = lambda c, name: c.cast("long").alias(name)
    return F.when(fits, F.struct(whole(x0, "x0"), whole(y0, "y0"), whole(x1, "x1"), whole(y1, "y1"), whole(x1 - x0, "out_w"), whole(y1 - y0, "out_h"), ds.alias("ds")))


def tile_read(box: Column, downsamples: Column, most_pixels: int, overview: float | None, cap: int) -> Column:
    """struct(level, ds, x0, y0, x1, y1, refused): where a tile is read in the real pyramid, each edge rounded by itself, so that neighbours abut.

    The level is the one that needs no enlarging; -1 is the overview, taken where the read would be over most_pixels and
    the tile is coarse enough for it. refused: whether the read is over the cap.
    """
    level = best_level(downsamples, box["ds"])
    own = F.element_at(downsamples, level + 1)
    edge = lambda c, d: F.bround(box[c] * box["ds"] / d).cast("long")
    pixels = lambda d: F.greatest(F.lit(1), edge("x1", d) - edge("x0", d)) * F.greatest(F.lit(1), edge("y1", d) - edge("y0", d))
    coarse = (pixels(own) > most_pixels) & (box["ds"] >= overview) if overview else F.lit(False)
    d = F.when(coarse, F.lit(overview)).otherwise(own) if overview else own
    return F.when(box.isNotNull(), F.struct(F.when(coarse, -1).otherwise(level).alias("level"), d.alias("ds"), *(edge(c, d).alias(c) for c in ("x0", "y0", "x1", "y1")), (~coarse & (pixels(own) > cap)).alias("refused")))


def closed(points: Column) -> Column:
    """A ring with its first point repeated at the end, unless it is there already."""
    return F.when((F.size(points) > 0) & (F.element_at(points, 1) != F.element_at(points, -1)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def outline(points: Column) -> Column:
    """A ring without a repeated closing point; NULL unless it has three different points."""
    open_ring = F.when((F.size(points) >= 2) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
    return F.when(F.size(F.array_distinct(open_ring)) >= 3, open_ring)


def shape_ring(kind: Column, points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The closed ring array<struct<x,y>> of a region's shape: a rectangle's corners, a circle's 64 points, a polygon's own; of the box where the points don't make the shape."""
    def corners(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.array(*[F.struct(px.cast("double").alias("x"), py.cast("double").alias("y")) for px, py in ((a, b), (c, b), (c, d), (a, d), (a, b))])

    at = lambda i, axis: F.try_element_at(points, F.lit(i))[axis]
    radius = F.hypot(at(2, "x") - at(1, "x"), at(2, "y") - at(1, "y"))
    rect = corners(F.least(at(1, "x"), at(2, "x")), F.least(at(1, "y"), at(2, "y")), F.greatest(at(1, "x"), at(2, "x")), F.greatest(at(1, "y"), at(2, "y")))
    n = F.size(points)
    return F.when((kind == "circle") & (n == 2) & (radius > 0), ring(at(1, "x"), at(1, "y"), radius)).when((kind == "rect") & (n == 2), rect).when((kind == "polygon") & (n >= 3), closed(points)).otherwise(corners(x0, y0, x1, y1))
