"""Images as rows of pixels (keys, px, py, r, g, b): colours, masks, statistics, textures, stains and heatmaps.

Everything is a column expression, an aggregate or a window along a row or column of an image, so that images of any
number and size go through the same plan; only the union of a mask's pixels runs on arrays, an image at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Colour vectors of haematoxylin, eosin and DAB (Ruifrok and Johnston 2001), those of the two-stain methods,
# weights of luminance, and the statistics that Reinhard's method aims at.
HED = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
STAINS = ((0.650, 0.704, 0.286), (0.072, 0.990, 0.105))
LUMA = (0.2126, 0.7152, 0.0722)
REINHARD = ((62.0, 14.0, 12.0), (8.0, 5.0, 5.0))
WHITE = (0.95047, 1.0, 1.08883)

TISSUE = 0.9 * 255.0
BLURRY = 100.0
LEAST_TISSUE = 10
RGB = ("r", "g", "b")


def luminance() -> Column:
    return sum((w * F.col(c) for w, c in zip(LUMA, RGB, strict=True)), F.lit(0.0))


def is_tissue() -> Column:
    return luminance() < TISSUE


def gray() -> Column:
    """The grey value of eight bits, by weights in 65536ths."""
    return F.floor((F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768) / 65536).cast("long")


def hed() -> tuple[Column, Column, Column]:
    """How much of the three stains a pixel holds, none below 0."""
    back = np.linalg.inv(np.array(HED))
    logs = [F.log(F.greatest(F.col(c) / 255.0, F.lit(1e-6))) / float(np.log(1e-6)) for c in RGB]
    return tuple(F.greatest(sum((log * float(back[i, j]) for i, log in enumerate(logs)), F.lit(0.0)), F.lit(0.0)) for j in range(3))


def optical_density(c: str) -> Column:
    return -F.log((F.col(c) + 1) / 256.0)


def in_circle(cx: Column, cy: Column, radius: Column, ox: Column, oy: Column, sx: Column, sy: Column) -> Column:
    """Whether a pixel, whose place at level 0 follows from an offset and scales, lies in a circle."""
    x, y = ox + F.col("px") * sx, oy + F.col("py") * sy
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def in_ring(points: Sequence[tuple[float, float]]) -> Column:
    """Whether a pixel's place is within a polygon, by the number of edges to its right."""
    crossed = F.lit(0)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True):
        if y0 != y1:
            between = (F.lit(min(y0, y1)) <= F.col("py")) & (F.col("py") < max(y0, y1))
            crossed = crossed + (between & (F.col("px") < x0 + (F.col("py") - y0) * (x1 - x0) / (y1 - y0))).cast("int")
    return crossed % 2 == 1


def region_stats(pixels: DataFrame, keys: Sequence[str], inside: Column) -> DataFrame:
    """Per image: mean colours and stains over the tissue in a shape, over the shape where it holds none, over all where the shape is empty; and the share of tissue."""
    h, e, _ = hed()
    marked = pixels.withColumns({"_in": inside, "_t": is_tissue(), "_h": h, "_e": e})
    shape, tissue = F.count_if("_in"), F.count_if(F.col("_in") & F.col("_t"))

    def mean(c: str) -> Column:
        return F.when(shape == 0, F.when(F.count_if("_t") > 0, F.avg(F.when(F.col("_t"), F.col(c)))).otherwise(F.avg(c))).when(tissue > 0, F.avg(F.when(F.col("_in") & F.col("_t"), F.col(c)))).otherwise(F.avg(F.when(F.col("_in"), F.col(c))))

    share = F.when(shape == 0, F.avg(F.col("_t").cast("double"))).otherwise(tissue / shape)
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), *(mean(c).alias(f"mean_{c}") for c in RGB), mean("_h").alias("hematoxylin"), mean("_e").alias("eosin"), share.alias("tissue"))


def _beside(pixels: DataFrame, keys: Sequence[str], value: str) -> tuple[Column, Column, Column, Column]:
    """The values left, right, above and below, a pixel's own at an edge."""
    row, column = Window.partitionBy(*keys, "py").orderBy("px"), Window.partitionBy(*keys, "px").orderBy("py")
    own = F.col(value)
    return tuple(F.coalesce(f(value).over(w), own) for w in (row, column) for f in (F.lag, F.lead))


def blur(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, blur, blurry, brightness): the variance of the grey values' Laplacian, edges mirrored."""
    held = pixels.withColumn("_g", gray().cast("double"))
    curved = held.withColumn("_l", sum(_beside(held, keys, "_g"), F.lit(0.0)) - 4 * F.col("_g"))
    score = F.var_pop("_l")
    return curved.groupBy(*keys).agg(score.alias("blur"), (score < BLURRY).alias("blurry"), (F.sum(F.col("r") + F.col("g") + F.col("b")) / (3 * F.count("*"))).alias("brightness"))


def histogram(pixels: DataFrame, keys: Sequence[str], channel: str, bins: int = 8) -> DataFrame:
    """(keys, bin, share) of every bin of a channel, empty ones too: one aggregate with a count for each bin."""
    counted = pixels.groupBy(*keys).agg(F.count("*").alias("_n"), F.array(*[F.count_if(F.floor(F.col(channel) * bins / 256) == i) for i in range(bins)]).alias("_c"))
    return counted.select(*keys, "_n", F.posexplode("_c").alias("bin", "_k")).select(*keys, "bin", (F.col("_k") / F.col("_n")).alias("share"))


def stain_stats(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, and of each stain mean, deviation and percentiles)."""
    values = dict(zip(("h", "e", "d"), hed(), strict=True))
    held = pixels.select(*keys, *(v.alias(n) for n, v in values.items()))
    told = [x for n in values for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"), *(F.percentile(n, p / 100).alias(f"{n}_p{p}") for p in (10, 50, 90)))]
    return held.groupBy(*keys).agg(*told)


def cooccurrence(pixels: DataFrame, keys: Sequence[str], distance: int, down: bool, levels: int = 16) -> DataFrame:
    """(keys, i, j, p): how often grey levels are so far apart along rows or columns, either way round, as shares; neighbours meet by their places."""
    level = F.least(F.floor(gray() * levels / 256), F.lit(levels - 1)).cast("int")
    own = pixels.select(*keys, "px", "py", level.alias("i"))
    other = pixels.select(*keys, (F.col("px") - (0 if down else distance)).alias("px"), (F.col("py") - (distance if down else 0)).alias("py"), level.alias("j"))
    met = own.join(other, [*keys, "px", "py"]).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    both = met.unionByName(met.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return both.select(*keys, "i", "j", (F.col("n") / total).alias("p"))


def texture(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, contrast, homogeneity, correlation) of a table of co-occurrence; a flat image correlates with itself."""
    d, p = F.col("i") - F.col("j"), F.col("p")
    moments = pairs.groupBy(*keys).agg(F.sum(p * d * d).alias("contrast"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * F.col("i")).alias("_m"), F.sum(p * F.col("i") * F.col("i")).alias("_q"), F.sum(p * F.col("i") * F.col("j")).alias("_c"))
    spread = F.col("_q") - F.col("_m") * F.col("_m")
    return moments.select(*keys, "contrast", "homogeneity", F.when(spread < 1e-15, 1.0).otherwise((F.col("_c") - F.col("_m") * F.col("_m")) / spread).alias("correlation"))


def otsu(pixels: DataFrame, keys: Sequence[str], value: Column, bins: int = 256) -> DataFrame:
    """(keys, threshold): the middle of the bin that parts the values best; NULL for an image of one value."""
    held = pixels.select(*keys, value.alias("_v"))
    ends = held.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    placed = _with(held, ends, keys).where("_b > _a").withColumn("_i", F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(*keys, "_a", "_b", "_i").agg(F.count("*").alias("_n"))
    middle = F.col("_a") + (F.col("_i") + 0.5) * (F.col("_b") - F.col("_a")) / bins
    counts = counts.withColumn("_m", middle)
    below = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy(*keys).orderBy("_i").rowsBetween(1, Window.unboundedFollowing)
    weighted = F.col("_n") * F.col("_m")
    n1, n2 = F.sum("_n").over(below), F.sum("_n").over(above)
    apart = F.sum(weighted).over(below) / n1 - F.sum(weighted).over(above) / n2
    told = counts.withColumn("_s", n1 * n2 * apart * apart).where("_s IS NOT NULL")
    best = told.groupBy(*keys).agg(F.max_by("_m", F.struct("_s", (-F.col("_i")).alias("i"))).alias("threshold"))
    return _with(ends.select(*keys), best, keys, "left")


def _with(rows: DataFrame, per_image: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the values of their image: one row an image, which Spark broadcasts as long as they are few."""
    if keys:
        return rows.join(per_image, list(keys), how)
    return rows.join(F.broadcast(per_image), how=how, on=F.lit(True))  # one row


def _blobs(keys: Sequence[str], least: int):
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, on = pdf["px"].to_numpy(), pdf["py"].to_numpy(), pdf["on"].to_numpy()
        x, y = x[on], y[on]
        out = {k: pdf[k].iloc[0] for k in keys}
        if not len(x):
            return pd.DataFrame({**{k: [] for k in keys}, "blob": [], "area": []}).astype({"blob": "int64", "area": "int64"})
        width = int(x.max()) + 2
        at = y.astype(np.int64) * width + x
        order = np.argsort(at)
        at = at[order]
        root = np.arange(len(at))
        pairs = []
        for step in (1, width):
            place = np.searchsorted(at, at + step)
            met = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == at + step)
            pairs.append(np.stack([np.flatnonzero(met), place[met]]))
        a, b = np.concatenate(pairs, axis=1)
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        names, area = np.unique(root, return_counts=True)
        kept = area >= least
        return pd.DataFrame({**{k: [v] * int(kept.sum()) for k, v in out.items()}, "blob": at[names[kept]] // width * 0 + np.arange(int(kept.sum())), "area": area[kept].astype(np.int64)})

    return rows


def blobs(pixels: DataFrame, keys: Sequence[str], on: Column, least: int = 20) -> DataFrame:
    """(keys, blob, area) of the connected parts of a mask, by their sides; parts below the least area are left out. An image is one task's, as a tile."""
    kinds = dict(pixels.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "blob long", "area long"])
    return pixels.select(*keys, "px", "py", on.alias("on")).where("on IS NOT NULL").groupBy(*keys).applyInPandas(_blobs(keys, least), schema)


def nuclei(pixels: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """(keys, count, coverage, mean_area) of what holds more haematoxylin than the best threshold."""
    h = hed()[0]
    marked = _with(pixels.withColumn("_h", h), otsu(pixels, keys, h), keys)
    found = blobs(marked, keys, F.col("_h") > F.coalesce("threshold", F.lit(float("inf"))), least)
    sizes = pixels.groupBy(*keys).agg(F.count("*").alias("_n"))
    told = found.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("area").alias("_a"), F.avg("area").alias("mean_area"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    return _with(sizes, told, keys, "left").select(*keys, zero(F.col("count")).alias("count"), zero(F.col("_a") / F.col("_n")).alias("coverage"), zero(F.col("mean_area")).alias("mean_area"))


def adjusted(pixels: DataFrame, keys: Sequence[str], brightness: float = 1.0, contrast: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """Gamma, then brightness, then contrast about the image's mean grey; values are cut to whole ones at each step."""
    clip = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("long")
    out = pixels
    if gamma > 0 and gamma != 1:
        out = out.withColumns({c: clip(F.pow(F.col(c) / 255.0, F.lit(1.0 / gamma)) * 255.0) for c in RGB})
    if brightness != 1:
        out = out.withColumns({c: clip(F.col(c) * brightness) for c in RGB})
    if contrast != 1:
        mean = out.groupBy(*keys).agg(F.floor(F.avg(gray()) + 0.5).alias("_mean"))
        out = _with(out, mean, keys).withColumns({c: clip(F.col("_mean") + contrast * (F.col(c) - F.col("_mean"))) for c in RGB}).drop("_mean")
    return out


def stain_range(pixels: DataFrame, keys: Sequence[str], stain: int) -> DataFrame:
    """(keys, low, high) of a stain, to be fitted once a slide."""
    value = hed()[stain]
    return pixels.select(*keys, value.alias("_v")).groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))


def stain_view(pixels: DataFrame, ranges: DataFrame, keys: Sequence[str], stain: int) -> DataFrame:
    """pixels with ``shade``: a stain within its range, dense ones dark."""
    value = hed()[stain]
    share = F.when(F.col("high") > F.col("low"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.col("low")) / (F.col("high") - F.col("low"))))).otherwise(0.0)
    return _with(pixels, ranges, keys).withColumn("shade", F.floor((1.0 - share) * 255.0).cast("long")).drop("low", "high")


def shades(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """grid (keys, gx, gy, value) with ``shade``, 0 to 255 between the least and greatest value, half to even; all of one value are 255, cells without one NULL."""
    ends = grid.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    share = (F.col("value") - F.col("_a")) / (F.col("_b") - F.col("_a")) * 255.0
    told = F.when(F.col("value").isNull(), None).when(F.col("_b") > F.col("_a"), F.bround(share)).otherwise(255)
    return _with(grid, ends, keys).withColumn("shade", told.cast("int")).drop("_a", "_b")


# Colours at equal steps of a perceptually even scale from dark violet to yellow.
SCALE = ((68, 1, 84), (71, 44, 122), (59, 81, 139), (44, 113, 142), (33, 144, 141), (39, 173, 129), (92, 200, 99), (170, 220, 50), (253, 231, 37))


def colour(shade: Column, channel: int) -> Column:
    """A channel of a shade's colour, between the two steps of SCALE around it."""
    steps = F.array(*[F.lit(float(c[channel])) for c in SCALE])
    place = shade * (len(SCALE) - 1) / 255.0
    low = F.least(F.floor(place), F.lit(len(SCALE) - 2)).cast("int")
    return F.bround(F.element_at(steps, low + 1) + (place - low) * (F.element_at(steps, low + 2) - F.element_at(steps, low + 1))).cast("int")


def heatmap(pixels: DataFrame, grid: DataFrame, keys: Sequence[str], cell_w: float, cell_h: float, alpha: float = 0.45) -> DataFrame:
    """pixels blended with the colours of the grid's cells they lie in; cells without a value leave them as they are."""
    shaded = shades(grid, keys).select(*keys, "gx", "gy", "shade")
    held = pixels.withColumns({"gx": F.floor(F.col("px") / cell_w).cast("long"), "gy": F.floor(F.col("py") / cell_h).cast("long")})
    met = held.join(shaded.withColumns({"gx": F.col("gx").cast("long"), "gy": F.col("gy").cast("long")}), [*keys, "gx", "gy"], "left")
    mixed = {c: F.when(F.col("shade").isNull(), F.col(c)).otherwise(F.bround(F.col(c) * (1 - alpha) + colour(F.col("shade"), i) * alpha)).cast("long") for i, c in enumerate(RGB)}
    return met.withColumns(mixed).drop("gx", "gy", "shade")


def _ordered(matrix: np.ndarray) -> np.ndarray:
    """Haematoxylin first: it absorbs more red."""
    return matrix if matrix[0][0] >= matrix[1][0] else matrix[::-1].copy()


def ruifrok() -> np.ndarray:
    m = np.array(STAINS)
    return _ordered(m / np.linalg.norm(m, axis=1, keepdims=True))


def _dense(pixels: DataFrame, threshold: float) -> DataFrame:
    od = pixels.select(*(optical_density(c).alias(c) for c in RGB))
    return od.where((F.col("r") + F.col("g") + F.col("b")) / 3 > float(-np.log(threshold)))


def macenko(pixels: DataFrame, threshold: float = 0.85) -> np.ndarray:
    """The two stain vectors of one image: the extreme directions in the plane of its densities' main axes. The driver gets nine sums and two percentiles."""
    od = _dense(pixels, threshold)
    sums = od.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a in RGB for b in RGB)).first()
    if sums["n"] < LEAST_TISSUE:
        return np.array(STAINS)
    _, axes = np.linalg.eigh(np.array([[sums[a + b] for b in RGB] for a in RGB]))
    v1, v2 = (v if v.sum() >= 0 else -v for v in (axes[:, 2], axes[:, 1]))
    along = lambda v: sum((F.col(c) * float(x) for c, x in zip(RGB, v, strict=True)), F.lit(0.0))
    low, high = od.agg(F.percentile(F.atan2(along(v2), along(v1)), F.array(F.lit(0.01), F.lit(0.99)))).first()[0]
    return _ordered(np.array([np.cos(a) * v1 + np.sin(a) * v2 for a in (low, high)]))


METHODS = {"macenko": macenko, "ruifrok": lambda pixels, threshold=0.85: ruifrok()}


def _concentrations(matrix: np.ndarray) -> tuple[Column, Column]:
    """Least squares of a pixel's densities by two stain vectors, none below 0."""
    back = np.linalg.pinv(matrix.T)
    return tuple(F.greatest(F.lit(0.0), sum((optical_density(c) * float(back[i, j]) for j, c in enumerate(RGB)), F.lit(0.0))) for i in range(2))


def stain_reference(pixels: DataFrame, method: str = "macenko", threshold: float = 0.85) -> dict:
    """The stain matrix of an image and the 99th percentile of each stain in it."""
    key = (method or "").strip().lower()
    if key not in METHODS:
        raise ValueError(f"unknown stain method {method!r}; there are {', '.join(sorted(METHODS))} and reinhard")
    matrix = METHODS[key](pixels, threshold)
    top = pixels.agg(*(F.percentile(c, 0.99) for c in _concentrations(matrix))).first()
    return {"stain_matrix": matrix.tolist(), "max_conc": [max(float(v), 1e-6) for v in top]}


def normalized(pixels: DataFrame, method: str = "macenko", reference: dict | None = None, threshold: float = 0.85) -> DataFrame:
    """One image with its stains brought to a reference's vectors and strengths, its own without one."""
    if (method or "").strip().lower() == "reinhard":
        return reinhard(pixels, ())
    own = stain_reference(pixels, method, threshold)
    goal = reference or own
    scaled = [c * (g / o) for c, g, o in zip(_concentrations(np.array(own["stain_matrix"])), goal["max_conc"], own["max_conc"], strict=True)]
    vectors = goal["stain_matrix"]
    back = {c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 256.0 * F.exp(-(scaled[0] * float(vectors[0][j]) + scaled[1] * float(vectors[1][j]))) - 1.0))).cast("long") for j, c in enumerate(RGB)}
    return pixels.withColumns(back)


def lab() -> tuple[Column, Column, Column]:
    """A pixel in CIE L*a*b*, white D65."""
    line = [F.when(F.col(c) / 255.0 > 0.04045, F.pow((F.col(c) / 255.0 + 0.055) / 1.055, 2.4)).otherwise(F.col(c) / 255.0 / 12.92) for c in RGB]
    to = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
    scaled = [sum((x * w for x, w in zip(line, row, strict=True)), F.lit(0.0)) / white for row, white in zip(to, WHITE, strict=True)]
    x, y, z = (F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16.0 / 116.0) for v in scaled)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def from_lab(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1."""
    y = (lightness + 16.0) / 116.0
    x, z = a / 500.0 + y, F.greatest(y - b / 200.0, F.lit(0.0))
    x, y, z = (F.when(v > 0.2068966, v * v * v).otherwise((v - 16.0 / 116.0) / 7.787) * white for v, white in zip((x, y, z), WHITE, strict=True))
    back = np.linalg.inv(np.array(((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))))
    line = [x * float(r[0]) + y * float(r[1]) + z * float(r[2]) for r in back]
    lit = [F.when(v > 0.0031308, 1.055 * F.pow(v, 1 / 2.4) - 0.055).otherwise(v * 12.92) for v in line]
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in lit)


def reinhard(pixels: DataFrame, keys: Sequence[str], mean: Sequence[float] = REINHARD[0], std: Sequence[float] = REINHARD[1]) -> DataFrame:
    """Images whose three channels in L*a*b* have given means and deviations; a flat channel only moves."""
    names = ("_L", "_A", "_B")
    held = pixels.withColumns(dict(zip(names, lab(), strict=True)))
    told = held.groupBy(*keys).agg(*(F.avg(n).alias(f"{n}m") for n in names), *(F.stddev_pop(n).alias(f"{n}s") for n in names))
    moved = [(F.col(n) - F.col(f"{n}m")) / F.when(F.col(f"{n}s") < 1e-6, 1.0).otherwise(F.col(f"{n}s")) * s + m for n, m, s in zip(names, mean, std, strict=True)]
    out = dict(zip(RGB, (F.bround(c * 255.0).cast("long") for c in from_lab(*moved)), strict=True))
    return _with(held, told, keys).withColumns(out).select(*pixels.columns)


def feature_vector(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, features): 15 of the stains, 24 of the channels' histograms, tissue, blur, 3 of the nuclei, 12 of the texture, in this order.

    Tissue is the share below the luminance threshold, textures are of the pixels as they are.
    """
    stains = stain_stats(pixels, keys)
    out = stains.select(*keys, F.array(*[F.col(f"{s}_{x}") for s in "hed" for x in ("mean", "std", "p10", "p50", "p90")]).alias("_0"))
    parts = ["_0"]
    for c in RGB:
        own = pixels.groupBy(*keys).agg(F.array(*[F.count_if(F.floor(F.col(c) / 32) == i) / F.count("*") for i in range(8)]).alias(f"_h{c}"))
        out, parts = _with(out, own, keys), [*parts, f"_h{c}"]
    share = pixels.groupBy(*keys).agg(F.avg(is_tissue().cast("double")).alias("_t"))
    out = _with(_with(out, share, keys), blur(pixels, keys).select(*keys, F.col("blur").alias("_b")), keys)
    out = _with(out, nuclei(pixels, keys).select(*keys, F.array("count", "coverage", "mean_area").alias("_n")), keys)
    pieces = []
    for distance in (1, 2):
        for down in (False, True):
            name = f"_g{distance}{int(down)}"
            own = texture(cooccurrence(pixels, keys, distance, down), keys).select(*keys, F.struct("contrast", "homogeneity", "correlation").alias(name))
            out = _with(out, own, keys, "left")
            pieces.append(name)
    glcm = F.array(*[F.col(f"{n}.{p}") for p in ("contrast", "homogeneity", "correlation") for n in pieces])
    return out.select(*keys, F.transform(F.concat(*parts, F.array("_t", "_b"), F.col("_n"), glcm), lambda v: v.cast("float")).alias("features"))


def sweep(tiles: Iterator, metric, name: str = "value"):
    """For mapInPandas: a metric of every tile; one that fails gives no value but its error."""
    for pdf in tiles:
        told = []
        for row in pdf.to_dict("records"):
            try:
                told.append((float(metric(row)), None))
            except Exception as e:  # noqa: BLE001 a tile's failure is a result
                told.append((None, f"{type(e).__name__}: {e}"))
        pdf[name], pdf["error"] = [v for v, _ in told], [e for _, e in told]
        yield pdf
