"""Queries of pixels: the image of the view ``pixels``, whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import pixels as P
from tessella.plans.registry import Tables, query
from tessella.sources import rasters

_BACK = np.linalg.inv(np.array(P.HED))
_LOGS = [f"ln(greatest({c} / 255.0, 1e-6)) / {float(np.log(1e-6))!r}" for c in P.RGB]
_HED = [f"greatest({' + '.join(f'({log}) * ({float(_BACK[i, j])!r})' for i, log in enumerate(_LOGS))}, 0.0)" for j in range(3)]
_LUM = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
_GRAY = "CAST(floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536) AS BIGINT)"
_WITH = f"SELECT px, py, r, g, b, {_LUM} < 229.5 AS t, {_HED[0]} AS h, {_HED[1]} AS e, {_GRAY} AS gray FROM pixels"
_CIRCLE = "(px - 20) * (px - 20) + (2 * py - 9) * (2 * py - 9) <= 144"


@query(f"SELECT round(avg({_HED[0]}), 9) AS h_mean, round(stddev_pop({_HED[1]}), 9) AS e_std, round(quantile_cont({_HED[2]}, 0.9), 9) AS d_p90, round(quantile_cont({_HED[0]}, 0.1), 9) AS h_p10 FROM pixels")
def stain_statistics(t: Tables) -> DataFrame:
    return P.stain_stats(t("pixels"), ()).select(*(F.round(c, 9).alias(c) for c in ("h_mean", "e_std", "d_p90", "h_p10")))


@query(f"SELECT count(*) AS n, round(avg(r) FILTER (i AND t), 6) AS mean_r, round(avg(h) FILTER (i AND t), 9) AS hematoxylin, round(avg(e) FILTER (i AND t), 9) AS eosin, round(count_if(i AND t) / count_if(i), 9) AS tissue FROM (SELECT *, {_CIRCLE} AS i FROM ({_WITH}) x) y")
def region_statistics(t: Tables) -> DataFrame:
    """Statistics of the tissue in a circle, whose rows are twice as far apart as its columns."""
    inside = P.in_circle(F.lit(20), F.lit(9), F.lit(12), F.lit(0), F.lit(0), F.lit(1), F.lit(2))
    told = P.region_stats(t("pixels"), (), inside)
    return told.select("n", F.round("mean_r", 6).alias("mean_r"), *(F.round(c, 9).alias(c) for c in ("hematoxylin", "eosin", "tissue")))


@query(f"""SELECT round(var_pop(l), 5) AS blur, var_pop(l) < 100 AS blurry, round(sum(r + g + b) / (3 * count(*)), 6) AS brightness FROM (SELECT *, coalesce(lag(gray) OVER a, gray) + coalesce(lead(gray) OVER a, gray) + coalesce(lag(gray) OVER d, gray) + coalesce(lead(gray) OVER d, gray) - 4 * gray AS l FROM ({_WITH}) x
    WINDOW a AS (PARTITION BY py ORDER BY px), d AS (PARTITION BY px ORDER BY py)) y""")
def blur_score(t: Tables) -> DataFrame:
    return P.blur(t("pixels"), ()).select(F.round("blur", 5).alias("blur"), "blurry", F.round("brightness", 6).alias("brightness"))


@query("SELECT CAST(k.bin AS INTEGER) AS bin, count_if(floor(p.r / 32) = k.bin) / count(*) AS share FROM pixels p, (SELECT range AS bin FROM range(8)) k GROUP BY k.bin")
def histogram_shares(t: Tables) -> DataFrame:
    return P.histogram(t("pixels"), (), "r")


_PAIRS = f"SELECT CAST(least(floor(a.gray * 16 / 256), 15) AS INTEGER) AS i, CAST(least(floor(b.gray * 16 / 256), 15) AS INTEGER) AS j FROM ({_WITH}) a JOIN ({_WITH}) b ON b.px = a.px + 2 AND b.py = a.py"


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p), c AS (SELECT i, j, count(*) / (SELECT count(*) FROM s) AS p FROM s GROUP BY i, j), m AS (SELECT sum(p * i) AS m, sum(p * i * i) AS q, sum(p * i * j) AS c, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity FROM c)
    SELECT round(contrast, 8) AS contrast, round(homogeneity, 8) AS homogeneity, round((c - m * m) / (q - m * m), 8) AS correlation FROM m""")
def texture_statistics(t: Tables) -> DataFrame:
    told = P.texture(P.cooccurrence(t("pixels"), (), 2, down=False), ())
    return told.select(*(F.round(c, 8).alias(c) for c in ("contrast", "homogeneity", "correlation")))


@query(f"""WITH v AS (SELECT CAST(gray AS DOUBLE) AS v FROM ({_WITH}) x), e AS (SELECT min(v) AS a, max(v) AS b FROM v), h AS (SELECT CAST(least(floor((v - a) / (b - a) * 256), 255) AS INTEGER) AS i, count(*) AS n FROM v, e GROUP BY 1), m AS (SELECT i, n, a + (i + 0.5) * (b - a) / 256 AS m FROM h, e),
    s AS (SELECT i, m, sum(n) OVER lo AS n1, sum(n) OVER hi AS n2, sum(n * m) OVER lo AS w1, sum(n * m) OVER hi AS w2 FROM m WINDOW lo AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT round(m, 8) AS threshold FROM s WHERE n2 IS NOT NULL ORDER BY n1 * n2 * (w1 / n1 - w2 / n2) * (w1 / n1 - w2 / n2) DESC, i LIMIT 1""")
def best_threshold(t: Tables) -> DataFrame:
    return P.otsu(t("pixels"), (), P.gray().cast("double")).select(F.round("threshold", 8).alias("threshold"))


_GAMMA = lambda c: f"CAST(floor(least(255.0, pow({c} / 255.0, 1 / 1.5) * 255.0)) AS BIGINT)"
_BRIGHT = lambda c: f"CAST(floor(least(255.0, {c} * 1.25)) AS BIGINT)"


@query(f"""WITH g AS (SELECT x, {', '.join(f'{_GAMMA(c)} AS {c}' for c in P.RGB)} FROM pixels), b AS (SELECT x, {', '.join(f'{_BRIGHT(c)} AS {c}' for c in P.RGB)} FROM g), m AS (SELECT floor(avg({_GRAY}) + 0.5) AS m FROM b)
    SELECT x, {', '.join(f'CAST(floor(greatest(0.0, least(255.0, m + 0.75 * ({c} - m)))) AS BIGINT) AS {c}' for c in P.RGB)} FROM b, m""")
def display_adjusted(t: Tables) -> DataFrame:
    return P.adjusted(t("pixels"), (), brightness=1.25, contrast=0.75, gamma=1.5).select("x", *P.RGB)


@query(f"WITH h AS (SELECT x, {_HED[1]} AS v FROM pixels), e AS (SELECT min(v) AS a, max(v) AS b FROM h) SELECT x, CAST(floor((1.0 - (v - a) / (b - a)) * 255.0) AS BIGINT) AS shade FROM h, e")
def stain_channel(t: Tables) -> DataFrame:
    """The eosin of every pixel within the slide's own range."""
    own = t("pixels")
    return P.stain_view(own, P.stain_range(own, (), 1), (), 1).select("x", "shade")


_GRID = f"SELECT gx, gy, CASE WHEN gx = 2 THEN NULL ELSE v END AS value FROM (SELECT CAST(floor(px / 16) AS BIGINT) AS gx, CAST(floor(py / 4) AS BIGINT) AS gy, avg({_LUM}) AS v FROM pixels GROUP BY 1, 2) c"


@query(f"SELECT gx, gy, CAST(CASE WHEN value IS NULL THEN NULL ELSE round_even((value - a) / (b - a) * 255.0, 0) END AS INTEGER) AS shade FROM ({_GRID}) g, (SELECT min(value) AS a, max(value) AS b FROM ({_GRID}) x) e")
def heatmap_shades(t: Tables) -> DataFrame:
    return P.shades(_grid(t), ()).select("gx", "gy", "shade")


def _grid(t: Tables) -> DataFrame:
    gx = F.floor(F.col("px") / 16)
    means = t("pixels").groupBy(gx.alias("gx"), F.floor(F.col("py") / 4).alias("gy")).agg(F.avg(P.luminance()).alias("v"))
    return means.select("gx", "gy", F.when(F.col("gx") != 2, F.col("v")).alias("value"))


@query(None)
def heatmap_image(t: Tables) -> DataFrame:
    """The image under its heatmap."""
    return P.heatmap(t("pixels"), _grid(t), (), 16, 4).select("x", *P.RGB)


@query(None)
def nuclei_counts(t: Tables) -> DataFrame:
    return P.nuclei(t("pixels"), (), least=2)


@query(None)
def stain_normalized(t: Tables) -> DataFrame:
    return P.normalized(t("pixels"), "macenko", {"stain_matrix": P.ruifrok().tolist(), "max_conc": [1.0, 1.0]}).select("x", *P.RGB)


@query(None)
def reinhard_normalized(t: Tables) -> DataFrame:
    return P.reinhard(t("pixels"), ()).select("x", *P.RGB)


@query(None)
def feature_vectors(t: Tables) -> DataFrame:
    """The 56 features of each band of sixteen rows of the image."""
    bands = t("pixels").withColumns({"band": F.floor(F.col("py") / 16), "py": F.col("py") % 16})
    return P.feature_vector(bands, ("band",))


@query("SELECT CAST(a.px AS BIGINT) AS px, CAST(b.py AS BIGINT) AS py, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b FROM range(40) a(px) CROSS JOIN range(12) b(py) LEFT JOIN pixels p ON p.px = a.px + 40 AND p.py = b.py - 3")
def region_read(t: Tables) -> DataFrame:
    """A region that hangs over the image's right and upper edge."""
    return rasters.region(t("pixels").select("px", "py", *P.RGB), (), 40, -3, 40, 12)


@query("SELECT CAST(floor(px / 4) AS BIGINT) AS px, CAST(floor(py / 4) AS BIGINT) AS py, CAST(floor(avg(r) + 0.5) AS BIGINT) AS r, CAST(floor(avg(g) + 0.5) AS BIGINT) AS g, CAST(floor(avg(b) + 0.5) AS BIGINT) AS b FROM pixels GROUP BY 1, 2")
def thumbnail(t: Tables) -> DataFrame:
    return rasters.coarser(t("pixels"), (), 4)


@query("""SELECT id, CASE id % 6 WHEN 0 THEN 'dicom' WHEN 1 THEN 'slide' WHEN 2 THEN 'tiff' WHEN 3 THEN 'png' WHEN 4 THEN 'slide' END AS format, CAST(1 + greatest(0, ceil(log2(least(width, 300 * (id % 40 + 1)) / 512.0))) AS INTEGER) AS levels FROM slides""")
def slide_formats(t: Tables) -> DataFrame:
    """Formats by content first, then by name, and the levels of pyramids made of images."""
    head = F.expr("CASE id % 6 WHEN 0 THEN concat(repeat('x', 128), 'DICM') WHEN 1 THEN concat('II*', chr(0), 'x') WHEN 2 THEN concat('MM', chr(0), '*') ELSE 'GIF8' END").cast("binary")
    head = F.when(F.col("id") % 6 == 3, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(head)
    name = F.expr("concat('a.b', id, CASE id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.SVS' WHEN 2 THEN '.tif' WHEN 4 THEN '.mrxs' ELSE '.gif' END)")
    return t("slides").select("id", rasters.file_format(head, name).alias("format"), rasters.level_count(F.col("width"), 300 * (F.col("id") % 40 + 1)).alias("levels"))


@query(None)
def synthetic_slide(t: Tables) -> DataFrame:
    return rasters.synthetic(t("region").sparkSession, 240, 160)
