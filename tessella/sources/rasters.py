"""Images and pyramids as rows: formats told by content, image files as tiles, regions read with a white margin, coarser levels.

Tiles are rows (path, level, col, row, width, height, data) of 8-bit red, green and blue; pixels are rows (keys, px, py, r, g, b).
Proprietary slide formats need libraries of their own; ``DECODERS`` maps a format to a function that a caller provides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
#: Format -> function from an image's bytes to an array (height, width, 3) of bytes.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {}


def file_format(head: Column, name: Column) -> Column:
    """The format of a file by its first bytes, else by its name: dicom, tiff, png, jpeg, slide; NULL for others."""
    hexed = F.hex(F.substring(head, 1, 8))
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(F.substring(head, 129, 4) == F.encode(F.lit("DICM"), "UTF-8"), "dicom")
        .when(hexed.rlike("^(?:49492A00|4D4D002A|49492B00|4D4D002B)"), F.when(suffix.isin("svs", "ndpi", "scn"), "slide").otherwise("tiff"))
        .when(hexed.startswith("89504E470D0A1A0A"), "png")
        .when(hexed.startswith("FFD8FF"), "jpeg")
        .when(suffix.isin("mrxs", "vms", "bif"), "slide")
        .when(suffix == "dcm", "dicom")
    )


def formats(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", file_format(F.substring("content", 1, 132), F.col("path")).alias("format"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data) of image files that Spark decodes; unreadable ones are left out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def level_count(width: Column, height: Column, least: int = 512) -> Column:
    """Levels of a pyramid that halves until the shorter side is at most so long."""
    return (1 + F.greatest(F.lit(0), F.ceil(F.log2(F.least(width, height) / least)))).cast("int")


def _cut(size: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image in pdf.itertuples(index=False):
                a = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.channels)
                a = np.repeat(a, 3, axis=2) if image.channels == 1 else a[:, :, 2::-1]  # Spark has blue first
                out = []
                for row, y in enumerate(range(0, image.height, size)):
                    for col, x in enumerate(range(0, image.width, size)):
                        part = np.ascontiguousarray(a[y : y + size, x : x + size])
                        out.append((image.path, 0, col, row, part.shape[1], part.shape[0], part.tobytes()))
                yield pd.DataFrame(out, columns=["path", "level", "col", "row", "width", "height", "data"])

    return rows


def tiles(found: DataFrame, size: int = 256) -> DataFrame:
    """The tiles of images at level 0."""
    return found.mapInPandas(_cut(size), "path string, level int, col int, row int, width int, height int, data binary")


def _spread(size: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                a = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 3)
                y, x = np.divmod(np.arange(t.height * t.width), t.width)
                r, g, b = a.reshape(-1, 3).astype(np.int64).T
                yield pd.DataFrame({"path": t.path, "level": t.level, "px": t.col * size + x, "py": t.row * size + y, "r": r, "g": g, "b": b})

    return rows


def pixels(cut: DataFrame, size: int = 256) -> DataFrame:
    """The pixels of tiles."""
    return cut.mapInPandas(_spread(size), "path string, level int, px long, py long, r long, g long, b long")


def coarser(held: DataFrame, keys: Sequence[str], factor: int = 2) -> DataFrame:
    """Pixels of a coarser level: means of blocks, rounded half up; blocks at an edge hold what is there."""
    place = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("px", "py")]
    return held.groupBy(*keys, *place).agg(*(F.floor(F.avg(c) + 0.5).cast("long").alias(c) for c in RGB))


def region(held: DataFrame, keys: Sequence[str], x: int, y: int, width: int, height: int) -> DataFrame:
    """Exactly width by height pixels of every image from a corner on, counted from it; white where the image has none."""
    inside = held.where(F.col("px").between(x, x + width - 1) & F.col("py").between(y, y + height - 1))
    moved = inside.select(*keys, (F.col("px") - x).alias("px"), (F.col("py") - y).alias("py"), *RGB)
    names = held.select(*keys).distinct() if keys else held.sparkSession.range(1).select()
    grid = names.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py")).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    place = [F.col(c).cast("long").alias(c) for c in ("px", "py")]
    return grid.select(*keys, *place).join(moved, [*keys, "px", "py"], "left").select(*keys, "px", "py", *(F.coalesce(c, F.lit(255)).cast("long").alias(c) for c in RGB))


def synthetic(spark: SparkSession, width: int, height: int, seed: int = 42) -> DataFrame:
    """(px, py, r, g, b) of a made-up slide: a light ground with dark discs, the same for the same seed and size."""
    spot = F.pmod(F.xxhash64(F.floor(F.col("px") / 40), F.floor(F.col("py") / 40), F.lit(seed)), F.lit(1000)) / 1000.0
    cx, cy, radius = 20 + 8 * (spot - 0.5), 20 - 8 * (spot - 0.5), 4 + 8 * spot
    disc = (F.col("px") % 40 - cx) * (F.col("px") % 40 - cx) + (F.col("py") % 40 - cy) * (F.col("py") % 40 - cy) <= radius * radius
    grain = F.pmod(F.xxhash64("px", "py", F.lit(seed)), F.lit(9)) - 4
    colour = lambda ground, dark: (F.when((spot < 0.6) & disc, dark).otherwise(ground) + grain).cast("long")
    own = spark.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).cast("long").alias("py"))
    return own.select("px", "py", colour(235, 96).alias("r"), colour(190, 60).alias("g"), colour(205, 130).alias("b"))
