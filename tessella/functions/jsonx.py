"""Tolerant reading of JSON documents: what doesn't parse is an empty document, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = "width_px INT, height_px INT, mean_rgb ARRAY<DOUBLE>, he_deconvolution STRUCT<hematoxylin_mean: DOUBLE, eosin_mean: DOUBLE>, tissue_fraction DOUBLE"


def finite(x: Column) -> Column:
    """NULL for NaN and infinities, which aggregates would carry on."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def has_keys(text: Column) -> Column:
    return F.coalesce(F.size(F.json_object_keys(text)) > 0, F.lit(False))


def stats(text: Column) -> Column:
    """The statistics document of a region; all fields NULL where it can't be read."""
    return F.from_json(text, STATS)
