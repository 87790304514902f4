"""Selections as viewers report them, in JSON text: what can't be used is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import geometry

POINT = "array<struct<x:double,y:double>>"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _points(pairs: Column) -> Column:
    """Points of an array of pairs, longer ones cut; NULL if any is short or not finite."""
    fine = F.forall(pairs, lambda p: F.coalesce(_finite(F.try_element_at(p, F.lit(1))) & _finite(F.try_element_at(p, F.lit(2))), F.lit(False)))
    return F.when(fine, F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def _corners(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y")), F.struct(F.array_max(xs).alias("x"), F.array_max(ys).alias("y")))


def selection(text: Column) -> Column:
    """struct(kind, points) of a selection at level 0: rect by two corners, polygon of at least three points; measurements are none."""
    told = F.from_json(text, "kind STRING, points_level0 ARRAY<ARRAY<DOUBLE>>")
    kind, points = told["kind"], _points(told["points_level0"])
    whole = F.when((kind == "rect") & (F.size(points) >= 2), _corners(points)).when((kind == "polygon") & (F.size(points) >= 3), points)
    return F.when(whole.isNotNull(), F.struct(kind.alias("kind"), whole.alias("points")))


def measured(text: Column) -> Column:
    """The two corners of a measurement; NULL for anything else."""
    told = F.from_json(text, "kind STRING, points_level0 ARRAY<ARRAY<DOUBLE>>")
    points = _points(told["points_level0"])
    return F.when((told["kind"] == "measure") & (F.size(points) >= 2), _corners(points))


def drawn(text: Column) -> Column:
    """struct(kind, points) of a box or a lasso drawn on a figure, in its pixels; a box comes first."""
    told = F.from_json(text, "range STRUCT<x: ARRAY<DOUBLE>, y: ARRAY<DOUBLE>>, lasso STRUCT<x: ARRAY<DOUBLE>, y: ARRAY<DOUBLE>>")
    ends = F.array(*[F.array(F.try_element_at(told["range"]["x"], F.lit(i)), F.try_element_at(told["range"]["y"], F.lit(i))) for i in (1, 2)])
    n = F.least(F.size(told["lasso"]["x"]), F.size(told["lasso"]["y"]))
    lasso = F.transform(F.arrays_zip(F.slice(told["lasso"]["x"], F.lit(1), n), F.slice(told["lasso"]["y"], F.lit(1), n)), lambda z: F.array(z["0"], z["1"]))
    box, line = _points(ends), F.when(n >= 3, _points(lasso))
    is_box = told["range"]["x"].isNotNull() & told["range"]["y"].isNotNull()
    return F.when(is_box, F.when(box.isNotNull(), F.struct(F.lit("box").alias("kind"), _corners(box).alias("points")))).when(line.isNotNull(), F.struct(F.lit("lasso").alias("kind"), line.alias("points")))


def as_region(kind: Column, points: Column, as_circle: bool = False) -> Column:
    """struct(kind, points) of a region: a box is a rectangle, or the circle in it by its centre and a point of its rim; a lasso is a polygon."""
    at = lambda i, axis: F.try_element_at(points, F.lit(i))[axis]
    cx, cy = (at(1, "x") + at(2, "x")) / 2.0, (at(1, "y") + at(2, "y")) / 2.0
    radius = F.least(at(2, "x") - at(1, "x"), at(2, "y") - at(1, "y")) / 2.0
    circle = F.struct(F.lit("circle").alias("kind"), F.array(F.struct(cx.alias("x"), cy.alias("y")), F.struct((cx + radius).alias("x"), cy.alias("y"))).alias("points"))
    rect = F.struct(F.lit("rect").alias("kind"), points.alias("points"))
    return F.when(kind.isin("box", "rect"), circle if as_circle else rect).when(kind.isNotNull(), F.struct(F.lit("polygon").alias("kind"), points.alias("points")))


def contract(kind: Column, points: Column, downsample: Column, slide: Column, width: Column, height: Column, mpp: Column) -> Column:
    """The seven fields by which agents know a selection, as JSON text; an unknown resolution is null."""
    box = geometry.bbox(kind, points)
    pairs = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    told = F.struct(kind.alias("kind"), pairs.alias("points_level0"), F.array(*[box[c] for c in ("x0", "y0", "x1", "y1")]).alias("bbox_level0"), downsample.alias("viewport_downsample"), slide.alias("slide"), F.array(width, height).alias("slide_dimensions"), mpp.alias("mpp"))
    return F.when(kind.isNotNull(), F.to_json(told, {"ignoreNullFields": "false"}))


def clicked(text: Column) -> Column:
    """The index before the sequence mark of a click; NULL unless it is a whole number from 0."""
    head = F.trim(F.substring_index(text, "#", 1))
    return F.when(head.rlike(r"^\+?[0-9]+$"), head.try_cast("long"))


def overlay(kind: Column, points: Column, place: Column, chosen: Column) -> Column:
    """What an overlay draws: struct(kind, points, selected)."""
    return F.struct(kind.alias("kind"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("points"), F.coalesce(place == chosen, F.lit(False)).alias("selected"))
