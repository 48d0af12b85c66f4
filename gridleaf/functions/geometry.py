"""Boxes as struct columns.  All functions are built-in expressions: they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
SIDES = ("x_min", "y_min", "x_max", "y_max")


def bbox(x_min, y_min, x_max, y_max) -> Column:
    parts = (x_min, y_min, x_max, y_max)
    return F.struct(*((p if isinstance(p, Column) else F.lit(p)).cast("double").alias(n) for p, n in zip(parts, SIDES, strict=True)))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x_max"] - b["x_min"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y_max"] - b["y_min"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x_min"] + b["x_max"]) / 2


def center_y(b: Column) -> Column:
    return (b["y_min"] + b["y_max"]) / 2


def center(b: Column) -> Column:
    return F.struct(center_x(b).alias("x"), center_y(b).alias("y"))


def to_tuple(b: Column) -> Column:
    """Sides cut toward zero."""
    return F.struct(*(b[s].cast("int").alias(s) for s in SIDES))


def padding(b: Column, pixel) -> Column:
    return bbox(b["x_min"] - pixel, b["y_min"] - pixel, b["x_max"] + pixel, b["y_max"] + pixel)


def margin(b: Column, pixel) -> Column:
    return bbox(b["x_min"] + pixel, b["y_min"] + pixel, b["x_max"] - pixel, b["y_max"] - pixel)


def intersect(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    across = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    down = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def _same(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for s in SIDES:
        out = out & (F.abs(a[s] - b[s]) <= EPS)
    return F.when(out, 1.0).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Shared area over united area; boxes without any area: 1 if they are the same, else 0."""
    shared = intersect(a, b)
    united = area(a) + area(b) - shared
    return F.when(united > 0, shared / F.when(united > 0, united)).otherwise(_same(a, b))


def intersection_over_min(a: Column, b: Column) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersect(a, b) / F.when(smaller > 0, smaller)).otherwise(_same(a, b))


def contains(a: Column, b: Column) -> Column:
    return (a["x_min"] - EPS <= b["x_min"]) & (a["y_min"] - EPS <= b["y_min"]) & (a["x_max"] + EPS >= b["x_max"]) & (a["y_max"] + EPS >= b["y_max"])


def contains_center(a: Column, b: Column) -> Column:
    """Whether the centre of b is in a; all edges count as inside."""
    return center_x(b).between(a["x_min"], a["x_max"]) & center_y(b).between(a["y_min"], a["y_max"])


def union_box(a: Column, b: Column) -> Column:
    return bbox(F.least(a["x_min"], b["x_min"]), F.least(a["y_min"], b["y_min"]), F.greatest(a["x_max"], b["x_max"]), F.greatest(a["y_max"], b["y_max"]))


def roi(b: Column, image_width, image_height) -> Column:
    """The box cut to whole pixels and to the image: rows y_min to y_max, columns x_min to x_max, ends excluded."""
    t = to_tuple(b)
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (image_width, image_height))
    return F.struct(*(F.least(F.greatest(t[s], F.lit(0)), limit).alias(s) for s, limit in zip(SIDES, (w, h, w, h), strict=True)))


def order_points(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left of an array of points (x, y); of equal candidates the first."""

    def least(measure: Callable[[Column], Column]) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct(measure(p).alias("m"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    total, apart = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(least(total), least(apart), least(lambda p: -total(p)), least(lambda p: -apart(p)))
