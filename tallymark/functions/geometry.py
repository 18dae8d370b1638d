"""Boxes given as x, y, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 when they do not overlap."""
    width = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    height = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    shared = width * height
    union = a.w * a.h + b.w * b.h - shared
    return F.when((width > 0) & (height > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def cell(value: Column, size: int) -> Column:
    return F.floor(value / size).cast("long")


def edges(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box by its edges, so that boxes unite by least and greatest."""
    return F.struct(x.alias("x"), y.alias("y"), (x + w).alias("x2"), (y + h).alias("y2"))


def union_of(a: Column, b: Column) -> Column:
    """The least box, by edges, that holds both."""
    return F.struct(
        F.least(a.x, b.x).alias("x"), F.least(a.y, b.y).alias("y"), F.greatest(a.x2, b.x2).alias("x2"), F.greatest(a.y2, b.y2).alias("y2")
    )
