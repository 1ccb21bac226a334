"""Points, boxes and circles, as structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    """The box with two opposite corners."""
    return F.struct(F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"), F.least(a["x"], b["x"]).alias("x0"), F.least(a["y"], b["y"]).alias("y0"))


def circle(x: Column, y: Column, radius: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), radius.cast("double").alias("r"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def circles_overlap(a: Column, b: Column) -> Column:
    return distance(a, b) <= a["r"] + b["r"]


def area(c: Column) -> Column:
    return F.pi() * c["r"] * c["r"]


def at_least(a: Column, b: Column) -> Column:
    """Circles are ordered by area."""
    return area(a) >= area(b)
