"""Lengths, areas and scales of drawn points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(points: Column, body) -> Column:
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), lambda i: F.when(i < F.size(points), body(F.get(points, i - 1), F.get(points, i))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def path_length(points: Column) -> Column:
    """Of an array of (x, y)."""
    return F.when(F.size(points) < 2, 0.0).otherwise(_steps(points, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def area(points: Column) -> Column:
    """Of the closed polygon."""
    closing = F.get(points, F.size(points) - 1)["x"] * F.get(points, F.lit(0))["y"] - F.get(points, F.lit(0))["x"] * F.get(points, F.size(points) - 1)["y"]
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(_steps(points, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) + closing) / 2)


def distance(ax: Column, ay: Column, bx: Column, by: Column, scale: Column) -> Column:
    """Distance and angle in degrees, in the unit of the scale."""
    return F.struct((F.hypot(bx - ax, by - ay) * scale).alias("length"), F.degrees(F.atan2(by - ay, bx - ax)).alias("angle"))


def calibrate(measured: Column, true: Column) -> Column:
    return F.when(measured > 0, true / measured)


def scale_lookup(points: DataFrame, viewports: DataFrame, default: float = 1.0) -> DataFrame:
    """Adds ``scale``: of the last viewport (ord) that contains the point on its page, else the default."""
    v = viewports.select(F.col("page").alias("__p"), "ord", "x0", "y0", "x1", "y1", F.col("scale").alias("__s"))
    inside = (F.col("page") == F.col("__p")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    keys = points.columns
    best = points.join(v, inside, "left").groupBy(*keys).agg(F.max_by("__s", "ord").alias("__s"))
    return best.select(*keys, F.coalesce("__s", F.lit(default)).alias("scale"))


def box_union(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
