"""As-of joins and interpolation onto grids.

The rows of both sides are merged by key and time in one shuffle and carried
forwards and backwards with windows whose frames only grow: no row is compared
with more than its two neighbours, whatever the size of the sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import cosine_ease
from ..storage import dealt, written


def bracketed(points: DataFrame, grid: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Grid rows with structs ``before`` (last point at or before) and ``after`` (first point at or after).

    Either is null beyond the points.  Of points at one time the last by all
    columns counts for ``before``, the first for ``after``.
    """
    point = F.struct(F.col(time).alias(time), *[F.col(c).alias(c) for c in columns])
    left = points.select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.lit(0).alias("side"), point.alias("point"), F.lit(None).cast(grid.select(F.struct("*")).schema[0].dataType).alias("row"))
    right = grid.select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["point"].dataType).alias("point"), F.struct("*").alias("row"))
    both = dealt(left.unionByName(right), "k")
    back = Window.partitionBy("k").orderBy("t", "side", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows is read in reverse: a frame to the series' end would be gone through again for every row
    forth = Window.partitionBy("k").orderBy(F.desc("t"), "side", F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumns({"before": F.last("point", ignorenulls=True).over(back), "after": F.last("point", ignorenulls=True).over(forth)})
    return held.where("side = 1").select("row.*", "before", "after")


def interpolated(points: DataFrame, grid: DataFrame, key: str, time: str, columns: Sequence[str], *, ease: Callable[[Column], Column] | None = None, order: str | None = None) -> DataFrame:
    """Values at grid times between the two neighbouring points; end values beyond them.

    Grid rows of a key without points are left out.  Points at one time follow
    in the order of ``order``, or of the columns.
    """
    found = bracketed(points, grid, key, time, [*([order] if order else []), *columns])
    a, b, t = F.col("before"), F.col("after"), F.col(time).cast("double")
    span = b[time].cast("double") - a[time].cast("double")
    part = F.when(span <= 0, 0.0).otherwise((t - a[time].cast("double")) / span)
    part = ease(part) if ease else part
    value = lambda c: F.when(a.isNull(), b[c]).when(b.isNull(), a[c]).otherwise(a[c] + part * (b[c] - a[c]))
    return found.where(a.isNotNull() | b.isNotNull()).select(*grid.columns, *[value(c).alias(c) for c in columns])


def eased(points: DataFrame, grid: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    return interpolated(points, grid, key, time, columns, ease=cosine_ease)


#: Side of the finest cells of ``nearest``: 180 degrees halved so often.
FINEST = 24


def nearest(points: DataFrame, targets: DataFrame, *, order: str, point: tuple[str, str] = ("lat", "lon"), target: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """The point of least great-circle distance for every target: its columns, ``distance`` in metres and ``point``; ties to the smallest ``order``.

    Points and targets meet in cells of a grid, a target in its own cell and
    the eight around it, by an equality join.  A find nearer than all that lies
    beyond these cells is proven; targets without one are asked again on a grid
    four times as wide.  The first grid has about a point a cell, the last one
    is a single cell in height.  Equal targets are asked once; places that are
    null meet nothing; without points there are no rows.
    """
    from ..functions.geo import EARTH, haversine

    at = lambda names: [F.col(c).cast("double").alias(n) for c, n in zip(names, ("y", "x"), strict=True)]
    known = F.col("y").isNotNull() & F.col("x").isNotNull()
    held = points.select(*at(point), F.struct(F.col(order).alias("o"), F.struct("*").alias("point")).alias("p")).where(known)
    # of points at one place the first counts
    held = written(held.groupBy("y", "x").agg(F.min("p").alias("p")), "points")
    asked = written(targets.select(*at(target), F.struct("*").alias("target")).where(known).distinct(), "targets")
    n, low, high, west, east = held.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if not n:
        return held.join(asked.limit(0).select("target"), F.lit(False)).select("target.*", F.lit(0.0).alias("distance"), "p.point")
    apart = math.sqrt(max((high - low) * (east - west), 1e-9) / n)
    level = max(0, min(FINEST, round(math.log2(180.0 / apart))))
    found = None
    while True:
        side, columns = 180.0 / (1 << level), 1 << (level + 1)
        row, column = F.floor((F.col("y") + 90.0) / side), F.pmod(F.floor((F.col("x") + 180.0) / side), F.lit(columns))
        around = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((row + i).alias("r"), F.pmod(column + j, F.lit(columns)).alias("c"))))))
        cells = held.select(F.struct(row.alias("r"), column.alias("c")).alias("cell"), F.col("y").alias("py"), F.col("x").alias("px"), "p")
        met = asked.select("target", "y", "x", F.explode(around).alias("cell")).join(cells, "cell")
        distance = haversine(F.col("y"), F.col("x"), F.col("py"), F.col("px"))
        best = met.groupBy("target", "y", "x").agg(F.min(F.struct(distance.alias("distance"), F.col("p.o").alias("o"), F.col("p.point").alias("point"))).alias("best"))
        # beyond the cells lie places a side off in latitude, and those over the meridian a side off
        turn = math.radians(min(side, 90.0))
        beyond = EARTH * F.least(F.lit(math.radians(side)), F.asin(F.sin(F.lit(turn)) * F.cos(F.radians("y")))) * (1.0 - 1e-9)
        best = written(best.withColumn("proven", F.lit(level == 0) | (F.col("best.distance") < beyond)), "nearest")
        sure = best.where("proven").select("target.*", "best.distance", "best.point")
        found = sure if found is None else found.unionByName(sure)
        if level == 0:
            return found
        asked = written(asked.join(best.where("proven").select("target"), "target", "left_anti"), "targets")
        if asked.isEmpty():
            return found
        level = max(0, level - 2)


def spanning(tracks: DataFrame, pairs: DataFrame, first: str, last: str, a: str, b: str, *, bucket: int = 64) -> DataFrame:
    """Tracks that reach from frame ``a`` to frame ``b``: first <= a and last >= b, by bucket of ``a``.

    A track is spread over the buckets it touches, a pair lies in one, so the
    join is an equality and only neighbours meet.
    """
    spread = tracks.withColumn("bucket", F.explode(F.sequence((F.col(first) / bucket).cast("bigint"), (F.col(last) / bucket).cast("bigint"))))
    placed = pairs.withColumn("bucket", (F.col(a) / bucket).cast("bigint"))
    return spread.join(placed, "bucket").where((F.col(first) <= F.col(a)) & (F.col(last) >= F.col(b))).drop("bucket")


def by_position(a: DataFrame, b: DataFrame, key: str, order: str, columns: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Rows of both sides that have the same place within their key; the longer side's rest is left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("place")
    left, right = (s.select(key, place, *[F.col(c).alias(f"{c}{x}") for c in columns]) for s, x in zip((a, b), suffixes, strict=True))
    return left.join(right, [key, "place"])
