"""GPS tracks: time grids, synchronisation, routes, dead reckoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, planar
from .joins import bracketed, interpolated
from .series import FRAME, ID, filled, ordered, so_far, whole


def seconds(keys: DataFrame, length: str, key: str = ID) -> DataFrame:
    """key, sec: every whole second from 0 to the length."""
    return keys.select(key, F.explode(F.sequence(F.lit(0), F.floor(length).cast("int"))).alias("sec"))


def synchronised(fixes: DataFrame, windows: DataFrame, *, key: str = ID, time: str = "sec") -> DataFrame:
    """key, sec, lat, lon, ele at 1 Hz over the window (key, start, length) of each track.

    Between two fixes positions are blended; before the first and after the
    last they stay.  With fewer than two timed fixes, fixes are spread evenly
    by their order, and not rounded.
    """
    timed = fixes.where(F.col(time).isNotNull())
    sized = fixes.groupBy(key).agg(F.count(time).alias("timed"))
    enough = sized.where("timed >= 2").select(key)
    grid = windows.join(enough, key, "left_semi").select(key, "start", F.explode(F.sequence(F.lit(0), F.col("length").cast("int"))).alias("s")).select(key, (F.col("start") + F.col("s")).alias(time), "s")
    exact = interpolated(timed.select(key, time, FRAME, "lat", "lon", "ele"), grid, key, time, ("lat", "lon", "ele"), order=FRAME)
    exact = exact.select(key, F.col("s").cast("int").alias("sec"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("ele", 3).alias("ele"))
    few = fixes.join(sized.where("timed < 2").select(key), key, "left_semi")
    order = Window.partitionBy(key).orderBy(FRAME)
    placed = few.select(key, "lat", "lon", "ele", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    spread = windows.join(placed.select(key, "n").distinct(), key).select(key, F.explode(F.sequence(F.lit(0), F.col("length").cast("int"))).alias("sec"), "length", "n")
    spread = spread.withColumn("place", F.when(F.col("length") > 0, F.least(F.floor(F.col("sec") / F.col("length") * (F.col("n") - 1)), F.col("n") - 1)).otherwise(0))
    loose = spread.join(placed.drop("n"), [key, "place"]).select(key, "sec", "lat", "lon", "ele")
    return exact.union(loose)


def route(points: DataFrame, lengths: DataFrame, *, key: str = ID) -> DataFrame:
    """key, sec, lat, lon, ele at 1 Hz along checkpoints (key, frame, lat, lon, ele, time).

    Where a key lacks any time, times follow from the share of the way on the
    plane, or from the checkpoints' order if the way is nothing.  Missing
    elevations are those of the checkpoint before.  ``lengths`` is key, length.
    """
    w = Window.partitionBy(key).orderBy(FRAME)
    step = F.coalesce(planar(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    every = Window.partitionBy(key)
    p = points.join(lengths, key).withColumns({"step": step, "ele": filled(F.col("ele"), 315.0)})
    p = p.withColumns({"way": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("step").over(every), "n": F.count(F.lit(1)).over(every), "place": F.row_number().over(w) - 1, "given": F.count("time").over(every)})
    share = F.when(F.col("total") > 0, F.col("way") / F.col("total")).otherwise(F.col("place") / F.greatest(F.col("n") - 1, F.lit(1)))
    p = p.withColumn("t", F.when(F.col("given") == F.col("n"), F.col("time")).otherwise(share * F.col("length")))
    grid = seconds(lengths, "length", key).withColumn("t", F.col("sec").cast("double"))
    out = interpolated(p.select(key, "t", FRAME, "lat", "lon", "ele"), grid, key, "t", ("lat", "lon", "ele"), order=FRAME)
    return out.select(key, "sec", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("ele", 3).alias("ele"))


def times_by_distance(length: Column) -> tuple[Column, Column]:
    """The way over the ground from the row before, to be kept as ``step``, and times by the share of all steps."""
    w = ordered()
    step = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    way, total = F.sum("step").over(so_far()), F.sum("step").over(whole())
    return step, F.when(total > 0, way / total * length).otherwise(0.0)


def dead_reckoning(df: DataFrame, *, heading: str, speed: float, dt: float, lat: float, lon: float) -> DataFrame:
    """Position at each row of a walk at one speed: north and east metres from the first row, lat, lon."""
    h, first = F.radians(heading), F.lag(heading).over(ordered()).isNull()
    step = df.withColumns({"north": F.when(first, 0.0).otherwise(F.cos(h) * speed * dt), "east": F.when(first, 0.0).otherwise(F.sin(h) * speed * dt)})
    moved = step.withColumns({c: F.sum(c).over(so_far()) for c in ("north", "east")})
    metres = 111320.0
    return moved.withColumns({"lat": lat + F.col("north") / metres, "lon": lon + F.col("east") / (metres * F.cos(F.radians(F.lit(lat))))})


def resampled(df: DataFrame, rate: float, columns: list[str], *, time: str = "t") -> DataFrame:
    """Series at a fixed rate from its first to its last time."""
    span = df.groupBy(ID).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    steps = F.floor((F.col("t1") - F.col("t0")) * rate + 1e-9).cast("int")
    grid = span.select(ID, "t0", F.explode(F.sequence(F.lit(0), steps)).alias(FRAME)).select(ID, F.col(FRAME).cast("bigint").alias(FRAME), (F.col("t0") + F.col(FRAME) / rate).alias(time))
    return interpolated(df.select(ID, time, *columns), grid, ID, time, columns)


__all__ = ["bracketed", "dead_reckoning", "resampled", "route", "seconds", "synchronised", "times_by_distance"]


#: Exports shorter than the first are padded to the second, in seconds (fixed values).
SHORTEST, PADDED = 120.0, 126.0


def export_windows(videos: DataFrame, fixes: DataFrame, *, key: str = ID, time: str = "sec") -> DataFrame:
    """key, start, length, padded: which part of its track each video gets.

    ``videos`` has key, duration, start, lat, lon and shift.  Of these, lat and
    lon, where given, choose the nearest fix as the start, the first of equally
    near ones; a start that is not given, or lies outside the track, is the
    track's first time.  The shift in seconds is added.  Short videos are padded.
    """
    near = F.min_by(time, F.struct(haversine(F.col("v_lat"), F.col("v_lon"), F.col("lat"), F.col("lon")), FRAME))
    asked = videos.select(key, F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    spans = fixes.join(asked, key).groupBy(key).agg(F.min(time).alias("low"), F.max(time).alias("high"), near.alias("near"))
    inside = F.col("start").between(F.col("low"), F.col("high"))
    start = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("near")).when(inside, F.col("start")).otherwise(F.col("low"))
    padded = F.col("duration") < SHORTEST
    length = F.floor(F.when(padded, PADDED).otherwise(F.col("duration"))).cast("int")
    return videos.join(spans, key).select(key, (start + F.col("shift")).alias("start"), length.alias("length"), padded.alias("padded"))


def exported(videos: DataFrame, fixes: DataFrame, *, key: str = ID, smooth: bool = True) -> DataFrame:
    """key, sec, lat, lon, ele: the track of each video at 1 Hz, padding included, smoothed with its ends in place."""
    windows = export_windows(videos, fixes, key=key)
    points = synchronised(fixes, windows.select(key, "start", "length"), key=key)
    if not smooth:
        return points
    from .series import pinned_smooth

    rows = pinned_smooth(points.select(F.col(key).alias(ID), F.col("sec").alias(FRAME), "lat", "lon", "ele"), {"lat": 8, "lon": 8, "ele": 3})
    return rows.select(F.col(ID).alias(key), F.col(FRAME).alias("sec"), "lat", "lon", "ele")
