"""Levelling checkpoints: (series_id, frame, pitch, roll, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recurrence import simplified
from .series import FRAME, ID, boxcar, extrema, leading_extrema, whole

#: Density names and what they stand for (fixed values): tolerance in degrees, seconds between checkpoints.
DENSITY = {"low": (3.0, 2.0), "medium": (1.5, 1.0), "high": (0.8, 0.5)}


def odd(n: int) -> int:
    return n + 1 if n % 2 == 0 else n


def cadence(totals: DataFrame, *, fps: float, interval: float = 0.5, most: int | None = None) -> DataFrame:
    """series_id, frame: a frame every ``interval`` seconds, and the last; wider apart where that gives more than ``most``."""
    last = F.col("total") - 1
    seconds = F.greatest(last, F.lit(1)) / max(0.1, fps)
    step = F.lit(max(0.05, interval))
    if most:
        step = F.when(F.ceil(seconds / step) + 1 > most, seconds / float(max(2, most - 1))).otherwise(step)
    frames = F.greatest(F.lit(1), F.rint(step * fps).cast("int")).cast("bigint")
    grid = F.when(last > 0, F.filter(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), frames), lambda f: f < last)).otherwise(F.array().cast("array<bigint>"))
    return totals.where("total > 0").select(ID, F.explode(F.concat(grid, F.array(last.cast("bigint")))).alias(FRAME))


def even_times(videos: DataFrame, n: int, key: str = ID) -> DataFrame:
    """key, place, time: n times that part each video's duration evenly, its ends left out."""
    places = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("place")
    return videos.select(key, "duration", places).select(key, "place", (F.col("place") * F.col("duration") / float(n + 1)).alias("time"))


def preferred(first: DataFrame, second: DataFrame, key: str = ID) -> DataFrame:
    """The first source's checkpoints of each series; those of the second where the first has none."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def by_density(df: DataFrame, density: str, *, fps: float) -> DataFrame:
    """series_id, frame: the rows that a polyline of the density's tolerance needs, and its cadence."""
    epsilon, interval = DENSITY[density]
    totals = df.groupBy(ID).agg((F.max(FRAME) + 1).alias("total"))
    return from_polyline(df, epsilon=epsilon).select(ID, FRAME).union(cadence(totals, fps=fps, interval=interval)).distinct()


def from_extrema(df: DataFrame, *, fps: float, prominence: float = 0.8, most: int | None = None, damping: float = 0.7, frames: tuple[int, int] | None = None) -> DataFrame:
    """Checkpoints at the crests and troughs of the smoothed pitch, and at both ends.

    With ``frames`` only extrema from the first to the last of these count.

    Pitch and damped roll are means over 0.2 and 0.6 seconds with nothing
    beyond the ends.  End rows have unsmoothed values and win over an extremum
    of the same frame at the end.
    """
    pitch_width = odd(max(3, min(15, round(fps * 0.2))))
    roll_width = odd(max(5, min(31, round(fps * 0.6))))
    ends = df.withColumn("last", F.max(FRAME).over(whole())).where((F.col(FRAME) == 0) | (F.col(FRAME) == F.col("last")))
    ends = ends.select(ID, FRAME, "pitch", (F.col("roll") * damping).alias("roll"), F.lit("boundary").alias("kind"), F.when(F.col(FRAME) > 0, 2).otherwise(0).alias("rank"))
    smooth = boxcar(boxcar(df, ["pitch"], pitch_width, "zero"), ["roll"], roll_width, "zero").withColumn("roll", F.col("roll") * damping)
    found = extrema(smooth, "pitch").where(F.col("prominence") >= max(0.2, prominence))
    if frames:
        found = found.where(F.col(FRAME).between(*frames))
    if most:
        found = leading_extrema(found, max(2, most - 2))
    every = ends.union(found.select(ID, FRAME, "pitch", "roll", "kind", F.lit(1).alias("rank")))
    best = every.groupBy(ID, FRAME).agg(F.max_by(F.struct("pitch", "roll", "kind"), "rank").alias("c"))
    return best.select(ID, FRAME, F.round(F.col(FRAME) / max(0.1, fps), 2).alias("time"), F.round("c.pitch", 2).alias("pitch"), F.round("c.roll", 2).alias("roll"), F.lit(0.0).alias("yaw"), "c.kind")


def from_polyline(df: DataFrame, *, epsilon: float, width: int = 15) -> DataFrame:
    """Counter-rotation around each series' median, smoothed, and cut down to the rows that a polyline needs."""
    middle = df.groupBy(ID).agg(*[F.percentile(a, F.lit(0.5)).alias(f"mid_{a}") for a in ("pitch", "roll")])
    level = df.join(middle, ID).select(ID, FRAME, *[(-(F.col(a) - F.col(f"mid_{a}"))).alias(a) for a in ("pitch", "roll")])
    rows = simplified(boxcar(level, ["pitch", "roll"], width, "zero"), epsilon)
    return rows.select(ID, FRAME, F.round("pitch", 2).alias("pitch"), F.round("roll", 2).alias("roll"))


def numbered(df: DataFrame) -> DataFrame:
    """Place of each checkpoint in its series, equal frames in the order they came in (column ``place``)."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(ID).orderBy(FRAME, "place")))
