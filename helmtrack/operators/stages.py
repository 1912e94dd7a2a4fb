"""Rotation stages: ordered command series that are composed, measured and rendered.

A stage's commands are rows (series_id, t, yaw, pitch, roll).  Stages don't
commute: they are multiplied from left to right in the order given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rotation as ro
from ..functions.angles import wrap180, wrap180_closed
from ..storage import dealt
from .recurrence import Deadband, Despike, Slew, fuse, scan, with_next
from .series import FRAME, ID, bilateral_circular, boxcar, median5, ordered, plain_rate, unwrapped

Stage = Callable[[DataFrame], DataFrame]
AXES = ("yaw", "pitch", "roll")
#: A stage that never turns further than this many degrees does nothing.
STILL = 0.015


def chain(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    for stage in stages:
        df = stage(df)
    return df


def is_identity(commands: DataFrame) -> DataFrame:
    """series_id, still: whether no command turns further than STILL."""
    return commands.groupBy(ID).agg((F.max(F.greatest(*[F.abs(a) for a in AXES])) < STILL).alias("still"))


def compose(stages: Sequence[DataFrame], *, delta: bool = False) -> DataFrame:
    """series_id, frame, t, yaw, pitch, roll: all stages as one.

    Per series, stages that stand still are left out, the longest stage (the
    first of equally long ones) gives the times, the others are interpolated,
    and matrices are multiplied in order.  With ``delta`` rows are wrapped
    changes.  All stages are read in one shuffle by series.
    """
    point = F.struct("t", *AXES)
    rows = [s.select(ID, F.col("t").cast("double").alias("t"), *AXES).withColumns({"stage": F.lit(k), "point": point}) for k, s in enumerate(stages)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    stage, series = Window.partitionBy(ID, "stage"), Window.partitionBy(ID)  # the exchange by series serves both
    sized = dealt(every, ID).withColumns({"n": F.count(F.lit(1)).over(stage), "most": F.max(F.greatest(*[F.abs(a) for a in AXES])).over(stage)})
    known = sized.withColumns({"grid": F.max_by("stage", F.struct("n", -F.col("stage"))).over(series), "active": F.collect_set(F.when(F.col("most") >= STILL, F.col("stage"))).over(series)})
    marked = known.withColumn("active", F.when(F.size("active") == 0, F.array("grid")).otherwise(F.col("active"))).drop("n", "most")
    back = Window.partitionBy(ID).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forth = Window.partitionBy(ID).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine = lambda k: F.when(F.col("stage") == k, F.col("point"))
    near = {f"a{k}": F.last(mine(k), ignorenulls=True).over(back) for k in range(len(stages))} | {f"b{k}": F.last(mine(k), ignorenulls=True).over(forth) for k in range(len(stages))}
    grid = marked.withColumns(near).where("stage = grid")
    total: list[Column] = [F.lit(float(i % 4 == 0)) for i in range(9)]
    for k in range(len(stages)):
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        span = b["t"] - a["t"]
        part = F.when(F.abs(span) < 1e-9, 0.0).otherwise((F.col("t") - a["t"]) / span)
        angle = [F.when(a.isNull(), b[x]).when(b.isNull(), a[x]).otherwise(a[x] + part * (b[x] - a[x])) for x in AXES]
        on = F.array_contains("active", k) & (a.isNotNull() | b.isNotNull())
        grid = grid.withColumns({f"on{k}": on} | {f"{x}{k}": F.when(on, v).otherwise(0.0) for x, v in zip(AXES, angle, strict=True)})
        grid = grid.withColumns({f"r{k}_{i}": v for i, v in enumerate(ro.matrix(*[F.col(f"{x}{k}") for x in AXES]))})
        step = ro.product(total, [F.col(f"r{k}_{i}") for i in range(9)])
        grid = grid.withColumns({f"m{k}_{i}": F.when(F.col(f"on{k}"), v).otherwise(total[i]) for i, v in enumerate(step)})
        total = [F.col(f"m{k}_{i}") for i in range(9)]
    out = grid.select(ID, "t", *[wrap180_closed(v).alias(x) for v, x in zip(ro.euler(total), AXES, strict=True)])
    order = Window.partitionBy(ID).orderBy("t")
    out = out.withColumn(FRAME, (F.row_number().over(order) - 1).cast("bigint"))
    if delta:
        out = out.withColumns({x: wrap180_closed(F.col(x) - F.coalesce(F.lag(x).over(order), F.lit(0.0))) for x in AXES})
    return out.select(ID, FRAME, "t", *AXES)


def prior(stages: Sequence[DataFrame]) -> DataFrame:
    """series_id, frame, t, yaw, pitch, roll: what all stages before have done to a series.

    A lone stage that moves is passed as it is, several are composed; a series
    whose stages all stand still has no prior and no row.
    """
    moving = [is_identity(s).where(~F.col("still")).select(ID, F.lit(k).alias("stage")) for k, s in enumerate(stages)]
    every = moving[0]
    for m in moving[1:]:
        every = every.unionByName(m)
    counted = every.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.min("stage").alias("lone"))
    order = Window.partitionBy(ID).orderBy("t")
    out = compose([s.join(counted.where("n > 1").select(ID), ID, "left_semi") for s in stages])
    for k, s in enumerate(stages):
        alone = s.join(counted.where((F.col("n") == 1) & (F.col("lone") == k)).select(ID), ID, "left_semi")
        out = out.unionByName(alone.select(ID, (F.row_number().over(order) - 1).cast("bigint").alias(FRAME), F.col("t").cast("double").alias("t"), *AXES))
    return out


def deltas(df: DataFrame, *, negated: bool = False, wrapped: bool = False) -> DataFrame:
    """Absolute angles as changes, the first from 0; direction stages write them wrapped and negated."""
    w = ordered()

    def one(x: str) -> Column:
        d = F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))
        d = wrap180(d) if wrapped else d
        return -d if negated else d

    return df.withColumns({x: one(x) for x in AXES})


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns one trajectory into another: series_id, frame, yaw, pitch, roll of transposed(before) * after."""
    a = before.select(ID, FRAME, *[v.alias(f"a{i}") for i, v in enumerate(ro.matrix(*[F.col(x) for x in AXES]))])
    b = after.select(ID, FRAME, *[v.alias(f"b{i}") for i, v in enumerate(ro.matrix(*[F.col(x) for x in AXES]))])
    m = ro.product(ro.transposed([F.col(f"a{i}") for i in range(9)]), [F.col(f"b{i}") for i in range(9)])
    both = a.join(b, [ID, FRAME]).select(ID, FRAME, *[v.alias(f"m{i}") for i, v in enumerate(m)])
    return both.select(ID, FRAME, *[v.alias(x) for v, x in zip(ro.euler([F.col(f"m{i}") for i in range(9)]), AXES, strict=True)])


def telemetry(df: DataFrame, *, mode: str = "level", fps: float = 30.0, smoothing: int = 30, reference: int = 0, multiplier: tuple[float, float] = (1.0, 1.0), fusion: str | None = None, gain: float = 0.5, slew: float = 2.5) -> DataFrame:
    """The telemetry stage: counter-rotation of roll and pitch (yaw stays 0), as changes by frame.

    Spikes are removed by a median of five and then row by row; the target is
    the series' mean (level), nothing (zero), a smooth course (smooth) or the
    reference frame's orientation (lock); the correction changes by at most
    ``slew`` a frame.
    """
    clean = df.select(ID, FRAME, *[median5(F.col(a)).alias(a) for a in ("roll", "pitch", "yaw")])
    clean = scan(clean, with_next(("roll", "pitch", "yaw")), ("roll", "pitch", "yaw"), Despike(3))
    if fusion:
        from ..functions.angles import gravity_camera

        force = gravity_camera(F.col("roll"), F.col("pitch"))
        rates = [plain_rate(F.col(a), fps).alias(g) for a, g in (("roll", "gx"), ("pitch", "gy"), ("yaw", "gz"))]
        clean = fuse(clean.select(ID, FRAME, *rates, *[v.alias(n) for v, n in zip(force, ("ax", "ay", "az"), strict=True)]), method=fusion, gain=gain, fps=fps)
    every = Window.partitionBy(ID)
    last = F.max(FRAME).over(every)
    if mode == "smooth":
        smooth = bilateral_circular(clean, ["roll", "pitch"], smoothing).select(ID, FRAME, F.col("roll").alias("to_roll"), F.col("pitch").alias("to_pitch"))
        aimed = clean.join(smooth, [ID, FRAME])
    else:
        at = F.least(F.lit(reference), last)
        target = {"level": lambda a: F.avg(a).over(every), "zero": lambda a: F.lit(0.0), "lock": lambda a: F.max(F.when(F.col(FRAME) == F.col("at"), F.col(a))).over(every)}[mode]
        aimed = clean.withColumn("at", at).withColumns({f"to_{a}": target(a) for a in ("roll", "pitch")})
    raw = aimed.select(ID, FRAME, *[((F.col(a) - F.col(f"to_{a}")) * m).alias(a) for a, m in zip(("roll", "pitch"), multiplier, strict=True)])
    limited = scan(raw, ("roll", "pitch"), ("roll", "pitch"), Slew(2, slew))
    half = 1.0 / fps
    start = F.when(F.col(FRAME) == 0, 0.0).otherwise((F.col(FRAME) - 0.5) * half)
    out = deltas(limited.withColumn("yaw", F.lit(0.0)), negated=True)
    return out.select(ID, FRAME, start.alias("t_start"), ((F.col(FRAME) + 0.5) * half).alias("t_end"), *AXES)


def travel_direction(df: DataFrame, *, mode: str = "travel_direction", target: float = 0.0, damping: float = 0.9, deadband: float = 1.5, width: int = 59) -> DataFrame:
    """Steers yaw along the way travelled, to a target, or after a damped follower: raw, trend, steer and locked yaw.

    The steering is the wrapped correction; pitch and roll are left alone.
    """
    raw = df.select(ID, FRAME, unwrapped(F.col("yaw")).alias("raw_yaw"))
    if mode == "target_lock":
        aimed = raw.withColumn("trend_yaw", F.lit(float(target)))
    elif mode == "damped_follow":
        first = F.first("raw_yaw").over(ordered())
        aimed = raw.withColumn("gap", F.col("raw_yaw") - first)
        follow = scan(aimed, ("gap",), ("trend",), Deadband(damping=damping, deadband=deadband))
        out = aimed.withColumn("base", first).join(follow, [ID, FRAME])
        out = out.withColumn("trend_yaw", F.col("base") + F.col("trend")).withColumn("steer", F.col("trend_yaw") - F.col("raw_yaw"))
        return out.select(ID, FRAME, "raw_yaw", "trend_yaw", wrap180(F.col("steer")).alias("steer"), (F.col("raw_yaw") + F.col("steer")).alias("locked_yaw"))
    else:
        aimed = boxcar(raw.withColumn("trend_yaw", F.col("raw_yaw")), ["trend_yaw"], width, "edge")
    wanted = aimed.withColumn("wanted", F.col("trend_yaw") - F.col("raw_yaw"))
    steer = scan(wanted, ("wanted",), ("steer",), Deadband(damping=damping, deadband=deadband))
    return wanted.join(steer, [ID, FRAME]).select(ID, FRAME, "raw_yaw", "trend_yaw", wrap180(F.col("steer")).alias("steer"), (F.col("raw_yaw") + F.col("steer")).alias("locked_yaw"))


#: Names that mean the same stage (fixed values).
ALIASES = {"horizon": "horizon", "checkpoints": "horizon", "kopf": "kopf", "kopf3d2d": "kopf", "l1_norm": "cinematic", "l1norm": "cinematic", "l1": "cinematic", "cinematic": "cinematic", "direction": "traveldir", "dir_lock": "traveldir", "subject_lock": "traveldir", "traveldir": "traveldir", "telemetry": "telemetry", "kabsch": "kabsch", "vidstab": "vidstab"}


def stage_name(requested: Column) -> Column:
    """The stage of a requested name; null for names that mean none."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(names, requested)


def normalised_list(requests: DataFrame, *, job: str = "job", place: str = "place", name: str = "name", applied: str | None = None) -> DataFrame:
    """job, place, stage: each stage once, where it is first asked for, without those the input has already."""
    known = requests.select(job, place, stage_name(F.col(name)).alias("stage"), *([applied] if applied else [])).where("stage is not null")
    first = known.groupBy(job, "stage").agg(F.min(place).alias(place), *([F.max(applied).alias(applied)] if applied else []))
    if applied:
        first = first.where(~F.coalesce(F.col(applied), F.lit(False)))
    return first.select(job, (F.row_number().over(Window.partitionBy(job).orderBy(place))).cast("bigint").alias(place), "stage")


def order_conflicts(stages: DataFrame, *, job: str = "job", place: str = "place") -> DataFrame:
    """Jobs that level the horizon before they use telemetry."""
    at = lambda s: F.min(F.when(F.col("stage") == s, F.col(place)))
    return stages.groupBy(job).agg(at("horizon").alias("horizon"), at("telemetry").alias("telemetry")).where("horizon < telemetry")
