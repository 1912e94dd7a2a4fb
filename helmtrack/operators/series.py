"""Operators on ordered series.

Every operator takes rows (series_id, frame, ...) with consecutive frames from
0 and partitions by series_id, so one shuffle serves a whole chain of them.
The five paddings give different edges and are never mixed up:

edge     the first and last value go on
reflect  mirrored, the edge itself not repeated
zero     nothing beyond the ends; sums are still divided by the whole width
shrink   the window is cut at the ends
pinned   end values stay as they are
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.angles import triple_distance, wrap180, wrapped_difference

ID, FRAME = "series_id", "frame"


def ordered() -> WindowSpec:
    return Window.partitionBy(ID).orderBy(FRAME)


def whole() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def shifted(x: Column, by: int) -> Column:
    """Value ``by`` rows on; beyond an end, the end's value."""
    w = ordered()
    if by == 0:
        return x
    return F.coalesce(F.lag(x, -by).over(w), F.first(x).over(whole())) if by < 0 else F.coalesce(F.lead(x, by).over(w), F.last(x).over(whole()))


def difference(x: Column, wrapped: bool = False) -> Column:
    """From the row before; null in the first row."""
    before = F.lag(x).over(ordered())
    return wrapped_difference(x, before) if wrapped else x - before


def wrapped_rate(x: Column, t: Column) -> Column:
    """Change by the shortest way over elapsed time; 0 in the first row and where no time has passed."""
    dt = difference(t)
    return F.when(dt > 0, difference(x, wrapped=True) / dt).otherwise(0.0)


def plain_rate(x: Column, fps: float) -> Column:
    """Change by rows times the row rate; the first row has the second one's."""
    rate = difference(x) * fps
    return F.coalesce(rate, F.lead(rate).over(ordered()), F.lit(0.0))


def integral(rate: Column, t: Column, least: float = 1e-4) -> Column:
    """Running sum of rate times elapsed time, each step of at least ``least`` seconds; the first row is 0."""
    step = difference(t)
    return F.sum(F.when(step.isNull(), 0.0).otherwise(rate * F.greatest(step, F.lit(least)))).over(so_far())


def running_sum(x: Column) -> Column:
    return F.sum(x).over(so_far())


def unwrapped(x: Column) -> Column:
    """Angles without jumps: steps of half a turn or more go the short way; a half turn keeps its direction."""
    d = difference(x)
    short = wrap180(d)
    short = F.when((short == -180.0) & (d > 0), 180.0).otherwise(short)
    return F.first(x).over(whole()) + F.sum(F.coalesce(F.when(F.abs(d) < 180.0, d).otherwise(short), F.lit(0.0))).over(so_far())


def median5(x: Column) -> Column:
    """Median of five, edge padding."""
    return F.sort_array(F.array(*(shifted(x, k) for k in (-2, -1, 0, 1, 2))))[2]


def median3(x: Column) -> Column:
    """Median of three; both end values stay."""
    a, b = F.lag(x).over(ordered()), F.lead(x).over(ordered())
    return F.when(a.isNull() | b.isNull(), x).otherwise(F.sort_array(F.array(a, x, b))[1])


def padded(df: DataFrame, radius: int, mode: str) -> DataFrame:
    """Adds ``radius`` rows at both ends of every series; they have frames below 0 and from the length on.

    Each row makes its own copies, so nothing is joined.  Column ``rows`` is
    the series' length.  Reflecting needs series longer than the radius.
    """
    n = F.col("rows")
    sized = df.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(ID)).cast("int"))
    f = F.col(FRAME)
    none = F.array().cast("array<bigint>")
    if mode == "edge":
        before = F.when(f == 0, F.sequence(F.lit(-radius).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(none)
        after = F.when(f == n - 1, F.sequence(n.cast("bigint"), (n + radius - 1).cast("bigint"))).otherwise(none)
    elif mode == "reflect":
        before = F.when(f.between(1, radius), F.array((-f).cast("bigint"))).otherwise(none)
        after = F.when(f.between(n - 1 - radius, n - 2), F.array((2 * (n - 1) - f).cast("bigint"))).otherwise(none)
    else:
        raise ValueError(mode)
    places = F.concat(F.array(f.cast("bigint")), before, after)
    others = [c for c in sized.columns if c != FRAME]
    return sized.select(F.explode(places).alias(FRAME), *others)


def convolved(df: DataFrame, columns: Sequence[str], kernel: Sequence[float], mode: str, left: int | None = None) -> DataFrame:
    """Weighted sums of windows that begin ``left`` rows before (the middle unless given)."""
    left = len(kernel) // 2 if left is None else left
    right = len(kernel) - 1 - left
    weights = F.array(*(F.lit(float(k)) for k in kernel))
    w = ordered().rowsBetween(-left, right)
    out = padded(df, max(left, right, 1), mode)
    for c in columns:
        out = out.withColumn(f"{c}_all", F.collect_list(c).over(w))
    for c in columns:
        out = out.withColumn(c, F.aggregate(F.zip_with(f"{c}_all", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).drop(f"{c}_all")
    return out.where(F.col(FRAME).between(0, F.col("rows") - 1)).drop("rows")


def gaussian(sigma: float) -> list[float]:
    r = math.ceil(3 * sigma)
    k = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    total = math.fsum(k)
    return [v / total for v in k]


def gaussian_smooth(df: DataFrame, columns: Sequence[str], sigma: float, mode: str = "reflect") -> DataFrame:
    return convolved(df, columns, gaussian(max(1.0, sigma) if mode == "edge" else sigma), mode)


def boxcar(df: DataFrame, columns: Sequence[str], width: int, mode: str) -> DataFrame:
    """Means of windows of ``width`` rows; an even window reaches further back."""
    if mode == "zero":
        left = width // 2
        w = ordered().rowsBetween(-left, width - 1 - left)
        return df.select(*[(F.sum(c).over(w) / float(width)).alias(c) if c in columns else F.col(c) for c in df.columns])
    return convolved(df, columns, [1.0 / width] * width, mode, left=width // 2)


def shrinking_mean(x: Column, half: int) -> Column:
    return F.avg(x).over(ordered().rowsBetween(-half, half))


def pinned_smooth(df: DataFrame, columns: dict[str, int], passes: int = 2) -> DataFrame:
    """Quarter, half, quarter; end values stay; rounded to the given decimals after every pass."""
    for _ in range(max(1, passes)):
        w = ordered()
        new = {}
        for c, decimals in columns.items():
            a, b = F.lag(c).over(w), F.lead(c).over(w)
            new[c] = F.when(a.isNull() | b.isNull(), F.col(c)).otherwise(F.round(0.25 * a + 0.5 * F.col(c) + 0.25 * b, decimals))
        df = df.withColumns(new)
    return df


def bilateral_circular(df: DataFrame, columns: Sequence[str], width: int, spread: float = 2.5) -> DataFrame:
    """Circular mean weighted by distance in time and in angle; edge padding."""
    sigma = max(1.0, width / 4.0)
    r = int(2.5 * sigma)
    kernel = F.array(*(F.lit(math.exp(-0.5 * (x / sigma) ** 2)) for x in range(-r, r + 1)))
    w = ordered().rowsBetween(-r, r)
    out = padded(df, r, "edge")
    for c in columns:
        out = out.withColumn(f"{c}_all", F.collect_list(c).over(w))
    out = out.withColumns({f"{c}_new": _weighted_direction(F.col(f"{c}_all"), F.col(c), kernel, spread) for c in columns})
    out = out.where(F.col(FRAME).between(0, F.col("rows") - 1))
    return out.select(*[F.col(f"{c}_new").alias(c) if c in columns else F.col(c) for c in df.columns])


def _weighted_direction(near: Column, x: Column, kernel: Column, spread: float) -> Column:
    away = lambda v: wrap180(v - x) / spread
    weight = F.zip_with(near, kernel, lambda v, k: k * F.exp(-0.5 * away(v) * away(v)))
    total = lambda part: F.aggregate(F.zip_with(near, weight, lambda v, k: part(F.radians(v)) * k), F.lit(0.0), lambda s, v: s + v)
    return F.degrees(F.atan2(total(F.sin), total(F.cos)))


def extrema(df: DataFrame, value: str) -> DataFrame:
    """Local extrema of a series: kind (crest or trough) and prominence.

    An extremum is where the first difference changes its sign.  Its prominence
    is the smaller gap to the nearest extremum of the other kind on either
    side, or to the series' end where there is none.
    """
    w, x = ordered(), F.col(value)
    before, after = x - F.lag(x).over(w), F.lead(x).over(w) - x
    kind = F.when((before > 0) & (after <= 0), "crest").when((before < 0) & (after >= 0), "trough")
    marked = df.withColumns({"kind": kind, "start_value": F.first(x).over(whole()), "end_value": F.last(x).over(whole())}).where("kind is not null")
    value_of = lambda k: F.when(F.col("kind") == k, x)
    back = ordered().rowsBetween(Window.unboundedPreceding, -1)
    forth = Window.partitionBy(ID).orderBy(F.desc(FRAME)).rowsBetween(Window.unboundedPreceding, -1)
    other = lambda f, span: F.when(F.col("kind") == "crest", f(value_of("trough"), ignorenulls=True).over(span)).otherwise(f(value_of("crest"), ignorenulls=True).over(span))
    left = F.abs(x - F.coalesce(other(F.last, back), F.col("start_value")))
    right = F.abs(x - F.coalesce(other(F.last, forth), F.col("end_value")))
    return marked.withColumn("prominence", F.least(left, right)).drop("start_value", "end_value")


def level_shift(df: DataFrame, angles: Sequence[str], last_frame: int, *, jump: float = 12.0, settle: float = 2.5, span: int = 8) -> DataFrame:
    """First persistent step of each series (series_id, frame, angle); series without one have no row.

    A step is a jump of at least ``jump`` degrees that settles at once, after a
    calm stretch, moves the mean by 65 percent of the jump, and isn't undone
    within the ``span`` rows that follow.
    """
    w = ordered()
    now = [F.col(a) for a in angles]
    step = triple_distance(now, [F.lag(x).over(w) for x in now])
    base = df.withColumn("step", step)
    pre, post = w.rowsBetween(-span, -1), w.rowsBetween(0, span - 1)
    mean_pre = [F.avg(x).over(pre) for x in now]
    mean_post = [F.avg(x).over(post) for x in now]
    after = F.collect_list(F.struct(*now)).over(post)
    seen = base.withColumns({
        "next_step": F.lead("step").over(w), "calm": F.avg("step").over(w.rowsBetween(-(span - 1), -1)), "left": F.count(F.lit(1)).over(pre), "right": F.count(F.lit(1)).over(post),
        "length": F.count(F.lit(1)).over(whole()), "pre": F.struct(*(m.alias(a) for m, a in zip(mean_pre, angles, strict=True))), "post": F.struct(*(m.alias(a) for m, a in zip(mean_post, angles, strict=True))), "after": after,
    })
    pre_of, post_of = [F.col("pre")[a] for a in angles], [F.col("post")[a] for a in angles]
    back = F.exists("after", lambda s: triple_distance([s[a] for a in angles], pre_of) < F.col("step") * 0.5)
    hit = (
        (F.col(FRAME) >= 1) & (F.col(FRAME) < F.least(F.lit(last_frame), F.col("length") - 4)) & (F.col("step") >= jump)
        & (F.col("next_step") <= settle) & (F.col("next_step") <= F.col("step") * 0.3) & (F.col("left") >= 2) & (F.col("right") >= 2)
        & (F.coalesce("calm", F.lit(0.0)) <= F.col("step") * 0.25) & (triple_distance(pre_of, post_of) >= F.col("step") * 0.65) & ~back
    )
    first = seen.where(hit).groupBy(ID).agg(F.min_by("step", FRAME).alias("angle"), F.min(FRAME).alias(FRAME))
    return first.select(ID, FRAME, "angle")


def static_prefix(df: DataFrame, angles: Sequence[str], within: float = 1e-4) -> DataFrame:
    """Length of the stretch at each series' start that stays at its first values."""
    moved = F.lit(False)
    for a in angles:
        moved = moved | (F.abs(F.col(a) - F.first(a).over(whole())) >= within)
    marked = df.select(ID, FRAME, moved.alias("moved"))
    return marked.groupBy(ID).agg(F.coalesce(F.min(F.when(F.col("moved"), F.col(FRAME))), F.count(F.lit(1))).cast("bigint").alias("static_frames"))


def turns(heading: Column, threshold: float = 8.0) -> Column:
    """Where the change over the two rows before differs from that over the two rows after."""
    w = ordered()
    return F.abs((heading - F.lag(heading, 2).over(w)) - (F.lead(heading, 2).over(w) - heading)) > threshold


def gradient(x: Column, t: Column) -> Column:
    """Central differences on uneven times, one-sided at both ends."""
    w = ordered()
    a, b = F.lag(x).over(w), F.lead(x).over(w)
    h1, h2 = t - F.lag(t).over(w), F.lead(t).over(w) - t
    inner = (h1 * h1 * b + (h2 * h2 - h1 * h1) * x - h2 * h2 * a) / (h1 * h2 * (h1 + h2))
    return F.when(a.isNull(), (b - x) / h2).when(b.isNull(), (x - a) / h1).otherwise(inner)


def hemisphere_sign(dot_with_previous: Column) -> Column:
    """1 or -1 for each row, so that neighbouring quaternions lie on one side."""
    flips = F.sum(F.when(dot_with_previous < 0, 1).otherwise(0)).over(so_far())
    return F.when(flips % 2 == 1, -1.0).otherwise(1.0)


def filled(x: Column, default: float) -> Column:
    """Last known value, else the first known one, else the default."""
    return F.coalesce(F.last(x, ignorenulls=True).over(so_far()), F.first(x, ignorenulls=True).over(whole()), F.lit(default))


def leading_extrema(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` most prominent extrema of each series, ties to the earlier frame."""
    best = Window.partitionBy(ID).orderBy(F.desc("prominence"), FRAME)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).drop("place")
