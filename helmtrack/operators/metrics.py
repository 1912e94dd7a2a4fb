"""Scores of motion: one row a series, from partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import FRAME, ID, ordered

#: Pixels of a degree in a view 1280 pixels wide and 90 degrees across.
PX_PER_DEGREE = 1280.0 / 90.0
#: The horizon report's own measure.
SLANT_PX = 12.0
AXES = ("roll", "pitch", "yaw")


def length(columns: list[Column]) -> Column:
    return F.sqrt(sum((c * c for c in columns[1:]), columns[0] * columns[0]))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def correction_size(df: DataFrame) -> DataFrame:
    """RMS and peak of the correction's length, and its largest axis (ties: pitch, roll, yaw)."""
    g = df.withColumn("m", length([F.col(a) for a in AXES])).groupBy(ID).agg(rms(F.col("m")).alias("rms_deg"), F.max("m").alias("peak_deg"), *[F.max(F.abs(a)).alias(f"max_{a}") for a in AXES])
    r, p, y = F.col("max_roll"), F.col("max_pitch"), F.col("max_yaw")
    dominant = F.when((p >= r) & (p >= y), "Pitch").when(r >= y, "Roll").otherwise("Yaw")
    return g.withColumns({"rms_px": F.col("rms_deg") * PX_PER_DEGREE, "peak_px": F.col("peak_deg") * PX_PER_DEGREE, "dominant": dominant})


def jerk(df: DataFrame) -> DataFrame:
    """RMS and peak of the second and third differences; 0 for series too short to have any."""
    w = ordered()
    at = lambda c, k: F.lag(c, k).over(w)
    acc = length([F.col(c) - 2 * at(c, 1) + at(c, 2) for c in AXES])
    third = length([F.col(c) - 3 * at(c, 1) + 3 * at(c, 2) - at(c, 3) for c in AXES])
    rows = df.select(ID, acc.alias("a"), third.alias("j"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(ID).agg(zero(rms(F.col("a"))).alias("rms_acc"), zero(F.max("a")).alias("max_acc"), zero(rms(F.col("j"))).alias("rms_jerk"), zero(F.max("j")).alias("max_jerk"))


#: Half widths that a series can have: a quarter of its rows, 3 to 15, cut in half.
HALVES = range(8)


def energy_bands(df: DataFrame) -> DataFrame:
    """Tremor around and drift of a moving mean whose width follows the series' length."""
    n = F.count(F.lit(1)).over(Window.partitionBy(ID))
    half = F.when(n >= 4, F.floor(F.least(F.lit(15), F.greatest(F.lit(3), F.floor(n / 4))) / 2)).otherwise(0)
    rows = df.select(ID, FRAME, *AXES, half.cast("int").alias("half"))

    def slow(c: str) -> Column:
        value = F.lit(None).cast("double")
        for h in HALVES:
            value = F.when(F.col("half") == h, F.avg(c).over(ordered().rowsBetween(-h, h))).otherwise(value)
        return value

    rows = rows.withColumns({f"low_{c}": slow(c) for c in AXES})
    high = length([F.col(c) - F.col(f"low_{c}") for c in AXES])
    low = length([F.col(f"low_{c}") for c in AXES])
    g = rows.select(ID, high.alias("h"), low.alias("l"), length([F.col(c) for c in AXES]).alias("m")).groupBy(ID).agg(rms(F.col("h")).alias("rms_hf"), rms(F.col("l")).alias("rms_lf"), F.sum(F.col("h") * F.col("h")).alias("he"), F.sum(F.col("l") * F.col("l")).alias("le"), F.max("m").alias("peak"))
    total = F.col("he") + F.col("le")
    share = F.when(total > 1e-9, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("he") / total * 100.0))).otherwise(0.0)
    grade = F.when(F.col("rms_hf") < 0.1, "EXCELLENT").when(F.col("rms_hf") < 0.25, "GOOD").when(F.col("peak") > 0.5, "EFFECTIVE").otherwise("MODERATE")
    return g.withColumns({"absorbed_pct": share, "grade": grade})


def reduction(before: str, after: str) -> Column:
    b, a = F.col(before), F.col(after)
    return F.when(b > 0, (b - a) / b * 100.0).otherwise(0.0)


def stabilisation(df: DataFrame, half: int = 15) -> DataFrame:
    """Reductions in percent between the shifts (raw_x, raw_y) and (stab_x, stab_y), and the verdict.

    The peak is the 99th percentile; jitter is what a moving mean leaves.
    """
    near = ordered().rowsBetween(-half, half)
    few = F.count(F.lit(1)).over(Window.partitionBy(ID)) < 4
    m = df.select(ID, FRAME, *[F.abs(c).alias(c) for c in ("raw_x", "raw_y", "stab_x", "stab_y")], length([F.col("raw_x"), F.col("raw_y")]).alias("raw"), length([F.col("stab_x"), F.col("stab_y")]).alias("stab"))
    m = m.withColumns({f"{c}_high": F.when(few, F.col(c)).otherwise(F.abs(F.col(c) - F.avg(c).over(near))) for c in ("raw", "stab")})
    sums = [F.avg(c).alias(c) for c in ("raw_x", "raw_y", "stab_x", "stab_y")]
    for c in ("raw", "stab"):
        sums += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.99)).alias(f"{c}_peak"), rms(F.col(f"{c}_high")).alias(f"{c}_jitter")]
    g = m.groupBy(ID).agg(*sums)
    g = g.withColumns({"pct_overall": reduction("raw_mean", "stab_mean"), "pct_dx": reduction("raw_x", "stab_x"), "pct_dy": reduction("raw_y", "stab_y"), "pct_peak": reduction("raw_peak", "stab_peak"), "pct_jitter": reduction("raw_jitter", "stab_jitter")})
    return g.withColumn("stabilized", (F.col("pct_peak") > 0) | (F.col("pct_overall") > 0) | (F.col("stab_peak") <= F.col("raw_peak")) | (F.col("pct_jitter") > 0))


def _mean(values: list[Column]) -> Column:
    """Mean of those that aren't null; null without any."""
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def composite(peak: Column, jitter: Column, overall: Column, dy: Column, stabilized: Column, sidecar: Column | None = None) -> Column:
    """One signed percentage.

    Of a stabilised clip: the sidecar's if positive, else the mean of jitter,
    peak, overall unless negative, and vertical unless 0; never below 0.1.  Of
    any other: minus the mean of what did not improve.
    """
    positive = lambda x: F.when(x > 0, x)
    value = _mean([jitter, peak, F.when(overall >= 0, overall), F.when(dy != 0, dy)])
    if sidecar is not None:
        value = F.when(sidecar > 0, F.least(sidecar, F.lit(100.0))).otherwise(value)
    rescue = F.coalesce(F.greatest(_mean([positive(x) for x in (peak, jitter, dy, overall)]), F.lit(0.1)), F.greatest(F.lit(0.1), F.when(F.abs(value) > 0.01, F.abs(value)).otherwise(1.0)))
    good = F.least(F.lit(100.0), F.when(value > 0, value).otherwise(rescue))
    worse = _mean([F.when(x <= 0, x) for x in (peak, overall, jitter)])
    bad = -F.abs(F.coalesce(worse, F.when(overall != 0, -F.abs(overall)).otherwise(-1.0)))
    return F.when(stabilized, good).otherwise(bad)


def percent_text(score: Column) -> Column:
    """A score with its sign and one decimal."""
    return F.concat(F.when(score < 0, "-").otherwise("+"), F.format_string("%.1f", F.abs(score)), F.lit("%"))


def horizon(df: DataFrame, *, fps: float, duration: float | None) -> DataFrame:
    """Tilt of checkpoints (series_id, frame, pitch, roll), and how well levelling holds them."""
    t = length([F.col("pitch"), F.col("roll")])
    g = df.withColumn("t", t).groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_tilt"), rms(F.col("t")).alias("rms_tilt"), F.max("t").alias("max_tilt"), F.stddev_pop("roll").alias("roll_std"), (F.max("roll") - F.min("roll")).alias("roll_swing"), F.max(F.abs("pitch")).alias("mp"), F.max(F.abs("roll")).alias("mr"), F.max(FRAME).alias("last"))
    n = F.col("n")
    clip = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    tilt = 55.0 + 28.0 * (1.0 - F.exp(-F.col("rms_tilt") / 3.5))
    count = F.least(F.lit(1.0), 0.8 + 0.05 * F.log2(F.greatest(F.lit(1), n) + 1.0))
    cover = F.lit(0.95)
    if duration:
        apart = F.lit(float(duration)) / F.greatest(F.lit(1), n)
        cover = F.when(n > 1, clip(F.col("last") / fps / duration, 0.5, 1.0) * clip(1.0 - F.greatest(F.lit(0.0), apart - 10.0) / 100.0, 0.85, 1.0)).otherwise(cover)
    level = (F.col("mp") < 0.015) & (F.col("mr") < 0.015)
    rms_, peak = F.col("rms_tilt"), F.col("max_tilt")
    grade = F.when(level, "ALREADY LEVEL").when((rms_ > 5) | (peak > 10), "EXCELLENT").when((rms_ > 2) | (peak > 4), "GOOD").when(peak > 0.5, "EFFECTIVE").otherwise("MODERATE")
    return g.withColumns({"max_slant_px": peak * SLANT_PX, "score": F.when(level, 100.0).otherwise(clip(tilt * count * cover, 45.0, 85.0)), "grade": grade})
