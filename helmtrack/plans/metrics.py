"""Queries that score motion: sizes, energies, shocks, grades, composite percentages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as me
from .carriers import SERIES, r6, r6_sql, series
from .registry import query

W = "WINDOW w AS (PARTITION BY series_id ORDER BY frame)"


@query("channel_stats", f"WITH {SERIES} SELECT series_id, {', '.join(f'{r6_sql(f'{f}({c})', f'{f}_{c}')}' for c in ('roll', 'pitch', 'yaw') for f in ('avg', 'min', 'max'))} FROM s GROUP BY series_id")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("series_id").agg(*[r6(getattr(F, f)(c), f"{f}_{c}") for c in ("roll", "pitch", "yaw") for f in ("avg", "min", "max")])


@query("correction_size", f"""
WITH {SERIES}, m AS (SELECT *, sqrt(roll * roll + pitch * pitch + yaw * yaw) AS m FROM s)
SELECT series_id, {r6_sql('sqrt(avg(m * m))', 'rms_deg')}, {r6_sql('sqrt(avg(m * m)) * 1280 / 90', 'rms_px')}, {r6_sql('max(m)', 'peak_deg')}, {r6_sql('max(m) * 1280 / 90', 'peak_px')},
  {r6_sql('max(abs(roll))', 'max_roll')}, {r6_sql('max(abs(pitch))', 'max_pitch')}, {r6_sql('max(abs(yaw))', 'max_yaw')},
  CASE WHEN max(abs(pitch)) >= max(abs(roll)) AND max(abs(pitch)) >= max(abs(yaw)) THEN 'Pitch' WHEN max(abs(roll)) >= max(abs(yaw)) THEN 'Roll' ELSE 'Yaw' END AS dominant FROM m GROUP BY series_id""")
def correction_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.correction_size(series(spark, sf_dir)).select("series_id", *[r6(F.col(c), c) for c in ("rms_deg", "rms_px", "peak_deg", "peak_px", "max_roll", "max_pitch", "max_yaw")], "dominant")


_DIFF = {n: " + ".join(f"pow({e.replace('X', c)}, 2)" for c in ("roll", "pitch", "yaw")) for n, e in (("acc", "X - 2 * lag(X) OVER w + lag(X, 2) OVER w"), ("jerk", "X - 3 * lag(X) OVER w + 3 * lag(X, 2) OVER w - lag(X, 3) OVER w"))}


@query("jerk_rms", f"""
WITH {SERIES}, d AS (SELECT series_id, {_DIFF['acc']} AS a, {_DIFF['jerk']} AS j FROM s {W})
SELECT series_id, {r6_sql('coalesce(sqrt(avg(a)), 0)', 'rms_acc')}, {r6_sql('coalesce(sqrt(max(a)), 0)', 'max_acc')}, {r6_sql('coalesce(sqrt(avg(j)), 0)', 'rms_jerk')}, {r6_sql('coalesce(sqrt(max(j)), 0)', 'max_jerk')} FROM d GROUP BY series_id""")
def jerk_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.jerk(series(spark, sf_dir)).select("series_id", *[r6(F.col(c), c) for c in ("rms_acc", "max_acc", "rms_jerk", "max_jerk")])


_BANDS = f"""b AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s), h AS (SELECT *, CASE WHEN n >= 4 THEN least(15, greatest(3, n // 4)) // 2 ELSE 0 END AS half FROM b),
l AS (SELECT a.series_id, a.frame, a.roll, a.pitch, a.yaw, avg(o.roll) AS lr, avg(o.pitch) AS lp, avg(o.yaw) AS ly FROM h a JOIN s o ON o.series_id = a.series_id AND o.frame BETWEEN a.frame - a.half AND a.frame + a.half GROUP BY ALL),
e AS (SELECT series_id, sqrt(avg(pow(roll - lr, 2) + pow(pitch - lp, 2) + pow(yaw - ly, 2))) AS hf, sqrt(avg(lr*lr + lp*lp + ly*ly)) AS lf, sum(pow(roll - lr, 2) + pow(pitch - lp, 2) + pow(yaw - ly, 2)) AS he, sum(lr*lr + lp*lp + ly*ly) AS le, max(sqrt(roll*roll + pitch*pitch + yaw*yaw)) AS peak FROM l GROUP BY series_id)"""


@query("energy_bands", f"""
WITH {SERIES}, {_BANDS}
SELECT series_id, {r6_sql('hf', 'rms_hf')}, {r6_sql('lf', 'rms_lf')}, {r6_sql('CASE WHEN he + le > 1e-9 THEN least(100, greatest(0, he / (he + le) * 100)) ELSE 0 END', 'absorbed_pct')},
 CASE WHEN hf < 0.1::DOUBLE THEN 'EXCELLENT' WHEN hf < 0.25::DOUBLE THEN 'GOOD' WHEN peak > 0.5::DOUBLE THEN 'EFFECTIVE' ELSE 'MODERATE' END AS grade FROM e""")
def energy_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.energy_bands(series(spark, sf_dir)).select("series_id", r6(F.col("rms_hf"), "rms_hf"), r6(F.col("rms_lf"), "rms_lf"), r6(F.col("absorbed_pct"), "absorbed_pct"), "grade")


_SHOCK = f"""p AS (SELECT series_id, frame, abs(roll) AS dx, abs(pitch) AS dy, sqrt(roll*roll + pitch*pitch) AS m, abs(roll * 0.6::DOUBLE + yaw * 0.05::DOUBLE) AS sx, abs(pitch * 0.9::DOUBLE) AS sy, sqrt(pow(roll * 0.6::DOUBLE + yaw * 0.05::DOUBLE, 2) + pow(pitch * 0.9::DOUBLE, 2)) AS k FROM s),
hp AS (SELECT *, abs(m - avg(m) OVER v) AS hm, abs(k - avg(k) OVER v) AS hk FROM p WINDOW v AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
g AS (SELECT series_id, avg(m) AS m0, avg(k) AS k0, quantile_cont(m, 0.99) AS m9, quantile_cont(k, 0.99) AS k9, avg(dx) AS x0, avg(sx) AS x1, avg(dy) AS y0, avg(sy) AS y1, sqrt(avg(hm*hm)) AS j0, sqrt(avg(hk*hk)) AS j1 FROM hp GROUP BY series_id),
c AS (SELECT series_id, m9, k9, CASE WHEN m0 > 0 THEN (m0 - k0) / m0 * 100 ELSE 0 END AS pct_overall, CASE WHEN x0 > 0 THEN (x0 - x1) / x0 * 100 ELSE 0 END AS pct_dx, CASE WHEN y0 > 0 THEN (y0 - y1) / y0 * 100 ELSE 0 END AS pct_dy, CASE WHEN m9 > 0 THEN (m9 - k9) / m9 * 100 ELSE 0 END AS pct_peak, CASE WHEN j0 > 0 THEN (j0 - j1) / j0 * 100 ELSE 0 END AS pct_jitter FROM g),
t AS (SELECT *, pct_peak > 0 OR pct_overall > 0 OR k9 <= m9 OR pct_jitter > 0 AS stabilized FROM c)"""


def _shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts of a raw and a stabilised clip by frame."""
    r, p, y = F.col("roll"), F.col("pitch"), F.col("yaw")
    return series(spark, sf_dir).select("series_id", "frame", r.alias("raw_x"), p.alias("raw_y"), (r * 0.6 + y * 0.05).alias("stab_x"), (p * 0.9).alias("stab_y"))


_PCTS = ("pct_overall", "pct_dx", "pct_dy", "pct_peak", "pct_jitter")


@query("shock_p99", f"WITH {SERIES}, {_SHOCK} SELECT series_id, {', '.join(r6_sql(c, c) for c in _PCTS)}, stabilized FROM t")
def shock_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.stabilisation(_shifts(spark, sf_dir)).select("series_id", *[r6(F.col(c), c) for c in _PCTS], "stabilized")


_COMPOSITE = """v AS (SELECT *, list_filter([pct_jitter, pct_peak, CASE WHEN pct_overall >= 0 THEN pct_overall END, CASE WHEN pct_dy <> 0 THEN pct_dy END], lambda x: x IS NOT NULL) AS ev, list_filter([pct_peak, pct_overall, pct_jitter], lambda x: x <= 0) AS neg FROM t),
u AS (SELECT *, list_avg(ev) AS val, list_filter([pct_peak, pct_jitter, pct_dy, pct_overall], lambda x: x > 0) AS pos FROM v),
z AS (SELECT series_id, stabilized, CASE WHEN stabilized THEN least(100, CASE WHEN val > 0 THEN val WHEN len(pos) > 0 THEN greatest(0.1::DOUBLE, list_avg(pos)) ELSE greatest(0.1::DOUBLE, CASE WHEN abs(val) > 0.01::DOUBLE THEN abs(val) ELSE 1 END) END)
  ELSE -abs(CASE WHEN len(neg) > 0 THEN list_avg(neg) WHEN pct_overall <> 0 THEN -abs(pct_overall) ELSE -1 END) END AS score FROM u)"""


@query("composite_score", f"WITH {SERIES}, {_SHOCK}, {_COMPOSITE} SELECT series_id, {r6_sql('score', 'score')} FROM z")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = me.stabilisation(_shifts(spark, sf_dir))
    return m.select("series_id", r6(me.composite(*[F.col(c) for c in ("pct_peak", "pct_jitter", "pct_overall", "pct_dy", "stabilized")]), "score"))


@query("horizon_score", f"""
WITH {SERIES}, c AS (SELECT series_id, frame, pitch, roll, sqrt(pitch*pitch + roll*roll) AS t FROM s),
g AS (SELECT series_id, count(*) AS n, avg(t) AS mean_tilt, sqrt(avg(t*t)) AS rms, max(t) AS peak, stddev_pop(roll) AS sway, max(roll) - min(roll) AS swing, max(abs(pitch)) AS mp, max(abs(roll)) AS mr, max(frame) / 30e0 AS span FROM c GROUP BY series_id),
f AS (SELECT *, (55 + 28 * (1 - exp(-rms / 3.5::DOUBLE))) * least(1, 0.8::DOUBLE + 0.05::DOUBLE * log2(greatest(1, n) + 1)) * CASE WHEN n > 1 THEN least(1, greatest(0.5::DOUBLE, span / 3)) * least(1, greatest(0.85::DOUBLE, 1 - greatest(0, 3e0 / greatest(1, n) - 10) / 100)) ELSE 0.95::DOUBLE END AS raw FROM g)
SELECT series_id, {r6_sql('mean_tilt', 'mean_tilt')}, {r6_sql('rms', 'rms_tilt')}, {r6_sql('peak', 'max_tilt')}, {r6_sql('peak * 12', 'max_slant_px')}, {r6_sql('sway', 'roll_std')}, {r6_sql('swing', 'roll_swing')},
 {r6_sql('CASE WHEN mp < 0.015::DOUBLE AND mr < 0.015::DOUBLE THEN 100 ELSE greatest(45, least(85, raw)) END', 'score')},
 CASE WHEN mp < 0.015::DOUBLE AND mr < 0.015::DOUBLE THEN 'ALREADY LEVEL' WHEN rms > 5 OR peak > 10 THEN 'EXCELLENT' WHEN rms > 2 OR peak > 4 THEN 'GOOD' WHEN peak > 0.5::DOUBLE THEN 'EFFECTIVE' ELSE 'MODERATE' END AS grade FROM f""")
def horizon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilt of every frame as a checkpoint, over clips of 3 seconds."""
    out = me.horizon(series(spark, sf_dir), fps=30.0, duration=3.0)
    return out.select("series_id", *[r6(F.col(c), c) for c in ("mean_tilt", "rms_tilt", "max_tilt", "max_slant_px", "roll_std", "roll_swing", "score")], "grade")


@query("cinematic_pooled_rms", f"WITH {SERIES} SELECT series_id, {r6_sql('sqrt((sum(roll*roll) + sum(pitch*pitch) + sum(yaw*yaw)) / (3 * count(*)))', 'rms')}, {r6_sql('greatest(max(abs(roll)), max(abs(pitch)), max(abs(yaw)))', 'peak')} FROM s GROUP BY series_id")
def cinematic_pooled_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RMS over the values of all three axes."""
    long = series(spark, sf_dir).select("series_id", "roll", "pitch", "yaw").unpivot("series_id", ["roll", "pitch", "yaw"], "axis", "v")
    return long.groupBy("series_id").agg(r6(F.sqrt(F.avg(F.col("v") * F.col("v"))), "rms"), r6(F.max(F.abs("v")), "peak"))


@query("heading_lock_metrics", f"WITH {SERIES} SELECT series_id, {r6_sql('avg(CASE WHEN abs(pitch - roll) <= 1.5::DOUBLE THEN 1 ELSE 0 END) * 100', 'in_deadband_pct')}, {r6_sql('max(abs(pitch - roll))', 'max_sway')}, {r6_sql('sqrt(avg(roll * roll))', 'rms_steer')} FROM s GROUP BY series_id")
def heading_lock_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.col("pitch") - F.col("roll"))
    return series(spark, sf_dir).groupBy("series_id").agg(r6(F.avg(F.when(off <= 1.5, 1).otherwise(0)) * 100, "in_deadband_pct"), r6(F.max(off), "max_sway"), r6(F.sqrt(F.avg(F.col("roll") * F.col("roll"))), "rms_steer"))


@query("net_stage_score", f"WITH {SERIES}, {_SHOCK}, {_COMPOSITE} SELECT {r6_sql('avg(score)', 'net_score')}, count(*)::BIGINT AS stages, count(*) FILTER (WHERE score < 0)::BIGINT AS degraded FROM z")
def net_stage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of all stage scores, and how many stages would be reverted."""
    m = me.stabilisation(_shifts(spark, sf_dir))
    scores = m.select(me.composite(*[F.col(c) for c in ("pct_peak", "pct_jitter", "pct_overall", "pct_dy", "stabilized")]).alias("s"))
    return scores.agg(r6(F.avg("s"), "net_score"), F.count(F.lit(1)).alias("stages"), F.count_if(F.col("s") < 0).alias("degraded"))
