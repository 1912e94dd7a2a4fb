"""Queries on orientation series: differences, integrals, filters, extrema, change points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import level_delta
from ..operators import series as op
from .carriers import FPS, SERIES, r6, r6_sql, series, wrap_sql
from .registry import query

AXES = ("roll", "pitch", "yaw")
W = "WINDOW w AS (PARTITION BY series_id ORDER BY frame), a AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _clamped(x: str, k: int) -> str:
    if k == 0:
        return x
    return f"coalesce(lag({x}, {-k}) OVER w, first_value({x}) OVER a)" if k < 0 else f"coalesce(lead({x}, {k}) OVER w, last_value({x}) OVER a)"


def _med5(x: str) -> str:
    return f"list_sort([{', '.join(_clamped(x, k) for k in (-2, -1, 0, 1, 2))}])[3]"


@query("level_correction_rms", f"""
WITH {SERIES}, m AS (SELECT series_id, frame, {_med5('roll')} AS roll, {_med5('pitch')} AS pitch FROM s {W}),
d AS (SELECT series_id, roll - avg(roll) OVER (PARTITION BY series_id) AS dr, pitch - avg(pitch) OVER (PARTITION BY series_id) AS dp FROM m)
SELECT series_id, {r6_sql('sqrt(avg(dr * dr + dp * dp))', 'rms_deg')}, {r6_sql('max(sqrt(dr * dr + dp * dp))', 'peak_deg')}, count(*)::BIGINT AS frames FROM d GROUP BY series_id""")
def level_correction_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS and peak of the correction that levels each series after spikes are removed."""
    clean = series(spark, sf_dir).select("series_id", "frame", *[op.median5(F.col(a)).alias(a) for a in ("roll", "pitch")])
    delta = [level_delta(F.col(a), F.avg(a).over(op.Window.partitionBy("series_id"))) for a in ("roll", "pitch")]
    size = clean.select("series_id", F.sqrt(delta[0] * delta[0] + delta[1] * delta[1]).alias("m"))
    return size.groupBy("series_id").agg(r6(F.sqrt(F.avg(F.col("m") * F.col("m"))), "rms_deg"), r6(F.max("m"), "peak_deg"), F.count(F.lit(1)).alias("frames"))


@query("wrapped_rate", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, {wrap_sql('yaw - lag(yaw) OVER w')} AS dy, sec - lag(sec) OVER w AS dt FROM s {W})
SELECT series_id, frame, {r6_sql('CASE WHEN dt > 0 THEN dy / dt ELSE 0 END', 'rate')} FROM d""")
def wrapped_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.wrapped_rate(F.col("yaw"), F.col("sec")), "rate"))


@query("unwrapped_rate", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, (roll - lag(roll) OVER w) * 30e0 AS v FROM s {W})
SELECT series_id, frame, {r6_sql('coalesce(v, lead(v) OVER w, 0)', 'rate')} FROM d {W}""")
def unwrapped_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.plain_rate(F.col("roll"), FPS), "rate"))


@query("gyro_integral", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, CASE WHEN lag(sec) OVER w IS NULL THEN 0 ELSE roll * 1e-4 * greatest(sec - lag(sec) OVER w, 1e-4) END AS step FROM s {W})
SELECT series_id, frame, {r6_sql('sum(coalesce(step, 0)) OVER (PARTITION BY series_id ORDER BY frame)', 'angle')} FROM d""")
def gyro_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.integral(F.col("roll") * 1e-4, F.col("sec")), "angle"))


@query("delta_to_absolute", f"WITH {SERIES} SELECT series_id, frame, {r6_sql('sum(pitch) OVER (PARTITION BY series_id ORDER BY frame)', 'pitch')} FROM s")
def delta_to_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.running_sum(F.col("pitch")), "pitch"))


@query("angle_unwrap", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, yaw, yaw - lag(yaw) OVER w AS d FROM s {W}),
e AS (SELECT *, CASE WHEN abs(d) < 180 THEN d WHEN {wrap_sql('d')} = -180 AND d > 0 THEN 180 ELSE {wrap_sql('d')} END AS step FROM d)
SELECT series_id, frame, {r6_sql('first_value(yaw) OVER w + sum(coalesce(step, 0)) OVER w', 'yaw')} FROM e {W}""")
def angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.unwrapped(F.col("yaw")), "yaw"))


@query("median5_edge", f"WITH {SERIES} SELECT series_id, frame, {', '.join(r6_sql(_med5(x), x) for x in AXES)} FROM s {W}")
def median5_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", *[r6(op.median5(F.col(a)), a) for a in AXES])


@query("median3_pinned", f"""
WITH {SERIES} SELECT series_id, frame, {r6_sql('CASE WHEN lag(roll) OVER w IS NULL OR lead(roll) OVER w IS NULL THEN roll ELSE list_sort([lag(roll) OVER w, roll, lead(roll) OVER w])[2] END', 'roll')} FROM s {W}""")
def median3_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.median3(F.col("roll")), "roll"))


def _listed(kernel: str, index: str, left: int) -> str:
    """SQL of a convolution on whole lists: kernel is a list, index maps a place j (from 0) of n."""
    return f"""
WITH {SERIES}, l AS (SELECT series_id, list(roll ORDER BY frame) AS x, count(*) AS n FROM s GROUP BY series_id),
k AS (SELECT {kernel} AS k),
p AS (SELECT series_id, n, x, k, unnest(range(n)) AS frame FROM l, k)
SELECT series_id, frame, {r6_sql(f'list_sum(list_transform(range(len(k)), lambda j: k[j + 1] * x[({index.format(j=f"(frame + j - {left})")}) + 1]))', 'roll')} FROM p"""


_REFLECT = "CASE WHEN {j} < 0 THEN -{j} WHEN {j} >= n THEN 2 * (n - 1) - {j} ELSE {j} END"
_EDGE = "greatest(0, least(n - 1, {j}))"


def _gauss(sigma: float, r: int) -> str:
    raw = f"list_transform(range({2 * r + 1}), lambda i: exp(-0.5e0 * pow((i - {r}) / {sigma}::DOUBLE, 2)))"
    return f"(SELECT list_transform(g, lambda v: v / list_sum(g)) FROM (SELECT {raw} AS g))"


@query("gauss_reflect", _listed(_gauss(2.0, 6), _REFLECT, 6))
def gauss_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "roll")
    return op.gaussian_smooth(rows, ["roll"], 2.0, "reflect").select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("gauss_edge", _listed(_gauss(1.5, 5), _EDGE, 5))
def gauss_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "roll")
    return op.gaussian_smooth(rows, ["roll"], 1.5, "edge").select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("boxcar_reflect", _listed("list_transform(range(6), lambda i: 1e0 / 6e0)", _REFLECT, 3))
def boxcar_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "roll")
    return op.boxcar(rows, ["roll"], 6, "reflect").select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("boxcar_edge", _listed("list_transform(range(15), lambda i: 1e0 / 15e0)", _EDGE, 7))
def boxcar_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "roll")
    return op.boxcar(rows, ["roll"], 15, "edge").select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("boxcar_zero", f"WITH {SERIES} SELECT series_id, frame, {r6_sql('sum(pitch) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7e0', 'pitch')} FROM s")
def boxcar_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "pitch")
    return op.boxcar(rows, ["pitch"], 7, "zero").select("series_id", "frame", r6(F.col("pitch"), "pitch"))


@query("mean_shrink", f"WITH {SERIES} SELECT series_id, frame, {r6_sql('avg(pitch) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)', 'pitch')} FROM s")
def mean_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.shrinking_mean(F.col("pitch"), 7), "pitch"))


@query("bilateral_circular", f"""
WITH {SERIES}, l AS (SELECT series_id, list(yaw ORDER BY frame) AS x, count(*) AS n FROM s GROUP BY series_id),
p AS (SELECT series_id, n, x, unnest(range(n)) AS frame FROM l),
o AS (SELECT series_id, frame, x[frame + 1] AS c, unnest(list_transform(range(11), lambda j: struct_pack(k := exp(-0.5e0 * pow((j - 5) / 2e0, 2)), v := x[greatest(0, least(n - 1, frame + j - 5)) + 1]))) AS q FROM p),
t AS (SELECT series_id, frame, q.v AS v, q.k * exp(-0.5e0 * pow({wrap_sql('q.v - c')} / 2.5::DOUBLE, 2)) AS g FROM o)
SELECT series_id, frame, {r6_sql('degrees(atan2(sum(sin(radians(v)) * g), sum(cos(radians(v)) * g)))', 'yaw')} FROM t GROUP BY series_id, frame""")
def bilateral_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "yaw")
    return op.bilateral_circular(rows, ["yaw"], 8).select("series_id", "frame", r6(F.col("yaw"), "yaw"))


_SMOOTHED = f"{SERIES}, m AS (SELECT series_id, frame, round(sum(pitch) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7e0, 9) AS pitch FROM s)"
_EXTREMA = f"""{_SMOOTHED},
d AS (SELECT *, pitch - lag(pitch) OVER w AS b, lead(pitch) OVER w - pitch AS f, first_value(pitch) OVER a AS p0, last_value(pitch) OVER a AS p1 FROM m {W}),
e AS (SELECT series_id, frame, pitch, p0, p1, CASE WHEN b > 0 AND f <= 0 THEN 'crest' WHEN b < 0 AND f >= 0 THEN 'trough' END AS kind FROM d),
x AS (SELECT e.*, (SELECT arg_max(o.pitch, o.frame) FROM e o WHERE o.series_id = e.series_id AND o.kind <> e.kind AND o.frame < e.frame) AS l,
        (SELECT arg_min(o.pitch, o.frame) FROM e o WHERE o.series_id = e.series_id AND o.kind <> e.kind AND o.frame > e.frame) AS r FROM e WHERE kind IS NOT NULL),
y AS (SELECT series_id, frame, pitch, kind, least(abs(pitch - coalesce(l, p0)), abs(pitch - coalesce(r, p1))) AS prominence FROM x)"""


def _smooth_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "pitch")
    return op.boxcar(rows, ["pitch"], 7, "zero").withColumn("pitch", F.round("pitch", 9))


@query("extrema_prominence", f"WITH {_EXTREMA} SELECT series_id, frame, kind, {r6_sql('pitch', 'pitch')}, {r6_sql('prominence', 'prominence')} FROM y")
def extrema_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extrema(_smooth_pitch(spark, sf_dir), "pitch").select("series_id", "frame", "kind", r6(F.col("pitch"), "pitch"), r6(F.col("prominence"), "prominence"))


@query("extrema_topk", f"""
WITH {_EXTREMA} SELECT series_id, frame, kind, {r6_sql('prominence', 'prominence')} FROM y WHERE prominence >= 0.8::DOUBLE
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY prominence DESC, frame) <= 6""")
def extrema_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.extrema(_smooth_pitch(spark, sf_dir), "pitch").where("prominence >= 0.8D")
    return op.leading_extrema(found, 6).select("series_id", "frame", "kind", r6(F.col("prominence"), "prominence"))


@query("extrema_count_by_kind", f"WITH {_EXTREMA} SELECT kind, count(*)::BIGINT AS extrema, {r6_sql('max(prominence)', 'most')} FROM y GROUP BY kind")
def extrema_count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extrema(_smooth_pitch(spark, sf_dir), "pitch").groupBy("kind").agg(F.count(F.lit(1)).alias("extrema"), r6(F.max("prominence"), "most"))


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({wrap_sql(f'{a}_{x} - {b}_{x}')}, 2)" for x in "rpy") + ")"


#: A calm start, then a step of 20 to 60 degrees at a frame of the series' own.
_STEPPED = f"{SERIES}, g AS (SELECT series_id, frame, value * 1e-3 + CASE WHEN frame >= 5 + series_id % 20 THEN 20e0 + series_id % 40 ELSE 0 END AS v_r, value * 2e-3 AS v_p, value * 1e-3 AS v_y FROM s)"


@query("level_shift_changepoint", f"""
WITH {_STEPPED},
q AS (SELECT *, lag(v_r) OVER w AS b_r, lag(v_p) OVER w AS b_p, lag(v_y) OVER w AS b_y, count(*) OVER (PARTITION BY series_id) AS n FROM g {W}),
st AS (SELECT *, {_dist('v', 'b')} AS step FROM q),
z AS (SELECT *, lead(step) OVER w AS nxt, avg(step) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS calm,
   {', '.join(f'avg(v_{x}) OVER pre AS m_{x}, avg(v_{x}) OVER post AS o_{x}' for x in 'rpy')}, count(*) OVER pre AS nl, count(*) OVER post AS nr,
   list({{'r': v_r, 'p': v_p, 'y': v_y}}) OVER post AS aft FROM st
   WINDOW w AS (PARTITION BY series_id ORDER BY frame), pre AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), post AS (PARTITION BY series_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
h AS (SELECT * FROM z WHERE frame >= 1 AND frame < least(90, n - 4) AND step >= 12 AND nxt <= 2.5::DOUBLE AND nxt <= step * 0.3::DOUBLE AND nl >= 2 AND nr >= 2 AND coalesce(calm, 0) <= step * 0.25::DOUBLE AND {_dist('m', 'o')} >= step * 0.65::DOUBLE
   AND len(list_filter(aft, lambda c: sqrt({' + '.join(f"pow({wrap_sql(f'c.{x} - m_{x}')}, 2)" for x in 'rpy')}) < step * 0.5::DOUBLE)) = 0)
SELECT series_id, min(frame) AS frame, {r6_sql('arg_min(step, frame)', 'angle')} FROM h GROUP BY series_id""")
def level_shift_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    step = F.when(F.col("frame") >= 5 + F.col("series_id") % 20, 20.0 + F.col("series_id") % 40).otherwise(0.0)
    rows = series(spark, sf_dir).select("series_id", "frame", (v * 1e-3 + step).alias("roll"), (v * 2e-3).alias("pitch"), (v * 1e-3).alias("yaw"))
    return op.level_shift(rows, AXES, 90).select("series_id", "frame", r6(F.col("angle"), "angle"))


@query("warmup_prefix_run", f"""
WITH {SERIES}, g AS (SELECT series_id, frame, CASE WHEN frame < series_id % 9 THEN 1e0 ELSE roll END AS roll, first_value(CASE WHEN series_id % 9 > 0 THEN 1e0 ELSE roll END) OVER w AS r0 FROM s {W})
SELECT series_id, coalesce(min(CASE WHEN abs(roll - r0) >= 1e-4 THEN frame END), count(*))::BIGINT AS static_frames FROM g GROUP BY series_id""")
def warmup_prefix_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", F.when(F.col("frame") < F.col("series_id") % 9, 1.0).otherwise(F.col("roll")).alias("roll"))
    return op.static_prefix(rows, ["roll"])


@query("gradient_nonuniform", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, roll AS x, lag(roll) OVER w AS a, lead(roll) OVER w AS b, sec - lag(sec) OVER w AS h1, lead(sec) OVER w - sec AS h2 FROM s {W}),
g AS (SELECT series_id, frame, CASE WHEN a IS NULL THEN (b - x) / h2 WHEN b IS NULL THEN (x - a) / h1 ELSE (h1 * h1 * b + (h2 * h2 - h1 * h1) * x - h2 * h2 * a) / (h1 * h2 * (h1 + h2)) END AS v FROM d)
SELECT series_id, frame, round(v * 1e3, 6) + 0e0 AS slope_milli FROM g""")
def gradient_nonuniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", r6(op.gradient(F.col("roll"), F.col("sec")) * 1e3, "slope_milli"))


@query("pan_rate", f"""
WITH {SERIES}, d AS (SELECT series_id, yaw - lag(yaw) OVER w AS back, lead(yaw) OVER w - yaw AS forth, pitch - lag(pitch) OVER w AS pb, lead(pitch) OVER w - pitch AS pf FROM s {W}),
g AS (SELECT series_id, avg(abs(CASE WHEN back IS NULL THEN forth WHEN forth IS NULL THEN back ELSE (back + forth) / 2 END)) * 30 AS raw, avg(abs(CASE WHEN pb IS NULL THEN pf WHEN pf IS NULL THEN pb ELSE (pb + pf) / 2 END)) * 30 AS locked FROM d GROUP BY series_id)
SELECT series_id, {r6_sql('raw', 'raw_rate')}, {r6_sql('locked', 'locked_rate')}, {r6_sql('CASE WHEN raw > 0 THEN (raw - locked) / raw * 100 ELSE 0 END', 'reduction_pct')} FROM g""")
def pan_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("frame").cast("double")
    rows = series(spark, sf_dir).select("series_id", op.gradient(F.col("yaw"), t).alias("raw"), op.gradient(F.col("pitch"), t).alias("locked"))
    g = rows.groupBy("series_id").agg((F.avg(F.abs("raw")) * FPS).alias("raw"), (F.avg(F.abs("locked")) * FPS).alias("locked"))
    return g.select("series_id", r6(F.col("raw"), "raw_rate"), r6(F.col("locked"), "locked_rate"), r6(F.when(F.col("raw") > 0, (F.col("raw") - F.col("locked")) / F.col("raw") * 100.0).otherwise(0.0), "reduction_pct"))


@query("upper_median", f"""
WITH {SERIES}, l AS (SELECT series_id, list_sort(list(roll)) AS x, median(roll) AS m, count(*) AS n FROM s GROUP BY series_id)
SELECT series_id, {r6_sql('x[(n // 2) + 1]', 'upper')}, {r6_sql('m', 'middle')} FROM l""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of the two middle values of an even count, beside their mean; both by rank, without lists."""
    rank = F.row_number().over(op.Window.partitionBy("series_id").orderBy("roll"))
    rows = series(spark, sf_dir).select("series_id", "roll", rank.alias("rank"), F.count(F.lit(1)).over(op.Window.partitionBy("series_id")).alias("n"))
    upper = F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("roll")))
    return rows.groupBy("series_id").agg(r6(upper, "upper"), r6(F.percentile("roll", F.lit(0.5)), "middle"))


@query("circular_mean", f"WITH {SERIES} SELECT series_id, {r6_sql('degrees(atan2(sum(sin(radians(yaw)) * (1 + pitch * pitch)), sum(cos(radians(yaw)) * (1 + pitch * pitch))))', 'yaw')} FROM s GROUP BY series_id")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, y = 1.0 + F.col("pitch") * F.col("pitch"), F.radians("yaw")
    return series(spark, sf_dir).groupBy("series_id").agg(r6(F.degrees(F.atan2(F.sum(F.sin(y) * w), F.sum(F.cos(y) * w))), "yaw"))


@query("elevation_fill", f"""
WITH {SERIES}, g AS (SELECT series_id, frame, CASE WHEN (frame + series_id) % 4 = 0 THEN ele END AS ele FROM s)
SELECT series_id, frame, {r6_sql('coalesce(last_value(ele IGNORE NULLS) OVER w, first_value(ele IGNORE NULLS) OVER a, 315)', 'ele')} FROM g {W}""")
def elevation_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", F.when((F.col("frame") + F.col("series_id")) % 4 == 0, F.col("ele")).alias("ele"))
    return rows.select("series_id", "frame", r6(op.filled(F.col("ele"), 315.0), "ele"))


@query("frame_slice", f"WITH {SERIES} SELECT series_id, count(*)::BIGINT AS frames, min(frame)::BIGINT AS first, max(frame)::BIGINT AS last FROM s WHERE frame >= 10 AND frame < 40 GROUP BY series_id")
def frame_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).where((F.col("frame") >= 10) & (F.col("frame") < 40))
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))
