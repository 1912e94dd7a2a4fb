"""Queries of recurrences; their SQL walks each series row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import gravity_camera
from ..operators import recurrence as rec
from ..operators import series as op
from .carriers import FPS, SERIES, r6, r6_sql, series
from .registry import query

#: sin and cos columns are given in full so that a step needs no look-ahead.
_IMU = f"""{SERIES}, i0 AS (SELECT series_id, frame, (roll - lag(roll) OVER w) * 30 AS gx, (pitch - lag(pitch) OVER w) * 30 AS gy, (yaw - lag(yaw) OVER w) * 30 AS gz, -sin(radians(pitch)) AS ax, sin(radians(roll)) * cos(radians(pitch)) AS ay, cos(radians(roll)) * cos(radians(pitch)) AS az FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
imu AS (SELECT series_id, frame, coalesce(gx, lead(gx) OVER w, 0) AS gx, coalesce(gy, lead(gy) OVER w, 0) AS gy, coalesce(gz, lead(gz) OVER w, 0) AS gz, ax, ay, az, degrees(atan2(ay, az + 1e-8)) AS tr, degrees(atan2(-ax, sqrt(ay*ay + az*az) + 1e-8)) AS tp FROM i0 WINDOW w AS (PARTITION BY series_id ORDER BY frame))"""


def _walk(start: str, step: str, carry: str, source: str = "s", ctes: str = SERIES) -> str:
    """A recursive walk: ``start`` from row 0, ``step`` from the walk's row p and the next row n."""
    return f"WITH RECURSIVE {ctes}, walk AS (SELECT n.series_id, n.frame, {start} FROM {source} n WHERE n.frame = 0 UNION ALL SELECT n.series_id, n.frame, {step} FROM walk p JOIN {source} n ON n.series_id = p.series_id AND n.frame = p.frame + 1) {carry}"


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and forces that a series' own angles imply."""
    ax, ay, az = gravity_camera(F.col("roll"), F.col("pitch"))
    rates = [op.plain_rate(F.col(a), FPS).alias(g) for a, g in (("roll", "gx"), ("pitch", "gy"), ("yaw", "gz"))]
    return series(spark, sf_dir).select("series_id", "frame", *rates, ax.alias("ax"), ay.alias("ay"), az.alias("az"))


@query("despike_sandwich", _walk("n.roll AS v", "CASE WHEN n.nx IS NOT NULL AND abs(n.roll - p.v) > 2.5::DOUBLE AND abs(n.roll - n.nx) > 2.5::DOUBLE THEN (p.v + n.nx) / 2 ELSE n.roll END", f"SELECT series_id, frame, {r6_sql('v', 'roll')} FROM walk", "d", f"{SERIES}, d0 AS (SELECT series_id, frame, roll + sin(value) AS roll FROM s), d AS (SELECT series_id, frame, roll, lead(roll) OVER (PARTITION BY series_id ORDER BY frame) AS nx FROM d0)"))
def despike_sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("roll", F.col("roll") + F.sin("value"))
    out = rec.scan(rows, rec.with_next(["roll"]), ("roll",), rec.Despike())
    return out.select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("slew_limit", _walk("n.roll AS v", "CASE WHEN abs(n.roll - p.v) > 2.5::DOUBLE THEN p.v + sign(n.roll - p.v) * 2.5::DOUBLE ELSE n.roll END", f"SELECT series_id, frame, {r6_sql('v', 'roll')} FROM walk"))
def slew_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rec.scan(series(spark, sf_dir), ("roll",), ("roll",), rec.Slew(1, 2.5))
    return out.select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("rate_limit", _walk("n.roll AS v, n.t AS t", "CASE WHEN abs(n.roll - p.v) > 4e0 * (n.t - p.t) THEN p.v + sign(n.roll - p.v) * (4e0 * (n.t - p.t)) ELSE n.roll END, n.t", f"SELECT series_id, frame, {r6_sql('v', 'roll')} FROM walk", "d", f"{SERIES}, d AS (SELECT series_id, frame, roll, frame * 0.5e0 AS t FROM s)"))
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("t", F.col("frame") * 0.5)
    return rec.scan(rows, ("roll", "t"), ("roll",), rec.RateLimit()).select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("deadband_follow", _walk("CASE WHEN abs(n.roll) > 1.5::DOUBLE THEN (1e0 - 0.9::DOUBLE) * n.roll ELSE 0e0 END AS v", "CASE WHEN abs(n.roll - p.v) > 1.5::DOUBLE THEN p.v + (1e0 - 0.9::DOUBLE) * (n.roll - p.v) ELSE p.v END", f"SELECT series_id, frame, {r6_sql('v', 'steer')} FROM walk"))
def deadband_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.scan(series(spark, sf_dir), ("roll",), ("steer",), rec.Deadband()).select("series_id", "frame", r6(F.col("steer"), "steer"))


@query("ema_speed", _walk("n.value AS v, n.t AS last", "CASE WHEN n.t - p.last >= 0.5e0 THEN 0.3::DOUBLE * n.value + (1e0 - 0.3::DOUBLE) * p.v ELSE p.v END, CASE WHEN n.t - p.last >= 0.5e0 THEN n.t ELSE p.last END", f"SELECT series_id, frame, {r6_sql('v', 'speed')} FROM walk", "d", f"{SERIES}, d AS (SELECT series_id, frame, value, frame * 0.2::DOUBLE AS t FROM s)"))
def ema_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("t", F.col("frame") * 0.2)
    return rec.scan(rows, ("value", "t"), ("speed",), rec.Ema()).select("series_id", "frame", r6(F.col("speed"), "speed"))


def _fused(spark: SparkSession, sf_dir: str, method: str, gain: float) -> DataFrame:
    out = rec.fuse(imu(spark, sf_dir), method=method, gain=gain, fps=FPS)
    return out.select("series_id", "frame", *[r6(F.col(c), c) for c in ("roll", "pitch", "yaw")])


_THREE = ", ".join(r6_sql(c, c) for c in ("roll", "pitch", "yaw"))
_A = "0.98::DOUBLE"


@query("complementary", _walk(f"{_A} * (0e0 + n.gx * (1e0/30)) + (1e0 - {_A}) * n.tr AS roll, {_A} * (0e0 + n.gy * (1e0/30)) + (1e0 - {_A}) * n.tp AS pitch, n.gz * (1e0/30) AS yaw", f"{_A} * (p.roll + n.gx * (1e0/30)) + (1e0 - {_A}) * n.tr, {_A} * (p.pitch + n.gy * (1e0/30)) + (1e0 - {_A}) * n.tp, p.yaw + n.gz * (1e0/30)", f"SELECT series_id, frame, {_THREE} FROM walk", "imu", _IMU))
def complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "complementary", 0.98)


@query("gyro_only", f"WITH {_IMU} SELECT series_id, frame, {', '.join(r6_sql(f'sum({g} / 30) OVER (PARTITION BY series_id ORDER BY frame)', a) for g, a in (('gx', 'roll'), ('gy', 'pitch'), ('gz', 'yaw')))} FROM imu")
def gyro_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pure integration needs no recurrence: it is a running sum."""
    return imu(spark, sf_dir).select("series_id", "frame", *[r6(op.running_sum(F.col(g) / FPS), a) for g, a in (("gx", "roll"), ("gy", "pitch"), ("gz", "yaw"))])


def _ekf_sql() -> str:
    dt, noise = "(1e0/30)", "(0.51::DOUBLE * (0.03::DOUBLE / 0.51::DOUBLE))"
    zero = ", ".join(f"0e0 AS a{i}, 0e0 AS b{i}, 1e0 AS p{i}, 0e0 AS q{i}, 0e0 AS r{i}, 1e0 AS t{i}" for i in (0, 1))

    def axis(i: int, rate: str, seen: str) -> str:
        ang, p, q, r, t = f"(p.a{i} + {dt} * (n.{rate} - p.b{i}))", f"(p.p{i} + {dt} * ({dt} * p.t{i} - p.q{i} - p.r{i} + 0.001::DOUBLE))", f"(p.q{i} - {dt} * p.t{i})", f"(p.r{i} - {dt} * p.t{i})", f"(p.t{i} + 0.003::DOUBLE * {dt})"
        k0, k1, off = f"({p} / ({p} + {noise}))", f"({r} / ({p} + {noise}))", f"(n.{seen} - {ang})"
        return f"{ang} + {k0} * {off}, p.b{i} + {k1} * {off}, {p} - {k0} * {p}, {q} - {k0} * {q}, {r} - {k1} * {p}, {t} - {k1} * {q}"

    # the walk begins one row before the first, at the filter's start
    return f"""WITH RECURSIVE {_IMU}, walk AS (SELECT series_id, -1::BIGINT AS frame, {zero}, 0e0 AS yaw FROM imu WHERE frame = 0
 UNION ALL SELECT n.series_id, n.frame, {axis(0, 'gx', 'tr')}, {axis(1, 'gy', 'tp')}, p.yaw + n.gz * {dt} FROM walk p JOIN imu n ON n.series_id = p.series_id AND n.frame = p.frame + 1)
SELECT series_id, frame, {r6_sql('a0', 'roll')}, {r6_sql('a1', 'pitch')}, {r6_sql('yaw', 'yaw')} FROM walk WHERE frame >= 0"""


@query("ekf", _ekf_sql())
def ekf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "ekf", 0.51)


def _mahony_sql() -> str:
    dt = "(1e0/30)"
    m = "sqrt(n.ax*n.ax + n.ay*n.ay + n.az*n.az)"
    vx, vy, vz = "(2*(x*z - w*y))", "(2*(w*x + y*z))", "(w*w - x*x - y*y + z*z)"
    return f"""WITH RECURSIVE {_IMU}, walk AS (SELECT series_id, -1::BIGINT AS frame, 1e0 AS w, 0e0 AS x, 0e0 AS y, 0e0 AS z FROM imu WHERE frame = 0
 UNION ALL SELECT series_id, frame, w1/k, x1/k, y1/k, z1/k FROM (SELECT *, sqrt(w1*w1 + x1*x1 + y1*y1 + z1*z1) AS k FROM (
  SELECT series_id, frame, w + 0.5e0*(-x*rx - y*ry - z*rz)*{dt} AS w1, x + 0.5e0*(w*rx + y*rz - z*ry)*{dt} AS x1, y + 0.5e0*(w*ry - x*rz + z*rx)*{dt} AS y1, z + 0.5e0*(w*rz + x*ry - y*rx)*{dt} AS z1 FROM (
   SELECT series_id, frame, w, x, y, z, radians(gx) + 0.5e0*(uy*{vz} - uz*{vy}) AS rx, radians(gy) + 0.5e0*(uz*{vx} - ux*{vz}) AS ry, radians(gz) + 0.5e0*(ux*{vy} - uy*{vx}) AS rz FROM (
    SELECT n.series_id, n.frame, w, x, y, z, n.gx, n.gy, n.gz, n.ax/{m} AS ux, n.ay/{m} AS uy, n.az/{m} AS uz FROM walk p JOIN imu n ON n.series_id = p.series_id AND n.frame = p.frame + 1)))))
SELECT series_id, frame, {r6_sql('degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y)))', 'roll')}, {r6_sql('degrees(asin(greatest(-1e0, least(1e0, 2*(w*y - z*x)))))', 'pitch')}, {r6_sql('degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z)))', 'yaw')} FROM walk WHERE frame >= 0"""


@query("mahony", _mahony_sql())
def mahony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "mahony", 0.5)


@query("rdp_simplify")
def rdp_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits depend on earlier splits, which SQL can't follow; tests/ holds it against a recursive version."""
    return rec.simplified(series(spark, sf_dir), 12.0).select("series_id", "frame", r6(F.col("pitch"), "pitch"), r6(F.col("roll"), "roll"))


@query("l1l2_trend")
def l1l2_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rec.side_by_side(series(spark, sf_dir), ("roll",), ("roll",), lambda found: rec.trend_filter_all(found, 6.0))
    return out.select("series_id", "frame", r6(F.col("roll"), "roll"))


@query("cinematic_l1")
def cinematic_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of few, straight stretches; yaw is unwrapped first and wrapped after."""
    rows = series(spark, sf_dir).select("series_id", "frame", "roll", "pitch", op.unwrapped(F.col("yaw")).alias("yaw"))
    out = rec.side_by_side(rows, ("roll", "pitch", "yaw"), ("roll", "pitch", "yaw"), rec.cinematic_all)
    from ..functions.angles import wrap180

    return out.select("series_id", "frame", r6(F.col("roll"), "roll"), r6(F.col("pitch"), "pitch"), r6(wrap180(F.col("yaw")), "yaw"))
