"""Queries on stages: composition, command text, stage lists, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checkpoints, stages
from .carriers import SERIES, r6, r6_sql, series, table, wrap_sql
from .motion import W, _med5
from .recurrences import _walk
from .registry import query
from .rotations import _matrix_sql, _product_sql, euler_sql

AXES = ("yaw", "pitch", "roll")


def synthetic(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three stages of every series: at 30 Hz, at 10 Hz, and one that stands still."""
    s = series(spark, sf_dir)
    t = (F.col("frame") / 30.0).alias("t")
    scaled = lambda by: [(F.col(a) * by).alias(a) for a in AXES]
    return [s.select("series_id", t, *scaled(0.2)), s.select("series_id", (F.col("frame") / 10.0).alias("t"), *scaled(0.1)), s.select("series_id", t, *scaled(1e-5))]


_INTERP = ", ".join(f"CASE WHEN t0 IS NULL THEN {a}1 WHEN t1 IS NULL THEN {a}0 ELSE {a}0 + q * ({a}1 - {a}0) END AS {a}b" for a in AXES)
_COMPOSE = f"""g AS (SELECT series_id, frame / 30e0 AS t, frame, yaw * 0.2::DOUBLE AS yaw, pitch * 0.2::DOUBLE AS pitch, roll * 0.2::DOUBLE AS roll FROM s),
k AS (SELECT series_id, frame / 10e0 AS t, yaw * 0.1::DOUBLE AS yaw, pitch * 0.1::DOUBLE AS pitch, roll * 0.1::DOUBLE AS roll FROM s),
b AS (SELECT g.*, k.t AS t0, k.yaw AS yaw0, k.pitch AS pitch0, k.roll AS roll0 FROM g ASOF LEFT JOIN k ON g.series_id = k.series_id AND g.t >= k.t),
f AS (SELECT b.*, k.t AS t1, k.yaw AS yaw1, k.pitch AS pitch1, k.roll AS roll1 FROM b ASOF LEFT JOIN k ON b.series_id = k.series_id AND b.t <= k.t),
h AS (SELECT *, CASE WHEN t1 - t0 > 1e-9 THEN (t - t0) / (t1 - t0) ELSE 0 END AS q FROM f),
i AS (SELECT series_id, frame, yaw, pitch, roll, {_INTERP} FROM h),
m AS (SELECT series_id, frame, {_matrix_sql('yaw', 'pitch', 'roll', 'a')}, {_matrix_sql('yawb', 'pitchb', 'rollb', 'b')} FROM i),
p AS (SELECT series_id, frame, {_product_sql('a', 'b', 'm')} FROM m),
e AS (SELECT series_id, frame, {', '.join(f'{v} AS {a}' for v, a in zip(euler_sql('m'), AXES, strict=True))} FROM p)"""


@query("stage_compose_prune", f"WITH {SERIES}, {_COMPOSE} SELECT series_id, frame, {', '.join(r6_sql(a, a) for a in AXES)} FROM e")
def stage_compose_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stages.compose(synthetic(spark, sf_dir))
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES])


@query("stage_compose_delta", f"WITH {SERIES}, {_COMPOSE} SELECT series_id, frame, {', '.join(r6_sql(wrap_sql(f'{a} - coalesce(lag({a}) OVER w, 0)'), a) for a in AXES)} FROM e WINDOW w AS (PARTITION BY series_id ORDER BY frame)")
def stage_compose_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stages.compose(synthetic(spark, sf_dir), delta=True)
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES])


@query("identity_stages", f"WITH {SERIES} SELECT series_id, max(greatest(abs(yaw), abs(pitch), abs(roll))) * 9e-5 < 0.015::DOUBLE AS still FROM s GROUP BY series_id")
def identity_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.is_identity(series(spark, sf_dir).select("series_id", *[(F.col(a) * 9e-5).alias(a) for a in AXES]))


@query("stage_list_normalize", """
WITH r AS (SELECT o_orderkey AS job, i AS place, (['checkpoints', 'telemetry', 'l1', 'kopf3d2d', 'dir_lock', 'horizon', 'unknown', 'cinematic'])[1 + (o_orderkey * (i + 3) + i) % 8] AS name FROM orders, (SELECT unnest(range(6)) AS i)),
k AS (SELECT job, place, CASE name WHEN 'checkpoints' THEN 'horizon' WHEN 'horizon' THEN 'horizon' WHEN 'l1' THEN 'cinematic' WHEN 'cinematic' THEN 'cinematic' WHEN 'kopf3d2d' THEN 'kopf' WHEN 'dir_lock' THEN 'traveldir' WHEN 'telemetry' THEN 'telemetry' END AS stage FROM r),
f AS (SELECT job, stage, min(place) AS p FROM k WHERE stage IS NOT NULL GROUP BY ALL)
SELECT job, row_number() OVER (PARTITION BY job ORDER BY p) AS place, stage FROM f""")
def stage_list_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.normalised_list(_requests(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("checkpoints", "telemetry", "l1", "kopf3d2d", "dir_lock", "horizon", "unknown", "cinematic")])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("place"))
    return rows.select("job", "place", names[((F.col("job") * (F.col("place") + 3) + F.col("place")) % 8).cast("int")].alias("name"))


@query("stage_order_conflicts", """
WITH r AS (SELECT o_orderkey AS job, i AS place, (['checkpoints', 'telemetry', 'l1', 'kopf3d2d', 'dir_lock', 'horizon', 'unknown', 'cinematic'])[1 + (o_orderkey * (i + 3) + i) % 8] AS name FROM orders, (SELECT unnest(range(6)) AS i)),
a AS (SELECT job, min(place) FILTER (WHERE name IN ('checkpoints', 'horizon')) AS h, min(place) FILTER (WHERE name = 'telemetry') AS t FROM r GROUP BY job)
SELECT job FROM a WHERE h < t""")
def stage_order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.order_conflicts(stages.normalised_list(_requests(spark, sf_dir))).select("job")


@query("chosen_minus_reverted", """
SELECT job, string_agg(stage, ',' ORDER BY place) AS kept FROM (
 SELECT o_orderkey AS job, u.place, u.stage FROM orders, (VALUES (1, 'telemetry'), (2, 'kopf'), (3, 'kabsch'), (4, 'horizon')) u(place, stage)
 WHERE (o_orderkey + u.place) % 3 <> 0 AND (o_orderkey * u.place) % 5 <> 1) GROUP BY job""")
def chosen_minus_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that were chosen, without those reverted, in their order."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(n).alias("stage")) for i, n in enumerate(("telemetry", "kopf", "kabsch", "horizon"))])
    every = jobs.select("job", F.inline(names))
    chosen = every.where("(job + place) % 3 <> 0").select("job", "stage")
    reverted = every.where("(job * place) % 5 = 1").select("job", "stage")
    kept = every.join(chosen, ["job", "stage"], "left_semi").join(reverted, ["job", "stage"], "left_anti")
    return kept.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "stage"))), lambda x: x["stage"]), ",").alias("kept"))


@query("sendcmd_roundtrip", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, round(yaw - coalesce(lag(yaw) OVER w, 0), 6) AS yaw, round(pitch - coalesce(lag(pitch) OVER w, 0), 6) AS pitch, round(roll - coalesce(lag(roll) OVER w, 0), 6) AS roll FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame))
SELECT series_id, frame, {', '.join(r6_sql(f'sum({a}) OVER (PARTITION BY series_id ORDER BY frame)', a) for a in AXES)} FROM d""")
def sendcmd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles written as changes, one text line an axis and frame, then parsed and summed up again."""
    rows = series(spark, sf_dir).select("series_id", "frame", *AXES)
    lines = text.command_lines(stages.deltas(rows), fps=30.0)
    back = text.parsed_commands(lines, delta=True)
    return back.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES])


@query("cadence_grid", f"""
WITH {SERIES}, n AS (SELECT series_id, count(*) AS total FROM s GROUP BY series_id),
g AS (SELECT series_id, total, unnest(range(0, total - 1, 15)) AS frame FROM n),
a AS (SELECT series_id, frame FROM g UNION SELECT series_id, total - 1 FROM n) SELECT series_id, frame::BIGINT AS frame, round(frame / 30e0, 2) AS time FROM a""")
def cadence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = series(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("total"))
    return checkpoints.cadence(totals, fps=30.0, interval=0.5).select("series_id", "frame", F.round(F.col("frame") / 30.0, 2).alias("time"))


@query("checkpoints_extrema")
def checkpoints_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levelling checkpoints; the pieces have SQL of their own (extrema_prominence, extrema_topk, boxcar_zero)."""
    rows = series(spark, sf_dir).select("series_id", "frame", "pitch", "roll")
    return checkpoints.from_extrema(rows, fps=30.0, most=12)


@query("checkpoints_simplified")
def checkpoints_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", "pitch", "roll")
    return checkpoints.from_polyline(rows, epsilon=4.0)


def _despiked_sql(a: str) -> str:
    return f"CASE WHEN n.next_{a} IS NOT NULL AND abs(n.{a} - p.{a}) > 2.5::DOUBLE AND abs(n.{a} - n.next_{a}) > 2.5::DOUBLE THEN (p.{a} + n.next_{a}) / 2 ELSE n.{a} END"


def _slewed_sql(a: str) -> str:
    return f"CASE WHEN abs(n.{a} - p.{a}) > 2.5::DOUBLE THEN p.{a} + sign(n.{a} - p.{a}) * 2.5::DOUBLE ELSE n.{a} END"


_NEXT_ROW = "JOIN {source} n ON n.series_id = p.series_id AND n.frame = p.frame + 1"


@query("telemetry_stage", f"""
WITH RECURSIVE {SERIES}, med AS (SELECT series_id, frame, {_med5('roll')} AS roll, {_med5('pitch')} AS pitch FROM s {W}),
ahead AS (SELECT *, lead(roll) OVER o AS next_roll, lead(pitch) OVER o AS next_pitch FROM med WINDOW o AS (PARTITION BY series_id ORDER BY frame)),
clean AS (SELECT series_id, frame, roll, pitch FROM ahead WHERE frame = 0 UNION ALL SELECT n.series_id, n.frame, {_despiked_sql('roll')}, {_despiked_sql('pitch')} FROM clean p {_NEXT_ROW.format(source='ahead')}),
aim AS (SELECT series_id, frame, roll - avg(roll) OVER (PARTITION BY series_id) AS roll, pitch - avg(pitch) OVER (PARTITION BY series_id) AS pitch FROM clean),
slow AS (SELECT series_id, frame, roll, pitch FROM aim WHERE frame = 0 UNION ALL SELECT n.series_id, n.frame, {_slewed_sql('roll')}, {_slewed_sql('pitch')} FROM slow p {_NEXT_ROW.format(source='aim')})
SELECT series_id, frame, {r6_sql('CASE WHEN frame = 0 THEN 0 ELSE (frame - 0.5::DOUBLE) / 30e0 END', 't_start')}, {r6_sql('(frame + 0.5::DOUBLE) / 30e0', 't_end')}, 0e0 AS yaw, {', '.join(r6_sql(f'-({a} - coalesce(lag({a}) OVER o, 0))', a) for a in ('pitch', 'roll'))} FROM slow WINDOW o AS (PARTITION BY series_id ORDER BY frame)""")
def telemetry_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stages.telemetry(series(spark, sf_dir), mode="level")
    return out.select("series_id", "frame", *[r6(F.col(c), c) for c in ("t_start", "t_end", *AXES)])


_HEADING = f"""{SERIES}, d AS (SELECT series_id, frame, yaw, yaw - lag(yaw) OVER w AS d FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
e AS (SELECT *, CASE WHEN abs(d) < 180 THEN d WHEN {wrap_sql('d')} = -180 AND d > 0 THEN 180 ELSE {wrap_sql('d')} END AS step FROM d),
r AS (SELECT series_id, frame, first_value(yaw) OVER w + sum(coalesce(step, 0)) OVER w AS raw FROM e WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
l AS (SELECT series_id, list(raw ORDER BY frame) AS x, count(*) AS n FROM r GROUP BY series_id), k AS (SELECT *, unnest(range(n)) AS frame FROM l),
g AS (SELECT series_id, frame, x[frame + 1] AS raw, list_sum(list_transform(range(15), lambda j: x[greatest(0, least(n - 1, frame + j - 7)) + 1])) / 15e0 AS trend FROM k),
h AS (SELECT *, trend - raw AS gap FROM g)"""


@query("travel_direction", _walk("CASE WHEN abs(n.gap) > 1.5::DOUBLE THEN (1e0 - 0.9::DOUBLE) * n.gap ELSE 0e0 END AS v, n.raw AS raw, n.trend AS trend", "CASE WHEN abs(n.gap - p.v) > 1.5::DOUBLE THEN p.v + (1e0 - 0.9::DOUBLE) * (n.gap - p.v) ELSE p.v END, n.raw, n.trend", f"SELECT series_id, frame, {r6_sql('raw', 'raw_yaw')}, {r6_sql('trend', 'trend_yaw')}, {r6_sql(wrap_sql('v'), 'steer')}, {r6_sql('raw + v', 'locked_yaw')} FROM walk", "h", _HEADING))
def travel_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stages.travel_direction(series(spark, sf_dir), width=15)
    return out.select("series_id", "frame", *[r6(F.col(c), c) for c in ("raw_yaw", "trend_yaw", "steer", "locked_yaw")])
