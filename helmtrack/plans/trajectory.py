"""Queries on corrections, key rotations, exports, stage outcomes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles, text
from ..functions import rotation as ro
from ..operators import catalog, checkpoints, joins, robust, stages, track
from ..operators import trajectory as tr
from ..sources import tracks
from .carriers import SERIES, r6, r6_sql, series, table
from .geo import hav_sql
from .motion import _REFLECT, _gauss
from .registry import query
from .rotations import _VEC, _matrix_sql, _product_sql, directions, euler_sql

AXES = ("yaw", "pitch", "roll")


def _smoothed_sql(source: str, columns: tuple[str, ...], sigma: float, radius: int, name: str) -> str:
    """CTEs of Gaussian means of columns of a CTE, reflected at the ends: ``name`` has the columns and g_ means."""
    lists = ", ".join(f"list({c} ORDER BY frame) AS x_{c}" for c in columns)
    at = _REFLECT.format(j=f"(frame + j - {radius})")
    means = ", ".join(f"list_sum(list_transform(range(len(k)), lambda j: k[j + 1] * x_{c}[({at}) + 1])) AS g_{c}, x_{c}[frame + 1] AS {c}" for c in columns)
    return f"""{name}_l AS (SELECT series_id, {lists}, count(*) AS n FROM {source} GROUP BY series_id),
{name}_k AS (SELECT {_gauss(sigma, radius)} AS k),
{name}_p AS (SELECT *, unnest(range(n)) AS frame FROM {name}_l, {name}_k),
{name} AS (SELECT series_id, frame, {means} FROM {name}_p)"""


def _clip_sql(x: str, cap: float = tr.CAP) -> str:
    return f"greatest(-{cap}::DOUBLE, least({cap}::DOUBLE, {x}))"


_CHANGES = "c AS (SELECT series_id, frame, yaw * 0.02::DOUBLE AS yaw, pitch * 0.1::DOUBLE AS pitch, roll * 0.1::DOUBLE AS roll FROM s), d AS (SELECT series_id, frame, " + ", ".join(f"sum({a}) OVER (PARTITION BY series_id ORDER BY frame) AS {a}" for a in AXES) + " FROM c)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("series_id", "frame", *[(F.col(a) * by).alias(a) for a, by in zip(AXES, (0.02, 0.1, 0.1), strict=True)])


@query("smoothing_correction", f"WITH {SERIES}, {_CHANGES}, {_smoothed_sql('d', AXES, 4.0, 12, 'g')} SELECT series_id, frame, {', '.join(r6_sql(_clip_sql(f'g_{a} - {a}'), a) for a in AXES)} FROM g")
def smoothing_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.smoothing_correction(_changes(spark, sf_dir), AXES, smoothing=12.0)
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES])


@query("shake_capped_correction", f"WITH {SERIES}, {_CHANGES}, {_smoothed_sql('d', AXES[:2], 2.0, 6, 'g')} SELECT series_id, frame, {', '.join(r6_sql(_clip_sql(f'g_{a} - {a}', 3.0), a) for a in AXES[:2])} FROM g")
def shake_capped_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.smoothing_correction(_changes(spark, sf_dir), AXES[:2], smoothing=6.0, cap=tr.shake_cap(2.0))
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES[:2]])


@query("tripod_correction", f"WITH {SERIES}, {_CHANGES} SELECT series_id, frame, {', '.join(r6_sql(f'-{a}', a) for a in AXES[:2])} FROM d")
def tripod_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.smoothing_correction(_changes(spark, sf_dir), AXES[:2], tripod=True)
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES[:2]])


# --- key rotations ------------------------------------------------------------

_KEYS = """hk AS (SELECT series_id, frame, frame // 4 AS k, floor(value)::BIGINT % 7 AS matches, radians(roll * 0.1::DOUBLE) / 2 AS r, radians(pitch * 0.1::DOUBLE) / 2 AS p, radians(yaw * 0.02::DOUBLE) / 2 AS y FROM s WHERE frame % 4 = 0),
tk AS (SELECT series_id, frame, k, matches, cos(r)*cos(p)*cos(y) + sin(r)*sin(p)*sin(y) AS w, sin(r)*cos(p)*cos(y) - cos(r)*sin(p)*sin(y) AS x, cos(r)*sin(p)*cos(y) + sin(r)*cos(p)*sin(y) AS y, cos(r)*cos(p)*sin(y) - sin(r)*sin(p)*cos(y) AS z FROM hk),
uk AS (SELECT series_id, frame, k, CASE WHEN matches >= 3 THEN w ELSE 1e0 END AS w, CASE WHEN matches >= 3 THEN -x ELSE 0e0 END AS x, CASE WHEN matches >= 3 THEN -y ELSE 0e0 END AS y, CASE WHEN matches >= 3 THEN -z ELSE 0e0 END AS z FROM tk),
walk AS (SELECT series_id, 0::BIGINT AS k, 0::BIGINT AS frame, 1e0 AS w, 0e0 AS x, 0e0 AS y, 0e0 AS z FROM uk WHERE k = 0
  UNION ALL SELECT u.series_id, u.k, u.frame, u.w*a.w - u.x*a.x - u.y*a.y - u.z*a.z, u.w*a.x + u.x*a.w + u.y*a.z - u.z*a.y, u.w*a.y - u.x*a.z + u.y*a.w + u.z*a.x, u.w*a.z + u.x*a.y - u.y*a.x + u.z*a.w FROM walk a JOIN uk u ON u.series_id = a.series_id AND u.k = a.k + 1)"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).where("frame % 4 = 0")
    q = ro.quaternion_zyx(F.col("roll") * 0.1, F.col("pitch") * 0.1, F.col("yaw") * 0.02)
    turns = rows.select("series_id", "frame", (F.floor("value") % 7).alias("matches"), q.alias("q"))
    return tr.chained(turns.select("series_id", "frame", "matches", *[F.col("q")[p].alias(p) for p in tr.PARTS]))


@query("keyframe_chain", f"WITH RECURSIVE {SERIES}, {_KEYS} SELECT series_id, frame, {', '.join(r6_sql(p, 'q' + p) for p in tr.PARTS)} FROM walk")
def keyframe_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("series_id", "frame", *[r6(F.col(p), f"q{p}") for p in tr.PARTS])


_FILLED = """fb AS (SELECT s.series_id, s.frame, k.frame AS f0, k.w AS w0, k.x AS x0, k.y AS y0, k.z AS z0 FROM s ASOF LEFT JOIN walk k ON s.series_id = k.series_id AND s.frame >= k.frame),
fa AS (SELECT fb.*, k.frame AS f1, k.w AS w1, k.x AS x1, k.y AS y1, k.z AS z1 FROM fb ASOF LEFT JOIN walk k ON fb.series_id = k.series_id AND fb.frame <= k.frame),
fc AS (SELECT *, w0*w1 + x0*x1 + y0*y1 + z0*z1 AS d, (frame - f0)::DOUBLE / (f1 - f0) AS t FROM fa),
fd AS (SELECT *, abs(d) AS c, CASE WHEN d < 0 THEN -1 ELSE 1 END AS g FROM fc),
fe AS (SELECT *, CASE WHEN c > 0.9995::DOUBLE THEN 1 - t ELSE cos(acos(least(c, 1e0)) * t) - c * sin(acos(least(c, 1e0)) * t) / sin(acos(least(c, 1e0))) END AS u, CASE WHEN c > 0.9995::DOUBLE THEN t ELSE sin(acos(least(c, 1e0)) * t) / sin(acos(least(c, 1e0))) END AS v FROM fd),
ff AS (SELECT series_id, frame, f0, f1, c, w0, x0, y0, z0, u*w0 + v*g*w1 AS a0, u*x0 + v*g*x1 AS a1, u*y0 + v*g*y1 AS a2, u*z0 + v*g*z1 AS a3 FROM fe),
fg AS (SELECT *, CASE WHEN c > 0.9995::DOUBLE THEN sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3) ELSE 1 END AS k FROM ff),
fh AS (SELECT series_id, frame, CASE WHEN f1 > f0 THEN a0 / k ELSE w0 END AS w, CASE WHEN f1 > f0 THEN a1 / k ELSE x0 END AS x, CASE WHEN f1 > f0 THEN a2 / k ELSE y0 END AS y, CASE WHEN f1 > f0 THEN a3 / k ELSE z0 END AS z FROM fg),
fi AS (SELECT *, w * lag(w) OVER o + x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o AS e FROM fh WINDOW o AS (PARTITION BY series_id ORDER BY frame)),
fj AS (SELECT series_id, frame, w, x, y, z, CASE WHEN sum(CASE WHEN e < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame) % 2 = 1 THEN -1e0 ELSE 1e0 END AS h FROM fi),
fq AS (SELECT series_id, frame, w*h AS w, x*h AS x, y*h AS y, z*h AS z FROM fj)"""

_TURN_BACK = """n AS (SELECT series_id, frame, w, x, y, z, g_w / m AS a, g_x / m AS b, g_y / m AS c, g_z / m AS d FROM (SELECT *, sqrt(g_w*g_w + g_x*g_x + g_y*g_y + g_z*g_z) AS m FROM g)),
t AS (SELECT series_id, frame, a*w + b*x + c*y + d*z AS w, -a*x + b*w - c*z + d*y AS x, -a*y + b*z + c*w - d*x AS y, -a*z - b*y + c*x + d*w AS z FROM n)"""


@query("trajectory_correction", f"""
WITH RECURSIVE {SERIES}, {_KEYS}, {_FILLED}, {_smoothed_sql('fq', tr.PARTS, 3.0, 9, 'g')}, {_TURN_BACK}
SELECT series_id, frame, {r6_sql(_clip_sql('degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z)))'), 'yaw')}, {r6_sql(_clip_sql('degrees(asin(greatest(-1e0, least(1e0, 2*(w*y - z*x)))))'), 'pitch')}, {r6_sql(_clip_sql('degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y)))'), 'roll')} FROM t""")
def trajectory_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From key rotations to capped corrections of all frames."""
    out = tr.corrections(_keys(spark, sf_dir), series(spark, sf_dir), smoothing=9.0)
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES])


@query("matrix_euler_zyx", f"""
WITH {SERIES}, a AS (SELECT series_id, frame, {_matrix_sql('yaw', 'pitch', 'roll', 'm')} FROM s)
SELECT series_id, frame, {r6_sql('degrees(atan2(m3, m0))', 'yaw')}, {r6_sql('degrees(asin(greatest(-1e0, least(1e0, -m6))))', 'pitch')}, {r6_sql('degrees(atan2(m7, m8))', 'roll')} FROM a""")
def matrix_euler_zyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ro.matrix(*[F.col(a) for a in AXES])
    rows = series(spark, sf_dir).select("series_id", "frame", *[v.alias(f"m{i}") for i, v in enumerate(m)])
    return rows.select("series_id", "frame", *[r6(v, a) for v, a in zip(tr.euler_zyx_of([F.col(f"m{i}") for i in range(9)]), AXES, strict=True)])


@query("separated_directions")
def separated_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of each frame that lie apart; greedy, so tests/ holds it against a plain loop."""
    rows = directions(spark, sf_dir).withColumn("f", F.floor(F.col("vec_id") / 40))
    return tr.separated(rows.select("f", "vec_id", "x", "y", "z"), "f", "vec_id", ("x", "y", "z"), 20.0).select("f", "vec_id")


@query("grid_search_pair", f"""
WITH {_VEC}, g AS (SELECT i, -6 + i * 0.2::DOUBLE AS p, j, -15 + j * 1e0 AS q FROM (SELECT unnest(range(61)) AS i), (SELECT unnest(range(31)) AS j)),
c AS (SELECT label, i, j, any_value(p) AS p, any_value(q) AS q, avg(pow(x * 5 - p, 2) + pow(y * 12 - q, 2)) + 0.003::DOUBLE * any_value(q * q) AS cost FROM u, g GROUP BY label, i, j)
SELECT label, round(p, 6) + 0e0 AS first, round(q, 6) + 0e0 AS second, round(cost, 6) + 0e0 AS cost FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, i, j) = 1""")
def grid_search_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parameters on a grid of 61 x 31 for every label."""
    first, second = [-6.0 + i * 0.2 for i in range(61)], [-15.0 + j * 1.0 for j in range(31)]
    rows = directions(spark, sf_dir).select("label", "x", "y")
    out = robust.best_pair(rows, "label", first, second, F.col("x") * 5, F.col("y") * 12, lambda p, q: q * q * 0.003)
    return out.select("label", r6(F.col("first"), "first"), r6(F.col("second"), "second"), r6(F.col("cost"), "cost"))


# --- exports, stages, files ---------------------------------------------------

_VIDEOS = """c AS (SELECT series_id, frame, lat, lon, ele, frame * 3e0 + abs(value) % 2e0 AS sec FROM s),
v AS (SELECT series_id, 40e0 + series_id % 170 AS duration, CASE WHEN series_id % 3 = 0 THEN -50e0 WHEN series_id % 3 = 1 THEN 31e0 END AS start, CASE WHEN series_id % 4 = 1 THEN 40.1::DOUBLE END AS v_lat, CASE WHEN series_id % 4 = 1 THEN 20.1001::DOUBLE END AS v_lon, (series_id % 3)::DOUBLE AS shift FROM s GROUP BY series_id),
n AS (SELECT v.series_id, min(sec) AS low, max(sec) AS high, arg_min(sec, round(""" + hav_sql("v_lat", "v_lon", "lat", "lon") + """, 7) * 100000 + frame * 1e-4) AS near FROM v JOIN c USING (series_id) GROUP BY v.series_id),
win AS (SELECT v.series_id, CASE WHEN v_lat IS NOT NULL THEN near WHEN start BETWEEN low AND high THEN start ELSE low END + shift AS start, floor(CASE WHEN duration < 120 THEN 126 ELSE duration END)::INT AS length, duration < 120 AS padded FROM v JOIN n USING (series_id))"""


def _videos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fixes = series(spark, sf_dir).select("series_id", "frame", "lat", "lon", "ele", (F.col("frame") * 3.0 + F.abs("value") % 2.0).alias("sec"))
    k = F.col("series_id")
    near = lambda x: F.when(k % 4 == 1, F.lit(x))
    start = F.when(k % 3 == 0, -50.0).when(k % 3 == 1, 31.0)
    videos = fixes.select("series_id").distinct().select("series_id", (k % 170 + 40.0).alias("duration"), start.alias("start"), near(40.1).alias("lat"), near(20.1001).alias("lon"), (k % 3).cast("double").alias("shift"))
    return videos, fixes


@query("export_windows", f"WITH {SERIES}, {_VIDEOS} SELECT series_id, {r6_sql('start', 'start')}, length, padded FROM win")
def export_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.export_windows(*_videos(spark, sf_dir)).select("series_id", r6(F.col("start"), "start"), "length", "padded")


_DECIMALS = {"lat": 8, "lon": 8, "ele": 3}


@query("geo_export", f"""
WITH {SERIES}, {_VIDEOS}, gr AS (SELECT series_id, start + k AS sec, k::INT AS k FROM (SELECT series_id, start, unnest(range(length + 1)) AS k FROM win)),
b AS (SELECT gr.*, p.sec AS t0, p.lat AS lat0, p.lon AS lon0, p.ele AS ele0 FROM gr ASOF LEFT JOIN c p ON gr.series_id = p.series_id AND gr.sec >= p.sec),
f AS (SELECT b.*, p.sec AS t1, p.lat AS lat1, p.lon AS lon1, p.ele AS ele1 FROM b ASOF LEFT JOIN c p ON b.series_id = p.series_id AND b.sec <= p.sec),
h AS (SELECT *, CASE WHEN t1 - t0 > 0 THEN (sec - t0) / (t1 - t0) ELSE 0 END AS q FROM f),
e0 AS (SELECT series_id, k AS sec, {', '.join(f"round(CASE WHEN t0 IS NULL THEN {c}1 WHEN t1 IS NULL THEN {c}0 ELSE {c}0 + q * ({c}1 - {c}0) END, {d}) AS {c}" for c, d in _DECIMALS.items())} FROM h)
SELECT series_id, sec::BIGINT AS sec, round(lat + 3e-9::DOUBLE, 5) AS lat, round(lon + 3e-9::DOUBLE, 5) AS lon, round(ele + 3e-4::DOUBLE, 1) AS ele FROM e0""")
def geo_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's track at 1 Hz: start by coordinates, by time or by the track, padded; gps_smooth_pinned shows the smoothing."""
    out = track.exported(*_videos(spark, sf_dir), smooth=False)
    off = lambda c, by, d: F.round(F.col(c) + by, d).alias(c)  # noqa: E731  coarser than the decimals that are kept, and off their ties
    return out.select("series_id", F.col("sec").cast("bigint").alias("sec"), off("lat", 3e-9, 5), off("lon", 3e-9, 5), off("ele", 3e-4, 1))


_PRIOR = f"""a AS (SELECT series_id, frame, {_matrix_sql('yaw * 0.2::DOUBLE', 'pitch * 0.2::DOUBLE', 'roll * 0.2::DOUBLE', 'a')}, {_matrix_sql('yaw * 0.1::DOUBLE', 'pitch * 0.1::DOUBLE', 'roll * 0.1::DOUBLE', 'b')}, yaw, pitch, roll FROM s),
ab AS (SELECT series_id, frame, yaw, pitch, roll, {_product_sql('a', 'b', 'm')} FROM a),
e AS (SELECT series_id, frame, yaw, pitch, roll, {', '.join(f'{v} AS e_{a}' for v, a in zip(euler_sql('m'), AXES, strict=True))} FROM ab)"""


@query("effective_prior", f"WITH {SERIES}, {_PRIOR} SELECT series_id, frame, {', '.join(r6_sql(f'CASE series_id % 4 WHEN 3 THEN e_{a} WHEN 1 THEN {a} * 0.2::DOUBLE ELSE {a} * 0.1::DOUBLE END', a) for a in AXES)} FROM e WHERE series_id % 4 <> 0")
def effective_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two stages before have done: of every four series one has neither, two have one, one has both."""
    s, k = series(spark, sf_dir), F.col("series_id")
    t = (F.col("frame") / 30.0).alias("t")
    scaled = lambda on, by: s.select("series_id", t, *[F.when(on, F.col(a) * by).otherwise(0.0).alias(a) for a in AXES])
    out = stages.prior([scaled(k % 2 == 1, 0.2), scaled(k % 4 >= 2, 0.1)])
    return out.select("series_id", "frame", *[r6(F.col(a), a) for a in AXES])


@query("stage_fallback", """
WITH r AS (SELECT o_orderkey AS job, u.place, u.stage, (o_orderkey + u.place * 7) % 5 AS k FROM orders, (VALUES (1, 'vidstab'), (2, 'telemetry'), (3, 'kopf')) u(place, stage)),
t AS (SELECT job, place, stage, CASE k WHEN 0 THEN 'NO (UNSTABILIZED)' WHEN 1 THEN 'Degraded: slightly' WHEN 2 THEN 'YES' WHEN 3 THEN '' ELSE 'STATUS unknown' END AS status, k IN (0, 1) AS reverted FROM r)
SELECT job, place, stage, status, reverted, coalesce(last_value(CASE WHEN NOT reverted THEN 'out' || place::VARCHAR END IGNORE NULLS) OVER (PARTITION BY job ORDER BY place), 'source') AS current FROM t""")
def stage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage")) for i, n in enumerate(("vidstab", "telemetry", "kopf"), 1)])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.inline(stage))
    k = (F.col("job") + F.col("place") * 7) % 5
    report = F.when(k == 0, "REPORT\nSTATUS : NO (UNSTABILIZED)\nSTATUS: YES").when(k == 1, "STATUS: Degraded: slightly\n").when(k == 2, "x\nSTATUS:YES").when(k == 3, "no state").otherwise("STATUS unknown")
    rows = rows.select("job", "place", "stage", F.lit("source").alias("input"), F.concat(F.lit("out"), F.col("place").cast("string")).alias("output"), report.alias("report"))
    return catalog.fallback(rows, "job").select("job", "place", "stage", "status", "reverted", "current")


@query("warmup_arbitration", """
WITH v AS (SELECT o_orderkey AS video, CASE WHEN o_orderkey % 3 = 0 THEN 25e0 ELSE 30e0 END AS fps, 50 + o_orderkey % 40 AS total, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 70 END AS tf, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 7 % 70 END AS vf,
  CASE o_orderkey % 3 WHEN 0 THEN 'visual_black' WHEN 1 THEN 'visual_frozen' ELSE 'visual_blur' END AS vk FROM orders),
c AS (SELECT *, tf IS NULL OR coalesce(vk <> 'visual_blur' AND vf > tf, false) AS wins FROM v),
d AS (SELECT *, CASE WHEN wins THEN vf ELSE tf END AS f FROM c)
SELECT video, coalesce(f > 0, false) AS has_warmup, (CASE WHEN f > 0 THEN least(f, total - 1) ELSE 0 END)::BIGINT AS start_frame, round(CASE WHEN f > 0 THEN least(f, total - 1) / fps ELSE 0 END, 3) AS start_time, CASE WHEN f > 0 THEN CASE WHEN wins THEN vk ELSE 'telemetry' END ELSE 'none' END AS kind FROM d""")
def warmup_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    videos = o.select(k.alias("video"), F.when(k % 3 == 0, 25.0).otherwise(30.0).alias("fps"), (k % 40 + 50).alias("total_frames"))
    telemetry = o.where("o_orderkey % 2 = 0").select(k.alias("video"), (k % 70).alias("start_frame"), F.lit("telemetry").alias("kind"))
    visual = o.where("o_orderkey % 5 <> 0").select(k.alias("video"), (k * 7 % 70).alias("start_frame"), F.when(k % 3 == 0, "visual_black").when(k % 3 == 1, "visual_frozen").otherwise("visual_blur").alias("kind"))
    return catalog.warmup(videos, telemetry, visual, "video")


@query("positional_pairs", f"WITH {SERIES}, a AS (SELECT series_id, roll, row_number() OVER (PARTITION BY series_id ORDER BY frame) AS place FROM s WHERE frame % 2 = 0), b AS (SELECT series_id, pitch, row_number() OVER (PARTITION BY series_id ORDER BY frame) AS place FROM s WHERE frame % 3 <> 0) SELECT series_id, place::INT AS place, {r6_sql('roll', 'raw')}, {r6_sql('pitch', 'stabilised')} FROM a JOIN b USING (series_id, place)")
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series side by side by place, cut to the shorter one."""
    s = series(spark, sf_dir)
    a, b = s.where("frame % 2 = 0").select("series_id", "frame", F.col("roll").alias("v")), s.where("frame % 3 <> 0").select("series_id", "frame", F.col("pitch").alias("v"))
    return joins.by_position(a, b, "series_id", "frame", ["v"]).select("series_id", "place", r6(F.col("v_a"), "raw"), r6(F.col("v_b"), "stabilised"))


@query("fresh_artifacts", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true ELSE o_orderkey % 100 >= o_custkey % 100 - 5 END AS fresh FROM orders WHERE o_custkey IS NOT NULL")
def fresh_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    began = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 100)
    return table(spark, sf_dir, "orders").where("o_custkey is not null").select("o_orderkey", catalog.fresh(F.col("o_orderkey") % 100, began).alias("fresh"))


@query("seeded_sample", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey) <= 5")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders of each customer, the same ones for the same seed."""
    return catalog.sampled(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5, 42)


@query("even_times", f"WITH {SERIES}, d AS (SELECT series_id, count(*) / 30e0 AS duration FROM s GROUP BY series_id) SELECT series_id, k::INT AS place, {r6_sql('k * duration / 9e0', 'time')} FROM d, (SELECT unnest(range(1, 9)) AS k)")
def even_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = series(spark, sf_dir).groupBy("series_id").agg((F.count(F.lit(1)) / 30.0).alias("duration"))
    return checkpoints.even_times(videos, 8).select("series_id", "place", r6(F.col("time"), "time"))


@query("preferred_checkpoints", f"WITH {SERIES} SELECT series_id, frame, CASE WHEN series_id % 3 = 0 THEN 'telemetry' ELSE 'motion' END AS source FROM s WHERE CASE WHEN series_id % 3 = 0 THEN frame % 10 = 0 ELSE frame % 15 = 0 END")
def preferred_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry's checkpoints where a series has telemetry, else those of its motion."""
    s = series(spark, sf_dir)
    of = lambda rows, name: rows.select("series_id", "frame", F.lit(name).alias("source"))
    return checkpoints.preferred(of(s.where("series_id % 3 = 0 and frame % 10 = 0"), "telemetry"), of(s.where("frame % 15 = 0"), "motion"))


@query("safe_numbers", "SELECT o_orderkey, coalesce(try_cast(CASE o_orderkey % 4 WHEN 0 THEN ' ' || (o_orderkey % 90)::VARCHAR || '.5 ' WHEN 1 THEN 'n/a' WHEN 2 THEN (o_orderkey % 7)::VARCHAR || 'e1' END AS DOUBLE), 30) AS value FROM orders")
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as typed, 30 where they are no numbers."""
    k = F.col("o_orderkey")
    typed = F.when(k % 4 == 0, F.concat(F.lit(" "), (k % 90).cast("string"), F.lit(".5 "))).when(k % 4 == 1, "n/a").when(k % 4 == 2, F.concat((k % 7).cast("string"), F.lit("e1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.safe_number(typed, 30.0).alias("value"))


@query("status_tail", f"WITH {SERIES} SELECT series_id, frame FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY frame DESC) <= 5")
def status_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five lines of each log."""
    return tracks.tail(series(spark, sf_dir).select("series_id", "frame"), "series_id", "frame", 5)


@query("numbered_checkpoints", f"WITH {SERIES} SELECT series_id, frame // 3 AS frame, frame AS place, row_number() OVER (PARTITION BY series_id ORDER BY frame // 3, frame)::INT AS number FROM s")
def numbered_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints by frame, those of one frame in the order they came in."""
    rows = series(spark, sf_dir).select("series_id", F.floor(F.col("frame") / 3).alias("frame"), F.col("frame").alias("place"))
    return checkpoints.numbered(rows).select("series_id", "frame", "place", "number")


@query("backwards_levelling", f"WITH {SERIES} SELECT series_id, frame, {r6_sql('(roll - avg(roll) OVER (PARTITION BY series_id)) * CASE WHEN series_id % 2 = 0 THEN -1.5::DOUBLE ELSE 1.5::DOUBLE END', 'roll')} FROM s")
def backwards_levelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levelling corrections; every other camera is mounted backwards."""
    rows = series(spark, sf_dir).withColumn("mean", F.avg("roll").over(Window.partitionBy("series_id")))
    turned = lambda back: angles.level_delta(F.col("roll"), F.col("mean"), 1.5, back)
    return rows.select("series_id", "frame", r6(F.when(F.col("series_id") % 2 == 0, turned(True)).otherwise(turned(False)), "roll"))
