"""Queries on rotations: quaternions, matrices, directions on the sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles as an
from ..functions import rotation as ro
from ..operators import series as op
from .carriers import SERIES, r6, r6_sql, series, table, wrap_sql
from .registry import query

_HALF = ", ".join(f"{f}(radians({a}) / 2) AS {f[0]}{a[0]}" for a in ("roll", "pitch", "yaw") for f in ("cos", "sin"))
_ZYX = f"{SERIES}, h AS (SELECT *, {_HALF} FROM s), q AS (SELECT *, cr*cp*cy + sr*sp*sy AS w, sr*cp*cy - cr*sp*sy AS x, cr*sp*cy + sr*cp*sy AS y, cr*cp*sy - sr*sp*cy AS z FROM h)"
_YXZ = f"{SERIES}, h AS (SELECT *, {_HALF} FROM s), q AS (SELECT *, cy*cp*cr + sy*sp*sr AS w, cy*sp*cr + sy*cp*sr AS x, sy*cp*cr - cy*sp*sr AS y, cy*cp*sr - sy*sp*cr AS z FROM h)"


@query("euler_quat_roundtrip", f"""
WITH {_ZYX} SELECT series_id, frame, {', '.join(r6_sql(v, 'q' + v) for v in 'wxyz')},
 {r6_sql('degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y)))', 'roll')}, {r6_sql('degrees(asin(greatest(-1e0, least(1e0, 2*(w*y - z*x)))))', 'pitch')}, {r6_sql('degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z)))', 'yaw')} FROM q""")
def euler_quat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", ro.quaternion_zyx(F.col("roll"), F.col("pitch"), F.col("yaw")).alias("q"))
    q = F.col("q")
    return rows.select("series_id", "frame", *[r6(q[n], f"q{n}") for n in "wxyz"], *[r6(v, n) for v, n in zip(ro.euler_zyx(q), ("roll", "pitch", "yaw"), strict=True)])


@query("camera_quat_roundtrip", f"""
WITH {_YXZ} SELECT series_id, frame, {', '.join(r6_sql(v, 'q' + v) for v in 'wxyz')},
 {r6_sql('degrees(atan2(2*(w*z + x*y), 1 - 2*(x*x + z*z)))', 'roll')}, {r6_sql('degrees(asin(greatest(-1e0, least(1e0, 2*(w*x - y*z)))))', 'pitch')}, {r6_sql('degrees(atan2(2*(w*y + x*z), 1 - 2*(x*x + y*y)))', 'yaw')} FROM q""")
def camera_quat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("series_id", "frame", ro.quaternion_yxz(F.col("yaw"), F.col("pitch"), F.col("roll")).alias("q"))
    q = F.col("q")
    return rows.select("series_id", "frame", *[r6(q[n], f"q{n}") for n in "wxyz"], *[r6(v, n) for v, n in zip(ro.euler_yxz(q), ("yaw", "pitch", "roll"), strict=True)])


@query("slerp_midpoint", f"""
WITH {_YXZ}, p AS (SELECT series_id, frame, w, x, y, z, lead(w) OVER o AS w1, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(z) OVER o AS z1 FROM q WINDOW o AS (PARTITION BY series_id ORDER BY frame)),
d AS (SELECT *, w*w1 + x*x1 + y*y1 + z*z1 AS d FROM p WHERE w1 IS NOT NULL),
t AS (SELECT *, abs(d) AS c, CASE WHEN d < 0 THEN -1 ELSE 1 END AS g FROM d),
f AS (SELECT *, CASE WHEN c > 0.9995::DOUBLE THEN 0.7::DOUBLE ELSE cos(acos(least(c, 1e0)) * 0.3::DOUBLE) - c * sin(acos(least(c, 1e0)) * 0.3::DOUBLE) / sin(acos(least(c, 1e0))) END AS u,
  CASE WHEN c > 0.9995::DOUBLE THEN 0.3::DOUBLE ELSE sin(acos(least(c, 1e0)) * 0.3::DOUBLE) / sin(acos(least(c, 1e0))) END AS v FROM t),
m AS (SELECT *, u*w + v*g*w1 AS a0, u*x + v*g*x1 AS a1, u*y + v*g*y1 AS a2, u*z + v*g*z1 AS a3 FROM f),
n AS (SELECT *, CASE WHEN c > 0.9995::DOUBLE THEN sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3) ELSE 1 END AS k FROM m)
SELECT series_id, frame, {', '.join(r6_sql(f'a{i} / k', f'q{c}') for i, c in enumerate('wxyz'))} FROM n""")
def slerp_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ro.quaternion_yxz(F.col("yaw"), F.col("pitch"), F.col("roll")).alias("q")
    rows = series(spark, sf_dir).select("series_id", "frame", q).withColumn("q1", F.lead("q").over(op.ordered())).where("q1 is not null")
    rows = rows.select("series_id", "frame", ro.slerp(F.col("q"), F.col("q1"), 0.3).alias("m"))
    return rows.select("series_id", "frame", *[r6(F.col("m")[n], f"q{n}") for n in "wxyz"])


@query("nlerp_hemisphere", f"""
WITH {_YXZ}, p AS (SELECT *, lag(w) OVER o AS w0, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lag(z) OVER o AS z0 FROM q WINDOW o AS (PARTITION BY series_id ORDER BY frame)),
e AS (SELECT *, CASE WHEN sum(CASE WHEN w*w0 + x*x0 + y*y0 + z*z0 < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame) % 2 = 1 THEN -1 ELSE 1 END AS g FROM p),
b AS (SELECT *, CASE WHEN w*w0 + x*x0 + y*y0 + z*z0 < 0 THEN -1 ELSE 1 END AS k FROM e),
c AS (SELECT series_id, frame, g, w0 + 0.25::DOUBLE*(w*k - w0) AS a0, x0 + 0.25::DOUBLE*(x*k - x0) AS a1, y0 + 0.25::DOUBLE*(y*k - y0) AS a2, z0 + 0.25::DOUBLE*(z*k - z0) AS a3 FROM b WHERE w0 IS NOT NULL)
SELECT series_id, frame, g::BIGINT AS side, {', '.join(r6_sql(f'a{i} / sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3)', f'q{c}') for i, c in enumerate('wxyz'))} FROM c""")
def nlerp_hemisphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ro.quaternion_yxz(F.col("yaw"), F.col("pitch"), F.col("roll")).alias("q")
    rows = series(spark, sf_dir).select("series_id", "frame", q).withColumn("q0", F.lag("q").over(op.ordered()))
    rows = rows.withColumn("side", op.hemisphere_sign(ro.dot(F.col("q"), F.col("q0")))).where("q0 is not null")
    rows = rows.select("series_id", "frame", F.col("side").cast("bigint").alias("side"), ro.nlerp(F.col("q0"), F.col("q"), 0.25).alias("m"))
    return rows.select("series_id", "frame", "side", *[r6(F.col("m")[n], f"q{n}") for n in "wxyz"])


def _matrix_sql(y: str, p: str, r: str, name: str) -> str:
    cy, sy, cp, sp, cr, sr = (f"{f}(radians({a}))" for a in (y, p, r) for f in ("cos", "sin"))
    cells = (f"{cy}*{cr} - {sy}*{sp}*{sr}", f"-{sr}*{cp}", f"{sy}*{cr} + {cy}*{sp}*{sr}", f"{cy}*{sr} + {sy}*{sp}*{cr}", f"{cr}*{cp}", f"{sy}*{sr} - {cy}*{sp}*{cr}", f"-{sy}*{cp}", sp, f"{cy}*{cp}")
    return ", ".join(f"{c} AS {name}{i}" for i, c in enumerate(cells))


def _product_sql(a: str, b: str, out: str) -> str:
    return ", ".join(f"{a}{3 * i}*{b}{j} + {a}{3 * i + 1}*{b}{3 + j} + {a}{3 * i + 2}*{b}{6 + j} AS {out}{3 * i + j}" for i in range(3) for j in range(3))


def euler_sql(m: str) -> tuple[str, str, str]:
    """yaw, pitch, roll of a matrix in columns m0 to m8."""
    free = f"cos(asin(greatest(-1e0, least(1e0, {m}7)))) > 1e-6"
    return (f"degrees(CASE WHEN {free} THEN atan2(-{m}6, {m}8) ELSE atan2({m}2, {m}0) END)", f"degrees(asin(greatest(-1e0, least(1e0, {m}7))))", f"degrees(CASE WHEN {free} THEN atan2(-{m}1, {m}4) ELSE 0 END)")


_COMPOSED = f"""a AS (SELECT series_id, frame, {_matrix_sql('yaw', 'pitch', 'roll', 'a')}, {_matrix_sql('roll', 'roll * 0.5::DOUBLE', 'pitch', 'b')}, {_matrix_sql('pitch', '0e0', 'pitch * 2', 'c')} FROM s),
ab AS (SELECT *, {_product_sql('a', 'b', 'd')} FROM a), abc AS (SELECT series_id, frame, {_product_sql('d', 'c', 'm')} FROM ab)"""


@query("rot_matrix_compose3", f"WITH {SERIES}, {_COMPOSED} SELECT series_id, frame, {', '.join(r6_sql(v, n) for v, n in zip(euler_sql('m'), ('yaw', 'pitch', 'roll'), strict=True))} FROM abc")
def rot_matrix_compose3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rotations composed from left to right."""
    y, p, r = F.col("yaw"), F.col("pitch"), F.col("roll")
    steps = (ro.matrix(y, p, r), ro.matrix(r, r * 0.5, p), ro.matrix(p, 0.0, p * 2.0))
    names = [[f"{n}{i}" for i in range(9)] for n in "abc"]
    rows = series(spark, sf_dir).select("series_id", "frame", *[c.alias(x) for cells, ns in zip(steps, names, strict=True) for c, x in zip(cells, ns, strict=True)])
    a, b, c = ([F.col(x) for x in ns] for ns in names)
    first = rows.select("series_id", "frame", *[v.alias(f"d{i}") for i, v in enumerate(ro.product(a, b))], *c)
    total = first.select("series_id", "frame", *[v.alias(f"m{i}") for i, v in enumerate(ro.product([F.col(f"d{i}") for i in range(9)], c))])
    m = [F.col(f"m{i}") for i in range(9)]
    return total.select("series_id", "frame", *[r6(v, n) for v, n in zip(ro.euler(m), ("yaw", "pitch", "roll"), strict=True)])


_TRIG = ", ".join(f"{f}(radians({a})) AS {f[0]}{a[0]}" for a in ("yaw", "pitch", "roll") for f in ("cos", "sin"))
_ZYX = ("cy*cp", "cy*sp*sr - sy*cr", "cy*sp*cr + sy*sr", "sy*cp", "sy*sp*sr + cy*cr", "sy*sp*cr - cy*sr", "-sp", "cp*sr", "cp*cr")
_YXZ = ("cy*cr + sy*sp*sr", "sy*sp*cr - cy*sr", "sy*cp", "cp*sr", "cp*cr", "-sp", "cy*sp*sr - sy*cr", "sy*sr + cy*sp*cr", "cy*cp")


@query("matrix_orders", f"WITH {SERIES}, t AS (SELECT series_id, frame, {_TRIG} FROM s) SELECT series_id, frame, {', '.join(r6_sql(v, f'a{i}') for i, v in enumerate(_ZYX))}, {', '.join(r6_sql(v, f'c{i}') for i, v in enumerate(_YXZ))} FROM t")
def matrix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of the same angles in aerospace order and in a camera's."""
    roll, pitch, yaw = F.col("roll"), F.col("pitch"), F.col("yaw")
    air, camera = ro.matrix_in_order("zyx", x=roll, y=pitch, z=yaw), ro.matrix_in_order("yxz", y=yaw, x=pitch, z=roll)
    return series(spark, sf_dir).select("series_id", "frame", *[r6(v, f"a{i}") for i, v in enumerate(air)], *[r6(v, f"c{i}") for i, v in enumerate(camera)])


@query("rotation_difference", f"""
WITH {SERIES}, a AS (SELECT series_id, frame, {_matrix_sql('yaw', 'pitch', 'roll', 'a')}, {_matrix_sql('yaw * 0.9::DOUBLE', 'pitch * 0.8::DOUBLE', 'roll * 0.7::DOUBLE', 'b')} FROM s),
t AS (SELECT series_id, frame, {', '.join(f'a{3 * j + i} AS t{3 * i + j}' for i in range(3) for j in range(3))}, {', '.join(f'b{i}' for i in range(9))} FROM a),
m AS (SELECT series_id, frame, {_product_sql('t', 'b', 'm')} FROM t)
SELECT series_id, frame, {r6_sql('degrees(atan2(m2, m8))', 'yaw')}, {r6_sql('degrees(atan2(m5, sqrt(m2*m2 + m8*m8)))', 'pitch')}, {r6_sql('-degrees(atan2(m3, m4))', 'roll')}, {r6_sql('degrees(acos(greatest(-1e0, least(1e0, (m0 + m4 + m8 - 1) / 2))))', 'angle')} FROM m""")
def rotation_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the raw orientation into the smooth one, in the tracked convention, and its whole angle."""
    y, p, r = F.col("yaw"), F.col("pitch"), F.col("roll")
    rows = series(spark, sf_dir).select("series_id", "frame", *[c.alias(f"a{i}") for i, c in enumerate(ro.matrix(y, p, r))], *[c.alias(f"b{i}") for i, c in enumerate(ro.matrix(y * 0.9, p * 0.8, r * 0.7))])
    step = ro.product(ro.transposed([F.col(f"a{i}") for i in range(9)]), [F.col(f"b{i}") for i in range(9)])
    rows = rows.select("series_id", "frame", *[c.alias(f"m{i}") for i, c in enumerate(step)])
    m = [F.col(f"m{i}") for i in range(9)]
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1.0) / 2.0))))
    return rows.select("series_id", "frame", *[r6(v, n) for v, n in zip(ro.euler_tracked(m), ("yaw", "pitch", "roll"), strict=True)], r6(angle, "angle"))


@query("axis_angle_roundtrip", f"WITH {SERIES} SELECT series_id, frame, {r6_sql('roll / 40', 'x')}, {r6_sql('pitch / 40', 'y')}, {r6_sql('yaw / 120', 'z')} FROM s")
def axis_angle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation vectors turned into matrices and back."""
    m = ro.axis_angle_matrix(F.col("roll") / 40.0, F.col("pitch") / 40.0, F.col("yaw") / 120.0)
    rows = series(spark, sf_dir).select("series_id", "frame", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    back = ro.matrix_axis_angle([F.col(f"m{i}") for i in range(9)])
    return rows.select("series_id", "frame", *[r6(v, n) for v, n in zip(back, "xyz", strict=True)])


@query("angle_wraps", f"""
WITH {SERIES}, v AS (SELECT series_id, frame, floor(yaw / 60) * 60 * 3 AS a FROM s)
SELECT series_id, frame, {r6_sql(wrap_sql('a'), 'half_open')}, {r6_sql(f"CASE WHEN a BETWEEN -180 AND 180 THEN a WHEN {wrap_sql('a')} = -180 AND a > 0 THEN 180 ELSE {wrap_sql('a')} END", 'closed')}, {r6_sql('CASE WHEN a > 180 THEN a - 360 WHEN a < -180 THEN a + 360 ELSE a END', 'one_step')} FROM v""")
def angle_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.floor(F.col("yaw") / 60.0).cast("double") * 180.0
    return series(spark, sf_dir).select("series_id", "frame", r6(an.wrap180(a), "half_open"), r6(an.wrap180_closed(a), "closed"), r6(an.step_wrap(a), "one_step"))


@query("gravity_tilt", f"""
WITH {SERIES}, g AS (SELECT series_id, frame, -sin(radians(pitch)) AS ax, sin(radians(roll)) * cos(radians(pitch)) AS ay, cos(radians(roll)) * cos(radians(pitch)) AS az FROM s)
SELECT series_id, frame, {r6_sql('-ax', 'log_x')}, {r6_sql('-ay', 'log_y')}, {r6_sql('degrees(atan2(ay, az + 1e-8))', 'roll')}, {r6_sql('degrees(atan2(-ax, sqrt(ay*ay + az*az) + 1e-8))', 'pitch')} FROM g""")
def gravity_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ax, ay, az = an.gravity_camera(F.col("roll"), F.col("pitch"))
    lx, ly, _ = an.gravity_log(F.col("roll"), F.col("pitch"))
    roll, pitch = an.tilt_of_gravity(ax, ay, az)
    return series(spark, sf_dir).select("series_id", "frame", r6(lx, "log_x"), r6(ly, "log_y"), r6(roll, "roll"), r6(pitch, "pitch"))


_VEC = "v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT *, sqrt(x*x + y*y + z*z) AS k FROM v), u AS (SELECT vec_id, label, x / k AS x, y / k AS y, z / k AS z FROM n WHERE k > 0)"


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the first three numbers of every embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    k = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return e.withColumn("k", k).where("k > 0").select("vec_id", "label", *[(F.col(n) / F.col("k")).alias(n) for n in "xyz"])


@query("octant_histogram", f"""
WITH {_VEC}, o AS (SELECT (x >= 0)::INT + 2 * (y >= 0)::INT + 4 * (z >= 0)::INT AS octant FROM u)
SELECT r.octant::INT AS octant, count(o.octant)::BIGINT AS vectors FROM (SELECT unnest(range(8)) AS octant) r LEFT JOIN o ON o.octant = r.octant GROUP BY r.octant""")
def octant_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = directions(spark, sf_dir).groupBy(ro.octant(F.col("x"), F.col("y"), F.col("z")).alias("octant")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(8).select(F.col("id").cast("int").alias("octant"))
    return every.join(found, "octant", "left").select("octant", F.coalesce("n", F.lit(0)).cast("bigint").alias("vectors"))


@query("axis_softmax_weights", f"""
WITH {_VEC}, e AS (SELECT vec_id, {', '.join(f'exp(greatest(-50, least(50, 5 * ({v})))) AS e{i}' for i, v in enumerate(('x', '-x', 'y', '-y', 'z', '-z')))} FROM u)
SELECT vec_id, {', '.join(r6_sql(f'e{i} / (e0 + e1 + e2 + e3 + e4 + e5)', f'w{i}') for i in range(6))} FROM e""")
def axis_softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ro.axis_weights(F.col("x"), F.col("y"), F.col("z"))
    return directions(spark, sf_dir).select("vec_id", *[r6(v, f"w{i}") for i, v in enumerate(w)])


@query("pixel_directions", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, 2 * pi() * ((value * 4) / 1920) - pi() AS lon, pi() / 2 - pi() * ((roll + 30) * 16 / 960) AS lat FROM s)
SELECT series_id, frame, {r6_sql('cos(lat) * sin(lon)', 'x')}, {r6_sql('sin(lat)', 'y')}, {r6_sql('cos(lat) * cos(lon)', 'z')} FROM p""")
def pixel_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ro.pixel_direction(F.col("value") * 4.0, (F.col("roll") + 30.0) * 16.0, 1920.0, 960.0)
    return series(spark, sf_dir).select("series_id", "frame", *[r6(c, n) for c, n in zip(v, "xyz", strict=True)])


@query("robust_and_lens", f"""
WITH {SERIES}, t AS (SELECT series_id, frame, roll * roll AS s2, radians(abs(pitch)) AS th FROM s)
SELECT series_id, frame, {r6_sql('4 * ln(1 + s2 / 4)', 'loss')}, {r6_sql('th * (1 + 0.02::DOUBLE * th*th - 0.003::DOUBLE * th*th*th*th)', 'radius')} FROM t""")
def robust_and_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = ro.cauchy_loss(F.col("roll") * F.col("roll"), 4.0)
    radius = ro.fisheye_radius(F.radians(F.abs("pitch")), (0.02, -0.003))
    return series(spark, sf_dir).select("series_id", "frame", r6(loss, "loss"), r6(radius, "radius"))
