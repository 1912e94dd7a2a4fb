"""Queries of fits, searches over grids, and feature matching."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robust
from .carriers import SERIES, r6, r6_sql, series, table
from .registry import query
from .rotations import _VEC, directions


def _ridge_sql(rows: str, out: str) -> str:
    return f"{out} AS (SELECT k, count(*) AS n, sum(w*w*a1*a1) + 25 AS p, sum(w*w*a2*a2) + 25 AS q, sum(w*w*a1*a2) AS o, sum(w*w*a1*b) AS t1, sum(w*w*a2*b) AS t2 FROM {rows} GROUP BY k HAVING count(*) >= 3)"


@query("ridge_fit", f"""
WITH {SERIES}, r AS (SELECT series_id AS k, -cos(radians(yaw)) AS a1, sin(radians(yaw)) AS a2, -1.2::DOUBLE * cos(radians(yaw)) + 0.7::DOUBLE * sin(radians(yaw)) + roll * 0.08::DOUBLE AS b, 1 + pitch * 0.01::DOUBLE AS w FROM s),
{_ridge_sql('r', 'f')}, u AS (SELECT k, (q*t1 - o*t2) / (p*q - o*o) AS u1, (p*t2 - o*t1) / (p*q - o*o) AS u2 FROM f),
c AS (SELECT r.* FROM r JOIN u USING (k) WHERE abs(a1*u1 + a2*u2 - b) < 2), {_ridge_sql('c', 'g')},
v AS (SELECT k, (q*t1 - o*t2) / (p*q - o*o) AS v1, (p*t2 - o*t1) / (p*q - o*o) AS v2 FROM g)
SELECT k AS series_id, {r6_sql('coalesce(v1, u1)', 'x1')}, {r6_sql('coalesce(v2, u2)', 'x2')} FROM u LEFT JOIN v USING (k)""")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = F.radians("yaw")
    b = -1.2 * F.cos(phi) + 0.7 * F.sin(phi) + F.col("roll") * 0.08
    out = robust.ridge2(series(spark, sf_dir), "series_id", -F.cos(phi), F.sin(phi), b, 1.0 + F.col("pitch") * 0.01)
    return out.select("series_id", r6(F.col("x1"), "x1"), r6(F.col("x2"), "x2"))


@query("sinusoid_fit", f"""
WITH {SERIES}, r AS (SELECT series_id, cos(radians(yaw)) AS c, sin(radians(yaw)) AS s, 200 + 7 * cos(radians(yaw)) - 3 * sin(radians(yaw)) + roll * 0.1::DOUBLE AS y FROM s),
m AS (SELECT series_id, count(*)::DOUBLE AS n, sum(c) AS c1, sum(s) AS s1, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(y) AS y1, sum(c*y) AS cy, sum(s*y) AS sy FROM r GROUP BY series_id),
d AS (SELECT *, n*(cc*ss - cs*cs) - c1*(c1*ss - cs*s1) + s1*(c1*cs - cc*s1) AS w FROM m),
f AS (SELECT series_id, (y1*(cc*ss - cs*cs) - c1*(cy*ss - cs*sy) + s1*(cy*cs - cc*sy)) / w AS m0, (n*(cy*ss - cs*sy) - y1*(c1*ss - cs*s1) + s1*(c1*sy - cy*s1)) / w AS mc, (n*(cc*sy - cy*cs) - c1*(c1*sy - cy*s1) + y1*(c1*cs - cc*s1)) / w AS ms FROM d)
SELECT series_id, {r6_sql('m0', 'mean')}, {r6_sql('mc', 'cosine')}, {r6_sql('ms', 'sine')}, round(sqrt(avg(pow(y - m0 - mc*c - ms*s, 2))), 4) + 0e0 AS rmse FROM r JOIN f USING (series_id) GROUP BY series_id, m0, mc, ms""")
def sinusoid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.radians("yaw")
    y = 200.0 + 7.0 * F.cos(a) - 3.0 * F.sin(a) + F.col("roll") * 0.1
    out = robust.sinusoid(series(spark, sf_dir), "series_id", a, y)
    return out.select("series_id", *[r6(F.col(c), c) for c in ("mean", "cosine", "sine")], (F.round("rmse", 4) + 0.0).alias("rmse"))


_GRID = [i * 0.5 for i in range(-10, 11)]


@query("grid_search_argmin", f"""
WITH {_VEC}, g AS (SELECT i AS place, (i - 10) * 0.5e0 AS p FROM (SELECT unnest(range(21)) AS i)),
c AS (SELECT label, place, p, avg(abs(x * 3 + 0.1::DOUBLE * label - p) + 0.01::DOUBLE * y) AS cost FROM u, g GROUP BY ALL)
SELECT label, p AS parameter, {r6_sql('cost', 'cost')} FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, place) = 1""")
def grid_search_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = lambda p: F.abs(F.col("x") * 3.0 + 0.1 * F.col("label") - p) + 0.01 * F.col("y")
    return robust.best_parameter(directions(spark, sf_dir), "label", _GRID, cost).select("label", "parameter", r6(F.col("cost"), "cost"))


_ROUND = "{n}g AS (SELECT {b} + (i - {k}) * {step}::DOUBLE AS p, i, m FROM {source}, (SELECT unnest(range({count})) AS i)), {n} AS (SELECT arg_min(p, row(round(p * p - 2 * m * p, 9), i)) AS b, any_value(m) AS m FROM {n}g)"


@query("grid_refined", f"""
WITH {_VEC}, m AS (SELECT avg(x * 3) AS m FROM u),
{_ROUND.format(n='a', b='0e0', k=5, step=1, count=11, source='m')}, {_ROUND.format(n='b', b='b', k=5, step='0.2', count=11, source='a')}, {_ROUND.format(n='c', b='b', k=5, step='0.04', count=11, source='b')}
SELECT round(b, 6) AS parameter FROM c""")
def grid_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of a search that narrows; the loop runs on the driver over one number a round."""
    rows = directions(spark, sf_dir)
    best = robust.refined(rows, "label", (-5.0, 5.0, 1.0), lambda p: (F.col("x") * 3.0 - p) * (F.col("x") * 3.0 - p))
    return spark.range(1).select(F.round(F.lit(best), 6).alias("parameter"))


_BITS = " + ".join(f"(CASE WHEN embedding[{i + 1}] >= 0 THEN {1 << i} ELSE 0 END)" for i in range(32))
_MATCHES = f"""d AS (SELECT vec_id, vec_id // 40 AS f, ({_BITS})::BIGINT AS b FROM embeddings),
p AS (SELECT l.f, l.vec_id AS l, r.vec_id AS r, bit_count(xor(l.b, r.b))::INT AS distance FROM d l JOIN d r ON l.f = r.f WHERE l.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l ORDER BY distance, r) = 1 AND row_number() OVER (PARTITION BY r ORDER BY distance, l) = 1)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = [F.when(F.col("embedding")[i] >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(32)]
    total = bit[0]
    for b in bit[1:]:
        total = total + b
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 40).alias("f"), total.alias("bits"))
    return robust.mutual_nearest(d.where("vec_id % 2 = 0"), d.where("vec_id % 2 = 1"), "f", "bits", "vec_id", width=32)


@query("mutual_nearest", f"WITH {_MATCHES} SELECT f, l, r, distance FROM m")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


@query("match_median", f"""
WITH {_MATCHES}, t AS (SELECT f, (l * 7 % 31)::DOUBLE * (1 + 0.5::DOUBLE * greatest(0, (20 - r % 40) / 20e0)) AS v FROM m QUALIFY row_number() OVER (PARTITION BY f ORDER BY distance, l) <= 6)
SELECT f, {r6_sql('median(v)', 'shift')}, count(*)::BIGINT AS n FROM t GROUP BY f""")
def match_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median shift of each frame's best matches, those near the ground weighing more."""
    weight = 1.0 + 0.5 * F.greatest(F.lit(0.0), (20.0 - F.col("r") % 40) / 20.0)
    m = _matches(spark, sf_dir).withColumn("shift", (F.col("l") * 7 % 31).cast("double") * weight)
    return robust.best_median(m, "f", "shift", "distance", "l", 6).select("f", r6(F.col("shift"), "shift"), "n")


@query("seam_report", f"""
WITH {_MATCHES}, v AS (SELECT f // 3 AS video, f, avg(distance) AS mean, count(*) AS n FROM m GROUP BY ALL)
SELECT video, {r6_sql('avg(mean)', 'mean_distance')}, sum(n)::BIGINT AS matches, CASE WHEN sum(n) >= 30 THEN 'HIGH' WHEN sum(n) >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM v GROUP BY video""")
def seam_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of frame means by video, and how far it can be trusted."""
    frames = _matches(spark, sf_dir).groupBy(F.floor(F.col("f") / 3).alias("video"), "f").agg(F.avg("distance").alias("mean"), F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return frames.groupBy("video").agg(r6(F.avg("mean"), "mean_distance"), n.alias("matches"), F.when(n >= 30, "HIGH").when(n >= 15, "MEDIUM").otherwise("LOW").alias("confidence"))


_TURN = (math.cos(0.3), math.sin(0.3))


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, and the same turned by 0.3 rad about the vertical; one in nine is wrong."""
    c, s = _TURN
    d = directions(spark, sf_dir).withColumn("f", F.floor(F.col("vec_id") / 40))
    wrong = F.col("vec_id") % 9 == 0
    return d.withColumns({"ax": F.when(wrong, F.col("y")).otherwise(c * F.col("x") - s * F.col("y")), "ay": F.when(wrong, F.col("z")).otherwise(s * F.col("x") + c * F.col("y")), "az": F.when(wrong, F.col("x")).otherwise(F.col("z"))})


_TURNED = f"""{_VEC}, t AS (SELECT vec_id // 40 AS f, x, y, z, CASE WHEN vec_id % 9 = 0 THEN y ELSE {_TURN[0]:.17g}::DOUBLE * x - {_TURN[1]:.17g}::DOUBLE * y END AS ax, CASE WHEN vec_id % 9 = 0 THEN z ELSE {_TURN[1]:.17g}::DOUBLE * x + {_TURN[0]:.17g}::DOUBLE * y END AS ay, CASE WHEN vec_id % 9 = 0 THEN x ELSE z END AS az FROM u)"""


@query("kabsch_rotation")
def kabsch_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation of every frame from nine sums; tests/ checks that a planted one comes back."""
    cols = lambda names: [F.col(n) for n in names]
    out = robust.kabsch(_turned(spark, sf_dir), "f", cols(("ax", "ay", "az")), cols("xyz"))
    return out.select("f", *[r6(F.col(c.replace("h", "r")), c.replace("h", "r")) for c in robust.CELLS])


@query("kabsch_ransac", f"SELECT vec_id // 40 AS f, round({_TURN[0]:.17g}::DOUBLE, 6) AS c, round({_TURN[1]:.17g}::DOUBLE, 6) AS s FROM embeddings GROUP BY 1 HAVING count(*) >= 20")
def kabsch_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted rotation in spite of wrong pairs, for frames with enough of them."""
    rows = _turned(spark, sf_dir)
    enough = rows.groupBy("f").count().where("count >= 20").select("f")
    out = robust.frame_rotations(rows.join(enough, "f", "left_semi"), "f", ("ax", "ay", "az"), ("x", "y", "z"), "vec_id", degrees=0.01)
    return out.select("f", F.round("r00", 6).alias("c"), F.round("r10", 6).alias("s"))


@query("kabsch_ransac_three", f"SELECT vec_id // 40 AS f, round({_TURN[0]:.17g}::DOUBLE, 6) AS c, round({_TURN[1]:.17g}::DOUBLE, 6) AS s FROM embeddings GROUP BY 1 HAVING count(*) >= 20")
def kabsch_ransac_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As kabsch_ransac, with the settings for key frames' features; wrong pairs are further off than their tolerance."""
    rows = _turned(spark, sf_dir).withColumns({"ax": F.when(F.col("vec_id") % 9 == 0, -F.col("x")).otherwise(F.col("ax")), "ay": F.when(F.col("vec_id") % 9 == 0, -F.col("y")).otherwise(F.col("ay")), "az": F.when(F.col("vec_id") % 9 == 0, -F.col("z")).otherwise(F.col("az"))})
    enough = rows.groupBy("f").count().where("count >= 20").select("f")
    out = robust.frame_rotations(rows.join(enough, "f", "left_semi"), "f", ("ax", "ay", "az"), ("x", "y", "z"), "vec_id", **robust.KEY_FRAMES)
    return out.select("f", F.round("r00", 6).alias("c"), F.round("r10", 6).alias("s"))


@query("gravity_median", f"WITH {SERIES} SELECT series_id, {r6_sql('greatest(-30, least(30, degrees(atan2(median(ay), median(az)))))', 'roll')}, {r6_sql('greatest(-30, least(30, degrees(atan2(-median(ax), sqrt(pow(median(ay), 2) + pow(median(az), 2))))))', 'pitch')} FROM (SELECT series_id, -sin(radians(pitch)) AS ax, sin(radians(roll)) * cos(radians(pitch)) AS ay, cos(radians(roll)) * cos(radians(pitch)) AS az FROM s) GROUP BY series_id HAVING count(*) > 10")
def gravity_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilt of the median force of a log of more than ten rows, within 30 degrees."""
    from ..functions.angles import gravity_camera

    ax, ay, az = gravity_camera(F.col("roll"), F.col("pitch"))
    rows = series(spark, sf_dir).select("series_id", ax.alias("ax"), ay.alias("ay"), az.alias("az"))
    g = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("ax", "ay", "az")]).where("n > 10")
    clip = lambda x: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.degrees(x)))
    x, y, z = F.col("ax"), F.col("ay"), F.col("az")
    return g.select("series_id", r6(clip(F.atan2(y, z)), "roll"), r6(clip(F.atan2(-x, F.sqrt(y * y + z * z))), "pitch"))
