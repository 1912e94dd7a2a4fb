"""Queries of picture geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lens
from .carriers import SERIES, r6, r6_sql, series, table
from .registry import query


def _axis(i: int) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {a[i]}e0 + fu * {r[i]} + fv * {d[i]}" for n, (a, r, d) in lens.FACES.items())
    return f"(CASE face {cases} END) / sqrt(1 + fu * fu + fv * fv)"


@query("cube_directions", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, (['px', 'nx', 'py', 'ny', 'pz', 'nz'])[1 + frame % 6] AS face, 2 * (roll + 30) / 255 - 1 AS fu, 2 * (pitch + 20) / 255 - 1 AS fv FROM s)
SELECT series_id, frame, {', '.join(r6_sql(_axis(i), n) for i, n in enumerate('xyz'))} FROM p""")
def cube_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.array(*[F.lit(n) for n in ("px", "nx", "py", "ny", "pz", "nz")])[(F.col("frame") % 6).cast("int")]
    v = lens.cube_direction(face, F.col("roll") + 30.0, F.col("pitch") + 20.0, 256.0)
    return series(spark, sf_dir).select("series_id", "frame", *[r6(c, n) for c, n in zip(v, "xyz", strict=True)])


@query("seam_mask", """
SELECT o_orderkey, x::BIGINT AS x, (CASE WHEN x BETWEEN 1020 AND 2820 THEN 0 WHEN x >= 900 AND x < 1020 THEN 255 - floor(255 * (0.5e0 - 0.5e0 * cos(pi() * ((x - 900) / 120e0)))) WHEN x > 2820 AND x <= 2940 THEN 255 - floor(255 * (0.5e0 - 0.5e0 * cos(pi() * ((2940 - x) / 120e0)))) ELSE 255 END)::INT AS alpha FROM (SELECT o_orderkey, o_orderkey * 7 % 3840 AS x FROM orders)""")
def seam_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask at one of its 3840 columns for every order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 3840).alias("x"))
    return rows.select("o_orderkey", "x", lens.seam_alpha(F.col("x").cast("double")).alias("alpha"))


@query("fisheye_places", f"""
WITH {SERIES}, d AS (SELECT series_id, frame, radians(yaw) AS lon, radians(pitch) AS lat FROM s), v AS (SELECT *, cos(lat) * sin(lon) AS x, sin(lat) AS y, cos(lat) * cos(lon) AS z FROM d),
w AS (SELECT *, acos(greatest(-1e0, least(1e0, z))) / radians(97.5::DOUBLE) * 940 AS r, atan2(sin(radians(-1.5::DOUBLE)) * x + cos(radians(-1.5::DOUBLE)) * y, cos(radians(-1.5::DOUBLE)) * x - sin(radians(-1.5::DOUBLE)) * y) AS phi FROM v)
SELECT series_id, frame, {r6_sql('960 + r * cos(phi)', 'x')}, {r6_sql('960 + r * sin(phi)', 'y')} FROM w""")
def fisheye_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = lens.fisheye_place(F.col("yaw"), F.col("pitch"), fov=195.0, radius=940.0, centre=(960.0, 960.0), roll=1.5)
    return series(spark, sf_dir).select("series_id", "frame", r6(x, "x"), r6(y, "y"))
