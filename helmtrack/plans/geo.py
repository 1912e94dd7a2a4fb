"""Queries on tracks: distances, grids, synchronisation, nearest fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins, track
from ..operators import series as op
from .carriers import SERIES, r6, r6_sql, series, table
from .registry import query

def hav_sql(a: str, b: str, c: str, d: str) -> str:
    q = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371000e0 * 2 * atan2(sqrt({q}), sqrt(1 - {q})))"


W = "WINDOW w AS (PARTITION BY series_id ORDER BY frame)"


@query("track_steps", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM s {W})
SELECT series_id, frame, {r6_sql(hav_sql('a', 'o', 'lat', 'lon'), 'metres')},
  round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) + 0e0 AS bearing FROM (SELECT *, degrees(atan2(sin(radians(lon - o)) * cos(radians(lat)), cos(radians(a)) * sin(radians(lat)) - sin(radians(a)) * cos(radians(lat)) * cos(radians(lon - o)))) AS b FROM p WHERE a IS NOT NULL)""")
def track_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = op.ordered()
    rows = series(spark, sf_dir).select("series_id", "frame", "lat", "lon", F.lag("lat").over(w).alias("a"), F.lag("lon").over(w).alias("o")).where("a is not null")
    args = [F.col(c) for c in ("a", "o", "lat", "lon")]
    return rows.select("series_id", "frame", r6(geo.haversine(*args), "metres"), r6(geo.bearing(*args), "bearing"))


@query("bearing_destination", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, radians(lat) AS a, radians(lon) AS o, radians(yaw + 180) AS b, (35 + value) / 6371000e0 AS d FROM s),
e AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) AS x FROM p)
SELECT series_id, frame, {r6_sql('degrees(x)', 'lat')}, {r6_sql('degrees(o + atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(x)))', 'lon')} FROM e""")
def bearing_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.col("yaw") + 180.0, F.col("value") + 35.0)
    return series(spark, sf_dir).select("series_id", "frame", r6(lat, "lat"), r6(lon, "lon"))


@query("track_sync_1hz", f"""
WITH {SERIES}, c AS (SELECT series_id, lat, lon, ele, frame * 3e0 + abs(value) % 2e0 AS sec FROM s),
win AS (SELECT series_id, floor(min(sec)) - 5 AS start, (ceil(max(sec)) - floor(min(sec)) + 10)::INT AS length FROM c GROUP BY series_id),
g AS (SELECT series_id, start + k AS sec, k::INT AS k FROM (SELECT series_id, start, unnest(range(length + 1)) AS k FROM win)),
b AS (SELECT g.*, p.sec AS t0, p.lat AS lat0, p.lon AS lon0, p.ele AS ele0 FROM g ASOF LEFT JOIN c p ON g.series_id = p.series_id AND g.sec >= p.sec),
f AS (SELECT b.*, p.sec AS t1, p.lat AS lat1, p.lon AS lon1, p.ele AS ele1 FROM b ASOF LEFT JOIN c p ON b.series_id = p.series_id AND b.sec <= p.sec),
h AS (SELECT *, CASE WHEN t1 - t0 > 0 THEN (sec - t0) / (t1 - t0) ELSE 0 END AS q FROM f)
SELECT series_id, k AS sec, {', '.join(f"round(round(CASE WHEN t0 IS NULL THEN {c}1 WHEN t1 IS NULL THEN {c}0 ELSE {c}0 + q * ({c}1 - {c}0) END, {d}) + {off}::DOUBLE, {d - 3 + (c == 'ele')}) AS {c}" for c, d, off in (('lat', 8, 3e-9), ('lon', 8, 3e-9), ('ele', 3, 3e-4)))} FROM h""")
def track_sync_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tracks at 1 Hz, of a fix each three seconds and some, from 5 seconds before the first fix to 5 after the last."""
    clock = F.col("frame") * 3.0 + F.abs("value") % 2.0
    fixes = series(spark, sf_dir).select("series_id", "frame", clock.alias("sec"), "lat", "lon", "ele")
    start = F.floor(F.min("sec"))
    windows = fixes.groupBy("series_id").agg((start - 5).cast("double").alias("start"), (F.ceil(F.max("sec")) - start + 10).cast("int").alias("length"))
    off = lambda c, by, d: F.round(F.col(c) + by, d).alias(c)  # noqa: E731  coarser than the decimals that are kept, and off their ties
    return track.synchronised(fixes, windows).select("series_id", "sec", off("lat", 3e-9, 5), off("lon", 3e-9, 5), off("ele", 3e-4, 1))


@query("track_sync_untimed", f"""
WITH {SERIES}, p AS (SELECT series_id, frame AS place, count(*) OVER (PARTITION BY series_id) AS n, lat, lon, ele FROM s),
g AS (SELECT series_id, k, least(floor(k / 126e0 * (max(n) - 1)), max(n) - 1) AS place FROM p, (SELECT unnest(range(127)) AS k) GROUP BY series_id, k)
SELECT series_id, k::INT AS sec, lat, lon, ele FROM g JOIN p USING (series_id, place)""")
def track_sync_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes without times, spread over 126 seconds by their order."""
    fixes = series(spark, sf_dir).select("series_id", "frame", F.lit(None).cast("double").alias("sec"), "lat", "lon", "ele")
    windows = fixes.select("series_id").distinct().select("series_id", F.lit(0.0).alias("start"), F.lit(126).alias("length"))
    return track.synchronised(fixes, windows)


_ROUTE = f"""c AS (SELECT series_id, frame, lat, lon, CASE WHEN frame % 3 = 0 THEN ele END AS ele FROM s),
d AS (SELECT *, coalesce(sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2)), 0) AS step, coalesce(last_value(ele IGNORE NULLS) OVER w, 315) AS e FROM c {W}),
t AS (SELECT series_id, frame, lat, lon, e AS ele, sum(step) OVER (PARTITION BY series_id ORDER BY frame) / sum(step) OVER (PARTITION BY series_id) * 90 AS t FROM d),
g AS (SELECT series_id, n::INT AS sec, n::DOUBLE AS t FROM (SELECT DISTINCT series_id FROM t), (SELECT unnest(range(91)) AS n)),
b AS (SELECT g.*, p.t AS t0, p.lat AS lat0, p.lon AS lon0, p.ele AS ele0 FROM g ASOF LEFT JOIN t p ON g.series_id = p.series_id AND g.t >= p.t),
f AS (SELECT b.*, p.t AS t1, p.lat AS lat1, p.lon AS lon1, p.ele AS ele1 FROM b ASOF LEFT JOIN t p ON b.series_id = p.series_id AND b.t <= p.t),
h AS (SELECT *, CASE WHEN t1 - t0 > 0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS q FROM f)"""


@query("route_interp_by_distance", f"WITH {SERIES}, {_ROUTE} SELECT series_id, sec, {', '.join(f'round(CASE WHEN t0 IS NULL THEN {c}1 WHEN t1 IS NULL THEN {c}0 ELSE {c}0 + q * ({c}1 - {c}0) END, 8) AS {c}' for c in ('lat', 'lon'))}, round(CASE WHEN t0 IS NULL THEN ele1 WHEN t1 IS NULL THEN ele0 ELSE ele0 + q * (ele1 - ele0) END, 3) AS ele FROM h")
def route_interp_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = series(spark, sf_dir).select("series_id", "frame", "lat", "lon", F.when(F.col("frame") % 3 == 0, F.col("ele")).alias("ele"), F.lit(None).cast("double").alias("time"))
    lengths = points.select("series_id").distinct().withColumn("length", F.lit(90.0))
    return track.route(points, lengths)


@query("route_times_by_ground", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, coalesce({hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM s {W})
SELECT series_id, frame, {r6_sql('sum(step) OVER w / sum(step) OVER (PARTITION BY series_id) * 600', 'sec')} FROM p {W}""")
def route_times_by_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, times = track.times_by_distance(F.lit(600.0))
    rows = series(spark, sf_dir).withColumn("step", step)
    return rows.select("series_id", "frame", r6(times, "sec"))


@query("gps_smooth_pinned", f"""
WITH {SERIES}, j AS (SELECT series_id, frame, lat + sin(value) * 1e-3 AS lat, lon + cos(value) * 1e-3 AS lon, ele + sin(value * 2) AS ele FROM s)
SELECT series_id, frame, {', '.join(f'round(CASE WHEN lag({c}) OVER w IS NULL OR lead({c}) OVER w IS NULL THEN {c} ELSE 0.25e0 * lag({c}) OVER w + 0.5e0 * {c} + 0.25e0 * lead({c}) OVER w END, {d}) AS {c}' for c, d in (('lat', 8), ('lon', 8), ('ele', 3)))} FROM j {W}""")
def gps_smooth_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = series(spark, sf_dir).select("series_id", "frame", (F.col("lat") + F.sin(v) * 1e-3).alias("lat"), (F.col("lon") + F.cos(v) * 1e-3).alias("lon"), (F.col("ele") + F.sin(v * 2.0)).alias("ele"))
    places = {"lat": 8, "lon": 8, "ele": 3}
    return op.pinned_smooth(rows, places, 1).select("series_id", "frame", *[F.round(c, d).alias(c) for c, d in places.items()])


@query("nearest_fix_haversine", f"""
WITH {SERIES}, t AS (SELECT n_nationkey, 40 + n_nationkey * 0.02::DOUBLE AS tlat, 20 + n_nationkey * 0.015::DOUBLE AS tlon FROM nation),
d AS (SELECT n_nationkey, series_id, frame, {hav_sql('tlat', 'tlon', 'lat', 'lon')} AS m FROM s, t)
SELECT n_nationkey, series_id, frame, {r6_sql('m', 'metres')} FROM d QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY m, series_id, frame) = 1""")
def nearest_fix_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = series(spark, sf_dir).select(F.struct("series_id", "frame").alias("at"), "lat", "lon")
    key = F.col("n_nationkey")
    targets = table(spark, sf_dir, "nation").select("n_nationkey", (40.0 + key * 0.02).alias("tlat"), (20.0 + key * 0.015).alias("tlon"))
    found = joins.nearest(fixes, targets, order="at", target=("tlat", "tlon"))
    return found.select("n_nationkey", "point.at.series_id", "point.at.frame", r6(F.col("distance"), "metres"))


@query("resample_fixed_rate", f"""
WITH {SERIES}, p AS (SELECT series_id, frame / 30e0 + (value * 7 % 10e0) * 1e-3 AS t, roll, pitch, yaw FROM s),
m AS (SELECT series_id, min(t) AS t0, max(t) AS t1 FROM p GROUP BY series_id),
g AS (SELECT series_id, n AS frame, t0 + n / 50e0 AS t FROM m, (SELECT unnest(range(100000)) AS n) WHERE n <= floor((t1 - t0) * 50e0 + 1e-9)),
b AS (SELECT g.*, p.t AS a, p.roll AS roll0, p.pitch AS pitch0, p.yaw AS yaw0 FROM g ASOF LEFT JOIN p ON g.series_id = p.series_id AND g.t >= p.t),
f AS (SELECT b.*, p.t AS z, p.roll AS roll1, p.pitch AS pitch1, p.yaw AS yaw1 FROM b ASOF LEFT JOIN p ON b.series_id = p.series_id AND b.t <= p.t),
h AS (SELECT *, CASE WHEN z - a > 0 THEN (t - a) / (z - a) ELSE 0 END AS q FROM f)
SELECT series_id, frame, {', '.join(r6_sql(f'CASE WHEN a IS NULL THEN {c}1 WHEN z IS NULL THEN {c}0 ELSE {c}0 + q * ({c}1 - {c}0) END', c) for c in ('roll', 'pitch', 'yaw'))} FROM h""")
def resample_fixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-channel logs come at uneven times; here three channels at 50 Hz."""
    rows = series(spark, sf_dir).select("series_id", (F.col("frame") / 30.0 + (F.col("value") * 7.0 % 10.0) * 1e-3).alias("t"), "roll", "pitch", "yaw")
    out = track.resampled(rows, 50.0, ["roll", "pitch", "yaw"])
    return out.select("series_id", "frame", *[r6(F.col(c), c) for c in ("roll", "pitch", "yaw")])


@query("checkpoint_cosine_ease", f"""
WITH {SERIES}, c AS (SELECT series_id, frame * 3e0 + 4 AS t, pitch, roll FROM s),
g AS (SELECT series_id, n AS frame, n::DOUBLE AS t FROM (SELECT series_id, unnest(range(3 * max(frame) + 10)) AS n FROM s GROUP BY series_id)),
b AS (SELECT g.*, c.t AS t0, c.pitch AS p0, c.roll AS q0 FROM g ASOF LEFT JOIN c ON g.series_id = c.series_id AND g.t >= c.t),
f AS (SELECT b.*, c.t AS t1, c.pitch AS p1, c.roll AS q1 FROM b ASOF LEFT JOIN c ON b.series_id = c.series_id AND b.t <= c.t),
h AS (SELECT *, 0.5e0 * (1 - cos(CASE WHEN t1 - t0 > 0 THEN (t - t0) / (t1 - t0) ELSE 0 END * pi())) AS e FROM f)
SELECT series_id, frame, {r6_sql('CASE WHEN t0 IS NULL THEN p1 WHEN t1 IS NULL THEN p0 ELSE p0 + e * (p1 - p0) END', 'pitch')}, {r6_sql('CASE WHEN t0 IS NULL THEN q1 WHEN t1 IS NULL THEN q0 ELSE q0 + e * (q1 - q0) END', 'roll')} FROM h""")
def checkpoint_cosine_ease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints three frames apart, from the fourth frame on."""
    rows = series(spark, sf_dir)
    points = rows.select("series_id", (F.col("frame") * 3.0 + 4.0).alias("t"), "pitch", "roll")
    last = rows.groupBy("series_id").agg((3 * F.max("frame") + 9).alias("last"))
    grid = last.select("series_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("frame")).withColumn("t", F.col("frame").cast("double"))
    return joins.eased(points, grid, "series_id", "t", ("pitch", "roll")).select("series_id", "frame", r6(F.col("pitch"), "pitch"), r6(F.col("roll"), "roll"))


@query("dead_reckoning", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, sum(CASE WHEN frame > 0 THEN cos(radians(yaw)) * 1.4::DOUBLE * 0.5::DOUBLE ELSE 0 END) OVER w AS n, sum(CASE WHEN frame > 0 THEN sin(radians(yaw)) * 1.4::DOUBLE * 0.5::DOUBLE ELSE 0 END) OVER w AS e FROM s {W})
SELECT series_id, frame, {r6_sql('n', 'north')}, {r6_sql('e', 'east')}, {r6_sql('46.5::DOUBLE + n / 111320', 'lat')}, {r6_sql('11.3::DOUBLE + e / (111320 * cos(radians(46.5::DOUBLE)))', 'lon')} FROM p""")
def dead_reckoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = track.dead_reckoning(series(spark, sf_dir).select("series_id", "frame", "yaw"), heading="yaw", speed=1.4, dt=0.5, lat=46.5, lon=11.3)
    return out.select("series_id", "frame", *[r6(F.col(c), c) for c in ("north", "east", "lat", "lon")])


@query("turn_points", f"""
WITH {SERIES}, t AS (SELECT series_id, frame, frame % 10 = 0 OR frame = 0 OR frame = count(*) OVER (PARTITION BY series_id) - 1 AS fixed, coalesce(abs((roll - lag(roll, 2) OVER w) - (lead(roll, 2) OVER w - roll)) > 8, false) AS turn FROM s {W})
SELECT series_id, frame, turn FROM t WHERE fixed OR turn""")
def turn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame, the ends, and the turns, each once."""
    f = F.col("frame")
    rows = series(spark, sf_dir).select("series_id", "frame", F.coalesce(op.turns(F.col("roll")), F.lit(False)).alias("turn"), (F.count(F.lit(1)).over(op.whole()) - 1).alias("last"))
    return rows.where((f % 10 == 0) | (f == F.col("last")) | F.col("turn")).select("series_id", "frame", "turn")


@query("path_length", f"""
WITH {SERIES}, p AS (SELECT series_id, frame, lat, lon, sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2)) AS d FROM s {W})
SELECT series_id, {r6_sql('coalesce(sum(d), 0)', 'degrees')}, {r6_sql('sqrt(pow(arg_max(lat, frame) - arg_min(lat, frame), 2) + pow(arg_max(lon, frame) - arg_min(lon, frame), 2))', 'net')} FROM p GROUP BY series_id""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = op.ordered()
    step = geo.planar(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    rows = series(spark, sf_dir).select("series_id", "frame", "lat", "lon", step.alias("d"))
    end = lambda f, c: f(c, "frame")
    net = geo.planar(end(F.min_by, "lat"), end(F.min_by, "lon"), end(F.max_by, "lat"), end(F.max_by, "lon"))
    return rows.groupBy("series_id").agg(r6(F.coalesce(F.sum("d"), F.lit(0.0)), "degrees"), r6(net, "net"))


@query("track_spans_keyframes", f"""
WITH {SERIES}, t AS (SELECT series_id, frame AS fi, frame + (floor(value)::BIGINT % 40) AS li FROM s), k AS (SELECT unnest(range(0, 60, 6)) AS a)
SELECT k.a::BIGINT AS a, count(*)::BIGINT AS tracks FROM t JOIN k ON fi <= a AND li >= a + 6 GROUP BY k.a""")
def track_spans_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that reach over a pair of keyframes, by bucket instead of by all pairs."""
    tracks = series(spark, sf_dir).select(F.col("frame").alias("fi"), (F.col("frame") + F.floor("value") % 40).alias("li"))
    pairs = spark.range(0, 60, 6).select(F.col("id").alias("a"), (F.col("id") + 6).alias("b"))
    return joins.spanning(tracks, pairs, "fi", "li", "a", "b").groupBy("a").agg(F.count(F.lit(1)).alias("tracks"))
