"""Queries of bookkeeping and small parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from .carriers import SERIES, r6, r6_sql, series, table
from .registry import query


def _choice(values: list[str], at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[at.cast("int")]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("latest_status", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (WHERE true) IS NOT NULL AS seen, count(*)::BIGINT AS changes FROM events WHERE user_id IS NOT NULL GROUP BY user_id""".replace("max(event_id) FILTER (WHERE true) IS NOT NULL AS seen, ", ""))
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_type", "ts", "event_id")
    last = catalog.latest(e, "user_id", "ts", "event_id").select("user_id", "event_type")
    return last.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("changes")), "user_id")


@query("lost_jobs_failed", """
WITH l AS (SELECT user_id AS pid, CASE arg_max(event_id, (ts, event_id)) % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'paused' END AS st FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT CASE WHEN st IN ('running', 'paused') AND pid % 4 <> 0 THEN 'failed' ELSE st END AS status, count(*)::BIGINT AS jobs FROM l GROUP BY 1""")
def lost_jobs_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("pid"), "ts", "event_id")
    jobs = catalog.latest(e, "pid", "ts", "event_id").select("pid", _choice(["running", "completed", "paused"], F.col("event_id") % 3).alias("status"))
    alive = e.where("pid % 4 = 0").select("pid")
    return catalog.with_lost_failed(jobs, alive).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


@query("status_spelling", "SELECT CASE WHEN x IN ('canceled', 'cancelled') THEN 'cancelled' ELSE x END AS status, count(*)::BIGINT AS n FROM (SELECT lower((['Canceled', 'cancelled', 'DONE', 'failed'])[1 + o_orderkey % 4]) AS x FROM orders) GROUP BY 1")
def status_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _choice(["Canceled", "cancelled", "DONE", "failed"], F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select(catalog.status(name).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("first_seen_distinct", "SELECT p_brand, min(p_partkey)::BIGINT AS p_partkey FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_seen(table(spark, sf_dir, "part").where("p_brand is not null"), "p_brand", "p_partkey")


@query("natural_sort", "WITH n AS (SELECT p_partkey, 'clip' || (p_partkey * 7919 % 1013)::VARCHAR || '_' || p_size::VARCHAR || '.gpx' AS name, p_partkey * 7919 % 1013 AS a, p_size AS b FROM part) SELECT name, p_partkey, row_number() OVER (ORDER BY a, b, p_partkey) AS place FROM n")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with their places in natural order."""
    name = F.concat(F.lit("clip"), (F.col("p_partkey") * 7919 % 1013).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".gpx"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return catalog.placed(catalog.natural(rows, "name", ["p_partkey"]), "natural", "p_partkey").select("name", "p_partkey", "place")


@query("media_catalog", "SELECT path, kind, size FROM (SELECT 'v' || (o_orderkey % 5000)::VARCHAR || CASE WHEN o_orderkey % 5000 % 4 = 0 THEN '.JPG' ELSE '.mp4' END AS path, CASE WHEN o_orderkey % 5000 % 4 = 0 THEN 'image' ELSE 'video' END AS kind, round(max(o_totalprice), 2) AS size, max(o_orderdate) AS d FROM orders GROUP BY ALL)")
def media_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All media files, each path once, the newest first."""
    k = F.col("o_orderkey") % 5000
    path = F.concat(F.lit("v"), k.cast("string"), F.when(k % 4 == 0, ".JPG").otherwise(".mp4"))
    rows = table(spark, sf_dir, "orders").select(path.alias("path"), "o_totalprice", "o_orderdate")
    rows = rows.groupBy("path").agg(F.round(F.max("o_totalprice"), 2).alias("size"), F.max("o_orderdate").alias("d")).orderBy(F.desc("d"), "path")
    return rows.select("path", F.when(F.lower("path").rlike(r"\.(jpe?g|png)$"), "image").otherwise("video").alias("kind"), "size")


@query("best_artifact", """
WITH a AS (SELECT o_custkey, 'a' || o_orderkey::VARCHAR AS path, o_orderkey % 4 AS methods, o_orderdate AS mtime FROM orders) SELECT o_custkey, path, methods FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY methods DESC, mtime DESC, path) = 1""")
def best_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 4).alias("methods"), F.col("o_orderdate").alias("mtime"))
    return catalog.best_artifact(rows, "o_custkey", "methods", "mtime").select("o_custkey", "path", "methods")


@query("source_fallback", """
WITH c AS (SELECT series_id, u.place, u.name, CASE WHEN (series_id + u.place) % 3 = 0 THEN frame_count ELSE 0 END AS size FROM (SELECT series_id, count(*) AS frame_count FROM s GROUP BY series_id), (VALUES (0, 'vrot'), (1, 'gpmf'), (2, 'camm'), (3, 'companion')) u(place, name))
SELECT series_id, arg_min(name, place) AS name, arg_min(size, place)::BIGINT AS size FROM c WHERE size > 0 GROUP BY series_id""".replace("WITH c", f"WITH {SERIES}, c"))
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of each recording that has samples."""
    counts = series(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("frames"))
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(("vrot", "gpmf", "camm", "companion"))])
    c = counts.select("series_id", "frames", F.inline(names))
    c = c.select("series_id", "place", "name", F.when((F.col("series_id") + F.col("place")) % 3 == 0, F.col("frames")).otherwise(0).cast("bigint").alias("size"))
    return catalog.first_present(c, "series_id", "place", "size").select("series_id", "name", "size")


@query("executed_stages", """
SELECT o_orderstatus AS job, u.stage, CASE WHEN count(*) FILTER (WHERE (o_orderkey * u.k) % 7 = 1) > 0 AND u.k = 3 THEN 'reverted' WHEN u.k % 2 = 1 THEN 'executed' ELSE 'skipped' END AS outcome FROM orders, (VALUES (1, 'telemetry'), (2, 'kopf'), (3, 'kabsch'), (4, 'horizon')) u(k, stage) GROUP BY o_orderstatus, u.k, u.stage""")
def executed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(n).alias("stage")) for i, n in enumerate(("telemetry", "kopf", "kabsch", "horizon"))])
    every = o.select(F.col("o_orderstatus").alias("job")).distinct().select("job", F.inline(names))
    reverted = o.where("(o_orderkey * 3) % 7 = 1").select(F.col("o_orderstatus").alias("job"), F.lit("kabsch").alias("stage"))
    return catalog.executed(every.select("job", "stage"), every.where("k % 2 = 1"), reverted, "job", "stage")


@query("keyframe_packet", """
WITH p AS (SELECT l_orderkey AS v, l_partkey / 1000e0 AS pts FROM lineitem WHERE l_linenumber % 2 = 1), a AS (SELECT o_orderkey AS v, (o_custkey % 2000) / 1000e0 AS asked FROM orders)
SELECT a.v, a.asked, max(p.pts) AS pts FROM a LEFT JOIN p ON p.v = a.v AND p.pts <= a.asked + 0.01::DOUBLE GROUP BY a.v, a.asked""")
def keyframe_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v"), (F.col("l_partkey") / 1000.0).alias("pts"), (F.col("l_linenumber") % 2 == 1).alias("is_key"))
    asks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), (F.col("o_custkey") % 2000 / 1000.0).alias("asked"))
    return catalog.key_packet(packets, asks, "v")


@query("progress_eta", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS cur, 120e0 AS dur, CASE WHEN l_linenumber % 3 = 0 THEN 60e0 ELSE 0e0 END AS act, l_discount * 10 + 0.01::DOUBLE AS sp FROM lineitem),
q AS (SELECT *, CASE WHEN act > 0 THEN act ELSE dur END AS r FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN dur > r AND cur < r THEN least(98, cur / greatest(r, 0.001::DOUBLE) * 98) WHEN dur > r THEN least(99, 98 + (cur - r) / greatest(dur - r, 0.001::DOUBLE)) ELSE least(99, cur / dur * 100) END, 6) + 0e0 AS pct,
 (CASE WHEN dur > r AND cur < r THEN trunc(greatest(0, r - cur) / sp) + least(3, greatest(1, trunc((dur - r) * 0.01::DOUBLE))) WHEN dur > r THEN greatest(1, trunc(greatest(0, dur - cur) / greatest(100, sp))) ELSE trunc(greatest(0, dur - cur) / sp) END)::INT AS eta FROM q""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct, eta = catalog.progress(F.col("l_quantity") * 2.0, F.lit(120.0), F.when(F.col("l_linenumber") % 3 == 0, 60.0).otherwise(0.0), F.col("l_discount") * 10.0 + 0.01)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(pct, "pct"), eta.alias("eta"))


@query("runtime_estimate", """
SELECT o_orderkey, round(2.0::DOUBLE + 0.05::DOUBLE * d + 5.0::DOUBLE + 1.9::DOUBLE * d + CASE WHEN o_orderkey % 2 = 0 THEN 2.0::DOUBLE + 0.1::DOUBLE * d ELSE 6.0::DOUBLE + 4.5::DOUBLE * d END, 4) AS seconds, round(d * 4 + 500, 4) AS disk_mb FROM (SELECT o_orderkey, (o_custkey % 600)::DOUBLE AS d FROM orders)""")
def runtime_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("o_custkey") % 600).cast("double")
    stages = F.array(F.lit("telemetry"), F.lit("kopf"), F.when(F.col("o_orderkey") % 2 == 0, "horizon").otherwise("vidstab"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(catalog.estimate(d, stages), 4).alias("seconds"), F.round(catalog.disk_needed(d, F.lit(4)), 4).alias("disk_mb"))


@query("next_prefix", "SELECT o_orderkey, (CASE WHEN o_orderkey % 10005 BETWEEN 1001 AND 9998 THEN o_orderkey % 10005 + 1 ELSE 1001 END)::BIGINT AS next FROM orders")
def next_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.next_prefix(F.col("o_orderkey") % 10005).cast("bigint").alias("next"))


@query("preset_values", "SELECT event_id, coalesce(try_cast(json_extract_string(p, '$.fov') AS DOUBLE), 90e0) AS fov, coalesce(try_cast(json_extract_string(p, '$.n') AS INT), 3) AS n FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"fov\": \"' || (event_id % 360)::VARCHAR || '.5\", \"n\": ' || (event_id % 9)::VARCHAR || '}' WHEN 1 THEN '{\"fov\": \"wide\"}' ELSE '{}' END AS p FROM events)")
def preset_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    full = F.concat(F.lit('{"fov": "'), (i % 360).cast("string"), F.lit('.5", "n": '), (i % 9).cast("string"), F.lit("}"))
    p = F.when(i % 3 == 0, full).when(i % 3 == 1, '{"fov": "wide"}').otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", catalog.preset_value(p, "fov", "double", 90.0).alias("fov"), catalog.preset_value(p, "n", "int", 3).alias("n"))


@query("time_parse", """
WITH t AS (SELECT o_orderkey, o_orderkey % 90000 AS k FROM orders), x AS (SELECT o_orderkey, k, CASE o_orderkey % 4 WHEN 0 THEN printf('%02d:%02d:%02d', k // 3600, k % 3600 // 60, k % 60) WHEN 1 THEN printf('%d:%02d', k // 60, k % 60) WHEN 2 THEN k::VARCHAR || '.25' ELSE 'x' || k::VARCHAR END AS s FROM t)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN k + 0.25::DOUBLE WHEN 3 THEN NULL ELSE k::DOUBLE END AS sec, printf('%02d:%02d:%02d', k // 3600, k % 3600 // 60, k % 60) AS clock, printf('%d:%02d:%02d.25', k // 3600, k % 3600 // 60, k % 60) AS subtitle FROM x""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    s = F.when(F.col("o_orderkey") % 4 == 0, F.format_string("%02d:%02d:%02d", F.floor(k / 3600), F.floor(k % 3600 / 60), k % 60)).when(F.col("o_orderkey") % 4 == 1, F.format_string("%d:%02d", F.floor(k / 60), k % 60)).when(F.col("o_orderkey") % 4 == 2, F.concat(k.cast("string"), F.lit(".25"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90000).alias("k"))
    return rows.select("o_orderkey", text.seconds(s).alias("sec"), text.clock(k.cast("double")).alias("clock"), text.subtitle_clock(k + 0.25).alias("subtitle"))


#: A line and what it holds: lat, lon, time, ele.
LINES = [
    ("00:01:57, 44.4340, 26.1055, 208m", 44.434, 26.1055, 117.0, 208.0), ("44.4340, 26.1055, 00:01:57, 208", 44.434, 26.1055, 117.0, 208.0), ("3, 44.5, 26.25, 12", 44.5, 26.25, 3.0, 12.0),
    ("1:30, 44.5, 26.25", 44.5, 26.25, 90.0, None), ("44.5, 26.25, 208", 44.5, 26.25, None, 208.0), ("44.5,26.25,1:02:03", 44.5, 26.25, 3723.0, None), ("44.5, 26.25", 44.5, 26.25, None, None), ("# a comment", None, None, None, None), ("", None, None, None, None), ("only words", None, None, None, None),
    ("00:05 https://maps.example/@46.5,11.25,40m/data=!3d46.625!4d11.375", 46.625, 11.375, 5.0, 40.0), ("https://maps.example/@-46.5,11.25,17z", -46.5, 11.25, 11.25, 17.0),
]


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


def _each(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    """o_orderkey, line: a text for every order, by its key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", _choice(values, F.col("o_orderkey") % len(values)).alias("line"))


def _each_sql(rows: list[tuple], names: str) -> str:
    """The orders with what the text of each holds."""
    return f"(SELECT o_orderkey, v.* FROM orders JOIN {_values([(i, *r) for i, r in enumerate(rows)], 'slot, ' + names)} ON o_orderkey % {len(rows)} = v.slot) t"


@query("checkpoint_parse", f"SELECT o_orderkey, lat, lon, time, ele FROM {_each_sql(LINES, 'line, lat, lon, time, ele')}")
def checkpoint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each(spark, sf_dir, [x[0] for x in LINES]).select("o_orderkey", text.checkpoint(F.col("line")).alias("p"))
    return rows.select("o_orderkey", *[F.col("p")[c].alias(c) for c in ("lat", "lon", "time", "ele")])


PASTED = [("12:30 46.5, 11.3 500", 46.5, 11.3, 500.0, 750.0), ("46.5 11.3", 46.5, 11.3, 315.0, None), ("lat=-12.25 lon=130.5 ele=9500", -12.25, 130.5, 315.0, None), ("95 46.5 11.3", 46.5, 11.3, 315.0, None), ("#46.5 11.3", None, None, None, None), ("nothing", None, None, None, None)]


@query("pasted_points", f"SELECT o_orderkey, lat, lon, ele, time FROM {_each_sql(PASTED, 'line, lat, lon, ele, time')}")
def pasted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each(spark, sf_dir, [x[0] for x in PASTED]).select("o_orderkey", text.pasted_point(F.col("line")).alias("p"))
    return rows.select("o_orderkey", *[F.col("p")[c].alias(c) for c in ("lat", "lon", "ele", "time")])


@query("coord_parse", """
SELECT o_orderkey, (o_orderkey % 90)::DOUBLE AS lat, (o_custkey % 180)::DOUBLE AS lon, CASE WHEN o_orderkey % 4 = 0 THEN printf('%.6f,%.6f', (o_orderkey % 90)::DOUBLE, (o_custkey % 180)::DOUBLE) ELSE '' END AS bounded FROM orders""")
def coord_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    mark = F.when(k == 0, ",").when(k == 1, ";").when(k == 2, " / ").otherwise("  ")
    s = F.concat((F.col("o_orderkey") % 90).cast("string"), mark, (F.col("o_custkey") % 180).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s", text.coordinates(F.col("s")).alias("p"))
    return rows.select("o_orderkey", "p.lat", "p.lon", text.bounded_coordinates(F.col("s")).alias("bounded"))


NAMES = [("/a/out_3381_final.mp4", "3381", "_a_out_3381_final.mp4"), ("clip-1234-x.mp4", "1234", ""), ("run_987.mp4", "987", ""), ("abc4567def.mp4", "4567", ""), ("no.mp4", None, ""), ("TEST-12.json", "12", "")]


@query("file_names", f"SELECT o_orderkey, name, number, split_part(name, '/', -1) || CASE WHEN lower(name) LIKE '%.json' THEN '' ELSE '.json' END AS preset, regexp_replace(name, '[^0-9A-Za-z_-]', '', 'g') AS job FROM {_each_sql([x[:2] for x in NAMES], 'name, number')}")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line")
    return _each(spark, sf_dir, [x[0] for x in NAMES]).select("o_orderkey", n.alias("name"), text.test_number(n).alias("number"), text.preset_file(n).alias("preset"), text.job_id(n).alias("job"))


RATES = [("15M", "15M"), ("50000k", "50000K"), ("8 mbit", "8"), ("0012G", "12G"), ("fast", ""), ("", "")]


@query("bitrates", f"SELECT o_orderkey, rate FROM {_each_sql(RATES, 'line, rate')}")
def bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, [x[0] for x in RATES]).select("o_orderkey", text.bitrate(F.col("line")).alias("rate"))


@query("timestamps", "SELECT o_orderkey, epoch_us(o_orderdate + to_seconds(o_orderkey % 86400))::BIGINT AS us FROM orders")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time in four notations: with T and Z, with a blank, with an offset, and as seconds."""
    t = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400))
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.unix_seconds(t).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(text.timestamp(s)).alias("us"))


@query("angle_cleaning", f"WITH {SERIES} SELECT series_id, frame, {r6_sql('roll', 'value')}, CASE WHEN frame % 3 = 0 THEN 'level' ELSE 'smooth' END AS mode FROM s WHERE frame % 7 <> 0")
def angle_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text: those that are no number are skipped, unknown modes become the default."""
    f = F.col("frame")
    rows = series(spark, sf_dir).select("series_id", "frame", F.when(f % 7 == 0, "n/a").otherwise(F.concat(F.col("roll").cast("string"), F.when(f % 2 == 0, "m").otherwise(""))).alias("v"), F.when(f % 3 == 0, " level ").otherwise("other").alias("m"))
    rows = rows.withColumn("value", text.clean_number(F.col("v"))).where("value is not null")
    return rows.select("series_id", "frame", r6(F.col("value"), "value"), text.safe_choice(F.col("m"), ["level", "smooth", "zero"], "smooth").alias("mode"))


@query("degraded_reports", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 5 = 0)::BIGINT AS degraded, count(*)::BIGINT AS reports FROM orders GROUP BY o_orderstatus")
def degraded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.concat(F.lit("STAGE : kopf\nSTATUS : "), F.when(F.col("o_orderkey") % 5 == 0, "NO (UNSTABILIZED) -23.8%").otherwise("YES (STABILIZED) +36.0%"), F.lit("\n"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(catalog.degraded(report)).alias("degraded"), F.count(F.lit(1)).alias("reports"))


@query("event_json", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT json_extract_string(props, '$.k'))::BIGINT AS keys FROM events GROUP BY event_type")
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.get_json_object("props", "$.k")).alias("keys"))
