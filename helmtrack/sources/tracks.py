"""GPS tracks, checkpoints and presets from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import checkpoint, checkpoint_list, timestamp
from ..operators.series import FRAME, ID
from .logs import in_file_order, is_packed, lines, packed, renumbered


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, lat, lon, ele, time of track points in the order of the file; a missing elevation is 0, a missing time null."""
    schema = "_lat double, _lon double, ele double, time string"
    if is_packed(path):  # a document a line
        doc = F.from_xml("value", f"trk array<struct<trkseg: array<struct<trkpt: array<struct<{schema}>>>>>>")
        parts = lambda a, part: F.flatten(F.transform(F.filter(a, lambda x: x[part].isNotNull()), lambda x: x[part]))
        points = packed(spark, path).select(F.col("name").alias(ID), doc.alias("d")).select(ID, F.posexplode(parts(parts(F.col("d.trk"), "trkseg"), "trkpt")).alias("n", "p"))
        kept = points.where("p._lat is not null and p._lon is not null")
        frame = (F.row_number().over(Window.partitionBy(ID).orderBy("n")) - 1).cast("bigint")
        return kept.select(ID, F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.coalesce("p.ele", F.lit(0.0)).alias("ele"), timestamp(F.col("p.time")).alias("time"), frame.alias(FRAME))
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    rows = in_file_order(rows, lat=F.col("_lat"), lon=F.col("_lon"), ele=F.coalesce("ele", F.lit(0.0)), time=timestamp(F.col("time")))
    return renumbered(rows.where("lat is not null and lon is not null"))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, lat, lon, time, ele of text files with one checkpoint a line."""
    rows = lines(spark, path).withColumn("p", checkpoint(F.col("line"))).where("p is not null")
    return renumbered(rows.select(ID, "n", "p.lat", "p.lon", "p.time", "p.ele"))


def checkpoint_documents(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, lat, lon, time, ele of documents that are JSON lists of objects or of lines, or lines; a document is one value."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(ID), F.posexplode(checkpoint_list(F.col("value"))).alias(FRAME, "p"))
    return text.select(ID, F.col(FRAME).cast("bigint").alias(FRAME), "p.lat", "p.lon", "p.time", "p.ele")


def levelling(spark: SparkSession, path: str, fps: float = 29.97) -> DataFrame:
    """series_id, frame, pitch, roll, yaw of checkpoint documents: an object with ``checkpoints``, or a bare list.

    A checkpoint without a frame has one by its time; one with neither is skipped.
    """
    point = "array<struct<frame:double,time:double,pitch:double,roll:double,yaw:double>>"
    if is_packed(path):  # a document a line
        text = packed(spark, path).select(F.col("name").alias(ID), "value")
    else:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(ID), "value")
    doc = text.withColumns({"a": F.from_json("value", f"struct<fps:double,ignoreYaw:boolean,checkpoints:{point}>"), "b": F.from_json("value", point)})
    rows = doc.select(ID, F.coalesce("a.fps", F.lit(fps)).alias("fps"), F.coalesce("a.ignoreYaw", F.lit(True)).alias("still"), F.inline(F.coalesce("a.checkpoints", "b")))
    frame = F.rint(F.coalesce("frame", F.col("time") * F.col("fps"))).cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(ID, frame.alias(FRAME), zero("pitch").alias("pitch"), zero("roll").alias("roll"), F.when(F.col("still"), 0.0).otherwise(zero("yaw")).alias("yaw")).where(F.col(FRAME).isNotNull())


def presets(spark: SparkSession, path: str) -> DataFrame:
    """name, kind, saved_at, body of preset documents; the kind is sniffed where it isn't stated."""
    text = spark.read.text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)
    body = F.col("value")
    kind = F.coalesce(F.get_json_object(body, "$.type"), F.when(F.get_json_object(body, "$.checkpoints").isNotNull(), "horizon").otherwise("pipeline"))
    return text.select(name.alias("name"), kind.alias("kind"), F.get_json_object(body, "$.saved_at").alias("saved_at"), body.alias("body"))


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """job, n, status, progress, at of append-only status files of JSON lines."""
    rows = spark.read.text(path).select(F.from_json("value", "struct<job:string,status:string,progress:double,at:double>").alias("s"))
    return rows.select("s.*").where("job is not null")


def tail(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The last ``most`` rows of every key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


__all__ = ["checkpoint_documents", "checkpoints", "gpx", "levelling", "presets", "status_log", "tail"]
