"""Motion inputs derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order as frames of an orientation series, and as fixes of a track."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    frame = (F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "event_id")) - 1).cast("bigint")
    v = F.col("value")
    return e.select(
        "series_id", frame.alias("frame"), (F.unix_micros("ts") / 1e6).alias("sec"), v.alias("value"),
        ((v * 7.0) % 60.0 - 30.0).alias("roll"), ((v * 3.0) % 40.0 - 20.0).alias("pitch"), ((v * 11.0) % 360.0 - 180.0).alias("yaw"),
        (40.0 + (F.col("series_id") % 50) * 0.01 + v * 1e-5).alias("lat"), (20.0 + (F.col("series_id") % 40) * 0.01 + (v * 3.0 % 50.0) * 1e-4).alias("lon"), (v * 5.0 % 300.0).alias("ele"),
    )


SERIES = """s AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) / 1e6::DOUBLE AS sec, value::DOUBLE AS value,
    (value * 7e0) % 60e0 - 30e0 AS roll, (value * 3e0) % 40e0 - 20e0 AS pitch, (value * 11e0) % 360e0 - 180e0 AS yaw,
    40e0 + (user_id % 50) * 0.01::DOUBLE + value * 1e-5 AS lat, 20e0 + (user_id % 40) * 0.01::DOUBLE + (value * 3e0 % 50e0) * 1e-4 AS lon, value * 5e0 % 300e0 AS ele
  FROM events WHERE user_id IS NOT NULL)"""

#: [-180, 180) in SQL, whose remainder has the sign of the dividend.
def wrap_sql(x: str) -> str:
    return f"(((({x}) + 180e0) % 360e0 + 360e0) % 360e0 - 180e0)"


def r6(x, alias: str):
    """Rounded for comparison; a negative zero becomes zero."""
    return (F.round(x, 6) + F.lit(0.0)).alias(alias)


def r6_sql(x: str, alias: str) -> str:
    return f"round({x}, 6) + 0e0 AS {alias}"
