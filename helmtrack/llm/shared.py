"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, as in tests, a local master gets one beside its warehouse; a cluster must set one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return at.rstrip("/")


def joined_apart(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join on keys that ``right`` has been grouped by, the rows of ``left`` kept splittable.

    On the grouping's own keys Spark would use the grouping's partitions, and
    all rows of a hot key would meet in one of them.  The keys wrapped in a
    struct are another expression: both sides are exchanged for the join alone,
    and Spark can split the partition of a hot key.  Null keys meet nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    wrapped = F.when(_all_known(keys), F.struct(*keys))
    other = right.select(wrapped.alias("_keys"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_keys", wrapped).join(other, "_keys", how).drop("_keys")


def _all_known(keys: list[str]) -> Column:
    known = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        known = known & F.col(k).isNotNull()
    return known


class Scratch:
    """Written tables of one run.  Each cuts the lineage of what follows it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        return f"{self.base}/{len(self.made):03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        self.made.append((kept, at))
        return kept

    def release(self) -> None:
        """Lets Spark delete the shuffle files behind tables that are already written.

        They go when the driver's garbage collector has found their plans gone;
        waiting for a chance collection would keep them on disk meanwhile.  What
        Python lets go of reaches the JVM a moment later, so that a single
        collection finds nothing.
        """
        for _ in range(3):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *kept: DataFrame | None) -> None:
        """Deletes kept tables that nothing reads any more."""
        for df, at in self.made:
            if any(df is x for x in kept):
                delete(self.spark, at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
