"""Where intermediate tables live: a folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: What the names of folders of packed text files end in.
PACKED = ".packed"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, as in tests, a local master gets one beside its warehouse; a cluster must set one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes, as Spark estimates them, of a task of ``dealt``; estimates of joins and of local rows beyond the limit say nothing.
TASK_BYTES, UNKNOWN = 4 << 20, 1 << 42


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to as many tasks as their size asks for.

    Without a number, tasks are as large as the advisory size of shuffled data,
    which is compressed, and a chain of windows sorts its rows several times in
    one task.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(4096, 1 + size // TASK_BYTES), key) if size < UNKNOWN else df.repartition(key)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, read again: what follows neither repeats nor changes what came before."""
    spark, at = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
