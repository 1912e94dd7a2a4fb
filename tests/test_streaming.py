"""Streams give what batches give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helmtrack.operators import recurrence as rec
from helmtrack.streaming import fusion


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name).toPandas()


@pytest.mark.parametrize("method", ["ekf", "complementary"])
def test_fusion_equals_the_batch(spark, tmp_path, method):
    rows = spark.range(60).select((F.col("id") % 2).alias("series_id"), F.floor(F.col("id") / 2).alias("frame"), *[(F.sin(F.col("id") * k)).alias(c) for k, c in enumerate(("gx", "gy", "gz", "ax", "ay", "az"), 1)])
    at = str(tmp_path / "in")
    for lo in (0, 15):  # two micro-batches
        rows.where(F.col("frame").between(lo, lo + 14)).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    got = run(spark, fusion.fuse_stream(stream, method=method, gain=0.6), f"fused_{method}").sort_values(["series_id", "frame"])
    want = rec.fuse(rows, method=method, gain=0.6).orderBy("series_id", "frame").toPandas()
    assert len(got) == 60
    for c in ("roll", "pitch", "yaw"):
        assert got[c].tolist() == pytest.approx(want[c].tolist())


def test_progress(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.0, 0.0, 10.0), (1, 1.0, 2.0, 10.0), (1, 2.0, 3.0, 10.0), (1, 9.0, 16.0, 10.0)], "job bigint, at double, done double, total double").write.parquet(at)
    stream = spark.readStream.schema("job bigint, at double, done double, total double").parquet(at)
    out = run(spark, fusion.progress_stream(stream), "progress").sort_values("at")
    assert out.speed.tolist()[1:3] == pytest.approx([2.0, 0.3 * 1.0 + 0.7 * 2.0])
    assert out.runaway.tolist() == [False, False, False, True]


def test_a_job_that_falls_silent(spark, tmp_path):
    """Ticks too soon after a report are held; timers report the last of them, and then the silence, without further ticks."""
    import time

    at = str(tmp_path / "in")
    schema = "job bigint, at double, done double, total double, active double"
    ticks = [(1, 0.0, 0.0, 20.0, 10.0), (1, 1.0, 5.0, 20.0, 10.0), (1, 1.1, 6.0, 20.0, 10.0), (1, 1.2, 7.0, 20.0, 10.0), (2, 0.0, 26.0, 20.0, 10.0), (2, 0.1, 31.0, 20.0, 10.0), (3, 5.0, 26.0, 20.0, 0.0)]
    spark.createDataFrame(ticks, schema).coalesce(1).write.parquet(at)
    stream = fusion.progress_stream(spark.readStream.schema(schema).parquet(at), silence=2.0, live=True)
    q = stream.writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            out = spark.table("silent").toPandas()
            if out.silent.sum() == 3:
                break
        time.sleep(3)
        out = spark.table("silent").toPandas()
    finally:
        q.stop()
        q.awaitTermination(60)
    tell = lambda job: [(r.at, r.progress, r.runaway, r.silent) for r in out[out.job == job].itertuples()]
    assert tell(1) == [(0.0, 0.0, False, False), (1.0, 49.0, False, False), (1.2, 68.6, False, False), (1.2, 68.6, False, True)]
    assert tell(2) == [(0.0, 98.0 + 1.0, False, False), (0.1, 99.0, True, False), (0.1, 99.0, True, True)]  # padding allows ten seconds
    assert tell(3) == [(5.0, 99.0, True, False), (5.0, 99.0, True, True)]


def test_windows(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.sql("select timestamp'2026-01-01 00:10:00' ts, 'a' event_type, 2.0D value union all select timestamp'2026-01-01 03:00:00', 'a', 3.0D").write.parquet(at)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(at)
    out = run(spark, fusion.windowed(stream), "windows")
    assert out.total.tolist() == [2.0]
