"""Text formats that other tools read.

Each function gives rows (series_id, n, line) or one document a series; ``save``
writes them in the order of their lines, one folder a series, ``pack`` many
series a file.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rotation import quaternion_zyx
from ..functions.text import command_lines, subtitle_clock
from ..operators.series import FRAME, ID, ordered
from ..storage import PACKED

#: First time stamp of a log, and the heads of the formats (fixed values).
EPOCH = "2026-07-21 00:00:00"
TELEMETRY_HEAD = "ChipTime\tAngleX(deg)\tAngleY(deg)\tAngleZ(deg)\tq0\tq1\tq2\tq3\tTime(s)"
IMU_HEAD = ("GYROFLOW IMU LOG", "version,1.3", "id,{name}", "orientation,Xyz", "tscale,1.0", "gscale,0.017453292519943295", "ascale,1.0", "t,gx,gy,gz,ax,ay,az")


def _headed(body: DataFrame, head: list[str]) -> DataFrame:
    """Head lines have numbers below 0."""
    keys = body.select(ID).distinct()
    places = F.array(*[F.struct(F.lit(i - len(head)).cast("bigint").alias("n"), F.lit(h).alias("line")) for i, h in enumerate(head)])
    return keys.select(ID, F.inline(places)).unionByName(body.select(ID, F.col("n").cast("bigint").alias("n"), "line"))


def telemetry_log(df: DataFrame, fps: float = 30.0) -> DataFrame:
    """Nine columns parted by tabs: stamp, angles, quaternion, seconds."""
    q = quaternion_zyx(F.col("roll"), F.col("pitch"), F.col("yaw"))
    sec = F.col(FRAME) / fps
    stamp = F.date_format(F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(secs=sec), "yyyy-MM-dd HH:mm:ss.SSS")
    rows = df.withColumns({"q": q, "sec": sec, "stamp": stamp})
    line = F.concat_ws("\t", "stamp", *[F.format_string("%.6f", c) for c in ("roll", "pitch", "yaw")], *[F.format_string("%.6f", F.col("q")[c]) for c in "wxyz"], F.format_string("%.6f", "sec"))
    return _headed(rows.select(ID, F.col(FRAME).alias("n"), line.alias("line")), [TELEMETRY_HEAD])


def imu_log(df: DataFrame, name: str = "log") -> DataFrame:
    """Comma-separated rates and forces after a preamble of seven lines."""
    line = F.concat_ws(",", *[F.format_string("%.6f", c) for c in ("t", "gx", "gy", "gz", "ax", "ay", "az")])
    return _headed(df.select(ID, F.col(FRAME).alias("n"), line.alias("line")), [h.format(name=name) for h in IMU_HEAD])


def command_file(df: DataFrame, *, fps: float = 30.0, delta: bool = False) -> DataFrame:
    """Command lines; with ``delta`` the angles given are changes, and the file says so."""
    place = {"yaw": 0, "pitch": 1, "roll": 2}
    lines = command_lines(df, fps=fps)
    axis, start = F.regexp_extract("line", r"v360 (\w+)", 1), F.regexp_extract("line", r"^([0-9.]+)-", 1).cast("double")
    order = sum((F.when(axis == a, i).otherwise(0) for a, i in place.items()), F.lit(0))
    rows = lines.select(ID, (F.rint(F.when(start == 0, 0.0).otherwise(start * fps + 0.5)) * 3 + order).cast("bigint").alias("n"), "line")
    return _headed(rows, ["# format: delta"]) if delta else rows


def motion_file(df: DataFrame, columns: list[str], comment: str) -> DataFrame:
    """Columns parted by blanks after a comment line."""
    line = F.concat_ws(" ", F.col(FRAME).cast("string"), *[F.format_string("%.6f", c) for c in columns])
    return _headed(df.select(ID, F.col(FRAME).alias("n"), line.alias("line")), [f"# {comment}"])


def motion_binary(df: DataFrame, *, fps: float = 30.0) -> DataFrame:
    """series_id, content: the binary motion file of each series, little-endian.

    A count in eight bytes, then a frame's start, end, yaw, pitch and roll as
    doubles.  A file is one series, of forty bytes a frame.
    """
    kind = df.schema[ID].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(FRAME, kind="stable")
        n = np.arange(len(rows))
        body = np.column_stack([n / fps, (n + 1) / fps, rows[["yaw", "pitch", "roll"]].to_numpy(np.float64)])
        return pd.DataFrame({ID: rows[ID].iloc[:1], "content": [np.int64(len(rows)).astype("<i8").tobytes() + body.astype("<f8").tobytes()]})

    return df.select(ID, FRAME, "yaw", "pitch", "roll").groupBy(ID).applyInPandas(run, f"{ID} {kind}, content binary")


def subtitles(df: DataFrame, text: str, time: str = "t", fps: float = 30.0) -> DataFrame:
    """Dialogue lines; each ends where the next begins, the last one a frame later."""
    end = F.coalesce(F.lead(time).over(ordered()), F.col(time) + 1.0 / fps)
    line = F.concat(F.lit("Dialogue: 0,"), subtitle_clock(F.col(time)), F.lit(","), subtitle_clock(end), F.lit(",Default,,0,0,0,,"), F.col(text))
    return df.select(ID, F.col(FRAME).alias("n"), line.alias("line"))


def gpx(points: DataFrame, start: str) -> DataFrame:
    """series_id, document: GPX 1.1 of tracks (series_id, sec, lat, lon, ele); a track has a point a second."""
    stamp = F.date_format(F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("sec")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ele = F.when(F.col("ele").isNotNull(), F.format_string("\n        <ele>%.3f</ele>", "ele")).otherwise("")
    point = F.concat(F.format_string('      <trkpt lat="%.8f" lon="%.8f">', "lat", "lon"), ele, F.lit("\n        <time>"), stamp, F.lit("</time>\n      </trkpt>"))
    body = points.select(ID, F.struct("sec", point.alias("xml")).alias("p")).groupBy(ID).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["xml"]), "\n").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="helmtrack" xmlns="http://www.topografix.com/GPX/1/1">\n  <trk>\n    <trkseg>\n'
    return body.select(ID, F.concat(F.lit(head), "body", F.lit("\n    </trkseg>\n  </trk>\n</gpx>\n")).alias("document"))


def route_page(points: DataFrame, title: str = "Route") -> DataFrame:
    """series_id, document: a page with the track's points as JSON, for a map script to draw."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sec", "lat", "lon", "ele"))), lambda p: p)
    data = points.groupBy(ID).agg(F.to_json(listed).alias("data"))
    return data.select(ID, F.concat(F.lit(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title></head><body><div id="map"></div>\n<script type="application/json" id="points">'), "data", F.lit("</script></body></html>\n")).alias("document"))


def report(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """series_id, n, line: 'KEY : value' lines of a row of metrics."""
    pairs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("n"), F.concat(F.lit(f"{c.upper():<20}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias("line")) for i, c in enumerate(columns)])
    return metrics.select(ID, F.inline(pairs))


def sectioned_report(metrics: DataFrame, title: str, sections: Sequence[tuple[str, Sequence[tuple[str, str, str]]]]) -> DataFrame:
    """series_id, n, line: a title, and sections of labelled values.

    A section is its heading and (label, column, format) of its values, such as
    '%.3f deg'.  A value that is null takes its line with it, and a section
    without values its heading.
    """
    filled = [(head, [(label, F.format_string(form, column), F.col(column).isNotNull()) for label, column, form in values]) for head, values in sections]
    parts = [F.lit(f"=== {title.upper()} ===")]
    for head, values in filled:
        some = F.lit(False)
        for _, _, known in values:
            some = some | known
        parts += [F.when(some, F.lit("")), F.when(some, F.lit(f"--- {head.upper()} ---"))]
        parts += [F.when(known, F.concat(F.lit(f"{label:<20}: "), text)) for label, text, known in values]
    lines = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return metrics.select(ID, F.posexplode(lines).alias("n", "line")).select(ID, F.col("n").cast("bigint").alias("n"), "line")


def checkpoint_log(points: DataFrame, settings: DataFrame, *, fps: float = 29.97) -> DataFrame:
    """series_id, n, line: an audit log of each series' levelling checkpoints (series_id, frame, pitch, roll, yaw, kind).

    ``settings`` has a row a series: video, total, strategy, source, density,
    prominence, damping, base_pitch, base_roll, still; null settings read N/A.
    Series without checkpoints say so.
    """
    named = lambda c, form="%s": F.coalesce(F.format_string(form, c), F.lit("N/A"))
    known = lambda c, form: F.when(F.col(c).isNotNull(), F.format_string(form, c)).otherwise("N/A")
    rule = F.lit("-" * 80)
    listed = points.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(FRAME, "pitch", "roll", "yaw", "kind"))).alias("points"))
    row = lambda p, i: F.concat(
        F.format_string("  [#%02d] Frame %6d (%6.2fs) | Pitch: %+6.2f | Roll: %+6.2f | Yaw: %+6.2f", i + 1, p[FRAME], p[FRAME] / F.lit(fps), p["pitch"], p["roll"], p["yaw"]),
        F.when(F.coalesce(p["kind"], F.lit("")) != "", F.concat(F.lit(" ["), p["kind"], F.lit("]"))).otherwise(""),
    )
    size = F.coalesce(F.size("points"), F.lit(0))
    head = [
        F.lit("LEVELLING PARAMETERS"), rule, F.concat(F.lit("Video     : "), known("video", "%s")), F.concat(F.lit(f"Frames    : {fps} fps, "), named("total", "%d")),
        F.concat(F.lit("Strategy  : "), known("strategy", "%s")), F.concat(F.lit("Source    : "), known("source", "%s")), F.concat(F.lit("Density   : "), known("density", "%s")),
        F.concat(F.lit("Prominence: "), F.when(F.col("source") == "vision", "N/A").otherwise(known("prominence", "%.2f"))), F.concat(F.lit("Damping   : "), F.when(F.col("source") == "vision", "N/A").otherwise(known("damping", "%.2fx"))),
        F.concat(F.lit("Baseline  : "), F.format_string("%.2f, %.2f", F.coalesce("base_pitch", F.lit(0.0)), F.coalesce("base_roll", F.lit(0.0)))), F.concat(F.lit("Yaw       : "), F.when(F.coalesce("still", F.lit(True)), "ignored").otherwise("kept")),
        F.format_string("CHECKPOINTS (%d)", size), rule,
    ]
    body = F.when(size > 0, F.transform("points", row)).otherwise(F.array(F.lit("  (none)")))
    return settings.join(listed, ID, "left").select(ID, F.posexplode(F.concat(F.array(*head), body)).alias("n", "line")).select(ID, F.col("n").cast("bigint").alias("n"), "line")


def append(rows: DataFrame, path: str, batch: str, *, key: str = ID) -> bool:
    """Appends a batch of rows to a log, once: a batch that is in already is left alone, and what a failed try left is written over.

    A log is a folder of batches; readers take those that ended (``_SUCCESS``).
    """
    spark = rows.sparkSession
    at = f"{path.rstrip('/')}/batch={batch}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    rows.write.mode("overwrite").parquet(at)
    return True


def dated_notes(notes: DataFrame) -> DataFrame:
    """series_id, n, line of notes (series_id, dated, title, content): sections headed by date and title, in the order of date and title."""
    w = Window.partitionBy(ID).orderBy("dated", "title", "content")
    text = F.concat(F.lit("## ["), F.col("dated").cast("string"), F.lit("] "), "title", F.lit("\n"), F.trim("content"), F.lit("\n"))
    rows = notes.select(ID, F.row_number().over(w).alias("k"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return _headed(rows.select(ID, (F.col("k").cast("bigint") * 1_000_000 + F.col("i")).alias("n"), "line"), ["# Notes", ""])


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines with the name of their series, a series in one task.

    Rows are dealt by the name, not by the id.  A union of rows that are dealt
    by the id already needs no exchange, and its sides are then coalesced each
    for itself, which parts a series' head from its body.
    """
    named = lines.withColumn("name", F.concat(F.lit(f"{ID}="), F.col(ID).cast("string"), F.lit("/")))
    return named.repartition("name")


def save(lines: DataFrame, path: str) -> None:
    """A folder for each series, its lines in order; for many series, ``pack`` makes fewer files."""
    _dealt(lines).sortWithinPartitions(ID, "n").select(ID, "line").write.partitionBy(ID).text(path)


def pack(lines: DataFrame, path: str) -> str:
    """Many series in a file: each line after its series' name (``series_id=7/``) and a tab, in order.  Gives the path that readers take.

    Readers know packed files by the ending of their folder, ``PACKED``.
    """
    at = path + PACKED
    _dealt(lines).sortWithinPartitions("name", "n").select(F.concat("name", F.lit("\t"), "line").alias("value")).write.text(at)
    return at
