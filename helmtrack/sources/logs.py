"""Text logs of motion.  Each file is a series, named by its path; rows keep the file's order.

A folder of packed files (``sinks.files.pack``) holds many series in a file,
since a file each is slow for many short ones: a line's series is the name
before its first tab.

Files are read by splits, so that a long log is the work of many tasks.  A
line's number is its place within its split after the lines of the splits
before, which are counted and added up by file.  Frames are numbered in the
same way, by spans of lines.  Lines that don't parse are skipped, as in the
devices' tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number
from ..operators.series import FRAME, ID
from ..storage import PACKED


#: Lines that are numbered together.
SPAN = 1 << 16


def packed(spark: SparkSession, path: str) -> DataFrame:
    """The name and the line of every line of packed files."""
    read = spark.read.option("lineSep", "\n").text(path.rstrip("/"))
    return read.select("_metadata", F.substring_index("value", "\t", 1).alias("name"), F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))


def is_packed(path: str) -> bool:
    return path.rstrip("/").endswith(PACKED)


def in_file_order(read: DataFrame, name: Column | None = None, **columns: Column) -> DataFrame:
    """series_id (the file's path, or ``name``), n (place in the file from 0) and the columns, for rows as a file reader gives them.

    A split's rows come one after another in one task, so that the running
    number of a row, less that of its split's first row, is its place in it.
    """
    raw = read.select((F.col("_metadata.file_path") if name is None else name).alias(ID), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), *[c.alias(name) for name, c in columns.items()])
    splits = raw.groupBy(ID, "_split").agg(F.count(F.lit(1)).alias("size"), F.min("_at").alias("first"))
    before = F.sum("size").over(Window.partitionBy(ID).orderBy("_split")) - F.col("size")
    places = splits.select(ID, "_split", (before - F.col("first")).alias("_shift"))
    return raw.join(places, [ID, "_split"]).select(ID, (F.col("_at") + F.col("_shift")).cast("bigint").alias("n"), *columns)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """series_id, n (line from 0), line; blank lines count, but are left out."""
    read = packed(spark, path) if is_packed(path) else spark.read.option("lineSep", "\n").text(path)
    return in_file_order(read, F.col("name") if is_packed(path) else None, line=F.regexp_replace("value", r"\r$", "")).where(F.trim("line") != "")


def renumbered(df: DataFrame, order: str = "n") -> DataFrame:
    """Frames from 0 by the order column, which goes and counts a file's lines or points.

    Rows are numbered within spans of it, after the rows of the spans before,
    so that no task needs all rows of a file.
    """
    spans = df.withColumn("_span", F.floor(F.col(order) / SPAN))
    sizes = spans.groupBy(ID, "_span").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(ID, "_span", (F.sum("_size").over(Window.partitionBy(ID).orderBy("_span")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(ID, "_span").orderBy(order)) - 1
    rows = spans.withColumn("_within", within).join(before, [ID, "_span"])
    return rows.withColumn(FRAME, (F.col("_before") + F.col("_within")).cast("bigint")).drop(order, "_span", "_within", "_before")


def _header(rows: DataFrame, is_header: Column) -> DataFrame:
    """series_id, at, header of the first header line of each file."""
    return rows.where(is_header).groupBy(ID).agg(F.min("n").alias("at"), F.min_by("line", "n").alias("header"))


def _field(parts: Column, names: Column, wanted: list[str], fallback: int) -> Column:
    """Number in the column of the first wanted name that exists, else at the fallback place."""
    place = F.lit(fallback)
    for w in reversed(wanted):
        p = F.array_position(names, w)
        place = F.when(p > 0, p.cast("int") - 1).otherwise(place)
    return number(F.get(parts, place))


def imu_log(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, t, gx, gy, gz, ax, ay, az of logs with a preamble.

    The header is the first of the first ten lines with 't,' or 'timestamp'.
    Times above 100000 are microseconds, above 1000 milliseconds, each row on
    its own.  Forces are null where the log has none.
    """
    rows = lines(spark, path)
    head = _header(rows, (F.col("n") < 10) & (F.col("line").contains("t,") | F.col("line").contains("timestamp")))
    names = F.transform(F.split(F.lower("header"), ","), lambda h: F.trim(h))
    body = rows.join(head, ID).where("n > at").withColumns({"p": F.split("line", ","), "h": names})
    raw = lambda c, i: _field(F.col("p"), F.col("h"), [c], i)
    t = raw("t", 0)
    sec = F.when(t > 100000, t / 1e6).when(t > 1000, t / 1e3).otherwise(t)
    out = body.select(ID, "n", sec.alias("t"), *[raw(c, i + 1).alias(c) for i, c in enumerate(("gx", "gy", "gz", "ax", "ay", "az"))])
    return renumbered(out.where("t is not null and gx is not null and gy is not null and gz is not null"))


def integrated(log: DataFrame) -> DataFrame:
    """series_id, frame, roll, pitch, yaw: running sums of an IMU log's rates."""
    from ..operators.series import integral

    t = F.col("t")
    return log.select(ID, FRAME, *[integral(F.col(g), t).alias(a) for g, a in (("gx", "roll"), ("gy", "pitch"), ("gz", "yaw"))])


def euler_log(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, roll, pitch, yaw of delimited logs.

    The first line is the header; its delimiter is a tab, else a semicolon,
    else a comma.  Columns are those whose names hold anglex or roll, angley or
    pitch, anglez or yaw (the last of each).
    """
    rows = lines(spark, path)
    head = rows.groupBy(ID).agg(F.min("n").alias("at"), F.min_by("line", "n").alias("header"))
    sep = F.when(F.col("header").contains("\t"), "\t").when(F.col("header").contains(";"), ";").otherwise(",")
    body = rows.join(head.withColumn("sep", sep), ID).where("n > at")
    names = F.transform(F.split(F.lower("header"), F.col("sep")), lambda h: F.trim(h))
    place = lambda a, b: F.array_max(F.filter(F.transform(F.col("h"), lambda h, i: F.when(h.contains(a) | h.contains(b), i)), lambda i: i.isNotNull()))
    parts = body.withColumns({"p": F.split("line", F.col("sep")), "h": names})
    value = lambda a, b: number(F.get(F.col("p"), place(a, b)))
    out = parts.select(ID, "n", value("anglex", "roll").alias("roll"), value("angley", "pitch").alias("pitch"), value("anglez", "yaw").alias("yaw"))
    return renumbered(out.where("roll is not null and pitch is not null and yaw is not null"))


#: Columns of the motion sidecars that trackers write (fixed layouts).
SIDECARS = {"kopf": {"yaw": 2, "pitch": 3, "roll": 4}, "kabsch": {"yaw": 4, "pitch": 5, "roll": 6}, "optical": {"dx": 1, "dy": 2, "yaw": 5, "pitch": 6}}


def motion(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """series_id, frame and the tracker's columns; lines with '#' are comments."""
    rows = lines(spark, path).where(~F.ltrim("line").startswith("#"))
    p = F.split(F.trim("line"), r"\s+")
    place = SIDECARS[kind]
    out = rows.select(ID, F.get(p, F.lit(0)).try_cast("bigint").alias(FRAME), *[F.get(p, F.lit(i)).try_cast("double").alias(c) for c, i in place.items()])
    kept = F.col(FRAME).isNotNull()
    for c in place:
        kept = kept & F.col(c).isNotNull()
    return out.where(kept)


def commands(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, t, yaw, pitch, roll of command files; files that say so hold changes, which are summed up."""
    from ..functions.text import parsed_commands

    rows = lines(spark, path)
    is_delta = rows.groupBy(ID).agg(F.max(F.col("line").contains("format: delta")).alias("delta"))
    sums = parsed_commands(rows, delta=True)
    plain = parsed_commands(rows)
    changes = is_delta.where("delta").select(ID)
    return sums.join(changes, ID, "left_semi").unionByName(plain.join(changes, ID, "left_anti"))


def rate(df: DataFrame, time: str = "t") -> DataFrame:
    """series_id, fps: one over the median time between rows; 30 for a single row."""
    dt = F.col(time) - F.lag(time).over(Window.partitionBy(ID).orderBy(time))
    return df.select(ID, dt.alias("dt")).groupBy(ID).agg((1.0 / F.greatest(F.coalesce(F.percentile("dt", F.lit(0.5)), F.lit(1.0 / 30.0)), F.lit(1e-4))).alias("fps"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, yaw, pitch, roll of transform files of either form.

    A file with '[enter]' in its first thirty lines holds commands: frames count
    its times from 1, and an axis that a time doesn't set is 0.  Other files
    have a frame and three numbers a line, parted by blanks; comments and lines
    that are no numbers are left out.
    """
    from ..functions.text import parsed_commands

    rows = lines(spark, path)
    sniffed = rows.where(F.col("n") < 30).groupBy(ID).agg(F.max(F.col("line").contains("[enter]")).alias("is_commands"))
    told = sniffed.where("is_commands").select(ID)
    commands_ = parsed_commands(rows.join(told, ID, "left_semi")).select(ID, (F.col(FRAME) + 1).alias(FRAME), "yaw", "pitch", "roll")
    p = F.split(F.trim("line"), r"\s+")
    number_ = lambda i: F.get(p, F.lit(i)).try_cast("double")
    plain = rows.join(told, ID, "left_anti").where(~F.ltrim("line").startswith("#"))
    plain = plain.select(ID, number_(0).cast("bigint").alias(FRAME), number_(1).alias("yaw"), number_(2).alias("pitch"), number_(3).alias("roll"))
    return commands_.unionByName(plain.where("frame is not null and yaw is not null and pitch is not null and roll is not null"))


#: Names that force columns go by (fixed values); a log's must be three in all.
FORCE_NAMES = ("acc_x", "acc_y", "acc_z", "acx", "acy", "acz", "ax", "ay", "az")


def force_log(spark: SparkSession, path: str) -> DataFrame:
    """series_id, frame, ax, ay, az of comma-separated logs with exactly three force columns, with or without rates."""
    rows = lines(spark, path)
    head = rows.groupBy(ID).agg(F.min("n").alias("at"), F.min_by("line", "n").alias("header"))
    names = F.transform(F.split(F.lower("header"), ","), lambda h: F.trim(h))
    wanted = F.array(*[F.lit(x) for x in FORCE_NAMES])
    places = F.transform(F.filter(wanted, lambda w: F.array_contains(F.col("h"), w)), lambda w: F.array_position(F.col("h"), w).cast("int") - 1)
    known = head.withColumn("h", names).withColumn("places", places).where(F.size("places") == 3).select(ID, "at", "places")
    parts = rows.join(known, ID).where("n > at").withColumn("p", F.split("line", ","))
    out = parts.select(ID, "n", *[number(F.get("p", F.col("places")[i])).alias(a) for i, a in enumerate(("ax", "ay", "az"))])
    return renumbered(out.where("ax is not null and ay is not null and az is not null"))


def force_tilt(log: DataFrame, *, least: int = 10, most: float = 30.0) -> DataFrame:
    """series_id, pitch, roll of the median force of logs of more than ``least`` rows, within ``most`` degrees."""
    found = log.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("ax", "ay", "az")]).where(F.col("n") > least)
    clip = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.degrees(x)))
    x, y, z = F.col("ax"), F.col("ay"), F.col("az")
    return found.select(ID, clip(F.atan2(-y, F.sqrt(x * x + z * z))).alias("pitch"), clip(F.atan2(x, z)).alias("roll"))
