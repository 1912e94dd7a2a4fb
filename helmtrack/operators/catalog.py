"""Bookkeeping: job states, artifacts, candidates, presets, estimates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: States of a running job, and names that mean the same end (fixed values).
ACTIVE = ("running", "processing", "paused", "queued")
ENDS = {"canceled": "cancelled", "cancelled": "cancelled"}


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key by the order columns."""
    others = [c for c in events.columns if c != key]
    best = events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in others])


def first_seen(rows: DataFrame, key: str, place: str) -> DataFrame:
    """key, place: each value once, in the order they first come."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


def status(name: Column) -> Column:
    """One spelling for each end state."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ENDS.items() for x in p]), F.lower(name)), F.lower(name))


def with_lost_failed(jobs: DataFrame, alive: DataFrame, *, pid: str = "pid", state: str = "status") -> DataFrame:
    """Active jobs whose process is gone count as failed."""
    live = alive.select(pid).distinct().withColumn("_live", F.lit(True))
    lost = F.col(state).isin(*ACTIVE) & F.col("_live").isNull()
    return jobs.join(live, pid, "left").withColumn(state, F.when(lost, "failed").otherwise(F.col(state))).drop("_live")


def best_artifact(rows: DataFrame, key: str, *rank: str) -> DataFrame:
    """The row of highest rank of each key; equal ranks go to the smallest path."""
    others = [c for c in rows.columns if c != key]
    w = Window.partitionBy(key).orderBy(*[F.desc(r) for r in rank], "path")
    return rows.withColumn("_p", F.row_number().over(w)).where("_p = 1").select(key, *others)


def first_present(candidates: DataFrame, key: str, place: str, size: str) -> DataFrame:
    """The first candidate of each key that isn't empty, after doubles are dropped."""
    others = [c for c in candidates.columns if c != key]
    return candidates.where(F.col(size) > 0).groupBy(key).agg(F.min_by(F.struct(*others), place).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in others])


#: Endings of companion files after a video's name, in the order they are looked for (fixed values); {name} is the video's file, {stem} the same without its ending.
RATE_LOGS = ("{stem}.gcsv", "{name}.gcsv", "{stem}_telemetry.gcsv")
ANGLE_LOGS = ("{stem}_telemetry.txt", "{stem}.telemetry.txt", "{stem}.csv", "{stem}_telemetry.csv", "{stem}.txt")
#: What a hint asks for.
HINTS = {"gyroflow": RATE_LOGS, "witmotion": ANGLE_LOGS, "custom_csv": ANGLE_LOGS}


def companions(videos: DataFrame, files: DataFrame, *, folders: Sequence[str] = ()) -> DataFrame:
    """video, place, path: the companion logs of each video that exist and aren't empty, in the order in which they are looked for.

    ``videos`` has path and hint, ``files`` path and size.  Names are looked for
    beside the video first and then in the standard folders; rate logs in all
    folders come before angle logs.  Without a known hint both kinds count, and
    of a path that is named twice the first.
    """
    folder, name = F.regexp_extract("path", "^(.*?)/?[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    stem = lambda n: F.regexp_replace(n, r"(?<=.)\.[^.]*$", "")
    ending = lambda form: re.sub(r"^\{\w+\}", "", form)
    # a video and its files share what their paths have before the video's own ending: a row a folder, not a row a name
    rows = videos.select(F.col("path").alias("video"), "hint", name.alias("name"), stem(name).alias("stem"), F.posexplode(F.array_distinct(F.array(folder, *map(F.lit, folders)))).alias("j", "at"))
    prefix = F.when(F.col("at") != "", F.concat("at", F.lit("/"))).otherwise("")
    looking = rows.select("video", "hint", "j", F.concat(prefix, "stem").alias("key"), F.substr("name", F.length("stem") + 1).alias("own"))

    keys = []
    for form in (*RATE_LOGS, *ANGLE_LOGS):
        base = F.when(F.endswith("path", F.lit(ending(form))), F.left("path", F.length("path") - len(ending(form))))
        last = F.substring_index(base, "/", -1)
        keys.append(base if form.startswith("{stem}") else F.concat(F.left(base, F.length(base) - F.length(last)), stem(last)))
    listed = files.where(F.col("size") > 0).select("path", F.explode(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))).alias("key"))
    pairs = looking.join(listed.select("key", F.substr("path", F.length("key") + 1).alias("tail")).hint("merge"), "key")  # as many as the files: never broadcast

    place, first = F.when(F.lit(False), 0), 0
    for endings in (RATE_LOGS, ANGLE_LOGS):
        hinted = [h for h, e in HINTS.items() if e == endings]
        allowed = F.coalesce(F.col("hint").isin(hinted) | ~F.col("hint").isin(list(HINTS)), F.lit(True))
        for i, form in enumerate(endings):
            own = F.lit("") if form.startswith("{stem}") else F.col("own")
            place = place.when(allowed & (F.col("tail") == F.concat(own, F.lit(ending(form)))), first + F.col("j") * len(endings) + i)
        first += (1 + len(folders)) * len(endings)
    found = pairs.select("video", F.concat("key", "tail").alias("path"), place.alias("at")).where("at is not null")
    w = Window.partitionBy("video").orderBy("at")
    ranked = found.select("video", F.dense_rank().over(w).alias("place"), "path", F.lag("at").over(w).eqNullSafe(F.col("at")).alias("again"))
    return ranked.where("not again").drop("again")


#: Endings of pictures and of videos (fixed values).
PICTURES, VIDEOS = ("jpg", "jpeg", "png", "webp"), ("mp4", "insv", "mov", "mkv")


def media(files: DataFrame) -> DataFrame:
    """path, kind, changed of the pictures and videos among files (path, changed), each path once, the newest first."""
    path = F.regexp_replace("path", r"\\", "/")
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    kind = F.when(ending.isin(*PICTURES), "image").when(ending.isin(*VIDEOS), "video")
    rows = files.select(path.alias("path"), kind.alias("kind"), "changed").where("kind is not null")
    return rows.groupBy("path", "kind").agg(F.max("changed").alias("changed")).orderBy(F.desc("changed"), "path")


def next_prefix(last: Column) -> Column:
    """Run prefixes go 1001 .. 9999 and begin again."""
    return F.when(last.between(1001, 9998), last + 1).otherwise(1001)


def disk_needed(size_mb: Column, stages: Column, margin_mb: float = 500.0) -> Column:
    return size_mb * stages + margin_mb


def progress(current: Column, duration: Column, active: Column, speed: Column) -> tuple[Column, Column]:
    """Percent and seconds to go; padding after the active part counts for the last percent."""
    real = F.when(active > 0, active).otherwise(duration)
    padded, before = duration > real, current < real
    low = lambda x: F.greatest(F.lit(0.0), x)
    overhead = F.least(F.lit(3), F.greatest(F.lit(1), ((duration - real) * 0.01).cast("int")))
    part = (low(real - current) / speed).cast("int") + overhead
    rest = F.greatest(F.lit(1), (low(duration - current) / F.greatest(F.lit(100.0), speed)).cast("int"))
    eta = F.when(speed > 1e-4, F.when(padded & before, part).when(padded, rest).otherwise((low(duration - current) / speed).cast("int")))
    floor = lambda x: F.greatest(x, F.lit(0.001))
    share = F.when(padded & before, F.least(F.lit(98.0), current / floor(real) * 98.0)).when(padded, F.least(F.lit(99.0), 98.0 + (current - real) / floor(duration - real))).otherwise(F.least(F.lit(99.0), current / duration * 100.0))
    return share, eta


#: Stage costs in seconds: a fixed part and a part for each second of video (fixed values).
COSTS = {"telemetry": (2.0, 0.05), "kopf": (5.0, 1.9), "kabsch": (3.0, 1.2), "vidstab": (6.0, 4.5), "cinematic": (2.0, 0.15), "horizon": (2.0, 0.1), "traveldir": (1.5, 0.08)}


def estimate(duration: Column, stages: Column) -> Column:
    """Seconds that the named stages (an array) take over a video of that length."""
    costs = F.create_map(*[x for k, (a, b) in COSTS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("base"), F.lit(b).alias("each")))])
    one = lambda s: F.coalesce(F.try_element_at(costs, s)["base"] + F.try_element_at(costs, s)["each"] * duration, F.lit(0.0))
    return F.aggregate(stages, F.lit(0.0), lambda t, s: t + one(s))


def preset_value(json: Column, name: str, kind: str, default: object) -> Column:
    """A parameter of a preset, whose numbers are often written as texts."""
    return F.coalesce(F.get_json_object(json, f"$.{name}").try_cast(kind), F.lit(default).cast(kind))


def degraded(report: Column) -> Column:
    """Whether a report's status says that the stage made things worse."""
    return report.rlike(r"(?m)^STATUS\s*:\s*NO \(UNSTABILIZED\)")


def executed(stages: DataFrame, done: DataFrame, reverted: DataFrame, *keys: str) -> DataFrame:
    """Every stage with its outcome: reverted, executed or skipped."""
    a = done.select(*keys).distinct().withColumn("_d", F.lit(True))
    b = reverted.select(*keys).distinct().withColumn("_r", F.lit(True))
    out = stages.join(a, list(keys), "left").join(b, list(keys), "left")
    return out.withColumn("outcome", F.when(F.col("_r"), "reverted").when(F.col("_d"), "executed").otherwise("skipped")).drop("_d", "_r")


def key_packet(packets: DataFrame, asks: DataFrame, key: str, slack: float = 0.01) -> DataFrame:
    """Last key packet at or before each asked time (with a little slack): key, asked, pts."""
    from .joins import bracketed

    grid = asks.select(key, (F.col("asked") + slack).alias("pts"), "asked")
    return bracketed(packets.where("is_key").select(key, "pts"), grid, key, "pts", []).select(key, "asked", F.col("before.pts").alias("pts"))


def natural(rows: DataFrame, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """Rows with a natural-order key: digit runs count by value."""
    from ..functions.text import natural_key

    return rows.select(name, *columns, natural_key(F.col(name)).alias("natural"))


def placed(rows: DataFrame, *order: str, place: str = "place") -> DataFrame:
    """Every row with its place from 1 in a total order, without a window over all rows.

    Rows are sorted by ranges; a row's place is its number within its range
    after the sizes of the ranges before.  The numbered rows are written, so
    that sizes and rows come from one and the same sort; only the sizes, one a
    partition, are added up in one place.
    """
    numbered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return numbered.withColumn("_part", part).join(before, "_part").select(*rows.columns, (F.col("_before") + within + 1).cast("bigint").alias(place))


def fresh(changed: Column, began: Column, slack: float = 5.0) -> Column:
    """Whether a file belongs to a job: changed no earlier than ``slack`` seconds before the job began; all do where it has no start."""
    return began.isNull() | (changed >= began - slack)


def sampled(rows: DataFrame, key: str, id_: str, most: int = 80, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each key, those whose ids have the smallest digests under the seed."""
    digest = F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))))
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(digest, id_)))
    return ranked.where(F.col("_place") <= most).drop("_place")


#: What a report's status says of a stage that made things worse (fixed values).
WORSE = ("NO (", "UNSTABILIZED", "DEGRADED", "FAILED")


def fallback(stages: DataFrame, key: str, order: str = "place") -> DataFrame:
    """Every stage with ``status``, ``reverted`` and ``current``, the file that the next stage goes on with.

    Columns: the key, the order, stage, input, output, report.  A report's
    first line with STATUS decides.  A stage that made things worse is taken
    back: its input, the last output that stood, goes on.
    """
    line = F.regexp_extract("report", r"(?m)^(.*STATUS.*)$", 1)
    status = F.trim(F.when(line.contains(":"), F.substr(line, F.instr(line, ":") + 1, F.length(line))).otherwise(line))
    worse = F.lit(False)
    for word in WORSE:
        worse = worse | F.coalesce(F.upper("status"), F.lit("")).contains(word)
    w = Window.partitionBy(key).orderBy(order)
    seen = stages.withColumn("status", status).withColumn("reverted", worse)
    stood = F.last(F.when(~F.col("reverted"), F.col("output")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("current", F.coalesce(stood, F.first("input").over(w))).drop("report")


def warmup(videos: DataFrame, telemetry: DataFrame, visual: DataFrame, key: str) -> DataFrame:
    """key, has_warmup, start_frame, start_time, kind: where each video begins.

    ``telemetry`` and ``visual`` have key, start_frame and kind of what either
    inspection found; ``videos`` has key, fps and total_frames.  Telemetry wins
    but against a later black or frozen start.
    """
    t, v = (d.select(key, F.col("start_frame").alias(f"{n}_frame"), F.col("kind").alias(f"{n}_kind")) for d, n in ((telemetry, "t"), (visual, "v")))
    later = F.col("v_kind").isin("visual_black", "visual_frozen") & (F.col("v_frame") > F.col("t_frame"))
    visual_wins = F.col("t_frame").isNull() | F.coalesce(later, F.lit(False))
    both = videos.join(t, key, "left").join(v, key, "left")
    chosen = both.withColumns({"frame": F.when(visual_wins, F.col("v_frame")).otherwise(F.col("t_frame")), "kind": F.when(visual_wins, F.col("v_kind")).otherwise(F.col("t_kind"))})
    has = F.coalesce(F.col("frame") > 0, F.lit(False))
    start = F.when(has, F.least(F.col("frame"), F.col("total_frames") - 1)).otherwise(0)
    return chosen.select(key, has.alias("has_warmup"), start.cast("bigint").alias("start_frame"), F.round(start / F.col("fps"), 3).alias("start_time"), F.when(has, F.col("kind")).otherwise("none").alias("kind"))


def preset_document(config: Column, saved_at: Column, kind: str = "pipeline_config") -> Column:
    """A preset's JSON object with its type and time of saving, in place of any it had; null where it is no object."""
    fields = F.map_filter(F.from_json(config, "map<string,variant>"), lambda k, v: ~k.isin("type", "saved_at"))
    text = lambda x: F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"')))
    stamps = F.map_from_arrays(F.array(F.lit("type"), F.lit("saved_at")), F.array(text(F.lit(kind)), text(saved_at)))
    return F.to_json(F.map_concat(fields, stamps))
