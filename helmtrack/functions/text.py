"""Small parsers and formats as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it; within lambdas Spark shares nothing."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def number(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def clean_number(x: Column) -> Column:
    """A number that may end in m (metres) or z (zoom), in either case."""
    return number(F.regexp_replace(F.regexp_replace(F.trim(x), "[mM]+$", ""), "[zZ]+$", ""))


def seconds(x: Column) -> Column:
    """Seconds of HH:MM:SS, MM:SS or a number; null otherwise."""

    def of(part: Column) -> Column:
        at = lambda i: number(F.get(part, F.lit(i)))
        n = F.size(part)
        return F.when(n == 3, at(0) * 3600.0 + at(1) * 60.0 + at(2)).when(n == 2, at(0) * 60.0 + at(1)).when(n == 1, at(0))

    return once(F.split(F.trim(x), ":"), of)


def clock(sec: Column) -> Column:
    """HH:MM:SS of rounded seconds, never negative."""
    s = F.greatest(F.lit(0), F.rint(sec)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def subtitle_clock(sec: Column) -> Column:
    """H:MM:SS.cs; hundredths never reach a hundred."""
    whole = F.floor(sec).cast("bigint")
    hundredths = F.least(F.rint((sec - whole) * 100.0).cast("bigint"), F.lit(99))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, hundredths)


def coordinates(x: Column) -> Column:
    """struct(lat, lon) of two numbers parted by comma, semicolon, slash or blanks; null otherwise."""
    comma = F.filter(F.transform(F.split(F.trim(x), "[,;/]"), lambda p: F.trim(p)), lambda p: p != "")
    blank = F.filter(F.split(F.trim(F.regexp_replace(x, "[,;/]", " ")), r"\s+"), lambda p: p != "")
    part = F.when(F.size(comma) >= 2, comma).otherwise(blank)
    lat, lon = (number(F.get(part, F.lit(i))) for i in (0, 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def bounded_coordinates(x: Column) -> Column:
    """'lat,lon' with six decimals if both are on earth, else empty."""
    part = F.split(F.trim(x), ",")
    lat, lon = (number(F.get(part, F.lit(i))) for i in (0, 1))
    ok = (F.size(part) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.format_string("%.6f,%.6f", lat, lon)).otherwise("")


#: Marks of a map address (fixed values): the pin's latitude and longitude, the view's centre.
PIN_MARK, LON_MARK, VIEW_MARK = "!3d", "!4d", "@"
#: A number with a fraction, and a height that may be one.
FRACTION, HEIGHT = r"(-?\d+\.\d+)", r"(\d+(?:\.\d+)?)"


def _address(s: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height of a map address: the pin's place, else the view's; the view's height."""
    pin, view = f"{PIN_MARK}{FRACTION}{LON_MARK}{FRACTION}", f"{VIEW_MARK}{FRACTION},{FRACTION}"
    place = [F.coalesce(*[number(F.regexp_extract(s, mark, i)) for mark in (pin, view)]) for i in (1, 2)]
    return place[0], place[1], number(F.regexp_extract(s, f"{view},{HEIGHT}", 3))


def checkpoint(line: Column) -> Column:
    """struct(lat, lon, time, ele) of a checkpoint line.

    A map address gives its pin before its view's centre, and the view's height
    as elevation; a time may stand beside it.  Otherwise two to four tokens
    parted by commas: the one with a colon is the time, of four plain ones the
    first; the others are numbers in order.  Comments and anything else are
    null.
    """
    point = lambda lat, lon, t, e: F.struct(lat.alias("lat"), lon.alias("lon"), t.alias("time"), e.alias("ele"))
    known = lambda p: F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), p)

    def address(s: Column) -> Column:
        lat, lon, height = _address(s)
        beside = F.transform(F.filter(F.split(s, r"[\s,]+"), lambda p: ~p.startswith("http")), seconds)
        return once(point(lat, lon, F.get(F.filter(beside, lambda v: v.isNotNull()), F.lit(0)), height), known)

    def numbers(token: Column, clock_at: Column) -> Column:
        time = F.when(clock_at > 0, seconds(F.get(token, clock_at - 1)))
        return once(F.transform(F.filter(token, lambda p, i: i + 1 != clock_at), clean_number), lambda v: point(*[F.get(v, F.lit(i)) for i in (0, 1)], time, F.get(v, F.lit(2))))

    def listed_(token: Column) -> Column:
        n, colon = F.size(token), F.filter(token, lambda p: p.contains(":"))
        clock_at = F.coalesce(once(F.get(colon, F.lit(0)), lambda c: F.array_position(token, c)), F.when(n == 4, 1).otherwise(0)).cast("int")
        usual = n.between(2, 4) & ~((n == 3) & F.get(token, F.lit(1)).contains(":"))  # of three tokens, the middle one is no time
        return F.when(usual, once(once(clock_at, lambda c: numbers(token, c)), known))

    def of(s: Column) -> Column:
        token = F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")
        marked = F.when(s.contains(PIN_MARK) | s.contains(VIEW_MARK), address(s))  # few lines need its searches
        return F.when(s.startswith("#") | (s == ""), F.lit(None)).otherwise(F.coalesce(marked, once(token, listed_)))

    return once(F.trim(line), of)


#: Elevations in metres lie between these, both left out (fixed values).
LOWEST, HIGHEST = 0, 9000


def checkpoint_list(x: Column) -> Column:
    """Checkpoints of a text: a JSON list of objects (lat, lon, time, ele) or of lines, or lines; an array of what ``checkpoint`` gives.

    Entries that are no checkpoint are left out; a null text has none.
    """
    none = F.array().cast("array<struct<lat:double,lon:double,time:double,ele:double>>")
    items = lambda v: F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>"))  # noqa: E731  objects stay as their text
    entry = lambda i: F.when(F.ltrim(i).startswith("{"), _object(i)).otherwise(checkpoint(i))
    entries = once(x, lambda v: F.coalesce(items(v), F.split(v, r"\r?\n")))
    return F.coalesce(F.filter(F.transform(entries, entry), lambda p: p.isNotNull()), none)


def _object(x: Column) -> Column:
    field = lambda c: F.get_json_object(x, f"$.{c}")
    whole = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), seconds(field("time")).alias("time"), clean_number(field("ele")).alias("ele"))
    return once(F.struct(number(field("lat")).alias("lat"), number(field("lon")).alias("lon")), lambda p: F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), whole(p)))


def pasted_point(x: Column, elevation: float = 315.0) -> Column:
    """struct(lat, lon, ele, time) of any pasted text: a clock time, and the first two numbers in range.

    The number after these is the elevation, if it can be one.
    """
    s = F.trim(x)
    token = F.filter(F.split(s, r"[^0-9.:+-]+"), lambda p: p != "")
    is_clock = lambda p: (F.size(F.split(p, ":")) > 1) & (F.length(p) >= 4) & seconds(p).isNotNull()
    time = F.get(F.transform(F.filter(token, is_clock), seconds), F.lit(0))
    number_ = F.filter(F.transform(token, lambda p: p.try_cast("double")), lambda v: v.isNotNull())
    place = F.transform(number_, lambda v, i: F.struct(v.alias("lat"), F.get(number_, i + 1).alias("lon"), F.get(number_, i + 2).alias("next")))
    in_range = lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180) & ((p["lat"] != 0) | (p["lon"] != 0))
    first = F.get(F.filter(place, in_range), F.lit(0))
    high = (first["next"] > LOWEST) & (first["next"] < HIGHEST) & ~first["next"].isin(first["lat"], first["lon"])
    ele = F.when(high, first["next"]).otherwise(elevation)
    return F.when(~s.startswith("#") & first.isNotNull(), F.struct(first["lat"].alias("lat"), first["lon"].alias("lon"), ele.alias("ele"), time.alias("time")))


def timestamp(x: Column) -> Column:
    """UTC time of an ISO or a plain date-time text, or of seconds since 1970."""
    s = F.trim(x)
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(s, " ", "T")), F.try_to_timestamp(s), F.when(s.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((s.try_cast("double") * 1e6).cast("bigint"))))


def bitrate(x: Column, default: str = "") -> Column:
    s = F.upper(F.trim(x))
    digits = F.regexp_replace(s, "[^0-9]", "")
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.coalesce(digits, F.lit("")) == "", default).otherwise(F.concat(plain, F.when(s.rlike("[MKG]$"), F.right(s, F.lit(1))).otherwise("")))


def job_id(x: Column) -> Column:
    """ASCII letters, digits, dash and underscore; null where none is left."""
    return F.nullif(F.regexp_replace(x, "[^0-9A-Za-z_-]", ""), F.lit(""))


def preset_file(x: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(F.trim(x), "([^/]*)$", 1), r"[^a-zA-Z0-9_\-\.]", "_")
    return F.when(F.lower(name).endswith(".json"), name).otherwise(F.concat(name, F.lit(".json")))


def test_number(path: Column) -> Column:
    """Number of a test in a file name: after out, job or test, between marks, at the end, or the first of three digits."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    found = [F.regexp_extract(s, p, 1) for s, p in ((base, r"(?i)(?:out|job|test)[-_](\d+)"), (base, r"[-_.](\d{3,})[-_.]"), (stem, r"[-_](\d{3,})$"), (stem, r"(\d{3,})"))]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def safe_number(x: Column, default: float) -> Column:
    return F.coalesce(number(x), F.lit(default))


def safe_choice(x: Column, allowed: list[str], default: str) -> Column:
    return F.when(F.trim(x).isin(allowed), F.trim(x)).otherwise(default)


def required(x: Column, name: str) -> Column:
    """The value; an error where it is missing or blank."""
    return F.when(F.coalesce(F.trim(x.cast("string")), F.lit("")) != "", x).otherwise(F.raise_error(F.lit(f"missing parameter: {name}")).cast("string"))


def clip_offset(name: Column, fps: float) -> Column:
    """Seconds into the recording of a clip named ..._first_last."""
    return F.regexp_extract(name, r"_(\d+)_(\d+)(?:\.|$)", 1).try_cast("double") / fps


def natural_key(x: Column, width: int = 20) -> Column:
    """Sorts digit runs by their value: they are padded to one width, letters lower-cased."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(r)), "")


def listed(x: Column) -> Column:
    """A JSON list of texts, or texts parted by commas."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.from_json(x, "array<string>"), parts)


def command_lines(df: DataFrame, *, fps: float) -> DataFrame:
    """series_id, line: one command a frame and axis (yaw, pitch, roll)."""
    start = F.when(F.col("frame") == 0, 0.0).otherwise((F.col("frame") - 0.5) / fps)
    long = df.select("series_id", start.alias("t0"), ((F.col("frame") + 0.5) / fps).alias("t1"), "yaw", "pitch", "roll").unpivot(["series_id", "t0", "t1"], ["yaw", "pitch", "roll"], "axis", "value")
    return long.select("series_id", F.format_string("%.6f-%.6f [enter] v360 %s %.6f;", "t0", "t1", "axis", "value").alias("line"))


COMMAND = r"^\s*([0-9.]+)(?:-([0-9.]+))?\s*\[enter\]"


def parsed_commands(lines: DataFrame, *, delta: bool = False) -> DataFrame:
    """series_id, frame, t, yaw, pitch, roll of command lines; frames follow the start times.

    Axes that a time lacks are 0.  Changes are summed up.
    """
    rows = lines.where(F.col("line").contains("[enter]") & ~F.ltrim("line").startswith("#"))
    value = lambda a: F.max(F.regexp_extract("line", rf"\b{a}\s+(-?[0-9.]+)", 1).try_cast("double"))
    wide = rows.groupBy("series_id", F.round(F.regexp_extract("line", COMMAND, 1).cast("double"), 6).alias("t")).agg(*[F.coalesce(value(a), F.lit(0.0)).alias(a) for a in ("yaw", "pitch", "roll")])
    w = Window.partitionBy("series_id").orderBy("t")
    out = wide.withColumn("frame", (F.row_number().over(w) - 1).cast("bigint"))
    return out.withColumns({a: F.sum(a).over(w) for a in ("yaw", "pitch", "roll")}) if delta else out
