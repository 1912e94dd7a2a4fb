"""Binary telemetry: boxes of media files, orientation records, metadata streams.

A recording is many gigabytes of pictures around some megabytes of telemetry,
so files are not read as values: Spark lists their names and lengths, and tasks
open them by name in whatever store they are, seek from box head to box head,
and read the wanted payload alone.  A payload of fixed records is planned as
byte ranges, which Spark deals out, so that a long one is the work of many
tasks; streams of items of any length are read through a window of bounded
size.  Contents that are already rows (a ``content`` column) are decoded by the
same code where they lie.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rotation
from ..operators.series import FRAME, ID

#: Boxes that hold other boxes (fixed names); 'meta' has four bytes more before them.
PARENTS = ("moov", "trak", "mdia", "minf", "stbl", "udta", "meta", "moof", "traf", "edts", "dinf")
#: Bytes that a file is read by, bytes of a planned range, and rows of a batch.
WINDOW, RANGE, ROWS = 1 << 20, 1 << 22, 1 << 16


class Held:
    """Bytes of a content that is a row."""

    def __init__(self, content: bytes):
        self.content, self.size = content, len(content)

    def get(self, at: int, n: int) -> bytes:
        return self.content[at : at + n]


class Stored:
    """Bytes of a file in any store, by seeking; small reads come from a window that is kept."""

    def __init__(self, name: str):
        if name.startswith("file:"):
            store, at = pafs.LocalFileSystem(), re.sub("^file:/*", "/", name)
        elif "://" in name:
            store, at = pafs.FileSystem.from_uri(name)
        else:
            store, at = pafs.LocalFileSystem(), name
        self.file = store.open_input_file(at)
        self.size, self.start, self.window = self.file.size(), 0, b""
        self.fetched = 0

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.start <= at <= at + n <= self.start + len(self.window):
            # a head far from the last one is read alone, what follows closely with a window
            near = self.start <= at <= self.start + len(self.window) + WINDOW
            self.start, self.window = at, self.file.read_at(max(n, WINDOW if near and at else min(4096, self.size - at)), at)
            self.fetched += len(self.window)
        return self.window[at - self.start : at - self.start + n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def files(spark: SparkSession, path: str) -> DataFrame:
    """series_id (the name of a file) and length; nothing of a file is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias(ID), "length")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, changed of all files below a folder, for ``catalog.media`` and ``catalog.companions``; nothing of a file is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def walk(data: Held | Stored, start: int = 0, end: int | None = None, parent: str = "") -> Iterator[tuple[str, int, int, int]]:
    """path, offset, size and head length of every box; a box that ends beyond its parent ends with it."""
    at, end = start, data.size if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data.get(at, 8))
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack(">Q", data.get(at + 8, 8)), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        name = f"{parent}/{kind.decode('latin1')}".lstrip("/")
        yield name, at, min(size, end - at), head
        if kind.decode("latin1") in PARENTS:
            yield from walk(data, at + head + (4 if kind == b"meta" else 0), min(at + size, end), name)
        at += size


def find(data: Held | Stored, path: str) -> tuple[int, int]:
    """First byte and end of the payload of the first box at a path such as moov/udta/vrot; an empty range without one."""
    for name, at, size, head in walk(data):
        if name == path:
            return at + head, at + size
    return 0, 0


def orientation_records(payload: bytes) -> np.ndarray:
    """roll, pitch, yaw of records of six big-endian numbers: scale and value of yaw, pitch and roll."""
    n = len(payload) // 24
    raw = np.frombuffer(payload, ">i4", n * 6).reshape(n, 6).astype(np.float64)
    scale, value = raw[:, 0::2], raw[:, 1::2]
    out = np.divide(value, scale, out=np.zeros_like(value), where=scale != 0)
    out = np.where(out > 180.0, out - 360.0, np.where(out < -180.0, out + 360.0, out))
    return out[:, ::-1]


def motion_records(payload: bytes) -> np.ndarray:
    """t_start, t_end, yaw, pitch, roll of records of five doubles."""
    n = len(payload) // 40
    return np.frombuffer(payload, "<f8", n * 5).reshape(n, 5)


def counted(data: Held | Stored) -> tuple[int, int]:
    """First byte and end of the records of a file that begins with their number; nothing where it is cut short."""
    n = int.from_bytes(data.get(0, 8), "little", signed=True) if data.size >= 8 else 0
    return (8, 8 + n * 40) if 0 < n and data.size - 8 >= n * 40 else (0, 0)


def key_length_quaternions(data: Held | Stored) -> Iterator[np.ndarray]:
    """w, x, y, z of the orientation items of a key-length-value stream; payloads are padded to four bytes."""
    at = 0
    while at + 8 <= data.size:
        key, kind, size, count = struct.unpack(">4scBH", data.get(at, 8))
        length = size * count
        if key in (b"CORI", b"IORI") and kind in (b"s", b"S") and size == 2 and count >= 4:
            payload = data.get(at + 8, length)
            yield np.frombuffer(payload, ">i2", len(payload) // 8 * 4).reshape(-1, 4) / 32767.0
        at += 8 + length + -length % 4


def packet_quaternions(data: Held | Stored) -> Iterator[np.ndarray]:
    """w, x, y, z of a camera motion stream: packets of type 4; types 0 and 1 are skipped, all else is searched on."""
    found: list[tuple[float, ...]] = []
    at, n = 0, data.size
    while at + 12 <= n:
        kind = int.from_bytes(data.get(at + 2, 2), "little")
        if kind == 4 and at + 20 <= n:
            x, y, z, w = struct.unpack("<4f", data.get(at + 4, 16))
            found.append((w, x, y, z))
            at += 20
        else:
            at += 16 if kind in (0, 1) and at + 16 <= n else 4
        if len(found) >= ROWS:
            yield np.array(found)
            found = []
    if found:
        yield np.array(found)


def _each(found: DataFrame, make: Callable[[str, Held | Stored], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``make`` gives for every file or content."""
    held = "content" in found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held:
                    yield from make(name, Held(content.as_py() or b""))
                else:
                    with Stored(name) as data:
                        yield from make(name, data)

    return found.select(ID, "content" if held else "length").mapInArrow(run, schema)


def _batch(kind: pa.DataType, name: object, first: int, rows: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([name] * n, kind), pa.array(np.arange(first, first + n)), *[pa.array(np.ascontiguousarray(rows[:, i], np.float64)) for i in range(len(names))]], names=[ID, FRAME, *names])


def _kinds(found: DataFrame, names: tuple[str, ...]) -> tuple[str, pa.DataType, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = found.schema[ID].dataType
    return kind.simpleString(), to_arrow_type(kind), f"{ID} {kind.simpleString()}, {FRAME} bigint, " + ", ".join(f"{c} double" for c in names)


def _streamed(found: DataFrame, decode: Callable[[Held | Stored], Iterator[np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """Rows of items in a row, as they come."""
    _, kind, schema = _kinds(found, names)

    def make(name: str, data: Held | Stored) -> Iterator[pa.RecordBatch]:
        first, held, size = 0, [], 0
        for rows in decode(data):
            held.append(rows)
            size += len(rows)
            if size >= ROWS:
                yield _batch(kind, name, first, np.concatenate(held), names)
                first, held, size = first + size, [], 0
        if size:
            yield _batch(kind, name, first, np.concatenate(held), names)

    return _each(found, make, schema)


def ranges(found: DataFrame, locate: Callable[[Held | Stored], tuple[int, int]], width: int, size: int = RANGE) -> DataFrame:
    """series_id, first (record), at, bytes: the byte ranges of whole records between the ends that ``locate`` finds."""
    step = max(1, size // width) * width
    name_kind, kind, _ = _kinds(found, ())

    def make(name: str, data: Held | Stored) -> Iterator[pa.RecordBatch]:
        start, end = locate(data)
        at = np.arange(start, start + (end - start) // width * width, step)
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.array([name] * n, kind), pa.array((at - start) // width), pa.array(at), pa.array(np.minimum(step, start + (end - start) // width * width - at))], names=[ID, "first", "at", "bytes"])

    return _each(found, make, f"{ID} {name_kind}, first bigint, at bigint, bytes bigint")


def _recorded(found: DataFrame, locate: Callable[[Held | Stored], tuple[int, int]], width: int, decode: Callable[[bytes], np.ndarray], names: tuple[str, ...], size: int = RANGE) -> DataFrame:
    """Rows of records of one width."""
    _, kind, schema = _kinds(found, names)
    if "content" in found.columns:

        def make(name: str, data: Held) -> Iterator[pa.RecordBatch]:
            start, end = locate(data)
            yield _batch(kind, name, 0, decode(data.get(start, (end - start) // width * width)), names)

        return _each(found, make, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Stored(name) as data:
                    yield _batch(kind, name, first, decode(data.get(at, n)), names)

    return ranges(found, locate, width, size).repartition(ID, "first").mapInArrow(run, schema)


def box_orientation(found: DataFrame, path: str = "moov/udta/vrot", skip: int = 4, size: int = RANGE) -> DataFrame:
    """series_id, frame, roll, pitch, yaw of the orientation box of media files; the records begin ``skip`` bytes into it."""

    def locate(data: Held | Stored) -> tuple[int, int]:
        start, end = find(data, path)
        return min(start + skip, end), end

    return _recorded(found, locate, 24, orientation_records, ("roll", "pitch", "yaw"), size)


def stream_orientation(found: DataFrame, kind: str) -> DataFrame:
    """series_id, frame, roll, pitch, yaw of metadata streams: 'klv' or 'packets'."""
    q = _streamed(found, {"klv": key_length_quaternions, "packets": packet_quaternions}[kind], ("w", "x", "y", "z"))
    return q.select(ID, FRAME, *[v.alias(n) for v, n in zip(rotation.euler_zyx(F.struct("w", "x", "y", "z")), ("roll", "pitch", "yaw"), strict=True)])


def binary_motion(found: DataFrame, size: int = RANGE) -> DataFrame:
    """series_id, frame, t_start, t_end, yaw, pitch, roll of counted files of doubles; nothing of one that is cut short."""
    return _recorded(found, counted, 40, motion_records, ("t_start", "t_end", "yaw", "pitch", "roll"), size)


def boxes(found: DataFrame) -> DataFrame:
    """series_id, box, offset, size: the structure of media files, from their heads."""
    name_kind, kind, _ = _kinds(found, ())

    def make(name: str, data: Held | Stored) -> Iterator[pa.RecordBatch]:
        rows = [(box, at, size) for box, at, size, _ in walk(data)]
        boxes_, at, size = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kind), pa.array(boxes_, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=[ID, "box", "offset", "size"])

    return _each(found, make, f"{ID} {name_kind}, box string, offset bigint, size bigint")


__all__ = ["binary_motion", "box_orientation", "boxes", "files", "listing", "ranges", "stream_orientation"]
