"""Array kernels shared by the text operators.

Arrow hands every task its texts as one byte buffer and one offset vector.
The kernels below work on such buffers with numpy, so that splitting and
hashing cost a few nanoseconds a byte.  A chunk is a run of whole documents
of about ``CHUNK`` bytes; a longer document is a chunk of its own, so nothing
is ever cut.

Words never contain bytes of the separator class, and every byte from 0x80 up
belongs to a word in all classes used here, so that working on UTF-8 bytes
gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

CHUNK = 1 << 19
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1

#: Separators of words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def with_columns(docs: DataFrame, **kinds: str) -> tuple[StructType, list[str]]:
    """The schema of ``docs`` with more columns, and names for these that clash with none."""
    names = []
    fields = list(docs.schema.fields)
    for name, kind in kinds.items():
        while name in docs.columns:
            name += "_"
        names.append(name)
        fields.append(StructField(name, DataType.fromDDL(kind)))
    return StructType(fields), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, at least one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a chunk: byte ranges in ``data``, row of each, first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.start)) - self.first[self.doc]


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, off, side="left")
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, lane: int, inverse: bool) -> np.ndarray:
    have = _tables.get((lane, inverse))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        base = _MULT[lane] | 1
        base = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * CHUNK:
            _tables[lane, inverse] = have
    return have[:n]


_BYTE = [np.random.default_rng(20 + lane).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for lane in (0, 1)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Position-independent hash of values[start:end] for every range."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(n, lane, False), out=total[1:])
    return mix((total[end] - total[start]) * _powers(n + 1, lane, True)[start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray, lane: int = 0) -> np.ndarray:
    return _BYTE[lane][data]


def word_hashes(w: Words, lane: int = 0) -> np.ndarray:
    return ranges(byte_values(w.data, lane), w.start, w.end, lane)


def windows(w: Words, length: int) -> np.ndarray:
    """First words of the windows of ``length`` words that lie in one document."""
    at = np.arange(max(0, len(w.start) - length + 1))
    return at[w.doc[at] == w.doc[at + length - 1]] if len(at) else at


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Marks the positions below n that lie in a range."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + length, n), -1)
    return np.cumsum(step[:n]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as the type of a Spark long."""
    return h.view(np.int64)
