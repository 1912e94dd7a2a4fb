"""Substring dedup over words, by difference-cover anchors.

A set D of residues modulo p is a difference cover when every difference
modulo p is a difference of two of its members.  For equal windows at word
positions i and j there is then an offset k < p with both i + k and j + k in D
(modulo p), so that the anchors of ``window - p + 1`` words there are equal.
Only anchors at cover positions, 5 of 21, are hashed and shuffled:

1. count every anchor key (partial sums before the shuffle) and keep repeated
   keys; a semi-join, whose large partitions Spark can split, marks anchors;
   the marks are written, and the shuffles behind them are dropped;
2. exact copies are found by digest; a copied text of at least a window's
   words goes as a whole, and only its first copy takes part in what follows;
3. a marked anchor extends to the windows that hold it; only these are hashed
   in full (96 bits) and counted in the same way;
4. words under a window that occurs again are removed.

No step emits pairs, and no step needs all rows of a key in one task.

Defined cases: a null or empty text has no words, and keeps none; a text with
fewer words than the window is kept whole; kept words are joined by one space.
``doc_id`` should be unique: exactly repeated rows count as copies of each
other; different texts of one doc_id pool the list of their repeated windows,
which are the same for all.  Rows with a null doc_id are documents like others:
within the operator each such text has an id of its own, below all ids that are
in use (integers from -2**63, or texts after a zero byte).  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import text as tx
from .packed import packed_documents, unpacked
from .shared import Scratch

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def window_hashes(h: np.ndarray, at: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    return tx.ranges(h, at, at + length, lane)


def with_repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of which another row has the same keys.

    The counts are partial sums.  The join is on another value than the
    counts' grouping, so that both of its sides are exchanges of their own and
    Spark can split the rows of a hot key.  That value is all that is shuffled;
    the keys are made from it again.
    """
    other = [F.bitwise_not(F.col(k)).alias(f"not_{k}") for k in keys]
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*other)
    rest = [c for c in rows.columns if c not in keys]
    found = rows.select(*rest, *other).join(again, [f"not_{k}" for k in keys], "left_semi")
    return found.select(*[F.bitwise_not(F.col(f"not_{c}")).alias(c) if c in keys else F.col(c) for c in rows.columns])


def first_copies(batch: pa.RecordBatch) -> np.ndarray:
    """Rows that are the first of their copies."""
    return pc.fill_null(pc.equal(batch.column(0), batch.column(2)), False).to_numpy(zero_copy_only=False)


def _copies(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column(3), 1).to_numpy(zero_copy_only=False)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of number lists; null reads as empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def marked(keys: np.ndarray, doc: np.ndarray, marks: np.ndarray, moff: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which of the keys, by row, are among the marks of their row."""
    use = np.isin(keys, marks[moff[i] : moff[j]])
    at = np.flatnonzero(use)
    for r in np.unique(doc[at]):
        mine = at[np.searchsorted(doc[at], r) : np.searchsorted(doc[at], r, side="right")]
        use[mine] = np.isin(keys[mine], marks[moff[i + r] : moff[i + r + 1]])
    return use


class _Anchors:
    """Anchor positions and keys of a chunk; keys have 48 bits, since they only choose candidates."""

    def __init__(self, window: int, period: int, cover: tuple[int, ...]):
        self.window, self.length = window, window - period + 1
        self.chosen = np.isin(np.arange(period), cover)

    def __call__(self, w: tx.Words, h: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = tx.windows(w, self.length)
        at = at[self.chosen[(at - w.first[w.doc[at]]) % len(self.chosen)] & ((w.count >= self.window) & use)[w.doc[at]]]
        return at, (window_hashes(h, at, self.length) >> np.uint64(16)).astype(np.int64)


def _anchor_rows(anchors: _Anchors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.buffers(batch.column(1))
            for i, j in tx.chunks(off):
                w = tx.words(raw[off[i] : off[j]], off[i : j + 1] - off[i], tx.SPACE)
                at, key = anchors(w, tx.word_hashes(w), np.ones(j - i, bool))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(w.doc[at])), pa.array(key)], names=["doc_id", "key"])

    return run


def _window_rows(anchors: _Anchors):
    window, period = anchors.window, len(anchors.chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = first_copies(batch)
            marks, moff = lists(batch.column(4))
            for i, j, data, off in unpacked(batch):
                w = tx.words(data, off, tx.SPACE)
                h = tx.word_hashes(w)
                at, key = anchors(w, h, first[i:j] & (np.diff(moff[i : j + 1]) > 0))
                at = at[marked(key, w.doc[at], marks, moff, i, j)]
                near = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(near, np.maximum(at - (period - 1), w.first[w.doc[at]]), 1)
                np.add.at(near, at + 1, -1)
                start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                start = start[start + window <= w.first[w.doc[start] + 1]]
                h1, h2 = window_hashes(h, start, window), window_hashes(tx.word_hashes(w, 1), start, window, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(w.doc[start])), pa.array(tx.signed(h1)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["doc_id", "h1", "h2"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = _copies(batch) > 1
            marks, moff = lists(batch.column(4))
            for i, j, data, off in unpacked(batch):
                w = tx.words(data, off, tx.SPACE)
                gone = copied[i:j][w.doc] & (w.count >= window)[w.doc]
                some = (np.diff(moff[i : j + 1]) > 0) & ~copied[i:j]
                at = tx.windows(w, window)
                at = at[some[w.doc[at]]]
                if len(at):
                    key = tx.signed(window_hashes(tx.word_hashes(w), at, window))
                    at = at[marked(key, w.doc[at], marks, moff, i, j)]
                    gone |= tx.covered(len(w.start), at, window)
                removed = np.bincount(w.doc, gone, minlength=j - i).astype(np.int64)
                joined, ends = _join(w, ~gone)
                view = memoryview(joined)
                kept = [bytes(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                sha = [hashlib.sha256(t).hexdigest() for t in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def _join(w: tx.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document, joined by one space: bytes and offsets."""
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep]
    docs = len(w.first) - 1
    last = np.ones(len(start), bool)
    last[:-1] = doc[:-1] != doc[1:]
    size = end - start + ~last
    to = np.concatenate([[0], np.cumsum(size)])
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, size, minlength=docs).astype(np.int64))])
    out = np.full(to[-1], 0x20, np.uint8)
    step = np.zeros(len(w.data) + 1, np.int64)
    step[start] += 1
    step[end] -= 1
    source = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    shift = np.repeat(to[:-1] - start, end - start)
    out[source + shift] = w.data[source]
    return out, ends


def drop_repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: one row per document."""
    if not is_cover(cover, period) or window < period:
        raise ValueError("cover must hold every difference modulo period, and period be at most the window")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    given = docs.schema[doc_id].dataType
    number = isinstance(given, IntegralType)
    mark = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 32))
    stand_in = F.lit(-(1 << 63)) + mark if number else F.concat(F.lit("\0"), mark.cast("string"))
    kind = "bigint" if number else "string"
    source = docs.select(F.coalesce(F.col(doc_id).cast(kind), stand_in).alias("doc_id"), F.col(text).alias("text"))
    anchors = _Anchors(window, period, cover)
    rows = source.mapInArrow(_anchor_rows(anchors), f"doc_id {kind}, key bigint")
    marks = scratch.keep(with_repeated(rows, "key").groupBy("doc_id").agg(F.collect_list("key").alias("marks")), "marks")
    scratch.release()
    base = packed_documents(source)
    found = base.join(marks, "doc_id", "left").mapInArrow(_window_rows(anchors), f"doc_id {kind}, h1 bigint, h2 int")
    again = with_repeated(found, "h1", "h2").groupBy("doc_id").agg(F.collect_list("h1").alias("marks"))
    out = base.join(again, "doc_id", "left").mapInArrow(_kept(window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
    stands_in = F.col("doc_id") < F.lit(-(1 << 63) + (1 << 32)) if number else F.col("doc_id").startswith("\0")
    return out.withColumn("doc_id", F.when(~stands_in, F.col("doc_id")).cast(given))


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1."""
    return drop_repeated_windows(tx.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
