"""Quality rules, with the frequency of lines across the documents of a host.

Lines are normalised (ASCII letters lower-cased, digits to 0, runs of blanks
to one space, ends trimmed) and hashed.  For every host the distinct documents
of a line are counted; a line in more than ``share`` of the host's distinct
documents, and in at least ``least`` of them, is boilerplate.  Boilerplate is
removed, and a document that keeps less than ``keep`` of its words is depleted
and rejected.  Copies under ids of their own are documents of their own, on
both sides of the share.

Texts are read once: a written table holds every row's counts and the hashes of
its distinct lines, and the rest is joins and sums over these.  A hot line is a
key of partial sums, and of a join on another expression than the sums', so
that both its sides are exchanges and Spark can split it.

Defined cases: a null or empty text has no words and fails the base rules; a
null host is a host of its own; rows of one id are judged each, and count once
as a document; a row of a null id is a document of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch, joined_apart

SHARE, LEAST, KEEP = 0.02, 10, 0.3
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NORMAL = tx.LOWER.copy()
_NORMAL[0x30:0x3A] = 0x30


class Lines:
    """Lines with a word: row, first and last word, raw and normalised hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, w: tx.Words):
        newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
        line = newline[w.start] + w.doc  # a document's end is a line's end too
        self.of_word = np.cumsum(np.diff(line, prepend=-1) != 0) - 1
        first = np.flatnonzero(np.diff(line, prepend=-1) != 0)
        self.first, self.end = first, np.append(first[1:], len(line))
        self.doc, self.at = w.doc[first], w.start[first]
        # the raw line reaches from the newline before its first word to the one after its last
        cuts = np.concatenate([np.flatnonzero(data == 0x0A) + 1, off])
        cuts.sort()
        start = cuts[np.searchsorted(cuts, w.start[first], side="right") - 1]
        stops = np.concatenate([np.flatnonzero(data == 0x0A), off])
        stops.sort()
        stop = stops[np.searchsorted(stops, w.end[self.end - 1], side="left")]
        self.raw = tx.ranges(tx.byte_values(data), start, stop)
        normal = tx.ranges(tx.byte_values(_NORMAL[data]), w.start, w.end)
        self.key = tx.ranges(normal, first, self.end) if len(first) else normal[:0]


def _later_equal(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks values equal to an earlier one of the same row."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return same


def _any_equal(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks values that their row has more than once."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    same = np.zeros(len(h) + 1, bool)
    if len(h) > 1:
        same[1:-1] = (x[1:] == x[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(h), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = tx.buffers(batch.column(column))
    for i, j in tx.chunks(off):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))


def _distinct_lines(lines: Lines, n: int) -> pa.Array:
    """The distinct lines of every row, with their words."""
    order = np.lexsort((lines.key, lines.doc))
    d, k, words = lines.doc[order], lines.key[order], (lines.end - lines.first)[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    head = np.flatnonzero(new)
    count = np.add.reduceat(words, head) if len(head) else words
    values = pa.StructArray.from_arrays([pa.array(tx.signed(k[head])), pa.array(count.astype(np.int32))], fields=list(_LINES.value_type))
    ends = np.concatenate([[0], np.cumsum(np.bincount(d[head], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _measures(data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    n = len(off) - 1
    w = tx.words(data, off, tx.SPACE)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(w.doc, lead[w.end] - lead[w.start], minlength=n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    lines = Lines(data, off, w)
    dup = np.bincount(lines.doc, _later_equal(lines.doc, lines.raw), minlength=n).astype(np.int64)
    at = tx.windows(w, REPEAT_WINDOW)
    win = tx.ranges(tx.word_hashes(w), at, at + REPEAT_WINDOW) if len(at) else np.zeros(0, np.uint64)
    twice = at[_any_equal(w.doc[at], win)] if len(at) else at
    repeat = np.bincount(w.doc, tx.covered(len(w.start), twice, REPEAT_WINDOW), minlength=n).astype(np.int64)
    return [*(pa.array(x) for x in (w.count, chars, symbols[off[1:]] - symbols[off[:-1]], dup, repeat)), _distinct_lines(lines, n)]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in _rows(batch, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *_measures(data, off)], names=["doc_id", "host", *_COUNTS, "lines"])


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of the given hashes; lines without words stay."""
    for batch in batches:
        for i, j, data, off in _rows(batch, 1):
            lines = Lines(data, off, tx.words(data, off, tx.SPACE))
            texts = batch.column(1).slice(i, j - i).to_pylist()
            for r, gone in enumerate(batch.column(2).slice(i, j - i).to_pylist()):
                if not gone:
                    continue
                mine = lines.doc == r
                out = np.isin(tx.signed(lines.key[mine]), np.array(gone, np.int64))
                cut = set(np.searchsorted(np.flatnonzero(data[off[r] : off[r + 1]] == 0x0A), lines.at[mine][out] - off[r]).tolist())
                texts[r] = "\n".join(x for k, x in enumerate(texts[r].split("\n")) if k not in cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string())], names=["row", "clean_text"])


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST, keep: float = KEEP, texts: bool = False) -> DataFrame:
    """Base counts, n_boilerplate_words, base_failed and kept for every row; ``clean_text``, without boilerplate lines, if ``texts``."""
    scratch = Scratch(docs.sparkSession, "quality")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(host).cast("string")).alias("host"), F.col(text).cast("string").alias("text"))
    if texts:
        source = scratch.keep(source.withColumn("row", F.monotonically_increasing_id()), "documents")
    kind = source.schema["doc_id"].dataType.simpleString()
    if texts:
        numbered = source.select(F.struct("row", "doc_id").alias("doc_id"), "host", "text")
        measured = numbered.mapInArrow(_measured, f"doc_id struct<row: bigint, doc_id: {kind}>, host bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, lines array<struct<line: bigint, words: int>>")
        measured = measured.select("doc_id.row", "doc_id.doc_id", "host", *_COUNTS, "lines")
    else:
        measured = source.mapInArrow(_measured, f"doc_id {kind}, host bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, lines array<struct<line: bigint, words: int>>").withColumn("row", F.monotonically_increasing_id())
    measured = scratch.keep(measured, "measured")  # the written table fixes the numbers of the rows

    who = ["doc_id", "alone"]  # a document is an id, or a row without one
    known = measured.withColumn("alone", F.when(F.col("doc_id").isNull(), F.col("row")))
    hosts = known.select("host", *who).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    lines = known.select("row", "host", *who, F.inline("lines"))
    counted = lines.select("host", "line", *who).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = joined_apart(counted, hosts, "host").where(F.col("n") > share * F.col("docs")).select("host", F.bitwise_not("line").alias("enil"))
    found = lines.select("row", "host", "line", "words", F.bitwise_not("line").alias("enil")).join(often, ["host", "enil"], "left_semi")
    gathered = [F.collect_set("line").alias("gone_lines")] if texts else []
    removed = found.groupBy("row").agg(F.sum("words").alias("gone"), *gathered)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_boilerplate_words") < keep * F.col("n_words")
    out = measured.drop("lines", "host").join(removed, "row", "left").withColumn("n_boilerplate_words", F.coalesce("gone", F.lit(0)).cast("bigint"))
    columns = ["doc_id", *_COUNTS, "n_boilerplate_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")]
    if texts:
        clean = source.select("row", "text").join(removed.select("row", "gone_lines"), "row", "left").mapInArrow(_without_lines, "row bigint, clean_text string")
        out, columns = out.join(clean, "row"), [*columns, "clean_text"]
    return out.select(*columns)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7."""
    return quality_rules(tx.table(spark, sf_dir, "documents"))
