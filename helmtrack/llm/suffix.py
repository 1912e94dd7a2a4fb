"""Byte-level dedup by suffix sorting, deep-shallow, of the strings that can repeat.

Every string of ``length`` bytes has a minimizer: the smallest hash among its
k-byte parts.  Equal strings have equal minimizers, so strings are grouped by
it, in segments: runs of neighbouring strings with one minimizer.

1. a minimizer that only one document has settles its strings; the others are
   marked (partial counts, a join that Spark can split, a written table);
2. an exact copy of an earlier document goes as a whole; among first copies,
   equal segments form a class with a smallest doc_id, and a segment of another
   document is removed as a whole;
3. minimizers with several classes are contested: strings of different classes
   may be equal.  One segment of each class is sent to the suffix sort: the
   suffixes at all its string starts are ordered by multikey quicksort on
   words of eight bytes to a shallow depth, and groups with a longer common
   prefix by a blind trie.  Suffixes that agree to ``length`` bytes are
   neighbours; their smallest doc_id decides.

Segments are sorted by tasks that hold a hash range of minimizers, in blocks of
bounded size: a minimizer with more than ``hot`` classes is not sorted in one
task.  Its strings are dealt by their own 128-bit hashes instead, with a
partial minimum and a join that Spark can split.

Defined cases: a null or empty text has no bytes; texts shorter than
``length`` are kept; matches never cross documents; rows of one doc_id never
remove each other; kept bytes need not be valid UTF-8, so they are binary.  A
row with a null doc_id is kept whole and removes nothing.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .packed import packed_documents, unpacked
from .shared import Scratch, joined_apart
from .substring import first_copies, lists, with_repeated

LENGTH, GRAM = 50, 16
#: A run of strings with one minimizer is cut after so many, as in long runs of one character.
MOST = 64
#: A minimizer with more classes has its strings dealt one by one: some megabytes of segments are the most that a task sorts at once.
HOT = 1 << 15
#: Words of eight bytes that are sorted on before the tries.
SHALLOW = 4


@dataclass
class Segments:
    """First string start, number of strings, row, minimizer and text hash of each segment."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    text: np.ndarray | None


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place, made of its eight-byte words."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        words[k::8] = np.frombuffer(data, "<u8", (n - k + 7) // 8, k)
    out = words[: len(data) - gram + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in (*range(8, gram - 8, 8), gram - 8):
        out ^= out >> np.uint64(32)
        out += words[k : k + len(out)]
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    return out


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int, use: np.ndarray | None = None) -> Segments:
    n, rows = len(data), np.diff(off)
    none = np.zeros(0, np.int64)
    ok = rows >= length if use is None else (rows >= length) & use
    if n < length or not ok.any():
        return Segments(none, none, none, none, none)
    low = gram_hashes(np.ascontiguousarray(data), gram)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    m = len(low)  # a string starts at each place, but for the last ones of a row
    new = np.ones(m, bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    step = np.zeros(m + 1, np.int8)
    new[off[:-1][ok]] = True
    step[off[:-1][ok]] = 1
    step[off[1:][ok] - length + 1] = -1
    new &= np.cumsum(step[:m], dtype=np.int8).view(bool)
    first = np.flatnonzero(new)
    doc = np.searchsorted(off, first, side="right") - 1
    count = np.minimum(np.append(first[1:], m), off[doc + 1] - length + 1) - first
    if count.max() > MOST:
        parts = -(-count // MOST)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, doc, count = np.repeat(first, parts) + MOST * place, np.repeat(doc, parts), np.repeat(count, parts) - MOST * place
        count = np.minimum(count, MOST)
    return Segments(first, count, doc, (low[first] >> np.uint64(16)).astype(np.int64), None)


def _hashed(s: Segments, data: np.ndarray, length: int, pick: np.ndarray) -> Segments:
    out = Segments(s.start[pick], s.count[pick], s.doc[pick], s.key[pick], None)
    out.text = tx.signed(tx.ranges(tx.byte_values(data, 1), out.start, out.start + out.count + length - 1, 1)) if len(pick) else out.key
    return out


def among(values: np.ndarray, doc: np.ndarray, marks: np.ndarray, moff: np.ndarray, i: int, j: int) -> np.ndarray:
    """Places of the values that are among the marks of their row."""
    mine = marks[moff[i] : moff[j]]
    if not len(mine) or not len(values):
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(j - i), np.diff(moff[i : j + 1]))
    both, code = np.unique(np.concatenate([mine, values]), return_inverse=True)
    pair = np.unique(owner * len(both) + code[: len(mine)])
    return np.flatnonzero(np.isin(doc * len(both) + code[len(mine) :], pair))


def _keys(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.buffers(batch.column(1))
            for i, j in tx.chunks(off):
                s = segments(raw[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)
                order = np.lexsort((s.key, s.doc))
                d, k = s.doc[order], s.key[order]
                head = np.ones(len(d), bool)
                head[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(d[head])), pa.array(k[head])], names=["doc_id", "key"])

    return run


def _marked(batch: pa.RecordBatch, length: int, gram: int, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Segments]]:
    """Marked segments of first copies, by chunk."""
    first = first_copies(batch)
    marks, moff = lists(batch.column(column))
    for i, j, data, off in unpacked(batch):
        use = first[i:j] & (np.diff(moff[i : j + 1]) > 0)
        s = segments(data, off, length, gram, use)
        yield i, j, data, off, _hashed(s, data, length, among(s.key, s.doc, marks, moff, i, j))


def _segment_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, s in _marked(batch, length, gram, 4):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(s.doc)), pa.array(s.key), pa.array(s.text)], names=["doc_id", "key", "segment"])

    return run


def _contested_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, woff = lists(batch.column(5))
            for i, j, data, _, s in _marked(batch, length, gram, 4):
                at = among(s.text, s.doc, wanted, woff, i, j)
                pair = np.unique(np.stack([s.doc[at], s.text[at]]), axis=1, return_index=True)[1] if len(at) else at
                at = at[pair]
                size = s.count[at] + length - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = data[np.arange(ends[-1]) + np.repeat(s.start[at] - ends[:-1], size)]
                texts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(s.doc[at])), pa.array(s.key[at]), pa.array(s.text[at]), texts], names=["doc_id", "key", "segment", "bytes"])

    return run


class BlindTrie:
    """Patricia tree of equally long strings: inner nodes know only the place of the byte they branch on."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, None

    def insert(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = (text, [item])
            return
        node = self.root
        while len(node) == 3:  # (place, children by byte, None): blind descent
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(item)
            return
        place = next(p for p in range(self.depth, len(text)) if node[0][p] != text[p])
        other, parent, at = node[0][place], None, self.root
        while len(at) == 3 and at[0] < place:
            parent, at = at, at[1][text[at[0]]]
        if len(at) == 3 and at[0] == place:
            at[1][text[place]] = (text, [item])
            return
        split = (place, {other: at, text[place]: (text, [item])}, None)
        if parent is None:
            self.root = split
        else:
            parent[1][text[parent[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """Items of equal strings, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                yield node[1]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def multikey(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their first ``depth`` words, and where a new prefix begins.

    Ternary partition about a median word; the equal part goes on with the next
    word.  Small parts are finished by a stable sort.
    """
    order = np.arange(len(words))
    new = np.zeros(len(words) + 1, bool)
    new[[0, -1]] = True
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, d = stack.pop()
        new[lo] = True
        if d == depth or hi - lo < 2:
            continue
        part = order[lo:hi]
        if hi - lo <= 4096:
            part = part[np.lexsort(tuple(words[part, k] for k in range(depth - 1, d - 1, -1)))]
            order[lo:hi] = part
            w = words[part, d:depth]
            new[lo + 1 : hi] |= np.any(w[1:] != w[:-1], axis=1)
            continue
        w = words[part, d]
        pivot = np.partition(w[:: max(1, len(w) // 1024)], min(512, (len(w) - 1) // 2))[min(512, (len(w) - 1) // 2)] if len(w) >= 1024 else w[len(w) // 2]
        less, more = w < pivot, w > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(x, y, z) for x, y, z in ((lo, a, d), (a, b, d + 1), (b, hi, d)) if x < y]
    return order, np.flatnonzero(new)


def equal_strings(texts: list[bytes], length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sorts the strings of ``length`` bytes at all starts of the texts; see ``equal_suffixes``."""
    return equal_suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), length, shallow)


def equal_suffixes(data: np.ndarray, off: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sorts the strings of ``length`` bytes at all starts of the texts that lie one after another in ``data``.

    Returns the text and the start of each suffix, the suffixes that agree to
    ``length`` bytes group after group, and where each group begins.  A group
    whose strings are all equal to its end is a trie of one leaf and is not
    built.
    """
    shallow = min(shallow, length // 8)
    count = np.diff(off) - length + 1
    of = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    place = off[:-1][of] + inside
    every = np.empty(len(data) - 7, np.uint64)  # the word at each place, bytes in order of significance
    for k in range(min(8, len(every))):
        every[k::8] = np.frombuffer(data, ">u8", (len(every) - k + 7) // 8, k)
    words = np.stack([every[place + 8 * k] for k in range(shallow)], axis=1) if shallow else np.empty((len(place), 0), np.uint64)
    order, cuts = multikey(words, shallow)
    size = np.diff(cuts)
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    begin = np.cumsum(size) - size
    same = np.ones(len(order), bool)
    for k in (*range(8 * shallow, length - 7, 8), *([length - 8] if length >= 8 else range(length))):
        deep = every[place[order] + k] if length >= 8 else data[place[order] + k]
        same[1:] &= deep[1:] == deep[:-1]
    same[begin] = True
    whole = np.logical_and.reduceat(same, begin) if len(begin) else np.zeros(0, bool)
    flat: list[int] = []
    sizes: list[int] = []
    raw = data.tobytes() if not whole.all() else b""
    deep_groups = np.flatnonzero(~whole & (size > 2))  # two strings that differ have nothing equal
    for i, n in zip(begin[deep_groups].tolist(), size[deep_groups].tolist(), strict=True):
        trie = BlindTrie(8 * shallow)
        group = order[i : i + n]
        for s, at in zip(group.tolist(), place[group].tolist(), strict=True):
            trie.insert(raw[at : at + length], s)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                flat.extend(leaf)
                sizes.append(len(leaf))
    members = np.concatenate([order[np.repeat(whole, size)], np.array(flat, np.int64)])
    each = np.concatenate([size[whole], np.array(sizes, np.int64)])
    return of, inside, members, np.cumsum(each) - each


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimizer in blocks of about ``most_bytes`` of text; a block ends where the minimizer changes."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def block() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(1).to_numpy()
        if size > most_bytes and key[0] != last:
            yield block()
            held, size = [], 0
        total = np.cumsum(np.diff(tx.buffers(batch.column(3))[1]))
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        i = 0
        while True:
            before = int(total[i - 1]) if i else 0
            full = int(np.searchsorted(total, before + most_bytes - size, side="right"))
            k = int(np.searchsorted(change, full, side="right"))
            if full >= len(batch) or k == len(change):
                break
            j = int(change[k])
            held.append(batch.slice(i, j - i))
            yield block()
            held, size, i = [], 0, j
        held.append(batch.slice(i))
        size += int(total[-1]) - (int(total[i - 1]) if i else 0)
        last = key[-1]
    if held:
        yield block()


def _sorted_rows(length: int, most_bytes: int = 1 << 20):
    """Strings of a segment's document that also start in a smaller document, as ranges of starts."""

    def settle(block: pa.RecordBatch) -> pa.RecordBatch:
        doc, segment = (block.column(i).to_numpy() for i in (0, 2))
        of, inside, members, heads = equal_suffixes(*tx.buffers(block.column(3)), length)
        docs = doc[of[members]]
        least = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(docs)))) if len(heads) else docs
        hit = np.unique(members[docs > least])  # suffixes are numbered by text and start
        row, start = of[hit], inside[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(hit)) - 1 if len(head) else head
        out = (doc[row[head]], segment[row[head]], start[head], start[last] + 1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "segment", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(settle, _blocks(batches, most_bytes))

    return run


def _string_rows(length: int):
    """Every string of the segments by its hashes, with its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.buffers(batch.column(3))
            for i, j in tx.chunks(off):
                data, size = raw[off[i] : off[j]], np.diff(off[i : j + 1])
                count = size - length + 1
                row = np.repeat(np.arange(j - i), count)
                lo = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = (off[i:j] - off[i])[row] + lo
                hashes = [pa.array(tx.signed(tx.ranges(tx.byte_values(data, lane), at, at + length, lane))) for lane in (0, 1)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(lo), *hashes], names=["doc_id", "segment", "lo", "h0", "h1"])

    return run


def _result(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = ~first_copies(batch) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            whole, hoff = lists(batch.column(5))
            some, soff = lists(batch.column(6))
            for i, j, data, off, s in _marked(batch, length, gram, 4):
                size = np.diff(off)
                gone = np.zeros(len(data) + 1, np.int64)
                full = among(s.text, s.doc, whole, hoff, i, j)
                lo, hi = [s.start[full]], [s.start[full] + s.count[full]]
                for r in np.flatnonzero(np.diff(soff[i : j + 1])):
                    mine = np.flatnonzero(s.doc == r)
                    for x in batch.column(6)[i + int(r)].as_py():
                        hits = mine[s.text[mine] == x["segment"]]
                        lo.append(s.start[hits] + x["lo"])
                        hi.append(s.start[hits] + x["hi"])
                np.add.at(gone, np.concatenate(lo), 1)
                np.add.at(gone, np.concatenate(hi) + length - 1, -1)
                out = copied[i:j] & (size >= length)
                np.add.at(gone, off[:-1][out], 1)
                np.add.at(gone, off[1:][out], -1)
                mask = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(mask)])
                begin = mask.copy()
                begin[1:] &= ~mask[:-1]
                inner = off[(off > 0) & (off < len(data))]
                begin[inner] |= mask[inner]
                spans = np.concatenate([[0], np.cumsum(begin)])
                kept = [data[a:b][~mask[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size), pa.array(total[off[1:]] - total[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]]), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return run


def drop_repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256: one row per document."""
    scratch = Scratch(docs.sparkSession, "suffix")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = source.mapInArrow(_keys(length, gram), "doc_id bigint, key bigint")
    marks = scratch.keep(with_repeated(rows, "key").groupBy("doc_id").agg(F.collect_list("key").alias("marks")), "marks")
    scratch.release()
    base = scratch.keep(packed_documents(source).join(marks, "doc_id", "left"), "base")
    scratch.release()
    scratch.drop(marks)
    found = base.mapInArrow(_segment_rows(length, gram), "doc_id bigint, key bigint, segment bigint")
    classes = scratch.keep(found.groupBy("key", "segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "classes")
    scratch.release()
    names = {k: F.bitwise_not(F.col(k)).alias(f"not_{k}") for k in ("key", "segment")}
    earlier = classes.where("least < most").select("least", *names.values())
    whole = found.select("doc_id", "segment", *names.values()).join(earlier, ["not_key", "not_segment"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("segment").alias("whole"))
    whole = scratch.keep(whole, "whole")
    scratch.release()

    many = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def contested(kept: Column, how: str) -> DataFrame:
        keys = many.where((F.col("n") > 1) & kept).select(F.bitwise_not("key").alias("not_key"))
        asked = classes.select("segment", "least", names["key"]).join(keys, "not_key", "left_semi").groupBy(F.col("least").alias("doc_id")).agg(F.collect_list("segment").alias("asked"))
        return base.join(asked, "doc_id", how).mapInArrow(_contested_rows(length, gram), "doc_id bigint, key bigint, segment bigint, bytes binary")

    texts = contested(F.col("n") <= hot, "left")
    # each step is written before the next one, so that one step's shuffles are on disk at a time
    part = scratch.keep(texts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_rows(length), "doc_id bigint, segment bigint, lo bigint, hi bigint"), "sorted")
    scratch.release()
    if not many.where(F.col("n") > hot).isEmpty():
        strings = scratch.keep(contested(F.col("n") > hot, "inner").mapInArrow(_string_rows(length), "doc_id bigint, segment bigint, lo bigint, h0 bigint, h1 bigint"), "strings")
        scratch.release()
        least = strings.groupBy("h0", "h1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        dealt = scratch.keep(joined_apart(strings, least, ["h0", "h1"]).where("doc_id > least").select("doc_id", "segment", "lo", (F.col("lo") + 1).alias("hi")), "dealt")
        scratch.release()
        scratch.drop(strings)
        part = part.union(dealt)
    ranges = scratch.keep(part.groupBy("doc_id").agg(F.collect_list(F.struct("segment", "lo", "hi")).alias("ranges")), "ranges")
    scratch.release()
    scratch.drop(classes)
    full = base.join(whole, "doc_id", "left").join(ranges, "doc_id", "left").select("doc_id", "packed", "first", "copies", "marks", "whole", "ranges")
    return full.mapInArrow(_result(length, gram), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6."""
    return drop_repeated_bytes(tx.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
