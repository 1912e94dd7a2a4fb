"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items form one automaton over word numbers (one per block
of items, so that its size is bounded whatever the benchmark's size).  Every
document is streamed through it; the automaton keeps the length of the longest
item passage that ends at the current word.  A word that no item has sends the
automaton to its root, so only runs of item words are stepped through; runs
shorter than the shortest window cannot match.

Up to ``GROUP`` blocks are broadcast at a time (a proven bound of 16 MB), and a
worker keeps their matchers for all of its tasks.  A benchmark of one group
takes one pass over the documents and no join.  A larger one takes a pass for
each group, over documents that were written once; each pass writes the hits
of the documents that it hit, and the last step gathers these by row.  The
driver holds one group of items at a time.

Defined cases: a null or empty text has no words and no hits; null ids and
repeated rows of documents give rows like any others; an item without words has
no windows; items with equal texts all count; items without an id hit like
others and are one null in a document's items, counted but not joined into
their digest; items that share an id, of whatever lengths, all hit and are one
id; a null item text is ignored; an empty documents table gives an empty
result, an empty benchmark gives zero hits.  Other columns pass through the
pipeline's stage, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch

WINDOW = 10
#: An automaton has at most two states for each item word; a block's items have at most this many bytes, or are one item.
BLOCK_BYTES = 4 << 20
#: Blocks of one pass, and matchers that a worker keeps.
GROUP = 4


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of every window."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, set[str | None]] = {}
        self.short_length: dict[int, int] = {}
        self.shortest = window
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.holds: list[set[str | None] | None] = [None] * len(self.next)
        for name, seq in items:
            if not seq:
                continue
            state, length = 0, 0
            for w in seq:
                state, length = self.next[state][w], length + 1
                if length >= window:
                    s = self._suffix(state, window)
                    if self.holds[s] is None:
                        self.holds[s] = set()
                    self.holds[s].add(name)
            if len(seq) < window:
                self.short.setdefault(state, set()).add(name)
                self.short_length[state] = len(seq)  # only equal items end in one state
                self.shortest = min(self.shortest, len(seq))
        self.ends = self._ends()

    def _suffix(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w)
        return new

    def _ends(self) -> list[tuple[int, ...]]:
        """Short items that end wherever a state does, by state."""
        out: list[tuple[int, ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            out[s] = out[self.link[s]] + ((s,) if s in self.short else ())
        return out

    def scan(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit ranges [from, to) of a word sequence, and the items that hit."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        hits: list[tuple[int, int]] = []
        names: set[str | None] = set()
        for i, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, have = to, have + 1
            if have >= self.window:
                s = self._suffix(state, self.window)
                if self.holds[s]:
                    hits.append((i + 1 - self.window, i + 1))
                    names |= self.holds[s]
            for s in self.ends[state]:
                if (n := self.short_length[s]) <= have:
                    hits.append((i + 1 - n, i + 1))
                    names |= self.short[s]
        return hits, names


class Matcher:
    """Numbers the words of a block of items and finds their passages in chunks of documents."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        w = tx.words(data, off, tx.NOT_ALNUM, lower=True)
        words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        number = {x: i for i, x in enumerate(dict.fromkeys(words))}
        seq = [number[x] for x in words]
        self.words = list(number)
        hashes = tx.word_hashes(w)
        table: dict[int, int] = {int(h): number[x] for h, x in zip(hashes, words, strict=True)}
        self.keys = np.array(sorted(table), np.uint64)
        self.numbers = np.array([table[int(k)] for k in self.keys], np.int64)
        self.automaton = Automaton([(items[i][0], seq[w.first[i] : w.first[i + 1]]) for i in range(len(items))], window)

    def number(self, w: tx.Words) -> np.ndarray:
        """Number of each word, -1 where no item has it."""
        if not len(self.keys) or not len(w.start):
            return np.full(len(w.start), -1)
        h = tx.word_hashes(w)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.numbers[at], -1)

    def chunk(self, w: tx.Words) -> tuple[np.ndarray, list[set[str | None]]]:
        number = self.number(w)
        hit, items = np.zeros(len(number), bool), [set() for _ in range(len(w.first) - 1)]
        known = number >= 0
        edge = np.zeros(len(number) + 1, bool)
        edge[w.first] = True
        begin = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
        stop = known & (edge[1:] | ~np.concatenate([known[1:], [False]]))
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = end - start >= self.automaton.shortest
        for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
            found, names = self.automaton.scan(number[a:b].tolist())
            if found:
                text = w.data
                for x, y in found:
                    if not hit[a + x : a + y].all() and all(text[w.start[i] : w.end[i]].tobytes() == self.words[number[i]] for i in range(a + x, a + y)):
                        hit[a + x : a + y] = True
                items[w.doc[a]] |= names
        return hit, items


Block = list[tuple[str | None, bytes]]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of bounded size, one after another."""
    block, size = [], 0
    for name, t in benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        raw = t.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, raw))
        size += len(raw)
    if block:
        yield block


def item_groups(blocks: Iterator[Block], most: int) -> Iterator[list[Block]]:
    group: list[Block] = []
    for block in blocks:
        if len(group) == most:
            yield group
            group = []
        group.append(block)
    yield group


#: The matchers of the last group that this worker scanned with.
_made: dict[tuple[str, int], Matcher] = {}


class Scanner:
    """Finds the passages of one group of blocks in batches of texts."""

    def __init__(self, spark: SparkSession, group: list[Block], window: int):
        self.name, self.window = uuid.uuid4().hex, window
        self.blocks = [spark.sparkContext.broadcast(b) for b in group]

    def matcher(self, k: int) -> Matcher:
        if (self.name, k) not in _made:
            for key in [x for x in _made if x[0] != self.name]:
                del _made[key]
            _made[self.name, k] = Matcher(self.blocks[k].value, self.window)
        return _made[self.name, k]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tx.Words, np.ndarray, list[list[str | None]]]]:
        """Row range, bytes, offsets, words, hit words, and the items of each row."""
        raw, off = tx.buffers(texts)
        for i, j in tx.chunks(off):
            local = off[i : j + 1] - off[i]
            data = raw[off[i] : off[j]]
            w = tx.words(data, local, tx.NOT_ALNUM, lower=True)
            hit = np.zeros(len(w.start), bool)
            items: list[set[str | None]] = [set() for _ in range(j - i)]
            for k in range(len(self.blocks)):
                h, names = self.matcher(k).chunk(w)
                hit |= h
                for r, found in enumerate(names):
                    items[r] |= found
            yield i, j, data, local, w, hit, [_in_order(x) for x in items]


def _in_order(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda name: (name is None, name or ""))


def _cleaned(texts: pa.Array, data: np.ndarray, off: np.ndarray, w: tx.Words, hit: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts without their hit words, and the numbers of these."""
    n_hit = np.bincount(w.doc, hit, minlength=len(texts)).astype(np.int64)
    if not hit.any():
        return texts, n_hit
    kept = texts.to_pylist()
    for r in np.flatnonzero(n_hit):
        kept[r] = _without(data[off[r] : off[r + 1]], w, int(r), hit, int(off[r]))
    return pa.array(kept, texts.type), n_hit


def scanned(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> tuple[DataFrame, list[str]]:
    """All rows and columns, with clean texts and more columns: numbers of words and of hit words, and items.

    The names of the three are returned too, since they avoid those of ``docs``.
    """
    groups = item_groups(item_blocks(benchmark, item_id, item_text, block_bytes), group)
    schema, names = tx.with_columns(docs, n_words="bigint", n_hit="bigint", items="array<string>")
    place = docs.columns.index(text)
    first, second = next(groups), next(groups, None)
    if second is None:
        scan = Scanner(spark, first, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, off, w, hit, items in scan(batch.column(place)):
                    columns = batch.slice(i, j - i).columns
                    columns[place], n_hit = _cleaned(columns[place], data, off, w, hit)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(w.count), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], names=schema.names)

        return docs.mapInArrow(run, schema), names
    return _in_passes(spark, docs, first, second, groups, schema, names, place, window), names


def _in_passes(spark, docs, first, second, groups, schema, names, place, window) -> DataFrame:
    scratch = Scratch(spark, "decontaminate")
    _, (row, places, found) = tx.with_columns(docs, row="bigint", places="array<int>", found="array<string>")
    base = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    hits = None

    def of_group(scan: Scanner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, _, _, w, hit, items in scan(batch.column(1)):
                    at = np.flatnonzero(np.bincount(w.doc, hit, minlength=j - i) > 0)
                    lists = [np.flatnonzero(hit[w.first[r] : w.first[r + 1]]).astype(np.int32) for r in at]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(at)), pa.array(lists, pa.list_(pa.int32())), pa.array([items[r] for r in at], pa.list_(pa.string()))], names=["row", "places", "found"])

        return run

    for k, group in enumerate(itertools.chain([first, second], groups)):
        found_here = _pass(scratch, spark, base.select(row, schema.names[place]), group, of_group, window, k)
        hits = found_here if hits is None else hits.union(found_here)
    gathered = hits.groupBy("row").agg(F.flatten(F.collect_list("places")).alias(places), F.flatten(F.collect_list("found")).alias(found)).withColumnRenamed("row", row)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            raw, off = tx.buffers(texts)
            for i, j in tx.chunks(off):
                part, local, data = batch.slice(i, j - i), off[i : j + 1] - off[i], raw[off[i] : off[j]]
                w = tx.words(data, local, tx.NOT_ALNUM, lower=True)
                hit = np.zeros(len(w.start), bool)
                items = []
                for r, (at, mine) in enumerate(zip(part.column(len(schema) - 3).to_pylist(), part.column(len(schema) - 2).to_pylist(), strict=True)):
                    hit[w.first[r] + np.array(at or [], np.int64)] = True
                    items.append(_in_order(set(mine or [])))
                columns = part.columns[: len(schema) - 3]
                columns[place], n_hit = _cleaned(columns[place], data, local, w, hit)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w.count), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return base.join(gathered, row, "left").select(*docs.columns, places, found).mapInArrow(last, schema)


def _pass(scratch: Scratch, spark: SparkSession, rows: DataFrame, group: list[Block], of_group, window: int, k: int) -> DataFrame:
    scan = Scanner(spark, group, window)
    hits = scratch.keep(rows.mapInArrow(of_group(scan), "row bigint, places array<int>, found array<string>"), f"hits{k}")
    for b in scan.blocks:
        b.unpersist()
    return hits


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, clean_text, n_words, n_hit, items.

    ``clean_text`` is the text without its hit words (from the first byte of a
    hit run to the last; nothing else changes).
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("clean_text"))
    return scanned(spark, source, benchmark, text="clean_text", item_id=item_id, item_text=item_text, window=window, block_bytes=block_bytes, group=group)[0]


def _without(raw: np.ndarray, w: tx.Words, row: int, hit: np.ndarray, base: int) -> str:
    a, b = w.first[row], w.first[row + 1]
    keep, mask = np.ones(len(raw), bool), hit[a:b]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for x, y in edges.reshape(-1, 2):
        keep[w.start[a + x] - base : w.end[a + y - 1] - base] = False
    return raw[keep].tobytes().decode("utf-8", "replace")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the contract's digest columns, from the operator's real output."""
    found = decontaminate(spark, tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, max_hit: int = 30, max_share: float = 0.5) -> DataFrame:
    """Pipeline stage: hit spans leave the text; documents over the limits of hit words leave the corpus.

    ``max_hit`` words alone never reject a document of which less than
    ``max_share`` is hit: a long document only loses its spans.
    """
    found, (words, hits, _) = scanned(spark, docs, tx.table(spark, sf_dir, "benchmark"))
    n, all_ = F.col(hits), F.col(words)
    gone = (n >= max_hit) & (n > max_share * all_) | (n > 0) & (n == all_)
    return found.where(~gone).select(*docs.columns)
