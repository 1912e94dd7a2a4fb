"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its words, ASCII lower-cased, joined by one space, and an end mark.
The tree's contexts are the up to ``depth`` bytes before a symbol.  A context
is retained when training has it ``least`` times and when its next-symbol
distribution diverges from that of its longest shorter suffix: the
log-likelihood ratio must exceed ``gain`` nats.  Both are absolute, so the tree
grows with the corpus.  A retained context's distribution is smoothed with its
parent's (Witten-Bell weights), the root's with a uniform one, so every text
has a positive probability.  A symbol is scored in the state of the longest
retained suffix of what precedes it.

Counts are those of all training documents: each task counts its grams of
``depth`` + 1 bytes, Spark sums them, and shorter grams are sums of longer
ones.  The retained contexts are written tables.  Of their symbols, at most
``held`` are also held by every worker as sorted arrays: those of the contexts
seen most, down to a count that the counts' histogram gives.  The contexts
below that count, without bound, never reach the driver: they are joined to the
distinct grams that end in one, which gives each such gram's difference to the
held tree's score, and these to the rows.  Where a context is kept changes no
score.

The unigram base score needs every word's training count.  Words of at least
the share ``frequent`` of all tokens are at most 1 / frequent and are looked up
in a broadcast table; the others are joined, so no key of the join is hot.
Words are compared by 64-bit hashes.

Every row is scored once, into a written table that also fixes its number; sums
of joined parts go by that number.

Defined cases: a null or empty text is the end mark alone; repeated rows are
each learned from and scored; a null doc_id counts as an empty one, so such a
row is learned from and not held out; without training documents the tree is
the uniform root; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch

DEPTH, LEAST, GAIN, FREQUENT = 6, 5, 12.0, 1e-6
#: Most symbols of retained contexts, and most contexts of full depth, that the driver and every worker hold.
HELD_SYMBOLS = 4_000_000
#: Bytes of text whose grams are looked up at a time.
LOOKUP = 1 << 20
END, SPACE = 0x0A, 0x20
FOLDS, HELD = 7, 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def normalised(w: tx.Words, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each after ``pad`` end marks, and the offsets of the rows."""
    n = len(w.first) - 1
    size = w.end - w.start + 1
    docs = np.bincount(w.doc, size, minlength=n).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(np.maximum(docs, 1) + pad)])
    out = np.full(off[-1], END, np.uint8)
    within = np.cumsum(size) - size
    to = within - (np.cumsum(docs) - docs)[w.doc] + off[w.doc] + pad
    step = np.zeros(len(w.data) + 1, np.int64)
    step[w.start] += 1
    step[w.end] -= 1
    source = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    out[source + np.repeat(to - w.start, w.end - w.start)] = w.data[source]
    sep = to + size - 1
    last = np.ones(len(to), bool)
    last[:-1] = w.doc[:-1] != w.doc[1:]
    out[sep] = np.where(last, END, SPACE)
    return out, off


def _chunks(batch: pa.RecordBatch, size: int = tx.CHUNK) -> Iterator[tuple[int, int, tx.Words]]:
    raw, off = tx.buffers(batch.column(1))
    for i, j in tx.chunks(off, size):
        yield i, j, tx.words(raw[off[i] : off[j]], off[i : j + 1] - off[i], tx.SPACE, lower=True)


class _Sums:
    """Adds up counts of keys; yields batches of distinct keys."""

    def __init__(self, limit: int = 3_000_000):
        self.keys, self.counts, self.held, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.held += len(k)

    def merge(self) -> None:
        k = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        n = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.keys, self.counts = [k[head]], [np.add.reduceat(n, head) if len(head) else n]
        self.held = len(head)

    def full(self) -> bool:
        if self.held > self.limit:
            self.merge()
        return self.held > self.limit // 2

    def take(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        k, n = self.keys[0], self.counts[0]
        for a in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(k[a : a + 200_000])), pa.array(n[a : a + 200_000])], names=["key", "n"])
        self.keys, self.counts, self.held = [], [], 0


def _counting(of):
    """Sums of the keys that ``of`` finds in a chunk, over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for _, _, w in _chunks(batch):
                sums.add(of(w))
                if sums.full():
                    yield from sums.take()
        yield from sums.take()

    return run


def _positions(w: tx.Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every symbol of the texts, and its row."""
    data, off = normalised(w, depth)
    n = len(data) - depth
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        gram = (gram << np.uint64(8)) | data[k : k + n]
    target = np.ones(len(data), bool)
    for k in range(depth):
        target[off[:-1] + k] = False
    return gram[target[depth:]], np.repeat(np.arange(len(off) - 1), np.diff(off) - depth)


def _grams(depth: int):
    return lambda w: _positions(w, depth)[0]


def _bytes(gram: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes."""
    return gram if n > 7 else gram & np.uint64((1 << (8 * n)) - 1)


class Tree:
    """Retained contexts by depth: sorted grams with smoothed probabilities, and contexts with the weight of their parent.

    Both are kept with their bytes reversed: in that order all suffixes of
    sorted grams are sorted too, so that lookups of sorted grams walk through a
    level instead of jumping about in it.

    Made of parallel arrays of the contexts' symbols: level, gram (the context
    and the symbol after it) and count.  Level 0 has the counts of the root.
    """

    def __init__(self, depth: int, level: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.depth = depth
        n = np.zeros(256)
        n[gram[level == 0].astype(np.int64)] = count[level == 0]
        self.root = np.log10((n + 0.5) / (n.sum() + 0.5 * 256))
        none = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)
        self.levels = [none] * (depth + 1)
        for k in range(1, depth + 1):
            order = np.argsort(gram[level == k])
            g, n = gram[level == k][order], count[level == k][order].astype(np.float64)
            contexts, first = np.unique(g >> np.uint64(8), return_index=True)
            if not len(g):
                continue
            kinds = np.diff(np.append(first, len(g))).astype(np.float64)
            total = np.add.reduceat(n, first)
            of = np.repeat(np.arange(len(contexts)), kinds.astype(np.int64))
            shorter = 10.0 ** self.grams(_bytes(g, k), k - 1)
            by, by_context = np.argsort(g.byteswap()), np.argsort(contexts.byteswap())
            self.levels[k] = g.byteswap()[by], np.log10((n + kinds[of] * shorter) / (total + kinds)[of])[by], contexts.byteswap()[by_context], np.log10(kinds / (total + kinds))[by_context]

    def holds(self, k: int, context: np.ndarray) -> np.ndarray:
        """Whether contexts of ``k`` bytes are held."""
        return _find(self.levels[k][2], context.byteswap()) >= 0

    def grams(self, gram: np.ndarray, top: int | None = None) -> np.ndarray:
        """log10 probability of the last byte of every gram after the others."""
        out, open_ = np.zeros(len(gram)), np.argsort(gram.byteswap())
        for k in range(self.depth if top is None else top, 0, -1):
            keys, score, contexts, passed = self.levels[k]
            if not len(keys):
                continue
            g = _bytes(gram[open_], k + 1)
            at = _find(keys, g.byteswap())
            hit = at >= 0
            out[open_[hit]] += score[at[hit]]
            open_, g = open_[~hit], g[~hit]
            at = _find(contexts, (g >> np.uint64(8)).byteswap())  # a retained context that never had this symbol
            out[open_[at >= 0]] += passed[at[at >= 0]]
        out[open_] += self.root[(gram[open_] & np.uint64(255)).astype(np.int64)]
        return out


@dataclass
class Learned:
    """The held tree, all contexts of full depth that are seen as often, and a table of the rarer contexts (None without any)."""

    tree: Tree
    often: np.ndarray
    rare: DataFrame | None


def _symbol(code: Column) -> Column:
    return code.bitwiseAND(255)


def _number(code: Column) -> Column:
    return F.shiftright(code, 8)


def _gain(symbols: Column, total: Column, symbols_up: Column, total_up: Column) -> Column:
    """Log-likelihood ratio of a context's symbols against those of its longest shorter suffix, in nats."""
    up = F.map_from_arrays(F.transform(symbols_up, _symbol), F.transform(symbols_up, _number))

    def ratio(numbers: Column) -> Column:
        one = lambda s, x: s + _number(x) * (F.log(_number(x).cast("double")) - F.log(F.element_at(numbers, _symbol(x)).cast("double")))
        return F.aggregate(symbols, total * F.log(total_up / total), one)

    return F.get(F.transform(F.array(up), ratio), F.lit(0))  # the map is made once


def learn(scratch: Scratch, train: DataFrame, *, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, held: int = HELD_SYMBOLS) -> Learned:
    """The tree of (doc_id, text) rows.

    Contexts are rows (context, total, symbols), a symbol being its number of
    times and its byte in one long.  The suffix of a context is joined to it;
    at most 256 contexts share one, so no key is hot.
    """
    rows = train.mapInArrow(_counting(_grams(depth)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    grams = scratch.keep(rows, "grams")
    scratch.release()
    tables: list[DataFrame] = [grams]
    for k in range(depth, 0, -1):
        shorter = tables[-1].groupBy(F.col("key").bitwiseAND((1 << (8 * k)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        tables.append(scratch.keep(shorter, f"grams{k}"))
    code = F.shiftleft("n", 8).bitwiseOR(F.col("key").bitwiseAND(255))
    kept: list[DataFrame] = []
    whole = full = None
    for k, table in zip(range(depth, -1, -1), tables, strict=True):
        # at most 256 symbols a context
        contexts = table.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(code).alias("symbols"))
        up = scratch.keep(contexts.where(F.col("total") >= (least if k else 0)), f"contexts{k}")
        scratch.release()
        scratch.drop(table)
        if full is not None:
            suffixes = up.select(F.col("context").alias("up"), F.col("total").alias("total_up"), F.col("symbols").alias("symbols_up"))
            joined = full.withColumn("up", F.col("context").bitwiseAND((1 << (8 * k)) - 1)).join(suffixes, "up")
            diverges = _gain(F.col("symbols"), F.col("total").cast("double"), F.col("symbols_up"), F.col("total_up").cast("double")) >= gain
            kept.append(scratch.keep(joined.where(diverges).select(F.lit(k + 1).alias("level"), "context", "total", "symbols"), f"retained{k + 1}"))
            if full is not whole:
                scratch.drop(full)
        whole = up if whole is None else whole
        full = up
    retained = reduce(DataFrame.unionByName, kept)
    limit = max(_least_held(retained.select("total", F.size("symbols").alias("n")), held), _least_held(whole.select("total", F.lit(1).alias("n")), held))
    often = np.sort(whole.where(F.col("total") >= limit).select("context").toArrow().column(0).to_numpy().view(np.uint64)) if limit > least else np.zeros(0, np.uint64)
    every = retained.where(F.col("total") >= limit).select("level", "context", "symbols").union(full.select(F.lit(0), "context", "symbols"))
    here = every.select("level", "context", F.explode("symbols").alias("code")).select("level", F.shiftleft("context", 8).bitwiseOR(_symbol(F.col("code"))).alias("gram"), _number(F.col("code")).alias("n")).toArrow()
    tree = Tree(depth, here.column("level").to_numpy(), here.column("gram").to_numpy().view(np.uint64), here.column("n").to_numpy())
    rarer = None
    if limit > least:
        rarer = scratch.keep(retained.where(F.col("total") < limit).select("level", "context", "total", F.map_from_arrays(F.transform("symbols", _symbol), F.transform("symbols", _number)).alias("symbols")), "rare")
    scratch.release()
    scratch.drop(*kept, whole, full)
    return Learned(tree, often, rarer)


def _least_held(rows: DataFrame, most: int) -> int:
    """The smallest power of two such that rows of as large a total have at most ``most`` in ``n``."""
    sizes = rows.groupBy(F.floor(F.log2("total")).cast("int").alias("power")).agg(F.sum("n").alias("n")).collect()  # at most 63 rows
    limit, sum_ = 1, 0
    for power, n in sorted(map(tuple, sizes), reverse=True):
        sum_ += n
        if sum_ > most:
            limit = 1 << (power + 1)
            break
    return limit


def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _scores(tree, often, keys, counts, depth: int):
    """One row a text: its sums over what the worker holds, its other words with their numbers, and its other grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = keys.value, np.log10(counts.value + 1.0)
        for batch in batches:
            for i, j, w in _chunks(batch, LOOKUP):
                n = j - i
                gram, doc = _positions(w, depth)
                code, kinds = pd.factorize(gram)
                score = np.bincount(doc, tree.value.grams(kinds)[code], minlength=n).astype(np.float64)
                h = tx.signed(tx.word_hashes(w))
                at = _find(known, h)
                hit = at >= 0
                base = np.bincount(w.doc[hit], logs[at[hit]], minlength=n).astype(np.float64)  # without words it counts in integers
                seen = np.bincount(w.doc[hit], minlength=n).astype(np.int64)
                far = (_find(often.value, kinds >> np.uint64(8)) < 0)[code] if often is not None else np.zeros(len(gram), bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(w.count + 1), pa.array(seen), pa.array(base), pa.array(score), _rare_words(w.doc[~hit], h[~hit], n), _lists(doc[far], pa.array(tx.signed(gram[far])), n)],
                    names=["doc_id", "n_tokens", "seen", "base", "score", "rare", "far"],
                )

    return run


def _lists(doc: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)), values)


def _rare_words(doc: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    tf = np.diff(np.append(at, len(h))).astype(np.int32)
    return _lists(doc[at], pa.StructArray.from_arrays([pa.array(h[at]), pa.array(tf)], names=["key", "tf"]), n)


def _asked(tree, often, depth: int):
    """The contexts of each gram that the worker doesn't hold, with the held tree's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            gram = gram[_find(often.value, gram >> np.uint64(8)) < 0]
            score = tree.value.grams(gram)
            for k in range(1, depth + 1):
                context = _bytes(gram >> np.uint64(8), k)
                at = ~tree.value.holds(k, context)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(gram[at])), pa.array(np.full(int(at.sum()), k, np.int32)), pa.array(tx.signed(context[at])), pa.array(score[at])], names=["key", "level", "context", "known"])

    return run


def _differences(asked: DataFrame, rare: DataFrame) -> DataFrame:
    """key, more: what the rarer contexts of a gram add to its score, each smoothed with the next shorter one."""
    n = F.coalesce(F.try_element_at("symbols", F.col("key").bitwiseAND(255)), F.lit(0))
    steps = asked.join(rare.hint("merge"), ["level", "context"]).select("key", "known", F.struct("level", n.alias("n"), F.size("symbols").alias("kinds"), "total").alias("step"))
    chains = steps.groupBy("key").agg(F.first("known").alias("known"), F.sort_array(F.collect_list("step")).alias("steps"))  # at most one row a level
    p = F.aggregate("steps", F.pow(F.lit(10.0), F.col("known")), lambda p, s: (s["n"] + s["kinds"] * p) / (s["total"] + s["kinds"]))
    return chains.select("key", (F.log10(p) - F.col("known")).alias("more"))


def lm_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, frequent: float = FREQUENT, held: int = HELD_SYMBOLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    if not 1 <= depth <= 7:
        raise ValueError("a gram of depth + 1 bytes must fit a long")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    train = source.where(~held_out())
    learned = learn(scratch, train, depth=depth, least=least, gain=gain, held=held)

    counted = scratch.keep(train.mapInArrow(_counting(tx.word_hashes), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "words")
    scratch.release()
    ends = train.count()
    distinct, words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, kinds = words + ends, distinct + (ends > 0)
    limit = max(2, int(np.ceil(frequent * tokens)))
    top = counted.where(F.col("n") >= limit).toArrow()  # at most 1 / frequent rows
    key, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(key)
    share = spark.sparkContext.broadcast
    keys, counts, tree = share(key[order]), share(n[order]), share(learned.tree)
    often = None if learned.rare is None else share(learned.often)
    fields = f"doc_id {kind}, n_tokens bigint, seen bigint, base double, score double, rare array<struct<key: bigint, tf: int>>, far array<bigint>"
    scored = scratch.keep(source.mapInArrow(_scores(tree, often, keys, counts, depth), fields).withColumn("row", F.monotonically_increasing_id()), "scored")
    scratch.release()

    rare = scored.select("row", F.inline("rare")).join(counted.where(F.col("n") < limit), "key")
    more = rare.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_base"))
    out, score = scored.drop("rare", "far").join(more, "row", "left"), F.col("score")
    if learned.rare is not None:
        grams = scored.select(F.explode("far").alias("key"))
        asked = grams.distinct().mapInArrow(_asked(tree, often, depth), "key bigint, level int, context bigint, known double")
        differences = scratch.keep(_differences(asked, learned.rare), "differences")
        scratch.release()
        far = scored.select("row", F.explode("far").alias("key")).join(differences.hint("merge"), "key")
        out = out.join(far.groupBy("row").agg(F.sum("more").alias("more_score")), "row", "left")
        score = score + F.coalesce("more_score", F.lit(0.0))
    total = float(np.log10(tokens + kinds + 1))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * total
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("seen") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
    )


def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5."""
    return lm_scores(tx.table(spark, sf_dir, "documents"))
