"""A stored inverted index for full-text search.

Folders under the index's root, each a table that only grows:

postings   lead, term, docs (id, n, length of each), batch: a row for each term of
           a few megabytes of text, in folders by the term's first two letters,
           sorted by term
documents  id, length, batch: the documents of a batch
dead       id, length, batch: documents of an earlier batch that a later one replaced or removed
batches    batch, place, docs, words: the committed batches, the last thing that a batch writes

A search reads the folders of its words' first letters, and of these the
stretches that its words lie in; the collection's counts are sums over
``batches``.  An upsert appends a batch and marks what it replaces; it rewrites
nothing.  Texts are read once: tasks count the terms of their documents, and
only the lists that they make are shuffled.  A batch is named by its caller: what a failed run has left of it is
never read, and written again by the next try; a batch that is committed is not
taken twice.

Ids are unique within a batch and not null; a null text has no terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import B, K1, terms

_TABLES = {
    "postings": "term string, docs array<struct<id: {id}, n: int, length: int>>, lead string, batch string",
    "documents": "id {id}, length int, batch string",
    "dead": "id {id}, length int, of string, batch string",
    "batches": "place bigint, docs bigint, words bigint, batch string",
}
#: The lead of rows that list documents instead of a term's; no term begins with it.
LISTED = "-"
#: Bytes of text whose terms are listed together.
CHUNK = 8 << 20
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def _lists(ids: pa.Array, raw: np.ndarray, off: np.ndarray, tasks: int) -> pa.RecordBatch:
    """lead, part, term, docs of documents, whose lower-case texts are ``raw`` from ``off[i]`` to ``off[i + 1]``.

    The rows of a lead are dealt to as many parts as its share of all lists asks for in ``tasks``.
    """
    docs = len(off) - 1
    inside, edge = _IS_TERM[raw], np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    begins = np.flatnonzero(begins)
    letters = raw[inside]
    to = np.append(np.cumsum(inside, dtype=np.int64)[begins] - 1, len(letters))
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(to), pa.py_buffer(letters)).dictionary_encode()
    length = np.diff(np.searchsorted(begins, off))
    doc = np.repeat(np.arange(docs), length)
    pairs, n = np.unique(words.indices.to_numpy().astype(np.int64) * docs + doc, return_counts=True)
    term, of = np.divmod(pairs, max(docs, 1))
    first = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    # the last list is that of all documents
    of, n, first = np.append(of, np.arange(docs)), np.append(n, np.zeros(docs, np.int64)), np.append(first, len(of) + docs)
    listed = pa.StructArray.from_arrays([ids.take(pa.array(of)), pa.array(n.astype(np.int32)), pa.array(length[of].astype(np.int32))], names=["id", "n", "length"])
    name = pa.concat_arrays([words.dictionary, pa.array([LISTED], pa.large_string())])
    lead = pc.utf8_slice_codeunits(name, 0, 2)
    at = lead.dictionary_encode().indices.to_numpy()
    parts = np.ceil(np.bincount(at, np.diff(first)) / len(of) * tasks)
    part = np.floor(np.random.default_rng(len(raw)).random(len(at)) * parts[at])
    return pa.RecordBatch.from_arrays([lead.cast(pa.string()), pa.array(part.astype(np.int32)), name.cast(pa.string()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), listed)], names=["lead", "part", "term", "docs"])


def _listing(tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            _, offsets, data = text.buffers()
            off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
                yield _lists(batch.column(0).slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i], tasks)
                i = j

    return run


class Index:
    """The index at a path in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint"):
        self.spark, self.root, self.id_type = spark, root.rstrip("/"), id_type

    def _exists(self, at: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        """Rows of the committed batches."""
        schema = _TABLES[name].format(id=self.id_type)
        if not self._exists(f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        if name == "batches":
            return rows
        # a batch is a folder: the few names prune the read
        names = [r.batch for r in self.table("batches").select("batch").collect()]
        return rows.where(F.col("batch").isin(names))

    def _write(self, df: DataFrame, name: str, batch: str, *by: str) -> None:
        at = f"{self.root}/{name}/batch={batch}"
        df.write.mode("overwrite").partitionBy(*by).parquet(at)

    def upsert(self, docs: DataFrame, batch: str, *, id_: str = "id", text: str = "content") -> bool:
        """Adds documents, which replace those of their ids; False where the batch is already in."""
        return self._apply(docs.select(F.col(id_).cast(self.id_type).alias("id"), F.col(text).alias("text")), batch, keep=True)

    def remove(self, ids: DataFrame, batch: str, *, id_: str = "id") -> bool:
        return self._apply(ids.select(F.col(id_).cast(self.id_type).alias("id"), F.lit(None).cast("string").alias("text")), batch, keep=False)

    def _apply(self, docs: DataFrame, batch: str, keep: bool) -> bool:
        if not re.fullmatch("[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch is named by letters, digits, dash and underscore")
        before = self.table("batches")
        if before.where(F.col("batch") == batch).count():
            return False
        place = before.agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0] + 1
        dead = self.living().join(docs.select("id").distinct(), "id", "left_semi").select("id", "length", F.col("batch").alias("of"))
        self._write(dead, "dead", batch)
        lower = docs.where(F.lit(keep)).select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        lists = lower.mapInArrow(_listing(int(self.spark.conf.get("spark.sql.shuffle.partitions"))), f"lead string, part int, term string, docs array<struct<id: {self.id_type}, n: int, length: int>>")
        self._write(lists.repartition("lead", "part").sortWithinPartitions("lead", "term").drop("part"), "postings", batch, "lead")
        at = f"{self.root}/postings/batch={batch}/lead={LISTED}"
        written = self.spark.read.schema(lists.select("docs").schema).parquet(at) if self._exists(at) else lists.select("docs").limit(0)
        self._write(written.select(F.inline("docs")).select("id", "length"), "documents", batch)
        sums = lambda name: self.spark.read.schema(_TABLES[name].format(id=self.id_type)).parquet(f"{self.root}/{name}/batch={batch}").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        (more, long), (gone, short) = sums("documents"), sums("dead")
        self._write(self.spark.range(1).select(F.lit(place).cast("bigint").alias("place"), F.lit(more - gone).cast("bigint").alias("docs"), F.lit(long - short).cast("bigint").alias("words")).coalesce(1), "batches", batch)
        return True

    def _dead(self) -> DataFrame:
        return self.table("dead").select("id", F.col("of").alias("batch")).distinct()

    def living(self) -> DataFrame:
        """id, length, batch of the documents that a search finds."""
        return self.table("documents").join(self._dead(), ["id", "batch"], "left_anti")

    def bm25(self, query: str, *, limit: int = 5, k1: float = K1, b: float = B) -> DataFrame:
        """id, score of the ``limit`` best documents, as ``search.bm25`` of the same documents gives them."""
        parts = list(dict.fromkeys(p for w in terms(query) for p in re.split("[^a-z0-9]+", w) if p))
        if not parts:
            return self.living().select("id", F.lit(0.0).alias("score")).limit(0)
        hit = F.lit(False)
        for w in parts:
            near = F.col("lead") == w[:2] if len(w) > 1 else F.col("lead").startswith(w)
            hit = hit | (near & F.col("term").startswith(w))
        found = self.table("postings").where(hit).select("term", "batch", F.inline("docs")).join(self._dead(), ["id", "batch"], "left_anti")
        counts = [F.sum(F.when(F.col("term").startswith(w), F.col("n")).otherwise(0)).alias(f"n{i}") for i, w in enumerate(parts)]
        docs = found.groupBy("id", "length").agg(*counts)
        whole = docs.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(parts))])
        sums = self.table("batches").agg(F.sum("docs").alias("docs"), F.try_divide(F.sum("words"), F.sum("docs")).alias("mean"))
        rows = docs.join(F.broadcast(whole)).join(F.broadcast(sums))  # a row each
        score = F.lit(0.0)
        for i in range(len(parts)):
            n, d = F.col(f"n{i}"), F.col(f"d{i}")
            idf = F.log(1.0 + (F.col("docs") - d + 0.5) / (d + 0.5))
            score = score + idf * n * (k1 + 1.0) / (n + k1 * (1.0 - b + b * F.col("length") / F.col("mean")))
        return rows.select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    def history(self) -> DataFrame:
        """place, batch, docs, words: the collection after each batch."""
        w = Window.orderBy("place")  # a row a batch
        return self.table("batches").select("place", "batch", F.sum("docs").over(w).alias("docs"), F.sum("words").over(w).alias("words"))
