"""Near-duplicate documents by one-permutation MinHash.

One hash of every shingle gives the whole signature: the hash's high bits pick
a bin, and a bin keeps its smallest hash.  Empty bins are filled by optimal
densification: each borrows from the first non-empty bin on a fixed random
order of its own.  ``rows`` bins make a band; documents with an equal band
share a bucket.

Documents of equal shingle sets are one class and are represented by their
smallest id, so copies cost one row each and no pairs.  Within a bucket the
candidate edges are a star: the member of smallest id is the centre and is
compared with the others, which bounds pairs by bucket rows.  Edges are
confirmed on the full sets.  A star alone would lose a link between members of
which one is not linked to the centre.  So members that are not
linked to their centre are compared, in blocks, with the whole family of the
centre (all that were in a bucket with it): of two members that share a bucket,
either both are linked to its centre, or one is compared with the other.  At a
similarity of 0.8 the default
bands miss a pair with a probability below 1e-8.

Defined cases: a null text, or one without words, has an empty set and is
linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows are linked, as one document; an empty table gives an empty
result.  ``doc_id`` should be unique.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .shared import Scratch, joined_apart

BANDS, ROWS = 64, 6
#: Bytes of shingle sets in a block of queries, and in a block of the family they are compared with.
QUERY_BLOCK, FAMILY_BLOCK = 128 << 10, 256 << 10


class Signer:
    """Band hashes of a sorted set of shingle hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(7)
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.int32)
        self.odd = rng.integers(1, 1 << 63, self.bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, sets: np.ndarray) -> np.ndarray:
        bins = ((sets >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bins.astype(np.int64), prepend=-1))
        full = np.zeros(self.bins, bool)
        out = np.zeros(self.bins, np.uint64)
        at = bins[first].astype(np.int64)
        full[at] = True
        out[at] = sets[first]
        empty = np.flatnonzero(~full)
        for depth in (8, 64, self.bins):
            if not len(empty):
                break
            order = self.order[empty, :depth]
            has = full[order]
            hit = has.argmax(axis=1)
            ok = has[np.arange(len(empty)), hit]
            out[empty[ok]] = out[order[np.arange(len(empty)), hit][ok]]
            empty = empty[~ok]
        return out

    def band_hashes(self, sets: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.signature(sets) * self.odd).reshape(self.bands, self.rows).sum(axis=1, dtype=np.uint64)
            return tx.mix(h + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = tx.words(data, off, tx.SPACE, lower=True)
    h = tx.word_hashes(w)
    n, first = w.count, w.first
    at = tx.windows(w, size)
    full = tx.ranges(h, at, at + size) if len(at) else np.zeros(0, np.uint64)
    begin = np.searchsorted(at, first)
    for r in range(len(off) - 1):
        if n[r] >= size:
            yield np.unique(full[begin[r] : begin[r + 1]])
        elif n[r]:
            yield tx.ranges(h, first[r : r + 1], first[r + 1 : r + 2])
        else:
            yield np.zeros(0, np.uint64)


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            raw, off = tx.buffers(batch.column(1))
            for i, j in tx.chunks(off):
                n, d1, d2, out = [], [], [], []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], size):
                        n.append(len(s))
                        d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                        d2.append(int(tx.mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)))
                        out.append(signer.band_hashes(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), flat], names=["doc_id", "n_shingles", "d1", "d2", "buckets"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.buffers(batch.column(1))
            for i, j in tx.chunks(off, 1 << 19):
                sets = [s.tobytes() for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _family_links(percent: int):
    """Links of a block of queries (side true) with a block of their family, on full sets.

    Of the links within a block, those that join two of its parts are returned.
    """

    def run(block: pa.Table) -> pa.Table:
        side, doc = block["side"].to_numpy(), block["doc"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["set"]]
        size = np.array([len(x) for x in sets])
        query, other = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = [], []
        root = {d: d for d in doc.tolist()}

        def find(d: int) -> int:
            while root[d] != d:
                root[d] = d = root[root[d]]
            return d

        if len(query) and len(other):
            flat, code = np.unique(np.concatenate([sets[i] for i in other]), return_inverse=True)
            begin = np.concatenate([[0], np.cumsum(size[other])])[:-1]
            for q in query:
                has = np.isin(flat, sets[q], assume_unique=True)
                both = np.add.reduceat(has[code], begin, dtype=np.int64)
                ok = 100 * both >= percent * (size[other] + size[q] - both)
                for d in doc[other[ok]].tolist():
                    x, y = find(int(doc[q])), find(d)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(int(doc[q]))
                        b.append(d)
        return pa.table({"a": pa.array(a, block.schema.field("doc").type), "b": pa.array(b, block.schema.field("doc").type)})

    return run


def _unlinked_against_families(stars: DataFrame, tested: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links of the members that are not linked to a centre with all of its family.

    A pair that shares a bucket is in the family of that bucket's centre.  If
    both are linked to the centre, they are in one component; else one of them
    is a query of this family.  Queries and family are dealt in blocks of
    bounded size, each pair of blocks being one group.
    """
    linked = tested.select(F.col("a").alias("centre"), F.col("b").alias("doc"), F.lit(False).alias("side"))
    members = stars.join(linked, ["centre", "doc"], "left").select("centre", "doc", F.coalesce("side", F.lit(True)).alias("side"))
    family = members.union(stars.select("centre", F.col("centre").alias("doc"), F.lit(False)).distinct())
    sized = family.join(sets.select(F.col("doc_id").alias("doc"), F.length("set").alias("size")), "doc")
    blocks = sized.groupBy("centre").agg(
        F.ceil(F.sum(F.when(F.col("side"), F.col("size")).otherwise(0)) / QUERY_BLOCK).cast("int").alias("queries"),
        F.ceil(F.sum("size") / FAMILY_BLOCK).cast("int").alias("others"),
    )
    dealt = joined_apart(family, blocks.where("queries > 0"), "centre")
    spot = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt.where("side").select("centre", "doc", "side", spot("queries").alias("qb"), every("others").alias("fb"))
    all_ = dealt.select("centre", "doc", F.lit(False).alias("side"), spot("others").alias("fb"), every("queries").alias("qb"))
    rows = asked.unionByName(all_).join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("centre", "qb", "fb", "doc", "side", "set")
    return rows.groupBy("centre", "qb", "fb").applyInArrow(_family_links(percent), f"a {kind}, b {kind}")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = scratch.keep(source.mapInArrow(_signatures(size, bands, rows), f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, buckets array<bigint>"), "signatures")

    keys = ["n_shingles", "d1", "d2"]
    classes = signed.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("doc"))
    chosen = joined_apart(signed.where("n_shingles > 0"), classes.withColumnRenamed("doc", "doc_id"), ["doc_id", *keys], "left_semi")
    spread = chosen.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("bucket")
    members = scratch.keep(joined_apart(spread, shared, "bucket", "left_semi").distinct(), "members")
    scratch.release()
    wanted = members.select("doc").distinct()
    sets = scratch.keep(source.join(wanted, F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(size), f"doc_id {kind}, set binary"), "sets")

    centres = members.groupBy("bucket").agg(F.min("doc").alias("centre"))
    stars = scratch.keep(joined_apart(members, centres, "bucket").where("doc <> centre").select("centre", "doc").distinct(), "stars")
    labels = None
    if not stars.isEmpty():
        left = stars.join(sets.select(F.col("doc_id").alias("doc"), F.col("set").alias("set_b")), "doc")
        full = left.join(sets.select(F.col("doc_id").alias("centre"), F.col("set").alias("set_a")), "centre")
        size_ok = F.least(F.length("set_a"), F.length("set_b")) * 100 >= F.greatest(F.length("set_a"), F.length("set_b")) * percent
        tested = scratch.keep(full.where(size_ok).select("centre", "doc", "set_a", "set_b").mapInArrow(_confirm(percent), f"a {kind}, b {kind}"), "links")
        more = scratch.keep(_unlinked_against_families(stars, tested, sets, percent, kind), "more")
        scratch.release()
        labels = scratch.keep(components(scratch, tested.union(more)), "labels")
        scratch.drop(tested, more)
    scratch.drop(sets, stars, members)

    out = joined_apart(signed.select("doc_id", "n_shingles", "d1", "d2"), classes, keys, "left")
    if labels is not None:
        out = out.join(labels, F.col("doc") == F.col("node"), "left").withColumn("doc", F.coalesce("root", "doc"))
    component = F.coalesce("doc", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4."""
    return near_duplicates(spark, tx.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document of smallest id stays.

    Shingles have five words here; the similarity is that of the query.  Rows
    of a null id, and rows that repeat a kept id, stay.
    """
    found = near_duplicates(spark, docs, size=5)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
