"""Audit of how far sources of a language differ, by SQL over shards.

Every source of a language gives each kept term of the language a smoothed
share of its words; two sources, or a source and its language, differ by a sum
or by single terms of a squared difference over a sum.  All arithmetic is on
integers.

1. tasks that read the documents count terms by language and source, some
   megabytes of text at a time, in DuckDB;
2. these partial counts are dealt by the hash of language and term.  A shard
   folds them in DuckDB as they come, so that it holds one row for each term and
   source of its own, and keeps the terms of enough documents.  One row a kept
   term, with its sources, is written;
3. Spark adds up words by source and by language;
4. a second dealing, by language and a bucket of the term's hash, lays the
   sources of the language beside each shard of kept terms.  A shard's partial
   sums are SQL again.  Most terms are absent from most sources, so a pair's sum
   is what it would be if all terms were absent from both (one product, made at
   the end), and corrections: of a source's present terms as if the other had
   none, grouped by count, and of terms that both have;
5. Spark adds up the partial sums and ranks.

The number of shards follows the number of kept terms.  Rows for pairs of
sources are the result itself; no step makes pairs of documents or of terms.

Defined cases: null text, language and source are empty; a group without kept
terms still has its pairs; a language without kept terms has pairs of value 0;
rows are documents, whatever their ids; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch

#: Fewest documents of a kept term, ranks of terms, added count, parts of the whole share.
DOCS, TOP, ADD, PARTS = 10, 10, 2, 1_000_000_000
#: Kept terms of a shard of pair sums.
SHARD = 2048
#: Bytes of text that are counted at a time, and rows of partial counts that a shard holds before it folds them.
CHUNK, FOLD = 1 << 22, 1 << 18

NOT_TERM = np.zeros(256, bool)
NOT_TERM[0x00:0x41] = NOT_TERM[0x5B:0x61] = NOT_TERM[0x7B:0x80] = True


def _database() -> duckdb.DuckDBPyConnection:
    """A database in memory, for one task's thread, that never writes to the machine's disk."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})
    con.execute("CREATE MACRO gap(p, q) AS ((p - q) * (p - q)) // (p + q)")
    con.execute(f"CREATE MACRO share(n, whole, v) AS (1 + ({PARTS}::HUGEINT * (n + {ADD})) // (whole + {ADD} * v))::BIGINT")
    return con


def terms(data: np.ndarray, off: np.ndarray) -> tuple[tx.Words, pa.Array]:
    """Places of the terms, and the terms: all bytes outside separators, end to end."""
    w = tx.words(data, off, NOT_TERM, lower=True)
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
    raw = w.data[~NOT_TERM[w.data]]
    return w, pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))


_COUNTS = """
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs
FROM (SELECT row, term, count(*) AS n FROM said GROUP BY row, term) JOIN held USING (row) GROUP BY lang, source, term"""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _database()
    for batch in batches:
        raw, off = tx.buffers(batch.column(2))
        for i, j in tx.chunks(off, CHUNK):
            w, names = terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            con.register("said", pa.table({"row": w.doc.astype(np.int32), "term": names}))
            con.register("held", pa.table({"row": np.arange(j - i, dtype=np.int32), "lang": batch.column(0).slice(i, j - i), "source": batch.column(1).slice(i, j - i)}))
            yield from con.sql(_COUNTS).to_arrow_table().to_batches()
            con.unregister("said")
            con.unregister("held")


def _kept(docs: int):
    """Terms of a shard that enough documents have, each with its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        con.execute("CREATE TABLE seen (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        fold = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM seen GROUP BY lang, source, term"
        held, most = 0, FOLD
        for batch in batches:
            con.register("more", pa.table(batch))
            con.execute("INSERT INTO seen SELECT lang, source, term, n, docs FROM more")
            con.unregister("more")
            held += len(batch)
            if held > most:
                con.execute(f"CREATE TABLE less AS {fold}")
                con.execute("DROP TABLE seen")
                con.execute("ALTER TABLE less RENAME TO seen")
                held = con.execute("SELECT count(*) FROM seen").fetchall()[0][0]
                most = max(FOLD, 2 * held)
        whole = f"SELECT lang, term, sum(n)::BIGINT AS total, list(source) AS sources, list(n) AS counts FROM ({fold}) GROUP BY lang, term HAVING sum(docs) >= {docs}"
        yield from con.sql(whole).to_arrow_table().to_batches(4096)

    return run


#: ``kept``: lang, term, total, sources, counts.  ``sides``: lang, source, whole (words of the source), spoken (of the language), v (kept terms).
_PARTS = """
WITH s AS (SELECT source, whole, spoken, v, share(0, whole, v) AS z FROM sides),
c AS (SELECT term, total, unnest(sources) AS source, unnest(counts) AS n FROM kept),
o AS (SELECT term, source, total, spoken, v, z, share(n, whole, v) AS p FROM c JOIN s USING (source)),
alone AS (SELECT h.source AS a, s.source AS b, h.m * (gap(h.p, s.z) - gap(h.z, s.z)) AS d FROM (SELECT source, p, z, count(*) AS m FROM o GROUP BY source, p, z) h JOIN s ON h.source <> s.source),
shared AS (SELECT x.source AS a, y.source AS b, gap(x.p, y.p) - gap(x.p, y.z) - gap(x.z, y.p) + gap(x.z, y.z) AS d FROM o x JOIN o y ON x.term = y.term AND x.source < y.source),
sums AS (SELECT a, b, sum(d)::BIGINT AS value FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, d FROM alone UNION ALL SELECT a, b, d FROM shared) GROUP BY a, b),
led AS (SELECT source, term, gap(p, q) AS value FROM (SELECT source, term, p, share(total, spoken, v) AS q FROM o) WHERE p > q)
SELECT 'pair' AS part, a AS source, b AS item, value FROM sums
UNION ALL SELECT 'term', source, term, value FROM led QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, term) <= {top}"""


def _partial(top: int):
    sql = _PARTS.format(top=top)

    def run(key: tuple, kept: pa.Table, sides: pa.Table) -> pa.Table:
        con = _database()
        con.register("kept", kept)
        con.register("sides", sides)
        out = con.sql(sql).to_arrow_table()
        con.close()
        lang = pa.array([key[0].as_py()] * len(out), pa.string())
        return pa.table({"lang": lang, **{c: out[c].cast(pa.int64() if c == "value" else pa.string()) for c in ("part", "source", "item", "value")}})

    return run


def source_divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = DOCS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence, and terms that a source has more of than its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    kept = counts.repartition("lang", "term").mapInArrow(_kept(least), "lang string, term string, total bigint, sources array<string>, counts array<bigint>")
    kept = scratch.keep(kept, "kept")

    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("spoken"))
    of_source = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("whole"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    none = {"whole": 0, "v": 0, "spoken": 0}
    sides = scratch.keep(groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(none), "sides")

    buckets = max(1, -(-kept.count() // shard))
    terms_ = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    spread = sides.where("v > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    parts = terms_.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInArrow(_partial(top), "lang string, part string, source string, item string, value bigint")
    parts = scratch.keep(parts, "parts")

    zero = f"(1 + ({ADD * PARTS} div (whole + {ADD} * v)))"
    side = sides.select("lang", "source", "v", F.when(F.col("v") > 0, F.expr(zero)).alias("z"))
    a, b = side.select("lang", "source", "v", "z"), side.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    apart = F.expr("v * (((z - y) * (z - y)) div (z + y))")
    pairs = a.join(b, "lang").where("source < item").select("lang", "source", "item", F.coalesce(apart, F.lit(0)).alias("apart"))
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.col("apart") + F.coalesce("value", F.lit(0)))
    way = lambda s, i: F.struct(F.col(s).alias("source"), F.lit("pair").alias("part"), F.col(i).alias("item"), F.col("value"))
    pairs = pairs.select("lang", F.inline(F.array(way("source", "item"), way("item", "source"))))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pairs).union(ranked(parts.where("part = 'term'").select("lang", "source", "part", "item", "value")).where(F.col("rank") <= top))


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11."""
    return source_divergence(tx.table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GAP = "((g.p - {q}) * (g.p - {q})) // (g.p + {q})"
DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array({_LOW}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS spoken FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT lang, source, coalesce(sum(n), 0) AS whole FROM s LEFT JOIN c USING (lang, source) GROUP BY lang, source),
g AS (SELECT z.lang, z.source, k.term, coalesce(n, 0) AS n, (1 + {PARTS} * (coalesce(n, 0) + {ADD})::HUGEINT // (whole + {ADD} * v))::BIGINT AS p, (1 + {PARTS} * (total + {ADD})::HUGEINT // (spoken + {ADD} * v))::BIGINT AS q
  FROM z JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
e AS (SELECT g.lang, g.source, o.source AS item, sum({_GAP.format(q="o.p")})::BIGINT AS value FROM g JOIN g o ON g.lang = o.lang AND g.term = o.term AND g.source <> o.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM s x JOIN s y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN e ON e.lang = x.lang AND e.source = x.source AND e.item = y.source),
b AS (SELECT lang, source, 'term' AS part, term AS item, ({_GAP.format(q="g.q")})::BIGINT AS value FROM g WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT * FROM u WHERE part = 'pair' OR rank <= {TOP}"""
