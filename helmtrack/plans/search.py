"""Queries of full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, search
from ..storage import new_path
from .carriers import table
from .registry import query

TEXT = "the heention of onen-thing"
_WORDS = ("the", "heention", "of", "onen", "thing")


def _bm25_sql() -> str:
    n = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS n{i}" for i, w in enumerate(_WORDS))
    d = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS d{i}" for i in range(len(_WORDS)))
    score = " + ".join(f"ln(1 + (docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * n{i} * 2.2::DOUBLE / (n{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))" for i in range(len(_WORDS)))
    hit = " OR ".join(f"n{i} > 0" for i in range(len(_WORDS)))
    return f"""
WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS length, {n} FROM l), w AS (SELECT count(*) AS docs, avg(length) AS mean, {d} FROM c)
SELECT doc_id, round({score}, 4) AS score FROM c, w WHERE {hit} ORDER BY score DESC, doc_id LIMIT 20"""


@query("bm25_topk", _bm25_sql())
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), TEXT, id_="doc_id", text="text", limit=20)


@query("bm25_index", _bm25_sql())
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index: old texts come first, a later batch replaces them, and one adds the rest."""
    docs = table(spark, sf_dir, "documents")
    found = index.Index(spark, new_path(spark, "index"))
    found.upsert(docs.where("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("onen thing "), F.reverse("text"))), "old", id_="doc_id", text="text")
    found.upsert(docs.where("doc_id % 3 <> 0"), "new", id_="doc_id", text="text")
    found.upsert(docs.where("doc_id % 3 = 0"), "rest", id_="doc_id", text="text")
    return found.bm25(TEXT, limit=20).withColumnRenamed("id", "doc_id")


@query("like_fallback", r"""SELECT doc_id, 1e0 AS score FROM documents WHERE lower(text) LIKE '%of the\_%' ESCAPE '\' OR lower(source) LIKE '%of the\_%' ESCAPE '\' OR lower(text) LIKE '%er. t%' ORDER BY doc_id LIMIT 30""")
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By substring; wildcards in the query stand for themselves."""
    docs = table(spark, sf_dir, "documents")
    found = search.substring(docs, "of the_", id_="doc_id", columns=("text", "source"), limit=1 << 30).union(search.substring(docs, "er. t", id_="doc_id", columns=("text",), limit=1 << 30))
    return found.distinct().orderBy("doc_id").limit(30)


@query("match_expression", r"""
WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[^\w\s\-\.]', ' ', 'g')), '\s+'), lambda t: length(t) > 1) AS w FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM benchmark))
SELECT item_id, array_to_string(list_transform(w, lambda t: '"' || t || '"' || CASE WHEN t LIKE '%*' THEN '' ELSE '*' END), ' OR ') AS match FROM q""")
def match_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    return items.select("item_id", search.match_expression(F.col("text")).alias("match"))


_SECTIONS = r"""
WITH d AS (SELECT conv_id, '# log' || chr(10) || string_agg('## ' || role || ' [2024-0' || (1 + turn % 9)::VARCHAR || '-11]' || chr(10) || regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY turn, role, text) AS t FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
p AS (SELECT conv_id, string_split(regexp_replace(t, '\n(##\s)', chr(1) || '\1', 'g'), chr(1)) AS a FROM d),
u AS (SELECT conv_id, unnest(range(len(a))) AS section, trim(unnest(a), E' \n\t\r') AS body FROM p)
SELECT conv_id, section::BIGINT AS section, trim(regexp_extract(body, '^##\s+([^\n]+)', 1)) AS title, regexp_extract(body, '\[(\d{4}-\d{2}-\d{2})\]', 1) AS dated, length(body)::BIGINT AS chars FROM u WHERE body <> '' AND body NOT LIKE '# %'"""


@query("section_split", _SECTIONS)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dated sections of one text, split again."""
    c = table(spark, sf_dir, "conversations").where("text is not null and role is not null and turn is not null")
    part = F.concat(F.lit("## "), "role", F.lit(" [2024-0"), (F.lit(1) + F.col("turn") % 9).cast("string"), F.lit("-11]\n"), F.regexp_replace("text", r"\s+", " "))
    notes = c.groupBy("conv_id").agg(F.concat(F.lit("# log\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", part.alias("part")))), lambda x: x["part"]), "\n")).alias("content"))
    return search.sections(notes, id_="conv_id").select("conv_id", "section", "title", "dated", F.length("body").cast("bigint").alias("chars"))


@query("search_upsert", """
SELECT doc_id, source, 'old' AS version FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, upper(source), 'new' FROM documents WHERE doc_id % 3 = 0""")
def search_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.select("doc_id", "source", F.lit("old").alias("version"))
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.upper("source").alias("source"), F.lit("new").alias("version"))
    return search.upsert(old, new, "doc_id")
