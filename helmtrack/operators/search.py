"""Full-text search over documents: terms with prefixes, BM25, and a fallback by substring."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(query: str) -> list[str]:
    """Lower-case words of a query of more than one character, without punctuation but dash and point."""
    return list(dict.fromkeys(t.lower() for t in re.sub(r"[^\w\s\-.]", " ", query).split() if len(t) > 1))


def match_expression(query: Column) -> Column:
    """The same as text: each word quoted, as a prefix, joined by OR."""
    clean = F.trim(F.regexp_replace(query, r"[^\w\s\-\.]", " "))
    words = F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > 1)
    return F.array_join(F.transform(words, lambda t: F.concat(F.lit('"'), t, F.lit('"'), F.when(t.endswith("*"), "").otherwise("*"))), " OR ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: str, *, id_: str = "id", text: str = "content", limit: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of the ``limit`` best documents, ties to the smaller id.

    Okapi BM25 with the inverse document frequency ln(1 + (N - n + 0.5) / (n + 0.5)).
    A word of the query stands for all words it begins.  Documents are read
    twice and never shuffled: counts of the query's few words stay with their
    document, and the collection's counts are one row.
    """
    words = terms(query)
    if not words:
        return docs.select(F.col(id_), F.lit(0.0).alias("score")).limit(0)
    parts = [[p for p in re.split("[^a-z0-9]+", w) if p] for w in words]
    flat = list(dict.fromkeys(p for ps in parts for p in ps))
    listed = docs.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("t"))
    counted = listed.select("id", F.size("t").alias("length"), *[F.size(F.filter("t", _begins(w))).alias(f"n{i}") for i, w in enumerate(flat)])
    whole = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(flat))])
    hit = F.lit(False)
    for i in range(len(flat)):
        hit = hit | (F.col(f"n{i}") > 0)
    found = counted.where(hit).join(F.broadcast(whole))  # one row of counts
    score = F.lit(0.0)
    for i in range(len(flat)):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        idf = F.log(1.0 + (F.col("docs") - d + 0.5) / (d + 0.5))
        score = score + idf * n * (k1 + 1.0) / (n + k1 * (1.0 - b + b * F.col("length") / F.col("mean")))
    return found.select(F.col("id").alias(id_), F.round(score, 4).alias("score")).orderBy(F.desc("score"), id_).limit(limit)


def _begins(word: str):
    return lambda t: t.startswith(word)


def substring(docs: DataFrame, query: str, *, id_: str = "id", columns: tuple[str, ...] = ("title", "content"), limit: int = 5) -> DataFrame:
    """id, score 1.0 of documents that hold the query as it is, in ASCII letters of any case, by id."""
    safe = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).like(f"%{safe}%"), F.lit(False))
    return docs.where(hit).select(id_, F.lit(1.0).alias("score")).orderBy(id_).limit(limit)


def search(docs: DataFrame, query: str, *, id_: str = "id", text: str = "content", limit: int = 5) -> DataFrame:
    """Ranked by BM25; by substring where the query has no words to rank by."""
    return bm25(docs, query, id_=id_, text=text, limit=limit) if terms(query) else substring(docs, query, id_=id_, columns=(text,), limit=limit)


def sections(docs: DataFrame, *, id_: str = "id", text: str = "content") -> DataFrame:
    """id, section, title, dated, body: parts of a text that begin with '## ', without a leading '# ' part."""
    parts = F.split(F.col(text), r"\n(?=##\s+)")
    rows = docs.select(F.col(id_), F.posexplode(parts).alias("section", "body")).withColumn("body", F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")))
    rows = rows.where((F.col("body") != "") & ~F.col("body").startswith("# "))
    head = F.trim(F.regexp_extract("body", r"^##\s+([^\n]+)", 1))
    title = F.when(head != "", head).otherwise(F.concat(F.lit("Section "), (F.col("section") + 1).cast("string")))
    return rows.withColumn("title", title).select(id_, F.col("section").cast("bigint").alias("section"), "title", F.nullif(F.regexp_extract("title", r"\[(\d{4}-\d{2}-\d{2})\]", 1), F.lit("")).alias("dated"), "body")


def records(lines: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """key, record, at, lines: what follows each marker line up to the next one; lines before the first are left out.

    The record of a line is the running count of markers in its key.
    """
    count = F.count_if(marker).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.select(key, F.col(order).alias("at"), "line", count.alias("record")).where("record > 0")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "record").agg(F.min("at").alias("at"), listed.alias("lines"))


def commit_documents(lines: DataFrame, *, key: str = "series_id", order: str = "n") -> DataFrame:
    """Documents of an exported log: a line of hash, author, date and subject parted by bars begins a commit, indented lines after it are its summary, those after 'Notes:' its note.

    The subject may hold bars itself.
    """
    head = r"^([0-9a-f]{7,40})\|([^|]*)\|(\d{4}-\d{2}-\d{2})\|(.*)$"
    found = records(lines, key, order, F.col("line").rlike(head))
    part = F.split(F.get("lines", F.lit(0)), r"\|", 4)
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    mark = F.coalesce(F.array_position(rest, "Notes:"), F.lit(0)).cast("int")
    before = F.when(mark > 0, F.slice(rest, 1, F.greatest(mark - 1, F.lit(0)))).otherwise(rest)
    after = F.when(mark > 0, F.slice(rest, mark + 1, F.greatest(F.size(rest) - mark, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    text = lambda x: F.trim(F.array_join(F.transform(x, lambda v: F.trim(v)), "\n"))
    rows = found.select(*[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(("hash", "author", "dated", "subject"))], text(before).alias("summary"), text(after).alias("note"))
    named = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c))
    blocks = F.array(named("Commit", "hash"), named("Author", "author"), named("Date", "dated"), named("Message", "subject"), F.concat(F.lit("Summary:\n"), "summary"), F.when(F.col("note") != "", F.concat(F.lit("Note:\n"), "note")))
    title = F.concat(F.lit("["), "dated", F.lit("] Commit: "), "subject")
    return rows.select(F.concat(F.lit("commit:"), "hash").alias("id"), F.lit("commit").alias("kind"), F.col("hash").alias("ref"), title.alias("title"), F.array_join(blocks, "\n\n").alias("content"), "dated")


def section_documents(docs: DataFrame, *, id_: str = "id", text: str = "content") -> DataFrame:
    """Documents of the sections of texts."""
    name = F.col(id_).cast("string")
    rows = sections(docs, id_=id_, text=text)
    return rows.select(F.concat(F.lit("doc:"), name, F.lit(":"), F.col("section").cast("string")).alias("id"), F.lit("section").alias("kind"), name.alias("ref"), F.concat(F.lit("["), name, F.lit("] "), "title").alias("title"), F.col("body").alias("content"), "dated")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All new rows, and the old ones whose key they lack."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
