"""The pipeline's stages on odd, repeated and empty rows, and what releases of shuffles do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


def through(spark, docs, stages, tmp_path):
    """Each stage's rows, written and read again."""
    out = []
    for name, stage in stages:
        at = f"{tmp_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs)
    return out


def test_stages_on_odd_rows(spark, stages, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    passage = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len((r.text or "").split()) > 25)
    plain = "the river runs slowly past the old mill where nobody has lived for many years now"
    odd = [(None, None), (None, plain + " a"), (90001, None), (90002, ""), (90003, plain), (90003, plain), (90004, plain), (90005, "mail root@10.20.30.40 " + " ".join(f"q{i}" for i in range(30))), (90006, f"{' '.join(f'k{i}' for i in range(40))} {passage} {' '.join(f'm{i}' for i in range(40))}"), (90007, "w" * 200_000)]
    rows = spark.createDataFrame([(d, t, None, None, None) for d, t in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = documents.unionByName(rows.withColumn("n_chars", F.col("n_chars").cast(documents.schema["n_chars"].dataType))).withColumns({"score": F.lit("x"), "ids": F.lit(1), "found": F.lit(None).cast("int"), "row": F.lit(2)})
    steps = through(spark, docs, stages, tmp_path)
    for step in steps:
        assert step.columns[: len(docs.columns)] == docs.columns
        assert {r[0] for r in step.select("score").distinct().collect()} == {"x"}
    last = {}
    for r in steps[-1].collect():
        last.setdefault(r.doc_id, []).append(r)
    assert None in last and last[90001][0].text is None and last[90002][0].text == ""
    assert len(last[90003]) == 2 and 90004 not in last  # rows that repeat a kept id stay, a near copy leaves
    assert "10.20.30.40" not in last[90005][0].text and last[90005][0].text.startswith("mail root@10.")
    assert passage not in last[90006][0].text and "k39" in last[90006][0].text and "m39" in last[90006][0].text
    assert last[90007][0].text == "w" * 200_000
    assert all(r.n_tokens == len(r.ids_) if "ids_" in r else True for rs in last.values() for r in rs)


def test_stages_on_an_empty_table(spark, stages, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for step in through(spark, docs, stages, tmp_path):
        assert step.count() == 0 and step.columns[: len(docs.columns)] == docs.columns
