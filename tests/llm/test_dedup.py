"""Substring, byte and near dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helmtrack.llm import minhash, substring, suffix

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain_substring(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = {}
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), sha(kept.encode()))
    return out


@pytest.mark.parametrize(("window", "period", "cover"), [(35, 21, (0, 1, 4, 14, 16)), (10, 7, (0, 1, 3))])
def test_substring(docs, odd, window, period, cover):
    got = substring.drop_repeated_windows(docs, window=window, period=period, cover=cover).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_substring(odd, window)
    assert len(got) == len(odd)
    with pytest.raises(ValueError):
        substring.drop_repeated_windows(docs, window=window, period=7, cover=(0, 1))


def plain_suffix(rows, length):
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize(("length", "gram"), [(50, 16), (20, 8)])
def test_suffix(docs, odd, length, gram):
    got = suffix.drop_repeated_bytes(docs, length=length, gram=gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_suffix(odd, length)
    assert len(got) == len(odd)


@pytest.mark.parametrize("hot", [1, 20])
def test_suffix_deals_hot_minimizers(spark, hot):
    """A footer in every text, with differing text around it: nearly one class a document at one minimizer."""
    footer = "all rights reserved, see the licence for the terms of use"
    rng = np.random.default_rng(6)
    word = lambda: bytes(rng.integers(97, 123, 40).astype(np.uint8)).decode()
    rows = [(i, f"{word()} {footer[i % 3 :]} {word()}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = suffix.drop_repeated_bytes(docs, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_suffix(rows, 50)
    assert sum(r.n_removed > 0 for r in got) > 190


def test_suffix_sort_groups_equal_strings():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(30, 90, 40)]
    texts += [b"a" * 100, texts[0] + texts[1]]
    of, inside, members, heads = suffix.equal_strings(texts, 30)
    found = {tuple(sorted(g.tolist())) for g in np.split(members, heads[1:])}
    by = defaultdict(list)
    for k, (t, i) in enumerate(zip(of, inside, strict=True)):
        by[texts[t][i : i + 30]].append(k)
    assert found == {tuple(v) for v in by.values() if len(v) > 1}


def test_multikey_sorts_large_inputs():
    words = np.random.default_rng(5).integers(0, 40, (30000, 3)).astype(np.uint64)
    order, cuts = suffix.multikey(words, 3)
    assert np.array_equal(words[order], words[np.lexsort((words[:, 2], words[:, 1], words[:, 0]))])
    assert len(cuts) - 1 == len(np.unique(words, axis=0))


def plain_near(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, odd, size):
    got = minhash.near_duplicates(spark, docs, size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == plain_near(odd, size, 80)


def test_links_that_only_members_have(spark):
    """A chain: each neighbour is near enough, the ends are not; no star around one centre holds it."""
    words = [f"k{i}" for i in range(100)]
    rows = [(10 * k, " ".join([f"x{j}" for j in range(4 * k)] + words[4 * k :])) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, docs).collect()}
    assert got == plain_near(rows, 2, 80)


def test_stage_keeps_one_of_a_group(spark, docs, odd):
    kept = minhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {d for d, v in plain_near(odd, 5, 80).items() if v[2]}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("run", [lambda s, d: substring.drop_repeated_windows(d), lambda s, d: suffix.drop_repeated_bytes(d), lambda s, d: minhash.near_duplicates(s, d)])
def test_odd_tables(spark, docs, run):
    assert run(spark, docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, None), (1, "same " * 60), (1, "same " * 60), (2, "same " * 60)], "doc_id bigint, text string")
    assert run(spark, nulls.selectExpr("doc_id", "text", "1 as key", "2 as n", "3 as doc", "'x' as digest", "array(1) as marks")).count() == 5


def test_equal_ids_count_as_copies(spark):
    same = spark.createDataFrame([(1, "z " * 40), (1, "z " * 40)], "doc_id bigint, text string")
    assert [r.n_removed for r in substring.drop_repeated_windows(same).collect()] == [40, 40]
    assert [r.n_removed for r in suffix.drop_repeated_bytes(same).collect()] == [0, 0]


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_rows_of_a_null_id_count_like_others(spark, tmp_path, kind):
    """Against the SQL, which numbers the rows."""
    import duckdb

    from helmtrack.llm.sql import SUBSTRING

    p = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"a {p} b"), ("1", f"c {p} d"), ("2", "e " * 5), (None, "q " * 36), (None, None), (None, f"only {p[:60]}")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = substring.drop_repeated_windows(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got.schema["doc_id"].dataType.simpleString() == kind
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(SUBSTRING).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sorted(r[2] for r in want) == [0, 0, 0, 36, 40, 40]
