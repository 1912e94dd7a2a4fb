"""Source divergence, mixing and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmtrack.llm import curriculum, divergence, runs
from helmtrack.llm.queries import oracle_sql, queries

from ..compare import database, rows

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_divergence", "op12_mix", "op13_runs"])
def test_queries_match_their_sql(spark, name):
    got = queries()[name](spark, SMALL).toPandas()
    want = database(SMALL).execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_mix", "op13_runs"])
def test_queries_match_their_sql_on_odd_rows(spark, folder, name):
    """Nulls, copies, one long text, sources and languages without a name."""
    got = queries()[name](spark, folder).toPandas()
    con = database("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert rows(got) == rows(con.execute(oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["op11_divergence", "op12_mix", "op13_runs"])
def test_queries_on_an_empty_table(spark, tmp_path, name):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 0


# --- divergence -------------------------------------------------------------


def plain_divergence(docs, least, top):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    said, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(low(text))
        said[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang in seen:
        kept = {t for t, n in seen[lang].items() if n >= least}
        sources = sorted(s for x, s in said if x == lang)
        whole = sum((said[lang, s] for s in sources), Counter())

        def p(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + int(Fraction(10**9 * (count[t] + 2), n + 2 * len(kept))) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(said[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in sources if o != s]
            led = [(-f(ps[s][t], q[t]), t.encode()) for t in kept if said[lang, s][t] and ps[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(led)[:top], 1)}
    return out


@pytest.mark.parametrize("shard", [1, 7, 10**6])
def test_divergence_against_plain_python(spark, shard):
    rng = random.Random(2)
    words = [f"t{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(60)]
    docs = []
    for _ in range(90):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot"] * 5 + ["a", "B", None, "ü", "only-x"])
        docs.append((rng.choice([None, "", " 1 2 ", "X-x x'X", " ".join(rng.choice(words[: rng.randrange(2, 60)]) for _ in range(rng.randrange(60)))]), lang, source))
    docs += [("A", "lonely", "s"), (None, "none", "s"), ("b", "none", "r")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(None).cast("int"), "value": F.lit("x")})
    got = [tuple(r) for r in divergence.source_divergence(df.repartition(5), least=4, top=3, shard=shard).collect()]
    want = plain_divergence(docs, 4, 3)
    assert len(got) == len(set(got)) and set(got) == want


def test_shards_fold_their_counts(monkeypatch):
    """A shard that gets many partial counts gives the same sums as one that holds them all."""
    import pyarrow as pa

    rng = random.Random(4)
    parts = [("en", rng.choice("abc"), f"w{rng.randrange(9)}", rng.randrange(5), 1) for _ in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts[i : i + 50], strict=True)], names=["lang", "source", "term", "n", "docs"]) for i in range(0, 900, 50)]
    tell = lambda out: sorted((r["lang"], r["term"], r["total"], sorted(zip(r["sources"], r["counts"], strict=True))) for b in out for r in b.to_pylist())
    whole = tell(divergence._kept(20)(iter(batches)))
    monkeypatch.setattr(divergence, "FOLD", 60)
    assert whole == tell(divergence._kept(20)(iter(batches))) and len(whole) == 9


# --- mixing -----------------------------------------------------------------


def plain_targets(sizes, weights, budget, most):
    """Shares by weight, those above their limit stopped, until none is."""
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    words, limited = sum(sizes.values()), set()
    while True:
        left = Fraction(*budget) * words - sum(most * sizes[s] for s in limited)
        free = [s for s in order if s not in limited]
        target = {s: Fraction(most * sizes[s]) if s in limited else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        limited |= over


@pytest.mark.parametrize(("weights", "budget", "epochs"), [((5, 2, 1), (3, 2), 2), ((1, 30, 2), (5, 2), 3), ((1,), (1, 2), 1)])
def test_mixture(spark, weights, budget, epochs):
    rng = random.Random(5)
    names = ["hot"] * 60 + ["a", "A", "é", "", None] * 3 + ["small"]
    docs = [(i if i % 9 else None, " \t".join(["w"] * rng.choice([0, 1, 3, 40, 200])) + "\n" if i % 7 else None, rng.choice(names)) for i in range(300)] + [(7, "x y", "hot")] * 4
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"size": F.lit(1), "digest": F.lit("x"), "takes": F.lit(None).cast("int")})
    schedules = [((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 2.0))[i % 3] for i in range(len(weights))]
    mixed = curriculum.mix(df.repartition(7), weights=weights, budget=budget, epochs=epochs, schedules=schedules).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, s in docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    target = plain_targets(sizes, weights, budget, epochs)
    taken = Counter()
    for r in mixed:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]), rel=1e-12)
        assert r.taken == sum(x.words for x in r.takes) <= epochs * r.size
        assert [x.epoch for x in r.takes] == sorted({x.epoch for x in r.takes})
        assert all(0 <= x.position <= curriculum.PARTS and 0 < x.words <= r.size for x in r.takes)
    assert all(taken[s] == int(t) for s, t in target.items())
    again = curriculum.mix(df.repartition(2), weights=weights, budget=budget, epochs=epochs, schedules=schedules).collect()
    assert Counter(map(str, mixed)) == Counter(map(str, again))


def test_the_schedule_is_followed(spark):
    """At each time a source has given what the integral of its weights asks for."""
    docs = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(6000)]
    mixed = curriculum.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    order = curriculum.training_order(mixed)
    positions = [r.position for r in order.select("position").collect()]
    assert positions == sorted(positions)
    stop = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    rows_ = order.collect()
    for k, s in enumerate("abc"):
        for time in (0.1, 0.5, 0.8, 1.0):
            m = curriculum.SCHEDULES[k]
            grid = np.linspace(0, time, 20001)
            want = np.trapezoid(np.interp(grid, curriculum.KNOTS, m), grid) / np.trapezoid(np.interp(np.linspace(0, 1, 20001), curriculum.KNOTS, m), np.linspace(0, 1, 20001))
            got = sum(r.words for r in rows_ if r.source == s and r.position <= time * curriculum.PARTS)
            assert got / stop[s] == pytest.approx(want, abs=0.003), (s, time)


def test_schedules_are_checked(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id bigint, text string, source string")
    for bad in ({"weights": (0, 1, 2)}, {"schedules": ((1, 1, 1),)}, {"budget": (5, 2)}, {"schedules": ((0, 0, 0),) * 3}, {"knots": (0.0, 0.0, 1.0)}):
        with pytest.raises(ValueError):
            curriculum.mix(docs, **bad)
    assert curriculum.mix(docs.withColumn("text", F.lit(" "))).select("target", "taken").collect() == [(0.0, 0)]


def test_no_digest_bucket_is_hot(spark):
    """A third of the rows under one id still spreads over the sums."""
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("one").alias("source"))
    mixed = curriculum.mix(docs)
    assert mixed.agg(F.sum("taken")).first()[0] == 9000
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[-1]


# --- runs -------------------------------------------------------------------


def plain_runs(t, least, times):
    n, out = len(t), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(x for x in out if not any(y[2] < x[2] and y[0] <= x[0] and sum(y[:2]) >= sum(x[:2]) for y in out))


def periodic(rng, n):
    t = [rng.randrange(rng.randrange(1, 5)) for _ in range(n)]
    p, a = rng.randrange(1, 6), rng.randrange(n)
    return [t[i] if i < a or a + p > n else t[a + (i - a) % p] for i in range(n)] if rng.random() < 0.6 else t


@pytest.mark.parametrize(("least", "times"), [(1, 3), (6, 3), (24, 3), (10, 4)])
def test_runs_against_all_periods(least, times):
    rng = random.Random(6)
    for _ in range(800):
        n = rng.randrange(1, 80)
        t = periodic(rng, n)
        assert runs.runs_of(t, least, times) == plain_runs(t, least, times), t
        first, end = runs.repetitive(np.zeros(n, np.int64), np.array(t), least, times)
        cut = sorted((a + s, m, p) for a, b in zip(first.tolist(), end.tolist(), strict=True) for s, m, p in runs.runs_of(t[a:b], least, times))
        assert cut == plain_runs(t, least, times), t


def test_next_smaller_suffixes():
    rng = random.Random(7)
    for _ in range(400):
        t = periodic(rng, rng.randrange(1, 50))
        n = len(t)
        smaller, share = runs.next_smaller(t)
        assert smaller == [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n)]
        for i, j in enumerate(smaller):
            if j < n:
                assert share[i] == next((v for v in range(n - j) if t[i + v] != t[j + v]), n - j)


class Counted(int):
    """A word that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("kind", ["one word", "Fibonacci", "two words", "long period", "rising", "falling"])
def test_words_are_compared_in_linear_time(kind):
    rng = random.Random(8)
    a, b = [0], [0, 1]
    while len(b) < 20000:
        a, b = b, b + a
    t = {"one word": [0] * 20000, "Fibonacci": b, "two words": [rng.randrange(2) for _ in range(20000)], "long period": [rng.randrange(9) for _ in range(2000)] * 10, "rising": list(range(20000)), "falling": list(range(20000, 0, -1))}[kind]
    Counted.seen = 0
    runs.next_smaller([Counted(x) for x in t])
    assert Counted.seen < 4 * len(t)


def plain_document(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 24, 3) if n < 3000 else None
    if found is None:
        return None
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return n, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_documents_against_plain_python(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a " * 23, "a " * 24, "a\x0b\x0ca " * 40, "ab " * 30 + "c " + "ab " * 30, "x y z " * 8, "x y z " * 7 + "x y", "é ü 漢字 " * 20, "w" * 50000]
    texts += [" ".join(f"w{x}" for x in periodic(rng, rng.randrange(1, 200))) for _ in range(120)]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    docs = [(None if i % 11 == 5 else i * 37 - 40, t) for i, t in enumerate(texts)] + [(4, texts[6])] * 2
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"start": F.lit("x"), "n_runs": F.lit(1), "runs": F.lit(None).cast("int")})
    fields = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter((r.doc_id, *(r[f] for f in fields)) for r in runs.periodic_runs(df.repartition(3), plant=True).collect())
    assert got == Counter((d, *plain_document(d, t)) for d, t in docs)
    assert sum(x[2] > 0 for x in got) > 20
    kept = runs.periodic_runs(df.where("doc_id is not null and text is not null")).select("doc_id", "runs", "collapsed").collect()
    for r in kept:
        if not r.runs and r.doc_id != 4:
            assert r.collapsed == " ".join(WORD.findall(dict(docs)[r.doc_id]))
