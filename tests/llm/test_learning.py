"""Pseudonyms, language-model scores, toxicity and the pipeline."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from helmtrack.llm import pii, suffix_tree_lm, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- pseudonyms -------------------------------------------------------------


def plain_text(value, tweak, key):
    """The same network in Python."""
    cut = len(value) // 2
    left, right = value[:cut], value[cut:]
    for i in range(1, pii.ROUNDS + 1):
        stream = hashlib.sha256("|".join([key, tweak, str(i), str(len(value)), right]).encode()).hexdigest()
        out = ""
        for j, c in enumerate(left):
            by = int(stream[j % 16 * 4 : j % 16 * 4 + 4], 16) + j // 16 * 7
            for base, n in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + n:
                    c = chr((ord(c) - base + by) % n + base)
                    break
            if ord(c) > 127:  # the last six bits
                raw = c.encode()
                c = (raw[:-1] + bytes([128 + (raw[-1] - 128 + by) % 64])).decode()
            out += c
        left, right = right, out
    return left + right


def plain_number(value, a, b, tweak, key):
    left, right = divmod(value, b)
    for i in range(1, pii.ROUNDS + 1):
        amount = int(hashlib.sha256("|".join([key, tweak, str(i), str(right)]).encode()).hexdigest()[:12], 16)
        left, right = right, (left + amount) % (a if i % 2 else b)
    return left * b + right


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return {r.doc_id: (r.text, list(r.pii)) for r in pii.pseudonymise(df).collect()}


def test_values_are_permuted_within_their_format(spark):
    texts = ["card 4539 1488 0343 6467.", "card 4539148803436467", "mail jane.Doe+1@example.org!", "born 1987-06-05 or 06/05/1987 or 05.06.1987", "ssn 123-45-6789", "at 192.168.10.77:80", "call +1 415 555 2671 or (415) 555-2671"]
    got = run(spark, texts)
    key = pii.KEY
    body = "4" + plain_text("53914880343646", "card4", key)
    check = str((10 - sum((lambda d: d - 9 if d > 9 else d)(int(c) * (1 + (i + 1) % 2)) for i, c in enumerate(reversed(body)))) % 10)
    assert got[1][0] == f"card {body}{check}" and luhn(body + check)
    assert got[0][0].replace(" ", "") == got[1][0].replace(" ", "") + "."
    assert got[2][0] == f"mail {plain_text('jane.Doe+1', 'email', key)}@example.org!"
    day = plain_number((dt.date(1987, 6, 5) - dt.date(1800, 1, 1)).days, 189, 773, "date", key)
    new = dt.date(1800, 1, 1) + dt.timedelta(days=day)
    assert got[3][0] == f"born {new:%Y-%m-%d} or {new:%m/%d/%Y} or {new:%d.%m.%Y}"
    n = plain_number(44 * 9999 + 6788, 99, 9999, "ssn123", key)
    assert got[4][0] == f"ssn 123-{n // 9999 + 1:02d}-{n % 9999 + 1:04d}"
    ip = plain_number(168 * 65536 + 10 * 256 + 77, 4096, 4096, "ipv4192", key)
    assert got[5][0] == f"at 192.{ip >> 16}.{ip >> 8 & 255}.{ip & 255}:80"
    assert re.fullmatch(r"call \+1 4\d\d \d{3} \d{4} or \(4\d\d\) \d{3}-\d{4}", got[6][0])
    assert [v[1] for _, v in sorted(got.items())] == [["card"], ["card"], ["email"], ["date"] * 3, ["ssn"], ["ipv4"], ["phone"] * 2]


def test_the_networks_are_permutations(spark):
    a = spark.range(1000).select(pii.permute_number(F.col("id"), 25, 40, F.lit("t"), "k").alias("v"))
    assert sorted(r.v for r in a.collect()) == list(range(1000))
    b = spark.range(1000).select(pii.permute_text(F.format_string("%03d", "id"), F.lit("t"), "k").alias("v"))
    assert len({r.v for r in b.collect()}) == 1000


def test_what_is_not_valid_stays(spark):
    texts = ["4539 1488 0343 6468", "2023-02-30 13/13/2020", "000-12-3456 123-00-4567", "300.1.1.1 1.2.3.4.5", "x@y", "", None, "no digits", "version 1.2.3"]
    got = run(spark, texts)
    assert {i: v[0] for i, v in got.items()} == dict(enumerate(texts))
    assert all(not v[1] for v in got.values())


def test_equal_values_stay_linked_and_columns_pass(spark):
    df = spark.createDataFrame([(1, "a 123-45-6789", "x", 1), (2, "b 123-45-6789 c 123-45-6788", None, 2)], "doc_id bigint, text string, found string, row int")
    out = pii.stage(spark, df, "")
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text[2:] == rows[2].text[2:13] != rows[2].text[-11:]
    assert (rows[2].found, rows[2].row) == (None, 2)
    assert pii.pseudonymise(df.limit(0)).count() == 0


#: The kinds in the order in which they are tried, written anew.
PLAIN_KINDS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.){1,8}[^\W\d_]{2,63}",
    "date": r"(?<![0-9]|[.]|/|-)(?:[0-9]{4}(?:-[0-9][0-9]){2}|(?:[0-9][0-9]/){2}[0-9]{4}|(?:[0-9][0-9][.]){2}[0-9]{4})(?![0-9]|[.][0-9]|/[0-9]|-[0-9])",
    "ssn": r"(?<![0-9]|-)[0-9]{3}-[0-9][0-9]-[0-9]{4}(?![0-9])(?!-[0-9])",
    "ipv4": r"(?<![0-9]|[.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9])(?![.][0-9])",
    "phone": r"(?<![0-9]|[+])[+][0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?(?:[ .-]?[0-9]{3,4}){2}(?![0-9])|(?<![0-9]|[+]|-)(?:[(][0-9]{3}[)] ?|[0-9]{3}[.]|[0-9]{3}-)[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ ][0-9]{4}|-[0-9]{4}){3})(?![0-9])",
}
PLAIN_ANY = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PLAIN_KINDS.items()))


def plain_value(kind, m, key):
    """Pseudonym of one match, in plain Python; None where it fails validation."""

    def refill(digits):
        it = iter(digits)
        return "".join(next(it) if c in "0123456789" else c for c in m)

    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, at, rest = m.partition("@")
        return plain_text(local, "email", key) + at + rest
    if kind == "date":
        for form in (["%Y-%m-%d"] if "-" in m else ["%m/%d/%Y", "%d/%m/%Y"] if "/" in m else ["%d.%m.%Y"]):
            try:
                day = dt.datetime.strptime(m, form).date()
            except ValueError:
                continue
            if 1800 <= day.year <= 2199:
                new = dt.date(1800, 1, 1) + dt.timedelta(days=plain_number((day - dt.date(1800, 1, 1)).days, 189, 773, "date", key))
                return f"{new:{form}}"
    if kind == "ssn":
        a, g, n = m.split("-")
        if a not in ("000", "666") and a < "900" and g != "00" and n != "0000":
            v = plain_number((int(g) - 1) * 9999 + int(n) - 1, 99, 9999, f"ssn{a}", key)
            return f"{a}-{v // 9999 + 1:02d}-{v % 9999 + 1:04d}"
    if kind == "ipv4":
        a = [int(x) for x in m.split(".")]
        if max(a) < 256:
            v = plain_number(a[1] << 16 | a[2] << 8 | a[3], 4096, 4096, f"ipv4{a[0]}", key)
            return f"{a[0]}.{v >> 16}.{v >> 8 & 255}.{v & 255}"
    if kind == "phone" and (8 <= len(d) <= 15 or m[0] != "+"):
        code = re.match(r"\+([0-9]{1,3})[ .(-]", m)
        n = (len(code[1]) if code else 0) + 1
        return refill(d[:n] + plain_text(d[n:], f"phone{d[:n]}", key))
    if kind == "card" and luhn(d):
        body = d[0] + plain_text(d[1:-1], f"card{d[0]}", key)
        return refill(body + next(c for c in "0123456789" if luhn(body + c)))
    return None


def plain_pseudonyms(text, key):
    kinds = []

    def one(m):
        new = plain_value(m.lastgroup, m[0], key)
        if new is None:
            return m[0]
        kinds.append(m.lastgroup)
        return new

    return PLAIN_ANY.sub(one, text), kinds


def test_whole_texts_against_plain_python(spark):
    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    more = ["see a.b@c.org...thanks", "x@y.com.", "x@y..com", "x@-.co", "q@a.b.c1", "u@h.com-x.de", "me@" + "a" * 64 + ".com", "l" * 200 + "@mail.example.net", "1.2.3.4 and 10.0.0.256", "+44 20 7946 0958, (415) 555-2671, 415.555.2671", "1799-12-31 2199-12-31 29/02/2024", "ж.ю@почта.рф", "a@b.c.d.e.f.g.h.i.j.k.com"]
    got = run(spark, sample + more)
    for i, t in enumerate(sample + more):
        assert got[i] == (plain_pseudonyms(t, pii.KEY) if t is not None else (None, [])), t
    assert sum(len(v[1]) for v in got.values()) > 20


def test_a_user_name_hides_nothing(spark):
    """Values behind something that looks like an address and is none, and addresses that are not plain ASCII."""
    texts = ["ssh root@10.20.30.40 now", "http://user@192.168.0.1/x", "pay 4111111111111111@5 x", "4111-1111-1111-1111@home", "ünï@mail.com", "x@y@z.com", "a@123-45-6789", "me@1987-06-05", "q@+1 415 555 2671"]
    kinds = ["ipv4", "ipv4", "card", "card", "email", "email", "ssn", "date", "phone"]
    got = run(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == [[k] for k in kinds]
    for i, t in enumerate(texts):
        assert got[i] == plain_pseudonyms(t, pii.KEY)
        assert got[i][0] != t and (kinds[i] == "ipv4" or len(got[i][0]) == len(t))
    assert got[4][0].endswith("@mail.com") and not set("ünï") & set(got[4][0].split("@")[0])


@pytest.mark.parametrize("part", [".cc", "a", ".", "1.", "1234 ", "x@y.zz"])
def test_values_of_a_million_characters(spark, part):
    n = 10**6 // len(part)
    texts = ["a@b" + part * n, part * n, part * n + "@b.cc end"]
    got = run(spark, texts)
    assert all(len(got[i][0]) == len(t) for i, t in enumerate(texts))


def test_the_key_is_the_caller_s(spark):
    df = spark.createDataFrame([(1, "a 123-45-6789")], "doc_id bigint, text string")
    mine = pii.stage(spark, df, "", key="mine").first().text
    assert mine == plain_pseudonyms("a 123-45-6789", "mine")[0] != pii.stage(spark, df, "").first().text
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.stage(spark, df, "").first().text == mine
    finally:
        spark.conf.unset(pii.KEY_SETTING)


# --- language model ---------------------------------------------------------


def plain_base(rows):
    words = {d: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    count = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    return {d: (held[d], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for d, ws in words.items()}


def test_base_scores(docs, odd):
    got = {r.doc_id: r for r in suffix_tree_lm.lm_scores(docs, depth=3, held=300, frequent=1e-3).collect()}
    for d, (held, n_tokens, n_known, train, base) in plain_base(odd).items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def plain_scores(rows, depth, least, gain):
    """Log10 probabilities by a suffix tree in plain Python."""
    raw = {}
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        raw[d] = b"\n" * depth + " ".join(WORD.findall(low)).encode() + b"\n"
    counts = {}
    for d, t in raw.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for i in range(depth, len(t)):
                for k in range(depth + 1):
                    counts.setdefault(t[i - k : i], Counter())[t[i]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}

    def retained(c):
        up = c[1:]
        return total[c] >= least and sum(n * math.log(n * total[up] / total[c] / counts[up][s]) for s, n in counts[c].items()) >= gain

    kept = {c for c in counts if c and retained(c)}

    def p(c, s):
        if not c:
            return (counts.get(b"", {}).get(s, 0) + 0.5) / (total.get(b"", 0) + 128)
        shorter = p(c[1:], s)
        return (counts[c][s] + len(counts[c]) * shorter) / (total[c] + len(counts[c])) if c in kept else shorter

    return {d: sum(math.log10(p(t[i - depth : i], t[i])) for i in range(depth, len(t))) for d, t in raw.items()}, len(kept)


@pytest.mark.parametrize(("depth", "held"), [(7, 500), (3, 1 << 20), (2, 0)])
def test_scores_against_a_plain_tree(docs, odd, depth, held):
    """Wherever contexts are kept: by every worker, or in the joined table."""
    want, kept = plain_scores(odd, depth, 5, 12.0)
    got = {r.doc_id: r.score for r in suffix_tree_lm.lm_scores(docs, depth=depth, held=held, frequent=1e-3).collect()}
    assert kept > 50 and got == pytest.approx(want, rel=1e-9)


def test_the_tree_sums_to_one_and_grows(docs, spark):
    from helmtrack.llm.shared import Scratch

    train = docs.select("doc_id", "text")
    some, all_ = (suffix_tree_lm.learn(Scratch(spark, "t"), x, depth=3).tree for x in (train.where("doc_id % 3 = 0"), train))
    rng = random.Random(1)
    for _ in range(20):
        c = int.from_bytes(" ".join(rng.choice(["w1", "w23", "漢字", "q"]) for _ in range(4)).encode()[-3:], "big")
        every = np.array([c << 8 | b for b in range(256)], np.uint64)
        assert (10.0 ** all_.grams(every)).sum() == pytest.approx(1.0, abs=1e-9)
    assert sum(len(x[2]) for x in all_.levels) > 1.5 * sum(len(x[2]) for x in some.levels)


def test_model_beats_the_base(spark):
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffix_tree_lm.lm_scores(prose).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 1.04 * got[1]  # both are negative; it is ahead of the base from some 10 MB on


def test_lm_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (1, "another text"), (None, "the cat sat on the mat"), (None, None), (2, "the dog"), (9, "the cat")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id bigint, text string, row int, key int")
    got = suffix_tree_lm.lm_scores(docs, frequent=0.2, depth=3, least=2, gain=0.1, held=3).collect()
    assert len(got) == len(rows) and all(r.held_out is not None and r.n_known <= r.n_tokens for r in got)
    same = [r for r in got if r.n_tokens == 7]
    assert len(same) == 3 and len({(r.n_known, r.base_score, r.score) for r in same}) == 1 and same[0].n_known == 7
    assert not any(r.held_out for r in got if r.doc_id is None)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in (1, 2, 9)} | {None: False}
    assert got[0].train_tokens == sum(len((t or "").split()) + 1 for d, t in rows if not held[d])


def test_lm_on_odd_tables(docs):
    assert suffix_tree_lm.lm_scores(docs.limit(0), depth=2).count() == 0
    only_held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert only_held.count() > 0
    assert {r.n_known for r in suffix_tree_lm.lm_scores(only_held, depth=2).collect()} == {0}


# --- toxicity ---------------------------------------------------------------


def labelled(spark, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Vile,", "scum", "rot!"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(n, None, None, None, 0), (n + 1, "", "en", "s", 0), (n + 2, "scum " * 5000, "en", "s", 0)]
    labels += [(n + 5, 1, 1), (3, 1, None), (None, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, tmp_path):
    docs, labels = labelled(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if i < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) / len(held) > 0.97
    kept = toxicity.stage(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 600 in ids and 601 in ids and 602 not in ids


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 30)
    for some, want in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        model = toxicity.fit(spark, docs, some)
        assert {r.score for r in toxicity.scored(docs, model)[0].collect()} == {want}
    assert toxicity.scored(docs.limit(0), toxicity.Model())[0].count() == 0


def test_documents_of_the_sample_are_read_in_parallel(spark, tmp_path):
    """Training is one task; reading and tokenising are as many as the documents' partitions."""
    docs, labels = labelled(spark, 60)
    at = str(tmp_path)

    def noted(batches):
        from pyspark import TaskContext

        open(f"{at}/{TaskContext.get().taskAttemptId()}", "w").close()
        yield from batches

    toxicity.fit(spark, spark.createDataFrame(docs.rdd.repartition(7), docs.schema).mapInArrow(noted, docs.schema), labels)
    assert len(list(tmp_path.iterdir())) > 1


def test_features_of_windows_end_with_their_row():
    m = toxicity.Model(known=None, tables=[[np.array([[0.0], [1.0], [5.0]], np.float32), np.array([[0.0], [10.0], [100.0]], np.float32)]], bias=[np.zeros(1, np.float32)], out=np.ones(1, np.float32))
    top, _ = m.features(np.array([1, 1, 2], np.int32), np.array([0, 2, 2, 3]))
    assert top.ravel().tolist() == [11.0, 0.0, 5.0]


def plain_forward(state, row):
    """Logit of one row of known tokens, window by window; what lies past the end is the neutral token."""
    k = len(toxicity.WIDTHS)
    emb, conv, bias, out, out_bias = state[0], state[1 : 1 + k], state[1 + k : 1 + 2 * k], state[-2], state[-1]
    top = []
    for width, c, b in zip(toxicity.WIDTHS, conv, bias, strict=True):
        for f in range(toxicity.FILTERS):
            best = b[f]
            values = [b[f] + sum(float(emb[row[i + j] if i + j < len(row) else 0] @ c[j][:, f]) for j in range(width)) for i in range(len(row))]
            top.append(max(0.0, *values) if values else max(0.0, best))
    return float(np.dot(top, out) + out_bias[0])


def small_network(seed=3):
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (9, toxicity.DIM)).astype(np.float32)
    emb[0] = 0
    conv = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    bias = [rng.normal(0, 0.3, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    out = rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32)
    rows = [rng.integers(0, 9, n).astype(np.int32) for n in (0, 1, 2, 3, 7, 12)]
    return [emb, *conv, *bias, out, np.array([0.2], np.float32)], rows


def test_scores_against_a_plain_forward_pass():
    state, rows = small_network()
    model = toxicity._assemble(state, np.arange(9), 0.0)
    got = model.score(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert got == pytest.approx([1 / (1 + math.exp(-plain_forward(state, r))) for r in rows], rel=1e-4)


def test_gradients_against_differences():
    state, rows = small_network()
    state = [p.astype(np.float64) for p in state]
    y, weight = np.array([0, 1, 1, 0, 1, 0], float), np.array([1, 2, 1, 1, 0.5, 1.0])

    def loss(s):
        z = np.array([plain_forward(s, r) for r in rows])
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / len(y))

    grads = toxicity._gradients(state, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), y, weight)
    rng = np.random.default_rng(1)
    for k, (p, g) in enumerate(zip(state, grads, strict=True)):
        for at in [np.unravel_index(i, p.shape) for i in rng.choice(p.size, min(6, p.size), replace=False)]:
            if k == 0 and at[0] == 0:
                continue  # the neutral token's row is held at nothing
            up, down = [q.copy() for q in state], [q.copy() for q in state]
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-3), (k, at)


def test_toxicity_of_repeated_ids_and_clashing_columns(spark):
    docs, labels = labelled(spark, 90)
    more = docs.union(docs.where("doc_id < 20")).union(docs.where("doc_id < 9").withColumn("text", F.lit("other text"))).selectExpr("*", "1 as score", "'x' as toxic", "2 as threshold", "3 as r")
    out, names = toxicity.scored(more, toxicity.fit(spark, more, labels))
    assert names == ["score_", "threshold_", "toxic_"] and out.columns == [*more.columns, *names]
    rows = out.collect()
    assert len(rows) == more.count() and all(r.score == 1 and r.toxic == "x" and r.toxic_ == (r.score_ >= r.threshold_) for r in rows)


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    passage = " ".join(f"p{i}" for i in range(60))
    extra = [(1000, passage, "en", "s", 0), (1001, passage, "en", "s", 0), (1002, f"{passage} q", "fr", "t", 0), (1003, "mail me at jane@example.org about " + " ".join(f"b{i}" for i in range(12)) + " and " + " ".join(f"c{i}" for i in range(40)), "en", "s", 0)]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert {1000, 1003} <= set(got) and not {1001, 1002, 602} & set(got)
    assert "b3" not in got[1003].text and "jane@" not in got[1003].text and "@example.org" in got[1003].text and "c39" in got[1003].text
    assert len(corpus_pipeline.STAGES) == 5
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, before, str(tmp_path)).columns == before.columns, name
    clean = {i for i in range(600) if i % 3}
    assert len(clean & set(got)) > 0.97 * len(clean)


def test_tree_lookups_walk_in_order():
    """Grams are kept by their reversed bytes, in which order their suffixes are sorted too; any order of questions gives the same."""
    import numpy as np

    from helmtrack.llm.suffix_tree_lm import Tree

    gram = np.array([0x61, 0x62, 0x6162, 0x6261, 0x6262, 0x616261, 0x626261], np.uint64)
    tree = Tree(2, np.array([0, 0, 1, 1, 1, 2, 2]), gram, np.array([6, 4, 3, 2, 1, 2, 5]))
    for k in (1, 2):
        keys, _, contexts, _ = tree.levels[k]
        assert np.all(keys[1:] > keys[:-1]) and np.array_equal(np.sort(keys.byteswap()), np.sort(gram[[2, 3, 4] if k == 1 else [5, 6]])) and len(contexts) == 2
    assert tree.holds(2, np.array([0x6162, 0x6161], np.uint64)).tolist() == [True, False]
    asked = np.array([0x616261, 0x636161, 0x626262, 0x616162, 0x636363], np.uint64)
    assert np.array_equal(tree.grams(asked)[::-1], tree.grams(asked[::-1]))
    root = 10.0 ** tree.root
    a_after_b = (2 + 2 * root[0x61]) / (3 + 2)
    assert np.isclose(10.0 ** tree.grams(asked)[0], (2 + a_after_b) / (2 + 1)) and np.isclose(10.0 ** tree.grams(asked)[2], (1 + 2 * root[0x62]) / 5 * (1 / 6))
