"""WARC archives, BPE, decontamination and quality rules against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmtrack.llm import bpe, decontaminate, quality, warc

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/ b\n", "x" * 200), (3, "http://c", "x" * 200), (9, None, "x" * 200), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "é漢", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (8, "u", "y" * 300000), (3, "http://c", "x" * 200), (None, "u", "x" * 200)]
    return spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).repartition(3)


def test_archives_read_back(spark, pages):
    found = warc.archives(pages, archive_bytes=1000)
    assert found.count() > 1
    out = warc.read_records(warc.normalise(found, part_bytes=300)).select(warc.page_of("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("to"), "payload").collect()
    got = sorted(((r.id if r.id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.to) for r in out), key=str)
    x = (200, sha(b"x" * 200))
    special = ("é" * 60 + "\r\n\r\nWARC/1.1\r\n").encode()
    want = [(5, *x, "revisit", 3), (3, *x, "response", None), (9, *x, "revisit", 3), (1, 0, sha(b""), "response", None), (2, 0, sha(b""), "response", None), (4, 5, sha(b"short"), "response", None), (6, 5, sha(b"short"), "response", None), (7, len(special), sha(special), "response", None), (8, 300000, sha(b"y" * 300000), "response", None), (3, *x, "response", None), (-1, *x, "response", None)]
    assert got == sorted(want, key=str)
    assert {r.id: bytes(r.payload) for r in out if r.id == 7} == {7: special}


def test_normalised_archive_is_one_member_a_record(pages):
    found = warc.archives(pages.coalesce(1)).collect()
    for row in found:
        parts = warc.normalise(pages.sparkSession.createDataFrame([row], warc.ARCHIVE), part_bytes=2000).orderBy("part").collect()
        joined = b"".join(bytes(p.content) for p in parts)
        assert gzip.decompress(joined) == gzip.decompress(bytes(row.content))
        for p in parts:
            assert p.start == sum(len(q.content) for q in parts if q.part < p.part)
            for e in p.entries:
                raw = gzip.decompress(joined[e.offset : e.offset + e.length])
                assert raw.startswith(b"WARC/1.1\r\n") and e.record_id.encode() in raw


def test_foreign_archives(spark):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for content in (record * 2, gzip.compress(record * 2), gzip.compress(record) + gzip.compress(record)):
        a = spark.createDataFrame([("p", bytearray(content))], warc.ARCHIVE)
        assert [r.payload_bytes for r in warc.read_records(warc.normalise(a)).collect()] == [3, 3]
        assert [r.offset > 0 for r in warc.index(warc.normalise(a)).orderBy("offset").collect()] == [False, True]
    for broken in (record[:-6], gzip.compress(record)[:-9], b"HTTP/1.1 200 OK\r\n\r\n"):
        a = spark.createDataFrame([("p", bytearray(broken))], warc.ARCHIVE)
        with pytest.raises(Exception, match="p: "):
            warc.normalise(a).collect()
    assert warc.archives(spark.createDataFrame([], PAGES)).count() == 0


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, odd, reference_tokenizer):
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    for i, t in odd:
        ids = reference_tokenizer.encode_ordinary(t or "")
        r = got[i]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(b"".join(x.to_bytes(4, "little") for x in ids))
        assert r.decoded == (t or "") and r.decoded_sha256 == sha((t or "").encode())


def test_bpe_on_odd_characters(reference_tokenizer):
    at, pattern = bpe.default_vocabulary()
    encoder, decoder = bpe.coder(at, pattern)
    samples = ["²³¹¼½¾", "\x1c\x1d\x1e\x1f x", "_a_ __", "don't WE'LL ' s", "１２３ ⅷ", "àé", "­​﻿", "🙂🙂 👩‍👩‍👧", "  \n \t x  ", "x\u0085y z", "ªº", "<|endoftext|>", "".join(map(chr, range(0x250))), string.printable * 3, "퟿", "ǅ ʰ ˢ", "e" * 5000]
    for s in samples:
        ids = encoder.encode(s)
        assert ids.tolist() == reference_tokenizer.encode_ordinary(s), s
        assert b"".join(decoder.stream(ids)) == s.encode() == b"".join(decoder.stream(ids, 1))
        for whole in decoder.stream(ids, 1):
            whole.decode()  # every piece ends between characters


def test_classes_of_every_character(reference_tokenizer):
    """Pre-tokens of each character between letters, digits and signs are the library's, whatever Unicode the regex module knows."""
    import tiktoken

    encoder, _ = bpe.coder(*bpe.default_vocabulary())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for name, probe in (("letters", r"\p{L}"), ("numbers", r"\p{N}"), ("blanks", r"\s")):
        library = tiktoken.Encoding("probe", pat_str=probe, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        want = set(bytes(library.encode_ordinary("".join(every))).decode())
        before = {"letters": "a", "numbers": "1", "blanks": "\n"}[name]
        joins = {c for c in every if len(encoder.split(before + c + before)) == 1}
        assert joins - {"'"} == want - {" "} if name == "letters" else joins - {" "} == want - {" "}, name


def test_newer_characters(reference_tokenizer):
    encoder, decoder = bpe.coder(*bpe.default_vocabulary())
    newer = [chr(c) for a, b in bpe.NEWER for c in {a, b}]
    for c in newer:
        for s in (c, f"a{c}b", f"\ub638{c}\ub638", f"{c}\ub638", f" {c} 1{c}2", c * 3):
            ids = encoder.encode(s)
            assert ids.tolist() == reference_tokenizer.encode_ordinary(s), s
            assert b"".join(decoder.stream(ids)) == s.encode()


def test_the_stage_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 6), (1, "a b", 7), (1, "a b", 7)], "doc_id bigint, text string, ids int")
    out = bpe.stage(spark, df, "").collect()
    assert sorted((str(r.text), r.ids, r.n_tokens) for r in out) == [("", 6, 0), ("None", 5, 0), ("a b", 7, 2), ("a b", 7, 2)]
    assert bpe.stage(spark, df.limit(0), "").count() == 0


def test_the_decoder_on_bytes_that_are_no_utf8():
    _, decoder = bpe.coder(*bpe.default_vocabulary())
    one = {raw: i for i, raw in enumerate(decoder.text) if raw is not None and len(raw) == 1}
    rng = random.Random(4)
    pool = [0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xE0, 0xE1, 0xED, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(300):
        raw = bytes(rng.choice(pool) for _ in range(rng.randrange(12)))
        ids = np.array([one[bytes([b])] for b in raw], np.int64)
        assert "".join(piece.decode("utf-8", "replace") for piece in decoder.stream(ids, 1)) == raw.decode("utf-8", "replace")
        assert b"".join(decoder.stream(ids, 5)) == raw


def test_generations_keep_results(reference_tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STEPS", 50)
    at, pattern = bpe.default_vocabulary()
    encoder = bpe.Encoder(bpe.read_ranks(at), pattern)
    encoder.seen.most = encoder.pairs.most = 20
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéö漢") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    for _ in range(30):
        s = " ".join(rng.choice(words) for _ in range(40))
        assert encoder.encode(s).tolist() == reference_tokenizer.encode_ordinary(s)
    assert len(encoder.seen) <= 20 and encoder.states.steps < 50 + 400


def test_bpe_of_an_empty_table(docs):
    assert bpe.encode_decode(docs.limit(0)).count() == 0


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_contamination(rows, items, window):
    wins = []
    for name, t in items:
        w = ITEM_WORD.findall(lower(t))
        wins.append((str(name), {tuple(w[i : i + window]) for i in range(len(w) - window + 1)} if len(w) >= window else ({tuple(w)} if w else set())))
    out = {}
    for d, t in rows:
        w = ITEM_WORD.findall(lower(t))
        hit, names = set(), set()
        for name, found in wins:
            for n in {len(x) for x in found}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in found:
                        hit.update(range(i, i + n))
                        names.add(name)
        out[d] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize(("block", "group"), [(1 << 20, 4), (300, 8), (300, 2), (1, 1)])
def test_contamination(spark, docs, odd, block, group):
    texts = dict(odd)
    items = [(1, " ".join((texts[6] or "").split()[3:18])), (2, "Two, WORDS!"), (3, None), (4, "?!"), (5, texts[8]), (10, texts[8]), (7, "漢字 x"), (8, "a " * 12), (9, " ".join((texts[9] or "").split()[:9]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.decontaminate(spark, docs, bench, block_bytes=block, group=group).collect()
    want = plain_contamination(odd, items, 10)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found} == want
    assert any(v[1] for v in want.values())
    for r in found:
        left = ITEM_WORD.findall(lower(r.clean_text))
        assert len(left) == r.n_words - r.n_hit
    assert decontaminate.decontaminate(spark, docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(spark, docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, docs, odd):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in odd:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), i
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_quality_of_lines(spark):
    rows = [(i, f"Notice 20{10 + i}: all rights   reserved by us\n" + (" ".join(f"t{i}x{j}" for j in range(40)) if i % 5 else "tiny " + " ".join(f"u{i}{j}" for j in range(2))), "h" if i < 30 else "other") for i in range(40)]
    rows.append((99, "#\n#\n*a|b\n\n  \n" + " ".join(f"z{j}" for j in range(30)), None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("line", F.lit(1)).withColumn("host", F.lit("x"))
    got = {r.doc_id: r for r in quality.quality_rules(docs, keep=0.5).collect()}
    assert got[1].n_boilerplate_words == 7 and got[1].kept  # digits and blanks don't matter
    assert got[5].n_boilerplate_words == 7 and not got[5].kept
    assert got[31].n_boilerplate_words == 7  # ten of the other host's have it
    assert got[99].n_symbols == 4 and got[99].n_dup_lines == 1 and got[99].kept


def test_quality_of_repeated_rows_and_null_ids(spark, tmp_path):
    """Against the SQL, which numbers the rows."""
    import duckdb

    from helmtrack.llm.sql import QUALITY

    body = lambda i: " ".join(f"t{i}x{j}" for j in range(20))
    rows = [(i, f"Shared line {i} here\n{body(i)}", "h") for i in range(12)]
    rows += [rows[3]] * 2 + [(None, rows[3][1], "h")] * 2 + [(None, f"shared LINE 7 here\n{body('n')}", "h")]
    rows += [(50 + k, f"copied text {body('c')}\nshared line 1 here", "copies") for k in range(30)] + [(50, "another text of this id " + body("d"), "copies"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.quality(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({QUALITY})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {r.n_boilerplate_words for r in got.where("doc_id = 3").collect()} == {24}  # digits count alike


def test_texts_without_boilerplate_lines(spark):
    rows = [(i, f"\nAll  Rights {i}\nown é text {'abcdefghijkl'[i]}\n\nall rights 1") for i in range(12)] + [(20, "no line of it"), (21, None), (21, "ALL rights 5"), (None, "x\nall rights 3\ny")]
    docs = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id bigint, text string, source string, row int")
    got = {(r.doc_id, r.clean_text) for r in quality.quality_rules(docs, texts=True).collect()}
    # digits count alike, but "rights 10" and "rights 11" have two of them
    assert got == {(i, f"\nown é text {'abcdefghijkl'[i]}\n") if i < 10 else (i, f"\nAll  Rights {i}\nown é text {'abcdefghijkl'[i]}\n") for i in range(12)} | {(20, "no line of it"), (21, None), (21, ""), (None, "x\ny")}


def test_items_without_an_id_and_items_of_one_id(spark, tmp_path):
    """Against the SQL: null ids hit, and a short item's length is its own, not that of its id's first text."""
    import duckdb

    from helmtrack.llm.sql import CONTAMINATION

    long = " ".join(f"l{i}" for i in range(14))
    items = [(None, " ".join(f"n{i}" for i in range(12))), (None, "null short"), (1, long), (1, "few words"), (2, None), (3, "few words")]
    texts = [items[0][1], f"x {items[0][1]} {long} y", "a null short b", "has few words here", "nothing", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_hit, n_items, items_sha256, contaminated FROM ({CONTAMINATION})").fetchall()
    got = decontaminate.contamination(spark, str(tmp_path)).select("doc_id", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[0]: r[1] for r in want} == {0: 12, 1: 26, 2: 2, 3: 2, 4: 0, 5: 0}
