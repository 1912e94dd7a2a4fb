"""Small documents with every odd case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, other alphabets, one long text."""
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = sentence(rng, 60, 5000)
    out: list[str | None] = [None, "", "  \n\t ", "one", "One", "two words", *base]
    out += [base[0], base[0], base[1].upper()]
    out += [f"{base[k]} tail{k}" for k in range(4)]
    out += [f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}" for _ in range(4)]
    out += [f"{passage} x {passage}", "a" * 300, "ab" * 200, "é ü 漢字   x y " * 12]
    chain = base[5].split()
    out += [" ".join([*chain[:-k], *[f"n{i}" for i in range(k)]]) for k in (1, 3, 5, 7)]
    out += [sentence(rng, 20000)]
    return out


@pytest.fixture(scope="session", autouse=True)
def no_waiting():
    """Small tables leave little on disk; collecting it takes longer than the tests."""
    from helmtrack.llm.shared import Scratch

    before, Scratch.release = Scratch.release, lambda self: None
    yield
    Scratch.release = before


@pytest.fixture(scope="session")
def odd():
    return list(enumerate(odd_texts()))


@pytest.fixture(scope="session")
def docs(spark, odd):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("hot", "hot", "b", None)[i % 4], len(t or "")) for i, t in odd]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A data folder of these documents, an empty one beside it."""
    at = str(tmp_path_factory.mktemp("data"))
    docs.write.parquet(f"{at}/documents.parquet")
    return at
