"""Toxicity by a small convolutional text classifier in numpy.

Words (ASCII lower-cased, punctuation of both ends dropped) are hashed to
embedding rows.  Filters of widths 1, 2 and 3 slide over the words; each
filter's maximum over the document feeds a logistic output.  A filter of width
w is w tables of its products with the embeddings, so that scoring a word costs
a few look-ups and a document of any length is scored whole.

Training takes at most ``max_docs`` labelled rows (a documented bound; the rows
of smallest hash, half of them toxic as far as there are), one pass of Adam
steps after another in one task's memory.  Embedding rows are words of at least
``min_docs`` training documents; all others share one neutral row, so a rare
word cannot be memorised.  All weights start as noise.  The bias is then calibrated on
held-back training rows.  For decisions, thresholds are calibrated by language
where a language has enough held-back rows of both labels; scores never see
the language.

Defined cases: a null or empty text has no words and scores by the bias; rows
without a label are scored, not learned from; labels of unknown documents and
null labels are ignored; without labels of both kinds every score is the share
of toxic labels (0 without labels); of several texts of a labelled id one is
learned from; a null id counts as an empty one, so it is held out; repeated
rows give repeated results; other columns pass, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

MAX_DOCS, BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS = 6000, 1 << 15, 8, 8, (1, 2, 3), 12
#: Spread of the embeddings' random start, weight decay, and share of words dropped in training.
START, DECAY, DROPPED = 0.3, 1e-3, 0.3
#: A word counts if so many training rows have it; others share one vector.
MIN_DOCS = 3
#: What all clean rows together weigh against all toxic ones where a threshold is set: losing a clean document costs a third more than keeping a toxic one.
CLEAN = 4 / 3
#: A language's threshold stays within this of 0.5, since it is set on few rows.
SPREAD = 0.15
#: One in so many training rows is held back for calibration.
FOLDS = 5

_STRIP = tx.SPACE.copy()
_STRIP[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of a chunk, and each row's first word."""
    w = tx.words(data, off, _STRIP, lower=True)
    return (tx.word_hashes(w) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1, w.first


@dataclass
class Model:
    prior: float = 0.0
    known: np.ndarray | None = None
    tables: list[list[np.ndarray]] = field(default_factory=list)  # by width, by place
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of every filter by row, and where they are (for training)."""
        rows, n = len(first) - 1, len(tokens)
        found, places = [], []
        filled = np.flatnonzero(np.diff(first))
        for tables, bias in zip(self.tables, self.bias, strict=True):
            width = len(tables)
            value = tables[0][tokens] + bias
            for k in range(1, width):
                value[: n - k] += tables[k][tokens[k:]]
            if width > 1:  # a window may not reach into the next row; what lies past the end counts as neutral
                for k in range(1, width):
                    last = first[1:][np.diff(first) >= k] - k
                    tail = tables[0][tokens[last]] + bias
                    for j in range(1, k):
                        tail = tail + tables[j][tokens[last + j]]
                    for j in range(k, width):
                        tail = tail + tables[j][0]
                    value[last] = tail
            top = np.tile(np.maximum(bias, 0.0), (rows, 1)).astype(np.float32)
            if len(filled):
                top[filled] = np.maximum(np.maximum.reduceat(value, first[filled], axis=0), 0.0)
            found.append(top)
            places.append(value)
        return np.concatenate(found, axis=1), places

    def score(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.out is None:
            return np.full(len(first) - 1, self.prior)
        tokens = self.known[tokens]
        out = np.empty(len(first) - 1)
        step = 0
        while step < len(first) - 1:  # in runs of rows, to bound memory
            to = max(step + 1, int(np.searchsorted(first, first[step] + 200_000, side="right")) - 1)
            f, _ = self.features(tokens[first[step] : first[to]], first[step : to + 1] - first[step])
            out[step:to] = f @ self.out + self.out_bias
            step = to
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _train(tokens: list[np.ndarray], labels: np.ndarray, seed: int = 5, min_docs: int = MIN_DOCS) -> Model:
    """Adam on the logistic loss; maxima pass their gradient to one window each."""
    rng = np.random.default_rng(seed)
    n, toxic = len(labels), labels.astype(np.float64)
    seen = [np.unique(t) for t in tokens]
    docs = np.zeros(BUCKETS)
    for s in seen:
        docs[s] += 1
    keep = np.flatnonzero(docs >= min_docs)
    known = np.zeros(BUCKETS, np.int32)
    known[keep] = np.arange(1, len(keep) + 1)
    rate = toxic.mean()
    emb = rng.normal(0, START, (len(keep) + 1, DIM)).astype(np.float32)
    emb[0] = 0
    conv = [rng.normal(0, (2.0 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, (1.0 / (FILTERS * len(WIDTHS))) ** 0.5, FILTERS * len(WIDTHS)).astype(np.float32)
    state = [emb, *conv, *bias, out, np.zeros(1, np.float32)]
    first_moment, second_moment = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    known_tokens = [known[t] for t in tokens]
    step, batch = 0, 64
    weight = np.where(toxic > 0, 0.5 / max(rate, 1e-6), 0.5 / max(1 - rate, 1e-6))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            first = np.concatenate([[0], np.cumsum([len(known_tokens[r]) for r in rows])])
            t = np.concatenate([known_tokens[r] for r in rows]) if first[-1] else np.zeros(0, np.int32)
            if len(t):
                t = np.where(rng.random(len(t)) < DROPPED, 0, t)  # word dropout
            grads = _gradients(state, t, first, toxic[rows], weight[rows])
            step += 1
            for p, g, a, b in zip(state, grads, first_moment, second_moment, strict=True):
                g = g + DECAY * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            emb[0] = 0
    return _assemble(state, known, rate)


def _assemble(state: list[np.ndarray], known: np.ndarray, prior: float) -> Model:
    k = len(WIDTHS)
    emb, conv, bias = state[0], state[1 : 1 + k], state[1 + k : 1 + 2 * k]
    return Model(prior, known, [[(emb @ c[i]).astype(np.float32) for i in range(len(c))] for c in conv], [b.copy() for b in bias], state[-2].copy(), float(state[-1][0]))


def _gradients(state: list[np.ndarray], t: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    k = len(WIDTHS)
    emb, conv, bias, out, out_bias = state[0], state[1 : 1 + k], state[1 + k : 1 + 2 * k], state[-2], state[-1]
    model = _assemble(state, None, 0.0)
    top, values = model.features(t, first)
    z = top @ out + out_bias[0]
    err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
    grads = [np.zeros_like(p) for p in state]
    grads[-1][0] = err.sum()
    grads[-2][:] = top.T @ err
    back = np.outer(err, out).astype(np.float32)
    back[top <= 0] = 0
    for i, value in enumerate(values):
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        for r in np.flatnonzero(np.any(part != 0, axis=1)):
            a, b = first[r], first[r + 1]
            g = part[r]
            grads[1 + k + i] += g
            if a == b:
                continue
            at = a + value[a:b].argmax(axis=0)
            for j in range(WIDTHS[i]):
                tok = np.where(at + j < b, t[np.minimum(at + j, b - 1)], 0)
                grads[1 + i][j] += (emb[tok] * g[:, None]).T
                np.add.at(grads[0], tok, (conv[i][j] * g).T)
    return grads


def _calibrate(model: Model, tokens: list[np.ndarray], labels: np.ndarray, langs: list[str | None], clean: float = CLEAN, spread: float = SPREAD) -> Model:
    """Moves the bias so that 0.5 splits held-back rows best, then sets thresholds by language."""
    score = _scores(model, tokens)
    z = np.log(score / (1 - score))
    cut = _best_cut(z, labels, clean)
    model.out_bias -= cut
    lang = np.array([x or "" for x in langs])
    for x in np.unique(lang):
        mine = lang == x
        if 10 <= labels[mine].sum() <= mine.sum() - 10:
            best = 1 / (1 + np.exp(-_best_cut((z - cut)[mine], labels[mine], clean)))
            model.thresholds[str(x)] = float(np.clip(best, 0.5 - spread, 0.5 + spread))
    return model


def _scores(model: Model, tokens: list[np.ndarray]) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return np.clip(model.score(np.concatenate([np.zeros(0, np.int32), *tokens]), first), 1e-9, 1 - 1e-9)


def _best_cut(z: np.ndarray, y: np.ndarray, weight: float = CLEAN) -> float:
    """The cut with the most right answers, the clean rows weighing ``weight`` times the toxic ones; the middle of the widest such gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    clean, toxic = weight * (y == 0) / max(1, (y == 0).sum()), (y == 1) / max(1, (y == 1).sum())
    right = np.concatenate([[0], np.cumsum(clean)]) + np.concatenate([np.cumsum(toxic[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    gap = edges[best + 1] - edges[best]
    at = best[gap.argmax()]
    return float((edges[at] + edges[at + 1]) / 2)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, min_docs: int = MIN_DOCS, clean: float = CLEAN, spread: float = SPREAD) -> Model:
    """Trains on a bounded sample of labelled rows, drawn by hash, half of them toxic as far as there are.

    ``min_docs`` rows must have a word for it to count; ``clean`` weighs clean
    rows against toxic ones where thresholds are set, which stay within
    ``spread`` of 0.5.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ranked = known.withColumn("r", F.xxhash64("doc_id"))
    half = ranked.where("toxic = 1").orderBy("r").limit(max_docs // 2).union(ranked.where("toxic = 0").orderBy("r").limit(max_docs // 2))
    sample = F.broadcast(half.select("doc_id", "toxic", "r"))  # at most max_docs rows of three numbers
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    joined = docs.select("doc_id", "text", lang.alias("lang")).join(sample, "doc_id")
    # one text of an id: of several, that of the smallest hash, by a partial minimum
    joined = joined.groupBy("doc_id", "toxic", "r").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("d")).select("d.*", "toxic", "r")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.buffers(batch.column(0))
            t, first = word_buckets(raw, off)
            yield pa.RecordBatch.from_arrays([pa.array([t[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), *(batch.column(i) for i in (1, 2, 3))], names=["tokens", "lang", "toxic", "r"])

    rows = joined.select("text", "lang", "toxic", "r").mapInArrow(tokens, "tokens binary, lang string, toxic int, r bigint")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b.to_pandas() for b in batches]
        model = fit_rows(pd.concat(tables) if tables else pd.DataFrame({"tokens": [], "lang": [], "toxic": [], "r": []}), min_docs=min_docs, clean=clean, spread=spread)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # an exchange of the sample's rows, so that the documents above it are read in parallel
    return pickle.loads(rows.repartition(1).mapInArrow(train, "model binary").first()[0])


def fit_rows(rows: pd.DataFrame, *, min_docs: int = MIN_DOCS, clean: float = CLEAN, spread: float = SPREAD) -> Model:
    rows = rows.sort_values(["r", "toxic"])
    y = rows["toxic"].to_numpy(np.int64)
    tokens = [np.frombuffer(t, np.int32) for t in rows["tokens"]]
    if len(y) == 0 or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.0)
    back = np.zeros(len(y), bool)
    for label in (0, 1):
        back[np.flatnonzero(y == label)[::FOLDS]] = True
    if y[~back].min() == y[~back].max():
        return Model(float(y.mean()))
    model = _train([t for t, b in zip(tokens, back, strict=True) if not b], y[~back], min_docs=min_docs)
    return _calibrate(model, [t for t, b in zip(tokens, back, strict=True) if b], y[back], [x for x, b in zip(rows["lang"], back, strict=True) if b], clean, spread)


def _scores_of(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, pa.Array]]:
    raw, off = tx.buffers(texts)
    for i, j in tx.chunks(off):
        t, first = word_buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, pa.array(model.score(t, first).astype(np.float64))


def scored(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[str]]:
    """All rows and columns, and three more: score, the threshold of the row's language, and whether the score reaches it.

    The names of the three are returned too, since they avoid those of
    ``docs``.  The language chooses the threshold only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of tables of fixed size
    schema, (name,) = tx.with_columns(docs, score="double")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in _scores_of(batch.column(place), shared.value):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, found], names=schema.names)

    out = docs.mapInArrow(run, schema)
    levels = F.create_map(*[x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))]) if model.thresholds and lang in docs.columns else None
    level = F.lit(0.5) if levels is None else F.coalesce(F.try_element_at(levels, F.coalesce(F.col(lang), F.lit(""))), F.lit(0.5))
    _, (threshold, toxic) = tx.with_columns(out, threshold="double", toxic="boolean")
    return out.withColumn(threshold, level).withColumn(toxic, F.col(name) >= level), [name, threshold, toxic]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: learned from the rows that are not held out, scored for all; ``toxic`` is the verdict by the language's threshold."""
    docs = tx.table(spark, sf_dir, "documents")
    labels = tx.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    out, _ = scored(docs.select("doc_id", "text", "lang"), fit(spark, docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that reach their language's threshold leave."""
    labels = tx.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    out, (_, _, toxic) = scored(docs, fit(spark, docs, labels))
    return out.where(~F.col(toxic)).select(*docs.columns)
