"""Periodic runs of words by Lyndon arrays, with extensions that are matched once.

A run is a longest stretch of words with a period, here of at least ``least``
words and ``times`` periods.  The Lyndon word that starts at a place reaches to
the next place whose suffix is smaller; every run has such a word of its
period's length among its first places, for the order of words or for the
inverse one.  So runs are read off the next-smaller-suffix edges of both
orders, if the extension to the right of each edge is known.

The edges come from one scan with a stack of previous smaller suffixes.  A
suffix is compared with the stack from its top on, and needs no look at words
that were matched before:

* the extension of the next stack entry is the smaller of two known ones where
  these differ, and at least their common value where they don't;
* the farthest match so far, of places ``d`` apart, mirrors later edges inside
  it: the extension of an edge ``d`` places back is copied if it ends inside,
  and goes on from the farthest matched word if not.

Words are compared only where that moves the farthest matched word, so a scan
takes linear time over any ordered alphabet.  Words are numbered by one
comparison sort of a batch; there is no suffix array or tree, and no hash of
words or of text stands for another.

A run cannot cross a word sequence of its text that comes only once, so texts
are first cut at these: equal neighbours of sorted sequences of 1, 2, 4 and 8
words.  What is left is scanned; the cut is exact, because all sequences of up
to 8 words inside a run of 24 words and three periods come again in it.

Every document is worked on by itself, in the task that reads it: there is no
exchange, and memory is bounded by a batch and its longest document.

Defined cases: a null or empty text has no words and no run; a null id gets no
planted period; rows of one id are judged each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Shortest run in words, and in periods.
LEAST, TIMES = 24, 3


def next_smaller(t: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one whose suffix is smaller, and how many words the two suffixes share.

    The end of the text is smaller than all words.  ``far`` is the farthest
    matched word, found at place ``at`` from the place ``back`` before it.
    """
    n = len(t)
    smaller, share = [n] * n, [0] * n  # edges to the next smaller suffix
    before, reach = [-1] * n, [0] * n  # edges to the previous smaller one
    far = at = back = 0
    for r in range(1, n):
        left, v, known = r - 1, 0, -1  # known: the extension of the entry above, with r
        while left >= 0:
            if known >= 0 and reach[above] != known:
                v = known if known < reach[above] else reach[above]
            else:
                v = known if known > 0 else 0
                stop = True
                if at <= left and r < far:
                    a, b = left - back, r - back
                    m = share[a] if smaller[a] == b else reach[b] if before[b] == a else -1
                    if m >= 0:
                        if m < far - r:
                            v, stop = m, False
                        else:
                            v = far - r
                if stop:
                    while r + v < n and t[left + v] == t[r + v]:
                        v += 1
                    if r + v > far:
                        far, at, back = r + v, r, r - left
            if r + v < n and t[left + v] < t[r + v]:
                before[r], reach[r] = left, v
                break
            smaller[left], share[left] = r, v
            known, above = v, left
            left = before[left]
    return smaller, share


def runs_of(t: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs with at least ``least`` words and ``times`` periods."""
    found = set()
    n = len(t)
    if n < least:
        return []
    for order in (t, [-x for x in t]):
        smaller, share = next_smaller(order)
        for i in range(n):
            j = smaller[i]
            p = j - i
            # a run of three periods has a root in its first period, which the text follows for a period more at least
            if share[i] < p * (times - 2) or j == n or (i >= p and smaller[i - p] == i and share[i - p] >= p):
                continue
            start = i
            while start > 0 and t[start - 1] == t[start - 1 + p]:
                start -= 1
            length = j + share[i] - start
            if length >= least and length >= times * p:
                found.add((start, length, p))
    return sorted((s, n_, p) for s, n_, p in found)


def _again(doc: np.ndarray, code: np.ndarray, least: int) -> np.ndarray:
    """Marks codes that their document has at least ``least`` times."""
    order = np.lexsort((code, doc))
    d, c = doc[order], code[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(d)))
    out = np.zeros(len(d), bool)
    out[order] = np.repeat(count >= least, count)
    return out


def _numbered(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs of codes within documents, by sorting."""
    order = np.lexsort((b, a, doc))
    x, y, d = a[order], b[order], doc[order]
    new = np.ones(len(d), np.int64)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    out = np.empty(len(d), np.int64)
    out[order] = np.cumsum(new)
    return out


def _stretches(inside: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the stretches of marked neighbours in a document."""
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    end = np.flatnonzero(last) + 1
    long = end - first >= least
    return first[long], end[long]


def repetitive(doc: np.ndarray, code: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the stretches that can hold a run: all their sequences of up to 8 words come again in the document.

    A sequence of k words comes again inside a run if the run has at least
    2 periods and k - 1 words.
    """
    widths = [k for k in (1, 2, 4, 8) if k <= least // times + 1]
    place = np.arange(len(code))
    size, names = 1, code
    for k in widths:
        if k > 1:
            # sequences of k words begin where one of k / 2 words is, and another one half on
            pos = np.full(len(code), -1, np.int64)
            pos[place] = np.arange(len(place))
            half = place + size
            ok = half < len(code)
            ok[ok] = (pos[half[ok]] >= 0) & (doc[half[ok]] == doc[place[ok]])
            place, names = place[ok], _numbered(doc[place[ok]], names[ok], names[pos[half[ok]]])
            size = k
        again = _again(doc[place], names, times if k == 1 else 2)
        place, names = place[again], names[again]
        begins = np.zeros(len(code), bool)
        begins[place] = True
        first, end = _stretches(begins, doc, least - k + 1)
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, end, -1)
        use = np.cumsum(inside)[place] > 0
        place, names = place[use], names[use]
    return first, end + size - 1


def planted(ids: list[int | None], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word at each place after planting periods by the ids' checksums, and the documents that were changed.

    A document whose checksum h is a multiple of 10 repeats, from word
    (h / 10) mod n on, what its next words say, some three to ten times.
    """
    order = np.arange(first[-1])
    changed = np.zeros(len(ids), bool)
    for r, d in enumerate(ids):
        n = int(first[r + 1] - first[r])
        if d is None or not n:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[first[r] + a : first[r + 1]] = first[r] + a + np.arange(n - a) % p
        changed[r] = True
    return order, changed


def spaced(w: tx.Words, order: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words in this order, a space after each, and where each document's begin; ``first`` counts words."""
    size = (w.end - w.start)[order] + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) + np.repeat(w.start[order] - begin[:-1], size)
    out = np.append(w.data, np.uint8(0x20))[at]
    out[begin[1:] - 1] = 0x20
    return out.tobytes(), begin[first]


def _ranks(w: tx.Words) -> np.ndarray:
    """Numbers of the words in byte order, equal for equal words."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    raw = w.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
    names = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
    return pc.rank(names, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


_FIELDS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli"]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _chunk(ids: list, data: np.ndarray, off: np.ndarray, least: int, times: int, plant: bool) -> list[pa.Array]:
    n = len(ids)
    w = tx.words(data, off, tx.SPACE)
    order = planted(ids, w.first)[0] if plant else np.arange(len(w.start))
    code = _ranks(w)[order] if len(order) else order
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    gone = np.zeros(len(order) + 1, np.int64)
    first, end = repetitive(w.doc, code, least, times) if len(order) else (order, order)
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        r = int(w.doc[a])
        for start, length, period in runs_of(code[a:b].tolist(), least, times):
            found[r].append((a - int(w.first[r]) + start, length, period))
            gone[a + start + period] += 1
            gone[a + start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[w.first]
    joined, at = spaced(w, order[kept], left)
    texts = [joined[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    rows = []
    for r, own in enumerate(found):
        own.sort(key=lambda x: (x[0], x[2]))
        best = None
        for x in own:  # in order of start and period: only a greater exponent takes over
            if best is None or x[1] * best[2] > best[1] * x[2]:
                best = x
        s, m, p = best or (None, None, None)
        rows.append((int(w.first[r + 1] - w.first[r]), len(own), s, m, p, 1000 * m // p if best else None))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    listed = ["".join(f"{s},{m},{p}\n" for s, m, p in own).encode() for own in found]
    return [
        *[pa.array(c, pa.int64()) for c in columns],
        pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in own] for own in found], _RUNS),
        pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
        pa.array([x.decode() for x in texts], pa.string()),
        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
    ]


def _run(least: int, times: int, plant: bool, columns: list[str]):
    names = [*_FIELDS, "runs", "runs_sha256", "collapsed", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.buffers(batch.column(1))
            for i, j in tx.chunks(off):
                ids = batch.column(0).slice(i, j - i)
                made = dict(zip(names, _chunk(ids.to_pylist(), raw[off[i] : off[j]], off[i : j + 1] - off[i], least, times, plant), strict=True))
                yield pa.RecordBatch.from_arrays([ids, *[made[c] for c in columns]], names=["doc_id", *columns])

    return run


_KINDS = {**dict.fromkeys(_FIELDS, "bigint"), "runs": "array<struct<start: bigint, length: bigint, period: bigint>>", "runs_sha256": "string", "collapsed": "string", "collapsed_sha256": "string"}


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, plant: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A row per document with its runs, the run of the greatest exponent, and the text without repeated periods.

    ``plant`` first writes periods into some documents, by the checksum of
    their ids, as the query's contract has it.
    """
    if times < 3 or least < 1:
        raise ValueError("runs have at least three periods and one word")
    columns = columns or list(_KINDS)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_run(least, times, plant, columns), ", ".join([f"doc_id {kind}", *[f"{c} {_KINDS[c]}" for c in columns]]))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13."""
    return periodic_runs(tx.table(spark, sf_dir, "documents"), plant=True, columns=[*_FIELDS, "runs_sha256", "collapsed_sha256"])


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_concat([xor(h, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"

RUNS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT *, len(w) AS n, {_CRC} AS h FROM d),
g AS (SELECT *, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 AS k FROM h),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END + 1]) ELSE w END AS w FROM g),
s AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 8], ' ')) AS x FROM (SELECT r, w, unnest(range(greatest(0, n - 7))) AS i FROM t)),
e AS (SELECT a.r, a.i, b.i - a.i AS q FROM s a JOIN s b ON a.r = b.r AND a.x = b.x AND a.i < b.i),
m AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 8 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM e) GROUP BY r, q, isle),
c AS (SELECT * FROM m WHERE length >= {LEAST} AND length >= {TIMES} * q),
f AS (SELECT r, start, length, q FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.r = c.r AND o.q < c.q AND o.start <= c.start AND o.start + o.length >= c.start + c.length)),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, start, q) AS place FROM f),
l AS (SELECT r, count(*)::BIGINT AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM f GROUP BY r),
z AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM f),
v AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS x FROM t),
k AS (SELECT v.r, string_agg(x, ' ' ORDER BY v.i) AS kept FROM v ANTI JOIN z ON z.r = v.r AND z.i = v.i GROUP BY v.r)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN l USING (r) LEFT JOIN (SELECT * FROM b WHERE place = 1) b USING (r) LEFT JOIN k USING (r)"""
