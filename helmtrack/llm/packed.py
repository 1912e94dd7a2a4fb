"""Texts packed for shuffling, with their exact copies counted.

The substring operators read every text several times, keyed by document.
``packed_documents`` shuffles the texts once, compressed, next to what is
known of their exact copies; all later passes use the same exchange, which
Spark reuses since the plan below it is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import joined_apart


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw, off = tx.buffers(batch.column(1))
        for i, j in tx.chunks(off):
            texts = [raw[a:b].tobytes() for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), pa.array(map(squeeze, texts), pa.binary())],
                names=["doc_id", "digest", "packed"],
            )


def packed_documents(source: DataFrame) -> DataFrame:
    """doc_id, packed, first, copies for (doc_id, text).

    ``copies`` counts the rows of the same text, ``first`` is the smallest
    doc_id among them.  A null doc_id has neither.
    """
    kind = source.schema["doc_id"].dataType.simpleString()
    packed = source.mapInArrow(_pack, f"doc_id {kind}, digest binary, packed binary")
    digest = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("digest")
    rows = source.select("doc_id", digest)
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    known = joined_apart(rows.distinct(), groups, "digest")  # a digest may be a third of all rows
    return packed.join(known, ["doc_id", "digest"], "left").select("doc_id", "packed", "first", "copies")


def unpacked(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of chunks of the packed texts."""
    expand = zstandard.ZstdDecompressor().decompress
    i, texts, size = 0, [], 0
    for j, z in enumerate(batch.column(column)):
        t = expand(z.as_py())
        if texts and size + len(t) > tx.CHUNK:
            yield i, j, *_joined(texts)
            i, texts, size = j, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield i, i + len(texts), *_joined(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
