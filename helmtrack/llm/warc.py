"""WARC archives: writing, normalising of monolithic gzip streams, reading back.

An archive may be one gzip stream over all of its records, of which nothing can
be read without inflating everything before it.  The normaliser inflates such a
stream once, in pieces of bounded size, rewrites every record as a gzip member
of its own and notes where it lies.  Records can then be read singly, by the
offset index.

Archives are rows (path, content), as Spark's ``binaryFile`` reader gives them;
normalised archives are rows (path, part, start, content, entries), whose parts
joined in order are the file, and whose entries are its index.  ``index`` is
the index as a sidecar table.  As tables they live in any store that Spark can
write to, and a lost executor repeats its own tasks only.

Of records with an equal payload of at least ``least`` bytes, that of the
smallest page id is a response, all others are revisits without payload that
refer to it.  Equal payloads are found by digest on rows without payload; a hot
digest is a partial minimum and a join that Spark can split.

Defined cases: a null payload is an empty one; a null url is left out; a null
id is a record without a number, which is always a response and is never
referred to; repeated rows of the smallest id are each a response; a record
larger than an archive is an archive of its own; a stream that ends within a
record, or that is no WARC, raises ValueError with its path; an empty table
gives no archives.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch

#: Payloads shorter than this are never revisits.
LEAST = 100
#: Bytes of records in an archive that is written, and of members in a part of a normalised one.
ARCHIVE_BYTES, PART_BYTES = 16 << 20, 8 << 20
#: Bytes of a compressed stream that are inflated at a time.
STEP = 1 << 18
#: Every record's date; an archive is the same whenever it is written.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3

ARCHIVE = "path string, content binary"
ENTRY = "offset bigint, length bigint, record_id string, record_type string, target_uri string, payload_digest string, refers_to string"
NORMALISED = f"path string, part int, start bigint, content binary, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Record:
    """Header fields by lower-case name, and the block."""

    headers: dict[str, str]
    block: bytes = b""
    raw: bytes = field(default=b"", repr=False)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, where it has one."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A header value: blanks and controls are percent-encoded, so it is one line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of another response."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        block = http + b"\r\n"
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(content: memoryview, step: int = STEP) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or many members, or of a plain one."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for a in range(0, len(content), step):
            yield bytes(content[a : a + step])
        return
    stream = zlib.decompressobj(31)
    for a in range(0, len(content), step):
        data = bytes(content[a : a + step])
        while data:
            if stream.eof:
                stream = zlib.decompressobj(31)
            out = stream.decompress(data, 8 * step)
            data = stream.unused_data if stream.eof else stream.unconsumed_tail
            if out:
                yield out
    if not stream.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of a stream; holds one record and one piece at a time."""
    held = bytearray()
    more = iter(pieces)

    def grow() -> bool:
        piece = next(more, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while held or grow():
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not grow():
                raise ValueError("the stream ends within a record's head")
        version, *lines = bytes(held[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, size = end + 4, int(headers["content-length"])
        while len(held) < begin + size + 4:
            if not grow():
                raise ValueError("the stream ends within a record")
        block = bytes(held[begin : begin + size])
        yield Record(headers, block, bytes(held[: begin + size + 4]))
        del held[: begin + size + 4]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _archives(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = size = 0
        out, stream = [], None

        def close() -> pa.RecordBatch:
            name = f"pages-{task:05d}-{made:05d}.warc.gz"
            content = b"".join([*out, stream.flush()])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*batch.columns, strict=True):
                raw = record_bytes(page_id.as_py(), url.as_py(), payload.as_py() if first.as_py() is None else b"", digest.as_py(), first.as_py())
                if stream and size + len(raw) > archive_bytes:
                    yield close()
                    made, size, out, stream = made + 1, 0, [], None
                stream = stream or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.append(stream.compress(raw))
                size += len(raw)
        if stream:
            yield close()

    return run


def archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): monolithic gzip archives with a record for every row."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    source = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = source.where(F.length("payload") >= least).select("page_id", "digest").where("page_id is not null")
    # not on the grouping's own column: both sides are then exchanges, and Spark can split a hot digest's rows
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.reverse("digest").alias("tsegid"), "first")
    revisits = rows.withColumn("tsegid", F.reverse("digest")).join(groups, "tsegid").where("page_id <> first").select("page_id", "digest", "first").distinct()
    known = source.join(revisits, ["page_id", "digest"], "left")
    return known.select("page_id", "url", "payload", "digest", "first").mapInArrow(_archives(archive_bytes), ARCHIVE)


def _normalise(part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                yield from _normalised(path.as_py(), memoryview(content.as_buffer()), part_bytes)

    return run


def _normalised(path: str, content: memoryview, part_bytes: int) -> Iterator[pa.RecordBatch]:
    part = start = offset = 0
    members: list[bytes] = []
    entries: list[dict] = []

    def close() -> pa.RecordBatch:
        columns = ([path], [part], [start], [b"".join(members)], [entries])
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _NORMALISED_TYPES, strict=True)], names=["path", "part", "start", "content", "entries"])

    try:
        for r in records(inflated(content)):
            member = _gzip(r.raw)
            if members and offset + len(member) - start > part_bytes:
                yield close()
                part, start, members, entries = part + 1, offset, [], []
            h = r.headers
            entries.append({"offset": offset, "length": len(member), "record_id": h.get("warc-record-id"), "record_type": r.kind, "target_uri": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to")})
            members.append(member)
            offset += len(member)
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"{path}: {e}") from e
    if members:
        yield close()


_ENTRY_TYPE = pa.struct([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split() for x in ENTRY.split(","))])
_NORMALISED_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(_ENTRY_TYPE))


def normalise(found: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """Archives (path, content) with every record as its own member, in parts, with their index."""
    return found.select("path", "content").mapInArrow(_normalise(part_bytes), NORMALISED)


def index(normalised: DataFrame) -> DataFrame:
    """The sidecar: path, part and place of every record."""
    return normalised.select("path", "part", F.inline("entries"))


def member(content: memoryview, offset: int, length: int) -> Record:
    """One record, read by its place."""
    return next(records(iter([zlib.decompress(content[offset : offset + length], 31)])))


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content, entries in zip(*batch.columns, strict=True):
                out: list[list] = [[], [], [], [], [], [], []]
                held = memoryview(content.as_buffer())
                for e in entries.as_py():
                    r = member(held, e["offset"] - start.as_py(), e["length"])
                    full = r.payload if r.kind != "revisit" else None
                    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha256:") if full is None else hashlib.sha256(full).hexdigest()
                    row = (e["record_id"], r.kind, e["target_uri"], None if full is None else len(full), digest, e["refers_to"], full if payloads else None)
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return run


def read_records(normalised: DataFrame, sidecar: DataFrame | None = None, *, payloads: bool = True) -> DataFrame:
    """A row for each record of the index: every member is inflated singly, at its place in its part.

    ``sidecar`` is the index, or the rows of it that are wanted; only the parts
    that hold these are read.  A part has at most as many records as fit its
    bytes.  A revisit has the size of the response that it refers to, where
    that is read too; its payload is null.
    """
    places = (index(normalised) if sidecar is None else sidecar).groupBy("path", "part").agg(F.collect_list(F.struct("offset", "length", "record_id", "target_uri", "refers_to")).alias("entries"))
    parts = normalised.select("path", "part", "start", "content").join(places, ["path", "part"])
    found = parts.select("start", "content", "entries").mapInArrow(_read(payloads), "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    key = F.concat_ws(" ", "refers_to", "payload_digest").alias("yek")
    sizes = found.where("record_type = 'response'").groupBy("record_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    sizes = sizes.select(F.concat_ws(" ", "record_id", "payload_digest").alias("yek"), "size")
    revisits = found.where("record_type = 'revisit'").select("*", key).join(sizes, "yek", "left").withColumn("payload_bytes", F.col("size")).select(*found.columns)
    return found.where("record_type <> 'revisit'").union(revisits)


def page_of(record: str):
    """The page id in a record id; null where it has none."""
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: pages written as monolithic archives, normalised, and read back by the index."""
    scratch = Scratch(spark, "warc")
    written = scratch.keep(archives(tx.table(spark, sf_dir, "pages")), "archives")
    scratch.release()
    rewritten = scratch.keep(normalise(written), "normalised")
    sidecar = scratch.keep(index(rewritten), "index")
    scratch.drop(written)
    out = read_records(rewritten, sidecar, payloads=False)
    return out.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


WARC_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
