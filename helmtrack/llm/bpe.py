"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A pre-token is read byte by byte.  A configuration is a boundary that a token
may start at, the trie node of the bytes since, and the tokens that lead to the
boundary and are not yet written.  The set of live configurations, without the
prefix of tokens that all of them share, is a state of a deterministic
transducer; the shared prefix is what the step emits.  States and steps are
built when first needed and kept.  No token is longer than the longest entry
of the ranks, so the lookahead is bounded by it.  A pre-token that is an entry
of the ranks is that one token, without a run of the transducer.  What a worker
keeps (pre-tokens, pairs of tokens, states) is bounded by two generations: a
full one becomes the old one, from which what is still used is taken over.

A boundary is reached by one token sequence only, the merge result of the
prefix before it.  A token may follow another if merging their joined bytes
gives back exactly these two; the test runs the merges once for each pair and
is remembered.

Decoding steps a finite-state machine of UTF-8 through the ids, piece by piece.
Its states say which bytes may come next and how many of the current character
have come; an incomplete character is held back until its rest arrives.  The
machine's step over a whole token is a table, so that only tokens which end
within a character are stepped through singly.

Defined cases: a null or empty text has no tokens; ids decode to the exact
bytes of the text, and bytes that are no UTF-8 pass as they are; null ids and
repeated rows give rows like any others; an empty table gives an empty result;
other columns are ignored, and pass the pipeline's stage unchanged, as a null
text does.
"""

from __future__ import annotations

import array
import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Bounds of one generation of what a worker keeps: steps of the transducer, pre-tokens seen before, and pairs of tokens tested.
MAX_STEPS = 120_000
MAX_SEEN = 400_000
MAX_PAIRS = 300_000
#: Ids that are decoded at a time.
STEP = 4096

#: The public pattern again for texts below U+0250 without the characters that
#: the two regex engines class differently; ``re`` is the faster of the two.
SAME_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+").findall
_ODD = re.compile("[\x1c-\x1f²³¹¼½¾\u0250-\U0010ffff]").search

#: Letters and numbers that Unicode has got since version 16.0, first and last of each range.  The
#: tokenizer library splits by the tables of 16.0, the regex module by newer ones.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF4),
    (0x16FF5, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
#: What stands for one of them where a text is split: a character for private use, which is no letter in any version.
_NO_LETTER = "\ue000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Generations(dict):
    """Values made on demand.  Two generations bound it: a full one becomes the old one."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class States:
    """One generation of the transducer: numbered configurations, their steps and what they write at the end."""

    def __init__(self):
        self.number: dict[frozenset, int] = {}
        self.held: list[frozenset] = []
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.last: list[tuple[int, ...] | None] = []
        self.steps = 0
        self.intern(frozenset([(0, -1, ())]), ())

    def intern(self, configurations: frozenset, last: tuple[int, ...] | None) -> int:
        at = self.number.get(configurations)
        if at is None:
            at = self.number[configurations] = len(self.held)
            self.held.append(configurations)
            self.step.append({})
            self.last.append(last)
        return at


class Encoder:
    """Ranks compiled into a transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.same = ranks, regex.compile(pattern), pattern == SAME_PATTERN
        self.text = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.edges: list[dict[int, int]] = [{}]
        self.accept: list[int] = [-1]
        for raw, rank in ranks.items():
            node = 0
            for b in raw:
                to = self.edges[node].get(b)
                if to is None:
                    to = self.edges[node][b] = len(self.edges)
                    self.edges.append({})
                    self.accept.append(-1)
                node = to
            self.accept[node] = rank
        self.alone: dict[int, bool] = {}
        self.pairs = Generations(self._joins, MAX_PAIRS)
        self.seen = Generations(lambda piece: array.array("I", self.piece(piece.encode())).tobytes(), MAX_SEEN)
        self.states, self.old = States(), States()

    def merged(self, raw: bytes) -> list[int]:
        """Merges pairs of lowest rank first; only for tokens and pairs of tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if best == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _joins(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        return self.follows(-1, right) and self.merged(self.text[left] + self.text[right]) == [left, right]

    def follows(self, left: int, right: int) -> bool:
        if left >= 0:
            return self.pairs[left, right]
        ok = self.alone.get(right)
        if ok is None:
            ok = self.alone[right] = self.merged(self.text[right]) == [right]
        return ok

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The step of a state on a byte, from the old generation where it has it."""
        now, old = self.states, self.old
        if (at := old.number.get(now.held[state])) is not None and (move := old.step[at].get(byte)):
            rest, last, out = old.held[move[0]], old.last[move[0]], move[1]
        else:
            rest, last, out = self._made(now.held[state], byte)
        move = now.step[state][byte] = (now.intern(rest, last), out)
        now.steps += 1
        return move

    def _made(self, configurations: frozenset, byte: int) -> tuple[frozenset, tuple[int, ...] | None, tuple[int, ...]]:
        edges, accept = self.edges, self.accept
        alive, done = [], None
        for node, left, pending in configurations:
            to = edges[node].get(byte)
            if to is None:
                continue
            if edges[to]:
                alive.append((to, left, pending))
            if done is None and (token := accept[to]) >= 0 and self.follows(left, token):
                done = (0, token, (*pending, token))
        if done:
            alive.append(done)
        out = alive[0][2]
        for _, _, p in alive:
            n = min(len(p), len(out))
            while p[:n] != out[:n]:
                n -= 1
            out = out[:n]
        n = len(out)
        rest = frozenset((node, left, p[n:]) for node, left, p in alive) if n else frozenset(alive)
        return rest, done[2][n:] if done else None, out

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if self.states.steps > MAX_STEPS:
            self.states, self.old = States(), self.states
        out: list[int] = []
        state, step = 0, self.states.step
        for b in raw:
            move = step[state].get(b) or self._determinise(state, b)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.states.last[state] or ())
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens by the classes of Unicode 16.0."""
        if self.same and not _ODD(text):
            return _PLAIN(text)
        if _NEWER.search(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub(_NO_LETTER, text))]
        return self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.seen.__getitem__, self.split(text))), np.uint32).astype("<u4", copy=False)


#: States of the UTF-8 machine (RFC 3629): the bytes that may come next, the state after them, and how many bytes of the character are held.
UTF8_STATES: tuple[tuple[int, int, int, int], ...] = (
    (0x00, 0x7F, 0, 0),  # 0: between characters
    (0x80, 0xBF, 0, 1),  # 1: after the lead of two
    (0xA0, 0xBF, 5, 1),  # 2: after E0
    (0x80, 0xBF, 5, 1),  # 3: after the lead of three
    (0x80, 0x9F, 5, 1),  # 4: after ED
    (0x80, 0xBF, 0, 2),  # 5: after two of three
    (0x90, 0xBF, 9, 1),  # 6: after F0
    (0x80, 0xBF, 9, 1),  # 7: after the lead of four
    (0x80, 0x8F, 9, 1),  # 8: after F4
    (0x80, 0xBF, 10, 2),  # 9: after two of four
    (0x80, 0xBF, 0, 3),  # 10: after three of four
)
_LEADS = ((0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEF, 3), (0xED, 0xED, 4), (0xF0, 0xF0, 6), (0xF1, 0xF3, 7), (0xF4, 0xF4, 8))


def utf8_machine() -> np.ndarray:
    """Next state by state and byte.  A byte that may not come begins anew, as a lead or as a byte of no character."""
    step = np.zeros((len(UTF8_STATES), 256), np.uint8)
    for low, high, to in _LEADS:
        step[:, low : high + 1] = to
    for state, (low, high, to, _) in enumerate(UTF8_STATES[1:], 1):
        step[state, low : high + 1] = to
    return step


class Decoder:
    """Token ids to bytes of whole characters, piece by piece."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.text = np.full(size, None, object)
        self.text[list(ranks.values())] = list(ranks)
        self.step, self.held_bytes = utf8_machine(), [x[3] for x in UTF8_STATES]
        # the machine's step over each token, from each state
        length = np.zeros(size, np.int64)
        length[list(ranks.values())] = [len(x) for x in ranks]
        flat = np.frombuffer(b"".join(x for x in self.text if x is not None), np.uint8)
        start = np.cumsum(length) - length
        self.after = np.repeat(np.arange(len(UTF8_STATES), dtype=np.uint8)[:, None], size, axis=1)
        for k in range(int(length.max())):
            at = np.flatnonzero(length > k)
            self.after[:, at] = self.step[self.after[:, at], flat[start[at] + k]]
        self.splits = self.after[0] != 0
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        """The characters that are complete after these ids."""
        state, at, after, n = self.state, 0, self.after, len(ids)
        for i in (np.flatnonzero(self.splits[ids]).tolist() if state == 0 else range(n)):
            if i < at:
                continue
            state, at = int(after[state, ids[i]]), i + 1
            while state and at < n:
                state, at = int(after[state, ids[at]]), at + 1
            if not state and self.state:
                return self._out(ids[:at], 0) + self.feed(ids[at:])
        return self._out(ids, state)

    def _out(self, ids: np.ndarray, state: int) -> bytes:
        raw = self.held + b"".join(self.text[ids].tolist())
        n = len(raw) - self.held_bytes[state]
        self.state, self.held = state, raw[n:]
        return raw[:n]

    def finish(self) -> bytes:
        """What is left of a character that never ended."""
        rest = self.held
        self.reset()
        return rest

    def stream(self, ids: np.ndarray, step: int = STEP) -> Iterator[bytes]:
        for i in range(0, len(ids), step):
            yield self.feed(ids[i : i + step])
        yield self.finish()


_encoders: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder a worker; the vocabulary file is part of every machine's Python."""
    if (path, pattern) not in _encoders:
        ranks = read_ranks(path)
        _encoders[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _encoders[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


_KINDS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}


def _coded(texts: pa.Array, encoder: Encoder, decoder: Decoder, ids: bool) -> list[pa.Array]:
    out: list[list] = [[], [], [], [], []]
    for t in texts:
        tokens = encoder.encode(t.as_py() or "")
        raw = b"".join(decoder.stream(tokens))
        row = (tokens.view("<i4") if ids else None, len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest(), raw.decode("utf-8", "replace") if ids else None, hashlib.sha256(raw).hexdigest())
        for x, v in zip(out, row, strict=True):
            x.append(v)
    return [pa.array(x, k) for x, k in zip(out, _KINDS.values(), strict=True)]


def encode_decode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, ids (array, unless ``ids`` is false), n_tokens, ids_sha256, decoded, decoded_sha256."""
    at, by = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(at, by)
        for batch in batches:
            for i, j in tx.chunks(tx.buffers(batch.column(1))[1]):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), *_coded(part.column(1), encoder, decoder, ids)], names=["doc_id", *_KINDS])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded string, decoded_sha256 string")


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10."""
    return encode_decode(tx.table(spark, sf_dir, "documents"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: all columns, the text as decoded from its ids, then ids, n_tokens, ids_sha256 and decoded_sha256.

    A new column whose name is taken gets a trailing underscore.
    """
    at, by = default_vocabulary()
    schema, _ = tx.with_columns(docs, ids="array<int>", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(at, by)
        for batch in batches:
            for i, j in tx.chunks(tx.buffers(batch.column(place))[1]):
                part = batch.slice(i, j - i)
                tokens, n, sha, decoded, decoded_sha = _coded(part.column(place), encoder, decoder, True)
                columns = part.columns
                columns[place] = pc.if_else(columns[place].is_valid(), decoded, pa.scalar(None, decoded.type)).cast(columns[place].type)
                yield pa.RecordBatch.from_arrays([*columns, tokens, n, sha, decoded_sha], names=schema.names)

    return docs.mapInArrow(run, schema)
