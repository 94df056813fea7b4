"""Byte-level BPE encoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last bytes has a fixed pattern, so passages that documents
share are cut alike.  Of every chunk the body (from its first to its last safe point) is
encoded once and kept in a bounded table of the task; copies of it take its ids.  What lies between
two bodies is encoded again together with the last piece of the left and the first piece of the right body.
When the ids of these two pieces come out as in the bodies, the join is exact; when not, both bodies
are given up and their text joins the gap, until everything agrees.

A safe point is a place where every tokenisation that sees both sides starts a new word: after an
ASCII letter, before a space with an ASCII letter or before one of ``.,;:!?``.

Reuse is per task: sharing ids between executors would shuffle every text and its ids
for work that costs less than that shuffle.

Defined results: null and empty texts have no ids; text that spells a special token gets its id, as the
file's added tokens do; repeated rows are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ctrltok.llm.common import texts, utf8
from ctrltok.udfs import by_value

by_value(__name__)

# fixed value: the word pattern of byte-level BPE tokenizers
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = re.compile(rb"[A-Za-z](?=[.,;:!?]| [A-Za-z])")
WINDOW_STEPS = 4
KEPT_BYTES = 96 << 20


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]
    special: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """Byte ranks and special tokens of a byte-level BPE ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    last = 255
    for merge in data["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        rank = ranks[bytes(byte_of[c] for c in a + b)]
        if rank <= last:
            raise ValueError("token ids do not follow the order of the merges")
        last = rank
    return Vocabulary(ranks, special)


def cut_points(data: bytes, bits: int = 11, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of content-defined chunks: where a hash of the last 16 bytes has ``bits`` zero bits."""
    n = len(data)
    if n <= least:
        return [n]
    h = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW_STEPS):
        h = h[:-(1 << k)] * np.uint64(0xD6E8FEB86659FD93) + h[1 << k:]
        h ^= h >> np.uint64(32)
    hits = np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + (1 << WINDOW_STEPS)
    cuts, lo = [], 0
    for at in [*hits.tolist(), n]:
        while at - lo > most:
            lo += most
            cuts.append(lo)
        if at - lo >= least or at == n:
            lo = at
            cuts.append(at)
    whole = []
    for at in cuts:  # never inside a character
        while at < n and data[at] & 0xC0 == 0x80:
            at -= 1
        if at > (whole[-1] if whole else 0):
            whole.append(at)
    if not whole or whole[-1] != n:
        whole.append(n)
    return whole


def last_safe(chunk: bytes) -> int:
    """The last safe point, or -1."""
    for width in (128, 1024, len(chunk)):
        lo = max(0, len(chunk) - width)
        at = -1
        for m in SAFE.finditer(chunk, lo):
            at = m.end()
        if at >= 0 or lo == 0:
            return at
    return -1


@dataclass
class Body:
    """An encoded chunk without its two ends (``lo`` to ``hi``), with its first and last piece."""

    lo: int
    hi: int
    ids: np.ndarray
    first: bytes
    first_ids: list[int]
    last: bytes
    last_ids: list[int]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.bpe = tiktoken.Encoding("chunked", pat_str=WORDS, mergeable_ranks=vocabulary.ranks,
                                     special_tokens=vocabulary.special)
        self.bytes_of = {i: b for b, i in vocabulary.ranks.items()} | {i: s.encode() for s, i in vocabulary.special.items()}
        self.kept: dict[bytes, Body | None] = {}
        self.size = 0
        self.encoded = self.reused = self.widened = 0

    def plain(self, data: bytes) -> list[int]:
        return self.bpe.encode(data.decode(), allowed_special="all") if data else []

    def body(self, chunk: bytes) -> Body | None:
        """The chunk's body, encoded when it is new; None when the chunk has too few safe points."""
        key = xxhash.xxh3_128_digest(chunk)
        if key in self.kept:
            self.reused += 1
            return self.kept[key]
        self.encoded += 1
        found = None
        first = SAFE.search(chunk)
        second = SAFE.search(chunk, first.end()) if first else None
        if second:
            lo, hi = first.end(), last_safe(chunk)
            before = last_safe(chunk[:hi - 1] + b".") if hi > second.end() else -1
            before = before if lo < before < hi else lo
            if hi > second.end():
                a, b = chunk[lo:second.end()], chunk[before:hi]
                found = Body(lo, hi, np.array(self.plain(chunk[lo:hi]), np.int32), a, self.plain(a), b, self.plain(b))
        if self.size > KEPT_BYTES:
            self.kept.clear()
            self.size = 0
        self.kept[key] = found
        self.size += 300 + (found.ids.nbytes if found else 0)
        return found

    def encode(self, data: bytes) -> np.ndarray:
        """Token ids of a whole text."""
        bodies: list[tuple[int, int, Body]] = []
        lo = 0
        for hi in cut_points(data):
            b = self.body(data[lo:hi])
            if b:
                bodies.append((lo + b.lo, lo + b.hi, b))
            lo = hi
        done: list[tuple[int, int, Body]] = []
        gaps: list[list[int]] = []
        start, i = 0, 0
        while True:
            left = done[-1][2] if done else None
            at, right = (bodies[i][0], bodies[i][2]) if i < len(bodies) else (len(data), None)
            head, tail = (left.last if left else b""), (right.first if right else b"")
            ids = self.plain(head + data[start:at] + tail)
            a, b = (left.last_ids if left else []), (right.first_ids if right else [])
            if ids[:len(a)] == a and ids[len(ids) - len(b):] == b and len(ids) >= len(a) + len(b):
                gaps.append(ids[len(a):len(ids) - len(b)])
                if not right:
                    break
                done.append(bodies[i])
                start, i = bodies[i][1], i + 1
                continue
            self.widened += 1
            if left:
                done.pop()
                gaps.pop()
                start = done[-1][1] if done else 0
            if right:
                i += 1
        parts = [np.array(gaps[0], np.int32)]
        for (_, _, b), gap in zip(done, gaps[1:], strict=True):
            parts += [b.ids, np.array(gap, np.int32)]
        return np.concatenate(parts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def shared(spark: SparkSession, path: str):
    """The vocabulary, read on the driver and sent to the executors (its size is that of one file)."""
    return spark.sparkContext.broadcast(vars(read_vocabulary(path)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    vocabulary = shared(docs.sparkSession, path)

    def run(batches):
        codec = Codec(Vocabulary(**vocabulary.value))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [codec.encode(t) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids are an empty text."""
    vocabulary = shared(encoded.sparkSession, path)

    def run(batches):
        codec = Codec(Vocabulary(**vocabulary.value))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = [codec.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, encoded and decoded in one task."""
    vocabulary = shared(docs.sparkSession, path)

    def run(batches):
        codec = Codec(Vocabulary(**vocabulary.value))
        decimal = {i: str(i) for i in codec.bytes_of}
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in utf8(b.column(1)):
                ids = codec.encode(text).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
