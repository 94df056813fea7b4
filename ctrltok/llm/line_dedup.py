"""Line deduplication by streaming range-partitioned line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased.  A key of at least ``min_chars`` code points that occurs in two or
more documents keeps its lines only in the smallest doc_id that holds it.

Keys travel as 128-bit hashes with document and position.  A map task already
settles what its own batch shows (a later document than another one of the
batch loses the line), so one batch sends a common line once.  The rest is
range-partitioned and sorted by (hash, document, position): a common key may
span any number of partitions.  Each partition streams its rows and keeps the
first document of every hash; only the document that leads a partition stays open,
since its key may have begun in an earlier one, and these few rows are settled
by the minimum over partitions.  The result is one zlib-packed bitmap per document
that loses lines; texts are not shuffled to find it.

Defined results: null or empty text is one empty line; keys repeated only inside one
document stay; rows that repeat a doc_id are one document for this rule
and each row gets its own bitmap; a null doc_id sorts before every number;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import keyed, row_key, stored, utf8
from ctrltok.udfs import by_value

by_value(__name__)

SPACE = b" \t\n\r\x0b\x0c"
ROWS = "kind int, hi long, lo long, did long, tag long, line long"
OPEN, SETTLED, SEEN = 0, 1, 2


def line_keys(text: bytes, min_chars: int):
    """(line number, 128-bit hash) of every line whose key has ``min_chars`` code points."""
    for n, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE).lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            yield n, xxhash.xxh3_128_digest(key)


def table(kinds, digests, dids, tags, lines) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
         pa.array(dids, pa.int64()), pa.array(tags, pa.int64()), pa.array(lines, pa.int64())],
        names=["kind", "hi", "lo", "did", "tag", "line"])


def key_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a key; lines that a smaller document of the same batch also holds are settled."""
    def run(batches):
        for b in batches:
            found, first = [], {}
            for did, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                for n, h in line_keys(text, min_chars):
                    found.append((h, did, tag, n))
                    if first.get(h, did) >= did:
                        first[h] = did
            for lo in range(0, len(found), 1 << 16):
                part = found[lo:lo + (1 << 16)]
                yield table([OPEN if first[h] == d else SETTLED for h, d, _, _ in part], [x[0] for x in part],
                            [x[1] for x in part], [x[2] for x in part], [x[3] for x in part])

    return rows.select("did", "tag", "text").mapInArrow(run, ROWS)


def streamed(batches):
    """Stream rows sorted by (hash, document, position) of one range partition.

    Yields the settled losers, the rows of the document that leads the partition (open) and
    one row that tells the last hash's first document to later partitions."""
    key = first = None
    leading = True
    for b in batches:
        hi, lo, did, tag, line = (b.column(i).to_numpy() for i in range(5))
        if not len(hi):
            continue
        new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        if key == (hi[0], lo[0]):
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(hi)), -1))
        firsts = np.where(start >= 0, did[start], did[0] if first is None else first)
        inside = leading & (np.cumsum(new) <= (1 if key is None else 0))
        kind = np.where(did > firsts, SETTLED, np.where(inside, OPEN, -1))
        take = kind >= 0
        yield pa.RecordBatch.from_arrays([pa.array(kind[take].astype(np.int32))] +
                                         [pa.array(x[take]) for x in (hi, lo, did, tag, line)],
                                         names=["kind", "hi", "lo", "did", "tag", "line"])
        leading = leading and bool(inside[-1])
        key, first = (hi[-1], lo[-1]), firsts[-1]
    if key is not None:
        one = lambda v, t=pa.int64(): pa.array([v], t)
        yield pa.RecordBatch.from_arrays([one(SEEN, pa.int32()), one(key[0]), one(key[1]), one(first), one(0), one(0)],
                                         names=["kind", "hi", "lo", "did", "tag", "line"])


def pack(lines) -> bytes:
    """zlib-packed keep bitmap: bit i is 0 when line i is dropped; lines beyond its end stay."""
    keep = np.ones((int(max(lines)) // 8 + 1) * 8, bool)
    keep[np.asarray(lines, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Boolean keep mask of ``n`` lines."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n].astype(bool)
        keep[:len(bits)] = bits
    return keep


def keep_bitmaps(rows: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(did, tag, bitmap)`` for every document of ``keyed`` rows that loses lines."""
    found = stored(key_rows(rows, min_chars), "line-keys")
    ordered = (found.filter(F.col("kind") == OPEN).select("hi", "lo", "did", "tag", "line")
               .repartitionByRange("hi", "lo", "did", "tag", "line")
               .sortWithinPartitions("hi", "lo", "did", "tag", "line"))
    seen = stored(ordered.mapInArrow(streamed, ROWS), "line-first")
    edge = seen.filter(F.col("kind") != SETTLED)
    low = edge.groupBy("hi", "lo").agg(F.min("did").alias("first"))
    late = edge.filter(F.col("kind") == OPEN).join(low, ["hi", "lo"]).filter("did > first")
    drops = (found.filter(F.col("kind") == SETTLED).select("did", "tag", "line")
             .union(seen.filter(F.col("kind") == SETTLED).select("did", "tag", "line"))
             .union(late.select("did", "tag", "line")))

    def pack_all(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([pack(x) for x in b.column(2).to_pylist()], pa.binary())],
                names=["did", "tag", "bitmap"])

    return (drops.groupBy("did", "tag").agg(F.collect_list("line").alias("lines"))
            .mapInArrow(pack_all, "did long, tag long, bitmap binary"))


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, text, bitmap)``: every row with its bitmap (null: nothing is dropped)."""
    rows = keyed(docs)
    return rows.join(keep_bitmaps(rows, min_chars), ["did", "tag"], "left").select("doc_id", "text", "bitmap")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text of the kept lines)."""
    lines = text.split(b"\n")
    if not bitmap:
        return len(lines), 0, text
    keep = unpack(bitmap, len(lines))
    return len(lines), int((~keep).sum()), b"\n".join([x for x, k in zip(lines, keep, strict=True) if k])


def digests(batches):
    for b in batches:
        done = [kept_lines(t, m) for t, m in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
             pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string()), b.column(2)],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])


def line_digests(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap`` for every row."""
    return with_bitmaps(docs, min_chars).mapInArrow(
        digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``; other columns (whatever their names) and null texts stay as they
    are, rows are judged by their own text, and an empty table stays empty."""
    columns = docs.columns
    rest = [c for c in columns if c != "text"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in rest]).alias("rest"), docs["`text`"].isNull().alias("none"),
                       F.coalesce(docs["`text`"], F.lit("")).alias("text"), *row_key(docs))
    marked = rows.join(keep_bitmaps(keyed(docs), min_chars), ["did", "tag"], "left").select("rest", "none", "text", "bitmap")

    def run(batches):
        for b in batches:
            kept = [kept_lines(t, m)[2].decode() for t, m in zip(utf8(b.column(2)), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.string())],
                                             names=["rest", "none", "text"])

    schema = marked.select("rest", "none", "text").schema
    out = marked.mapInArrow(run, schema)
    text = F.when(~F.col("none"), F.col("text")).alias("text")
    return out.select(*[text if c == "text" else F.col("rest").getField(c).alias(c) for c in columns])
