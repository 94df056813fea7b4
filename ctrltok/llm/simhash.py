"""SimHash near-duplicates by pigeonhole blocks.

A text's words (ASCII letters lower-cased, split at ASCII white space) give
word shingles, repeats included; a fingerprint bit is set when it is set in
more than half of the shingles' XXH64 values.  Documents link when their
fingerprints differ in at most ``distance`` bits, and a group is a connected
component of links.

Everything after the fingerprints works on *distinct* fingerprints, so a
group of exact copies is one node.  The 64 bits are split into ``blocks``
blocks; two fingerprints within ``distance`` agree on ``blocks - distance`` of
them, so they meet under one of the block combinations.  In a bucket of at
most ``pair_bucket`` fingerprints candidates are joined and their Hamming
distance is verified.  Members of larger buckets are linked exactly without pairs: two
fingerprints are within d bits if and only if some value lies within
floor(d/2) bits of one and ceil(d/2) bits of the other, so each member is
dealt to the values around it and members that meet at a value with a near
one are linked to the smallest near one.

Defined results: null and empty texts have fingerprint zero and link like any
other; equal rows stay separate rows with equal results; a null doc_id
takes part and counts as the largest id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import keyed, row_key, stored, unpacked, utf8
from ctrltok.udfs import by_value

by_value(__name__)

PIECE = 1 << 15


def fingerprint(words: list[bytes], size: int, seed: int) -> int:
    """64-bit SimHash of a word list (zero without words)."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        if n == 1:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[lo + k:hi + k] for k in range(size)), strict=True))
        h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, did, tag, fp)`` for every row."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.lower().split(), shingle, seed) for t in utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.int64())], names=["doc_id", "did", "tag", "fp"])

    return keyed(docs).select("doc_id", "did", "tag", "text").mapInArrow(run, "doc_id long, did long, tag long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks (as signed longs) that keep ``blocks - distance`` of the blocks of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [reduce(int.__or__, c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball(radius: int):
    """Array column: ``fp`` with at most ``radius`` (0 or 1) bits flipped."""
    flips = [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)] * (radius > 0)
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda x: x.bitwiseXOR(F.col("fp")))


def fingerprint_links(nodes: DataFrame, distance: int = 2, blocks: int = 4, pair_bucket: int = 64) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect exactly the pairs
    within ``distance`` bits (0 to 2): verified pairs in small buckets, stars in large ones."""
    if not 0 <= distance <= 2 or blocks <= distance:
        raise ValueError("distance must be 0, 1 or 2 and blocks larger than it")
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in
                      enumerate(block_masks(blocks, distance))])
    rows = (nodes.select("fp", F.explode(masks).alias("b"))
            .select("fp", F.col("b.i").alias("combo"), F.col("fp").bitwiseAND(F.col("b.m")).alias("key")))
    sizes = rows.groupBy("combo", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(rows.join(sizes, ["combo", "key"]), "simhash-buckets")
    small = met.filter(F.col("n") <= pair_bucket).select("combo", "key", F.col("fp").alias("u"))
    pairs = (small.join(small.withColumnRenamed("u", "v"), ["combo", "key"])
             .filter("u < v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
             .select("u", "v").distinct())
    dense = met.filter(F.col("n") > pair_bucket).select("fp").distinct()
    near, far = distance // 2, distance - distance // 2
    at = dense.select("fp", F.explode(ball(far)).alias("z"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("z"))) <= near
    hubs = at.filter(close).groupBy("z").agg(F.min("fp").alias("hub"), F.count("*").alias("c"))
    if near == far:
        hubs = hubs.filter("c > 1")
    stars = (at.join(hubs, "z").filter("fp != hub")
             .select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v")).distinct())
    return pairs.union(stars)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``links (u, v)``; the root is a
    component's smallest node.  Alternates large stars (neighbours above a node move to its
    smallest neighbour) and small stars (those below do) until nothing changes, so the number of rounds follows the
    logarithm of the longest path.  Each round is written to the shared folder."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
                   .distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        large = stored(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        edges = stored(small, "cc")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, did, tag, fp, component_id)`` per row."""
    fps = stored(fingerprints(docs, shingle, seed), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(nodes.select("fp"), distance, blocks))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-groups")
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    group_of = stored(rooted.join(first, "root").select("fp", "root", "component_id"), "simhash-components")
    return fps.join(group_of, "fp")


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the smallest doc_id reachable over links."""
    return grouped(docs, **parameters).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, **parameters) -> DataFrame:
    """One row of ``docs`` per group, all columns kept: the smallest doc_id (null counts as the largest), of rows that repeat it
    the smallest text hash, and of rows equal in both the smallest hash of the whole row.  An empty table stays empty."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "did", "tag")
    chosen = stored(grouped(docs, **parameters).groupBy("root").agg(F.min(order).alias("o")).select("o.did", "o.tag"), "simhash-chosen")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *row_key(docs))
    kept = rows.join(chosen, ["did", "tag"], "left_semi")
    return unpacked(kept.groupBy("did", "tag").agg(F.min_by("row", F.xxhash64("row")).alias("row")), docs.columns)
