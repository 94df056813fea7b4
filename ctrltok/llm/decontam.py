"""Benchmark decontamination by spaced-seed hashing.

Words (runs of Unicode letters, marks and digits of the lower-cased text; in scripts written without spaces every such
character) are hashed; a seed hashes the words under a fixed mask and ignores the masked-out positions, so a substituted word
there does not hide a copy.  Seeds of the benchmark and of every position of the documents are
joined; around each hit the document and the item are compared word by word on the
hit's diagonal; any stretch of at least ``min(least_words, item)`` words of which ``similarity`` or more
agree counts, and the one with the most equal words is reported.

Documents send only seeds that pass a bitmap of the benchmark's seeds.  The bitmap has a fixed size
whatever the benchmark's, so it is broadcast; a benchmark that fills it only lets more rows through to the join,
which Spark plans by the measured size of its sides.

Passages that stand in several items (an instruction line, a question asked twice) are targets of their own: windows of
``least_words`` words (shorter items whole) are counted over the items, neighbouring windows held by the same items form a
passage, and every seed inside one is kept once for the passage instead of once per item.  A document with a verified
overlap with a passage is linked to the passage, not to each of its items; one that only touches it is
compared with each item, as its overlap may lie in what surrounds the passage there.

Defined results: null or empty texts and items have no overlap; items below ``SHORTEST`` words match documents that
consist of the same words, and items shorter than a mask match exactly; a document that meets an item by words of its own and
by a shared passage has a row for either; equal rows of a table are reported once; rows
that repeat a doc_id with other text are compared one by one and reported under the id; a null doc_id or item_id
is reported as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import as_long, keyed, slices, stored, without_rows
from ctrltok.udfs import by_value

by_value(__name__)

MASKS = ("110111", "1011011", "11001011", "1101010001")
SHORTEST = 5
STEP = 0xD6E8FEB86659FD93
BITS = 24
# fixed values: code points of scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, CJK)
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
            (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
NO_WORD, IN_WORD, ALONE = 0, 1, 2
WHOLE = 0x9E3779B97F4A7C15
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For every code point whether it is no part of a word, part of one or a word of its own."""
    if not _KINDS:
        k = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)], np.uint8)
        for lo, hi in UNSPACED:
            k[lo:hi + 1] *= ALONE
        _KINDS.append(k)
    return _KINDS[0]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def lowered(column: pa.Array) -> list[str]:
    return [t.lower() for t in column.to_pylist()]


class Hasher:
    """Word hashes of a text, independent of where a word stands."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of every word, places in code points."""
        b = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(b) > len(self.up):
            size = max(len(b), 1 << 21)
            self.up = np.cumprod(np.full(size, STEP, np.uint64))
            self.down = np.cumprod(np.full(size, pow(STEP, -1, 1 << 64), np.uint64))
        kind = np.r_[NO_WORD, kinds()[b], NO_WORD]
        start = np.flatnonzero((kind[1:-1] == ALONE) | (kind[1:-1] == IN_WORD) & (kind[:-2] != IN_WORD))
        end = np.flatnonzero((kind[1:-1] == ALONE) | (kind[1:-1] == IN_WORD) & (kind[2:] != IN_WORD)) + 1
        total = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.down[:len(b)])]
        h = (total[end] - total[start]) * self.up[start] if len(start) else np.zeros(0, np.uint64)
        return mixed(h, (end - start).astype(np.uint64)), start, end


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask at every position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, hash_of_mask(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = mixed(h, words[k:n + k])
    return h


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * STEP & (1 << 64) - 1


def masks_of(words: int) -> tuple[str, ...]:
    """The masks an item of so many words is found by (below ``SHORTEST``: its :func:`whole_seed` alone)."""
    if words < SHORTEST:
        return ()
    fitting = tuple(m for m in MASKS if len(m) <= words)
    return fitting if words >= max(map(len, MASKS)) else (*fitting, "1" * words)


def whole_seed(words: np.ndarray) -> np.ndarray:
    """The seed of a short text as a whole, of another kind than those inside texts (none: no words)."""
    n = len(words)
    return mixed(seeds(words, "1" * n), np.full(1, WHOLE, np.uint64)) if 0 < n < SHORTEST else np.zeros(0, np.uint64)


def item_windows(items: DataFrame, least: int) -> DataFrame:
    """``(ik, q, win)``: hash of every ``least`` consecutive words of an item (of all words of a shorter one)."""
    def run(batches):
        hasher = Hasher()
        for b in batches:
            for ik, text in zip(b.column(0).to_pylist(), lowered(b.column(1)), strict=True):
                w = hasher.words(text)[0]
                h = seeds(w, "1" * min(least, len(w))) if len(w) else w
                yield pa.RecordBatch.from_arrays([pa.array([ik] * len(h), pa.int64()), pa.array(np.arange(len(h))), pa.array(as_long(h))],
                                                 names=["ik", "q", "win"])

    return items.select("ik", "text").mapInArrow(run, "ik long, q long, win long")


def shared_windows(items: DataFrame, least: int) -> DataFrame:
    """``(ik, windows)``: places ``q`` of an item's windows that other items have too, with the number ``n`` of these
    items and a hash ``who`` of them."""
    windows = stored(item_windows(items, least), "item-windows")
    held_by = (windows.select("win", "ik").distinct().groupBy("win")
               .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ik")).alias("who")).filter("n > 1"))
    return windows.join(held_by, "win").groupBy("ik").agg(F.collect_list(F.struct("q", "n", "who")).alias("windows"))


def passages(words: np.ndarray, windows: list[dict], least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Of one item: holders of the window at every place (0: the item alone), number of the passage the window
    belongs to, and the passages as (hash, first word, end)."""
    size = min(least, len(words))
    n, who = np.zeros(len(words) - size + 1, np.int64), np.zeros(len(words) - size + 1, np.int64)
    for x in windows:
        n[x["q"]], who[x["q"]] = x["n"], x["who"]
    new = np.r_[True, (who[1:] != who[:-1]) | (n[1:] != n[:-1])]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    power = np.cumprod(np.full(len(words), STEP, np.uint64))
    found = []
    for lo, hi in zip(first, np.r_[first[1:], len(n)], strict=True):
        part = words[lo:hi - 1 + size]
        h = mixed(np.array([(part * power[:len(part)]).sum(dtype=np.uint64)]), np.array([len(part)], np.uint64))
        found.append((int(as_long(h)[0]), int(lo), int(hi - 1 + size)))
    return n, run, found


def most_shared(n: np.ndarray, places: int, span: int, size: int) -> np.ndarray:
    """For seeds at ``0 .. places - 1`` the place of the window around them that most items hold (-1: none is shared)."""
    at = np.arange(places)
    best, chosen = np.zeros(places, np.int64), np.full(places, -1)
    for k in range(size - span + 1):
        q = at - k
        inside = (q >= 0) & (q < len(n))
        here = np.where(inside, n[np.clip(q, 0, len(n) - 1)], 0)
        better = here > best
        best[better], chosen[better] = here[better], q[better]
    return chosen


PLACES = "kind int, target long, shared boolean, at long, seed long, ik long, text string"
SEED, MEMBER = 0, 1


def item_places(items: DataFrame, least: int) -> DataFrame:
    """Rows of two kinds: the seeds of every item with their target (the item, or the passage around the seed that most items
    share) and place in it; and the passages of every item with the place and the text they have there."""
    def run(batches):
        hasher = Hasher()
        for b in batches:
            for ik, text, windows in zip(b.column(0).to_pylist(), lowered(b.column(1)), b.column(2).to_pylist(), strict=True):
                w, start, end = hasher.words(text)
                if not len(w):
                    continue
                n, run_of, parts = passages(w, windows or [], least)
                used, rows = set(), []
                short = whole_seed(w)
                for h, span in ((short, len(w)), *((seeds(w, m), len(m)) for m in masks_of(len(w)))):
                    q = most_shared(n, len(h), span, min(least, len(w)))
                    for at, (s, c) in enumerate(zip(as_long(h).tolist(), q.tolist(), strict=True)):
                        if c < 0:
                            rows.append((SEED, ik, False, at, s, None, None))
                        else:
                            r = int(run_of[c])
                            used.add(r)
                            rows.append((SEED, parts[r][0], True, at - parts[r][1], s, None, None))
                for r in sorted(used):
                    h, lo, hi = parts[r]
                    rows.append((MEMBER, h, True, lo, None, ik, text[start[lo]:end[hi - 1]]))
                types = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names=["kind", "target", "shared", "at", "seed", "ik", "text"])

    rows = items.join(shared_windows(items, least), "ik", "left").select("ik", "text", "windows")
    return rows.mapInArrow(run, PLACES)


def bitmap(found: DataFrame) -> np.ndarray:
    """Bitmap of ``2 ** BITS`` bits over the seeds' top bits; at most ``2 ** BITS / 64`` rows reach the driver."""
    bit = F.shiftrightunsigned("seed", 64 - BITS)
    words = np.zeros(1 << (BITS - 6), np.int64)
    rows = (found.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITS}) & 63 as int))").alias("m"))
            .groupBy("at").agg(F.bit_or("m").alias("m")))
    for r in rows.toLocalIterator():
        words[r["at"]] = r["m"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def document_seeds(rows: DataFrame, lengths: list[int], allowed) -> DataFrame:
    """``(did, tag, at, seed)`` of document positions whose seed may be one of the benchmark's."""
    masks = (*MASKS, *("1" * n for n in lengths))

    def run(batches):
        hasher, bits = Hasher(), np.unpackbits(allowed.value).astype(bool)
        for b in batches:
            dids, tags, data = b.column(0).to_numpy(), b.column(1).to_numpy(), lowered(b.column(2))
            for lo, hi in slices([len(t) for t in data]):
                # texts are joined by separators; no seed may span two of them
                sizes = np.array([len(t) + 1 for t in data[lo:hi]])
                w, start, _ = hasher.words("\n".join(data[lo:hi]))
                doc = np.searchsorted(np.cumsum(sizes), start, side="right")
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in np.flatnonzero(np.diff(first) < SHORTEST):
                    h = whole_seed(w[first[i]:first[i + 1]])
                    if len(h) and bits[int(h[0] >> np.uint64(64 - BITS))]:
                        yield pa.RecordBatch.from_arrays([pa.array(dids[lo + i:lo + i + 1]), pa.array(tags[lo + i:lo + i + 1]), pa.array([0]), pa.array(as_long(h))],
                                                         names=["did", "tag", "at", "seed"])
                for m in masks:
                    h = seeds(w, m)
                    at = np.flatnonzero(bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                    at = at[doc[at] == doc[at + len(m) - 1]]
                    own = doc[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(dids[lo + own]), pa.array(tags[lo + own]), pa.array(at - first[own]), pa.array(as_long(h[at]))],
                        names=["did", "tag", "at", "seed"])

    return rows.select("did", "tag", "text").mapInArrow(run, "did long, tag long, at long, seed long")


def best_stretch(same: np.ndarray, similarity: float, least: int) -> tuple[int, int] | None:
    """Of the stretches of ``least`` words or more that agree in the share ``similarity`` or more, the one with the
    most equal words, then the fewest words: (start, end)."""
    agree = np.r_[0, np.cumsum(same)]
    total = agree - similarity * np.arange(len(agree))
    # a stretch agrees enough if the total does not fall over it; its earliest start has the most words, equal ones too
    start = np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9)
    end = np.flatnonzero(np.arange(len(agree)) - start >= max(1, least))
    if not len(end):
        return None
    start = start[end]
    i = np.lexsort((end - start, agree[start] - agree[end]))[0]
    lo, hi = int(start[i]), int(end[i])
    while hi - lo > least and not same[lo]:
        lo += 1
    while hi - lo > least and not same[hi - 1]:
        hi -= 1
    return lo, hi


def overlap(doc: np.ndarray, item: np.ndarray, diagonals, least: int, similarity: float):
    """Best verified overlap over the hit diagonals: (words, agreeing words, start in document, start in item)."""
    best = None
    for d in sorted(diagonals):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi <= lo:
            continue
        same = doc[lo + d:hi + d] == item[lo:hi]
        stretch = best_stretch(same, similarity, min(least, len(item)))
        if stretch is None:
            continue
        start, end = stretch
        agree = int(same[start:end].sum())
        if best is None or agree > best[1]:
            best = (end - start, agree, lo + d + start, lo + start)
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """``doc_id, item_id, words, agreeing, similarity, doc_word, item_word, class_id, n_items``: the verified overlaps.

    Without class_id a row is a pair of a document and an item with its best stretch.  A class_id stands for a passage of
    ``n_items`` items: every document of the class overlaps every item of it by the passage.  Its documents are in
    rows with the smallest item, its items in rows with the smallest document, so a class has about as many rows as documents
    and items together."""
    pairs, links, members = found_overlaps(docs, benchmark, least_words, similarity)
    item = F.struct("item_id", "ik", F.col("at").alias("place"))
    members = members.groupBy("target", "ik").agg(F.min(F.struct("item_id", "ik", "at")).alias("m")).select("target", "m.*")
    # one document row per class and text: links are small rows, their texts are gone
    first = members.groupBy("target").agg(F.min(item).alias("least"), F.count("*").alias("n_items"))
    heads = links.groupBy("target").agg(F.min(F.struct("did", "tag", "doc_id", *STRETCH)).alias("head"))
    across = links.join(first, "target").select("doc_id", F.col("least.item_id").alias("item_id"), *STRETCH[:-1],
                                                (F.col("item_word") + F.col("least.place")).alias("item_word"), "target", "n_items")
    down = (members.join(first, "target").filter("ik != least.ik").join(heads, "target")
            .select("head.doc_id", "item_id", *[F.col(f"head.{c}").alias(c) for c in STRETCH[:-1]],
                    (F.col("head.item_word") + F.col("at")).alias("item_word"), "target", "n_items"))
    alone = pairs.select("doc_id", "item_id", *STRETCH, F.lit(None).cast("long").alias("target"), F.lit(1).cast("long").alias("n_items"))
    return alone.unionByName(across).unionByName(down).withColumnRenamed("target", "class_id").select(
        "doc_id", "item_id", *STRETCH, "class_id", "n_items").distinct()


STRETCH = ["words", "agreeing", "similarity", "doc_word", "item_word"]


def compared(met: DataFrame, rows: DataFrame, targets: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """``met (did, tag, target, diagonals)`` with the best stretch of the document and the target (null: none suffices)."""
    # Spark broadcasts the written hits when they are small, so documents without a hit are not shuffled
    pairs = (rows.join(met, ["did", "tag"]).join(targets, "target")
             .select("doc_id", "did", "tag", "target", "diagonals", "text", "passage"))

    def verify(batches):
        hasher = Hasher()
        for b in batches:
            got = [overlap(hasher.words(t)[0], hasher.words(x)[0], d, least_words, similarity)
                   for t, x, d in zip(lowered(b.column(5)), lowered(b.column(6)), b.column(4).to_pylist(), strict=True)]
            cols = [pa.array([g and g[k] for g in got], pa.int64()) for k in range(4)]
            share = pa.array([g and g[1] / g[0] for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], cols[0], cols[1], share, cols[2], cols[3]],
                                             names=["doc_id", "did", "tag", "target", "diagonals", *STRETCH])

    return pairs.mapInArrow(verify, "doc_id long, did long, tag long, target long, diagonals array<long>, words long, agreeing long, "
                                    "similarity double, doc_word long, item_word long")


def found_overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of a document and an item, links of a document and a passage (both with the row key ``did, tag``), and the
    passages' items ``(target, ik, at, item_id)``."""
    items = (benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
             .withColumn("ik", F.xxhash64("item_id", "text")))
    places = stored(item_places(items, least_words), "item-places")
    tests = stored(places.filter(F.col("kind") == SEED).select("target", "shared", "at", "seed").distinct(), "seeds")
    inside = places.filter(F.col("kind") == MEMBER)
    members = inside.select("target", "ik", "at").join(items.select("ik", "item_id"), "ik")
    spark = docs.sparkSession
    allowed = spark.sparkContext.broadcast(np.packbits(bitmap(tests)))
    rows = keyed(docs)

    def lengths_of(batches):
        hasher = Hasher()
        for b in batches:
            n = {len(hasher.words(t)[0]) for t in lowered(b.column(0))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(n), pa.int64())], names=["n"])

    longest = max(map(len, MASKS))
    lengths = [r.n for r in items.select("text").mapInArrow(lengths_of, "n long")
               .filter((F.col("n") >= SHORTEST) & (F.col("n") < longest)).distinct().orderBy("n").collect()]
    hits = document_seeds(rows, lengths, allowed).join(tests.withColumnRenamed("at", "item_at"), "seed")
    key = ["did", "tag", "target"]
    met = stored(hits.select(*key, "shared", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
                 .groupBy(*key, "shared").agg(F.collect_list("diagonal").alias("diagonals")), "seed-hits")
    texts_of = inside.groupBy("target").agg(F.min("text").alias("passage"))
    tried = stored(compared(met.filter("shared").drop("shared"), rows, texts_of, least_words, similarity), "passages-met")
    # a document that only touches a passage may overlap the items around it
    around = (tried.filter("words is null").select("did", "tag", "target", F.explode("diagonals").alias("d"))
              .join(members.select("target", "ik", "at"), "target").select("did", "tag", F.col("ik").alias("target"), (F.col("d") - F.col("at")).alias("d")))
    direct = met.filter("not shared").select(*key, F.explode("diagonals").alias("d"))
    met_items = stored(direct.unionByName(around).distinct().groupBy(*key).agg(F.collect_list("d").alias("diagonals")), "item-hits")
    whole = items.select(F.col("ik").alias("target"), F.col("text").alias("passage"))
    pairs = compared(met_items, rows, whole, least_words, similarity).filter("words is not null").join(
        items.select(F.col("ik").alias("target"), "item_id"), "target")
    return pairs, tried.filter("words is not null"), members


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns kept.  Rows are judged by their own text: of rows that repeat a
    doc_id only those with an overlap go.  An empty table stays empty."""
    pairs, links, _ = found_overlaps(docs, benchmark, **parameters)
    bad = stored(pairs.select("did", "tag").unionByName(links.select("did", "tag")).distinct(), "contaminated")
    return without_rows(docs, bad)
