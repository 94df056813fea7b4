"""Removal of repeated byte strings by prefix doubling over content-chosen positions.

A byte goes when some ``WIDTH``-byte string over it also starts earlier (smaller doc_id, or the same document,
earlier start).  Strings get names: the name of 2h bytes is made from the pair of names of the two h-byte halves, and
Spark groups and sorts positions by their names at growing lengths until a position is unique or past the
threshold:

1. Names of ``GRAM`` bytes.  Only positions whose name is the smallest (leftmost) inside some window of ``WIDTH`` bytes
   take part: equal windows choose the same position, so no repeat is lost, and about one position in 35 is shuffled.
   Positions whose name is unique drop out.
2. Names of the whole stretch of windows that chose a position (``WIDTH`` bytes and more).  Positions of equal stretches are
   settled at once: all but the first are repeats.  Groups with one stretch are done.
3. What is left, the first of every stretch in groups that differ around a common core, is compared window by
   window at ``WIDTH`` bytes.

Common passages: a map task settles repeats inside its own batch, so a batch sends each distinct
stretch once; groups of more than ``GROUP`` stretches are dealt by window name (two 64-bit hashes together) instead of by core,
and are streamed.  A core that stands in very many surroundings would still be sorted by one task: cores that look so in
a bounded sample of documents are dealt by core and stretch, and their windows by name, whatever their number.
The sample decides where rows go and nothing else.

Defined results: null and empty texts have no bytes; texts below ``WIDTH`` bytes stay whole; equal rows are one
document and get equal results; rows that repeat a doc_id with other text are separate documents, the smaller
text hash first; a null doc_id comes before every number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import SLICE_BYTES, as_long, keyed, stored, utf8
from ctrltok.udfs import by_value

by_value(__name__)

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM + 1
GROUP = 256
STEP, OTHER = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
U = np.uint64
NEVER = U(0xFFFFFFFFFFFFFFFF)
# a position in one long: the start of the first window, 7 + 7 bits of offsets
START, OFFSET = 14, 7
PLACE = ["did", "tag", "at"]
HELD = ["kh", "ch", *PLACE]
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LEAST = 20_000, 1 << 16, 8
# positions, and windows, that one step of a task sorts together
SETTLED_TOGETHER, WINDOWS_TOGETHER = 500_000, 250_000


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15) + b
    x ^= x >> U(29)
    x *= U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


def names(data: np.ndarray, width: int, salt: int = STEP) -> np.ndarray:
    """Name of the ``width`` bytes at every position, by doubling (the last pair may overlap); another odd ``salt`` gives
    independent names."""
    h = mixed((data.astype(np.uint64) + U(1)) * U(salt), np.full(len(data), salt, np.uint64))
    size = 1
    while size < width:
        step = min(size, width - size)
        h = mixed(h[:len(h) - step], h[step:]) if len(h) > step else h[:0]
        size += step
    return h


class Stretches:
    """Positions of a slice of texts with the windows that chose them."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def find(self, data: np.ndarray, ends: np.ndarray):
        """(first window, last window, position, its name, name of the stretch) as arrays; ``ends``: where each
        byte's text ends."""
        n = len(data)
        if n > len(self.up):
            size = max(n, SLICE_BYTES + 4 * WIDTH)
            self.up = np.cumprod(np.full(size, STEP, np.uint64))
            self.down = np.cumprod(np.full(size, pow(STEP, -1, 1 << 64), np.uint64))
        core = names(data, GRAM)
        low = np.where(np.arange(len(core)) + GRAM <= ends[:len(core)], core, NEVER)
        at = np.arange(len(low), dtype=np.int32)
        size = 1
        while size < SPAN and len(low):
            step = min(size, SPAN - size)
            if len(low) <= step:
                low = low[:0]
                break
            left = low[:-step] <= low[step:]
            at = np.where(left, at[:-step], at[step:])
            low = np.where(left, low[:-step], low[step:])
            size += step
        window = np.flatnonzero(np.arange(len(low)) + WIDTH <= ends[:len(low)])
        chosen = at[window].astype(np.int64)
        if not len(window):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        cut = np.flatnonzero(chosen[1:] != chosen[:-1])
        lo, hi, pos = window[np.r_[0, cut + 1]], window[np.r_[cut, len(window) - 1]], chosen[np.r_[0, cut + 1]]
        total = np.r_[U(0), np.cumsum((data.astype(np.uint64) + U(1)) * self.down[:n])]
        cover = (total[hi + WIDTH] - total[lo]) * self.up[lo]
        cover = mixed(cover, ((pos - lo) << OFFSET | (hi - lo)).astype(np.uint64))
        return lo, hi, pos, core[pos], np.maximum(cover, U(1))


def segments(data: list[bytes]):
    """(text index, offset, bytes) of pieces that together hold every window of every text once."""
    for i, t in enumerate(data):
        for lo in range(0, len(t) - WIDTH + 1, SLICE_BYTES):
            yield i, lo, t[lo:lo + SLICE_BYTES + WIDTH - 1]


def joined(data: list[bytes]):
    """Slices of segments: (text index and offset of each, joined bytes, end of each byte's segment, first byte of each)."""
    part, size = [], 0
    for s in segments(data):
        if part and size + len(s[2]) > SLICE_BYTES:
            yield flat(part)
            part, size = [], 0
        part.append(s)
        size += len(s[2])
    if part:
        yield flat(part)


def flat(part):
    sizes = np.array([len(s[2]) for s in part])
    ends = np.cumsum(sizes)
    return (np.array([s[0] for s in part]), np.array([s[1] for s in part]),
            np.frombuffer(b"".join(s[2] for s in part), np.uint8), np.repeat(ends, sizes), ends - sizes)


def repeats(keys: list[np.ndarray], place: list[np.ndarray]):
    """For rows sorted by (keys, place): (first of its key, repeat of an earlier place)."""
    n = len(place[0])
    first = np.ones(n, bool)
    if n:
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return first, np.logical_or.reduce([p != p[head] for p in place])


def spread(place: list[np.ndarray]) -> np.ndarray:
    """A key that only spreads rows."""
    did, tag, at = (p.astype(np.uint64) for p in place)
    return as_long(mixed(mixed(did, tag), at))


def batch(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()],
                                      names=list(columns))


def core_rows(rows: DataFrame, crowded=None) -> DataFrame:
    """``(kh, ch, did, tag, at, hot)`` of every chosen position.  Repeats inside the batch are settled: their ``ch`` is 0
    and ``kh`` only spreads them.  ``hot``: the core is among the broadcast ``crowded`` ones."""
    def run(batches):
        finder = Stretches()
        for b in batches:
            dids, tags, data = b.column(0).to_numpy(), b.column(1).to_numpy(), utf8(b.column(2))
            parts = []
            for text, offset, joint, ends, start in joined(data):
                lo, hi, pos, kh, ch = finder.find(joint, ends)
                s = np.searchsorted(start, lo, side="right") - 1
                first = lo - start[s] + offset[s]
                own = text[s]
                at = first << START | (pos - lo) << OFFSET | (hi - lo)
                parts.append((as_long(kh), as_long(ch), dids[own], tags[own], at))
                if sum(len(p[0]) for p in parts) > SETTLED_TOGETHER:
                    yield from settle(parts)
                    parts = []
            if parts:
                yield from settle(parts)

    def settle(parts):
        kh, ch, *place = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.lexsort((*reversed(place), ch, kh))
        kh, ch, place = kh[o], ch[o], [x[o] for x in place]
        first, later = repeats([kh, ch], place)
        known = crowded.value if crowded is not None else np.zeros(0, np.int64)
        for lo in range(0, len(kh), 1 << 17):
            s = slice(lo, lo + (1 << 17))
            f, r = first[s], later[s] & ~first[s]
            take = f | r
            here = [x[s][take] for x in place]
            k, f = kh[s][take], f[take]
            hot = f & (known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k) if len(known) else np.zeros(len(k), bool)
            yield batch({"kh": np.where(f, k, spread(here)), "ch": np.where(f, ch[s][take], 0), **dict(zip(PLACE, here, strict=True)), "hot": hot})

    return rows.select("did", "tag", "text").mapInArrow(run, "kh long, ch long, did long, tag long, at long, hot boolean")


def crowded_cores(rows: DataFrame) -> list[int]:
    """Cores with very many surroundings, judged by a sample of at most about ``SAMPLE_DOCS`` documents of bounded length: the
    list is bounded too.  Only the dealing of rows depends on it."""
    every = max(1, -(-rows.count() // SAMPLE_DOCS))
    sample = rows.filter((F.pmod(F.xxhash64("tag", "did"), F.lit(every)) == 0) & (F.octet_length("text") <= SAMPLE_BYTES))
    seen = core_rows(sample).filter("ch != 0").select("kh", "ch").distinct().groupBy("kh").agg(F.count("*").alias("n"))
    return [r.kh for r in seen.filter(F.col("n") >= max(SAMPLE_LEAST, GROUP // every)).collect()]


SETTLED, OPEN, OPEN_LARGE = 1, 2, 3


def rank_cores(batches):
    """Stream rows sorted by (settled last, kh, ch, place).

    Yields ``kind, kh, did, tag, at``: repeats of a stretch are settled; the first of every stretch stays open when its
    core is hot or has other stretches.  At most ``GROUP`` firsts of the core at hand are held."""
    key = None
    head = None  # (ch, did, tag, at) of the stretch at hand
    held: list[list[np.ndarray]] = []
    count, large = 0, False

    def rows(kind, kh, place):
        return batch({"kind": np.full(len(place[0]), kind, np.int32),
                      "kh": np.full(len(place[0]), kh, np.int64) if np.isscalar(kh) else kh, **dict(zip(PLACE, place, strict=True))})

    def let_go():
        if held and (count > 1 or large):
            yield rows(OPEN_LARGE if large else OPEN, key, [np.concatenate(x) for x in zip(*held, strict=True)])

    for b in batches:
        kh, ch, *place, hot = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        done = ch == 0
        if done.any():
            yield rows(SETTLED, np.zeros(int(done.sum()), np.int64), [x[done] for x in place])
            kh, ch, hot, place = kh[~done], ch[~done], hot[~done], [x[~done] for x in place]
        if not len(kh):
            continue
        new_core = np.r_[True, kh[1:] != kh[:-1]]
        first = new_core | np.r_[True, ch[1:] != ch[:-1]]
        if key is not None and kh[0] == key:
            new_core[0] = False
            first[0] = ch[0] != head[0]
        start = np.maximum.accumulate(np.where(first, np.arange(len(kh)), -1))
        same = np.where(start >= 0, np.logical_and.reduce([x == x[start] for x in place]), False)
        if start[0] < 0:
            same |= (start < 0) & np.logical_and.reduce([x == h for x, h in zip(place, head[1:], strict=True)])
        late = ~first & ~same
        if late.any():
            yield rows(SETTLED, np.zeros(int(late.sum()), np.int64), [x[late] for x in place])
        where = np.flatnonzero(first)
        if len(where):
            i = int(where[-1])
            head = (ch[i], *(x[i] for x in place))
        fk, fh, fp = kh[where], hot[where], [x[where] for x in place]
        cuts = np.flatnonzero(new_core[where])
        # firsts that still belong to the core at hand
        n0 = int(cuts[0]) if len(cuts) else len(where)
        if n0:
            count += n0
            held.append([x[:n0] for x in fp])
            if large or count > GROUP:
                large = True
                yield from let_go()
                held = []
        if len(cuts):
            yield from let_go()
            bounds = np.r_[cuts, len(where)]
            sizes = np.diff(bounds)
            group = np.repeat(np.arange(len(sizes)), sizes)
            closed = group < len(sizes) - 1
            wide = (sizes > GROUP) | fh[cuts]
            for kind, pick in ((OPEN, (sizes > 1) & ~wide), (OPEN_LARGE, wide)):
                take = closed & pick[group]
                if take.any():
                    yield rows(kind, fk[n0:][take], [x[n0:][take] for x in fp])
            key, count, large = fk[-1], int(sizes[-1]), bool(wide[-1])
            held = [[x[bounds[-2]:] for x in fp]]
            if large:
                yield from let_go()
                held = []
    yield from let_go()


def packed(rows: DataFrame) -> DataFrame:
    """``doc_id, did, tag`` and the text compressed for the shuffle."""
    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress(t) for t in utf8(b.column(2))], pa.binary())],
                                             names=["did", "tag", "body"])

    return rows.select("did", "tag", "text").mapInArrow(run, "did long, tag long, body binary")


def open_windows(bodies: DataFrame, asked: DataFrame) -> DataFrame:
    """Bytes of the open stretches, ``(large, key, alt, did, tag, at, cover)``: under their core, or in large groups one row per
    window under two names of the window.  Repeats among a batch's windows are settled (``key`` spreads, ``cover`` empty)."""
    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple[int, int, int, int, bytes]] = []
            wide: list[tuple[np.ndarray, ...]] = []
            windows = 0
            for did, tag, body, places, cores in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                data = inflate.decompress(body)
                for place, kh in zip(places, cores, strict=True):
                    at = place if place >= 0 else ~place
                    lo, n = at >> START, at & 127
                    cover = data[lo:lo + n + WIDTH]
                    if place >= 0:
                        out.append((kh, did, tag, at, cover))
                    else:
                        raw = np.frombuffer(cover, np.uint8)
                        name = names(raw, WIDTH)
                        wide.append((as_long(mixed(np.full(len(name), kh & (1 << 64) - 1, np.uint64), name)), as_long(names(raw, WIDTH, OTHER)),
                                     np.full(len(name), did), np.full(len(name), tag), (lo + np.arange(len(name))) << START))
                        windows += len(name)
                if len(out) > 20_000:
                    yield small(out)
                    out = []
                if windows > WINDOWS_TOGETHER:
                    yield from large(wide)
                    wide, windows = [], 0
            if out:
                yield small(out)
            if wide:
                yield from large(wide)

    def small(out):
        column = lambda i: pa.array([x[i] for x in out], pa.int64())
        return batch({"large": pa.array([False] * len(out)), "key": column(0), "alt": pa.array(np.zeros(len(out), np.int64)),
                      "did": column(1), "tag": column(2), "at": column(3), "cover": pa.array([x[4] for x in out], pa.binary())})

    def large(wide):
        key, alt, *place = (np.concatenate(x) for x in zip(*wide, strict=True))
        o = np.lexsort((*reversed(place), alt, key))
        key, alt, place = key[o], alt[o], [x[o] for x in place]
        first, later = repeats([key, alt], place)
        take = first | later
        settled = (later & ~first)[take]
        # a settled window has an empty cover, an open one none
        cover = pa.array([b"" if s else None for s in settled], pa.binary())
        yield batch({"large": pa.array(np.ones(len(settled), bool)), "key": np.where(later & ~first, spread(place), key)[take], "alt": alt[take],
                     **{n: x[take] for n, x in zip(PLACE, place, strict=True)}, "cover": cover})

    per_text = (asked.withColumn("place", F.when(F.col("kind") == OPEN, F.col("at")).otherwise(F.bitwise_not("at")))
                .groupBy("did", "tag").agg(F.collect_list("place").alias("places"), F.collect_list("kh").alias("cores")))
    return bodies.join(per_text, ["did", "tag"]).select("did", "tag", "body", "places", "cores").mapInArrow(
        run, "large boolean, key long, alt long, did long, tag long, at long, cover binary")


def repeated_windows(batches):
    """Stream windows sorted by (large, key, alt, place); yields ``(did, tag, piece)`` of windows that start earlier elsewhere."""
    keep = None  # rows of the small key at hand
    last = None  # (key, alt, did, tag, at) of the first row of the large key at hand

    def runs(did, tag, at):
        o = np.lexsort((at, tag, did))
        did, tag, start = did[o], tag[o], at[o] >> START
        begin = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)][:len(did)])
        size = np.diff(np.r_[begin, len(did)])
        # a piece's length has 8 bits: cut long runs
        parts = [(i + j, min(100, n - j)) for i, n in zip(begin, size, strict=True) for j in range(0, n, 100)]
        i = np.array([x[0] for x in parts], np.int64)
        length = np.array([x[1] + WIDTH - 1 for x in parts], np.int64)
        return batch({"did": did[i], "tag": tag[i], "piece": start[i] << 8 | length})

    def compare(key, did, tag, at, covers):
        sizes = np.array([len(c) for c in covers])
        n = sizes - WIDTH + 1
        data = np.frombuffer(b"".join(covers), np.uint8)
        begin = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        name = names(data, WIDTH)[begin[row] + shift]
        k, place = key[row], [did[row], tag[row], (at[row] >> START) + shift << START]
        o = np.lexsort((*reversed(place), name, k))
        place = [x[o] for x in place]
        first, later = repeats([k[o], name[o]], place)
        return runs(*(x[later & ~first] for x in place))

    for b in batches:
        large = b.column(0).to_numpy(zero_copy_only=False)
        key, alt, did, tag, at = (b.column(i).to_numpy() for i in range(1, 6))
        if not large.all():
            m = int((~large).sum())
            covers = b.column(6).slice(0, m).to_pylist()
            own = [key[:m], did[:m], tag[:m], at[:m], covers]
            if keep:
                own = [*(np.r_[k, x] for k, x in zip(keep[:4], own[:4], strict=True)), keep[4] + covers]
            k = own[0]
            end = len(k) if large.any() else int(np.searchsorted(k, k[-1]))
            lo = 0
            while lo < end:
                # slices of whole keys
                hi = min(end, lo + 8192)
                while hi < end and k[hi] == k[hi - 1]:
                    hi += 1
                yield compare(*(x[lo:hi] for x in own))
                lo = hi
            keep = [x[end:] for x in own] if end < len(k) else None
        if large.any():
            if keep:
                yield compare(*keep)
                keep = None
            columns = [x[large] for x in (key, alt, did, tag, at)]
            settled = b.column(6).filter(pa.array(large)).is_valid().to_numpy(zero_copy_only=False)
            if settled.any():
                yield runs(*(x[settled] for x in columns[2:]))
            columns = [x[~settled] for x in columns]
            if len(columns[0]):
                if last is not None and last[:2] == (columns[0][0], columns[1][0]):
                    columns = [np.r_[h, x] for h, x in zip(last, columns, strict=True)]
                first, later = repeats(columns[:2], columns[2:])
                yield runs(*(x[later & ~first] for x in columns[2:]))
                i = int(np.flatnonzero(first)[-1])
                last = tuple(x[i] for x in columns)
    if keep:
        yield compare(*keep)


def repeated_pieces(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """``did, tag, piece``: stretches of bytes that go, as ``start << 8 | length``."""
    crowded = rows.sparkSession.sparkContext.broadcast(np.sort(np.array(crowded_cores(rows), np.int64)))
    deal = F.when(F.col("hot"), F.xxhash64("kh", "ch")).otherwise(F.col("kh"))
    cores = (core_rows(rows, crowded).repartition(deal).sortWithinPartitions((F.col("ch") == 0).cast("int"), *HELD)
             .mapInArrow(rank_cores, "kind int, kh long, did long, tag long, at long"))
    ranked = stored(cores, "cores")
    settled = ranked.filter(F.col("kind") == SETTLED).select(
        "did", "tag", F.expr(f"shiftleft(shiftright(at, {START}), 8) | ((at & 127) + {WIDTH})").alias("piece"))
    windows = (open_windows(bodies, ranked.filter(F.col("kind") != SETTLED)).repartition("key")
               .sortWithinPartitions("large", "key", "alt", *PLACE)
               .mapInArrow(repeated_windows, "did long, tag long, piece long"))
    return settled.union(windows)


def cut(data: bytes, pieces) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, remaining bytes)."""
    if not len(pieces):
        return 0, 0, data
    x = np.asarray(pieces, np.int64)
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, x >> 8, 1)
    np.add.at(step, (x >> 8) + (x & 255), -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row; ``kept`` are the remaining bytes."""
    rows = keyed(docs)
    bodies = packed(rows)
    pieces = repeated_pieces(rows, bodies).groupBy("did", "tag").agg(F.collect_list("piece").alias("pieces"))

    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                data = [inflate.decompress(x) for x in part.column(1).to_pylist()]
                done = [cut(t, p or []) for t, p in zip(data, part.column(2).to_pylist(), strict=True)]
                dids = [None if d == -(1 << 63) else d for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dids, pa.int64()), pa.array([len(t) for t in data], pa.int64()), pa.array([x[0] for x in done], pa.int64()),
                     pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return bodies.join(pieces, ["did", "tag"], "left").select("did", "body", "pieces").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    return without_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
