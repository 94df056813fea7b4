"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and at least ``max(6, 4 q)`` words that no
neighbouring word extends.  Words are the maximal ``[^\\x20\\x09-\\x0D]+`` of a text, numbered from 0.

Spark deals the documents out; a task lays the words of a slice of documents in one array (a symbol is a
document and a word, so nothing matches across documents) and

* names the words at every position by prefix doubling: equal names at level k, equal 2**k words.  The names
  are the first suffix-array slots of their group, so every group is an interval of the suffix array, and two names
  tables give the longest common extension of two positions to the right and to the left;
* builds a wavelet matrix over the suffix array (only slots whose two words occur again);
* asks for every block of 2**k words at a multiple of 2**k for its occurrences in the neighbouring window
  (``4 * 2**k / 3`` words): range successor in the block's interval.  Occurrences at most half a block apart
  form one progression, which is skipped in one step.  The first difference, the offsets of single occurrences, and the
  offsets that align the two ends of later progressions with those of the first are the candidate periods;
* extends every candidate to both sides and keeps the runs, the smallest period for each stretch.

A run with period q contains a block of at least (2 q + 1) / 3 words at the level that is responsible for q together
with its copy q words on, and q is then among the candidates, so the result is exact (tested against brute force).
Work is O(n log n) for n words, whatever the text; memory is a few integers per word and level of one slice of
documents, or of one longer document.

Defined results: null or empty text has no words and no runs; a null doc_id counts as the empty string where
digits of the id are used; repeated rows get equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ctrltok.llm.common import slices, texts, utf8
from ctrltok.udfs import by_value

by_value(__name__)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_words(rows: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of the rows, and the number of the first word of every row (one more entry: all words)."""
    raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    space = SPACE[raw]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    offsets = np.r_[0, np.cumsum(ends - begins)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space].tobytes())])
    limits = np.cumsum([0] + [len(r) + 1 for r in rows])
    return words, np.searchsorted(begins, limits).astype(np.int64)


class Names:
    """Names of 2**k symbols at every position, the suffix array, and longest common extensions."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        sa = np.argsort(symbols, kind="stable").astype(np.int32)
        ordered = symbols[sa]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        rank = np.empty(n, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        self.levels, size = [rank], 1
        while True:
            open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
            if not len(open_):
                break
            at = sa[open_]
            after = at.astype(np.int64) + size
            second = np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            pair = rank[at].astype(np.int64) * (n + 1) + second
            order = np.argsort(pair)
            sa[open_], pair = at[order], pair[order]
            new[open_] = first = np.r_[True, pair[1:] != pair[:-1]]
            rank = rank.copy()
            rank[sa[open_]] = np.maximum.accumulate(np.where(first, open_, 0))
            self.levels.append(rank)
            size *= 2
        self.sa = sa

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from ``i`` and from ``j > i`` on."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            name, size = self.levels[k], 1 << k
            same = j + size <= self.n
            same &= name[np.minimum(i, self.n - 1)] == name[np.minimum(j, self.n - 1)]
            i += same * size
            j += same * size
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols right before ``i`` and right before ``j > i``."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            name, size = self.levels[k], 1 << k
            same = i >= size
            same &= name[np.maximum(i - size, 0)] == name[np.maximum(j - size, 0)]
            i -= same * size
            j -= same * size
        return start - i


class Wavelet:
    """Wavelet matrix over a sequence of distinct numbers: the smallest number from ``x`` on in a range of places."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for b in range(bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers at places [lo, hi) are smaller than ``x``."""
        found = np.zeros(len(lo), np.int64)
        for k, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - k) & 1).astype(bool)
            zlo, zhi = zeros[lo], zeros[hi]
            found += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, zeros[-1] + lo - zlo, zlo), np.where(one, zeros[-1] + hi - zhi, zhi)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of rank ``k`` (from 0, ``k < hi - lo``) among those at places [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            zlo, zhi = zeros[lo], zeros[hi]
            one = k >= zhi - zlo
            k = np.where(one, k - (zhi - zlo), k)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, zeros[-1] + lo - zlo, zlo), np.where(one, zeros[-1] + hi - zhi, zhi)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest number >= ``x`` at places [lo, hi), -1 where there is none."""
        rank = self.below(lo, hi, x)
        out = np.full(len(lo), -1, np.int64)
        some = np.flatnonzero(rank < hi - lo)
        out[some] = self.smallest(lo[some], hi[some], rank[some])
        return out


def block_candidates(names: Names, tree: Wavelet, place: np.ndarray, k: int):
    """``(positions, distances)`` of candidate periods from the blocks of 2**k symbols."""
    size = 1 << k
    name = names.levels[k]
    s = np.arange(0, names.n - size + 1, size, dtype=np.int64)
    lo = name[s].astype(np.int64)
    hi = lo + np.bincount(name, minlength=names.n)[lo]
    again = hi - lo > 1
    s, lo, hi = s[again], place[lo[again]], place[hi[again]]
    reach = (4 * size - 1) // 3
    x, last = s + 1, s.copy()
    period = np.zeros(len(s), np.int64)
    begin, end = s.copy(), s.copy()                         # of the first progression's stretch, where the period is known
    out = []
    while len(s):
        o = tree.successor(lo, hi, x)
        go = (o >= 0) & (o - s <= reach)
        s, lo, hi, x, last, period, begin, end, o = (v[go] for v in (s, lo, hi, x, last, period, begin, end, o))
        if not len(s):
            break
        near = o - last <= size // 2                        # the block has this period: last .. o belong to one progression
        learnt = near & (period == 0)
        period[learnt] = (o - last)[learnt]
        if learnt.any():
            begin[learnt], end[learnt] = stretch(names, s[learnt], period[learnt])
        out.append((s, o - s))
        at = np.where(near, last, o)
        x, last = o + 1, o.copy()
        known = np.flatnonzero(period)
        if len(known):
            b, e = stretch(names, at[known], period[known])
            out += [(s[known], e - end[known]), (s[known], b - begin[known])]
            x[known] = e - size + 1
            last[known] = at[known] + (e - size - at[known]) // period[known] * period[known]
    return out


def stretch(names: Names, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest stretch around ``at`` with this period."""
    return at - names.left(at, at + period), at + period + names.right(at, at + period)


def find_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(symbols) < LEAST_WORDS:
        return none, none, none
    names = Names(symbols)
    if len(names.levels) < 2:
        return none, none, none
    again = np.bincount(names.levels[1], minlength=names.n)[names.levels[1]] > 1
    again = again[names.sa]
    place = np.r_[0, np.cumsum(again)]
    tree = Wavelet(names.sa[again].astype(np.int64), names.n.bit_length())
    found = [c for k in range(1, len(names.levels)) for c in block_candidates(names, tree, place, k)]
    s = np.concatenate([c[0] for c in found] or [none])
    q = np.concatenate([c[1] for c in found] or [none])
    good = (q > 0) & (s + q < names.n)
    packed = np.unique(s[good] * names.n + q[good])
    s, q = packed // names.n, packed % names.n
    start, end = stretch(names, s, q)
    good = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, end, q = start[good], end[good], q[good]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def repeated(number: int, n: int) -> np.ndarray | None:
    """The edit for tests and queries: which of ``n`` words stands at every place, None where nothing changes.
    A tenth of all ``number`` (crc32 of ids) gets its text's end replaced by copies of its first part."""
    g = number // 10
    if number % 10 or not n:
        return None
    a = g % n
    place = np.arange(n)
    place[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


def slice_runs(rows: list[bytes], ids: list, edited: bool):
    """``(first run of every row, start, length, period, kept words of every row joined by a space)``."""
    words, first = split_words(rows)
    n = len(words)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    word = np.arange(n)
    if edited:
        for r, i in enumerate(ids):
            place = repeated(zlib.crc32(b"" if i is None else str(i).encode()), int(first[r + 1] - first[r]))
            if place is not None:
                word[first[r]:first[r + 1]] = first[r] + place
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[word]
    start, length, period = find_runs(row * max(1, len(coded.dictionary)) + codes)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change[:n]) == 0)
    offsets = np.searchsorted(kept, first).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(word[kept])))
    return np.searchsorted(start, first), start - first[row[start]] if len(start) else start, length, period, pc.binary_join(lists, b" ")


def run_lists(docs: DataFrame, edited: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: all runs by start, then period, and the words outside the
    repeats joined by a space (a word is dropped if any run contains it after its first period)."""
    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), utf8(b.column(1))
            for lo, hi in slices([len(r) for r in rows]):
                first, start, length, period, kept = slice_runs(rows[lo:hi], ids[lo:hi], edited)
                runs = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (start, length, period)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), runs), kept.cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def summary(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """Number of runs, the longest one (start, length, period, thousandths of its exponent), digest of all runs."""
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(start, length, period, strict=True)).encode()).hexdigest()
    if not len(start):
        return 0, None, None, None, None, digest
    k = np.lexsort((period, start, -length))[0]
    return len(start), int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k]), digest


def digests(docs: DataFrame, edited: bool = True) -> DataFrame:
    """Number of runs, longest run, and digests of the runs and of the collapsed text, for every row."""
    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), utf8(b.column(1))
            for lo, hi in slices([len(r) for r in rows]):
                first, start, length, period, kept = slice_runs(rows[lo:hi], ids[lo:hi], edited)
                done = [summary(*(v[i:j] for v in (start, length, period))) for i, j in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *[pa.array([d[c] for d in done], pa.int64()) for c in range(5)],
                     pa.array([d[5] for d in done]), pa.array([hashlib.sha256(k).hexdigest() for k in utf8(kept)])],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                       "runs_sha256 string, collapsed_sha256 string")
