"""Edit similarity ``2 * LCS(a, b) / (|a| + |b|)`` (insert/delete distance,
substitution costs 2), in code points; two empty strings have similarity 1.

Spark's ``levenshtein`` counts a substitution as 1 and is therefore a
different function.  The LCS length uses the bit-parallel recurrence of
Allison & Dix (1986) / Hyyrö (2004), ``V = (V + (V & M)) | (V & ~M)``, on 63 bits of uint64 words for many pairs
at once: a pair's shorter text lies along the bits of its words, and the longer one is read
as a wavefront, word w being w characters behind word 0, so that a word's carry into the next one is ready one step
later.  A step is a handful of numpy operations on a (words x pairs) matrix; the number of steps is the longest
text's length, and a pair costs |a| |b| / 63 word operations.  Pairs of a batch are ordered by length and
cut into groups of at most ``GROUP_CELLS`` matrix entries (a longer pair alone).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ctrltok.udfs import by_value

GROUP_CELLS = 1 << 18
#: Bits of a text in a word; the word's highest bit is the carry of the sum.
WORD = 63
ALL = np.uint64((1 << WORD) - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins (one more entry: the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _group_lcs(short: list[str], long: list[str]) -> np.ndarray:
    """LCS lengths of pairs; ``short[i]`` is not longer than ``long[i]``."""
    pairs = len(short)
    b, b0 = _codes(short)
    a, a0 = _codes(long)
    nb, na = np.diff(b0), np.diff(a0)
    words, steps = int(nb.max() + WORD - 1) // WORD, int(na.max())
    # match masks: one row per (pair, character of the short text), row 0 matches nothing
    pair_b, at_b = np.repeat(np.arange(pairs), nb), np.arange(len(b)) - np.repeat(b0[:-1], nb)
    keys, row = np.unique(pair_b << 21 | b, return_inverse=True)
    masks = np.zeros((len(keys) + 1) * words, np.uint64)
    cell = (row + 1) * words + at_b // WORD
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
    masks[cell[order][first]] = np.bitwise_or.reduceat(np.uint64(1) << (at_b % WORD).astype(np.uint64)[order], first)
    # the long texts as mask rows, a step in each line, with room for the wavefront at both ends
    key_a = np.repeat(np.arange(pairs), na) << 21 | a
    found = np.minimum(np.searchsorted(keys, key_a), len(keys) - 1)
    rows = np.zeros((steps + 2 * words, pairs), np.int64)
    rows[words + np.arange(len(a)) - np.repeat(a0[:-1], na), np.repeat(np.arange(pairs), na)] = np.where(keys[found] == key_a, found + 1, 0)
    rows *= words
    shape = (words, pairs)
    v, carry, top = np.full(shape, ALL), np.zeros((words + 1, pairs), np.uint64), np.uint64(WORD)
    cells, m, u = np.empty(shape, np.int64), np.empty(shape, np.uint64), np.empty(shape, np.uint64)
    lane = np.arange(words)[:, None]
    for t in range(steps + words - 1):
        np.add(rows[t + words:t:-1], lane, out=cells)
        np.take(masks, cells, out=m, mode="clip")
        np.bitwise_and(v, m, out=u)
        np.add(v, u, out=m)
        np.bitwise_xor(v, u, out=v)
        if words > 1:
            np.add(m, carry[:words], out=m)                 # word w's carry enters word w + 1 a step later
            np.right_shift(m, top, out=carry[1:])
        np.bitwise_or(v, m, out=v)
        np.bitwise_and(v, ALL, out=v)
    return np.bitwise_count(~v & ALL).sum(axis=0).astype(np.int64)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of the pairs ``(a[i], b[i])``."""
    out = np.zeros(len(a), np.int64)
    pairs = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = len(x)
        elif x and y:
            pairs.append((i, x, y) if len(x) <= len(y) else (i, y, x))
    pairs.sort(key=lambda p: (len(p[1]) // WORD, len(p[2])))
    lo = 0
    while lo < len(pairs):
        hi, words, steps = lo, 0, 0
        while hi < len(pairs):
            words, steps = max(words, len(pairs[hi][1]) // WORD + 1), max(steps, len(pairs[hi][2]))
            if hi > lo and (hi + 1 - lo) * (steps + 64 * words) > GROUP_CELLS:
                break
            hi += 1
        group = pairs[lo:hi]
        out[[p[0] for p in group]] = _group_lcs([p[1] for p in group], [p[2] for p in group])
        lo = hi
    return out


def similarities(a: list[str | None], b: list[str | None]) -> list[float | None]:
    """Edit similarity of the pairs; None where a side is None."""
    known = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    out: list[float | None] = [None] * len(a)
    found = lcs_lengths([a[i] for i in known], [b[i] for i in known])
    for i, n in zip(known, found.tolist(), strict=True):
        total = len(a[i]) + len(b[i])
        out[i] = 2.0 * n / total if total else 1.0
    return out


def lcs_length(a: str, b: str) -> int:
    return int(lcs_lengths([a], [b])[0])


def similarity(a: str | None, b: str | None) -> float | None:
    return similarities([a], [b])[0]


@F.pandas_udf(DoubleType())
def _edit_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(similarities(a.tolist(), b.tolist()), dtype="float64")


def edit_ratio(a, b) -> Column:
    """Symmetric edit similarity in [0, 1] (NULL if either side is NULL)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _edit_ratio_udf(a, b)


# Ship this module's UDF code with the UDF itself (pickle by value), so Python
# workers need only numpy/pandas, not an installed copy of this package.
by_value(__name__)
