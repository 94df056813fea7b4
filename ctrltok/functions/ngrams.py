"""N-gram multisets of token arrays, compared inside the row.

Rows of an Arrow batch are counted together, up to ``GROUP_TOKENS`` tokens at a time: tokens become numbers (dictionary encoding), an n-gram's number is that of the
pair (its first n-1 tokens' number, last token), both exact, and one sort of ``(row, gram)`` gives every row's
sorted multisets of all texts merged.  Only the sums a metric needs leave the row; no gram ever becomes a
row or a string.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.udfs import bounded_ranges, by_value

#: Tokens of the rows that are counted together (a longer row alone).
GROUP_TOKENS = 1 << 16


def _counts(arrays: list[pa.ListArray], max_n: int):
    """For n = 1..max_n ``(row, counts)``: the row of every distinct (row, n-gram) and its count in each of the arrays."""
    flat = pa.concat_arrays([a.flatten() for a in arrays]).dictionary_encode().indices
    codes = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    sizes = [a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays]
    rows = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    ends = np.repeat(np.cumsum(np.concatenate(sizes)), np.concatenate(sizes))
    sides = np.repeat(np.arange(len(arrays)), [int(s.sum()) for s in sizes])
    width = int(codes.max(initial=0)) + 1
    # the n-grams that lie inside one text by their first token's place, and their numbers
    places, numbers = np.arange(len(codes)), codes
    for n in range(1, max_n + 1):
        if n > 1:
            inside = places + n - 1 < ends[places]
            places = places[inside]
            _, numbers = np.unique(numbers[inside] * width + codes[places + n - 1], return_inverse=True)
        key = rows[places] * (int(numbers.max(initial=0)) + 1) + numbers
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        yield rows[places][first], [np.bincount(which[sides[places] == s], minlength=len(first)) for s in range(len(arrays))]


def gram_sums(df: DataFrame, key: str, columns: list[str], measures: Callable, names: list[str], max_n: int) -> DataFrame:
    """``key`` and one DOUBLE column ``<name><n>`` per name and order: for every row the sums over its distinct n-grams of
    ``measures(*counts)`` (one array per name, from the gram's counts in each token column)."""
    fields = [f"{x}{n}" for n in range(1, max_n + 1) for x in names]

    def run(batches):
        for b in batches:
            lists = [b.column(1 + i) for i in range(len(columns))]
            sizes = sum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in lists)
            for lo, hi in bounded_ranges(sizes, GROUP_TOKENS):
                out = []
                for row, counts in _counts([a.slice(lo, hi - lo) for a in lists], max_n):
                    out += [pa.array(np.bincount(row, weights=np.asarray(m, np.float64), minlength=hi - lo).astype(np.float64)) for m in measures(*counts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *out], names=[key, *fields])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, *[F.col(c) for c in columns]).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{f} double" for f in fields)]))


by_value(__name__)
