"""Frequency statistic of a text from its own row: rank dictionary, sorted log ranks, interpolated quantile.

The rank table travels with the tasks as a dictionary, so a text's statistic needs no explode, no join and no
aggregation: it works in a projection, also of a stream.  The dictionary's size is checked when it is loaded; beyond
the bound :func:`ctrltok.operators.features.frequency_stats` with the rank table as a DataFrame is the way, or a
a rank head: the quantile lies between two order statistics of the ranks, and where both are ranks that the head holds, the
words that it lacks need not be looked up, since their ranks are larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ctrltok.udfs import bounded_ranges, by_value, shared

#: Bounds of a rank dictionary.
MOST_WORDS = 1 << 22
MOST_BYTES = 1 << 27
#: Bounds of a rank head.
HEAD_WORDS = 1 << 21
HEAD_BYTES = 1 << 26
#: Words that are hashed together, and tokens that are looked up together (a longer text alone).
SLICE_WORDS = 1 << 16
SLICE_TOKENS = 1 << 17


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


class RankDictionary:
    """Words and ranks by language, and the vocabulary sizes.  A language's words are ordered by a 64-bit hash: a look-up is a
    binary search and a comparison of the words themselves, so it needs no memory that grows with the dictionary."""

    def __init__(self, table: pa.Table):
        self.langs: dict[str, tuple[np.ndarray, pa.Array, np.ndarray]] = {}
        self.equal_hashes: dict[str, int] = {}
        codes = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else None
        for k, lang in enumerate(codes.dictionary.to_pylist() if codes is not None else []):
            own = table.filter(pc.equal(codes.indices, k))
            self._put(lang, own.column("word").combine_chunks().cast(pa.string()), own.column("rank").to_numpy())

    def _put(self, lang: str, words: pa.Array, ranks: np.ndarray):
        hashes = np.concatenate([_hashes(words.slice(lo, SLICE_WORDS)) for lo in range(0, len(words), SLICE_WORDS)])
        order = np.argsort(hashes, kind="stable")
        hashes, ranks = hashes[order], ranks.astype(np.float64)[order]
        self.langs[lang] = hashes, words.take(pa.array(order)), ranks
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        self.equal_hashes[lang] = int(np.diff(np.r_[starts, len(hashes)]).max())

    def vocabulary(self, lang: str) -> int:
        return len(self.langs[lang][2])

    def log_ranks(self, words: pa.Array, lang: str) -> np.ndarray:
        """``ln(rank + 1)`` of every word, ``ln(vocabulary + 1)`` for unknown ones."""
        return np.log(self.find(words, lang, float(self.vocabulary(lang))) + 1.0)

    def find(self, words: pa.Array, lang: str, unknown: float) -> np.ndarray:
        """The rank of every word, ``unknown`` for unknown ones."""
        hashes, known, ranks = self.langs[lang]
        codes = words.dictionary_encode()
        distinct, found = codes.dictionary, np.full(len(codes.dictionary), unknown)
        first = np.searchsorted(hashes, _hashes(distinct))
        missing = np.ones(len(distinct), bool)
        for k in range(self.equal_hashes[lang]):
            at = np.minimum(first + k, len(known) - 1)
            same = pc.equal(known.take(pa.array(at)), distinct).fill_null(False).to_numpy(zero_copy_only=False) & missing
            found[same] = ranks[at[same]]
            missing &= ~same
        return np.append(found, unknown)[codes.indices.fill_null(len(distinct)).to_numpy(zero_copy_only=False)]


class HeadWords(RankDictionary):
    """The most frequent words of some languages: all words up to some rank.  ``vocabularies`` has the number of words of every
    language, held here or not; of a language in ``whole`` no word is left out.  A word that is not held has a larger rank than
    those held, or none, which counts as the vocabulary's size: ranks beyond that size must be left out too."""

    def __init__(self, vocabularies: dict[str, int], whole: set[str]):
        self.langs, self.equal_hashes, self.vocabularies, self.whole = {}, {}, vocabularies, whole

    def vocabulary(self, lang: str) -> int:
        return self.vocabularies[lang]

    def ranks_of(self, words: pa.Array, lang: str) -> np.ndarray:
        """The rank of every word; infinite where only the table knows it."""
        unknown = float(self.vocabulary(lang)) if lang in self.whole else np.inf
        return self.find(words, lang, unknown) if lang in self.langs else np.full(len(words), unknown)


class RankHead(NamedTuple):
    """What the driver keeps of the head words: how a worker opens them, and whose words they are."""

    opened: Callable[[], HeadWords]
    vocabularies: dict[str, int]
    whole: set[str]


class TooManyRanks(ValueError):
    """The rank table exceeds the bounds of a dictionary."""


def load_ranks_dictionary(ranks: DataFrame, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> RankDictionary:
    """The dictionary of a rank table ``(lang, word, rank)``; a larger one than the bounds is refused, by its size and before any
    of it is fetched."""
    size = F.length(F.encode("word", "utf-8")) + F.length(F.encode("lang", "utf-8")) + 16
    n, total = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n > most_words or total > most_bytes:
        raise TooManyRanks(f"the rank table exceeds {most_words} words or {most_bytes} bytes: join it instead")
    return RankDictionary(ranks.select("lang", "word", F.col("rank").cast("long").alias("rank")).toArrow())


def load_rank_head(ranks: DataFrame, langs: Iterable[str] | None = None, most_words: int = HEAD_WORDS, most_bytes: int = HEAD_BYTES) -> RankHead:
    """The head of a rank table ``(lang, word, rank)`` with one row per language and word and ranks from 0: of the given languages
    (else of all) the ranks below the largest power of two whose words keep the bounds, found by their sizes before any word is fetched."""
    size = F.length(F.encode("word", "utf-8")) + F.length(F.encode("lang", "utf-8")) + 16
    sizes = ranks.where("lang is not null").groupBy("lang", F.length(F.bin("rank")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()          # 65 rows per language at most
    vocabularies = {r["lang"]: 0 for r in sizes}
    for r in sizes:
        vocabularies[r["lang"]] += r["n"]
    wanted = set(vocabularies) if langs is None else set(langs) & set(vocabularies)
    by_bits = [(b, [r for r in sizes if r["lang"] in wanted and r["bits"] == b]) for b in sorted({r["bits"] for r in sizes if r["bits"]})]
    kept, words, total = 0, 0, 0
    for b, rows in by_bits:
        words, total = words + sum(r["n"] for r in rows), total + sum(r["bytes"] or 0 for r in rows)
        if words > most_words or total > most_bytes:
            break
        kept = b
    whole = {lang for lang in wanted if all((r["bits"] or 0) <= kept for r in sizes if r["lang"] == lang)}
    words = HeadWords(vocabularies, whole)
    for lang in sorted(wanted):
        held = ranks.where((F.col("lang") == lang) & F.col("word").isNotNull() & (F.length(F.bin("rank")) <= kept))
        table = (held if lang in whole else held.where(F.col("rank") <= vocabularies[lang])).select("word", F.col("rank").cast("long").alias("rank")).toArrow()
        if table.num_rows:
            words._put(lang, table.column("word").combine_chunks().cast(pa.string()), table.column("rank").to_numpy())
        del table
    head = RankHead(shared(words), vocabularies, whole)
    del words                       # the broadcast has them
    pa.default_memory_pool().release_unused()
    return head


def neighbours(values: np.ndarray, sizes: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """The two values of every group of consecutive values between which its quantile lies; NaN for an empty one."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    ordered = values[np.lexsort((values, row))]
    begin, some, place = np.cumsum(sizes) - sizes, sizes > 0, (sizes - 1) * q
    low, high = np.full(len(sizes), np.nan), np.full(len(sizes), np.nan)
    low[some] = ordered[(begin + np.floor(place))[some].astype(np.int64)]
    high[some] = ordered[(begin + np.ceil(place))[some].astype(np.int64)]
    return low, high


def quantiles(values: np.ndarray, sizes: np.ndarray, q: float) -> np.ndarray:
    """Linearly interpolated quantile of every group of consecutive values; NaN for an empty one."""
    a, b = neighbours(values, sizes, q)
    place = (sizes - 1) * q
    return np.where(a == b, a, (np.ceil(place) - place) * a + (place - np.floor(place)) * b)


def rank_quantile(dictionary: RankDictionary, quantile: float = 0.75):
    """``(admitted tokens, lang) -> statistic``: NULL for a language without ranks, the out-of-vocabulary value for a text
    without tokens."""
    held = shared(dictionary)

    @F.arrow_udf(DoubleType())
    def run(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        known, codes = held(), lang.dictionary_encode()
        place = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.full(len(tokens), np.nan)
        for k, code in enumerate(codes.dictionary.to_pylist()):
            if code in known.langs:
                rows = np.flatnonzero(place == k)
                for lo, hi in bounded_ranges(sizes[rows], SLICE_TOKENS):
                    at = rows[lo:hi]
                    found = quantiles(known.log_ranks(tokens.take(pa.array(at)).flatten().cast(pa.string()), code), sizes[at], quantile)
                    out[at] = np.where(sizes[at] > 0, found, np.log(known.vocabulary(code) + 1.0))
        return pa.array(out, mask=np.isnan(out))

    def apply(tokens: Column, lang: Column) -> Column:
        x = run(tokens, lang)
        return F.when(~F.isnan(x), x)

    return apply


#: What :func:`rank_neighbours` returns: the ranks around the quantile, their weights, the rank of a word that is in no table.
LOW, HIGH, LOW_WEIGHT, HIGH_WEIGHT, UNKNOWN = range(5)


def rank_neighbours(head: RankHead, quantile: float = 0.75):
    """``(admitted tokens, lang) -> array`` of the ranks around the quantile (infinite: the head does not decide them) and what
    :func:`log_quantile` needs; NULL for a language without ranks."""
    opened = head.opened

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        known, codes = opened(), lang.dictionary_encode()
        spot = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.full((len(tokens), 5), np.nan)
        place = (sizes - 1) * quantile
        out[:, LOW_WEIGHT], out[:, HIGH_WEIGHT] = np.ceil(place) - place, place - np.floor(place)
        for k, code in enumerate(codes.dictionary.to_pylist()):
            if code in known.vocabularies:
                rows = np.flatnonzero(spot == k)
                out[rows, UNKNOWN] = float(known.vocabulary(code))
                for lo, hi in bounded_ranges(sizes[rows], SLICE_TOKENS):
                    at = rows[lo:hi]
                    words = tokens.take(pa.array(at)).flatten().cast(pa.string())
                    low, high = neighbours(known.ranks_of(words, code), sizes[at], quantile)
                    some = sizes[at] > 0
                    out[at, LOW], out[at, HIGH] = np.where(some, low, out[at, UNKNOWN]), np.where(some, high, out[at, UNKNOWN])
        none = np.isnan(out[:, UNKNOWN])
        ends = np.cumsum(np.where(none, 0, 5))
        offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[none, False])
        return pa.ListArray.from_arrays(offsets, pa.array(out[~none].ravel()))

    return run


def log_quantile(near: Column) -> Column:
    """The interpolated quantile of the log ranks, computed as Spark's ``percentile`` does; NULL where the head does not decide it."""
    low, high = F.ln(near[LOW] + 1.0), F.ln(near[HIGH] + 1.0)
    between = F.when(near[LOW] == near[HIGH], low).otherwise(near[LOW_WEIGHT] * low + near[HIGH_WEIGHT] * high)
    return F.when(near[HIGH] != float("inf"), between)


by_value(__name__)
