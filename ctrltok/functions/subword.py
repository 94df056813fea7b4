"""Sub-word tokeniser: best segmentation of every word over a table of scored pieces.

The table (``piece``, ``score``: a log probability) is a parameter: a vocabulary file of a unigram tokeniser, or a rank
file whose pieces get scores by Zipf's law.  Nothing is trained here.

A text's white-space-separated words each get the piece mark ``▁`` in front; pieces never cross a mark, so words are
segmented alone.  Pieces are looked up by hash, a set of all piece prefixes ends a look-up early, and the Viterbi
recursion keeps the best score of every prefix of the word (ties: the longer last piece).  A character that is no
piece of its own is unknown and costs ``unknown_penalty`` more than the worst piece; unknown neighbours
form one piece of the output.  The work is the word's length times the longest piece, whatever the word.

A segmenter is an Arrow UDF, so it fits every ``tokenizer=`` of the library.  A batch's texts become Python strings only
``SLICE_BYTES`` at a time (pieces: ``SLICE_PIECES``), and a Python worker holds one segmenter; words of up to ``LONG_WORD``
characters that repeat are segmented once per Python worker, up to ``CACHED_WORDS`` at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ctrltok.functions.text import PIECE_MARK
from ctrltok.udfs import bounded_ranges, by_value, shared

# Fixed value: what an unknown piece decodes to (with the spaces around it).
UNKNOWN_SURFACE = " ⁇ "
# Unicode white space, as ``functions.text`` states it.
SPACES = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c)[0] == "Z" or c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85")
CACHED_WORDS = 1 << 17
LONG_WORD = 64
SLICE_BYTES = 1 << 18
SLICE_PIECES = 1 << 16


class Segmenter:
    """Pieces of words and texts.  ``scores``: piece -> score."""

    def __init__(self, scores: Mapping[str, float], unknown_penalty: float = 10.0, normalization: str | None = None):
        if not scores:
            raise ValueError("the piece table is empty")
        self.scores = dict(scores)
        self.normalization = normalization
        self.unknown = min(self.scores.values()) - unknown_penalty
        self.reset()

    def reset(self) -> None:
        self.prefixes = None
        self.own = {p: p for p in self.scores}
        self.cache: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"scores": self.scores, "normalization": self.normalization, "unknown": self.unknown}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def word(self, word: str) -> tuple[str, ...]:
        """The best pieces of one word (the mark included)."""
        known = self.cache.get(word)
        if known is None:
            if len(word) > LONG_WORD:
                return self.segment(word)
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            known = self.cache[word] = self.segment(word)
        return known

    def segment(self, word: str) -> tuple[str, ...]:
        if self.prefixes is None:
            self.prefixes = {p[:k] for p in self.scores for k in range(1, len(p) + 1)}
        n, scores, prefixes, own = len(word), self.scores, self.prefixes, self.own
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        for i in range(n):
            here = best[i]
            k = i + 1
            while k <= n and (part := word[i:k]) in prefixes:
                score = scores.get(part)
                if score is not None and (best[k] is None or here + score > best[k]):
                    best[k], back[k] = here + score, (i, False)
                k += 1
            if word[i] not in scores and (best[i + 1] is None or here + self.unknown > best[i + 1]):
                best[i + 1], back[i + 1] = here + self.unknown, (i, True)
        out: list[str] = []
        at, follows = n, False
        while at:
            start, unknown = back[at]
            if unknown and follows:
                out[-1] = word[start:at] + out[-1]
            else:
                piece = word[start:at]
                out.append(own.get(piece, piece))                # one string per piece, whatever the number of words
            at, follows = start, unknown
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize(self.normalization, text) if self.normalization else text
        return [PIECE_MARK + w for w in text.translate(TO_SPACE).split(" ") if w]

    def pieces(self, text: str | None) -> list[str] | None:
        return None if text is None else [p for w in self.words(text) for p in self.word(w)]

    def decode(self, pieces) -> str | None:
        """Pieces -> text: unknown ones become the unknown sign, marks become spaces, the leading space goes."""
        if pieces is None:
            return None
        joined = "".join(p if p in self.scores else UNKNOWN_SURFACE for p in pieces).replace(PIECE_MARK, " ")
        return joined[1:] if joined.startswith(" ") else joined


TO_SPACE = str.maketrans({c: " " for c in SPACES})


def _sizes(lengths: pa.Array) -> np.ndarray:
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _piece_lists(segmenter: Segmenter, texts: pa.Array) -> pa.Array:
    parts, lengths = [pa.array([], pa.string())], []
    for lo, hi in bounded_ranges(_sizes(pc.binary_length(texts)), SLICE_BYTES):
        found = [segmenter.pieces(t) for t in texts.slice(lo, hi - lo).to_pylist()]
        parts.append(pa.array([p for pieces in found for p in pieces or ()], pa.string()))
        lengths += [None if pieces is None else len(pieces) for pieces in found]
    missing = np.array([n is None for n in lengths], bool)
    ends = np.cumsum([0, *(n or 0 for n in lengths)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts), mask=pa.array(missing))


def _decoded(segmenter: Segmenter, lists: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    for lo, hi in bounded_ranges(_sizes(lists.value_lengths()), SLICE_PIECES):
        parts.append(pa.array([segmenter.decode(p) for p in lists.slice(lo, hi - lo).to_pylist()], pa.string()))
    return pa.concat_arrays(parts)


def tokenizer(segmenter: Segmenter) -> Callable[[Column], Column]:
    """The segmenter as a ``tokenizer=``: text Column -> ARRAY<STRING> Column."""
    held = shared(segmenter)

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return _piece_lists(held(), texts)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


def decoder(segmenter: Segmenter) -> Callable[[Column], Column]:
    """ARRAY<STRING> of pieces -> text."""
    held = shared(segmenter)

    @F.arrow_udf(StringType())
    def run(pieces: pa.Array) -> pa.Array:
        return _decoded(held(), pieces)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


by_value(__name__)
