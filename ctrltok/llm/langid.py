"""Language identification by unigram models that sum over all segmentations.

Pieces come from a fixed public vocabulary.  For every language the piece probabilities are
fitted by expectation maximisation on word counts; the probability of a word is the sum over
all ways to cut it into pieces (forward algorithm), and a text's score is the product over its words.
A character that no piece covers counts as the unknown piece.

Words of up to ``LONGEST`` characters are summed together, longer ones (unspaced scripts) one by one with a running scale, so
that segmentations over any place of a word count.

Fitting uses a bounded sample: per language at most ``sample_docs`` documents, the first
by hash of doc_id among those with a text of 1 to ``sample_bytes`` bytes, one text per id; the fit counts a longer word in parts of
``LONGEST`` characters.  Prediction covers every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text when nothing could be learned; ties go to the alphabetically first language; repeated rows are predicted alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrltok.llm.common import held
from ctrltok.udfs import by_value

by_value(__name__)

START = "▁"
UNKNOWN = 0
LONGEST = 24
STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 50_000
CACHE = 250_000


def public_pieces(path: str) -> dict[str, int]:
    """Text pieces of a sentencepiece vocabulary file (no control or byte pieces), numbered from 1."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return {p: i for i, p in enumerate(sorted(set(found)), 1)}


def words_of(text: str) -> list[str]:
    """Lower-cased words."""
    return text.lower().split()


def parts_of(words: list[str]) -> list[str]:
    """Words for the fit, long ones in parts of bounded length."""
    return [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


class Pieces:
    """Vocabulary lookup of many substrings at once: hashed slots, what collides goes to a further table.

    Piece numbers start at 1; ``UNKNOWN`` is 0 and ``none`` (one past the last piece) marks no piece."""

    def __init__(self, pieces: dict[str, int]):
        self.longest = max(map(len, pieces), default=1)
        self.none = len(pieces) + 1
        self.size = len(pieces) + 2
        self.tables = []
        left = [(self.hash_of(p), i) for p, i in pieces.items()]
        bits = 17
        while left:
            salt = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            keys, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.none, np.int32)
            rest = []
            for h, i in left:
                at = (h * int(salt) & (1 << 64) - 1) >> (64 - bits)
                if ids[at] == self.none:
                    keys[at], ids[at] = h, i
                else:
                    rest.append((h, i))
            self.tables.append((salt, np.uint64(64 - bits), keys, ids))
            left, bits = rest, max(8, bits - 2) if len(rest) < 1 << (bits - 4) else bits

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(STEP) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        out = None
        for salt, shift, keys, ids in self.tables:
            at = (h * salt) >> shift
            got = np.where(keys[at] == h, ids[at], self.none)
            out = got if out is None else np.minimum(out, got)
        return np.full(len(h), self.none, np.int32) if out is None else out

    def lattice(self, words: list[str]):
        """Per length of a word with its start mark: (indexes of the words, length,
        {(start, length of piece): piece numbers})."""
        words = [START + w for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            codes = np.array([words[i] for i in at], dtype=f"<U{n}").view(np.uint32).reshape(len(at), n).astype(np.uint64)
            codes += np.uint64(1)
            edges = {}
            for start in range(n):
                h = np.zeros(len(at), np.uint64)
                for k in range(min(self.longest, n - start)):
                    h = h * STEP + codes[:, start + k]
                    ids = self.find(h)
                    if k == 0:
                        ids = np.where(ids == self.none, UNKNOWN, ids)
                    edges[start, k + 1] = ids
            yield at, int(n), edges


@dataclass
class Model:
    pieces: Pieces
    languages: list[str]
    probability: np.ndarray


def forward(n: int, edges, probability: np.ndarray) -> np.ndarray:
    """``alpha[position, word, language]``: summed probability of all segmentations of a prefix."""
    rows = len(edges[0, 1])
    alpha = np.zeros((n + 1, rows, probability.shape[1]))
    alpha[0] = 1.0
    for (start, k), ids in edges.items():
        alpha[start + k] += alpha[start] * probability[ids]
    return alpha


def long_log_probability(word: str, model: Model) -> np.ndarray:
    """Log of the summed probability of one word of any length: the sums of the last positions with a running scale."""
    pieces, probability = model.pieces, model.probability
    codes = np.frombuffer((START + word).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, width = len(codes), min(pieces.longest, len(codes))
    ids = np.full((n + 1, width), pieces.none, np.int32)              # of the piece of k + 1 characters that ends before place
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h[:n - k] * STEP + codes[k:]
        found = pieces.find(h)
        ids[k + 1:, k] = np.where(found == pieces.none, UNKNOWN, found) if k == 0 else found
    alpha = np.zeros((width, probability.shape[1]))                   # alpha[k]: sum of the prefix that ends k + 1 characters before
    alpha[0], scale = 1.0, np.zeros(probability.shape[1])
    for end in range(1, n + 1):
        here = (alpha * probability[ids[end]]).sum(axis=0)
        alpha[1:] = alpha[:-1]
        alpha[0] = here
        top = alpha.max(axis=0)
        if top.min() < 1e-200:
            top = np.maximum(top, 1e-300)
            alpha /= top
            scale += np.log(top)
    return np.log(np.maximum(alpha[0], 1e-300)) + scale


def log_probability(words: list[str], model: Model) -> np.ndarray:
    """``[word, language]`` log of the summed probability."""
    out = np.zeros((len(words), len(model.languages)))
    if not len(model.languages):
        return out
    for i in [i for i, w in enumerate(words) if len(w) > LONGEST]:
        out[i] = long_log_probability(words[i], model)
    short = np.array([i for i, w in enumerate(words) if len(w) <= LONGEST], np.int64)
    for lo in range(0, len(short), CHUNK):
        part = short[lo:lo + CHUNK]
        for at, n, edges in model.pieces.lattice([words[i] for i in part]):
            out[part[at]] = np.log(np.maximum(forward(n, edges, model.probability)[n], 1e-300))
    return out


def expected(n: int, edges, counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language (forward-backward over all segmentations)."""
    alpha = forward(n, edges, probability[:, None])[:, :, 0]
    beta = np.zeros_like(alpha)
    beta[n] = 1.0
    out = np.zeros(len(probability))
    scale = counts / np.maximum(alpha[n], 1e-300)
    for (start, k), ids in sorted(edges.items(), reverse=True):
        through = probability[ids] * beta[start + k]
        beta[start] += through
        out += np.bincount(ids, weights=alpha[start] * through * scale, minlength=len(out))
    return out


def fit(word_counts: dict[str, Counter], pieces: dict[str, int], rounds: int = 3, smooth: float = 0.05) -> Model:
    """Piece probabilities of every language."""
    lookup = Pieces(pieces)
    languages = sorted(word_counts)
    columns = []
    for lang in languages:
        words = sorted(word_counts[lang])
        counts = np.array([word_counts[lang][x] for x in words], float)
        parts = [(n, edges, counts[at]) for at, n, edges in lookup.lattice(words)]
        weight = np.zeros(lookup.size)
        for _, edges, c in parts:
            for ids in edges.values():
                weight += np.bincount(ids, weights=c, minlength=lookup.size)
        for _ in range(rounds):
            prob = normal(weight, smooth)
            weight = sum((expected(n, edges, c, prob) for n, edges, c in parts), np.zeros(lookup.size))
        columns.append(normal(weight, smooth))
    return Model(lookup, languages, np.array(columns).T if columns else np.zeros((lookup.size, 0)))


def normal(weight: np.ndarray, smooth: float) -> np.ndarray:
    """Smoothed probabilities; the mark for no piece keeps probability zero."""
    p = weight + smooth
    p[-1] = 0.0
    return p / p.sum()


def learn(docs: DataFrame, vocabulary: str, sample_docs: int = 300, sample_bytes: int = 32768) -> Model:
    """Fit on documents outside the held-out fifth."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter("doc_id is not null and lang is not null").filter(held(5) != 0).filter(F.octet_length("text").between(1, sample_bytes))
    # Spark limits the rank before the shuffle, so a task sends at most sample_docs ids of a language
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = (rows.select("lang", "doc_id", F.row_number().over(first).alias("r")).filter(F.col("r") <= sample_docs)
              .select("doc_id", "lang").distinct())
    counts: dict[str, Counter] = {}
    sample = (rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("t"))
              .groupBy("lang", "doc_id").agg(F.min("t").alias("t")))
    for r in sample.select("lang", "t.text").toLocalIterator():
        counts.setdefault(r.lang, Counter()).update(parts_of(words_of(r.text)))
    return fit({k: v for k, v in counts.items() if v}, public_pieces(vocabulary))


class Predictor:
    """Language scores with the log-probabilities of words kept in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((CACHE, len(model.languages)))

    def places(self, words: list[str]) -> np.ndarray:
        """Table rows of the words; new words are computed together."""
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > CACHE:
            self.index.clear()
            new = list(set(words))
        lo = len(self.index)
        self.table[lo:lo + len(new)] = log_probability(new, self.model)
        self.index.update(zip(new, range(lo, lo + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]):
        """``(language, score)`` of every text; words of many texts are looked up together."""
        words: list[str] = []
        spans, totals = [], np.zeros((len(texts), self.table.shape[1]))

        def flush():
            rows = self.table[self.places(words)]
            for i, lo, hi in spans:
                totals[i] += rows[lo:hi].sum(axis=0)
            words.clear()
            spans.clear()

        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        for i, t in enumerate(texts):
            own = words_of(t) if known[i] else []
            for lo in range(0, len(own), CHUNK):
                part = own[lo:lo + CHUNK]
                if len(words) + len(part) > 2 * CHUNK:
                    flush()
                spans.append((i, len(words), len(words) + len(part)))
                words += part
        flush()
        for k, x in zip(known, totals, strict=True):
            if not k or not len(x):
                yield "und", 0.0
                continue
            best = int(np.argmax(x))
            yield self.model.languages[best], float(1 / np.exp(np.clip(x - x[best], -700, 0)).sum())


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    # plain values: executors need not have this module
    shared = docs.sparkSession.sparkContext.broadcast((vars(model.pieces), model.languages, model.probability))

    def run(batches):
        fields, languages, probability = shared.value
        pieces = Pieces({})
        vars(pieces).update(fields)
        p = Predictor(Model(pieces, languages, probability))
        for b in batches:
            got = list(p.predict(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (held(5) == 0).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
