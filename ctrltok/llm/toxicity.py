"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on words of ordinary documents and on
fragments of toxic documents (the words whose byte 5-grams occur in clearly more toxic than
ordinary documents).  A window is one word with its borders; its distance is its shortest compressed length
with an ordinary dictionary minus its shortest with a toxic one (several of each, since one dictionary
leaves some frequent words out).  The shares of a
document's windows beyond several distances go through a calibrated logistic threshold.

The model is fitted on a bounded sample: at most ``sample_docs`` labelled documents a class, the
first by hash of doc_id among those with a text of 1 to ``sample_bytes`` bytes, one text per id; an ordinary dictionary is trained on at
most ``dictionary_words`` words of them.  Each half is calibrated with dictionaries of the other half,
weighted back to the labels' class ratio; all of them train the final dictionaries.  Scoring covers every whole text.

Defined results: null and empty texts get the score of a document without windows; repeated rows
are scored alike; a null doc_id is scored and never used for learning; without
labels of both classes every score is the share of toxic labels (0 without labels); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.llm.common import held, stored, texts, unpacked
from ctrltok.udfs import by_value

by_value(__name__)

GRAM = 5
BUCKETS = 1 << 20
LEVEL = 3
PAD = b" " + b"\n" * 8
LONG = 48
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DISTANCES = (2, 3, 4, 5, 6)
CACHE = 400_000
SLACK = 0.01


@dataclass
class Model:
    ordinary: list[bytes]
    toxic: list[bytes]
    weights: list[float]
    center: list[float]
    scale: list[float]
    base: float


def windows(text: str) -> list[bytes]:
    """The words of a text without punctuation at their ends, longer ones in pieces."""
    out = []
    for w in text.lower().encode().split():
        w = w.strip(EDGE)
        if len(w) <= LONG:
            if w:
                out.append(w)
        else:
            out += [w[i:i + LONG] for i in range(0, len(w), LONG)]
    return out


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams of `` word word ... `` and, per gram, the index of its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h + b[k:n + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ends = np.cumsum([len(w) + 1 for w in words])
    return (h >> np.uint64(44)).astype(np.int64), np.searchsorted(ends, np.arange(n), side="right").clip(max=len(words) - 1)


def contrasting(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int, ratio: float,
                evidence: float) -> np.ndarray:
    """Buckets whose share of toxic documents is ``ratio`` times that of ordinary ones, with a
    log-likelihood ratio of at least ``evidence``."""
    both = toxic + ordinary
    share = n_toxic / (n_toxic + n_ordinary)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) +
                 np.where(ordinary > 0, ordinary * np.log(ordinary / (both * (1 - share))), 0))
    return (g >= evidence) & ((toxic + 0.5) / (n_toxic + 1) >= ratio * (ordinary + 0.5) / (n_ordinary + 1))


def fragments(docs: list[list[bytes]], marked: np.ndarray) -> list[bytes]:
    """The words that hold a marked n-gram."""
    out = []
    for words in docs:
        g, at = grams(words)
        out += [words[i] for i in np.unique(at[marked[g]])]
    return out


def padded(word: bytes) -> bytes:
    return b" " + word + PAD


def trained(size: int, words: list[bytes]) -> bytes:
    """A zstandard dictionary of the words (their plain bytes when they are too few to train one)."""
    samples = [padded(w) for w in words]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or PAD


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


class Scorer:
    """Distances of words, each distinct word compressed once while it is in the bounded cache."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        if model.toxic:
            self.ordinary, self.toxic = (list(map(compressor, x)) for x in (model.ordinary, model.toxic))

    def distance(self, word: bytes) -> int:
        x = padded(word)
        toxic = min(len(c.compress(x)) for c in self.toxic)
        best = len(x) + 16  # no frame is longer than its input by more
        for c in self.ordinary:
            if best - toxic < DISTANCES[0]:
                return 0
            best = min(best, len(c.compress(x)))
        return min(max(best - toxic, 0), 15)

    def features(self, text: str) -> np.ndarray:
        words, seen = windows(text), self.seen
        for w in set(words).difference(seen):
            seen[w] = self.distance(w)
        counts = np.bincount(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), minlength=16)
        if len(seen) > CACHE:
            seen.clear()
        beyond = counts[::-1].cumsum()[::-1]
        return np.array([np.log((beyond[d] + 0.5) / (len(words) + 100)) for d in DISTANCES] +
                        [np.log(len(words) + 100)] + [float(beyond[d] > 0) for d in DISTANCES[-3:]])

    def score(self, text: str) -> float:
        m = self.model
        if not m.weights:
            return m.base
        x = (self.features(text) - np.array(m.center)) / np.array(m.scale)
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + penalty * b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def best_margin(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The margin above which predicting label 1 has the best weighted F1 (between two sample margins); of those within
    ``SLACK`` of the best the highest one, which leaves most documents alone."""
    o = np.argsort(-margin)
    hit, taken = np.cumsum(w[o] * y[o]), np.cumsum(w[o])
    f1 = 2 * hit / (taken + (w * y).sum())
    i = int(np.argmax(f1 >= (1 - SLACK) * f1.max()))
    after = margin[o][min(i + 1, len(o) - 1)]
    return float((margin[o][i] + after) / 2)


def fit(sample: list[tuple[str, int]], totals: tuple[int, int], ordinary_size: int = 32768, toxic_size: int = 16384,
        n_ordinary: int = 3, n_toxic: int = 2, toxic_share: float = 0.2, ratio: float = 8.0, evidence: float = 25.0, cutoff: float = 0.7,
        dictionary_words: int = 300_000) -> Model:
    """Calibrate on cross-fitted halves of the sample, then train the dictionaries on all of it.

    ``totals``: labelled documents of class 0 and 1, whose ratio the scores are calibrated to.  ``cutoff`` is the
    score at which the F1 of the cross-fitted sample is best."""
    base = totals[1] / max(1, sum(totals))
    by = [[t for t, y in sample if y == k] for k in (0, 1)]
    if min(map(len, by)) < 4:
        return Model([], [], [], [], [], base)
    words = [[windows(t) for t in docs] for docs in by]

    def dictionaries(part: list[list[list[bytes]]]) -> Model:
        counts = np.zeros((2, BUCKETS))
        for k in (0, 1):
            for w in part[k]:
                counts[k][np.unique(grams(w)[0])] += 1
        marked = contrasting(counts[1], counts[0], len(part[1]), len(part[0]), ratio, evidence)
        found = fragments(part[1], marked)
        size = int(np.clip(sum(map(len, found)) * toxic_share, 512, toxic_size))
        plain = [[x for w in part[0][i::n_ordinary] for x in w][:dictionary_words] for i in range(n_ordinary)]
        return Model([trained(ordinary_size, w) for w in plain], [trained(size >> i, found) for i in range(n_toxic)], [], [], [], base)

    # every document is measured with dictionaries that the other half of the sample trained
    rows = []
    for half in (0, 1):
        scorer = Scorer(dictionaries([w[half::2] for w in words]))
        rows += [(scorer.features(t), k) for k in (0, 1) for t in by[k][1 - half::2]]
    model = dictionaries(words)
    x = np.array([f for f, _ in rows])
    y = np.array([k for _, k in rows], float)
    share = [totals[k] / max(1, (y == k).sum()) for k in (0, 1)]
    w = np.where(y == 1, share[1], share[0])
    w *= len(w) / w.sum()
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    beta = logistic((x - center) / scale, y, w)
    margin = np.c_[np.ones(len(x)), (x - center) / scale] @ beta
    beta[0] += np.log(cutoff / (1 - cutoff)) - best_margin(margin, y, w)
    model.weights = beta.tolist()
    model.center, model.scale = center.tolist(), scale.tolist()
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = 4800, sample_bytes: int = 32768) -> Model:
    """Fit on labelled documents outside the held-out third."""
    known = (labels.filter("doc_id is not null and toxic in (0, 1)").filter(held(3) != 1)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # ids are chosen among those with a text that fits; of rows that repeat an id the text with the smallest hash counts
    fitting = texts(docs).filter(F.octet_length("text").between(1, sample_bytes))
    usable = stored(known.join(fitting.select("doc_id"), "doc_id", "left_semi"), "toxicity-ids")
    first = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // (2 - k)) for k in (0, 1)]
    rows = fitting.join(F.broadcast(first[0].union(first[1])), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("o"), "text", "toxic")
    picked = rows.groupBy("doc_id").agg(F.min(F.struct("o", "text", "toxic")).alias("x")).select("x.*")
    sample = sorted((r.o, r.text, r.toxic) for r in picked.toLocalIterator())
    return fit([(text, toxic) for _, text, toxic in sample], (totals.get(0, 0), totals.get(1, 0)))


def scores(docs: DataFrame, model: Model, cutoff: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: executors need not have this module

    def run(batches):
        scorer = Scorer(Model(**shared.value))
        for b in batches:
            got = [scorer.score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array([int(s >= cutoff) for s in got], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return texts(docs).select("doc_id", (held(3) == 1).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, cutoff: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``cutoff``, all columns kept; no shuffle.  Rows are judged one by one by their own
    text (null: empty), repeated rows alike, whatever the other columns; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: executors need not have this module
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(Model(**shared.value))
        for b in batches:
            keep = [scorer.score(t or "") < cutoff for t in b.column(0).field(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return unpacked(rows.mapInArrow(run, rows.schema), docs.columns)
