"""Output-quality metrics over (source, reference, hypothesis) rows.

* BLEU (Papineni et al. 2002): corpus-level clipped n-gram precisions
  (n = 1..4), geometric mean, brevity penalty; no smoothing (0 when some
  order has no match).
* SARI (Xu et al. 2016), one reference: per sentence and n-gram order, the F1
  of kept n-grams, the precision of deleted n-grams and the F1 of added
  n-grams, averaged over the three operations and the four orders, on a 0-100 scale.  The
  corpus score pools the sums behind these ratios over all sentences; the mean over
  sentences is available too.
* FKGL (Kincaid et al. 1975): 0.39 words/sentences + 11.8 syllables/words
  - 15.59 with a documented heuristic: sentences = runs of ``.!?`` (at least 1
  per non-empty text), syllables = vowel groups per word (at least 1).
* Embedding greedy match (the matching step of BERTScore, given token vectors):
  precision = mean over candidate tokens of the best cosine with a reference
  token, recall the other way round, F1.

Tokens are the library tokeniser's tokens of the lower-cased text.
N-grams are counted inside the row (:mod:`ctrltok.functions.ngrams`): only sums leave a sentence, and nothing is shuffled but
the partial sums of corpus scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrltok.udfs import by_value
from pyspark.sql.types import DoubleType, StructField, StructType

from ctrltok.functions import text as T
from ctrltok.functions.ngrams import gram_sums
from ctrltok.operators.numbering import global_index
from ctrltok.session import materialize

MAX_N = 4
# Fixed value of the syllable heuristic: the vowel letters (lower case) whose
# maximal runs count as syllables.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
SYLLABLE_PATTERN = f"[{VOWELS}]+"
SENTENCE_END_PATTERN = r"[.!?]+"
WORD_RUN_PATTERN = r"[\p{L}\p{M}\p{N}_]+"


def metric_tokens(c) -> Column:
    return T.tokenize(F.lower(F.col(c) if isinstance(c, str) else c))


def drop_every(tokens, k: int = 4) -> Column:
    """Tokens without every k-th one (positions k-1, 2k-1, ...): a deterministic
    'simplified' system output for tests."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(tokens, lambda t, i: (i % k) != (k - 1))


# ---------------------------------------------------------------------------
# BLEU
# ---------------------------------------------------------------------------

def _bleu_measures(h, r):
    return np.minimum(h, r), h, r


def bleu(df: DataFrame, hyp: str = "hyp_tokens", ref: str = "ref_tokens", key: str = "pair_id") -> DataFrame:
    """One row: ``bleu``, ``bp``, ``p1..p4``, ``hyp_len``, ``ref_len``.  N-grams are counted inside the row, and only the
    per-order sums reach the final (single-row, partially aggregated) aggregate."""
    per = gram_sums(df, key, [hyp, ref], _bleu_measures, ["m", "t", "r"], MAX_N)
    aggs = [F.sum(f"{x}{n}").cast("long").alias(f"{x}{n}") for n in range(1, MAX_N + 1) for x in ("m", "t")]
    s = per.agg(*aggs, F.sum("r1").cast("long").alias("ref_len"))
    for n in range(1, MAX_N + 1):
        s = s.withColumn(f"m{n}", F.coalesce(f"m{n}", F.lit(0))).withColumn(f"t{n}", F.coalesce(f"t{n}", F.lit(0)))
    s = s.withColumn("hyp_len", F.col("t1")).withColumn("ref_len", F.coalesce("ref_len", F.lit(0)))
    precisions = [F.try_divide(F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double")) for n in range(1, MAX_N + 1)]
    any_zero = F.lit(False)
    log_sum = F.lit(0.0)
    for n, p in enumerate(precisions, start=1):
        s = s.withColumn(f"p{n}", F.coalesce(p, F.lit(0.0)))
        any_zero = any_zero | (F.col(f"m{n}") == 0)
    for n in range(1, MAX_N + 1):
        log_sum = log_sum + F.when(F.col(f"m{n}") > 0, F.ln(F.col(f"p{n}"))).otherwise(F.lit(0.0))
    bp = (F.when(F.col("hyp_len") == 0, F.lit(0.0))
          .when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0))
          .otherwise(F.exp(F.lit(1.0) - F.col("ref_len").cast("double") / F.col("hyp_len").cast("double"))))
    s = s.withColumn("bp", bp)
    score = F.when(any_zero, F.lit(0.0)).otherwise(F.lit(100.0) * F.col("bp") * F.exp(log_sum / F.lit(float(MAX_N))))
    return s.withColumn("bleu", score).select("bleu", "bp", "p1", "p2", "p3", "p4",
                                              F.col("hyp_len").cast("long").alias("hyp_len"),
                                              F.col("ref_len").cast("long").alias("ref_len"))


# ---------------------------------------------------------------------------
# SARI
# ---------------------------------------------------------------------------

def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


SARI_SUMS = ("keep_hit", "keep_sys", "keep_found", "keep_ref", "del_hit", "del_sys", "add_hit", "add_sys", "add_ref")


def _sari_measures(s, c, r):
    """The sums and counts behind the SARI ratios, from a gram's counts in source, system output and reference."""
    k, kg, ka = np.minimum(s, c), np.minimum(np.minimum(s, c), r), np.minimum(s, r)
    d, dg = np.maximum(s - c, 0), np.maximum(s - c - r, 0)
    part = lambda x, of: x / np.maximum(of, 1)  # noqa: E731  0 where of is 0, since x <= of
    added = (c > 0) & (s == 0)
    return part(kg, k), k > 0, part(kg, ka), ka > 0, part(dg, d), d > 0, added & (r > 0), added, (r > 0) & (s == 0)


def _sari_sums(df: DataFrame, src: str, hyp: str, ref: str, key: str) -> DataFrame:
    """One row per sentence with the sums of every order (columns ``<sum><n>``)."""
    return gram_sums(df, key, [src, hyp, ref], _sari_measures, list(SARI_SUMS), MAX_N)


def _sari_scores(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Operation scores (0-100) from the sums of a row, by column arithmetic."""
    def mean(of_order) -> Column:
        return F.lit(100.0) * sum((of_order(n) for n in range(1, MAX_N + 1)), F.lit(0.0)) / F.lit(float(MAX_N))

    def ratio(num, den):
        return lambda n: _ratio(F.col(f"{num}{n}"), F.col(f"{den}{n}"))

    kp, kr, ap, ar = ratio("keep_hit", "keep_sys"), ratio("keep_found", "keep_ref"), ratio("add_hit", "add_sys"), ratio("add_hit", "add_ref")
    out = sums.select(*keep, mean(lambda n: _f1(kp(n), kr(n))).alias("keep"), mean(ratio("del_hit", "del_sys")).alias("deletion"),
                      mean(lambda n: _f1(ap(n), ar(n))).alias("addition"))
    return out.withColumn("sari", (F.col("keep") + F.col("deletion") + F.col("addition")) / F.lit(3.0))


def sari(df: DataFrame, src: str = "src_tokens", hyp: str = "hyp_tokens", ref: str = "ref_tokens",
         key: str = "pair_id") -> DataFrame:
    """Per sentence ``(key, keep, deletion, addition, sari)``, all on a 0-100 scale; nothing is shuffled."""
    return _sari_scores(_sari_sums(df, src, hyp, ref, key), [key])


def corpus_sari(df: DataFrame, src: str = "src_tokens", hyp: str = "hyp_tokens", ref: str = "ref_tokens",
                key: str = "pair_id") -> DataFrame:
    """One row ``(n_sentences, sari, keep, deletion, addition)`` from sums over all sentences."""
    names = [f"{x}{n}" for n in range(1, MAX_N + 1) for x in SARI_SUMS]
    pooled = _sari_sums(df, src, hyp, ref, key).agg(F.count(F.lit(1)).alias("n_sentences"), *[F.sum(x).alias(x) for x in names])
    return _sari_scores(pooled, ["n_sentences"])


def mean_sari(per_sentence: DataFrame) -> DataFrame:
    """The mean of sentence scores."""
    return per_sentence.agg(F.count(F.lit(1)).alias("n_sentences"), F.avg("sari").alias("sari"),
                            F.avg("keep").alias("keep"), F.avg("deletion").alias("deletion"),
                            F.avg("addition").alias("addition"))


# ---------------------------------------------------------------------------
# FKGL
# ---------------------------------------------------------------------------

def text_counts(text) -> tuple[Column, Column, Column]:
    """(sentences, words, syllables) of one text."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(t, F.lit(WORD_RUN_PATTERN), 0)
    n_sent = F.when(F.length(T.strip(t)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.size(F.regexp_extract_all(t, F.lit(SENTENCE_END_PATTERN), 0))))
    syl = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.greatest(
        F.lit(1), F.size(F.regexp_extract_all(F.lower(w), F.lit(SYLLABLE_PATTERN), 0))))
    return n_sent, F.size(words), syl


def fkgl(df: DataFrame, text: str = "text") -> DataFrame:
    n_sent, n_words, n_syl = text_counts(text)
    s = df.agg(F.sum(n_sent).cast("long").alias("n_sentences"), F.sum(n_words).cast("long").alias("n_words"),
               F.sum(n_syl).cast("long").alias("n_syllables"))
    score = (F.lit(0.39) * F.try_divide(F.col("n_words").cast("double"), F.col("n_sentences").cast("double"))
             + F.lit(11.8) * F.try_divide(F.col("n_syllables").cast("double"), F.col("n_words").cast("double"))
             - F.lit(15.59))
    return s.withColumn("fkgl", score)


# ---------------------------------------------------------------------------
# Embedding greedy match
# ---------------------------------------------------------------------------

_MATCH_OUT = StructType([StructField("precision", DoubleType()), StructField("recall", DoubleType())])


def _unit(rows) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in rows], dtype=np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms > 0, m / np.where(norms > 0, norms, 1.0), 0.0)


def _weighted(best: np.ndarray, weights) -> float:
    w = np.asarray(weights, np.float64)
    total = w.sum()
    return float((best * w).sum() / total) if total else 0.0


@F.pandas_udf(_MATCH_OUT)
def _greedy(cand: pd.Series, ref: pd.Series, cweights: pd.Series, rweights: pd.Series) -> pd.DataFrame:
    out = []
    for a, b, v, w in zip(cand, ref, cweights, rweights):
        sims = _unit(a) @ _unit(b).T
        out.append((_weighted(sims.max(axis=1), v), _weighted(sims.max(axis=0), w)))
    return pd.DataFrame(out, columns=["precision", "recall"])


def token_weights(vectors: DataFrame, token: str = "token") -> DataFrame:
    """``(token, weight)``: inverse document frequency ``ln((n + 1) / (df + 1))`` over the sentences of ``vectors``.  Tokens of a
    sentence are made distinct before they are counted, both aggregations partial before their shuffle."""
    seen = vectors.select("sent", token).distinct()
    n = vectors.select("sent").distinct().agg(F.count("*").alias("_n"))                       # one row
    df = seen.groupBy(token).agg(F.count("*").alias("_df"))
    return df.crossJoin(F.broadcast(n)).select(token, F.ln((F.col("_n") + 1.0) / (F.col("_df") + 1.0)).alias("weight"))


def unrelated_pairs(sentences: DataFrame, order: list) -> DataFrame:
    """``(cand, ref)``: every sentence of ``sentences (sent, ..)`` with the next one in ``order`` (hashes of the sentence, with a
    unique column last), the last with the first.  Linear in the sentences, and the same whatever the partitioning."""
    ranked = materialize(global_index(sentences, order, out="_i").select("sent", "_i"), "hash_order")
    n = ranked.agg(F.count("*").alias("_n"))                                                  # one row
    after = ranked.crossJoin(F.broadcast(n)).select(F.col("sent").alias("cand"), ((F.col("_i") + 1) % F.col("_n")).alias("_i"))
    return after.join(ranked.withColumnRenamed("sent", "ref"), "_i").select("cand", "ref")


def match_baseline(matched: DataFrame) -> DataFrame:
    """One row: mean precision, recall and F1 of the matches of unrelated pairs."""
    return matched.agg(*[F.avg(c).alias(f"base_{c}") for c in ("precision", "recall", "f1")])


def rescaled(matched: DataFrame, baseline: DataFrame) -> DataFrame:
    """Scores moved so that the baseline is 0 and a perfect match 1: ``(x - b) / (1 - b)``; a baseline of 1 gives NULL."""
    x = matched.crossJoin(F.broadcast(baseline))                                              # one row
    return x.withColumns({c: F.try_divide(F.col(c) - F.col(f"base_{c}"), 1.0 - F.col(f"base_{c}")) for c in ("precision", "recall", "f1")}) \
            .drop(*[f"base_{c}" for c in ("precision", "recall", "f1")])


def embedding_match(vectors: DataFrame, sentence_pairs: DataFrame, weights: DataFrame | None = None, token: str = "token") -> DataFrame:
    """Greedy cosine match between the token vectors of candidate and reference
    sentences.  ``vectors``: ``(sent, vec_id, embedding)``; ``sentence_pairs``: ``(cand, ref)``.  With ``weights``
    (:func:`token_weights`; the vectors then have the ``token`` column) the means are weighted; a sentence whose
    weights are all 0 scores 0.

    A sentence has a bounded number of tokens, so its vectors form one array; each pair is
    an equi-join of two arrays and one matrix product.  Vectors are shuffled once to build the arrays and once to
    meet the other side."""
    weighted = vectors.withColumn("weight", F.lit(1.0)) if weights is None else vectors.join(weights, token)
    arrays = weighted.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "weight"))).alias("vecs"))
    side = lambda a, b: arrays.select(F.col("sent").alias(a), F.col("vecs.embedding").alias(f"{b}vecs"), F.col("vecs.weight").alias(f"{b}w"))
    j = sentence_pairs.select("cand", "ref").join(side("cand", "c"), "cand").join(side("ref", "r"), "ref")
    out = j.select("cand", "ref", _greedy("cvecs", "rvecs", "cw", "rw").alias("m")).select("cand", "ref", "m.precision", "m.recall")
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


# Ship this module's UDF code with the UDF itself (pickle by value), so Python
# workers need only numpy/pandas, not an installed copy of this package.
by_value(__name__)
