"""Registered queries: each takes ``(spark, sf_dir)``, reads the given tables
(or data Spark derives from them) whole, and returns a DataFrame whose column
names match the DuckDB oracle in :mod:`ctrltok.plans.oracle`.

Doubles are rounded to 6 places in outputs (both here and in the oracle) so
the order-insensitive value hash is not decided by the last ulp.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrltok.functions import bins as B
from ctrltok.functions import rankstat as RS
from ctrltok.functions import subword as SW
from ctrltok.functions import text as T
from ctrltok.functions import tokens as K
from ctrltok.operators import audit as AU
from ctrltok.operators import corpus as C
from ctrltok.operators import experiments as EX
from ctrltok.operators import features as FE
from ctrltok.operators import gaps as GA
from ctrltok.operators import hypotheses as HY
from ctrltok.operators import match as MA
from ctrltok.operators import metrics as ME
from ctrltok.operators import profile as PR
from ctrltok.operators import ranks as R
from ctrltok.operators import resume as RE
from ctrltok.operators import shards as SH
from ctrltok.operators import tree as TR
from ctrltok.operators.numbering import global_index
from ctrltok.plans.testparse import heads_table, parse_text
from ctrltok.session import checkpoint_dir, materialize
from ctrltok.sources import lines as L
from ctrltok.sources import pieces as PI
from ctrltok.sources import sinks as SK
from ctrltok.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_TABLES: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, inputs: list[str], make: Callable):
    """A stored table that several queries read: built once per session for the files of its ``inputs`` (written to the
    checkpoint folder); other files under the same folder make a new one."""
    files = [f for t in inputs for f in sorted(TB.table(spark, sf_dir, t).inputFiles())]
    key = (spark.sparkContext.applicationId, name, *files)
    if key not in _TABLES:
        _TABLES[key] = make()
    return _TABLES[key]


def doc_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank table derived from the documents' token counts; every query that looks words up reads it, as it would a
    saved rank file."""
    return _once(spark, sf_dir, "ranks", ["documents"],
                 lambda: R.ranks_from_corpus(TB.table(spark, sf_dir, "documents").select("lang", "text")))


def _headed_ranks(spark: SparkSession, sf_dir: str) -> FE.HeadedRanks:
    """The same rank table with its head, for the feature match."""
    return _once(spark, sf_dir, "headed ranks", ["documents"], lambda: FE.headed(doc_ranks(spark, sf_dir), [TB.CONVERSATION_LANG]))


def _pairs(spark, sf_dir):
    """The pair corpus, derived and tokenised once."""
    return _once(spark, sf_dir, "pairs", ["conversations"], lambda: FE.prepare_pairs(TB.conversation_pairs(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Flagship: the control corpus (featurise -> bin -> prefix -> tokenise)
# ---------------------------------------------------------------------------

CONTROL_FEATURES = B.FEATURES


@query("control_corpus")
def q_control_corpus(spark, sf_dir):
    cc = C.control_corpus(_pairs(spark, sf_dir), CONTROL_FEATURES, ranks=doc_ranks(spark, sf_dir), parse=parse_text)
    return cc.select("pair_id", "split", "feature_set",
                     *[r6(f"exact_{f}").alias(f"exact_{f}") for f in CONTROL_FEATURES],
                     "prefix", "source_line", "target_line")


@query("control_corpus_all")
def q_control_corpus_all(spark, sf_dir):
    """All four features with the parse supplied as a heads table (one sentence per line of a text)."""
    pairs = _pairs(spark, sf_dir)
    cc = C.control_corpus(pairs, B.FEATURES, ranks=doc_ranks(spark, sf_dir), parse=heads_table(pairs))
    return cc.select("pair_id", "split", "feature_set", *[r6(f"exact_{f}").alias(f"exact_{f}") for f in B.FEATURES],
                     "prefix", "source_line", "target_line")


@query("control_corpus_length")
def q_control_corpus_length(spark, sf_dir):
    pairs = TB.conversation_pairs(spark, sf_dir)
    cc = C.control_corpus(pairs, ["length"])
    return cc.select("pair_id", "split", r6("exact_length").alias("exact_length"),
                     "bin_idx_length", "prefix", "source_line", "target_line")


# ---------------------------------------------------------------------------
# Scans, pairing, shards
# ---------------------------------------------------------------------------


HEAD_N = 5
SHARD_LINES = 4
SHARD_SKIP = 1


def _doc_files(spark, sf_dir):
    """Documents paired as source/target line files: doc 2u is the source file and
    doc 2u+1 the target file of unit u.  Every document is used (the parity
    only says which side of its unit it is on)."""
    dl = TB.document_lines(spark, sf_dir)
    src = dl.where(F.col("doc_id") % 2 == 0).select((F.col("doc_id") / 2).cast("long").alias("unit"), "line_no", "line")
    tgt = dl.where(F.col("doc_id") % 2 == 1).select(((F.col("doc_id") - 1) / 2).cast("long").alias("unit"), "line_no", "line")
    return src, tgt


@query("pairs_scan")
def q_pairs_scan(spark, sf_dir):
    src, tgt = _doc_files(spark, sf_dir)
    return L.pair_lines(src, tgt, keys=["unit"], how="full").select("unit", "line_no", "source", "target")


@query("pair_tsv")
def q_pair_tsv(spark, sf_dir):
    src, tgt = _doc_files(spark, sf_dir)
    p = L.pair_lines(src, tgt, keys=["unit"], how="inner")
    out = L.pair_tsv(p)
    # the position in the sorted order is part of the result
    return global_index(out, ["n_words", "line_no"], group_by=["unit"], out="position").select(
        "unit", "line_no", "n_words", "tsv", "position")


@query("pair_tsv_file")
def q_pair_tsv_file(spark, sf_dir):
    """The pair corpus written as one TSV in length order and read back: line number and line."""
    pairs = TB.conversation_pairs(spark, sf_dir).select("pair_id", *[
        F.regexp_replace(c, "[\\n\\r]", " ").alias(c) for c in ("source", "target")])
    folder = _folder(spark, "pairs") + ".tsv"
    SK.write_pair_tsv(L.pair_tsv(pairs), folder, order=["n_words", "pair_id"])
    return L.read_lines(spark, folder).select("line_no", F.col("value").alias("tsv"))


@query("lines_head")
def q_lines_head(spark, sf_dir):
    return L.head(TB.document_lines(spark, sf_dir), HEAD_N).select("doc_id", "line_no", "line")


@query("shard_assign")
def q_shard_assign(spark, sf_dir):
    sh = SH.assign_shards(TB.document_lines(spark, sf_dir), SHARD_LINES, skip=SHARD_SKIP)
    return sh.select("doc_id", "line_no", "shard", "shard_name")


@query("shard_merge")
def q_shard_merge(spark, sf_dir):
    """Shards of every document merged back in descending shard order."""
    sh = SH.assign_shards(TB.document_lines(spark, sf_dir), SHARD_LINES, skip=SHARD_SKIP)
    order = sh.select("doc_id", "shard").distinct().withColumn("pos", -F.col("shard"))
    m = SH.merge_shards(sh, order, keys=("doc_id",))
    return m.select("doc_id", "merged_line_no", "shard", "line_no", "line")


# ---------------------------------------------------------------------------
# Tokens, predicates, ranks
# ---------------------------------------------------------------------------

def _pair_tokens(spark, sf_dir):
    return FE.side_tokens(TB.conversation_pairs(spark, sf_dir))


@query("tokenize")
def q_tokenize(spark, sf_dir):
    pairs = TB.conversation_pairs(spark, sf_dir)
    per = pairs.select("pair_id", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), T.tokenize("source").alias("toks")),
        F.struct(F.lit(1).alias("side"), T.tokenize("target").alias("toks")))))
    return per.select("pair_id", "side", F.size("toks").cast("long").alias("n_tokens"),
                      F.array_join("toks", " ").alias("tokens"))


@query("token_filter")
def q_token_filter(spark, sf_dir):
    t = _pair_tokens(spark, sf_dir)
    return t.select("pair_id", "side", F.col("token_no").cast("long").alias("token_no"), "word",
                    T.is_punct("word").alias("is_punct"), T.is_number("word").alias("is_number"),
                    T.is_stop("word", "lang").alias("is_stop"), T.admitted("word", "lang").alias("admitted"))


@query("detokenize")
def q_detokenize(spark, sf_dir):
    pairs = TB.conversation_pairs(spark, sf_dir)
    pieces = T.to_pieces("source")
    return pairs.select("pair_id", F.size(pieces).cast("long").alias("n_pieces"),
                        F.array_join(pieces, " ").alias("pieces"), T.detokenize(pieces).alias("detokenized"))


# The public vocabulary of the sub-word queries.
VOCABULARY = "byte_bpe_50k.tiktoken"

_SEGMENTERS: dict[tuple, SW.Segmenter] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer file; pass another path where the package is not installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _segmenter(spark, path=None):
    key = (spark.sparkContext.applicationId, path or vocabulary_path())
    if key not in _SEGMENTERS:
        _SEGMENTERS[key] = PI.load_segmenter(spark, key[1])
    return _SEGMENTERS[key]


@query("subword_tokens")
def q_subword_tokens(spark, sf_dir, path=None):
    seg = _segmenter(spark, path)
    per = TB.conversation_pairs(spark, sf_dir).select("pair_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("side"), F.col(s).alias("text")) for i, s in enumerate(FE.SIDES)])))
    per = per.withColumn("toks", SW.tokenizer(seg)("text"))
    return per.select("pair_id", "side", F.size("toks").cast("long").alias("n_pieces"), F.array_join("toks", " ").alias("pieces"),
                      SW.decoder(seg)("toks").alias("decoded"))


@query("subword_vocabulary")
def q_subword_vocabulary(spark, sf_dir, path=None):
    v = R.vocabulary(TB.conversation_pairs(spark, sf_dir), tokenizer=SW.tokenizer(_segmenter(spark, path)))
    return v.select("side", "token", "cnt", "freq_rank")


@query("subword_corpus")
def q_subword_corpus(spark, sf_dir, path=None):
    """The control corpus in sub-word pieces, frequency ranks counted by the same tokeniser over the sources."""
    tok = SW.tokenizer(_segmenter(spark, path))
    pairs = FE.prepare_pairs(TB.conversation_pairs(spark, sf_dir), tok)
    ranks = R.ranks_from_corpus(pairs.select("lang", F.col("source").alias("text")), tokenizer=tok)
    cc = C.control_corpus(pairs, ["frequency", "length"], ranks=ranks, tokenizer=tok)
    return cc.select("pair_id", "feature_set", r6("exact_frequency").alias("exact_frequency"), "prefix", "source_line", "target_line")


@query("rank_table")
def q_rank_table(spark, sf_dir):
    """Every document read as a word-vector file: header line, then the first
    whitespace field of each line is a word ranked by its line index."""
    dl = TB.document_lines(spark, sf_dir).select("doc_id", "line_no", F.col("line").alias("value"))
    r = R.ranks_from_vectors(dl, keys=("doc_id",))
    return r.select("doc_id", "word", F.col("rank").cast("long").alias("rank"))


@query("corpus_ranks")
def q_corpus_ranks(spark, sf_dir):
    return doc_ranks(spark, sf_dir).select("lang", "word", "cnt", "rank")


@query("rank_summary")
def q_rank_summary(spark, sf_dir):
    return R.rank_summary(doc_ranks(spark, sf_dir))


@query("vocabulary")
def q_vocabulary(spark, sf_dir):
    return R.vocabulary(TB.conversation_pairs(spark, sf_dir)).select("side", "token", "cnt", "freq_rank")


@query("rank_lookup")
def q_rank_lookup(spark, sf_dir):
    t = _pair_tokens(spark, sf_dir).where(T.admitted("word", "lang"))
    lk = R.rank_lookup(t, doc_ranks(spark, sf_dir))
    return lk.select("pair_id", "side", F.col("token_no").cast("long").alias("token_no"), "word",
                     "raw_rank", r6("log_rank").alias("log_rank"))


@query("freq_stat")
def q_freq_stat(spark, sf_dir):
    st = FE.frequency_stats(FE.by_pair(_pairs(spark, sf_dir)), doc_ranks(spark, sf_dir))
    return st.select("pair_id", r6("freq_source").alias("freq_source"), r6("freq_target").alias("freq_target"))


@query("freq_ratio")
def q_freq_ratio(spark, sf_dir):
    f = FE.with_frequency(FE.by_pair(_pairs(spark, sf_dir)), doc_ranks(spark, sf_dir))
    return f.select("pair_id", r6("exact_frequency").alias("freq_ratio"))


@query("freq_abs")
def q_freq_abs(spark, sf_dir):
    f = FE.with_frequency(FE.by_pair(_pairs(spark, sf_dir)), doc_ranks(spark, sf_dir), absolute=True)
    return f.select("pair_id", r6("exact_frequency").alias("freq_abs"))


@query("freq_row")
def q_freq_row(spark, sf_dir):
    """The frequency statistic inside the row, with the rank table as a dictionary; a rank table beyond a dictionary's
    bounds is joined, once per distinct text."""
    pairs, ranks = TB.conversation_pairs(spark, sf_dir), doc_ranks(spark, sf_dir)
    try:
        st = FE.row_frequency_stats(pairs, RS.load_ranks_dictionary(ranks))
    except RS.TooManyRanks:
        st = FE.frequency_stats_by_text(pairs, ranks)
    return st.select("pair_id", r6("freq_source").alias("freq_source"), r6("freq_target").alias("freq_target"))


@query("freq_reuse")
def q_freq_reuse(spark, sf_dir):
    """The frequency statistic once per distinct text (a turn is the target of one pair and the source of the next)."""
    st = FE.frequency_stats_by_text(TB.conversation_pairs(spark, sf_dir), doc_ranks(spark, sf_dir))
    return st.select("pair_id", r6("freq_source").alias("freq_source"), r6("freq_target").alias("freq_target"))


@query("rank_profile")
def q_rank_profile(spark, sf_dir):
    # tokens stay on their pair's partition, so the per-(pair, side) aggregate needs no second shuffle
    tokens = FE.side_tokens(FE.by_pair(_pairs(spark, sf_dir)))
    p = PR.rank_profile(FE.log_ranks(tokens, doc_ranks(spark, sf_dir)))
    return p.select("pair_id", "side", *[r6(c).alias(c) for c in ("mean", "max", "sd", "median", "q1", "q3", "iqr")])


# ---------------------------------------------------------------------------
# Row-local features and bins
# ---------------------------------------------------------------------------

@query("length_ratio")
def q_length_ratio(spark, sf_dir):
    p = TB.conversation_pairs(spark, sf_dir)
    return p.select("pair_id", r6(FE.length_ratio()).alias("length_ratio"))


@query("length_abs")
def q_length_abs(spark, sf_dir):
    p = TB.conversation_pairs(spark, sf_dir)
    return p.select("pair_id", FE.length_abs().alias("length_abs"))


@query("edit_ratio")
def q_edit_ratio(spark, sf_dir):
    p = TB.conversation_pairs(spark, sf_dir)
    return p.select("pair_id", r6(FE.edit_ratio()).alias("edit_ratio"))


@query("tree_depth")
def q_tree_depth(spark, sf_dir):
    p = TB.conversation_pairs(spark, sf_dir)
    p, ds, dt = FE.depth_columns(p, parse_text)
    return p.select("pair_id", ds.alias("depth_source"), dt.alias("depth_target"))


@query("depth_ratio")
def q_depth_ratio(spark, sf_dir):
    p = FE.with_depth(TB.conversation_pairs(spark, sf_dir), parse_text)
    return p.select("pair_id", r6("exact_dependency").alias("depth_ratio"))


@query("depth_abs")
def q_depth_abs(spark, sf_dir):
    p = FE.with_depth(TB.conversation_pairs(spark, sf_dir), parse_text, absolute=True)
    return p.select("pair_id", r6("exact_dependency").alias("depth_abs"))


def _bundle(spark, sf_dir):
    return FE.feature_bundle(_pairs(spark, sf_dir), CONTROL_FEATURES, ranks=doc_ranks(spark, sf_dir), parse=parse_text)


@query("depth_from_heads")
def q_depth_from_heads(spark, sf_dir):
    """Depths from a supplied heads table with several sentences per text."""
    heads = heads_table(TB.conversation_pairs(spark, sf_dir))
    return TR.depth_from_heads(heads).select("pair_id", "side", F.col("depth").cast("long").alias("depth"))


@query("bin_values")
def q_bin_values(spark, sf_dir):
    b = _bundle(spark, sf_dir)
    return b.select("pair_id", *[F.col(f"bin_idx_{f}").alias(f"bin_idx_{f}") for f in CONTROL_FEATURES],
                    *[F.round(F.col(f"bin_{f}"), 2).alias(f"bin_{f}") for f in CONTROL_FEATURES])


@query("feature_bundle")
def q_feature_bundle(spark, sf_dir):
    b = _bundle(spark, sf_dir)
    return b.select("pair_id", *[r6(f"exact_{f}").alias(f"exact_{f}") for f in CONTROL_FEATURES],
                    *[F.round(F.col(f"bin_{f}"), 2).alias(f"bin_{f}") for f in CONTROL_FEATURES])


@query("feature_summary")
def q_feature_summary(spark, sf_dir):
    long = PR.long_features(_bundle(spark, sf_dir), CONTROL_FEATURES)
    s = PR.feature_summary(long)
    return s.select("feature", "n", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query("control_prefix")
def q_control_prefix(spark, sf_dir):
    b = _bundle(spark, sf_dir)
    return b.select("pair_id", K.render_prefix({f: F.col(f"bin_{f}") for f in CONTROL_FEATURES}).alias("prefix"))


# Fixed example request of the inference corpus (any values work).
INFER_REQUEST = {"dependency": 0.8, "frequency": 0.95, "length": 0.78, "levenshtein": 0.22}


@query("infer_prefix")
def q_infer_prefix(spark, sf_dir):
    dl = TB.document_lines(spark, sf_dir)
    out = C.inference_corpus(dl, INFER_REQUEST, col="line")
    return out.select("doc_id", "line_no", "model_input")


# ---------------------------------------------------------------------------
# Parsing control tokens, ablation, profiles
# ---------------------------------------------------------------------------

def _control_lines(spark, sf_dir):
    """The control corpus with glued tokens (``<A_1><B_2>``) on odd pairs, so the
    parser sees both spellings."""
    cc = C.control_corpus(_pairs(spark, sf_dir), CONTROL_FEATURES, ranks=doc_ranks(spark, sf_dir), parse=parse_text)
    glued = F.regexp_replace("source_line", "> (?=<)", ">")
    return cc.withColumn("source_line", F.when(F.col("turn") % 2 == 1, glued).otherwise(F.col("source_line")))


@query("parse_tokens")
def q_parse_tokens(spark, sf_dir):
    p = C.parsed_corpus(_control_lines(spark, sf_dir))
    # NULL (not -1) for a line without control tokens, whatever the ANSI setting
    n = F.when(F.col("controls").isNotNull(), F.size("controls")).cast("long")
    return p.select("pair_id", n.alias("n_controls"),
                    *[F.col("controls").getItem(B.TOKEN_NAMES[f]).alias(B.TOKEN_NAMES[f]) for f in CONTROL_FEATURES],
                    "sentence")


@query("feature_ablation")
def q_feature_ablation(spark, sf_dir):
    a = C.ablation_corpus(_control_lines(spark, sf_dir))
    return a.select("pair_id", "feature_set", "ablated_line")


@query("feature_combinations")
def q_feature_combinations(spark, sf_dir):
    """Ablation feature sets per experiment: every proper non-empty subset of the
    features each experiment config requests."""
    cfg = _configs(spark, sf_dir).select(EX.config_id("config_name").alias("exp_id"), "features_requested")
    out = C.subsets_of(cfg)
    return out.select("exp_id", F.col("combo").cast("long").alias("combo"),
                      F.array_join("subset", "_").alias("feature_set"),
                      F.size("subset").cast("long").alias("n_features"))


@query("value_counts")
def q_value_counts(spark, sf_dir):
    v = PR.control_values(_control_lines(spark, sf_dir))
    return PR.value_counts(v).select("name", "value", "split", "pooled", "cnt")


@query("hist_equal_width")
def q_hist_equal_width(spark, sf_dir):
    # two passes over the values (bounds, then bins): the values are written once
    long = materialize(PR.long_features(_bundle(spark, sf_dir), CONTROL_FEATURES), "feature_values")
    h = PR.hist_equal_width(long)
    return h.select("feature", "bin", "cnt", "n_bins", r6("bin_lo").alias("bin_lo"))


@query("hist_fixed")
def q_hist_fixed(spark, sf_dir):
    b = _bundle(spark, sf_dir)
    long = PR.long_features(b, CONTROL_FEATURES, prefix="bin_", keep=["split"]).withColumnRenamed("x", "value")
    return PR.hist_fixed(long.withColumn("value", F.round("value", 2))).select("feature", "bin", "split", "cnt")


# ---------------------------------------------------------------------------
# Model outputs and evaluation
# ---------------------------------------------------------------------------

@query("hyp_parse")
def q_hyp_parse(spark, sf_dir):
    return HY.parse_hypotheses(TB.hypothesis_log(spark, sf_dir)).select("sample_id", "log_no", "score", "text")


@query("best_hypothesis")
def q_best_hypothesis(spark, sf_dir):
    h = HY.parse_hypotheses(TB.hypothesis_log(spark, sf_dir))
    return HY.best_hypotheses(h).select("sample_id", "score", "text")


def _match_rows(spark, sf_dir):
    """Requested bins = the features of (turn t -> turn t+2) rendered on turn t;
    system output = turn t+1."""
    ranks = _headed_ranks(spark, sf_dir)
    # the prefixed corpus is a stored product (evaluation reads it back): both match queries read the same one
    return _once(spark, sf_dir, "requested", ["conversations", "documents"], lambda: _requested(spark, sf_dir, ranks)), ranks


def _requested(spark, sf_dir, ranks):
    tri = TB.conversation_triples(spark, sf_dir)
    req = tri.select("pair_id", "lang", "source", F.col("output").alias("target"), F.col("target").alias("output"))
    req = req.withColumns({f"{s}_tokens": T.tokenize(s) for s in FE.SIDES})
    req = FE.feature_bundle(req, CONTROL_FEATURES, ranks=ranks, parse=parse_text)
    prefix = K.render_prefix({f: F.col(f"bin_{f}") for f in CONTROL_FEATURES})
    # every fifth turn is requested without control tokens
    line = F.concat(F.when(F.col("pair_id") % 5 != 0, prefix).otherwise(F.lit("")), F.array_join("source_tokens", " "))
    return materialize(req.select("pair_id", "lang", line.alias("source_line"), "output"), "requested_corpus")


def _compared(rows, ranks):
    return MA.realised_vs_requested(rows, CONTROL_FEATURES, ranks=ranks, parse=parse_text)


@query("feature_match")
def q_feature_match(spark, sf_dir):
    s = MA.match_summary(_compared(*_match_rows(spark, sf_dir)))
    return s.select("name", "is_total", "n_match", "n_mismatch", r6("avg_delta").alias("avg_delta"))


@query("feature_match_totals")
def q_feature_match_totals(spark, sf_dir):
    rows, ranks = _match_rows(spark, sf_dir)
    return MA.match_totals(rows, _compared(rows, ranks), len(CONTROL_FEATURES)).select(
        "n_pairs", "n_prefixed", "n_features_total", "n_matches")


def _metric_rows(spark, sf_dir):
    pairs = TB.conversation_pairs(spark, sf_dir)
    return pairs.select("pair_id", ME.metric_tokens("source").alias("src_tokens"),
                        ME.metric_tokens("target").alias("ref_tokens")) \
                .withColumn("hyp_tokens", ME.drop_every("src_tokens", 4))


@query("bleu")
def q_bleu(spark, sf_dir):
    b = ME.bleu(_metric_rows(spark, sf_dir))
    return b.select(*[r6(c).alias(c) for c in ("bleu", "bp", "p1", "p2", "p3", "p4")], "hyp_len", "ref_len")


@query("sari")
def q_sari(spark, sf_dir):
    s = ME.sari(_metric_rows(spark, sf_dir))
    return s.select("pair_id", *[r6(c).alias(c) for c in ("keep", "deletion", "addition", "sari")])


@query("sari_corpus")
def q_sari_corpus(spark, sf_dir):
    s = ME.corpus_sari(_metric_rows(spark, sf_dir))
    return s.select("n_sentences", *[r6(c).alias(c) for c in ("sari", "keep", "deletion", "addition")])


@query("sari_mean")
def q_sari_mean(spark, sf_dir):
    s = ME.mean_sari(ME.sari(_metric_rows(spark, sf_dir)))
    return s.select("n_sentences", *[r6(c).alias(c) for c in ("sari", "keep", "deletion", "addition")])


@query("fkgl")
def q_fkgl(spark, sf_dir):
    hyp = _metric_rows(spark, sf_dir).select(F.array_join("hyp_tokens", " ").alias("text"))
    f = ME.fkgl(hyp)
    return f.select("n_sentences", "n_words", "n_syllables", r6("fkgl").alias("fkgl"))


EMBED_RANGE = 200


@query("embed_match")
def q_embed_match(spark, sf_dir):
    """Sentences are the vectors of one label in a range of vec_ids; label l is matched against l+1 of the same range."""
    part = F.floor(F.col("vec_id") / EMBED_RANGE).cast("long")
    sent = lambda label: F.struct(part.alias("part"), label.cast("long").alias("label"))
    v = TB.table(spark, sf_dir, "embeddings").select(sent(F.col("label")).alias("sent"), "vec_id", "embedding")
    pairs = v.select("sent").distinct().select(
        F.col("sent").alias("cand"), F.struct(F.col("sent.part").alias("part"), (F.col("sent.label") + 1).alias("label")).alias("ref"))
    m = ME.embedding_match(v, pairs)
    return m.select(F.col("cand.part").alias("part"), F.col("cand.label").alias("cand"), F.col("ref.label").alias("ref"),
                    *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("embed_match_rescaled")
def q_embed_match_rescaled(spark, sf_dir):
    """The match weighted by inverse document frequency and rescaled by the mean of unrelated pairs.  A vector's token is the
    signs of its first four components; unrelated sentences are neighbours in the order of a hash of (part, label)."""
    part = F.floor(F.col("vec_id") / EMBED_RANGE).cast("long")
    sign = sum((F.when(F.get("embedding", F.lit(i)) > 0, 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    v = TB.table(spark, sf_dir, "embeddings").select(
        F.struct(part.alias("part"), F.col("label").cast("long").alias("label")).alias("sent"), "vec_id", sign.alias("token"), "embedding")
    v = materialize(v, "token_vectors")
    weights = ME.token_weights(v)
    sentences = v.select("sent").distinct()
    hashed = (F.col("sent.part") * 7919 + F.col("sent.label") * 104729) % 1000003
    unrelated = ME.unrelated_pairs(sentences, [hashed, F.col("sent.part"), F.col("sent.label")])
    base = ME.match_baseline(ME.embedding_match(v, unrelated, weights))
    pairs = sentences.select(F.col("sent").alias("cand"), F.struct(F.col("sent.part").alias("part"), (F.col("sent.label") + 1).alias("label")).alias("ref"))
    m = ME.rescaled(ME.embedding_match(v, pairs, weights), base)
    return m.select(F.col("cand.part").alias("part"), F.col("cand.label").alias("cand"), F.col("ref.label").alias("ref"),
                    *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# ---------------------------------------------------------------------------
# Audits
# ---------------------------------------------------------------------------

@query("bad_split_counts")
def q_bad_split_counts(spark, sf_dir):
    """The expected list also names, for every part, a file that has no line."""
    dl = TB.document_lines(spark, sf_dir)
    expected = TB.table(spark, sf_dir, "documents").select(F.col("source").alias("file")).unionByName(
        TB.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("file")))
    return AU.bad_split_counts(dl, expected).select("file", "is_total", "zb", "ca")


def _roundtrip(spark, sf_dir, path=None):
    """A stored corpus of sub-word pieces, both sides whole, audited against its texts: line breaks and white-space runs are
    lost in it (raw differences), and characters that the vocabulary cannot decode stand in the stored pieces but not in the
    decoded original (differences after cleaning)."""
    pairs = TB.conversation_pairs(spark, sf_dir, strip=False)
    both = pairs.select("pair_id", F.col("split").alias("file"), F.inline(F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("source", "target")])))
    seg = _segmenter(spark, path)
    stored = materialize(both.withColumn("line", F.array_join(SW.tokenizer(seg)(T.strip("text")), " ")), "stored_pieces")
    return AU.roundtrip(stored, "text", "line", has_prefix=False, pieces=True, segmenter=seg)


@query("roundtrip_counts")
def q_roundtrip_counts(spark, sf_dir):
    return AU.roundtrip_counts(_roundtrip(spark, sf_dir), ["file", "side"])


@query("roundtrip_diff")
def q_roundtrip_diff(spark, sf_dir):
    """The mismatch report, written and read back."""
    folder = _folder(spark, "mismatches")
    SK.write_mismatch_report(AU.mismatches(_roundtrip(spark, sf_dir), "text", ["file", "side", "pair_id"]), folder)
    schema = "pair_id long, same_raw boolean, same_cleaned boolean, original string, decoded string, file string, side string"
    return spark.read.schema(schema).parquet(folder).select("file", "side", "pair_id", "same_raw", "same_cleaned", "original", "decoded")


@query("hyp_group")
def q_hyp_group(spark, sf_dir):
    g = HY.group_hypotheses(HY.parse_hypotheses(TB.hypothesis_log(spark, sf_dir)))
    return g.select("sample_id", "n_hyps", F.array_join("texts", "\t").alias("texts"))


@query("missing_ids")
def q_missing_ids(spark, sf_dir):
    """Samples are the orders that have an order line; the others are missing."""
    return HY.missing_samples(TB.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id")))


@query("missing_intervals")
def q_missing_intervals(spark, sf_dir):
    return GA.missing_intervals(TB.table(spark, sf_dir, "lineitem"), "l_orderkey")


# ---------------------------------------------------------------------------
# Files written to the shared folder and read back
# ---------------------------------------------------------------------------

def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def _flat_pairs(spark, sf_dir):
    """The pair corpus as one-line texts, ``line_no`` counting the pairs of each split."""
    pairs = TB.conversation_pairs(spark, sf_dir).select("pair_id", "lang", "split", *[
        F.regexp_replace(c, "[\\n\\r]", " ").alias(c) for c in ("source", "target")])
    return global_index(pairs, ["pair_id"], group_by=["split"], out="line_no")


@query("read_corpus")
def q_read_corpus(spark, sf_dir):
    """The corpus as ``<split>_<shard>.src`` / ``.tgt`` line files, two shards a split, read as a corpus folder."""
    folder = _folder(spark, "corpus")
    SK.write_shard_files(_flat_pairs(spark, sf_dir).withColumn("shard", F.col("line_no") % 2), folder)
    return L.read_corpus(spark, folder).select("split", "stem", "line_no", "source", "target")


FILE_SHARD_LINES = 25


def _shard_folder(spark, sf_dir):
    """The pair corpus cut into shards of consecutive lines, written as ordered shard files."""
    folder = _folder(spark, "shards")
    SK.write_shard_files(SH.assign_shards(_flat_pairs(spark, sf_dir), FILE_SHARD_LINES, split=None), folder)
    return folder


@query("shard_files")
def q_shard_files(spark, sf_dir):
    back = L.read_corpus(spark, _shard_folder(spark, sf_dir))
    return back.select("split", F.regexp_extract("stem", "_([0-9]+)$", 1).cast("long").alias("shard"), "line_no", "source", "target")


@query("shard_merge_files")
def q_shard_merge_files(spark, sf_dir):
    """The training sources merged from their shard files, last shard first."""
    folder = _shard_folder(spark, sf_dir)
    n = TB.conversation_pairs(spark, sf_dir).where("split = 'train'").count()
    return SH.merge_shard_files(spark, folder, "train", range((n - 1) // FILE_SHARD_LINES, -1, -1), "src")


@query("control_corpus_files")
def q_control_corpus_files(spark, sf_dir):
    """The length and edit-similarity corpus written by language, feature set and split, and read back."""
    cc = C.control_corpus(_flat_pairs(spark, sf_dir), ["length", "levenshtein"])
    folder = _folder(spark, "control")
    SK.write_control_corpus(cc.select("lang", "feature_set", "split", "line_no", "source_line", "target_line"), folder)
    return spark.read.parquet(folder).select("lang", "feature_set", "split", "line_no", "source_line", "target_line")


@query("control_corpus_resumed")
def q_control_corpus_resumed(spark, sf_dir):
    """The same corpus built by a run that stops after one wave of chunks and a second run that completes it."""
    features = ["length", "levenshtein"]
    pairs = RE.chunked(_flat_pairs(spark, sf_dir), K.feature_set_key(features), FILE_SHARD_LINES)
    folder = _folder(spark, "resumed")
    make = lambda part: C.control_corpus(part, features)
    columns = ["line_no", "source_line", "target_line"]
    RE.resume(pairs, folder, make, columns, waves=3, stop_after=1)
    RE.resume(pairs, folder, make, columns, waves=3)
    return spark.read.parquet(folder).select("lang", "feature_set", "split", "line_no", "source_line", "target_line")


@query("rank_saved")
def q_rank_saved(spark, sf_dir):
    folder = _folder(spark, "ranks")
    R.save_ranks(doc_ranks(spark, sf_dir), folder)
    return R.load_ranks(spark, folder).select("lang", "word", "rank")


@query("overview_csv")
def q_overview_csv(spark, sf_dir):
    """The results table written with ``;`` and a header, read back into its types."""
    folder, table = _folder(spark, "overview"), _overview(spark, sf_dir)
    EX.write_overview(table, folder)
    back = spark.read.option("sep", ";").option("header", True).csv(folder)
    return back.select(*[F.col(f"`{h}`").cast(kind).alias(c) for h, (c, kind) in zip(EX.OVERVIEW_HEADER, table.dtypes, strict=True)])


# ---------------------------------------------------------------------------
# Experiments
# ---------------------------------------------------------------------------

def _metric_lines(spark, sf_dir):
    """One metric file per part: ``experiments/<partkey>/checkpoints/evaluation.txt``
    holding a single-quoted dict (fkgl missing for every third experiment)."""
    p = TB.table(spark, sf_dir, "part")
    bleu = F.col("p_retailprice") / 100.0
    sari = F.col("p_size") + F.col("p_retailprice") / 1000.0
    fk = F.col("p_size") / 7.0
    bp = (F.col("p_partkey") % 97) / 100.0
    br = (F.col("p_partkey") % 89) / 100.0
    bf = (F.col("p_partkey") % 83) / 100.0
    body = F.when(F.col("p_partkey") % 3 == 0,
                  F.format_string("{'bleu': %s, 'sari': %s, 'bertscore_precision': %s, 'bertscore_recall': %s, 'bertscore_f1': %s}",
                                  bleu, sari, bp, br, bf)) \
            .otherwise(F.format_string("{'bleu': %s, 'sari': %s, 'fkgl': %s, 'bertscore_precision': %s, 'bertscore_recall': %s, 'bertscore_f1': %s}",
                                       bleu, sari, fk, bp, br, bf))
    return p.select(F.format_string("experiments/%d/checkpoints/evaluation.txt", "p_partkey").alias("file_path"),
                    body.alias("value"))


def _configs(spark, sf_dir):
    """One config per part: id, language, requested features (a subset by the
    bits of partkey mod 15 + 1), batch size, update frequency (absent for every
    fourth), test batch size, epochs, beam and learning rate."""
    p = TB.table(spark, sf_dir, "part")
    bits = (F.col("p_partkey") % 15) + 1
    feats = F.filter(F.array(*[F.when(F.shiftright(bits, k) % 2 == 1, F.lit(f)) for k, f in enumerate(B.FEATURES)]),
                     lambda f: f.isNotNull())
    return p.select(
        F.format_string("tuning_config_%d.yaml", "p_partkey").alias("config_name"),
        F.when(F.col("p_size") % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("language"),
        feats.alias("features_requested"),
        F.col("p_size").cast("long").alias("batch_size"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(None).cast("long")).otherwise(F.col("p_partkey") % 4 + 1).alias("update_freq"),
        (F.col("p_size") * 2).cast("long").alias("test_batch_size"),
        (F.col("p_size") + 10).cast("long").alias("max_epochs"),
        (F.col("p_partkey") % 8 + 1).cast("long").alias("beam_size"),
        (F.col("p_retailprice") / 1.0e7).alias("lr"))


@query("metric_parse")
def q_metric_parse(spark, sf_dir):
    return EX.parse_metric_lines(_metric_lines(spark, sf_dir))


def _overview(spark, sf_dir):
    allow = TB.table(spark, sf_dir, "part").where(F.col("p_size") <= 25) \
              .select(F.col("p_partkey").cast("string").alias("exp_id"))
    return EX.overview(_configs(spark, sf_dir), EX.parse_metric_lines(_metric_lines(spark, sf_dir)), allow)


@query("experiment_overview")
def q_experiment_overview(spark, sf_dir):
    return _overview(spark, sf_dir)
