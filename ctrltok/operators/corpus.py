"""Control corpora: prefix rendering, tokenised lines, feature-subset (ablation)
corpora, feature combinations and inference prefixes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrltok.functions import bins as B
from ctrltok.functions import text as T
from ctrltok.functions import tokens as K
from ctrltok.operators.features import Parse, Tokenizer, feature_bundle, tokens_of


def control_corpus(pairs: DataFrame, features: Iterable[str], ranks: DataFrame | None = None,
                   tokenizer: Tokenizer | None = None, parse: Parse | DataFrame | str | None = None) -> DataFrame:
    """Featurise, bin, render the prefix and tokenise: adds ``feature_set``,
    ``prefix``, ``source_line`` (prefix + tokenised source) and ``target_line``
    (tokenised target), keeping the exact and binned feature columns.
    ``tokenizer`` (text Column -> ARRAY<STRING> Column, e.g. a pandas UDF)
    replaces the built-in tokeniser in lines and frequency; ``parse`` supplies the dependency feature's heads.
    Prepared pairs (:func:`~ctrltok.operators.features.prepare_pairs`) are not tokenised again."""
    key = K.feature_set_key(features)
    fs = key.split("_")
    df = feature_bundle(pairs, fs, ranks=ranks, binned=True, tokenizer=tokenizer, parse=parse)
    src, tgt = (F.array_join(tokens_of(df, s, tokenizer), " ") for s in ("source", "target"))
    prefix = K.render_prefix({f: F.col(f"bin_{f}") for f in fs})
    df = df.withColumns({"feature_set": F.lit(key), "prefix": prefix})
    return df.withColumns({"source_line": F.concat(F.col("prefix"), src), "target_line": tgt})


def parsed_corpus(lines: DataFrame, col: str = "source_line") -> DataFrame:
    """Split prefixed lines into ``controls`` (MAP or NULL) and ``sentence``."""
    return lines.withColumn("controls", K.parse_tokens(col)).withColumn("sentence", K.strip_prefix(col))


def feature_combinations(spark: SparkSession, features: Iterable[str] = B.FEATURES, proper: bool = True) -> DataFrame:
    """All non-empty subsets of ``features`` as rows ``(combo_id, feature_set,
    features ARRAY<STRING>, n_features)``; ``proper`` drops the full set.  Built
    from ``range`` and bit tests, so it never leaves the JVM."""
    names = sorted(features)
    n = len(names)
    hi = (1 << n) - (1 if proper else 0)
    arr = F.array(*[F.when(F.shiftright(F.col("id"), k) % 2 == 1, F.lit(x)) for k, x in enumerate(names)])
    bits = F.filter(arr, lambda x: x.isNotNull())
    return (spark.range(1, hi)
            .select(F.col("id").alias("combo_id"), bits.alias("features"))
            .withColumn("feature_set", F.array_join("features", "_"))
            .withColumn("n_features", F.size("features")))


def subsets_of(df: DataFrame, features: str = "features_requested", proper: bool = True) -> DataFrame:
    """Per row, every (proper) non-empty subset of its feature list, in list
    order: adds ``combo`` (bit mask over list positions) and ``subset``.  A row
    with k features yields 2^k - 2 (or 2^k - 1) rows; k is at most 4."""
    k = F.size(features)
    hi = F.pow(F.lit(2), k).cast("int") - (2 if proper else 1)
    masks = F.when(hi >= 1, F.sequence(F.lit(1), hi)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("combo", F.explode(masks))
    bit_set = lambda f, i: F.floor(F.col("combo") / F.pow(F.lit(2), i)) % 2 == 1
    return out.withColumn("subset", F.filter(features, bit_set))


def combination_list(features: Iterable[str] = B.FEATURES, proper: bool = True) -> list[list[str]]:
    """Driver-side twin of :func:`feature_combinations` (at most 15 subsets)."""
    names = sorted(features)
    hi = (1 << len(names)) - (1 if proper else 0)
    return [[x for i, x in enumerate(names) if (c >> i) & 1] for c in range(1, hi)]


def ablation_corpus(lines: DataFrame, combos: list[list[str]] | None = None, col: str = "source_line") -> DataFrame:
    """Every line re-prefixed with each feature subset (default: the 14 proper
    subsets).  The subsets are a bounded literal array exploded per line -- no
    join -- and the line is parsed once for all of them.  A subset that asks for a feature
    outside the corpus's ``feature_set`` (without that column: a token the line lacks) fails the job; a feature
    whose value was NULL has no token and is left out."""
    combos = combination_list() if combos is None else combos
    lit_combos = F.array(*[
        F.struct(F.lit("_".join(sorted(c))).alias("feature_set"),
                 F.array(*[F.lit(B.TOKEN_NAMES[f]) for f in sorted(c)]).alias("names"))
        for c in combos])
    parsed = parsed_corpus(lines, col)
    known = "feature_set" in parsed.columns
    if known:
        token_of = F.create_map(*[F.lit(x) for f in B.FEATURES for x in (f, B.TOKEN_NAMES[f])])
        parsed = parsed.withColumn("_own", F.transform(F.split("feature_set", "_"), lambda f: token_of[f])).drop("feature_set")
    j = parsed.select("*", F.inline(lit_combos))
    has = lambda n: F.try_element_at(F.col("controls"), n).isNotNull()
    missing = F.exists("names", lambda n: ~F.array_contains("_own", n) if known else ~F.coalesce(has(n), F.lit(False)))
    names = F.when(missing, F.raise_error(F.lit("a line lacks a requested control token")).cast("array<string>")) \
        .otherwise(F.filter("names", has))
    prefix = F.aggregate(names, F.lit(""), lambda acc, n: F.concat(
        acc, F.lit("<"), n, F.lit("_"), F.try_element_at(F.col("controls"), n).cast("string"), F.lit("> ")))
    return j.withColumn("ablated_line", F.concat(F.coalesce(prefix, F.lit("")), F.col("sentence"))).drop("names", "_own")


def snap_requested(requested: Mapping[str, float]) -> dict[str, F.Column]:
    """Requested values snapped to their bins and rounded to two decimals, as
    literal expressions (Catalyst folds them to constants)."""
    if not requested:
        raise ValueError("no feature values requested")
    K.feature_set_key(requested.keys())
    return {f: B.bin_label(F.lit(float(v)), f) for f, v in requested.items()}


def inference_corpus(lines: DataFrame, requested: Mapping[str, float], col: str = "line",
                     tokenizer: Tokenizer | None = None) -> DataFrame:
    """Prefix every line with the constant control tokens of the requested
    values (features in alphabetical order) followed by the tokenised line."""
    prefix = K.render_prefix(snap_requested(requested))
    return lines.withColumn("prefix", prefix).withColumn("model_input", F.concat("prefix", F.array_join((tokenizer or T.tokenize)(F.col(col)), " ")))
