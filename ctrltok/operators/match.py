"""Requested-versus-realised feature match.

The requested bins are the control tokens prefixed to the source line; the
realised bins are recomputed between the *tokenised* source (prefix removed)
and the system output.  Both live on the same row after featurisation, so the
"join on (line, feature)" is a same-row lookup after exploding the requested
map: no shuffle.  Pairs without a prefix count in the pair total only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.functions import bins as B
from ctrltok.functions import tokens as K
from ctrltok.operators.features import Parse, Tokenizer, feature_bundle


def realised_vs_requested(rows: DataFrame, features: Iterable[str], ranks: DataFrame | None = None,
                          line: str = "source_line", output: str = "output", tokenizer: Tokenizer | None = None,
                          parse: Parse | DataFrame | str | None = None) -> DataFrame:
    """Rows ``(pair_id, name, requested, realised, match, delta)``, one per
    requested control token of a requested feature.  A realised value that cannot be computed (empty source)
    is a mismatch with NULL ``realised`` and ``delta``."""
    fs = sorted(set(features))
    lang = F.col("lang") if "lang" in rows.columns else F.lit("en")
    parsed = rows.select("pair_id", lang.alias("lang"), K.parse_tokens(line).alias("requested_map"),
                         K.strip_prefix(line).alias("source"), F.col(output).alias("target"))
    feats = feature_bundle(parsed, fs, ranks=ranks, binned=True, tokenizer=tokenizer, parse=parse)
    realised_of = F.lit(None).cast("double")
    for f in fs:
        realised_of = F.when(F.col("name") == B.TOKEN_NAMES[f], F.round(F.col(f"bin_{f}"), 2)).otherwise(realised_of)
    ex = feats.select("pair_id", *[f"bin_{f}" for f in fs],
                      F.explode("requested_map").alias("name", "requested"))
    ex = ex.where(F.col("name").isin([B.TOKEN_NAMES[f] for f in fs]))
    out = ex.select("pair_id", "name", "requested", realised_of.alias("realised"))
    return (out.withColumn("match", F.coalesce(F.col("requested") == F.col("realised"), F.lit(False)))
               .withColumn("delta", F.when(~F.col("match"), F.col("requested") - F.col("realised"))))


def match_summary(compared: DataFrame) -> DataFrame:
    """Per control-token name and overall (``name`` NULL, ``is_total`` 1): matches, mismatches and
    the mean divergence over mismatches with a realised value (NULL when there is none)."""
    return compared.rollup("name").agg(
        F.grouping("name").cast("int").alias("is_total"),
        F.count_if("match").alias("n_match"),
        F.count_if(~F.col("match")).alias("n_mismatch"),
        F.avg("delta").alias("avg_delta"))


def match_totals(rows: DataFrame, compared: DataFrame, n_features: int, line: str = "source_line") -> DataFrame:
    """One row: pairs, pairs with a prefix, total features (= features x pairs)
    and total matches -- one aggregate over the union of both inputs."""
    a = rows.select(F.lit(1).alias("is_pair"), (K.prefix_text(line) != "").alias("prefixed"),
                    F.lit(None).cast("boolean").alias("match"))
    b = compared.select(F.lit(0).alias("is_pair"), F.lit(None).cast("boolean").alias("prefixed"), "match")
    tot = a.unionByName(b).agg(F.sum("is_pair").cast("long").alias("n_pairs"),
                               F.count_if("prefixed").alias("n_prefixed"),
                               F.count_if("match").alias("n_matches"))
    return tot.withColumn("n_features_total", F.col("n_pairs") * F.lit(n_features))
