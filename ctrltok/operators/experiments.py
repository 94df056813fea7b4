"""Experiment bookkeeping: metric files, configs and the results overview.

Metric files hold one single-quoted dict per file (``{'bleu': 9.5, ...}``);
they are parsed with ``from_json(..., allowSingleQuotes)`` and the experiment
id is taken from the file path.  Configs are rows (one per experiment); the
overview joins them on the experiment id, restricted by an allow-list
(semi join), and derives the feature abbreviation and effective batch size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of a metric file and the header of the results table.
METRIC_KEYS = ("bleu", "sari", "fkgl", "bertscore_precision", "bertscore_recall", "bertscore_f1")
# Feature abbreviations in the overview, in this order; all four -> "all".
FEATURE_ABBR = (("dependency", "dep"), ("frequency", "freq"), ("length", "len"), ("levenshtein", "leven"))
OVERVIEW_HEADER = ("ID", "Language", "Features", "Batch Size", "Effective Batch Size", "Test Batch Size",
                   "Max Epochs", "Beam Size", "Learning Rate", "Bleu", "Sari", "Fkgl",
                   "Bertscore Precision", "Bertscore Recall", "Bertscore F1")


def parse_metric_lines(lines: DataFrame, path: str = "file_path", value: str = "value") -> DataFrame:
    """``(exp_id, bleu, sari, fkgl, bertscore_*)``; a missing metric is NULL.
    The id is the directory above ``checkpoints/`` in the path."""
    m = F.from_json(F.col(value), "MAP<STRING,DOUBLE>", {"allowSingleQuotes": "true"})
    exp = F.regexp_extract(F.col(path), r"([^/]+)/checkpoints/[^/]+$", 1)
    return lines.select(exp.alias("exp_id"), m.alias("m")).select(
        "exp_id", *[F.col("m").getItem(k).alias(k) for k in METRIC_KEYS])


def read_metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric files (the first line of each, stripped) -> parsed metrics."""
    from ctrltok.functions.text import strip
    from ctrltok.sources.lines import read_lines

    first = read_lines(spark, pattern).where(F.col("line_no") == 0)
    return parse_metric_lines(first.select(F.col("file").alias("file_path"), strip("value").alias("value")))


def config_id(name) -> F.Column:
    """Trailing digits of a config file name (``tuning_17.yaml`` -> ``17``)."""
    n = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(F.regexp_replace(n, r"\.[^.]*$", ""), r"(\d+)$", 1)


def feature_abbreviation(features) -> F.Column:
    f = F.col(features) if isinstance(features, str) else features
    parts = F.array(*[F.when(F.array_contains(f, full), F.lit(short)) for full, short in FEATURE_ABBR])
    return F.when(F.size(F.array_distinct(f)) == 4, F.lit("all")).otherwise(
        F.array_join(F.filter(parts, lambda x: x.isNotNull()), "_"))


def overview(configs: DataFrame, metrics: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Experiment table: config parameters joined with metrics on the id."""
    c = configs.withColumn("exp_id", config_id("config_name"))
    if allow is not None:
        c = c.join(allow.select("exp_id"), "exp_id", "left_semi")
    j = c.join(metrics, "exp_id", "inner")
    eff = F.coalesce(F.col("batch_size") * F.col("update_freq"), F.col("batch_size"))
    return j.select(
        F.col("exp_id").alias("id"), F.col("language").alias("language"),
        feature_abbreviation("features_requested").alias("features"),
        F.col("batch_size"), eff.alias("effective_batch_size"), "test_batch_size", "max_epochs", "beam_size",
        F.col("lr"), *METRIC_KEYS)


def write_overview(df: DataFrame, path: str) -> None:
    """``;``-separated results table with a header line."""
    names = dict(zip(["id", "language", "features", "batch_size", "effective_batch_size", "test_batch_size",
                      "max_epochs", "beam_size", "lr", *METRIC_KEYS], OVERVIEW_HEADER))
    out = df.select(*[F.col(c).cast("string").alias(names.get(c, c)) for c in df.columns])
    out.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
