"""Model-output logs: hypothesis lines ``H-<sample>\\t<score>\\t<text>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.operators.gaps import expand, missing_intervals

# Fixed value: a hypothesis line is "H-", the sample id, a tab, a signed decimal
# score, a tab, then the text (everything else in the log is ignored).
HYP_PATTERN = r"(?s)\AH-([0-9]+)\t(-?[0-9]+\.[0-9]+)\t(.*)\z"


def parse_hypotheses(log: DataFrame, value: str = "value", order: str = "log_no") -> DataFrame:
    """``(sample_id, log_no, score, text)`` for every hypothesis line; other
    lines are dropped; ``log_no`` keeps the arrival order."""
    v = F.col(value)
    ok = v.rlike(HYP_PATTERN)
    return log.where(ok).select(
        F.regexp_extract(v, HYP_PATTERN, 1).cast("long").alias("sample_id"),
        F.col(order).alias("log_no"),
        F.regexp_extract(v, HYP_PATTERN, 2).cast("double").alias("score"),
        F.regexp_extract(v, HYP_PATTERN, 3).alias("text"))


def group_hypotheses(hyps: DataFrame) -> DataFrame:
    """Per sample: number of hypotheses, and the hypotheses in arrival order
    (an n-best list: bounded by the beam size)."""
    return hyps.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_hyps"),
        F.transform(F.array_sort(F.collect_list(F.struct("log_no", "text"))), lambda s: s["text"]).alias("texts"))


def best_hypotheses(hyps: DataFrame) -> DataFrame:
    """The first-arriving hypothesis per sample (``min_by``: a partial
    aggregate, no group is ever collected)."""
    return hyps.groupBy("sample_id").agg(F.min_by("text", "log_no").alias("text"),
                                         F.min_by("score", "log_no").alias("score"))


def missing_samples(hyps: DataFrame) -> DataFrame:
    """Sample ids in ``0 .. max`` that have no hypothesis (reported, not invented), by id."""
    return expand(missing_intervals(hyps, "sample_id")).orderBy("sample_id")


def read_hypotheses(spark, path: str) -> DataFrame:
    """Parse a decoder log file: hypothesis lines in file order (``log_no`` is the
    line number, so arrival order survives any partitioning)."""
    from ctrltok.sources.lines import read_lines

    lines = read_lines(spark, path).select(F.col("line_no").alias("log_no"), "value")
    return parse_hypotheses(lines)
