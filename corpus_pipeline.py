"""Corpus pipeline over ``documents``: each stage works on all rows its predecessor kept.

``run`` writes every stage's rows once to the shared checkpoint folder, so a lost
executor re-reads them and no stage repeats the ones before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctrltok.llm import bpe, decontam, line_dedup, simhash, toxicity
from ctrltok.llm.common import stored
from ctrltok.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines leave the text of all but the first document."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the smallest doc_id of each group stays."""
    return simhash.one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token counts and digests of ids and decoded text of every document kept."""
    return bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokenise),
]

#: SimHash components, compression scores and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
