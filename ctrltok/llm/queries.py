"""Registered queries of the subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrltok.llm import (bpe, decontam, langid, licenses, line_dedup, periodic, pii, prefix_trie, secrets, simhash, sketch,
                         suffix_dedup, toxicity)
from ctrltok.sources.tables import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; pass another path where the package is not installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents")).drop("keep_bitmap")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.learn(docs, path or vocabulary("piece_bpe_32k.model")))


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), path or vocabulary("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.digests(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), edited=True)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op5_language": op5_language,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op6_secrets": op6_secrets,
    "op10_personal_data": op10_personal_data,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_licenses": op12_licenses,
    "op13_prefix_trie": op13_prefix_trie,
}
