"""Structured Streaming: build the control corpus for pair files as they arrive.

Every feature is row-local once the rank table is a dictionary of checked size (:mod:`ctrltok.functions.rankstat`), so
the control corpus of a stream is a plain projection: ``readStream`` -> expressions -> ``writeStream``, append mode, no state,
and Spark's file sink makes the output exactly-once.

A rank table beyond the dictionary's bound has to be joined, which needs an aggregation per pair.  For that case
:func:`start_joined_stream` runs the batch plan on every micro-batch (a complete set of pairs) with ``foreachBatch``
into a folder keyed by the batch id; a retried batch overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ctrltok.functions import text as T
from ctrltok.functions.rankstat import RankDictionary
from ctrltok.operators.corpus import control_corpus
from ctrltok.operators.features import Tokenizer

PAIR_SCHEMA = StructType([
    StructField("pair_id", LongType(), False),
    StructField("lang", StringType(), True),
    StructField("split", StringType(), True),
    StructField("source", StringType(), True),
    StructField("target", StringType(), True),
])

OUTPUT_COLUMNS = ("pair_id", "split", "feature_set", "prefix", "source_line", "target_line")


def read_pair_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAIR_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.load(path)
    return df.withColumn("source", T.strip("source")).withColumn("target", T.strip("target"))


def corpus_stream(pairs: DataFrame, features: Iterable[str], ranks: RankDictionary | None = None, parse=None,
                  tokenizer: Tokenizer | None = None) -> DataFrame:
    """The control corpus of a stream of pairs, itself a stream (``ranks``: a dictionary; ``parse``: a function or heads
    columns)."""
    return control_corpus(pairs, list(features), ranks=ranks, parse=parse, tokenizer=tokenizer).select(*OUTPUT_COLUMNS)


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")


def start_control_corpus_stream(pairs: DataFrame, features: Iterable[str], out_path: str, checkpoint: str,
                                ranks: RankDictionary | DataFrame | None = None, available_now: bool = True, parse=None,
                                tokenizer: Tokenizer | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops.  Ranks given as a DataFrame are joined
    batch by batch (:func:`start_joined_stream`)."""
    if isinstance(ranks, DataFrame):
        return start_joined_stream(pairs, features, out_path, checkpoint, ranks, available_now, parse, tokenizer)
    out = corpus_stream(pairs, features, ranks, parse, tokenizer)
    writer = (out.writeStream.format("parquet").outputMode("append").partitionBy("split")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    return _trigger(writer, available_now).start()


def batch_writer(features: Iterable[str], out_path: str, ranks: DataFrame | None = None, parse=None, tokenizer: Tokenizer | None = None):
    """The ``foreachBatch`` function: the batch plan on one micro-batch, written
    to ``batch=<id>`` with overwrite, so a retried batch replaces its own output."""
    feats = list(features)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        cc = control_corpus(batch, feats, ranks=ranks, parse=parse, tokenizer=tokenizer).select(*OUTPUT_COLUMNS)
        cc.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    return write_batch


def start_joined_stream(pairs: DataFrame, features: Iterable[str], out_path: str, checkpoint: str, ranks: DataFrame,
                        available_now: bool = True, parse=None, tokenizer: Tokenizer | None = None) -> StreamingQuery:
    write_batch = batch_writer(features, out_path, ranks, parse, tokenizer)
    writer = pairs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()
