"""Structured Streaming: the stream's output equals the batch control corpus."""

import os

from pyspark.sql import functions as F

from ctrltok.operators.corpus import control_corpus
from ctrltok.streaming import read_pair_stream, start_control_corpus_stream
from ctrltok.streaming.corpus_stream import OUTPUT_COLUMNS


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    rows = [(i, "en", "train", f"  source text number {i} , with words ", f"target {i} words") for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id long, lang string, split string, source string, target string")
    for k in range(4):                                   # four arriving files
        df.where(F.col("pair_id") % 4 == k).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{k}"))
    ranks = spark.createDataFrame([("en", "words", 1), ("en", "text", 2)], "lang string, word string, rank long")
    feats = ["length", "frequency", "levenshtein"]
    stream = read_pair_stream(spark, os.path.join(src, "*"), max_files_per_trigger=1)
    out = os.path.join(tmpdir_path, "out")
    q = start_control_corpus_stream(stream, feats, out, os.path.join(tmpdir_path, "ckpt"), ranks=ranks)
    q.awaitTermination(180)
    got = spark.read.parquet(out).select(*OUTPUT_COLUMNS)
    from ctrltok.functions import text as T
    batch = control_corpus(df.withColumn("source", T.strip("source")).withColumn("target", T.strip("target")),
                           feats, ranks=ranks).select(*OUTPUT_COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_native_stream_equals_batch(spark, tmpdir_path):
    """Rows of the plain projection stream (no foreachBatch): all features, a custom tokeniser, a rank dictionary."""
    from ctrltok.functions import subword as SW
    from ctrltok.functions.rankstat import load_ranks_dictionary
    from ctrltok.operators.features import feature_bundle
    from ctrltok.plans.testparse import parse_text
    from ctrltok.streaming.corpus_stream import corpus_stream

    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    rows = [(i, "en", "train" if i % 3 else "test", f"source Text number {i} , with words ", f"target {i} words" if i % 5 else "") for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id long, lang string, split string, source string, target string")
    for k in range(4):
        df.where(F.col("pair_id") % 4 == k).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{k}"))
    ranks = spark.createDataFrame([("en", "words", 1), ("en", "Text", 2), ("en", "▁words", 1)], "lang string, word string, rank long")
    feats = ["length", "frequency", "levenshtein", "dependency"]
    tok = SW.tokenizer(SW.Segmenter({"▁words": -2.0, "▁t": -3.0, "e": -3.0, "x": -4.0}))
    stream = read_pair_stream(spark, os.path.join(src, "*"), max_files_per_trigger=1)
    dictionary = load_ranks_dictionary(ranks)
    assert corpus_stream(stream, feats, dictionary, parse_text, tok).isStreaming
    q = start_control_corpus_stream(stream, feats, out, os.path.join(tmpdir_path, "ckpt"), ranks=dictionary, parse=parse_text, tokenizer=tok)
    q.awaitTermination(180)
    assert q.exception() is None and len(q.recentProgress) >= 4
    from ctrltok.functions import text as T
    clean = df.withColumn("source", T.strip("source")).withColumn("target", T.strip("target"))
    want = control_corpus(clean, feats, ranks=ranks, parse=parse_text, tokenizer=tok).select(*OUTPUT_COLUMNS)
    assert sorted(map(tuple, spark.read.parquet(out).select(*OUTPUT_COLUMNS).collect())) == sorted(map(tuple, want.collect()))
    assert feature_bundle(clean, feats, ranks=dictionary, parse=parse_text).count() == 40


def test_retried_batch_is_idempotent(spark, tmpdir_path):
    from ctrltok.streaming.corpus_stream import batch_writer

    batch = spark.createDataFrame([(1, "en", "train", "a b c", "a b")], "pair_id long, lang string, split string, "
                                  "source string, target string")
    out = os.path.join(tmpdir_path, "idem")
    write = batch_writer(["length"], out)
    write(batch, 7)
    write(batch, 7)                      # the same micro-batch replayed after a failure
    assert spark.read.parquet(out).count() == 1
