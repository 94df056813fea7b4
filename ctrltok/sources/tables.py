"""Reading the input tables and deriving the corpora the operators run on.

* ``conversation_pairs``: a parallel corpus from ``conversations`` -- every turn
  is a source line and the next turn of the same conversation its target.
  The successor is found with an equi-join on ``(conv_id, turn + 1)``, which
  hashes on both columns, so a conversation with a third of all turns still
  spreads over many tasks (a ``lead`` window partitioned by conversation would
  put it in one).
* ``document_lines``: ``documents`` as line files (one document = one file,
  split on newline, numbered from 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrltok.functions import text as T

# Pairs and log lines are numbered by (conv_id, turn) packed into one long.
TURN_BITS = 24
# The language of the corpora made of conversations.
CONVERSATION_LANG = "en"


def packed(conv_id, turn) -> F.Column:
    """``conv_id * 2**24 + turn``; a turn outside 24 bits fails the job instead of running into
    the next conversation (a conv_id beyond 39 bits overflows, which ANSI mode reports)."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (conv_id, turn))
    t = F.when((t >= 0) & (t < 1 << TURN_BITS), t).otherwise(F.raise_error(F.lit("turn outside 24 bits")).cast("long"))
    return c.cast("long") * (1 << TURN_BITS) + t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(conv_id) -> F.Column:
    """Deterministic split assignment by conversation (every row kept)."""
    k = F.pmod(F.col(conv_id) if isinstance(conv_id, str) else conv_id, F.lit(10))
    return F.when(k == 0, F.lit("test")).when(k == 1, F.lit("valid")).otherwise(F.lit("train"))


def conversation_pairs(spark: SparkSession, sf_dir: str, strip: bool = True) -> DataFrame:
    """``(pair_id, conv_id, turn, lang, split, source, target)``; ``pair_id`` packs (conv_id, turn)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    pairs = conv.withColumnRenamed("text", "source").join(nxt, ["conv_id", "turn"], "inner")
    src, tgt = (T.strip("source"), T.strip("target")) if strip else (F.col("source"), F.col("target"))
    return pairs.select(
        packed("conv_id", "turn").alias("pair_id"),
        "conv_id", "turn",
        F.lit(CONVERSATION_LANG).alias("lang"),
        split_of("conv_id").alias("split"),
        src.alias("source"), tgt.alias("target"),
    )


def conversation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, lang, source, target, output)``: turn t, t+1 and t+2 of a
    conversation (used as source, reference and system output)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip("text").alias("text"))
    t1 = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    t2 = conv.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("output"))
    j = conv.withColumnRenamed("text", "source").join(t1, ["conv_id", "turn"]).join(t2, ["conv_id", "turn"])
    return j.select(packed("conv_id", "turn").alias("pair_id"), F.lit(CONVERSATION_LANG).alias("lang"),
                    "source", "target", "output")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, file, line_no, line)``: every document as a line file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("file"), "text")
    return docs.select("doc_id", "lang", "file",
                       F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line")) \
               .withColumn("line_no", F.col("line_no").cast("long"))


def hypothesis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-output log lines rendered from every conversation turn:
    ``S-<conv>\\t<text>`` and ``H-<conv>\\t-0.<turn>\\t<text>`` (one column ``value``,
    plus the log position ``log_no``).  A log line holds one line of text, so
    newlines inside a turn are written as spaces (as a decoder prints them)."""
    conv = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    h = conv.select((packed("conv_id", "turn") * 2 + 1).alias("log_no"),
                    F.format_string("H-%d\t-0.%d\t%s", "conv_id", "turn", "text").alias("value"))
    s = conv.select((packed("conv_id", "turn") * 2).alias("log_no"),
                    F.format_string("S-%d\t%s", "conv_id", "text").alias("value"))
    return h.unionByName(s)


def save_pairs_bucketed(pairs: DataFrame, table_name: str, buckets: int, key: str = "pair_id") -> None:
    """Store a pair table bucketed (and sorted) by ``pair_id``: every later read
    is already hash-partitioned by the key, so per-pair aggregations and the
    join back of per-pair statistics run without any shuffle of the pairs."""
    (pairs.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
          .format("parquet").saveAsTable(table_name))
