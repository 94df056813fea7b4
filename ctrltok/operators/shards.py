"""Sharding a corpus into fixed-size, order-preserving chunks and merging
shards back in a listed order.

A shard id is arithmetic on the line number (no window): after skipping the
first ``skip`` lines, line ``n`` belongs to shard ``(n - skip) // k`` (ids start
at 1 when ``skip > 0``, so a resumed run never reuses id 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctrltok.operators.numbering import global_index
from ctrltok.sources.lines import read_shards


def assign_shards(lines: DataFrame, lines_per_shard: int, skip: int = 0, split: str | None = "train",
                  line_no: str = "line_no") -> DataFrame:
    """Adds ``split`` (the given one, or the column of that name where ``split`` is None), ``shard`` and ``shard_name``."""
    if lines_per_shard <= 0:
        raise ValueError("lines_per_shard must be positive")
    if skip < 0:
        raise ValueError("skip must be >= 0")
    base = 1 if skip > 0 else 0
    shard = F.floor((F.col(line_no) - F.lit(skip)) / F.lit(lines_per_shard)).cast("long") + F.lit(base)
    return (lines.where(F.col(line_no) >= skip)
                 .withColumn("split", F.col("split") if split is None else F.lit(split))
                 .withColumn("shard", shard)
                 .withColumn("shard_name", F.concat("split", F.lit("_"), F.col("shard").cast("string"))))


def merge_shards(sharded: DataFrame, order: DataFrame | None, keys: tuple[str, ...] = (), line: str = "line") -> DataFrame:
    """Concatenate shards in the order given by ``order`` (``(*keys, shard, pos)``),
    dropping empty lines, and renumber ``merged_line_no`` from 0 per key.  Shards
    not listed are not part of the output.  ``order=None`` (an empty id list)
    copies the split as it is, empty lines included."""
    if order is None:
        return sharded.withColumn("merged_line_no", F.col("line_no"))
    ks = list(keys)
    kept = (sharded.join(order.select(*ks, "shard", "pos"), [*ks, "shard"], "inner").where(F.col(line) != ""))
    # a shard's first number is the number of kept lines in the shards before it (one row per shard); inside a
    # shard, which holds a bounded number of lines, lines are numbered in order
    sizes = kept.groupBy(*ks, "shard", "pos").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*ks) if ks else Window).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*ks, "shard", "pos", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*ks, "shard", "pos").orderBy("line_no")
    numbered = kept.withColumn("_row", F.row_number().over(inside)).join(first, [*ks, "shard", "pos"])
    return numbered.withColumn("merged_line_no", (F.col("_first") + F.col("_row") - 1).cast("long")).drop("_first", "_row")


def merge_shard_files(spark: SparkSession, folder: str, split: str, shards: Sequence[int], end: str) -> DataFrame:
    """``(merged_line_no, shard, line)``: the listed shard files one after the other without their empty lines, numbered
    from 0.  Only the listed files are read; the numbering is one range sort by (place in the list, line)."""
    kept = read_shards(spark, folder, split, shards, end).where(F.col("line") != "")
    return global_index(kept, ["pos", "line_no"], out="merged_line_no").select("merged_line_no", "shard", "line")
