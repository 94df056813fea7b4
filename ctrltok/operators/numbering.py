"""Global, gap-free row numbering without a single-partition window.

``row_number()`` over an unpartitioned (or hot-key-partitioned) window moves
every row through one task.  Instead, rows are range-sorted across all
partitions, each partition counts its rows per group, a running sum over those
few counts gives every partition's starting offset, and each row adds its
position inside the partition.  Only the per-partition counts (one row per
partition and group) are aggregated centrally.

Right after the sort each row is stamped with its sort partition and its
position id, and the stamped rows are written once to the shared checkpoint
folder: the count branch and the row branch then read identical stored values
(whatever AQE would coalesce differently on a recomputation), and a lost
executor re-reads instead of re-sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctrltok.session import materialize


def global_index(df: DataFrame, order_by: Sequence[Column | str], group_by: Sequence[str] = (),
                 out: str = "row_no", start: int = 0) -> DataFrame:
    """Add ``out`` = 0-based (or ``start``-based) position of each row within its
    ``group_by`` group in ``order_by`` order.  The order must be total (ties
    broken by a unique key) for the numbering to be deterministic."""
    keys = [F.col(g) for g in group_by] + [F.col(c) if isinstance(c, str) else c for c in order_by]
    # one range-partitioned sort; partitions are ordered, rows sorted within them
    ranged = df.orderBy(*keys)
    stamped = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    tagged = materialize(stamped, "numbered")
    gcols = list(group_by)
    counts = tagged.groupBy(*gcols, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    w = Window.partitionBy(*gcols).orderBy("_part") if gcols else Window.orderBy("_part")
    offsets = counts.withColumn("_offset", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select(*gcols, "_part", F.coalesce(F.col("_offset"), F.lit(0)).alias("_offset"), "_first")
    joined = tagged.join(offsets, [*gcols, "_part"], "inner")
    idx = F.col("_offset") + (F.col("_mono") - F.col("_first")) + F.lit(start)
    return joined.withColumn(out, idx.cast("long")).drop("_part", "_mono", "_offset", "_first")
