"""Gaps in a set of ids, as intervals.

Ids are range-partitioned and sorted; a task looks one id ahead and emits the interval between neighbours.  Each
partition also tells its first and last id, and the intervals between partitions come from these few rows.  No id range
is ever generated to be compared with: the work follows the number of ids, not their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrltok.session import materialize
from ctrltok.udfs import by_value

#: Bits of an id that one expansion step opens: a row never becomes more than 2**12 rows at a time.
STEP_BITS = 12


def missing_intervals(ids: DataFrame, column: str = "sample_id", start: int = 0) -> DataFrame:
    """``(first_missing, last_missing, n_missing)``: the maximal intervals of ids from ``start`` to the largest id that
    do not occur.  Ids below ``start`` and null ids are ignored; no ids, no intervals."""
    wanted = ids.select(F.col(column).cast("long").alias("id")).where(F.col("id") >= start)
    ranged = wanted.repartitionByRange("id").sortWithinPartitions("id")
    names = ["first", "last", "edge"]

    def run(batches):
        low = last = None
        for b in batches:
            at = b.column(0).to_numpy()
            if not len(at):
                continue
            low = int(at[0]) if low is None else low
            before = np.r_[at[0] if last is None else last, at[:-1]]
            gap = np.flatnonzero(at - before > 1)
            yield pa.RecordBatch.from_arrays([pa.array(before[gap] + 1), pa.array(at[gap] - 1), pa.array(np.zeros(len(gap), bool))], names=names)
            last = int(at[-1])
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([last]), pa.array([True])], names=names)

    found = materialize(ranged.mapInArrow(run, "first long, last long, edge boolean"), "gaps")
    # one row per partition
    before = F.lag("last", 1, start - 1).over(Window.orderBy("first", "last"))
    between = (found.where("edge").select((before + 1).alias("first"), (F.col("first") - 1).alias("last")).where("first <= last"))
    gaps = found.where("not edge").select("first", "last").unionByName(between)
    return gaps.select(F.col("first").alias("first_missing"), F.col("last").alias("last_missing"),
                       (F.col("last") - F.col("first") + 1).alias("n_missing"))


def expand(intervals: DataFrame, out: str = "sample_id") -> DataFrame:
    """One row per id of the intervals.  Long intervals are opened in steps of 2**12, spread before the last one."""
    df = intervals.select(F.col("first_missing").alias("a"), F.col("last_missing").alias("b"))
    for shift in range(5 * STEP_BITS, 0, -STEP_BITS):
        k = F.explode(F.sequence(F.shiftright("a", shift), F.shiftright("b", shift))).alias("k")
        low = F.shiftleft("k", shift)
        df = df.select("a", "b", k).select(F.greatest("a", low).alias("a"), F.least("b", low + F.lit((1 << shift) - 1)).alias("b"))
    return df.repartition("a").select(F.explode(F.sequence("a", "b")).alias(out))


by_value(__name__)
