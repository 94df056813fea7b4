"""Tree depth from a supplied parse table.

``heads(pair_id, side, sent_no, token_no, head_no)`` (head_no < 0 = root) is
grouped per sentence into a heads array -- a group is one sentence, so its
size is bounded by the sentence length, never by the data -- and resolved by
the batched pointer-jumping UDF; the text's depth is the maximum over its
sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.functions.depth import max_depth


def sentence_heads(heads: DataFrame, keys=("pair_id", "side", "sent_no")) -> DataFrame:
    ks = list(keys)
    g = heads.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("token_no", "head_no"))).alias("t"))
    return g.select(*ks, F.transform("t", lambda x: x["head_no"].cast("int")).alias("heads"))


def depth_from_heads(heads: DataFrame, keys=("pair_id", "side"), sent: str = "sent_no") -> DataFrame:
    """``(*keys, depth)``: max over the sentences of each text."""
    per_sent = sentence_heads(heads, (*keys, sent)).withColumn("d", max_depth("heads"))
    return per_sent.groupBy(*keys).agg(F.max("d").alias("depth"))


def depth_ratio_from_heads(heads: DataFrame) -> DataFrame:
    """``(pair_id, depth_source, depth_target, depth_ratio)`` with the 0.5 floor;
    side 0 = source, 1 = target."""
    d = depth_from_heads(heads)
    p = d.groupBy("pair_id").agg(F.max(F.when(F.col("side") == 0, F.col("depth"))).alias("depth_source"),
                                 F.max(F.when(F.col("side") == 1, F.col("depth"))).alias("depth_target"))
    ratio = F.try_divide(F.greatest(F.coalesce("depth_target", F.lit(0)).cast("double"), F.lit(0.5)),
                         F.greatest(F.coalesce("depth_source", F.lit(0)).cast("double"), F.lit(0.5)))
    return p.withColumn("depth_ratio", ratio)
