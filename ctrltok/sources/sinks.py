"""Writers for corpora and reports.

Partitioned parquet is the primary format (partition pruning by language,
feature set and split replaces a directory-per-corpus layout).  Plain-text
exports keep line order without funnelling rows through one task: rows are
range-partitioned by their line number and sorted inside each partition, so
the part files, read in name order, are the corpus in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_control_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(lang, feature_set, split, line_no, source_line, target_line, ...)`` as
    parquet partitioned by language, feature set and split."""
    df.write.mode(mode).partitionBy("lang", "feature_set", "split").parquet(path)


Order = str | Column | Sequence[str | Column]


def _order(order: Order) -> list[Column]:
    many = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(c) if isinstance(c, str) else c for c in many]


def export_text(df: DataFrame, col: str, path: str, order: Order = "line_no", partitions: int | None = None,
                mode: str = "overwrite") -> None:
    """One text line per row, in ``order`` (one column or several): one range partitioning + per-partition sort.  The number of
    files follows the session's shuffle partitions and AQE unless ``partitions`` is given."""
    keys = _order(order)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    out = ranged.sortWithinPartitions(*keys).select(F.col(col).alias("value"))
    out.write.mode(mode).text(path)



def write_shard_files(df: DataFrame, folder: str, source: str = "source", target: str = "target", order: Order = "line_no",
                      mode: str = "overwrite") -> None:
    """Shards as ordered text files ``<split>_<shard>.src`` and ``.tgt`` (folders of part files, one text line a row), as
    :func:`ctrltok.sources.lines.read_lines` reads them.

    Rows of both sides are clustered by one range partitioning over (file, order): a shard lies in few part files whose
    names follow the order, a task writes its files one after the other, and a large shard is written by several tasks."""
    keys = _order(order)
    sides = F.array(*[F.struct(F.concat("split", F.lit("_"), F.col("shard").cast("string"), F.lit(end)).alias("name"),
                               F.col(c).alias("value")) for c, end in ((source, ".src"), (target, ".tgt"))])
    rows = df.select(*[k.alias(f"_o{i}") for i, k in enumerate(keys)], F.inline(sides))
    by = ["name", *(f"_o{i}" for i in range(len(keys)))]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("name", "value").write.mode(mode).partitionBy("name").text(folder)
    _plain_names(df, folder)


def _plain_names(df: DataFrame, folder: str) -> None:
    """Folders ``name=<x>`` become ``<x>`` (a rename per shard file, no data moved)."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("name="):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(path, name[len("name="):]))


def write_pair_tsv(df: DataFrame, path: str, order: Order = "line_no", mode: str = "overwrite") -> None:
    """``source \\t target`` lines (never quoted or escaped) in ``order``; ``order=["n_words", "line_no"]`` of
    :func:`ctrltok.sources.lines.pair_tsv` is the length order.  The only sort is the writer's."""
    tsv = df if "tsv" in df.columns else df.withColumn("tsv", F.concat_ws("\t", "source", "target"))
    export_text(tsv, "tsv", path, order=order, mode=mode)


def write_inference_corpus(df: DataFrame, path: str, order: str = "line_no", mode: str = "overwrite") -> None:
    export_text(df, "model_input", path, order=order, mode=mode)


def write_mismatch_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Round-trip mismatches (file, side, line, original, decoded) as parquet, one folder per file and side."""
    df.write.mode(mode).partitionBy("file", "side").parquet(path)
