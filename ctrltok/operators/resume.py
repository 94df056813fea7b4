"""Resumable featurisation: a control corpus built chunk by chunk into a partitioned table.

The corpus table itself is the record of what is done.  Pairs fall into chunks by their line number; a chunk
is finished when the table holds as many of its pairs as the corpus has.  A run featurises the pairs of unfinished
chunks only (left-anti join with the finished ones) in waves of chunks, and every wave replaces its chunks' partitions
as a whole (dynamic partition overwrite).  A run that is killed leaves finished chunks, and perhaps a part of one,
which the next run replaces; run again until nothing is left, the table equals that of one undisturbed run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrltok.session import materialize

CHUNK = ["lang", "feature_set", "split", "chunk"]


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds anything but the writer's own files."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(folder))


def chunked(pairs: DataFrame, feature_set: str, lines_per_chunk: int, line_no: str = "line_no") -> DataFrame:
    """Pairs with their feature set and chunk number."""
    if lines_per_chunk <= 0:
        raise ValueError("lines_per_chunk must be positive")
    return pairs.withColumns({"feature_set": F.lit(feature_set), "chunk": F.floor(F.col(line_no) / lines_per_chunk).cast("long")})


def unfinished(pairs: DataFrame, path: str) -> DataFrame:
    """The chunks (:data:`CHUNK`) of ``pairs`` that the table at ``path`` does not hold whole."""
    wanted = pairs.groupBy(*CHUNK).agg(F.count("*").alias("n"))
    if not table_exists(pairs.sparkSession, path):
        return wanted.drop("n")
    done = pairs.sparkSession.read.parquet(path).groupBy(*CHUNK).agg(F.count("*").alias("n"))
    done = done.select(*[F.col(c).cast(wanted.schema[c].dataType) for c in CHUNK], "n")
    return wanted.join(done, [*CHUNK, "n"], "left_anti").drop("n")


def resume(pairs: DataFrame, path: str, featurise: Callable[[DataFrame], DataFrame], columns: Iterable[str], waves: int = 1,
           stop_after: int | None = None) -> int:
    """Featurise the unfinished chunks of ``pairs`` (:func:`chunked`) into the table at ``path``; returns how many waves were
    written.  ``featurise``: pairs -> rows with the chunk columns and ``columns``.  ``stop_after`` ends the run early."""
    # written down first: the waves replace files of the table that the list was made from
    todo = materialize(unfinished(pairs, path).withColumn("wave", F.pmod(F.xxhash64(*CHUNK), F.lit(waves))), "unfinished")
    numbers = [r[0] for r in todo.select("wave").distinct().orderBy("wave").collect()]        # at most ``waves`` rows
    for done, wave in enumerate(numbers):
        if done == stop_after:
            return done
        part = pairs.join(todo.where(F.col("wave") == wave).drop("wave"), CHUNK, "left_semi")
        rows = featurise(part).select(*columns, *CHUNK)
        (rows.repartition(*CHUNK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*CHUNK).parquet(path))
    return len(numbers)
