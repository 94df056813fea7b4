"""Line files: numbered scans, aligned pair scans, and pairing of line tables.

``read_lines`` numbers the lines of text files without a single-partition
window: every file split (``_metadata.file_block_start``) is read in order by
exactly one task, so a line's number is the number of lines in the earlier
splits of its file (a running sum over the few per-split counts) plus its
position inside its split.  Only one row per split is aggregated and joined
back (AQE broadcasts that small table from its measured size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctrltok.functions import text as T


PART_FILE = r"/part-[^/]*$"


def read_lines(spark: SparkSession, paths: str | Sequence[str], n_lines: int | None = None, separator: str | None = None) -> DataFrame:
    """``(file, line_no, value)`` for text files; only the newline (or another ``separator``) is dropped.
    ``n_lines`` keeps the first n lines of every file (a deterministic head).  A folder written
    as part files in line order (``train.src/part-*``) is one file."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep=separator)
    tagged = raw.select(
        F.regexp_replace("_metadata.file_path", PART_FILE, "").alias("file"), F.col("_metadata.file_path").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_mono"),
        "value",
    )
    blocks = tagged.groupBy("file", "part", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    w = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = tagged.join(blocks, ["file", "part", "block"]).select(
        "file", (F.col("_offset") + F.col("_mono") - F.col("_first")).alias("line_no"), "value")
    if n_lines is not None:
        out = out.where(F.col("line_no") < n_lines)
    return out


def head(lines: DataFrame, n: int, line_no: str = "line_no") -> DataFrame:
    """First ``n`` lines of every file (by line number, unlike ``limit``)."""
    return lines.where(F.col(line_no) < n)


def pair_lines(src: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("unit",), how: str = "full",
               strip: bool = True, strict: bool = False) -> DataFrame:
    """Align two line tables ``(*keys, line_no, line)`` by line number.

    ``how='full'`` keeps lines of the longer file with NULL on the other side
    (lenient); ``how='inner'`` truncates to the shorter file.  ``strict=True``
    makes any unmatched line fail the job (``raise_error`` inside the plan, no
    driver round trip)."""
    k = list(keys) + ["line_no"]
    s = src.select(*k, F.col("line").alias("source"))
    t = tgt.select(*k, F.col("line").alias("target"))
    j = s.join(t, k, how)
    if strip:
        j = j.withColumn("source", T.strip("source")).withColumn("target", T.strip("target"))
    if strict:
        bad = F.col("source").isNull() | F.col("target").isNull()
        j = j.withColumn("source", F.when(bad, F.raise_error(F.lit("files do not have the same number of lines")))
                         .otherwise(F.col("source")))
    return j


def pair_tsv(pairs: DataFrame) -> DataFrame:
    """``source \\t target`` lines with ``n_words``, the number of single-space-separated source words.  Nothing is
    sorted here: :func:`ctrltok.sources.sinks.write_pair_tsv` writes them in line order or by (n_words, line_no), which is the
    stable length order, and a numbering takes the same columns."""
    return pairs.withColumn("n_words", F.size(T.split_words("source")).cast("long")) \
                .withColumn("tsv", F.concat_ws("\t", "source", "target"))


def read_pairs(spark: SparkSession, src_path: str, tgt_path: str, strip: bool = True, strict: bool = True,
               n_lines: int | None = None) -> DataFrame:
    """Read a source and a target line file in lock-step by line number:
    ``(line_no, source, target)``.  ``strict`` fails the job when the files have
    different lengths; otherwise the longer file's extra lines pair with NULL."""
    s = read_lines(spark, src_path, n_lines).select(F.lit(0).alias("unit"), "line_no", F.col("value").alias("line"))
    t = read_lines(spark, tgt_path, n_lines).select(F.lit(0).alias("unit"), "line_no", F.col("value").alias("line"))
    return pair_lines(s, t, keys=["unit"], how="full", strip=strip, strict=strict).drop("unit")


# Split names, and the spelling accepted for the validation split.
SPLITS = ("train", "valid", "test")
SPLIT_ALIASES = {"val": "valid"}


def split_name(file_col) -> F.Column:
    """Split of a ``<split>.src`` / ``<split>.tgt`` (or ``<split>_<shard>.*``) file name."""
    raw = F.regexp_extract(file_col, r"([^/_.]+)(?:_[0-9]+)?\.(?:src|tgt)$", 1)
    out = raw
    for alias, name in SPLIT_ALIASES.items():
        out = F.when(raw == alias, F.lit(name)).otherwise(out)
    return out


def read_shards(spark: SparkSession, folder: str, split: str, shards: Sequence[int], end: str) -> DataFrame:
    """``(shard, pos, line_no, line)`` of the listed shard files ``<split>_<shard>.<end>``; ``pos`` is the shard's place in the
    list.  Only the listed files are opened."""
    base = folder.rstrip("/")
    names = [f"{split}_{s}.{end}" for s in shards]
    lines = read_lines(spark, [f"{base}/{n}" for n in names])
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    # the list is an argument of the call, so its array is a literal
    pos = F.array_position(F.array(*[F.lit(n) for n in names]), name) - 1
    return lines.select(F.element_at(F.array(*[F.lit(int(s)) for s in shards]), (pos + 1).cast("int")).cast("long").alias("shard"),
                        pos.cast("long").alias("pos"), "line_no", F.col("value").alias("line"))


def read_corpus(spark: SparkSession, folder: str, lang: str = "en", strip: bool = True,
                strict: bool = True) -> DataFrame:
    """Every ``<split>.src`` / ``<split>.tgt`` pair of a corpus folder as one pair
    table ``(lang, split, stem, line_no, source, target)``; the split comes from the
    file name (``val`` is read as ``valid``) and lines pair up per file."""
    base = folder.rstrip("/")
    # lines pair up by the file's path without its ending: shard files of a split stay apart
    side = lambda end: read_lines(spark, f"{base}/*.{end}").select(
        F.regexp_replace("file", rf"\.{end}$", "").alias("stem"), "line_no", F.col("value").alias("line"))
    pairs = pair_lines(side("src"), side("tgt"), keys=["stem"], how="full", strip=strip, strict=strict)
    return pairs.select(F.lit(lang).alias("lang"), split_name(F.concat("stem", F.lit(".src"))).alias("split"),
                        F.regexp_extract("stem", r"([^/]+)$", 1).alias("stem"), "line_no", "source", "target")
