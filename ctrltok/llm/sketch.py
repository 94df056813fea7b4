"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's five-word shingles
(words split at ASCII white space, lower-cased; fewer words: one shingle of all; none: an empty sketch).
Sketches of parts merge to the sketch of the whole, and estimate resemblance, containment and the
number of distinct shingles.

Defined results: null text is empty; two empty sketches resemble fully, an empty and another one not at
all; equal texts have equal sketches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctrltok.llm.common import NO_ID, keyed, stored

K = 128
SHINGLE = 5
NO_HASHES = "cast(array() as array<bigint>)"


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text column."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    hashed = df.withColumn("_words", F.transform(words, lambda x: F.xxhash64(x)))
    n, w = F.size("_words"), F.col("_words")
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
    few = F.array(F.xxhash64(w))
    grams = F.when(n >= shingle, many).when(n > 0, few).otherwise(F.expr(NO_HASHES))
    return hashed.withColumn(name, bottom(grams, k)).drop("_words")


def bottom(hashes: Column, k: int) -> Column:
    """The ``k`` smallest distinct hashes, sorted."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return bottom(F.concat(a, b), k)


def merge_parts(parts: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from any number of part sketches.  Only the ``k`` smallest hashes of a key leave
    a task (Spark limits the rank before the shuffle), so a key with very many parts stays small."""
    hashes = parts.select(key, F.explode_outer(sketch).alias("h")).distinct()
    first = Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last())
    return (hashes.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
            .groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two texts."""
    union = merged(a, b, k)
    both = F.array_intersect(F.array_intersect(union, a), b)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    span = (sketch.getItem(k - 1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def fingerprint(sketch: Column) -> Column:
    """Hex digits of a sketch."""
    return F.lower(F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0"))))


def successors(ids: DataFrame) -> DataFrame:
    """``did, tag, n`` with ``next_did, next_tag``: the next document in ascending order, after the last the first.

    Ids are range-partitioned; each partition looks ahead inside itself and its last row takes the first row
    of the next partition, so no task sees more than one range."""
    order = ["did", "tag"]
    ranged = stored(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "id-ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    heads = ranged.groupBy("part").agg(F.min(F.struct("did", "tag")).alias("head"))
    # one row per range partition: a window over all of them is small, and so is its broadcast
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(over)).alias("after"))
    found = ranged.withColumn("next", F.lead(F.struct("did", "tag")).over(inside)).join(F.broadcast(ahead), "part")
    follow = F.coalesce("next", "after")
    return found.select("did", "tag", "n", follow["did"].alias("next_did"), follow["tag"].alias("next_tag"))


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of every text, of its edited text and their likeness to each other and to the next document.

    The edited text is the text with its last quarter replaced by as much of the start of the next document
    (ascending doc_id, rows of one id by their text's hash, a null id first; equal rows are one document here).  A
    document sends only the quarter that its predecessor needs, with its sketch."""
    rows = keyed(docs).select("did", "tag", "text")  # the same columns in both joins: their shuffle is reused
    ids = stored(rows.select("did", "tag", F.char_length("text").alias("n")).distinct(), "ids")
    follow = successors(ids).select(
        F.col("next_did").alias("did"), F.col("next_tag").alias("tag"),
        F.col("did").alias("for_did"), F.col("tag").alias("for_tag"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    heads = rows.join(follow, ["did", "tag"]).dropDuplicates(["for_did", "for_tag"])
    heads = with_sketch(heads, "text", "next_sketch", k, shingle).select(
        F.col("for_did").alias("did"), F.col("for_tag").alias("tag"), F.expr("substring(text, 1, need)").alias("head"), "next_sketch")
    joined = rows.join(heads, ["did", "tag"]).withColumn("n", F.char_length("text"))
    both = joined.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n", "text", F.concat(F.expr("substring(text, 1, n - cast(floor(n / 4) as int))"), "head").alias("edited"), "next_sketch")
    both = with_sketch(with_sketch(both, "text", "sketch", k, shingle), "edited", "edited_sketch", k, shingle)
    return both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "sketch", "edited_sketch", "next_sketch")


def digests(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints as hex strings, likeness to the edited text and to the next document."""
    found = edited_fingerprints(docs, k, shingle)
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"),
                        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
