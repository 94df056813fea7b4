"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrltok.session import materialize
from ctrltok.udfs import by_value

by_value(__name__)

SLICE_BYTES = 1 << 21
NO_ID = -(1 << 63)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return materialize(df, f"llm-{name}")


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, whatever other columns there are; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, did, tag)``: ``did`` is the id with null below every
    number, ``tag`` the 64-bit hash of the text.  ``(did, tag)`` identifies a row's
    content, so equal rows share it and rows that repeat an id with other text
    do not mix; among these the smaller tag comes first."""
    return texts(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"),
                              F.xxhash64("text").alias("tag"))


def row_key(docs: DataFrame) -> list[Column]:
    """The columns ``did, tag`` of :func:`keyed` for a table with any columns."""
    text = F.coalesce(docs["`text`"].cast("string"), F.lit(""))
    return [F.coalesce(docs["`doc_id`"].cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("tag")]


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among ``keys (did, tag)``, all columns kept."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *row_key(docs))
    return unpacked(rows.join(keys, ["did", "tag"], "left_anti"), docs.columns)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The struct column ``row`` as a table again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def held(divisor: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``divisor``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(sizes: list[int], limit: int = SLICE_BYTES):
    """Index ranges of consecutive rows with about ``limit`` bytes each (a longer row alone)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def as_long(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed ones."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)
