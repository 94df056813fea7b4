"""Piece tables ``(piece, score)`` from vocabulary files.

* ``*.model``: a unigram tokeniser's model file (protocol buffers: field 1 repeats a message of piece, score, type);
* ``*.tiktoken``: a rank file, one base64 token and its rank a line;
* any other name: text lines ``piece<TAB>score``.

Bytes that are no UTF-8 text, control and unused pieces, and pieces with white space or with a piece mark after their first
character are left out.  A token that begins with a space begins with the piece mark instead.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrltok.functions.subword import Segmenter
from ctrltok.functions.text import PIECE_MARK, WHITESPACE_CLASS

#: A piece table is small enough to travel with every task; larger ones are refused.
MOST_PIECES = 1 << 20
#: Score of a rank by Zipf's law in thousandths (whole numbers, so sums are exact), and the unknown penalty on this scale.
RANK_SCALE = 1000
RANK_PENALTY = 10.0 * RANK_SCALE
# Piece types of a model file that stand for text.
TEXT_TYPES = (1, 4)


def model_pieces(content: bytes) -> list[tuple[str, float]]:
    """``(piece, score)`` of a model file's text pieces."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = content[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            key, at = varint(at)
            kind = key & 7
            if kind == 0:
                value, at = varint(at)
            elif kind == 2:
                size, at = varint(at)
                value, at = (at, at + size), at + size
            else:
                size = 4 if kind == 5 else 8
                value, at = content[at:at + size], at + size
            yield key >> 3, value

    out = []
    for number, value in fields(0, len(content)):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, v in fields(*value):
                if n == 1:
                    piece = content[v[0]:v[1]].decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind in TEXT_TYPES:
                out.append((piece, score))
    return out


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(piece, score)`` of a vocabulary file, the best score of each piece."""
    if path.endswith(".model"):
        content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        table = spark.createDataFrame(model_pieces(content), "piece string, score double")
    elif path.endswith(".tiktoken"):
        parts = F.split("value", " ")
        token = F.unbase64(parts[0]).cast("string")
        lines = spark.read.text(path).where(F.size(parts) == 2).select(token.alias("token"), parts[1].cast("long").alias("rank"))
        score = -F.floor(F.lit(RANK_SCALE) * F.ln(F.col("rank") + 2)).cast("double")
        table = lines.where(F.is_valid_utf8("token")).select(
            F.regexp_replace("token", "^ ", PIECE_MARK).alias("piece"), score.alias("score"))
    else:
        parts = F.split("value", "\t")
        table = spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("piece"), parts[1].cast("double").alias("score"))
    fit = (F.length("piece") > 0) & ~F.col("piece").rlike(rf"[{WHITESPACE_CLASS}]|(?s).{PIECE_MARK}")
    return table.where(fit).groupBy("piece").agg(F.max("score").alias("score"))


def segmenter(pieces: DataFrame, unknown_penalty: float = 10.0, normalization: str | None = None) -> Segmenter:
    """The segmenter of a piece table of at most ``MOST_PIECES`` rows."""
    rows = pieces.select("piece", "score").limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"the piece table has more than {MOST_PIECES} rows")
    return Segmenter({r["piece"]: r["score"] for r in rows}, unknown_penalty, normalization)


def load_segmenter(spark: SparkSession, path: str, normalization: str | None = None) -> Segmenter:
    """The segmenter of a vocabulary file."""
    penalty = RANK_PENALTY if path.endswith(".tiktoken") else 10.0
    return segmenter(read_pieces(spark, path), penalty, normalization)
