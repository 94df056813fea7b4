"""A deterministic parse for the registered queries and tests.  Not a parser: users supply their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrltok.functions import text as T


def synthetic_heads(tokens) -> Column:
    """Deterministic test parse: token i >= 1 (0-based) hangs under
    ``i - 1 - (length(token_i) % i)``; token 0 is the root."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(tokens, lambda t, i: F.when(i == 0, F.lit(-1)).otherwise(i - 1 - F.length(t) % i))


def parse_text(text: Column) -> Column:
    """Heads of the text's tokens."""
    return synthetic_heads(T.tokenize(text))


def heads_table(pairs: DataFrame) -> DataFrame:
    """``(pair_id, side, sent_no, token_no, head_no)``: every line of a text parsed as a sentence of its own."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("text")) for i, s in enumerate(("source", "target"))])
    lines = pairs.select("pair_id", F.inline(sides)).select(
        "pair_id", "side", F.posexplode(F.split("text", "\n", -1)).alias("sent_no", "line"))
    return lines.select("pair_id", "side", "sent_no", F.posexplode(parse_text(F.col("line"))).alias("token_no", "head_no"))
