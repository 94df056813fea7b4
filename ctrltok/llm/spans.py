"""Positions of regular-expression matches in DataFrame functions only.

Spark returns matches and the text between them but no positions; both lists come from the same left-to-right
scan, so a running sum of their lengths gives every start.  A span is
``struct(start, stop, value, before)`` in code points, ``stop`` exclusive; ``before`` is the text right before it
(at most ``CONTEXT`` code points, earlier matches included).

A fold that appends to an array copies it at every step, so matches are folded in blocks of ``BLOCK``: a block starts at the
summed length of the blocks before it and with the text of the ``CONTEXT`` matches before it, and the blocks' results
are flattened once.  The work is proportional to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 80
BLOCK = 256
SPAN = "struct<start:int,stop:int,value:string,before:string>"


def tail(c: Column) -> Column:
    return F.right(c, F.lit(CONTEXT))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (an expression inside a lambda is computed at every call)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: str, pattern: str, keep: Callable[[Column, Column], Column], group: int = 0,
          likely: Column | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches for which ``keep(match, group)`` holds.

    ``likely``: a cheap condition that every text with a match fulfils."""
    t = F.col(text)
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else whole
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    zipped = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), whole.alias("m"), inner.alias("g"))
    matched = F.filter(zipped, lambda x: x["m"].isNotNull())
    length = lambda x: F.char_length(x["gap"]) + F.char_length(x["m"])

    def cut(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: F.struct(
            F.slice(z, k * BLOCK + 1, BLOCK).alias("rows"),
            F.slice(z, F.greatest(k * BLOCK + 1 - CONTEXT, F.lit(1)), F.least(k * BLOCK, F.lit(CONTEXT))).alias("ahead")))

    def starts(blocks: Column) -> Column:
        # one start per block: the array that this fold copies is short
        sizes = F.transform(blocks, lambda b: F.aggregate(b["rows"], F.lit(0), lambda n, x: n + length(x)))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["m"])
        before = tail(F.concat(acc["last"], tail(x["gap"])))
        span = F.struct(begin.alias("start"), end.alias("stop"), x["m"].alias("value"), before.alias("before"))
        out = F.when(F.coalesce(keep(x["m"], x["g"]), F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), tail(F.concat(before, tail(x["m"]))).alias("last"), out.alias("out"))

    def block(b: Column, start: Column) -> Column:
        last = tail(F.array_join(F.transform(b["ahead"], lambda x: F.concat(tail(x["gap"]), tail(x["m"]))), ""))
        return F.aggregate(b["rows"], F.struct(start.alias("at"), last.alias("last"), none.alias("out")), step, lambda acc: acc["out"])

    hits = let(matched, lambda z: let(cut(z), lambda blocks: let(starts(blocks), lambda at: F.flatten(
        F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), block)))))
    test = t.rlike(pattern) if likely is None else likely & t.rlike(pattern)
    return F.when(test, hits).otherwise(none)


def covered(spans: DataFrame, start: str, stop: str, covers: Column, flag: str = "covered") -> DataFrame:
    """``flag``: whether a row's span overlaps a span of the same text (``did, tag``) for which ``covers`` holds; rows that
    cover are not tested.  Two sorts per text: the furthest end before and the nearest start after."""
    # both frames grow (a frame that shrinks to the end is computed anew for every row)
    up, down = (Window.partitionBy("did", "tag").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)
                for o in (F.col(start).asc(), F.col(start).desc()))
    ahead = F.max(F.when(covers, F.col(stop))).over(up)
    after = F.min(F.when(covers, F.col(start))).over(down)
    touched = F.coalesce(ahead > F.col(start), F.lit(False)) | F.coalesce(after < F.col(stop), F.lit(False))
    return spans.withColumn(flag, ~covers & touched)


def marked(spans: Column, kind: int) -> Column:
    """``struct(start, kind, stop)`` of spans."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def listed(spans: Column, names: list[str]) -> Column:
    """``kind:start:stop`` of ``struct(.., kind, ..)`` in the array's order, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))
