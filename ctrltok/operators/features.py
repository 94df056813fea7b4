"""Pair features: target/source ratios of character length, edit similarity,
word-frequency rank statistic and tree depth, exact and binned.

Pairs are rows ``(pair_id, lang, source, target, ...)``.  Row-local features
(length, edit similarity, depth) are plain projections.  The frequency
statistic needs a rank lookup, so tokens are exploded, joined to the rank
table and aggregated back per pair; the pairs are hash-partitioned by
``pair_id`` once, up front, so that the explode, the (AQE-broadcast) rank join,
the per-pair aggregation and the join back all reuse that one partitioning.

Three other ways give the same statistic: :class:`HeadedRanks` computes it in the row from the most frequent words and joins ranks
only for texts whose quantile lies beyond them, a rank dictionary of checked size
(:mod:`ctrltok.functions.rankstat`) computes it inside the row, without explode, join or aggregation (the
way of streams), and :func:`frequency_stats_by_text` computes it once per distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrltok.functions import bins as B
from ctrltok.functions import depth as D
from ctrltok.functions import edit as E
from ctrltok.functions import rankstat as RS
from ctrltok.functions import text as T
from ctrltok.session import materialize

SIDES = ("source", "target")


def length_ratio(src="source", tgt="target") -> Column:
    """len(target) / len(source) in code points; NULL for an empty source."""
    s = F.col(src) if isinstance(src, str) else src
    t = F.col(tgt) if isinstance(tgt, str) else tgt
    return F.try_divide(F.length(t).cast("double"), F.length(s).cast("double"))


def length_abs(tgt="target") -> Column:
    t = F.col(tgt) if isinstance(tgt, str) else tgt
    return F.length(t).cast("double")


def edit_ratio(src="source", tgt="target") -> Column:
    return E.edit_ratio(src, tgt)


# A tokenizer maps a text Column to an ARRAY<STRING> Column: a built-in
# expression (the default) or a user pandas UDF (Arrow-batched).
Tokenizer = Callable[[Column], Column]


def _tok(tokenizer: Tokenizer | None, c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (tokenizer or T.tokenize)(col)


# A parse maps a text Column to a heads ARRAY<INT> Column (heads[i] = parent of token i, negative = root).
Parse = Callable[[Column], Column]


def prepare_pairs(pairs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """The pairs with ``source_tokens`` / ``target_tokens``, derived and tokenised once: the table is
    written to the shared checkpoint folder, and every feature, prefix and line reads it from there."""
    df = pairs if "lang" in pairs.columns else pairs.withColumn("lang", F.lit("en"))
    return materialize(df.withColumns({f"{s}_tokens": _tok(tokenizer, s) for s in SIDES}), "pairs")


def tokens_of(df: DataFrame, side: str, tokenizer: Tokenizer | None = None) -> Column:
    """The prepared tokens of a side, or the text tokenised here."""
    return F.col(f"{side}_tokens") if f"{side}_tokens" in df.columns else _tok(tokenizer, side)


def depth_columns(pairs: DataFrame, parse: Parse | DataFrame | str | None) -> tuple[DataFrame, Column, Column]:
    """Pairs with the depths of both sides from a supplied parse: a function of the text column, the prefix of
    heads columns (``<prefix>_source`` / ``<prefix>_target``, several sentences = several roots) or a heads table
    ``(pair_id, side, sent_no, token_no, head_no)``.  There is no default parse."""
    if parse is None:
        raise ValueError("the dependency feature needs a parse (a function, heads columns or a heads table)")
    if isinstance(parse, DataFrame):
        from ctrltok.operators.tree import depth_from_heads

        d = depth_from_heads(parse).groupBy("pair_id").agg(
            *[F.max(F.when(F.col("side") == i, F.col("depth"))).alias(f"_depth_{s}") for i, s in enumerate(SIDES)])
        joined = pairs.join(d, "pair_id", "left")
        return joined, *(F.coalesce(f"_depth_{s}", F.lit(0)) for s in SIDES)
    if isinstance(parse, str):
        return pairs, *(D.max_depth(f"{parse}_{s}") for s in SIDES)
    return pairs, *(D.max_depth(parse(F.col(s))) for s in SIDES)


def depth_ratio_from(ds: Column, dt: Column) -> Column:
    """Target depth / source depth, a depth of 0 counting as 0.5 on either side."""
    return F.try_divide(F.greatest(dt.cast("double"), F.lit(0.5)), F.greatest(ds.cast("double"), F.lit(0.5)))


def with_depth(pairs: DataFrame, parse: Parse | DataFrame | str, absolute: bool = False,
               out: str = "exact_dependency") -> DataFrame:
    """Depth ratio (or absolute target depth, without the 0.5 floor) from a supplied parse."""
    df, ds, dt = depth_columns(pairs, parse)
    df = df.withColumn(out, dt.cast("double") if absolute else depth_ratio_from(ds, dt))
    return df.drop(*[f"_depth_{s}" for s in SIDES])


# ---------------------------------------------------------------------------
# Frequency statistic
# ---------------------------------------------------------------------------

def vocab_sizes(ranks: DataFrame) -> DataFrame:
    """``(lang, vocab)``: distinct words per language (one row per language)."""
    return ranks.groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"))


def side_tokens(pairs: DataFrame, sides: Iterable[str] = SIDES, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``(pair_id, lang, side, token_no, word)`` for every token of the given sides
    (side 0 = source, 1 = target)."""
    structs = [F.struct(F.lit(SIDES.index(s)).alias("side"), tokens_of(pairs, s, tokenizer).alias("toks")) for s in sides]
    per_side = pairs.select("pair_id", "lang", F.inline(F.array(*structs)))
    return per_side.select("pair_id", "lang", "side", F.posexplode("toks").alias("token_no", "word"))


def log_ranks(tokens: DataFrame, ranks: DataFrame) -> DataFrame:
    """Admitted tokens with ``lr = ln(rank + 1)``, or ``ln(vocab + 1)`` when
    the word is not in the rank table (case-sensitive lookup)."""
    admitted = tokens.where(T.admitted("word", "lang"))
    # the rank table is joined without a hint: AQE broadcasts it from its measured
    # size when small and falls back to a (skew-split) sort-merge join otherwise
    looked = admitted.join(ranks.select("lang", "word", "rank"), ["lang", "word"], "left")
    # one row per language: bounded by the number of languages
    looked = looked.join(F.broadcast(vocab_sizes(ranks)), "lang", "left")
    return looked.withColumn("lr", F.ln(F.coalesce(F.col("rank"), F.col("vocab")).cast("double") + 1.0))


def frequency_stats(pairs: DataFrame, ranks: DataFrame, quantile: float = 0.75, sides: Iterable[str] = SIDES,
                    tokenizer: Tokenizer | None = None) -> DataFrame:
    """Per pair, the ``quantile`` (linear interpolation) of the admitted tokens'
    log ranks on each side: columns ``freq_source`` / ``freq_target``; a side
    with no admitted token gets the out-of-vocabulary value ``ln(vocab + 1)``.
    Expects ``pairs`` hash-partitioned by pair_id (see :func:`by_pair`)."""
    sides = list(sides)
    lr = log_ranks(side_tokens(pairs, sides, tokenizer), ranks)
    aggs = [F.percentile(F.when(F.col("side") == SIDES.index(s), F.col("lr")), quantile).alias(f"q_{s}") for s in sides]
    stats = lr.groupBy("pair_id").agg(*aggs)
    oov = F.ln(F.col("vocab").cast("double") + 1.0)
    out = (pairs.join(stats, "pair_id", "left")
           .join(F.broadcast(vocab_sizes(ranks)), "lang", "left"))
    out = out.withColumns({f"freq_{s}": F.coalesce(F.col(f"q_{s}"), oov) for s in sides})
    return out.drop("vocab", *[f"q_{s}" for s in sides])


def row_frequency_stats(pairs: DataFrame, ranks: RS.RankDictionary, quantile: float = 0.75, sides: Iterable[str] = SIDES,
                        tokenizer: Tokenizer | None = None) -> DataFrame:
    """:func:`frequency_stats` by projection only: nothing is exploded, joined or shuffled, and streams may use it."""
    sides, statistic = list(sides), RS.rank_quantile(ranks, quantile)
    df = pairs.withColumns({f"_toks_{s}": tokens_of(pairs, s, tokenizer) for s in sides})
    df = df.withColumns({f"freq_{s}": statistic(T.admitted_tokens(f"_toks_{s}", "lang"), F.col("lang")) for s in sides})
    return df.drop(*[f"_toks_{s}" for s in sides])


class HeadedRanks(NamedTuple):
    """A rank table and its most frequent words as a dictionary of bounded size."""

    table: DataFrame
    head: RS.RankHead


def headed(ranks: DataFrame, langs: Iterable[str] | None = None) -> HeadedRanks:
    """``ranks`` with the head of the given languages (else of all); pairs may be in other languages too."""
    return HeadedRanks(ranks, RS.load_rank_head(ranks, langs))


def headed_frequency_stats(pairs: DataFrame, ranks: HeadedRanks, quantile: float = 0.75, sides: Iterable[str] = SIDES,
                           tokenizer: Tokenizer | None = None) -> DataFrame:
    """:func:`frequency_stats` by projection for the texts whose quantile the head of the rank table decides; only the others' tokens
    are exploded and joined, and the pairs are then stored in between.  Rows that share a ``pair_id`` are one group of tokens
    there, so they are among the others.  Whether there are others is looked up when this is called."""
    sides, near, head = list(sides), RS.rank_neighbours(ranks.head, quantile), ranks.head
    df = pairs.withColumns({f"_toks_{s}": tokens_of(pairs, s, tokenizer) for s in sides})
    df = df.withColumns({f"_near_{s}": near(T.admitted_tokens(f"_toks_{s}", "lang"), F.col("lang")) for s in sides})
    repeated = pairs.where("pair_id is not null").groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    some_repeat = not repeated.isEmpty()
    beyond = sorted(set(head.vocabularies) - head.whole)
    some_open = bool(beyond) and not pairs.where(F.col("lang").isin(beyond)).isEmpty()
    if some_repeat or some_open:
        if some_repeat:
            df = df.join(repeated.withColumn("_again", F.lit(True)), "pair_id", "left")
        again = F.coalesce("_again", F.lit(False)) if some_repeat else F.lit(False)
        is_open = {s: again | F.coalesce(F.col(f"_near_{s}")[RS.HIGH] == float("inf"), F.lit(False)) for s in sides}
        df = materialize(df.withColumns({f"_toks_{s}": F.when(is_open[s], F.col(f"_toks_{s}")) for s in sides}).drop("_again"), "head")
        rest = df.select("pair_id", "lang", *[F.col(f"_toks_{s}").alias(f"{s}_tokens") for s in sides])
        lr = log_ranks(side_tokens(rest, sides), ranks.table)
        # stored, so that its measured size decides the join
        stats = materialize(lr.groupBy("pair_id").agg(
            *[F.percentile(F.when(F.col("side") == SIDES.index(s), F.col("lr")), quantile).alias(f"_q_{s}") for s in sides]), "head")
        df = df.join(stats, "pair_id", "left")
    else:
        df = df.withColumns({f"_q_{s}": F.lit(None).cast("double") for s in sides})
    # a row without a pair_id belongs to no group of tokens
    oov = {s: F.when(F.col("pair_id").isNull(), F.ln(F.col(f"_near_{s}")[RS.UNKNOWN] + 1.0)) for s in sides}
    df = df.withColumns({f"freq_{s}": F.coalesce(oov[s], f"_q_{s}", RS.log_quantile(F.col(f"_near_{s}"))) for s in sides})
    return df.drop(*[f"{c}_{s}" for s in sides for c in ("_toks", "_near", "_q")])


TEXT_KEY = ["lang", "_t1", "_t2"]


def text_key(text) -> list[Column]:
    """128 bits of a text's hash as two columns ``_t1``, ``_t2``."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def distinct_texts(pairs: DataFrame, sides: Iterable[str] = SIDES) -> DataFrame:
    """``(lang, _t1, _t2, text)``: every distinct text of the given sides once (partially aggregated before the shuffle)."""
    texts = pairs.select("lang", F.explode(F.array(*[F.col(s) for s in sides])).alias("text")).where("text is not null")
    return texts.select("lang", *text_key(F.col("text")), "text").groupBy(*TEXT_KEY).agg(F.first("text").alias("text"))


def frequency_stats_by_text(pairs: DataFrame, ranks: DataFrame, quantile: float = 0.75, sides: Iterable[str] = SIDES,
                            tokenizer: Tokenizer | None = None) -> DataFrame:
    """:func:`frequency_stats` with every distinct (language, text) tokenised, exploded and aggregated once, whatever
    the number of pairs and sides it stands in; the statistic is joined back by the text's hash."""
    sides = list(sides)
    words = distinct_texts(pairs, sides).select(*TEXT_KEY, F.explode(_tok(tokenizer, "text")).alias("word"))
    stats = log_ranks(words, ranks).groupBy(*TEXT_KEY).agg(F.percentile("lr", quantile).alias("_q"))
    oov = F.ln(F.col("vocab").cast("double") + 1.0)
    out = pairs.join(F.broadcast(vocab_sizes(ranks)), "lang", "left")
    for s in sides:
        keyed = out.select("*", *text_key(F.col(s)))
        out = keyed.join(stats, TEXT_KEY, "left").withColumn(f"freq_{s}", F.coalesce("_q", oov)).drop("_t1", "_t2", "_q")
    return out.drop("vocab")


def by_pair(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Hash-partition pairs by ``pair_id`` once so downstream per-pair aggregations and joins do not shuffle
    again.  The number of partitions is the session's; AQE coalesces by measured size."""
    return pairs.repartition(key)


def with_frequency(pairs: DataFrame, ranks: DataFrame | RS.RankDictionary | HeadedRanks, absolute: bool = False, out: str = "exact_frequency",
                   tokenizer: Tokenizer | None = None) -> DataFrame:
    """The frequency ratio (or the target's statistic); a rank dictionary makes it a projection, headed ranks nearly one."""
    headed_form = headed_frequency_stats if isinstance(ranks, HeadedRanks) else frequency_stats
    stats = row_frequency_stats if isinstance(ranks, RS.RankDictionary) else headed_form
    if absolute:
        st = stats(pairs, ranks, sides=["target"], tokenizer=tokenizer)
        return st.withColumn(out, F.col("freq_target")).drop("freq_target")
    st = stats(pairs, ranks, tokenizer=tokenizer)
    return (st.withColumn(out, F.try_divide(F.col("freq_target"), F.col("freq_source")))
              .drop("freq_source", "freq_target"))


# ---------------------------------------------------------------------------
# Bundle
# ---------------------------------------------------------------------------

def feature_bundle(pairs: DataFrame, features: Iterable[str], ranks: DataFrame | RS.RankDictionary | HeadedRanks | None = None,
                   binned: bool = True, tokenizer: Tokenizer | None = None,
                   parse: Parse | DataFrame | str | None = None, partitioned: bool = False) -> DataFrame:
    """Add ``exact_<feature>`` (and ``bin_<feature>``, ``bin_idx_<feature>``) for the
    requested features only; unrequested branches never enter the plan.  ``dependency`` needs a
    ``parse`` (see :func:`depth_columns`).  ``partitioned``: the pairs are already hash-partitioned by
    ``pair_id`` (a bucketed table), so the frequency feature does not shuffle them; with a rank dictionary it
    never does, with headed ranks only when some quantile lies beyond the head or a ``pair_id`` repeats."""
    fs = sorted(set(features))
    unknown = set(fs) - set(B.FEATURES)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    # a corpus without a language column is English (the stop-list default)
    df = pairs if "lang" in pairs.columns else pairs.withColumn("lang", F.lit("en"))
    if "frequency" in fs:
        if ranks is None:
            raise ValueError("the frequency feature needs a rank table")
        local_ranks = partitioned or isinstance(ranks, (RS.RankDictionary, HeadedRanks))
        df = with_frequency(df if local_ranks else by_pair(df), ranks, tokenizer=tokenizer)
    local = {}
    if "dependency" in fs:
        df, ds, dt = depth_columns(df, parse)
        local["exact_dependency"] = depth_ratio_from(ds, dt)
    if "length" in fs:
        local["exact_length"] = length_ratio()
    if "levenshtein" in fs:
        local["exact_levenshtein"] = edit_ratio()
    if local:
        df = df.withColumns(local).drop(*[f"_depth_{s}" for s in SIDES])
    if binned:
        df = df.withColumns({f"bin_idx_{f}": B.bin_index(F.col(f"exact_{f}"), f) for f in fs})
        df = df.withColumns({f"bin_{f}": B.edge_of(F.col(f"bin_idx_{f}")) for f in fs})
    return df
