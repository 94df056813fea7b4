"""Frequency-rank tables and vocabularies.

* ``ranks_from_vectors``: a word-vector text file (header line, then one word
  per line by descending frequency) -> ``(lang, word, rank)`` with rank = line
  index (header = 0); a word listed twice keeps its last rank.
* ``ranks_from_corpus``: rank words by their token count in a corpus
  (count descending, then word), numbered 1.. per language without a
  single-task window (see :mod:`ctrltok.operators.numbering`).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrltok.functions import text as T
from ctrltok.operators.numbering import global_index
from ctrltok.session import materialize as materialize_table


def ranks_from_vectors(lines: DataFrame, keys: tuple[str, ...] = ("lang",), lang: str = "en") -> DataFrame:
    """``lines``: ``(*keys, line_no, value)`` as produced by the line scan (one
    vector file per key; a missing ``lang`` column defaults to ``lang``)."""
    df = lines if "lang" in lines.columns or "lang" not in keys else lines.withColumn("lang", F.lit(lang))
    ks = list(keys)
    words = (df.where(F.col("line_no") > 0)
               .select(*ks, F.split(T.strip(F.col("value")), rf"[{T.WHITESPACE_CLASS}]+", 2)[0].alias("word"),
                       "line_no")
               .where(F.col("word").isNotNull() & (F.col("word") != "")))
    return words.groupBy(*ks, "word").agg(F.max("line_no").alias("rank"))


def token_counts(texts: DataFrame, text_col: str = "text", tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(lang, word, cnt)``; partial aggregation happens before the shuffle, so
    a hot word costs one row per map task, not one per occurrence.  ``tokenizer`` as in the corpus operators."""
    toks = texts.select("lang", F.explode((tokenizer or T.tokenize)(F.col(text_col))).alias("word"))
    return toks.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt"))


def ranks_from_corpus(texts: DataFrame, text_col: str = "text", materialize: bool = True,
                      tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(lang, word, cnt, rank)``, rank 1 = most frequent word of the language.  A corpus tokenised with its own
    ``tokenizer`` looks its tokens up in ranks of that tokenizer.

    The rank table is a product that every frequency feature looks up (the
    table is kept as a file per language), so by default it is
    written into the shared checkpoint folder once; later lookups, the
    vocabulary-size aggregate and the out-of-vocabulary default all scan that
    table instead of re-running the numbering."""
    counts = token_counts(texts, text_col, tokenizer)
    ranked = global_index(counts, [F.col("cnt").desc(), F.col("word")], group_by=["lang"], out="rank", start=1)
    return materialize_table(ranked, "ranks") if materialize else ranked


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Vocabulary size and the most / least frequent word per language."""
    return ranks.groupBy("lang").agg(
        F.count(F.lit(1)).alias("vocab_size"),
        F.min_by("word", "rank").alias("most_frequent"),
        F.max_by("word", "rank").alias("least_frequent"),
    )


def rank_lookup(tokens: DataFrame, ranks: DataFrame) -> DataFrame:
    """Tokens with ``raw_rank = coalesce(rank, vocab) + 1`` and
    ``log_rank = ln(raw_rank)`` (the out-of-vocabulary default is the vocabulary size)."""
    vocab = ranks.groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"))
    j = tokens.join(ranks.select("lang", "word", "rank"), ["lang", "word"], "left") \
              .join(F.broadcast(vocab), "lang", "left")
    raw = F.coalesce(F.col("rank"), F.col("vocab")) + 1
    return j.withColumn("raw_rank", raw.cast("long")).withColumn("log_rank", F.ln(raw.cast("double")))


# The special symbols a sequence-model dictionary starts with, in order.
SPECIAL_SYMBOLS = ("<s>", "<pad>", "</s>", "<unk>")


def vocabulary(pairs: DataFrame, specials: tuple[str, ...] = (), tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per side, token counts in frequency order: ``(side, token, cnt, freq_rank)``
    (the dictionary a sequence model is trained with).  With ``specials`` (e.g.
    :data:`SPECIAL_SYMBOLS`) those symbols take ranks 1..k with a NULL count and
    the corpus tokens follow from k+1."""
    tok = tokenizer or T.tokenize
    toks = pairs.select(F.inline(F.array(
        F.struct(F.lit("src").alias("side"), tok(F.col("source")).alias("toks")),
        F.struct(F.lit("tgt").alias("side"), tok(F.col("target")).alias("toks")))))
    counts = toks.select("side", F.explode("toks").alias("token")).groupBy("side", "token") \
                 .agg(F.count(F.lit(1)).alias("cnt"))
    if specials:
        counts = counts.where(~F.col("token").isin(list(specials)))
    ranked = global_index(counts, [F.col("cnt").desc(), F.col("token")], group_by=["side"], out="freq_rank",
                          start=1 + len(specials))
    if not specials:
        return ranked
    sides = F.array(F.lit("src"), F.lit("tgt"))
    head = pairs.sparkSession.range(len(specials)).select(
        F.explode(sides).alias("side"),
        F.element_at(F.array(*[F.lit(x) for x in specials]), (F.col("id") + 1).cast("int")).alias("token"),
        F.lit(None).cast("long").alias("cnt"), (F.col("id") + 1).alias("freq_rank"))
    return ranked.select("side", "token", "cnt", "freq_rank").unionByName(head)


def save_ranks(ranks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rank tables per language (``lang=<x>`` folders; partition pruning on load)."""
    ranks.select("lang", "word", "rank").write.mode(mode).partitionBy("lang").parquet(path)


def load_ranks(spark, path: str, lang: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("lang") == lang) if lang else df


# Fixed value: a fragment of a JSON object between two separators: a key without its opening quote, its rank, maybe the end.
JSON_ENTRY = r'(?s)\A((?:[^"\\]++|\\.)*+)"\s*:\s*(-?[0-9]+)\s*\}?\s*\z'


# Fixed value: the rest of an entry whose key ended with the separator.
JSON_RANK = r"\A\s*:\s*-?[0-9]+\s*\}?\s*\z"


def json_separator(spark, path: str) -> str | None:
    """What stands between two entries of a JSON object, the next entry's opening quote included (None: one entry or none)."""
    head = [r["value"] for r in spark.read.text(path, lineSep=",").limit(64).collect()]
    for a, b in zip(head, head[1:], strict=False):
        space = b[:len(b) - len(b.lstrip())]
        if re.search(r'"\s*:\s*-?[0-9]+\s*\Z', a) and b[len(space):].startswith('"'):
            return f',{space}"'
    return None


def ranks_from_json(spark, path: str, lang: str) -> DataFrame:
    """Import a ``{"word": rank, ...}`` JSON object file, cut over as many tasks as the file has splits.

    The entries' separator (comma, white space, quote) ends a record of the text scan.  A quote inside a key is escaped, so the
    separator stands between entries or, if a key ends with a comma and that white space, at the key's end; such a
    key's record lacks its rank, which is the next record.  Records that are no whole entry therefore come in such pairs: within a
    run of them the first, third, .. is a key and is joined with the next by its number.  An object whose separators differ
    fails the job."""
    from ctrltok.sources.lines import read_lines

    sep = json_separator(spark, path)
    if sep is None:
        raw = spark.read.text(path, wholetext=True)                 # one entry or none
        pairs = raw.select(F.explode(F.from_json("value", "MAP<STRING,BIGINT>")).alias("word", "rank"))
        return pairs.select(F.lit(lang).alias("lang"), "word", "rank")
    records = read_lines(spark, path, separator=sep).select(
        "file", "line_no", F.when(F.col("line_no") == 0, F.regexp_replace("value", r'\A\s*\{\s*"', "")).otherwise(F.col("value")).alias("value"))
    whole = F.col("value").rlike(JSON_ENTRY)
    broken = global_index(records.where(~whole), ["file", "line_no"], out="_i").withColumn("_run", F.col("line_no") - F.col("_i"))
    place = broken.join(broken.groupBy("file", "_run").agg(F.min("line_no").alias("_first")), ["file", "_run"])
    odd = (F.col("line_no") - F.col("_first")) % 2 == 1
    tails = place.where(odd & F.col("value").rlike(JSON_RANK)).select("file", (F.col("line_no") - 1).alias("line_no"), F.col("value").alias("tail"))
    joined = place.where(~odd).join(tails, ["file", "line_no"], "left").select(
        F.concat("value", F.lit(sep), F.coalesce("tail", F.raise_error(F.lit("not an object of words and ranks")).cast("string"))).alias("value"))
    entries = records.where(whole).select("value").unionByName(joined)
    key = F.regexp_extract("value", JSON_ENTRY, 1)
    word = F.from_json(F.concat(F.lit('{"w":"'), key, F.lit('"}')), "w string")["w"]
    return entries.select(F.lit(lang).alias("lang"), word.alias("word"), F.regexp_extract("value", JSON_ENTRY, 2).cast("long").alias("rank"))


def read_rank_vectors(spark, path: str, lang: str) -> DataFrame:
    """A word-vector text file (header, then ``word v1 v2 ...`` by descending
    frequency) -> ``(lang, word, rank)``."""
    from ctrltok.sources.lines import read_lines

    lines = read_lines(spark, path).select(F.lit(lang).alias("lang"), "line_no", "value")
    return ranks_from_vectors(lines, keys=("lang",))
