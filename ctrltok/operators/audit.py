"""Corpus audits: bad sentence-split counts and tokenisation round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrltok.functions import subword as SW
from ctrltok.functions import text as T
from ctrltok.functions import tokens as K


def split_flags(lines: DataFrame, line: str = "line") -> DataFrame:
    """Flags for sentence splits that went wrong at abbreviations: a line that
    starts with ``B.`` or ends with ``z.`` (German "z.B." cut in two) and a line
    ending in ``ca.``; checked on the stripped line."""
    s = T.strip(line)
    return (lines.withColumn("starts_b", s.startswith("B."))
                 .withColumn("ends_z", s.endswith("z."))
                 .withColumn("ends_ca", s.endswith("ca.")))


def bad_split_counts(lines: DataFrame, expected: DataFrame, file: str = "file") -> DataFrame:
    """Per file: ``zb`` = lines starting with ``B.`` + lines ending with ``z.``
    (each counted separately) and ``ca`` = lines ending with ``ca.``; files of
    ``expected`` with no line at all appear with 0, files found but not expected
    are counted too; ``is_total`` = 1 (``file`` NULL) is the total."""
    flagged = split_flags(lines)
    per = flagged.groupBy(file).agg(
        (F.count_if("starts_b") + F.count_if("ends_z")).alias("zb"),
        F.count_if("ends_ca").alias("ca"))
    filled = expected.select(file).distinct().join(per, file, "full") \
                     .select(file, F.coalesce("zb", F.lit(0)).alias("zb"), F.coalesce("ca", F.lit(0)).alias("ca"))
    return filled.rollup(file).agg(F.grouping(file).cast("int").alias("is_total"), F.sum("zb").cast("long").alias("zb"), F.sum("ca").cast("long").alias("ca"))


def roundtrip(df: DataFrame, original: str, processed: str, has_prefix: bool, pieces: bool = False,
              tokenizer=None, segmenter: SW.Segmenter | None = None) -> DataFrame:
    """Compare an original line with its tokenised (and possibly prefixed)
    version.  ``decoded_original`` = decode(encode(original)); ``decoded`` =
    decode(processed line without its control tokens).  With ``pieces`` the
    processed line holds sub-word pieces (decoded by joining them and turning
    piece markers into spaces); with a ``segmenter`` the original is encoded and decoded by its table, so that unknown
    characters become the unknown sign, and so is the stored line unless ``pieces`` says that its pieces are joined as they
    stand; otherwise it holds space-separated word tokens.
    Both comparisons split on a single space: ``same_cleaned`` (the two
    decodings agree) and ``same_raw`` (the stripped original agrees with the
    decoding)."""
    body = K.strip_prefix(processed) if has_prefix else F.col(processed)
    orig = T.strip(original)
    if segmenter is not None:
        decode, stored = SW.decoder(segmenter), T.split_words(T.strip(body))
        dec_orig, dec = decode(SW.tokenizer(segmenter)(orig)), T.detokenize(stored) if pieces else decode(stored)
    elif pieces:
        dec_orig, dec = T.detokenize(T.to_pieces(orig)), T.detokenize(T.split_words(T.strip(body)))
    else:
        dec_orig, dec = F.array_join((tokenizer or T.tokenize)(orig), " "), T.strip(body)
    return (df.withColumn("decoded_original", dec_orig)
              .withColumn("decoded", dec)
              .withColumn("same_cleaned", T.split_words("decoded_original") == T.split_words("decoded"))
              .withColumn("same_raw", T.split_words(orig) == T.split_words("decoded")))


def roundtrip_counts(checked: DataFrame, keys=()) -> DataFrame:
    """Lines and mismatches per ``keys`` (for example file and side)."""
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"),
                                      F.count_if(~F.col("same_raw")).alias("not_matching"),
                                      F.count_if(~F.col("same_cleaned")).alias("not_matching_cleaned"))


def mismatches(checked: DataFrame, original: str, keys=("file", "side", "line_no")) -> DataFrame:
    """The report rows: keys (file and side first), flags, original and decoded text."""
    bad = checked.where(~F.col("same_raw") | ~F.col("same_cleaned"))
    return bad.select(*keys, "same_raw", "same_cleaned", T.strip(original).alias("original"), "decoded")
