"""Column functions on invented rows: strip, tokens, predicates, bins,
control-token rendering/parsing, edit similarity and tree depth."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctrltok.functions import bins as B
from ctrltok.functions import depth as D
from ctrltok.functions import edit as E
from ctrltok.functions import text as T
from ctrltok.functions import tokens as K


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- text

def test_strip_unicode_whitespace(spark):
    texts = ["  a b  ", " x\u3000", "\t\n y  ", "", "\u200bz", "\xa0nbsp\xa0", "\u2028line\u2029", "\x1cfs\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.strip("t")).collect()]
    # zero-width space is not whitespace for Python either
    assert got == [t.strip() for t in texts]


def test_tokenize_words_and_symbols(spark):
    df = spark.createDataFrame([("Hello, world! 3.5 don't  é🙂",), ("",)], "t string")
    got = [r[0] for r in df.select(T.tokenize("t")).collect()]
    assert got[0] == ["Hello", ",", "world", "!", "3", ".", "5", "don", "'", "t", "é", "🙂"]
    assert got[1] == []


def test_predicates(spark):
    toks = ["()", "--", "...", "(", "1", "3.68", ".5", "-2", "3s1", "1,000", "The", "the", "und", "Haus", ""]
    df = spark.createDataFrame([(t, "en") for t in toks] + [("und", "de")], "w string, lang string")
    got = {(r[0], r[1]): (r[2], r[3], r[4], r[5]) for r in df.select(
        "w", "lang", T.is_punct("w"), T.is_number("w"), T.is_stop("w", "lang"), T.admitted("w", "lang")).collect()}
    assert got[("()", "en")][0] is True          # substring of the punctuation string
    assert got[("--", "en")][0] is False         # not a substring -> admitted
    assert got[("--", "en")][3] is True
    assert got[("...", "en")][3] is True
    assert got[("", "en")][0] is True            # empty string is rejected
    for num in ["1", "3.68", ".5", "-2"]:
        assert got[(num, "en")][1] is True
    assert got[("3s1", "en")][1] is False
    assert got[("1,000", "en")][1] is False and got[("1,000", "en")][3] is True
    assert got[("the", "en")][2] is True and got[("The", "en")][2] is False  # case-sensitive
    assert got[("und", "en")][2] is False and got[("und", "de")][2] is True


def test_pieces_detokenize_roundtrip(spark):
    df = spark.createDataFrame([("Hello,  wide world!",), ("a",)], "t string")
    got = rows(df.select(T.to_pieces("t"), T.detokenize(T.to_pieces("t"))))
    assert got[0][0] == ["▁Hello", ",", "▁wide", "▁world", "!"]
    assert got[0][1] == "Hello, wide world!"
    assert got[1][1] == "a"


# ---------------------------------------------------------------- bins

def numpy_bin(x, feature):
    edges = np.arange(0.05, 2.5 if feature != "levenshtein" else 1.5, 0.05)
    idx = int(np.digitize([x], edges, right=True)[0])
    return min(idx, len(edges) - 1)


EDGE_POINTS = [0.0, -1.0, 0.05, 0.0500001, 0.1, 0.15, 0.3, 0.95, 1.0, 1.05, 2.2, 2.25, 2.45, 2.46, 3.0, 1e9,
               0.15000000000000002, 0.30000000000000004]


@pytest.mark.parametrize("feature", ["length", "levenshtein"])
def test_bins_match_numpy_digitize(spark, feature):
    df = spark.createDataFrame([(x,) for x in EDGE_POINTS], "x double")
    got = [r[0] for r in df.select(B.bin_index("x", feature)).collect()]
    assert got == [numpy_bin(x, feature) for x in EDGE_POINTS]


def test_bin_edge_facts(spark):
    df = spark.createDataFrame([(2.2,), (0.0,), (None,), (5.0,)], "x double")
    got = [r[0] for r in df.select(B.bin_label("x", "length")).collect()]
    assert got == [2.25, 0.05, None, 2.45]            # 2.2 sits above the float edge 44
    lev = [r[0] for r in df.select(B.bin_label("x", "levenshtein")).collect()]
    assert lev[3] == 1.45


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(min_value=-1, max_value=4, allow_nan=False), min_size=1, max_size=30))
def test_bins_random_and_idempotent(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = df.select("x", B.bin_index("x", "frequency").alias("k"), B.bin_value("x", "frequency").alias("v"))
    out = out.select("x", "k", "v", B.bin_index("v", "frequency").alias("k2")).collect()
    for x, k, v, k2 in out:
        assert k == numpy_bin(x, "frequency")
        assert k2 == k                                   # bin(bin(x)) == bin(x)


# ---------------------------------------------------------------- control tokens

def test_render_prefix_order_and_format(spark):
    df = spark.createDataFrame([(0.85, 1.0, 0.3000000000000001)], "f double, l double, d double")
    p = df.select(K.render_prefix({"length": F.col("l"), "frequency": F.col("f"), "dependency": F.col("d")})).first()[0]
    assert p == "<MaxDep_0.3> <FreqRank_0.85> <Length_1.0> "


def test_parse_tokens_variants(spark):
    lines = [
        "<MaxDep_0.3> <Length_1.0> the text",
        "<MaxDep_0.3><Length_1.0>glued text",
        "<unk> not a prefix",
        "no prefix at all",
        "<Length_0.5> <Length_0.75> duplicate",
        "<A_1>  <B_2.5>   spaced",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = rows(df.select(K.parse_tokens("x"), K.strip_prefix("x")))
    assert got[0] == ({"MaxDep": 0.3, "Length": 1.0}, "the text")
    assert got[1] == ({"MaxDep": 0.3, "Length": 1.0}, "glued text")
    assert got[2] == (None, "<unk> not a prefix")
    assert got[3] == (None, "no prefix at all")
    assert got[4][0] == {"Length": 0.75}                 # last duplicate wins
    assert got[5] == ({"A": 1.0, "B": 2.5}, "spaced")


def test_parse_render_roundtrip(spark):
    df = spark.createDataFrame([(0.05, 2.45, 0.95)], "a double, b double, c double")
    m = df.select(K.parse_tokens(K.render_prefix({"dependency": F.col("a"), "length": F.col("b"),
                                                   "levenshtein": F.col("c")}))).first()[0]
    assert m == {"MaxDep": 0.05, "Length": 2.45, "Leven": 0.95}


def test_feature_set_key():
    assert K.feature_set_key(["length", "dependency"]) == "dependency_length"
    with pytest.raises(ValueError):
        K.feature_set_key(["speed"])


# ---------------------------------------------------------------- edit similarity

def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé🙂 ", max_size=40), st.text(alphabet="abcé🙂 ", max_size=40))
def test_lcs_matches_dp(a, b):
    assert E.lcs_length(a, b) == dp_lcs(a, b)


def test_similarity_edges():
    assert E.similarity("", "") == 1.0
    assert E.similarity("abc", "") == 0.0
    assert E.similarity("abc", "abc") == 1.0
    assert E.similarity("ab", "ba") == E.similarity("ba", "ab") == 0.5
    assert E.similarity(None, "x") is None


def test_edit_ratio_udf_long_texts(spark):
    rnd = random.Random(7)
    pairs = [("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 900))),
              "".join(rnd.choice("abce ") for _ in range(rnd.randint(0, 900)))) for _ in range(20)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(E.edit_ratio("a", "b")).collect()]
    for (a, b), g in zip(pairs, got):
        want = 1.0 if not a and not b else 2 * dp_lcs(a, b) / (len(a) + len(b))
        assert math.isclose(g, want, rel_tol=0, abs_tol=1e-12)


# ---------------------------------------------------------------- depth

def brute_depth(heads):
    best = 0
    for i in range(len(heads)):
        d, j = 0, i
        while heads[j] >= 0:
            j, d = heads[j], d + 1
        best = max(best, d)
    return best


def test_max_depths_cases():
    cases = [[], [-1], [-1, 0, 1, 2], [-1, 0, 0, 0], [-1, 0, -1, 2, 3], [2, 2, -1]]
    assert list(D.max_depths(cases)) == [brute_depth(h) for h in cases]
    with pytest.raises(ValueError):
        D.max_depths([[1, 0]])                         # cycle, no root


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=60), min_size=1, max_size=20), st.randoms())
def test_max_depths_random_forests(lengths, rnd):
    cases = [[-1] + [rnd.randint(-1, i - 1) for i in range(1, n)] for n in lengths]
    assert list(D.max_depths(cases)) == [brute_depth(h) for h in cases]


def test_synthetic_heads_and_udf(spark):
    from ctrltok.plans.testparse import synthetic_heads

    df = spark.createDataFrame([("a bb ccc dddd e",), ("one",), ("",)], "t string")
    got = rows(df.select(synthetic_heads(T.tokenize("t")).alias("h")).select("h", D.max_depth("h")))
    h0 = got[0][0]
    assert h0[0] == -1 and all(0 <= h < i for i, h in enumerate(h0) if i > 0)
    assert got[0][1] == brute_depth(h0)
    assert got[1] == ([-1], 0) and got[2] == ([], 0)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_similarity_symmetric_and_bounded(a, b):
    s = E.similarity(a, b)
    assert s == E.similarity(b, a)
    assert 0.0 <= s <= 1.0
    assert (s == 1.0) == (a == b)
