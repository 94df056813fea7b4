"""The driver contract: every registered query against its DuckDB oracle on
the smallest given tables (same comparison as the driver: row count, column
names, order-insensitive values), the flagship entry, and brute-force checks
for the queries that have no SQL oracle."""

import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from ctrltok.plans.queries import QUERIES  # noqa: E402
from oracle_check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ["documents", "conversations", "embeddings", "part", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["pair_id", "split"]
    assert df.count() > 0


def test_edit_ratio_against_dp_on_whole_texts(spark, duck):
    from test_functions import dp_lcs

    from ctrltok.sources.tables import conversation_pairs

    got = {r["pair_id"]: r["edit_ratio"] for r in E.queries()["edit_ratio"](spark, SF).collect()}
    texts = {r["pair_id"]: (r["source"], r["target"]) for r in conversation_pairs(spark, SF).collect()}
    assert set(got) == set(texts) and len(texts) == E.queries()["length_ratio"](spark, SF).count()
    for k, (a, b) in texts.items():
        want = 1.0 if not a and not b else 2 * dp_lcs(a, b) / (len(a) + len(b))
        assert math.isclose(got[k], round(want, 6), abs_tol=1e-9), k


def test_control_corpus_against_edit_similarity(spark):
    """The corpus's edit similarity is the brute-force-checked one, rendered last in the prefix."""
    from ctrltok.functions.bins import edge_values

    corpus = {r["pair_id"]: r for r in E.queries()["control_corpus"](spark, SF).collect()}
    lev = {r["pair_id"]: r["edit_ratio"] for r in E.queries()["edit_ratio"](spark, SF).collect()}
    edges = edge_values("levenshtein")
    assert set(corpus) == set(lev)
    for k, r in corpus.items():
        v = next((e for e in edges if e >= r["exact_levenshtein"]), edges[-1])
        assert r["exact_levenshtein"] == lev[k]
        assert r["prefix"].endswith(f"<Leven_{round(v, 2)}> ")
