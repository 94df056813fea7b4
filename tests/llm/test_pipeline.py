"""The pipeline's stages on the smallest tables, and its queries' registration."""

import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages_keep_columns_and_take_effect(spark):
    from test_llm import brute_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        old = {r.doc_id: r.text for r in docs.collect()}
        rows = stage(spark, docs, SF).collect()
        assert [*rows[0].asDict()] == columns
        docs = spark.createDataFrame(rows, docs.schema).repartition(2)
        new = {r.doc_id: r.text for r in rows}
        assert set(new) <= set(old)
        if name == "simhash":
            assert set(new) == {root for _, root in brute_simhash(list(old.items())).values()}
        if name == "line_dedup":
            assert set(new) == set(old) and new != old
    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(new) and 0 < len(last) < before
    assert {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, SF).collect()} == {r.doc_id: r.ids_sha256 for r in last}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_line_dedup_query_equals_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(entry.oracle_sql()["op2_line_dedup"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = entry.queries()["op2_line_dedup"](spark, SF).select(*names).collect()
    assert sorted(tuple(r) for r in got) == want


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, did long, tag long, row string, rest string, `a.b` string"


def odd_rows():
    """Nulls, repeated rows, one id with several texts, clashing column names."""
    t = "a text of some words that is long enough to be compared with others of its kind"
    rows = [(1, t), (1, t), (None, t), (2, "benchmark passage of thirteen words that stands here as one whole item of the test set"), (2, "another text"),
            (3, None), (4, ""), (None, None), (5, "line one is long\nline two is long"), (6, "line one is long\nline six is other")]
    return [(d, x, "en", "s", 0, 7, 7, "r", "q", f"z{i}") for i, (d, x) in enumerate(rows)]


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_on_odd_rows(spark, tmpdir_path):
    spark.createDataFrame([(1, "benchmark passage of thirteen words that stands here as one whole item of the test set"), (2, None)],
                          "item_id long, text string").write.mode("overwrite").parquet(tmpdir_path + "/own/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(tmpdir_path + "/own/labels.parquet")
    docs = spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)
    own, every = tmpdir_path + "/own", sorted(r["a.b"] for r in docs.collect())
    for name, fn in pipeline.STAGES[:-1]:
        out = fn(spark, docs, own)
        assert out.columns == docs.columns
        rows = {r["a.b"]: r for r in out.collect()}
        if name in ("toxicity", "line_dedup"):
            assert sorted(rows) == every
        if name == "line_dedup":
            assert rows["z9"].text == "line six is other" and rows["z8"].text == "line one is long\nline two is long" and rows["z5"].text is None
        if name == "simhash":
            # one of the three copies, one of the four rows without words (ids 3 and 4, null), one row each of the others
            assert len(rows) == 6 and len({"z0", "z1", "z2"} & set(rows)) == 1 and "z2" not in rows and {"z5", "z6", "z7"} & set(rows) == {"z5"}
        if name == "decontamination":
            assert set(every) - set(rows) == {"z3"}
        empty = fn(spark, docs.limit(0), own)
        assert empty.columns == docs.columns and empty.count() == 0
    last = stage("bpe")(spark, docs, own)
    assert last.count() == len(every) and stage("bpe")(spark, docs.limit(0), own).count() == 0


def test_simhash_keeps_the_same_row_whatever_the_partitioning(spark):
    rows = [(*r[:9], f"y{i}") for i, r in enumerate(odd_rows() * 3)]
    kept = [sorted(map(str, stage("simhash")(spark, spark.createDataFrame(rows, COLUMNS).repartition(n), SF).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 6
