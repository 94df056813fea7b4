"""In-row n-grams, row-local frequency, text reuse, gaps, ordered shard files, JSON scan, resumed runs, weighted match."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctrltok.functions import ngrams as NG
from ctrltok.functions import rankstat as RS
from ctrltok.operators import features as FE
from ctrltok.operators import gaps as GA
from ctrltok.operators import hypotheses as HY
from ctrltok.operators import metrics as ME
from ctrltok.operators import ranks as R
from ctrltok.operators import resume as RE
from ctrltok.operators import shards as SH
from ctrltok.sources import lines as L
from ctrltok.sources import sinks as SK


# n-grams


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens or []) - n + 1)) if tokens else Counter()


def test_gram_sums_against_counters(spark, monkeypatch):
    monkeypatch.setattr(NG, "GROUP_TOKENS", 50)
    rng = random.Random(2)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 30))], [rng.choice("abcd") for _ in range(rng.randint(0, 30))]) for i in range(60)]
    rows += [(60, None, ["a"]), (61, [], []), (62, ["a", "a b", "a"], ["a a", "b a"]), (62, ["x"] * 200, ["x"] * 100)]
    df = spark.createDataFrame(rows, "pair_id long, h array<string>, r array<string>").repartition(3)
    got = sorted(map(tuple, NG.gram_sums(df, "pair_id", ["h", "r"], ME._bleu_measures, ["m", "t", "r"], 4).collect()))
    want = []
    for i, h, r in rows:
        row = [i]
        for n in range(1, 5):
            a, b = grams(h, n), grams(r, n)
            row += [float(sum((a & b).values())), float(sum(a.values())), float(sum(b.values()))]
        want.append(tuple(row))
    assert got == sorted(want)


def test_sari_has_no_generate_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, ["a"], ["a"], ["b"])], "pair_id long, src_tokens array<string>, hyp_tokens array<string>, ref_tokens array<string>")
    plan = ME.sari(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


# frequency statistic


@pytest.fixture()
def freq_input(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "the", "der", "und", "42", "3.5", "!", "()", "--", "gamma", "unknown", "é"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    rows = [(i, rng.choice(["en", "de", "fr"]), text(), text()) for i in range(120)]
    rows += [(200 + i, "en", "beta gamma Alpha", "the") for i in range(30)] + [(300, "en", None, "beta"), (301, "xx", "beta", "gamma"), (302, None, "a", "b")]
    pairs = spark.createDataFrame(rows, "pair_id long, lang string, source string, target string").repartition(4)
    ranks = spark.createDataFrame([(lang, w, i + 1) for lang in ("en", "de", "fr") for i, w in enumerate(["beta", "Alpha", "gamma", "é", "--"])],
                                  "lang string, word string, rank long")
    return pairs, ranks


def by_id(df):
    return {r.pair_id: (r.freq_source, r.freq_target) for r in df.select("pair_id", "freq_source", "freq_target").collect()}


def test_row_local_and_reused_statistics_equal_the_joined_one(spark, freq_input):
    pairs, ranks = freq_input
    want = by_id(FE.frequency_stats(FE.by_pair(pairs), ranks))
    for got in (by_id(FE.row_frequency_stats(pairs, RS.load_ranks_dictionary(ranks))), by_id(FE.frequency_stats_by_text(pairs, ranks))):
        assert got.keys() == want.keys()
        for k, pair in want.items():
            for a, b in zip(pair, got[k], strict=True):
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12)), (k, pair, got[k])


def test_row_local_form_has_no_shuffle(freq_input):
    pairs, ranks = freq_input
    out = FE.feature_bundle(pairs, ["frequency", "length"], ranks=RS.load_ranks_dictionary(ranks))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") == 1    # the fixture's own repartition


def test_headed_statistic_equals_the_joined_one(spark, freq_input):
    """Whatever the head holds, and for rows that share a pair_id or have none, too: the very same doubles."""
    pairs, ranks = freq_input
    ranks = ranks.unionByName(spark.createDataFrame([("fr", "gap", 900), ("fr", "42a", 901)], ranks.schema))     # ranks beyond the vocabulary
    more = [(5, "en", "Alpha gamma zz", "beta"), (5, "en", "é", ""), (None, "en", "beta", "Alpha"), (400, "fr", "gap beta zz", "42a zz zz gap"),
            (401, "en", "zz", "zz beta"), (402, "en", "gamma é zz", "é gamma")]
    pairs = pairs.unionByName(spark.createDataFrame(more, pairs.schema))
    rows = lambda df: sorted(map(tuple, df.select("pair_id", "lang", "source", "target", "freq_source", "freq_target").collect()), key=repr)
    for some in (pairs, pairs.where("pair_id >= 6")):
        want = rows(FE.frequency_stats(FE.by_pair(some), ranks))
        for langs, words in ((None, 9), (None, 1 << 20), (["en"], 1), (["en"], 4), (["de", "fr", "none"], 1 << 20), ([], 0)):
            head = RS.load_rank_head(ranks, langs, most_words=words)
            assert rows(FE.headed_frequency_stats(some, FE.HeadedRanks(ranks, head))) == want, (langs, words)
    assert RS.load_rank_head(ranks, most_bytes=10).whole == set() and RS.load_rank_head(ranks).whole == {"en", "de", "fr"}


def test_head_that_decides_all_texts_needs_no_join(spark, freq_input):
    pairs, ranks = freq_input
    out = FE.feature_bundle(pairs.where("lang = 'en'"), ["frequency", "length"], ranks=FE.headed(ranks, ["en"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") == 1    # the fixture's own repartition


def test_dictionary_bound(freq_input):
    _, ranks = freq_input
    with pytest.raises(ValueError):
        RS.load_ranks_dictionary(ranks, most_words=3)
    with pytest.raises(ValueError):
        RS.load_ranks_dictionary(ranks, most_bytes=10)


def test_each_distinct_text_is_exploded_once(freq_input):
    pairs, _ = freq_input
    rows = pairs.collect()
    distinct = {(r.lang, t) for r in rows for t in (r.source, r.target) if t is not None}
    assert FE.distinct_texts(pairs).count() == len(distinct) < sum(2 for _ in rows)


def test_quantiles_equal_numpy():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 300)
    values = rng.integers(0, 5, sizes.sum()).astype(float)
    ends = np.cumsum(sizes)
    for q in (0.0, 0.25, 0.75, 1.0):
        got = RS.quantiles(values, sizes, q)
        for e, n, g in zip(ends, sizes, got, strict=True):
            assert (np.isnan(g) and n == 0) or g == pytest.approx(np.quantile(values[e - n:e], q))


# gaps


def test_gaps_against_sets(spark):
    rng = random.Random(3)
    for ids in ([], [0], [5], [0, 1, 2, 4, 4, 4, 9], rng.sample(range(20_000), 9000), [3, None, -4, 7]):
        df = spark.createDataFrame([(i,) for i in ids], "sample_id long").repartition(5)
        known = {i for i in ids if i is not None and i >= 0}
        want = [i for i in range(max(known, default=-1) + 1) if i not in known]
        assert [r.sample_id for r in HY.missing_samples(df).collect()] == want
        spans = sorted(map(tuple, GA.missing_intervals(df).collect()))
        assert [i for a, b, _ in spans for i in range(a, b + 1)] == want
        assert all(n == b - a + 1 for a, b, n in spans) and all(b + 1 < c for (_, b, _), (c, _, _) in zip(spans, spans[1:], strict=False))


def test_gap_work_follows_the_ids_not_their_size(spark):
    df = spark.createDataFrame([(0,), (10**15,), (10**15 + 2,)], "sample_id long")
    assert sorted(map(tuple, GA.missing_intervals(df).collect())) == [(1, 10**15 - 1, 10**15 - 1), (10**15 + 1, 10**15 + 1, 1)]
    near = GA.missing_intervals(df).where("first_missing > 5").unionByName(spark.createDataFrame([(2**40 - 3, 2**40 + 5000, 5004)], "first_missing long, last_missing long, n_missing long"))
    got = sorted(r.sample_id for r in GA.expand(near).collect())
    assert got == [*range(2**40 - 3, 2**40 + 5001), 10**15 + 1]


# shard files


def corpus(spark, n=230):
    rows = [("train" if i % 3 else "test", i, f"source {i}" if i % 7 else "", f"target {i}") for i in range(n)]
    return spark.createDataFrame(random.Random(1).sample(rows, n), "split string, line_no long, source string, target string").repartition(6)


def test_shard_files_keep_line_order(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "shards")
    sharded = SH.assign_shards(corpus(spark), 40, split=None)
    SK.write_shard_files(sharded, out)
    names = {n for n in os.listdir(out) if not n.startswith(("_", "."))}
    assert names == {f"{s}_{k}.{e}" for s in ("train", "test") for k in range(6) for e in ("src", "tgt")}
    back = L.read_corpus(spark, out, strip=False).collect()
    want = {}
    for r in sorted(sharded.collect(), key=lambda r: r.line_no):
        want.setdefault(r.shard_name, []).append((r.source, r.target))
    got = {}
    for r in sorted(back, key=lambda r: (r.stem, r.line_no)):
        got.setdefault(r.stem, []).append((r.source, r.target))
        assert r.line_no == len(got[r.stem]) - 1
    assert got == want


def test_a_shard_over_several_tasks_is_still_in_order(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "one")
    df = spark.range(5000).select(F.lit("train").alias("split"), F.lit(0).alias("shard"), F.col("id").alias("line_no"),
                                  F.concat(F.lit("s"), "id").alias("source"), F.concat(F.lit("t"), "id").alias("target")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SK.write_shard_files(df, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(os.path.join(out, "train_0.src")) if f.startswith("part-")]) > 1
    rows = L.read_lines(spark, os.path.join(out, "train_0.src")).collect()
    assert sorted((r.line_no, r.value) for r in rows) == [(i, f"s{i}") for i in range(5000)]


def test_merge_reads_listed_shards_only(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "merge")
    sharded = SH.assign_shards(corpus(spark), 40, split=None)
    SK.write_shard_files(sharded, out)
    merged = SH.merge_shard_files(spark, out, "train", [4, 0, 2], "src")
    lines = sorted(sharded.where("split = 'train'").collect(), key=lambda r: r.line_no)
    want = [(k, r.source) for k in (4, 0, 2) for r in lines if r.shard == k and r.source]
    assert [(r.shard, r.line) for r in sorted(merged.collect(), key=lambda r: r.merged_line_no)] == want
    assert [r.merged_line_no for r in sorted(merged.collect(), key=lambda r: r.merged_line_no)] == list(range(len(want)))
    opened = {f.split("/")[-2] for f in L.read_shards(spark, out, "train", [4, 0, 2], "src").inputFiles()}
    assert opened == {"train_4.src", "train_0.src", "train_2.src"}


def test_pair_tsv_in_length_order(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "p.tsv")
    rows = [(0, "a b c", "x"), (1, "a", "y"), (2, "b c", "z"), (3, "d", 'q"uote\\')]
    df = L.pair_tsv(spark.createDataFrame(rows, "line_no long, source string, target string"))
    SK.write_pair_tsv(df, out, order=["n_words", "line_no"])
    assert [r.value for r in L.read_lines(spark, out).orderBy("line_no").collect()] == ["a\ty", 'd\tq"uote\\', "b c\tz", "a b c\tx"]


def test_mismatch_report_is_written_by_file_and_side(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "report")
    df = spark.createDataFrame([("train", "source", 3, False, True, "a", "b")], "file string, side string, line_no int, same_raw boolean, same_cleaned boolean, original string, decoded string")
    SK.write_mismatch_report(df, out)
    assert os.path.isdir(os.path.join(out, "file=train", "side=source"))
    assert [r.decoded for r in spark.read.parquet(out).where("side = 'source'").collect()] == ["b"]


# JSON vocabulary


@pytest.mark.parametrize("form", [{}, {"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
def test_json_ranks_are_split_over_tasks(spark, tmpdir_path, form):
    rng = random.Random(7)
    words = {"".join(rng.choice('ab,:{}"\\ é\n\t') for _ in range(rng.randint(0, 9))) for _ in range(4000)}
    words |= {", ", ": 5, ", ": 6, ", ": 7,", ": 8,\n  ", ",", 'x, ', '", "', '\\', '\\"', "1,000", ": 5", "a: 3, ", "e" * 20_000, ',\n  '}
    ranks = {w: i for i, w in enumerate(sorted(words))}
    path = os.path.join(tmpdir_path, "ranks.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(ranks, f, **form)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = R.ranks_from_json(spark, path, "en").collect()
        scan = spark.read.text(path, lineSep=R.json_separator(spark, path))
        assert scan.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.word: r["rank"] for r in rows} == ranks and len(rows) == len(ranks) and {r.lang for r in rows} == {"en"}


def test_small_json_objects(spark, tmpdir_path):
    for k, obj in enumerate(({}, {"a": 1}, {"a": 1, "b": 2})):
        path = os.path.join(tmpdir_path, f"{k}.json")
        with open(path, "w") as f:
            json.dump(obj, f)
        assert {r.word: r["rank"] for r in R.ranks_from_json(spark, path, "de").collect()} == obj


# resumed runs


def test_killed_run_completes_to_the_same_table(spark, tmpdir_path):
    rows = [("en", "train" if i % 4 else "test", i, f"text {i}") for i in range(90)]
    pairs = RE.chunked(spark.createDataFrame(rows, "lang string, split string, line_no long, source string"), "length", 10)
    seen = []

    def make(part):
        seen.append(sorted(r.line_no for r in part.select("line_no").collect()))
        return part.withColumn("source_line", F.concat(F.lit("<L> "), "source"))

    whole, broken = os.path.join(tmpdir_path, "whole"), os.path.join(tmpdir_path, "broken")
    RE.resume(pairs, whole, make, ["line_no", "source_line"], waves=2)
    RE.resume(pairs, broken, make, ["line_no", "source_line"], waves=2, stop_after=1)
    part = os.path.join(broken, "lang=en", "feature_set=length", "split=train")
    left = spark.read.parquet(broken)
    assert 0 < left.count() < 90 and os.path.isdir(part)
    # a chunk that a killed writer left half done
    chunk = left.where("split = 'train'").select("chunk").first()[0]
    half = left.where((F.col("split") == "train") & (F.col("chunk") == chunk)).limit(2).select("line_no", "source_line").collect()
    spark.createDataFrame(half).coalesce(1).write.mode("overwrite").parquet(os.path.join(part, f"chunk={chunk}"))
    seen.clear()
    RE.resume(pairs, broken, make, ["line_no", "source_line"], waves=2)
    again = sorted(n for s in seen for n in s)
    assert len(again) < 90 and set(again) >= {r.line_no for r in half}
    table = lambda p: sorted(map(tuple, spark.read.parquet(p).select("split", "chunk", "line_no", "source_line").collect()))
    assert table(broken) == table(whole) and len(table(whole)) == 90
    assert RE.resume(pairs, broken, make, ["line_no", "source_line"], waves=2) == 0


# weighted match


def test_weighted_match_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(s, v, int(rng.integers(0, 3)) if s else 9, rng.normal(size=5).astype("float32").tolist()) for s in range(6) for v in range(s * 10, s * 10 + 4 + s)]
    v = spark.createDataFrame(rows, "sent int, vec_id int, token int, embedding array<float>").repartition(3)
    weights = {r.token: r.weight for r in ME.token_weights(v).collect()}
    have = {t: len({s for s, _, x, _ in rows if x == t}) for _, _, t, _ in rows}
    assert weights == pytest.approx({t: math.log(7 / (n + 1)) for t, n in have.items()})
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "cand int, ref int")
    unit = {s: np.array([np.asarray(e) / np.linalg.norm(e) for x, _, _, e in rows if x == s]) for s in range(6)}
    w = {s: np.array([weights[t] for x, _, t, _ in rows if x == s]) for s in range(6)}
    for r in ME.embedding_match(v, pairs, ME.token_weights(v)).collect():
        sims = unit[r.cand] @ unit[r.ref].T
        assert r.precision == pytest.approx((sims.max(1) * w[r.cand]).sum() / w[r.cand].sum(), abs=1e-6)
        assert r.recall == pytest.approx((sims.max(0) * w[r.ref]).sum() / w[r.ref].sum(), abs=1e-6)
    sents = v.select("sent").distinct()
    unrelated = {(r.cand, r.ref) for r in ME.unrelated_pairs(sents, [F.col("sent") * 7 % 5, F.col("sent")]).collect()}
    order = sorted(range(6), key=lambda s: (s * 7 % 5, s))
    assert unrelated == set(zip(order, order[1:] + order[:1], strict=True))
    base = spark.createDataFrame([(0.5, 0.0, 1.0)], "base_precision double, base_recall double, base_f1 double")
    one = spark.createDataFrame([(1, 2, 0.75, 0.25, 0.5)], "cand int, ref int, precision double, recall double, f1 double")
    assert tuple(ME.rescaled(one, base).first())[2:] == (0.5, 0.25, None)


# bounded memory


def test_dictionary_look_up_with_equal_hashes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    table = pa.table({"lang": ["en"] * 4 + ["de"], "word": ["a", "b", "c", "é", "a"], "rank": [1, 2, 3, 4, 9]})
    words = pa.array(["é", "x", None, "a", "c", "c", "b"])
    want = [math.log(r + 1.0) for r in (4, 4, 4, 1, 3, 3, 2)]
    for hashes in (None, lambda w: np.zeros(len(w), np.uint64), lambda w: np.array([len(x or "") and ord((x or "x")[0]) % 2 for x in w.to_pylist()], np.uint64)):
        if hashes:
            monkeypatch.setattr(RS, "_hashes", hashes)
        d = RS.RankDictionary(table)
        assert np.allclose(d.log_ranks(words, "en"), want) and np.allclose(d.log_ranks(pa.array(["a", "b"]), "de"), [math.log(10.0), math.log(2.0)])


def test_freq_row_joins_a_rank_table_beyond_the_dictionary(spark, tmpdir_path, monkeypatch):
    from ctrltok.plans import queries as Q

    text = ["Alpha beta gamma", "beta delta", "the !", "gamma Alpha beta beta", ""]
    conv = [(c, t, "user", text[(c + t) % 5]) for c in range(6) for t in range(4)]
    spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(f"{tmpdir_path}/conversations.parquet")
    docs = [(i, text[i % 5] + " beta", "en", "web") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    want = sorted(map(tuple, Q.q_freq_row(spark, tmpdir_path).collect()))
    load = RS.load_ranks_dictionary
    monkeypatch.setattr(RS, "load_ranks_dictionary", lambda ranks: load(ranks, most_words=2))
    assert sorted(map(tuple, Q.q_freq_row(spark, tmpdir_path).collect())) == want and len(want) == 18


def test_feature_match_joins_no_tokens_that_the_rank_head_decides(spark, tmpdir_path, monkeypatch):
    from ctrltok.plans import queries as Q

    text = ["Alpha beta gamma", "beta delta", "the !", "gamma Alpha beta beta", ""]
    conv = [(c, t, "user", text[(c + t) % 5]) for c in range(6) for t in range(5)]
    spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(f"{tmpdir_path}/conversations.parquet")
    docs = [(i, text[i % 5] + " beta", "en", "web") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    ran = lambda: (sorted(map(tuple, Q.q_feature_match(spark, tmpdir_path).collect()), key=repr), list(map(tuple, Q.q_feature_match_totals(spark, tmpdir_path).collect())))
    plan = Q.q_feature_match_totals(spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan
    got = ran()
    load, calls = RS.load_rank_head, []
    for words in (0, 2):
        monkeypatch.setattr(Q, "_TABLES", {})
        monkeypatch.setattr(RS, "load_rank_head", lambda ranks, langs, words=words: calls.append(words) or load(ranks, langs, most_words=words))
        assert ran() == got
    assert calls == [0, 2] and got[1][0][:3] == (18, 14, 72)


def test_edit_similarity_at_the_ends_of_words():
    from ctrltok.functions import edit as E

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return row[-1]

    rng = random.Random(3)
    sizes = [1, 2, 61, 62, 63, 64, 65, 125, 126, 127, 128, 189, 190]
    a = ["".join(rng.choice("abé😀"[:rng.randint(1, 4)]) for _ in range(n)) for n in sizes for _ in sizes]
    b = ["".join(rng.choice("abé😀"[:rng.randint(1, 4)]) for _ in range(n)) for _ in sizes for n in sizes]
    assert E.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]


def test_few_tokens_are_counted_together(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    assert NG.GROUP_TOKENS <= 1 << 16
    lists = [pa.array([[f"t{i % 997}" for i in range(NG.GROUP_TOKENS // 2)]]) for _ in range(2)]
    tracemalloc.start()
    for _ in NG._counts(lists, 4):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20
