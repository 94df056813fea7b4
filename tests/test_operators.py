"""Operators on invented pairs and line files, including the edge rows listed
in the fixture notes (empty sides, equal strings, no admitted tokens, glued and
spaced prefixes, unequal file lengths, empty lines, non-BMP characters)."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctrltok.functions import edit as E
from ctrltok.operators import audit as AU
from ctrltok.operators import corpus as C
from ctrltok.operators import experiments as EX
from ctrltok.operators import features as FE
from ctrltok.operators import hypotheses as HY
from ctrltok.operators import match as MA
from ctrltok.operators import metrics as ME
from ctrltok.operators import numbering as NU
from ctrltok.operators import profile as PR
from ctrltok.operators import ranks as R
from ctrltok.operators import shards as SH
from ctrltok.sources import lines as L
from ctrltok.sources import sinks as SK
from ctrltok.plans.testparse import parse_text

PAIRS = [
    (1, "en", "The cat sat on the mat.", "A cat sat."),
    (2, "en", "", "nonempty"),
    (3, "en", "same words here", "same words here"),
    (4, "en", "the of and", "the a"),                       # only stop words
    (5, "en", "zebra quokka 🙂 ünïcode", "quokka"),            # unknown words, non-BMP
    (6, "de", "Der Hund und die Katze", "Der Hund"),
]
RANKS = [("en", "cat", 1), ("en", "mat", 2), ("en", "sat", 3), ("en", "A", 4), ("en", "quokka", 5),
         ("de", "Hund", 1), ("de", "Katze", 2)]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id long, lang string, source string, target string") \
                .withColumn("split", F.lit("train"))


@pytest.fixture()
def ranks(spark):
    return spark.createDataFrame(RANKS, "lang string, word string, rank long")


def by_id(df, *cols):
    return {r["pair_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def py_quantile(xs, q):
    return float(np.quantile(xs, q))


def test_length_and_edit(pairs):
    got = by_id(pairs.select("pair_id", FE.length_ratio().alias("l"), FE.edit_ratio().alias("e")), "l", "e")
    assert got[2][0] is None                          # empty source -> NULL, not an error
    assert got[3] == (1.0, 1.0)                        # equal strings
    assert math.isclose(got[1][0], len("A cat sat.") / len("The cat sat on the mat."))
    assert math.isclose(got[1][1], E.similarity("The cat sat on the mat.", "A cat sat."))


def test_frequency_statistic(pairs, ranks):
    st = by_id(FE.frequency_stats(FE.by_pair(pairs), ranks), "freq_source", "freq_target")
    v_en, v_de = 5, 2
    oov_en = math.log(v_en + 1)
    # pair 4: nothing admitted on either side -> OOV value on both sides
    assert st[4] == pytest.approx((oov_en, oov_en))
    # pair 1 target "A cat sat ." -> admitted A, cat, sat (punct dropped)
    assert st[1][1] == pytest.approx(py_quantile([math.log(5), math.log(2), math.log(4)], 0.75))
    # pair 5 source: zebra (OOV), quokka (5), the emoji symbol and ünïcode (OOV)
    src5 = [math.log(v_en + 1), math.log(6), math.log(v_en + 1), math.log(v_en + 1)]
    assert st[5][0] == pytest.approx(py_quantile(src5, 0.75))
    # German stop words for lang=de: "Der", "und", "die" are case-sensitive ("Der" is kept)
    de_src = [math.log(v_de + 1), math.log(2), math.log(3)]       # Der (OOV), Hund, Katze
    assert st[6][0] == pytest.approx(py_quantile(de_src, 0.75))


def test_depth_ratio_floor(spark):
    df = spark.createDataFrame([(1, "en", "one", "two words"), (2, "en", "a b", "c")],
                               "pair_id long, lang string, source string, target string")
    got = by_id(FE.with_depth(df, parse_text), "exact_dependency")
    # "one" has depth 0 -> 0.5;  "two words" -> token 1 hangs under 1-1-(5%1)=0 -> depth 1
    assert got[1][0] == pytest.approx(1 / 0.5)
    got_abs = by_id(FE.with_depth(df, parse_text, absolute=True), "exact_dependency")
    assert got_abs[2][0] == 0.0                       # absolute mode has no floor


def test_bundle_only_requested(pairs, ranks):
    b = FE.feature_bundle(pairs, ["length"])
    assert "exact_length" in b.columns and "exact_frequency" not in b.columns
    with pytest.raises(ValueError):
        FE.feature_bundle(pairs, ["frequency"])       # needs ranks
    with pytest.raises(ValueError):
        FE.feature_bundle(pairs, ["dependency"])      # needs a parse


def test_control_corpus_and_parse(pairs, ranks):
    cc = C.control_corpus(pairs, ["length", "dependency", "frequency", "levenshtein"], ranks=ranks, parse=parse_text)
    r = {x["pair_id"]: x for x in cc.collect()}
    assert r[3]["prefix"].startswith("<MaxDep_") and "<Leven_1.0>" in r[3]["prefix"]
    names = [p.split("_")[0][1:] for p in r[1]["prefix"].split()]
    assert names == ["MaxDep", "FreqRank", "Length", "Leven"]
    assert r[1]["source_line"].endswith("The cat sat on the mat .")
    assert r[2]["prefix"].count("<") == 3              # NULL length ratio renders no token
    parsed = C.parsed_corpus(cc).select("pair_id", "controls", "sentence").collect()
    for row in parsed:
        assert row["sentence"] == r[row["pair_id"]]["source_line"][len(r[row["pair_id"]]["prefix"]):]


def test_ablation_full_set_is_identity(pairs, ranks):
    cc = C.control_corpus(pairs, ["length", "dependency"], ranks=ranks, parse=parse_text)
    full = C.ablation_corpus(cc, [["dependency", "length"]]).select("pair_id", "source_line", "ablated_line").collect()
    for row in full:
        assert row["ablated_line"] == row["source_line"]
    with pytest.raises(Exception, match="lacks a requested control token"):
        C.ablation_corpus(cc).collect()               # the corpus has no frequency token


def test_feature_combinations(spark):
    df = C.feature_combinations(spark)
    assert df.count() == 14
    assert sorted(r[0] for r in df.select("feature_set").collect()) == sorted(
        "_".join(c) for c in C.combination_list())
    assert C.feature_combinations(spark, proper=False).count() == 15


def test_inference_prefix(spark):
    df = spark.createDataFrame([(0, "Hello world!")], "line_no long, line string")
    out = C.inference_corpus(df, {"length": 0.78, "levenshtein": 0.22}, col="line").first()
    assert out["model_input"] == "<Length_0.8> <Leven_0.25> Hello world !"


def test_global_index_matches_python(spark):
    data = [(g, v, i) for i, (g, v) in enumerate((g, (i * 7919) % 101) for g in ("a", "b", "c") for i in range(300))]
    df = spark.createDataFrame(data, "g string, v long, id long").repartition(7)
    out = NU.global_index(df, [F.col("v").desc(), "id"], group_by=["g"], out="n")
    got = {(r["g"], r["id"]): r["n"] for r in out.collect()}
    for g in ("a", "b", "c"):
        ids = sorted([(v, i) for gg, v, i in data if gg == g], key=lambda t: (-t[0], t[1]))
        for n, (_, i) in enumerate(ids):
            assert got[(g, i)] == n


def test_ranks_from_corpus_and_vectors(spark):
    texts = spark.createDataFrame([("en", "b a a c b a"), ("de", "x y y")], "lang string, text string")
    r = {(x["lang"], x["word"]): (x["cnt"], x["rank"]) for x in R.ranks_from_corpus(texts).collect()}
    assert r[("en", "a")] == (3, 1) and r[("en", "b")] == (2, 2) and r[("en", "c")] == (1, 3)
    assert r[("de", "y")] == (2, 1)
    vec = spark.createDataFrame([(0, "3 300"), (1, "the 0.1 0.2"), (2, "cat 0.3"), (3, "the 0.5"), (4, "")],
                                "line_no long, value string")
    rv = {x["word"]: x["rank"] for x in R.ranks_from_vectors(vec).collect()}
    assert rv == {"the": 3, "cat": 2}                  # header skipped, last duplicate wins
    s = R.rank_summary(R.ranks_from_corpus(texts)).where("lang = 'en'").first()
    assert (s["vocab_size"], s["most_frequent"], s["least_frequent"]) == (3, "a", "c")


def test_read_lines_multiblock(spark, tmpdir_path):
    paths = []
    for k, n in enumerate([5000, 3, 0]):
        p = os.path.join(tmpdir_path, f"f{k}.txt")
        with open(p, "w", encoding="utf-8") as fh:
            for i in range(n):
                fh.write(f"line {i} of file {k} " + "x" * (i % 13) + "\n")
        paths.append(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")       # many splits per file
    try:
        out = L.read_lines(spark, tmpdir_path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for r in out:
        i = int(r["value"].split()[1])
        assert r["line_no"] == i
    assert len(out) == 5003
    head = L.read_lines(spark, paths[0], n_lines=10).count()
    assert head == 10


def test_pair_lines_lenient_strict(spark):
    src = spark.createDataFrame([(0, 0, " a "), (0, 1, "b"), (0, 2, "c")], "unit long, line_no long, line string")
    tgt = spark.createDataFrame([(0, 0, "A"), (0, 1, "B ")], "unit long, line_no long, line string")
    full = L.pair_lines(src, tgt).orderBy("line_no").collect()
    assert [(r["source"], r["target"]) for r in full] == [("a", "A"), ("b", "B"), ("c", None)]
    assert L.pair_lines(src, tgt, how="inner").count() == 2
    with pytest.raises(Exception):
        L.pair_lines(src, tgt, strict=True).collect()
    tsv = [r["tsv"] for r in L.pair_tsv(L.pair_lines(src, tgt, how="inner")).collect()]
    assert tsv == ["a\tA", "b\tB"]


def test_shards_roundtrip(spark):
    lines = spark.createDataFrame([(i, "" if i % 5 == 3 else f"l{i}") for i in range(23)], "line_no long, line string")
    sh = SH.assign_shards(lines, 4, skip=2)
    got = {r["line_no"]: (r["shard"], r["shard_name"]) for r in sh.collect()}
    assert 0 not in got and got[2] == (1, "train_1") and got[6] == (2, "train_2")
    assert SH.assign_shards(lines, 4).where("line_no = 0").first()["shard"] == 0
    order = sh.select("shard").distinct().withColumn("pos", F.col("shard"))
    merged = SH.merge_shards(sh, order).orderBy("merged_line_no").collect()
    expect = [f"l{i}" for i in range(2, 23) if i % 5 != 3]
    assert [r["line"] for r in merged] == expect       # merge(shard(x)) = x without empty lines
    assert [r["merged_line_no"] for r in merged] == list(range(len(expect)))


def test_profiles(spark):
    lines = spark.createDataFrame([("train", "<Length_0.5> <Leven_1.0> a"), ("train", "<Length_0.5> b"),
                                   ("test", "<Length_0.75>c"), ("test", "none")], "split string, source_line string")
    vc = {(r["name"], r["value"], None if r["pooled"] else r["split"]): r["cnt"] for r in PR.value_counts(PR.control_values(lines)).collect()}
    assert vc[("Length", 0.5, "train")] == 2 and vc[("Length", 0.5, None)] == 2 and vc[("Length", 0.75, None)] == 1
    vals = spark.createDataFrame([("length", float(x)) for x in [0.0, 1.0, 2.0, 3.0, 4.0]], "feature string, x double")
    h = {r["bin"]: r["cnt"] for r in PR.hist_equal_width(vals, {"length": 4}).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 2}               # last bin right-closed
    s = PR.feature_summary(vals).first()
    assert (s["min"], s["max"], s["mean"]) == (0.0, 4.0, 2.0) and s["std"] == pytest.approx(np.std([0, 1, 2, 3, 4]))
    fx = spark.createDataFrame([("length", 0.05, "a"), ("length", 2.1, "a"), ("length", 0.3, "b")],
                               "feature string, value double, split string")
    hf = {(r["bin"], r["split"]): r["cnt"] for r in PR.hist_fixed(fx).collect()}
    assert hf[(0, None)] == 1 and (40, None) not in hf   # 2.1 is outside the 40 bins


def test_bad_splits(spark):
    lines = spark.createDataFrame([("a", "B. rest"), ("a", "z."), ("a", "ca. "), ("b", "ok"), ("d", "etwa ca.")],
                                  "file string, line string")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    got = {None if r["is_total"] else r["file"]: (r["zb"], r["ca"]) for r in AU.bad_split_counts(lines, expected).collect()}
    assert got == {"a": (2, 1), "b": (0, 0), "c": (0, 0), "d": (0, 1), None: (2, 2)}


def test_roundtrip(spark):
    df = spark.createDataFrame([(1, "Hello, world", "<Length_1.0> Hello , world"), (2, "plain words", "plain words")],
                               "id long, orig string, proc string")
    got = {r["id"]: (r["same_raw"], r["same_cleaned"]) for r in AU.roundtrip(df, "orig", "proc", True).collect()}
    assert got == {1: (False, True), 2: (True, True)}
    counts = AU.roundtrip_counts(AU.roundtrip(df, "orig", "proc", True)).first()
    assert (counts["n_lines"], counts["not_matching"], counts["not_matching_cleaned"]) == (2, 1, 0)


def test_hypotheses(spark):
    log = spark.createDataFrame([(0, "S-0\tsrc"), (1, "H-0\t-0.5\tfirst"), (2, "H-0\t-0.9\tsecond"),
                                 (3, "H-2\t-1.25\ttab\tinside"), (4, "garbage")], "log_no long, value string")
    h = HY.parse_hypotheses(log)
    best = {r["sample_id"]: r["text"] for r in HY.best_hypotheses(h).collect()}
    assert best == {0: "first", 2: "tab\tinside"}
    grouped = {r["sample_id"]: r["texts"] for r in HY.group_hypotheses(h).collect()}
    assert grouped[0] == ["first", "second"]
    assert [r["sample_id"] for r in HY.missing_samples(h).collect()] == [1]


def test_feature_match_counts(spark, ranks):
    rows = spark.createDataFrame([
        (1, "en", "<Length_1.0> a b c", "a b c"),          # realised length 1.0 -> match
        (2, "en", "<Length_0.5> a b c", "a b c"),          # mismatch, delta -0.5
        (3, "en", "no prefix", "whatever"),                # counts only as a pair
        (4, "en", "<Length_0.5> ", "text"),                # no realised value: a mismatch without a delta
    ], "pair_id long, lang string, source_line string, output string")
    cmp = MA.realised_vs_requested(rows, ["length"], ranks=ranks)
    s = {r["name"]: (r["n_match"], r["n_mismatch"], r["avg_delta"]) for r in MA.match_summary(cmp).collect()}
    assert s["Length"] == (1, 2, pytest.approx(-0.5)) and s[None][:2] == (1, 2)
    t = MA.match_totals(rows, cmp, 1).first()
    assert (t["n_pairs"], t["n_prefixed"], t["n_matches"], t["n_features_total"]) == (4, 3, 1, 4)


# ---------------------------------------------------------------- metrics vs brute force

def grams(toks, n):
    return Counter(" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1))


def py_bleu(hyps, refs):
    m, t = [0] * 4, [0] * 4
    for h, r in zip(hyps, refs):
        for n in range(1, 5):
            gh, gr = grams(h, n), grams(r, n)
            m[n - 1] += sum(min(c, gr[g]) for g, c in gh.items())
            t[n - 1] += sum(gh.values())
    hl, rl = t[0], sum(len(r) for r in refs)
    if min(m) == 0:
        return 0.0
    bp = 1.0 if hl >= rl else math.exp(1 - rl / hl)
    return 100 * bp * math.exp(sum(math.log(m[i] / t[i]) for i in range(4)) / 4)


def py_sari(s, c, r):
    tot = 0.0
    for n in range(1, 5):
        S, Cc, Rr = grams(s, n), grams(c, n), grams(r, n)
        keys = set(S) | set(Cc) | set(Rr)
        kp = [min(S[g], Cc[g], Rr[g]) / min(S[g], Cc[g]) for g in keys if min(S[g], Cc[g]) > 0]
        kr = [min(S[g], Cc[g], Rr[g]) / min(S[g], Rr[g]) for g in keys if min(S[g], Rr[g]) > 0]
        dp = [max(S[g] - Cc[g] - Rr[g], 0) / (S[g] - Cc[g]) for g in keys if S[g] - Cc[g] > 0]
        a = {g for g in Cc if S[g] == 0}
        ag = {g for g in a if Rr[g] > 0}
        aall = {g for g in Rr if S[g] == 0}
        p = sum(kp) / len(kp) if kp else 0.0
        rr = sum(kr) / len(kr) if kr else 0.0
        keep = 2 * p * rr / (p + rr) if p + rr > 0 else 0.0
        dl = sum(dp) / len(dp) if dp else 0.0
        ap = len(ag) / len(a) if a else 0.0
        ar = len(ag) / len(aall) if aall else 0.0
        add = 2 * ap * ar / (ap + ar) if ap + ar > 0 else 0.0
        tot += (keep + dl + add) / 3
    return 100 * tot / 4


METRIC_ROWS = [
    (1, "the cat sat on the mat today", "the cat sat on a mat", "a cat sat on the mat"),
    (2, "one two three four five", "one two four five", "one two three four"),
    (3, "short", "short", "different words entirely here now"),
    (4, "", "", ""),
]


def test_bleu_and_sari_match_brute_force(spark):
    df = spark.createDataFrame(METRIC_ROWS, "pair_id long, s string, c string, r string")
    df = df.select("pair_id", ME.metric_tokens("s").alias("src_tokens"), ME.metric_tokens("c").alias("hyp_tokens"),
                   ME.metric_tokens("r").alias("ref_tokens"))
    toks = {r["pair_id"]: (r["src_tokens"], r["hyp_tokens"], r["ref_tokens"]) for r in df.collect()}
    b = ME.bleu(df).first()
    assert b["bleu"] == pytest.approx(py_bleu([t[1] for t in toks.values()], [t[2] for t in toks.values()]))
    per = {r["pair_id"]: r["sari"] for r in ME.sari(df).collect()}
    for k, (s, c, r) in toks.items():
        assert per[k] == pytest.approx(py_sari(s, c, r)), k
    cs = ME.mean_sari(ME.sari(df)).first()
    assert cs["sari"] == pytest.approx(np.mean([py_sari(*t) for t in toks.values()]))


def test_fkgl(spark):
    df = spark.createDataFrame([("The cat sat. It was happy!",), ("rhythm",), ("",)], "text string")
    f = ME.fkgl(df).first()
    # sentences 2 + 1 + 0, words 6 + 1, syllables: the cat sat it was hap-py = 7, rhythm (y) = 1
    assert (f["n_sentences"], f["n_words"], f["n_syllables"]) == (3, 7, 8)
    assert f["fkgl"] == pytest.approx(0.39 * 7 / 3 + 11.8 * 8 / 7 - 15.59)


def test_embedding_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [(int(lab), int(i), [float(x) for x in rng.normal(size=5)]) for i, lab in enumerate(rng.integers(0, 3, 70))]
    vecs.append((2, 999, [0.0] * 5))                       # zero vector -> cosine 0
    v = spark.createDataFrame(vecs, "sent long, vec_id long, embedding array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "cand long, ref long")
    got = {(r["cand"], r["ref"]): (r["precision"], r["recall"], r["f1"])
           for r in ME.embedding_match(v, pairs).collect()}

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(n > 0, m / np.where(n > 0, n, 1), 0)
    for (c, r) in [(0, 1), (1, 2)]:
        A = unit(np.array([e for s, _, e in vecs if s == c]))
        Bm = unit(np.array([e for s, _, e in vecs if s == r]))
        sims = A @ Bm.T
        p, rc = sims.max(axis=1).mean(), sims.max(axis=0).mean()
        assert got[(c, r)][:2] == pytest.approx((p, rc))
        assert got[(c, r)][2] == pytest.approx(2 * p * rc / (p + rc))


def test_experiments(spark, tmpdir_path):
    lines = spark.createDataFrame([
        ("x/experiments/5/checkpoints/evaluation.txt", "{'bleu': 9.5, 'sari': 37.35, 'fkgl': 5.7, 'bertscore_precision': 0.2, 'bertscore_recall': 0.1, 'bertscore_f1': 0.15}"),
        ("x/experiments/3/checkpoints/evaluation.txt", "{'bleu': 0.0, 'sari': 26.3, 'bertscore_precision': -1.0, 'bertscore_recall': -0.3, 'bertscore_f1': -0.7}"),
    ], "file_path string, value string")
    m = {r["exp_id"]: r for r in EX.parse_metric_lines(lines).collect()}
    assert m["5"]["fkgl"] == 5.7 and m["3"]["fkgl"] is None
    cfg = spark.createDataFrame([
        ("tuning_5.yaml", "en", ["dependency", "frequency", "length", "levenshtein"], 16, 2, 16, 40, 8, 1.1e-4),
        ("tuning_3.yaml", "de", ["levenshtein", "length"], 16, None, 16, 10, 4, 1e-4),
        ("tuning_7.yaml", "de", ["length"], 8, None, 8, 10, 4, 1e-4),
    ], "config_name string, language string, features_requested array<string>, batch_size long, update_freq long, "
       "test_batch_size long, max_epochs long, beam_size long, lr double")
    allow = spark.createDataFrame([("5",), ("3",)], "exp_id string")
    ov = {r["id"]: r for r in EX.overview(cfg, EX.parse_metric_lines(lines), allow).collect()}
    assert set(ov) == {"5", "3"}
    assert ov["5"]["features"] == "all" and ov["5"]["effective_batch_size"] == 32
    assert ov["3"]["features"] == "len_leven" and ov["3"]["effective_batch_size"] == 16
    out = os.path.join(tmpdir_path, "overview")
    EX.write_overview(EX.overview(cfg, EX.parse_metric_lines(lines), allow), out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert text.splitlines()[0].startswith("ID;Language;Features")


def test_sinks_keep_line_order(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(200)], "line_no long, model_input string").repartition(5)
    out = os.path.join(tmpdir_path, "inf")
    SK.write_inference_corpus(df, out)
    got = []
    for f in sorted(os.listdir(out)):
        if f.startswith("part-"):
            got += open(os.path.join(out, f), encoding="utf-8").read().splitlines()
    assert got == [f"line {i}" for i in range(200)]


def test_repartition_invariance(pairs, ranks):
    a = C.control_corpus(pairs.coalesce(1), ["length", "frequency", "dependency"], ranks=ranks, parse=parse_text)
    b = C.control_corpus(pairs.repartition(8), ["length", "frequency", "dependency"], ranks=ranks, parse=parse_text)
    cols = ["pair_id", "prefix", "source_line", "target_line"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_rank_save_load_json(spark, tmpdir_path):
    ranks = spark.createDataFrame([("en", "a", 1), ("de", "b", 1)], "lang string, word string, rank long")
    p = os.path.join(tmpdir_path, "ranks")
    R.save_ranks(ranks, p)
    assert [r["word"] for r in R.load_ranks(spark, p, "de").collect()] == ["b"]
    jp = os.path.join(tmpdir_path, "ranks.json")
    with open(jp, "w") as fh:
        fh.write('{"the": 1, "cat": 2}')
    assert {r["word"]: r["rank"] for r in R.ranks_from_json(spark, jp, "en").collect()} == {"the": 1, "cat": 2}


def test_depth_from_heads_table(spark):
    from ctrltok.operators import tree

    rows = [(1, 0, 0, 0, -1), (1, 0, 0, 1, 0), (1, 0, 0, 2, 1),       # source sentence 0: depth 2
            (1, 0, 1, 0, -1), (1, 0, 1, 1, 0),                          # source sentence 1: depth 1
            (1, 1, 0, 0, -1)]                                           # target: single node
    h = spark.createDataFrame(rows, "pair_id long, side int, sent_no int, token_no int, head_no int")
    r = tree.depth_ratio_from_heads(h).first()
    assert (r["depth_source"], r["depth_target"]) == (2, 0)
    assert r["depth_ratio"] == pytest.approx(0.5 / 2)


def test_read_pairs_and_vector_file(spark, tmpdir_path):
    src, tgt, vec = (os.path.join(tmpdir_path, n) for n in ("a.src", "a.tgt", "cc.vec"))
    open(src, "w").write(" one\ntwo \nthree\n")
    open(tgt, "w").write("uno\ndos\n")
    with pytest.raises(Exception):
        L.read_pairs(spark, src, tgt).collect()                   # strict: unequal lengths
    got = sorted(tuple(r) for r in L.read_pairs(spark, src, tgt, strict=False).collect())
    assert got == [(0, "one", "uno"), (1, "two", "dos"), (2, "three", None)]
    open(vec, "w").write("3 2\nthe 0.1 0.2\ncat 0.3 0.4\n")
    assert {r["word"]: r["rank"] for r in R.read_rank_vectors(spark, vec, "en").collect()} == {"the": 1, "cat": 2}


def test_merge_copy_and_vocabulary_specials(spark):
    lines = spark.createDataFrame([(0, "a"), (1, ""), (2, "b")], "line_no long, line string")
    assert [r["merged_line_no"] for r in SH.merge_shards(lines, None).orderBy("line_no").collect()] == [0, 1, 2]
    pairs = spark.createDataFrame([(1, "x y y", "z")], "pair_id long, source string, target string")
    v = {(r["side"], r["token"]): (r["cnt"], r["freq_rank"]) for r in R.vocabulary(pairs, R.SPECIAL_SYMBOLS).collect()}
    assert v[("src", "<s>")] == (None, 1) and v[("tgt", "<unk>")] == (None, 4)
    assert v[("src", "y")] == (2, 5) and v[("src", "x")] == (1, 6) and v[("tgt", "z")] == (1, 5)


def test_ship_package(spark):
    from ctrltok.session import ship_package

    path = ship_package(spark)
    import zipfile
    assert "ctrltok/functions/edit.py" in zipfile.ZipFile(path).namelist()
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    assert df.select(E.edit_ratio("a", "b")).first()[0] == pytest.approx(2 * 2 / 6)


def test_bundle_without_lang_column(spark, ranks):
    df = spark.createDataFrame([(1, "the cat", "a cat")], "pair_id long, source string, target string")
    out = FE.feature_bundle(df, ["frequency", "length"], ranks=ranks).first()
    assert out["exact_length"] == pytest.approx(5 / 7) and out["exact_frequency"] > 0


def test_long_conversations_do_not_collide(spark, tmpdir_path):
    from ctrltok.sources.tables import conversation_pairs

    rows = [(1, t, "u", f"one word{t}") for t in range(1003)] + [(2, t, "u", f"two three other{t}") for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        os.path.join(tmpdir_path, "conversations.parquet"))
    pairs = conversation_pairs(spark, tmpdir_path)
    ranks = spark.createDataFrame([("en", "one", 1), ("en", "two", 50), ("en", "three", 7)], "lang string, word string, rank long")
    got = {(r["conv_id"], r["turn"]): r["exact_frequency"] for r in FE.feature_bundle(pairs, ["frequency"], ranks=ranks).collect()}
    assert len(got) == 1002 + 2 == pairs.select("pair_id").distinct().count()
    alone = {(r["conv_id"], r["turn"]): r["exact_frequency"] for r in FE.feature_bundle(
        pairs.where("conv_id = 2"), ["frequency"], ranks=ranks).collect()}
    assert {k: got[k] for k in alone} == pytest.approx(alone)


def test_hot_word_without_broadcasts(spark, ranks):
    rows = [(i, "en", "cat " * 50 + f"mat w{i}", "cat cat mat") for i in range(300)]
    pairs = spark.createDataFrame(rows, "pair_id long, lang string, source string, target string")
    want = {r["pair_id"]: r["exact_frequency"] for r in FE.feature_bundle(pairs, ["frequency"], ranks=ranks).collect()}
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        df = FE.feature_bundle(pairs, ["frequency"], ranks=ranks)
        got = {r["pair_id"]: r["exact_frequency"] for r in df.collect()}
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == pytest.approx(want)


def test_parse_from_columns_and_table(spark):
    from ctrltok.plans.testparse import heads_table

    df = spark.createDataFrame([(1, "en", "a bb ccc dddd", "one two three"), (2, "en", "x", "")],
                               "pair_id long, lang string, source string, target string")
    cols = df.withColumns({f"h_{s}": parse_text(F.col(s)) for s in ("source", "target")})
    want = by_id(FE.feature_bundle(df, ["dependency"], parse=parse_text), "exact_dependency")
    assert by_id(FE.feature_bundle(cols, ["dependency"], parse="h"), "exact_dependency") == want
    assert by_id(FE.feature_bundle(df, ["dependency"], parse=heads_table(df)), "exact_dependency") == want


def test_shard_corpora_pair_by_file(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "sharded")
    os.makedirs(d)
    for stem in ("train_0", "train_1"):
        for end in ("src", "tgt"):
            open(os.path.join(d, f"{stem}.{end}"), "w").write(f"{stem} a\n{stem} b\n")
    got = L.read_corpus(spark, d).collect()
    assert len(got) == 4 and all(r["source"] == r["target"] and r["split"] == "train" for r in got)


def test_read_corpus_folder_with_val_alias(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "corpus")
    os.makedirs(d)
    for split, n in (("train", 3), ("val", 1), ("test", 2)):
        open(os.path.join(d, f"{split}.src"), "w").write("".join(f"s{split}{i}\n" for i in range(n)))
        open(os.path.join(d, f"{split}.tgt"), "w").write("".join(f"t{split}{i}\n" for i in range(n)))
    got = sorted(tuple(r) for r in L.read_corpus(spark, d).collect())
    assert ("en", "valid", "val", 0, "sval0", "tval0") in got
    assert sorted({r[1] for r in got}) == ["test", "train", "valid"] and len(got) == 6


def test_read_metric_files(spark, tmpdir_path):
    for e, body in (("5", "{'bleu': 9.5, 'sari': 37.35}\nsecond line ignored\n"), ("3", "{'bleu': 0.0, 'fkgl': 1.5}\n")):
        d = os.path.join(tmpdir_path, "experiments", e, "checkpoints")
        os.makedirs(d)
        open(os.path.join(d, "evaluation.txt"), "w").write(body)
    got = {r["exp_id"]: (r["bleu"], r["sari"], r["fkgl"])
           for r in EX.read_metric_files(spark, os.path.join(tmpdir_path, "experiments", "*", "checkpoints", "evaluation.txt")).collect()}
    assert got == {"5": (9.5, 37.35, None), "3": (0.0, None, 1.5)}


def test_read_hypotheses_file(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "gen.out")
    open(p, "w").write("S-1\tsource\nH-1\t-0.25\tbest one\nH-0\t-0.5\tzero\nH-1\t-0.75\tworse one\nP-1\t-0.1 -0.2\n")
    h = HY.read_hypotheses(spark, p)
    assert {r["sample_id"]: r["text"] for r in HY.best_hypotheses(h).collect()} == {0: "zero", 1: "best one"}
    assert [r["texts"] for r in HY.group_hypotheses(h).where("sample_id = 1").collect()] == [["best one", "worse one"]]


def test_control_corpus_sink_partition_pruning(spark, pairs, ranks, tmpdir_path):
    out = os.path.join(tmpdir_path, "cc")
    cc = C.control_corpus(pairs.withColumn("split", F.when(F.col("pair_id") % 2 == 0, "train").otherwise("valid")),
                          ["length"]).withColumnRenamed("pair_id", "line_no")
    SK.write_control_corpus(cc.select("lang", "feature_set", "split", "line_no", "source_line", "target_line"), out)
    back = spark.read.parquet(out).where("lang = 'en' AND feature_set = 'length' AND split = 'valid'")
    assert "PartitionFilters" in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["line_no"] for r in back.collect()) == [1, 3, 5]


def test_custom_pandas_udf_tokenizer(spark, pairs, ranks):
    import pandas as pd
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def whitespace_tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [t for t in x.split() if t])

    cc = C.control_corpus(pairs, ["length", "frequency", "dependency"], ranks=ranks, tokenizer=whitespace_tokens, parse=parse_text)
    r = {x["pair_id"]: x for x in cc.collect()}
    assert r[1]["target_line"] == "A cat sat."                       # punctuation stays glued
    assert r[1]["source_line"].endswith("The cat sat on the mat.")


def test_bucketed_pairs_need_no_pair_shuffle(spark, pairs, ranks):
    from ctrltok.session import materialize
    from ctrltok.sources.tables import save_pairs_bucketed

    save_pairs_bucketed(pairs, "pairs_bucketed", 4)
    stored = spark.table("pairs_bucketed")
    stored_ranks = materialize(ranks, "ranks")                # a stored rank table has size statistics
    out = FE.feature_bundle(stored, ["frequency"], ranks=stored_ranks, partitioned=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair_id" not in plan            # no exchange of the pairs at all
    want = by_id(FE.feature_bundle(pairs, ["frequency"], ranks=ranks), "exact_frequency")
    assert {k: v[0] for k, v in by_id(out, "exact_frequency").items()} == pytest.approx({k: v[0] for k, v in want.items()})


def test_global_index_with_a_hot_group(spark):
    rows = [("hot" if i % 10 else f"cold{i % 7}", (i * 7919) % 1009, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(8)
    out = NU.global_index(df, [F.col("v").desc(), "id"], group_by=["g"], out="n").collect()
    by_group = {}
    for r in out:
        by_group.setdefault(r["g"], []).append(r)
    for g, rs in by_group.items():
        want = sorted(rs, key=lambda r: (-r["v"], r["id"]))
        assert [r["n"] for r in want] == list(range(len(rs))), g
    # the range sort behind the numbering spreads the hot group over several
    # partitions (AQE coalescing off so the tiny test data keeps its ranges)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = (df.orderBy("g", F.col("v").desc(), "id").where("g = 'hot'")
                 .select(F.spark_partition_id().alias("p")).distinct().count())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert parts > 1


def test_hist_equal_width_matches_numpy(spark):
    rng = np.random.default_rng(11)
    xs = list(rng.normal(1.0, 0.4, 500)) + [0.1 * i for i in range(30)]        # includes values on edges
    flat = [0.7] * 9                                                             # zero-width range
    df = spark.createDataFrame([("length", float(x)) for x in xs] + [("frequency", x) for x in flat],
                               "feature string, x double")
    got = {(r["feature"], r["bin"]): r["cnt"] for r in PR.hist_equal_width(df, {"length": 80, "frequency": 80}).collect()}
    for feat, vals in (("length", xs), ("frequency", flat)):
        counts, _ = np.histogram(vals, bins=80)
        want = {(feat, i): int(c) for i, c in enumerate(counts) if c}
        assert {k: v for k, v in got.items() if k[0] == feat} == want, feat


def test_feature_match_with_levenshtein(spark, ranks):
    rows = spark.createDataFrame([
        (1, "en", "<Leven_1.0> a b c", "a b c"),            # identical output: similarity 1.0 -> match
        (2, "en", "<Leven_0.5> a b c", "a b c"),            # requested 0.5, realised 1.0
    ], "pair_id long, lang string, source_line string, output string")
    cmp = {r["pair_id"]: (r["match"], r["delta"]) for r in MA.realised_vs_requested(rows, ["levenshtein"]).collect()}
    assert cmp[1] == (True, None) and cmp[2][0] is False and cmp[2][1] == pytest.approx(-0.5)
