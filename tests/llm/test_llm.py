"""The llm operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

pa = pytest.importorskip("pyarrow")
llm = pytest.importorskip("ctrltok.llm")

from ctrltok.llm import bpe, decontam, langid, line_dedup, pii, secrets, simhash, sketch, spans, suffix_dedup, toxicity  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, did long, tag long, hi long, KEY string"
WORDS = "the of and to in is that for it as was with be by on".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n))


def frame(spark, texts, ids=None):
    """A documents table with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", 0, 7, 7, 7, "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(0, 90)) for _ in range(40)]
    out = list(base)
    for t in base[:20]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[0], base[0], base[1], "", " ", "\n\n", "word", "Ünï cödé 😀 " + base[2], base[3].upper(), "x" * 30000,
            "shared line here\n" + base[4] + "\nshared line here", "  Shared LINE here \t\nother", "ab" * 400, base[5] + base[6] + base[5]]
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rows_by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# line dedup


def brute_lines(docs):
    first, out = {}, {}
    space = b" \t\n\r\x0b\x0c"
    key = lambda x: x.strip(space).lower()
    for d, t in sorted(docs):
        for x in t.encode().split(b"\n"):
            first.setdefault(key(x), d)
    for d, t in docs:
        lines = t.encode().split(b"\n")
        kept = [x for x in lines if len(key(x).decode()) < 10 or first[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), sha(b"\n".join(kept)))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_line_dedup(spark, texts, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_by_id(line_dedup.line_digests(frame(spark, texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_lines(list(enumerate(texts)))
    assert {d: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for d, r in got.items()} == want
    assert any(r["n_dropped"] for r in got.values())


def test_line_dedup_keeps_columns_and_nulls(spark):
    df = frame(spark, ["a common line\nown", "A COMMON line ", None], [2, 1, 3])
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {2: "own", 1: "A COMMON line ", 3: None}


def test_bitmap_round_trip():
    for dropped, n in (([0], 1), ([3, 8], 9), ([7], 40), (list(range(0, 1000, 3)), 1000)):
        keep = line_dedup.unpack(line_dedup.pack(dropped), n)
        assert sorted(np.flatnonzero(~keep)) == dropped


# SimHash


def brute_simhash(docs, distance=2):
    import xxhash

    def fp(t):
        w = t.encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = {d: fp(t) for d, t in docs}
    root = {d: d for d in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(f)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (f[a] ^ f[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f[d], find(d)) for d in ids}


def test_simhash(spark, texts):
    got = rows_by_id(simhash.near_duplicates(frame(spark, texts)))
    want = brute_simhash(list(enumerate(texts)))
    assert {d: (r["fp"] & (1 << 64) - 1, r["component_id"]) for d, r in got.items()} == want


@pytest.mark.parametrize("distance,bucket", [(0, 64), (1, 64), (1, 1), (2, 64), (2, 1)])
def test_fingerprint_links_connect_like_all_pairs(spark, distance, bucket):
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(15):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.fingerprint_links(nodes, distance, 4, bucket)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    label = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    assert {x: got.get(x, x) for x in signed} == label


def test_one_of_each_group(spark, texts):
    df = frame(spark, texts)
    kept = {r.doc_id for r in simhash.one_of_each_group(df).collect()}
    assert kept == {root for _, root in brute_simhash(list(enumerate(texts))).values()}


# decontamination


def test_decontamination_tolerates_substitutions_and_case(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (30, 20, 15, 9, 6, 3)]
    filler = lambda n: " ".join(word() for _ in range(n))
    swapped = items[0].split()
    for i in (4, 11, 17, 25):
        swapped[i] = "other"
    docs = [filler(50) + " " + items[0] + " " + filler(50), filler(20) + " " + " ".join(swapped), items[1].upper() + "!",
            filler(300), " ".join(items[0].split()[:14]) + " " + filler(30), " ".join(items[0].split()[:8]) + " " + filler(30),
            filler(5) + " " + items[3], items[4] + " " + filler(4), items[5] + " " + filler(9), "", None, items[0] + " " + items[1],
            "Ñandú ÉTÉ " + items[2]]
    bench = spark.createDataFrame(list(enumerate(items)) + [(6, None), (7, ""), (0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.overlaps(frame(spark, docs), bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (4, 0), (6, 3), (7, 4), (11, 0), (11, 1), (12, 2)}
    assert got[1, 0].words >= 22 and 0.8 <= got[1, 0].similarity < 1
    assert got[0, 0].doc_word == 50 and got[0, 0].item_word == 0
    kept = {r.doc_id for r in decontam.drop_contaminated(frame(spark, docs), bench).collect()}
    assert kept == {3, 5, 8, 9, 10}


def test_unspaced_scripts_and_short_items(spark):
    chinese = "从前有座山山里有座庙庙里有个老和尚在讲故事给小和尚听"
    thai = "กาลครั้งหนึ่งนานมาแล้วมีชายคนหนึ่งอาศัยอยู่ในหมู่บ้าน"
    items = [(1, chinese), (2, thai), (3, "Yes, indeed."), (4, "«Bonjour» à tous — les amis de la maison d’été et du jardin bleu très grand")]
    docs = ["前言：" + chinese + "。后记", "เอ๊ะ " + thai, "yes indeed", "yes indeed it is", 'bonjour à tous, les amis; de la "maison" d’été et du jardin bleu très grand!',
            "完全不同的内容没有任何重复之处我们今天去公园玩", "Yes"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(frame(spark, docs), bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (4, 4)}


def test_seed_masks_find_every_pattern_of_a_fifth_substituted():
    from itertools import combinations

    for length, errors in ((13, 2), (15, 3), (20, 4)):
        for gone in combinations(range(length), errors):
            assert any(all(o + k not in gone for k, c in enumerate(m) if c == "1")
                       for m in decontam.MASKS for o in range(length - len(m) + 1))


def test_copies_with_any_fifth_substituted_overlap(spark):
    from itertools import combinations

    rng = random.Random(9)
    items, docs, want = {}, [], set()
    for n in range(13, 31):
        items[n] = [f"w{n}x{k}" for k in range(n)]
        for errors in range(n // 5 + 1):
            patterns = list(combinations(range(n), errors)) if n < 17 else [rng.sample(range(n), errors) for _ in range(60)]
            for gone in patterns:
                want.add((len(docs), n, errors))
                docs.append(" ".join(["before", "it", *("other" if k in gone else w for k, w in enumerate(items[n])), "and", "after"]))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontam.overlaps(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id, r.item_id - r.agreeing) for r in got} == want
    assert all(r.similarity >= 0.8 and r.words >= 13 for r in got)


def linked(rows):
    """Pairs of a document and an item that rows and classes of overlaps stand for."""
    classes = {}
    for r in rows:
        docs, items = classes.setdefault((r.class_id, None if r.class_id is not None else (r.doc_id, r.item_id)), (set(), set()))
        docs.add(r.doc_id)
        items.add(r.item_id)
    return {(d, i) for docs, items in classes.values() for d in docs for i in items}


def brute_overlaps(docs, items):
    hasher, out = decontam.Hasher(), set()
    words = {(k, i): hasher.words((t or "").lower())[0] for k, rows in (("d", docs), ("i", items)) for i, t in rows}
    for d, _ in docs:
        for i, _ in items:
            a, b = words["d", d], words["i", i]
            if 0 < len(b) < decontam.SHORTEST:
                found = len(a) == len(b) and (a == b).all()
            else:
                found = decontam.overlap(a, b, range(-len(b), len(a) + 1), 13, 0.8) if len(b) else None
            if found:
                out.add((d, i))
    return out


def test_decontamination_classes_equal_all_pairs(spark):
    rng = random.Random(12)
    own = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n)]
    lines = [own(n) for n in (17, 14, 24, 40)]
    items = []
    for _ in range(45):
        w = own(rng.randrange(3, 12))
        for line in rng.sample(lines, rng.randrange(0, 3)):
            w += line[rng.choice([0, 0, 0, 4]):] + own(rng.randrange(0, 9))
        items.append(w if len(w) > 12 else w[:4] if rng.random() < 0.3 else w + own(13))
    items += [items[k] for k in (0, 1, 2, 3)] + [["yes", "indeed"]] * 3
    docs = []
    for _ in range(120):
        w = own(rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 3)):
            part = list(rng.choice(rng.choice([lines, items])))
            if rng.random() < 0.5:  # a fragment
                lo = rng.randrange(len(part))
                part = part[lo:lo + rng.randrange(5, 30)]
            for _ in range(int(len(part) * rng.choice([0, 0, 0.1, 0.2, 0.25]))):
                part[rng.randrange(len(part))] = "other"
            w += part + own(rng.randrange(0, 20))
        docs.append(" ".join(w))
    docs += ["Yes, indeed", "yes indeed", None]
    bench = [(i, " ".join(w).capitalize()) for i, w in enumerate(items)] + [(0, "another text under an id that is taken")]
    want = brute_overlaps(list(enumerate(docs)), bench[:-1])
    got = decontam.overlaps(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string").repartition(4)).collect()
    assert linked(got) == want and len(want) > 300
    assert any(r.class_id is not None and r.n_items > 3 for r in got) and any(r.class_id is None for r in got)
    assert all(r.similarity >= 0.8 and r.words == r.agreeing / r.similarity for r in got)
    kept = {r.doc_id for r in decontam.drop_contaminated(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in want}


def test_decontamination_shared_line_is_linear(spark):
    rng = random.Random(13)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    line = own(17)
    changed = " ".join("other" if k == 8 else w for k, w in enumerate(line.split()))
    items = [(i, own(10) + " " + line + " " + own(10)) for i in range(300)]
    docs = [own(20) + " " + (line if d % 3 else changed) + " " + own(20) for d in range(300)]
    got = decontam.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) < 700 and {(r.n_items, r.words >= 13) for r in got} == {(300, True)}
    assert {r.doc_id for r in got} == set(range(300)) and {r.item_id for r in got} == set(range(300))
    first = {(r.doc_id, r.item_id): r for r in got}
    assert first[1, 0].doc_word == 20 and first[1, 0].item_word == 10 and first[1, 0].words == 17


def test_best_stretch_against_all_stretches():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        same, least = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.75, 0.9]), int(rng.integers(1, 15))
        every = [(int(same[i:j].sum()), i - j) for i in range(len(same)) for j in range(i + least, len(same) + 1)
                 if 5 * int(same[i:j].sum()) >= 4 * (j - i)]
        got = decontam.best_stretch(same, 0.8, least)
        assert (got is None) == (not every)
        if got:
            n, agree = got[1] - got[0], int(same[got[0]:got[1]].sum())
            assert n >= least and 5 * agree >= 4 * n and agree == max(every)[0]


# repeated substrings


def brute_repeats(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("group,slice_bytes", [(256, 1 << 21), (2, 1 << 21), (256, 700)])
def test_suffix_dedup(spark, texts, monkeypatch, group, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefg ") for _ in range(900))
    docs = list(texts)
    for _ in range(120):
        i = rng.randrange(700)
        docs.append("".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + base[i:i + rng.randrange(80, 300)] + "é" * rng.randrange(40))
    got = rows_by_id(suffix_dedup.digests(frame(spark, docs)))
    want = brute_repeats(list(enumerate(docs)))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


@pytest.mark.parametrize("least", [1, 8])
def test_suffix_dedup_of_a_phrase_in_many_surroundings(spark, monkeypatch, least):
    """A core with one stretch per document: dealt by stretch, its windows by name; the result does not depend on it."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_LEAST", least)
    rng = random.Random(6)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(70))
    word = lambda n: "".join(rng.choice("xyz ") for _ in range(n))
    docs = [word(120) + phrase + word(120) for _ in range(60)]
    docs += [docs[3][:260] + word(90), word(40) + docs[5][60:], phrase * 3, word(30) + phrase + docs[7][190:]]
    rows = suffix_dedup.keyed(frame(spark, docs))
    assert suffix_dedup.crowded_cores(rows)
    got = rows_by_id(suffix_dedup.digests(frame(spark, docs)))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute_repeats(list(enumerate(docs)))


def test_suffix_dedup_equal_rows_are_one_document(spark):
    t = sentence(random.Random(0), 80)
    got = suffix_dedup.digests(frame(spark, [t, t, t], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in got) == [(1, False), (1, False), (2, True)]


# BPE


def tokenizer_path():
    tok = pytest.importorskip("public_tokenizers")
    return str(tok.path("byte_bpe_50k.json"))


def test_bpe_equals_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    reference = Tokenizer.from_file(path)
    rng = random.Random(3)
    atoms = ["a", "b", " ", "  ", "\n", "'", "s", "re", "<|endoftext|>", ".", ",", "1", "é", "中", "<|", "|>", " the", " of"]
    docs = texts + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 2500))) for _ in range(60)] + ["don't we'll " * 900, "中文" * 3000]
    df = frame(spark, docs)
    got = rows_by_id(bpe.digests(df, path))
    for d, t in enumerate(docs):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == sha(",".join(map(str, ids)))
        assert got[d]["decoded_sha256"] == sha(t) == sha(reference.decode(ids, skip_special_tokens=False))
    back = rows_by_id(bpe.decode(bpe.encode(df, path), path))
    assert all(back[d]["text"] == t for d, t in enumerate(docs))


def test_bpe_reuses_shared_chunks_and_widens_bad_joins(monkeypatch):
    codec = bpe.Codec(bpe.read_vocabulary(tokenizer_path()))
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 12) + "." for _ in range(400))
    one, two = "First head. " + passage, "Another, longer start of text! " + passage
    assert codec.encode(one.encode()).tolist() == codec.plain(one.encode())
    before = codec.encoded
    assert codec.encode(two.encode()).tolist() == codec.plain(two.encode())
    assert codec.reused > codec.encoded - before
    # with points that are not safe, joins disagree until bodies are given up
    monkeypatch.setattr(bpe, "SAFE", re.compile(rb"[a-z](?=[a-z])"))
    careless = bpe.Codec(bpe.read_vocabulary(tokenizer_path()))
    careless.encode(one.encode())
    assert careless.widened > 0


def test_cut_points_follow_content():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(30000)).encode()
    a, b = b"x" * 300 + passage, b"another head " * 77 + passage
    cuts = [{c - len(t) for c in bpe.cut_points(t)} for t in (a, b)]
    assert len(cuts[0] & cuts[1]) > 5
    for t in (a, b):
        at = bpe.cut_points(t)
        assert at[-1] == len(t) and all(x < y for x, y in zip(at, at[1:], strict=False))


# language


def brute_log_probability(word, pieces, p):
    alpha = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            i = pieces.get(word[s:e], langid.UNKNOWN if s == e - 1 else None)
            if i is not None:
                alpha[e] += alpha[s] * p[i]
    return np.log(alpha[-1])


def test_forward_sums_all_segmentations():
    from collections import Counter

    pieces = {p: i for i, p in enumerate(sorted(["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "ü"]), 1)}
    model = langid.fit({"x": Counter({"abab": 3, "ba": 2}), "y": Counter({"bbb": 4, "aü": 1})}, pieces)
    words = ["abab", "ba", "b", "aüz", "zzz"]
    got = langid.log_probability(words, model)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(brute_log_probability("▁" + w, pieces, model.probability[:, k]))
    assert model.probability[:, 0].sum() == pytest.approx(1)


def test_long_words_sum_all_segmentations():
    rng = random.Random(3)
    vocabulary = {p: i for i, p in enumerate(["▁", "▁ab", "a", "b", "ab", "ba", "abba", "bab", "ccc"], 1)}
    pieces = langid.Pieces(vocabulary)
    probability = np.array([[rng.random() + 0.01, rng.random() + 0.01] for _ in range(pieces.size)])
    probability[-1] = 0
    probability /= probability.sum(axis=0)
    model = langid.Model(pieces, ["x", "y"], probability)
    words = ["".join(rng.choice("abcé") for _ in range(n)) for n in (3, 24, 25, 26, 60, 60, 61, 200)] + ["ab" * 3000]
    got = langid.log_probability(words, model)
    for w, row in zip(words, got, strict=True):
        text = "▁" + w
        for lang in (0, 1):
            logs = [0.0] + [-np.inf] * len(text)
            for end in range(1, len(text) + 1):
                ways = []
                for start in range(max(0, end - 4), end):
                    i = vocabulary.get(text[start:end], 0 if end - start == 1 else None)
                    if i is not None:
                        ways.append(logs[start] + np.log(probability[i, lang]))
                logs[end] = np.logaddexp.reduce(ways)
            assert row[lang] == pytest.approx(logs[-1], rel=1e-9)


def test_language_sample_skips_texts_that_do_not_fit(spark):
    """A language whose first ids are long or null texts is still learned, the same from any row order."""
    tok = pytest.importorskip("public_tokenizers")
    rows = [(i, "x " * 40_000 if i % 3 else None, "de") for i in range(60)] + [(100 + i, "über zwölf große ärgerliche", "de") for i in range(5)]
    rows += [(200 + i, "the quick brown fox", "en") for i in range(40)] + [(200, "another text of it", "en")]
    a, b = (langid.learn(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(3), str(tok.path("piece_bpe_32k.model")), sample_docs=5)
            for r in (rows, rows[::-1]))
    assert a.languages == b.languages == ["de", "en"] and (a.probability == b.probability).all()


def test_language_held_out_accuracy(spark):
    path = str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows_by_id(langid.predictions(docs, langid.learn(docs, path)))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.97


def test_language_edges(spark):
    path = str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    docs = frame(spark, [None, "", "123 ?!", "hello there"] + ["the of and"] * 30)
    got = rows_by_id(langid.predictions(docs, langid.learn(docs, path)))
    assert [got[i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "en"]
    none = langid.predictions(docs, langid.learn(docs.filter("doc_id < 0"), path)).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)


# toxicity


def toxic_sample(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(["th", "er", "an", "in", "ou", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(120)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(8):
                words[rng.randrange(120)] = rng.choice(["grumplox", "blarfwit", "snozzcum", "vexdrudge"])
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_separates_held_out_documents():
    model = toxicity.fit(toxic_sample(600), (400, 200))
    scorer = toxicity.Scorer(model)
    rest = toxic_sample(150, 1)
    scores = [(scorer.score(t), y) for t, y in rest]
    assert np.mean([s >= 0.7 for s, y in scores if y]) > 0.9
    assert np.mean([s >= 0.7 for s, y in scores if not y]) < 0.05
    assert 0 <= scorer.score("") < 0.7 and 0 <= scorer.score("x" * 100000) <= 1


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b", None, ""])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 3
    assert toxicity.drop_toxic(docs, model).count() == 3 and toxicity.drop_toxic(docs, model).columns == docs.columns


# sketches


def test_fingerprints(spark, texts):
    got = rows_by_id(sketch.digests(frame(spark, texts)))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for d, t in enumerate(texts):
        after = texts[(d + 1) % len(texts)]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        # below k distinct shingles the estimate is exact
        assert r["near_edited"] == pytest.approx(like(shingles(t), shingles(edited)))
        assert r["near_next"] == pytest.approx(like(shingles(t), shingles(after)))
    assert got[0]["fingerprint"] == got[60]["fingerprint"]


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(900)) for _ in range(4)]
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(parts)], "k int, i int, text string")
    one = sketch.with_sketch(df, "text", "sketch")
    merged = sketch.merge_parts(one, "k").first()
    every = sorted({h for r in sketch.with_sketch(df, "text", "s", k=10**6).collect() for h in r.s})
    assert merged.sketch == every[:sketch.K]
    n = spark.createDataFrame([(merged.sketch,)], "s array<long>").select(sketch.distinct_count(F.col("s"))).first()[0]
    assert n == pytest.approx(len(every), rel=0.3)
    a = sketch.with_sketch(spark.createDataFrame([(parts[0], parts[0] + " " + parts[1])], "a string, b string"), "a", "sa")
    c = sketch.with_sketch(a, "b", "sb").select(sketch.containment(F.col("sa"), F.col("sb")), sketch.containment(F.col("sb"), F.col("sa"))).first()
    assert c[0] > 0.85 and 0.3 < c[1] < 0.7


# spans


def base_secrets(t):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    spans.sort()
    return (*[sum(s[1] == k for s in spans) for k in range(3)], sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)))


def test_secrets(spark):
    rng = random.Random(2)
    atoms = ["password", "PASSWD", "secret", "Token", "api_key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGH12345678",
             "0123456789abcdef", "é", "中😀", "\n", "x/y+z", "user=bob", "http://h.example.com/x", "pwd=abcd"]
    docs = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 50))) for _ in range(200)] + [None, "", "a" * 30000]
    got = rows_by_id(secrets.digests(frame(spark, docs)))
    for d, t in enumerate(docs):
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == base_secrets(t or "")


def test_weak_parts_need_their_complement(spark):
    far = " " + "z " * 400
    docs = ["client_id=abc123 pwd=xyzw", "client_id=abc123", "pwd=xyzw", "pwd=xyzw at https://db.example.com/a", "client_id=abc123" + far + "pwd=xyzw",
            "https://db.example.com/a client_id=abc123", "https://db.example.com/a client_id=abc123 pwd=xyzw", "client_id=abc123 token=abcdefgh1"]
    got = rows_by_id(secrets.digests(frame(spark, docs)))
    kinds = [sorted({s.split(":")[0] for s in got[d]["spans"].split(",") if s}) for d in range(len(docs))]
    assert kinds == [["identifier", "weak_secret"], [], [], ["weak_secret"], [], [], ["endpoint", "identifier", "weak_secret"],
                     ["assign", "identifier"]]


def test_linking_against_all_pairs(spark):
    rng = random.Random(6)
    scans, want = [], {}
    for d in range(120):
        parts = set()
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(2500)
            parts.add((a, rng.randrange(6), a + rng.choice([5, 10, 40, 299, 300, 301, 700, 1500])))
        parts |= {(299 + d, 3, 319 + d), (609 + d, 4, 615 + d)} if d < 20 else set()
        scans.append((d, 0, sorted(p for p in parts if p[1] < 3), sorted(p for p in parts if p[1] >= 3)))
        met = {p: {secrets.CLASS_OF[q[1]] for q in parts if 0 <= max(q[0] - p[2], p[0] - q[2]) <= 300} for p in parts if p[1] >= 3}
        need = {0: lambda c: 1 in c, 1: lambda c: 0 in c or 2 in c, 2: lambda c: {0, 1} <= c}
        added = sorted(p for p, c in met.items() if need[secrets.CLASS_OF[p[1]]](c))
        want |= {d: added} if added else {}
    spans_ = "array<struct<start:int,kind:int,stop:int>>"
    df = spark.createDataFrame(scans, f"did long, tag long, base {spans_}, weak {spans_}")
    assert {r.did: [tuple(x) for x in r.added] for r in secrets.linked(df).collect()} == want
    assert all((299 + d, 3, 319 + d) in want[d] for d in range(20))


def test_names_inside_longer_ones(spark):
    key = "wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY00"[:40]
    docs = ["DB_USER=bob DB_PWD=abcd DB_HOST=db.example.com", f"aws_access_key_id=abc123 aws_secret_access_key={key}", "MY_SECRET=abcd\nMY_USER=bob",
            "x-user-name: bob\nPASSWORD_2: abcd", f"user=bob sk={key}", "user-agent: bot/1 token_type=none", "superuser=bob bypass=abcd",
            "mail_server_1=mail.example.com LOGIN_PROD=bob PASS_PROD=abcd", "DB_USER=bob", "DB_HOST=db.example.com DB_USER=bob", "secretAccessKey=abcd user=bob"]
    got = rows_by_id(secrets.digests(frame(spark, docs)))
    values = [sorted(docs[d][int(a):int(b)] for s in got[d]["spans"].split(",") if s for _, a, b in [s.split(":")]) for d in range(len(docs))]
    assert values == [["HOST=db.example.com", "PWD=abcd", "USER=bob"], ["access_key_id=abc123", f"secret_access_key={key}"], ["SECRET=abcd", "USER=bob"],
                      ["PASSWORD_2: abcd", "user-name: bob"], ["user=bob", key], [], [], ["LOGIN_PROD=bob", "PASS_PROD=abcd", "server_1=mail.example.com"],
                      [], [], ["secretAccessKey=abcd", "user=bob"]]


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_spans_in_blocks(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spans, "BLOCK", block)
    rng = random.Random(block)
    docs = ["".join(rng.choice(["12", "7", "ab", " ", "é", "😀", "x" * 90]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["5 " * 300, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, text string")
    got = df.select("i", spans.found("text", "[0-9]+", lambda m, g: F.char_length(m) > 1).alias("s")).collect()
    for r in got:
        want = [(m.start(), m.end(), m[0], docs[r.i][max(0, m.start() - spans.CONTEXT):m.start()]) for m in re.finditer("[0-9]+", docs[r.i]) if len(m[0]) > 1]
        assert [tuple(s) for s in r.s] == want


def test_covered_spans_against_all_pairs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(d, d % 3, rng.random() < 0.4, a, a + rng.randint(1, 9)) for d in range(60) for a in (rng.randrange(60) for _ in range(rng.randint(0, 12)))]
    got = spans.covered(spark.createDataFrame(rows, "did long, tag long, base boolean, start int, stop int"), "start", "stop", F.col("base"))
    over = lambda r: any(b[:2] == r[:2] and b[2] and b[3] < r[4] and b[4] > r[3] for b in rows)
    assert sorted(map(tuple, got.collect())) == sorted((*r, not r[2] and over(r)) for r in rows)


@pytest.mark.parametrize("make,module,unit", [(lambda i: f"10.{i % 250}.{i // 250 % 250}.{i % 99} x\n", pii, 1), (lambda i: f"user=bob{i} pwd=abc{i}\n", secrets, 2)])
def test_many_matches_in_one_text(spark, make, module, unit):
    """100,000 matches in one text: the time follows the text's length."""
    import time

    took = []
    for n in (12_500 // unit, 100_000 // unit):
        text = "".join(make(i) for i in range(n))
        began = time.time()
        row = module.digests(frame(spark, [text])).collect()[0]
        took.append(time.time() - began)
        assert len(row["spans"].split(",")) == n * unit
    assert took[1] < 12 * took[0] + 10, took


def repeated_ids():
    """Two texts under one id whose hashes agree in their lowest 16 bits, and others."""
    import xxhash

    seen = {}
    for i in range(100_000):
        t = f"first line number {i} of its own\nshared line of many\nlast line {i} here user=bob{i} pwd=abcd{i} mail a{i}@b.org"
        h = xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFF
        if h in seen:
            return [(1, "shared line of many\nand more"), (5, seen[h]), (5, t), (5, t), (9, seen[h]), (9, "other words here")]
        seen[h] = t


def test_rows_that_repeat_an_id_stay_apart(spark):
    data = repeated_ids()
    ids, docs = [d for d, _ in data], [t for _, t in data]
    alone = [(5, docs[1]), (5, docs[2]), (9, docs[5])]
    frame_ = frame(spark, docs, ids)
    sizes = sorted(len(t) for t in docs)
    got = sketch.digests(frame_).collect()
    assert sorted(r.n_chars for r in got) == sorted({(d, t): len(t) for d, t in data}.values()) or sorted(r.n_chars for r in got) == sizes
    lines = sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(frame_).select("doc_id", "text").collect())
    first = {}
    for d, t in sorted(data):
        for line in t.split("\n"):
            first.setdefault(line.strip().lower(), d)
    want = [(d, "\n".join(x for x in t.split("\n") if first[x.strip().lower()] == d)) for d, t in data]
    assert lines == sorted(want)
    for module, column in ((secrets, "spans"), (pii, "base_sha256"), (suffix_dedup, "n_bytes")):
        single = {t: module.digests(frame(spark, [t], [d])).first()[column] for d, t in alone}
        rows = [r[column] for r in module.digests(frame_).collect()]
        assert len(rows) == len(data) and all(rows.count(v) >= docs.count(t) for t, v in single.items())


def base_pii(t):
    def luhn(d):
        v = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return sum(v) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
             [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))],
             [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
             [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]]
    return (*map(len, spans), sha(",".join(f"{k}:{a}:{b}" for k, v in zip(pii.KINDS, spans, strict=True) for a, b in v)))


def test_personal_data(spark):
    rng = random.Random(2)
    atoms = ["a@b.c", "x%y@z-1.com", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
             "+", "12", "-", " ", "é", "中😀", "\n", "9", "(", ")", "foo", "0", "5500000000000004", ".b"]
    docs = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "1" * 20000, "a@" + "b." * 9000 + "c"]
    got = rows_by_id(pii.digests(frame(spark, docs)))
    for d, t in enumerate(docs):
        r = got[d]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == base_pii(t or "")


def test_contexts_discover_unseen_identifiers(spark):
    docs = [f"hello please call me at +1 555 0{i:02d} 12{i:02d} now" for i in range(30)]
    docs += [f"you can call me at 555-77{i:02d} ok" for i in range(3)] + [f"the year was 19{i:02d} then" for i in range(20)]
    got = rows_by_id(pii.digests(frame(spark, docs)))
    assert all(got[i]["spans"] == "ctx_phone:19:27" for i in (30, 31, 32))
    assert all(got[i]["spans"] == "" for i in range(33, 53))


def test_two_word_contexts_discover_where_one_word_is_mixed(spark):
    docs = [f"my phone at +1 555 0{i:02d} 12{i:02d} now" for i in range(30)] + [f"we met at 1{i:03d}x today" for i in range(150)]
    docs += [f"a phone at 555-77{i:02d} ok" for i in range(3)]
    got = rows_by_id(pii.digests(frame(spark, docs)))
    assert [got[i]["spans"] for i in (180, 181, 182)] == ["ctx_phone:11:19"] * 3
    assert all(got[i]["spans"] == "" for i in range(30, 180))


def test_context_is_the_text_before_across_matches(spark):
    texts = ["a bc 中😀 d 12 e34", "x " * 100 + "9", "y" * 200 + " z 7 8", "5"]
    df = frame(spark, texts).select("doc_id", spans.found("text", r"\S++", lambda m, g: m.rlike("[0-9]")).alias("s"))
    for r in df.collect():
        t = texts[r.doc_id]
        assert [(x.start, x.stop, x.before) for x in r.s] == [
            (m.start(), m.end(), t[:m.start()][-spans.CONTEXT:]) for m in re.finditer(r"\S+", t) if re.search("[0-9]", m[0])]


# every operator: empty tables, null ids and repeated rows


def operators(spark):
    path = tokenizer_path()
    pieces = path.replace("byte_bpe_50k.json", "piece_bpe_32k.model")
    bench = spark.createDataFrame([(0, "some item of the benchmark with enough words to be found here")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    return {"decontam": lambda d: decontam.overlaps(d, bench), "line": line_dedup.line_digests, "toxic": lambda d: toxicity.scores(d, toxicity.learn(d, labels)),
            "suffix": suffix_dedup.digests, "lang": lambda d: langid.predictions(d, langid.learn(d, pieces)), "secrets": secrets.digests,
            "sketch": sketch.digests, "bpe": lambda d: bpe.digests(d, path), "simhash": simhash.near_duplicates, "pii": pii.digests}


@pytest.mark.parametrize("name", ["decontam", "line", "toxic", "suffix", "lang", "secrets", "sketch", "bpe", "simhash", "pii"])
def test_edges(spark, name):
    run = operators(spark)[name]
    assert run(frame(spark, [], [])).count() == 0
    t = "one two three four five six seven user=bob pwd=abcd +1 555 123 4567\nsome common line"
    rows = [(None, t), (1, t), (1, t), (1, None), (2, ""), (3, t + " more"), (None, None)]
    got = run(frame(spark, [x[1] for x in rows], [x[0] for x in rows])).collect()
    assert len(got) == (0 if name == "decontam" else len(rows))
    if name != "decontam":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in rows)
