"""Periodic runs, licence templates and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("ctrltok.llm")

from ctrltok.llm import licenses, periodic, prefix_trie  # noqa: E402
from ctrltok.llm.license_texts import PHRASES, TEMPLATES  # noqa: E402

DOC = "doc_id long, text string, start long, runs string, labels string, KEY string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "r", "l", "k") for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# periodic runs


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def repetitive(rng):
    k, out = rng.choice([1, 2, 2, 3, 4]), []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.4:
            unit = unit * rng.randint(1, 6) + [rng.randrange(k)]
        out += unit * rng.randint(1, 7) + [rng.randrange(k) for _ in range(rng.randint(0, 4))]
    return out if rng.random() < 0.7 else out[:30] * 5 + out[:7]


def test_runs_equal_brute_force_on_repetitive_words():
    rng = random.Random(1)
    for _ in range(400):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        symbols = np.array([10 * i + c for i, t in enumerate(texts) for c in t], np.int64)
        first = np.cumsum([0] + [len(t) for t in texts])
        want = sorted((a + first[i], n, q) for i, t in enumerate(texts) for a, n, q in brute_runs(t))
        assert list(zip(*periodic.find_runs(symbols), strict=True)) == want


def test_names_and_range_successor():
    rng = random.Random(2)
    w = [rng.randrange(3) for _ in range(200)]
    names = periodic.Names(np.array(w))
    assert [w[i:] for i in names.sa] == sorted(w[i:] for i in range(len(w)))
    i, j = np.array([(a, b) for a in range(0, 190, 7) for b in range(a + 1, 200, 11)]).T
    right = [next((k for k in range(200 - b) if w[a + k] != w[b + k]), 200 - b) for a, b in zip(i, j, strict=True)]
    left = [next((k for k in range(a) if w[a - 1 - k] != w[b - 1 - k]), a) for a, b in zip(i, j, strict=True)]
    assert names.right(i, j).tolist() == right and names.left(i, j).tolist() == left
    values = np.array(rng.sample(range(500), 300))
    tree = periodic.Wavelet(values, 9)
    lo, hi, x = (np.array([rng.randrange(n) for _ in range(500)]) for n in (150, 300, 511))
    hi = np.maximum(lo, hi)
    want = [min((v for v in values[a:b].tolist() if v >= c), default=-1) for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.successor(lo, hi, x).tolist() == want


def edited_words(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if i is None else str(i).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_run_digests_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join("abcd"[c] + "é" * (c == 1) for c in repetitive(rng)) for _ in range(80)]
    texts += [None, "", " \t\n", "a a a a a", "a a a a a a", "x x " * 6, "b " * 30_000, "w1 w2\x0bw3\x0c" * 9, "one"]
    ids = [*range(len(texts) - 1), None]
    data = [*zip(ids, texts, strict=True), (3, texts[3]), (3, "c c c c c c c")]
    rows = periodic.digests(frame(spark, [t for _, t in data], [i for i, _ in data])).collect()

    def want(i, t):
        w = edited_words(i, t)
        runs = brute_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
                sha(" ".join(x for k, x in enumerate(w) if k not in gone)))

    assert sorted(map(repr, map(tuple, rows))) == sorted(repr(want(*d)) for d in data)


def test_run_lists_keep_texts(spark):
    rows = {r.doc_id: r for r in periodic.run_lists(frame(spark, ["x " + "a b " * 4 + "y", "p q"])).collect()}
    assert [tuple(r) for r in rows[0].runs] == [(1, 8, 2)] and rows[0].collapsed == "x a b y"
    assert rows[1].runs == [] and rows[1].collapsed == "p q"
    assert periodic.run_lists(frame(spark, [])).collect() == [] and periodic.digests(frame(spark, [])).count() == 0


# licences


def brute_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def ends_of(items, words, at):
    """All ends of ``items`` read from word ``at`` on."""
    ends = {at}
    for x in items:
        if isinstance(x, bytes):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == x.decode()}
        elif isinstance(x, list):
            ends |= {f for e in ends for f in ends_of(x, words, e)}
        else:
            ends = {e + k for e in ends for k in range(x[0], x[1] + 1) if e + k <= len(words)}
    return ends


TOY = [("one", "alpha beta <<beginOptional>>very <<beginOptional>>much<<endOptional>> so<<endOptional>> gamma"),
       ("two", "alpha <<var;words=0-3>> delta <<var;words=1-2>> beta"), ("three", "beta"), ("three", "gamma alpha alpha")]


def test_template_automata_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "alpha beta gamma delta very much so other".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    parsed = [(label, licenses.parse(t)) for label, t in TOY]
    rows = {r.doc_id: r for r in licenses.license_spans(frame(spark, texts), TOY).collect()}
    for i, text in enumerate(texts):
        words, want = text.split(), {}
        for at in range(len(words)):
            for label, items in parsed:
                for end in ends_of(items, words, at):
                    want[label, at] = max(want.get((label, at), 0), end)
        got = {(s.label, s.start): s.stop for s in rows[i].spans}
        assert got == want
        assert rows[i].score == 1.0 if got else rows[i].score < 1.0


def test_every_template_accepts_its_wording_and_nothing_less():
    scanner = licenses.Scanner(TEMPLATES, PHRASES)

    def render(items, optional, n):
        for x in items:
            if isinstance(x, bytes):
                yield x.decode()
            elif isinstance(x, list):
                yield from render(x, optional, n) if optional else ()
            else:
                yield from ["somebody"] * (x[0] if n == "least" else x[1])

    for label, text in TEMPLATES:
        items = licenses.parse(text)
        for n in ("least", "most"):
            words = list(render(items, False, n))
            for line in (" ".join(words), "(C) 2020 " + ",\n".join(words).upper() + ". end"):
                (_, _, spans, score), = scanner.scan([line.encode()])
                assert label in {s[0] for s in spans} and score == 1.0, (label, line)
            broken = [w if k != len(words) // 2 else "wrongword" for k, w in enumerate(words)]
            if isinstance(items[0], bytes) and not any(isinstance(x, tuple) for x in items):
                assert label not in {s[0] for s in scanner.scan([" ".join(broken).encode()])[0][2]}
        words = list(render(items, True, "least"))
        assert label in {s[0] for s in scanner.scan([" ".join(words).encode()])[0][2]}


def test_license_digests(spark):
    texts = ["Released under the MIT License.", "the APACHE-license, mité license", "GNU General  Public\nLicense; apache license", None, "",
             "Permission is hereby granted", "Licensed under CC BY-NC 4.0", "mit", "license mit license mit license", "x " * 100_000 + "mit license"]
    rows = {r.doc_id: r for r in licenses.digests(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = brute_words(t)
        places = sorted((k, lab) for p, lab in PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({lab for _, lab in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert rows[0].labels == "mit" and rows[0].score == 1 and rows[6].labels == "cc-by-nc-4.0" and rows[6].base_labels == ""
    assert rows[1].score == 0.5 and 0 < rows[5].score < 0.5 and rows[3].score == 0
    assert licenses.digests(frame(spark, [])).count() == 0


def test_templates_are_checked():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "a <<var;words=3-2>>"):
        with pytest.raises(ValueError):
            licenses.parse(bad)
    with pytest.raises(ValueError):
        licenses.Automata([("x", "<<beginOptional>>a<<endOptional>> b")])


# prefix trie


def brute_trie(rows, edited):
    convs, members, kids, out = {}, {}, {}, {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c in convs:
        convs[c] = [(r, x) for _, _, r, x in sorted(convs[c])]
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = convs.get(c - c % 5, [])[:h] + own[h:] if edited else own
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    done = {}
    for p in sorted(members, key=len, reverse=True):
        below, n = kids.get(p, []), len(members[p])
        done[p] = (sum(done[q][0] for q in below) or 1, sum(done[q][1] for q in below) + ((n - 1) * len(p[-1][1].encode()) if p else 0))
        ends = ",".join(str(c) for c, e in sorted(members[p]) if e)
        above = min(members[p[:-1]])[0] if p else None
        out[min(members[p])[0], len(p)] = (above, n, len(below), *done[p], sha(ends))
    return out


def check_trie(spark, rows, edited=True, **parameters):
    frame_ = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, len int, KEY string")
    got = prefix_trie.trie(frame_.repartition(4), edited, **parameters).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got) and found == brute_trie(rows, edited)


def turns(rng, convs, alphabet, longest):
    rows = [(c, t, rng.choice("ua"), "téxt%d" % rng.randrange(alphabet)) for c in range(convs) if rng.random() < 0.9
            for t in range(rng.randint(0, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("edited,alphabet,shard_nodes", [(True, 1, 6), (False, 2, 5), (False, 1, 2048)])
def test_trie_against_brute_force(spark, edited, alphabet, shard_nodes):
    check_trie(spark, turns(random.Random(alphabet + shard_nodes), 70, alphabet, 9), edited, shard_nodes=shard_nodes)


def test_trie_of_one_conversation_over_many_tasks(spark):
    rows = [(1, i, "u", "x") for i in range(300)] + [(2, i, "u", "x") for i in range(250)] + [(7, i, "u", "x") for i in range(300)]
    check_trie(spark, rows + [(9, 0, "u", "x"), (11, 0, "u", "z")], False, shard_nodes=20)


def test_trie_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_IN_A_STRETCH", 7)
    rows = [(c, t, "u", f"hot {t}") for c in range(400) for t in range(3)] + [(c, 0, "u", f"{c}") for c in range(400, 420)]
    check_trie(spark, rows, False, shard_nodes=50)


def test_trie_of_odd_rows(spark):
    check_trie(spark, [(None, 0, "a", "b"), (3, None, None, None), (3, None, None, None), (3, 1, "x", None), (4, 2, "q", "é"), (4, 2, "q", "a"),
                       (4, 2, "p", "z"), (-7, 0, "ab", "c"), (-6, 0, "a", "bc")], False, shard_nodes=3)
    check_trie(spark, [])
    check_trie(spark, [(5, 0, "u", "long " * 50_000), (6, 0, "u", "long " * 50_000)])


def test_double_array():
    rng = random.Random(8)
    parent, label, seen = [], [], set()
    for i in range(500):
        p, x = rng.randint(-1, i - 1), rng.randrange(60)
        if (p, x) not in seen:
            seen.add((p, x))
            parent.append(p if p < len(parent) else -1)
            label.append((x, i) if p >= len(parent) - 1 else x)
    trie, slots = prefix_trie.pack(parent, label)
    assert len(set(slots)) == len(slots)
    codes = {}
    for p in [-1, *range(len(parent))]:
        for i, q in enumerate(parent):
            if q == p:
                codes.setdefault(label[i], len(codes) + 1)
    for i, p in enumerate(parent):
        assert trie.check[slots[i]] == (1 if p < 0 else slots[p])
        node = 1 if p < 0 else slots[p]
        assert trie.child(node, slots[i] - trie.base[node]) == slots[i]
    assert all(trie.child(s, 10_000) == -1 for s in slots)
    done = prefix_trie.traverse(trie, dict.fromkeys(slots, 1))
    assert done[1][2] == len(slots)


def test_running_sums_over_partition_edges(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(1 << 62)) for k in (0, 1, 1 << 40) for i in range({0: 5, 1: 3000}.get(k, 1))]
    frame_ = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, i long, v long")
    got = {(r.k, r.i): (r.pos, r.run_v) for r in prefix_trie.running(frame_, "k", ["i"], ["v"], ["i"], "t").collect()}
    want, total = {}, {}
    for k, i, v in rows:
        total[k] = (total.get(k, 0) + v) % (1 << 62)
        want[k, i] = (i, total[k])
    assert got == want
