"""Sub-word tokeniser: brute-force segmentation, piece tables, one tokeniser everywhere."""

import itertools
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from ctrltok.functions import subword as SW
from ctrltok.operators import audit as AU
from ctrltok.operators import corpus as C
from ctrltok.operators import features as FE
from ctrltok.operators import ranks as R
from ctrltok.sources import pieces as PI

SCORES = {"▁": -9.0, "▁a": -3.0, "a": -4.0, "b": -4.5, "ab": -5.0, "▁ab": -8.0, "ba": -6.0, "bab": -8.5, "c": -7.0, "abc": -9.0, "é": -7.0}


def brute(word, scores, unknown):
    """The best segmentation by trying every cut."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        if all(p in scores or (len(p) == 1) for p in parts):
            total = 0.0
            for p in parts:
                total += scores.get(p, unknown)
            # ties: the longer last piece, then the longer one before it
            key = (round(total, 9), [len(p) for p in reversed(parts)])
            if best is None or key > best[0]:
                best = (key, parts)
    merged = []
    for p in best[1]:
        if merged and p not in scores and merged[-1][1]:
            merged[-1][0] += p
        else:
            merged.append([p, p not in scores])
    return tuple(m[0] for m in merged)


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for scores in (SCORES, {k: -float(len(k)) for k in SCORES}):
        seg = SW.Segmenter(scores)
        for _ in range(400):
            word = "▁" + "".join(rng.choice("aabbcéxy") for _ in range(rng.randint(0, 9)))
            assert seg.segment(word) == brute(word, scores, seg.unknown), word


def test_texts_and_decoding():
    seg = SW.Segmenter(SCORES)
    assert seg.pieces(None) is None and seg.pieces("") == [] and seg.pieces("  \t") == []
    assert seg.pieces("  ab  ba\n") == seg.pieces("ab ba")
    assert seg.decode(seg.pieces("ab cab")) == "ab cab"
    assert seg.decode(seg.pieces("axxyb")) == "a ⁇ b"                # unknown neighbours form one piece
    assert SW.Segmenter(SCORES, normalization="NFC").pieces("é") == SW.Segmenter(SCORES).pieces("é")
    long = "ab" * 50_000
    assert "".join(seg.pieces(long)) == "▁" + long
    with pytest.raises(ValueError):
        SW.Segmenter({})


def model_bytes(pieces):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(piece, score, kind):
        raw = piece.encode()
        return b"\x0a" + varint(len(raw)) + raw + b"\x15" + struct.pack("<f", score) + (b"\x18" + varint(kind) if kind != 1 else b"")

    body = b"".join(b"\x0a" + varint(len(m)) + m for m in (message(*p) for p in pieces))
    return body + b"\x12\x03\x0a\x01x"                               # another field is skipped


def test_piece_files(spark, tmpdir_path):
    model = os.path.join(tmpdir_path, "own.model")
    with open(model, "wb") as f:
        f.write(model_bytes([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁the" * 60, -2.0, 1), ("▁he", -1.5, 1), ("user", -3.0, 4), ("x", -4.0, 5), ("a b", -1.0, 1)]))
    got = {r.piece: r.score for r in PI.read_pieces(spark, model).collect()}
    assert got == {"▁he": -1.5, "user": -3.0}                        # marks inside, control, unused and white space are left out
    plain = os.path.join(tmpdir_path, "own.vocab")
    with open(plain, "w") as f:
        f.write("▁the\t-2.5\nth\t-3\n▁the\t-1.25\nbad line\n")
    assert {r.piece: r.score for r in PI.read_pieces(spark, plain).collect()} == {"▁the": -1.25, "th": -3.0}
    import base64
    ranks = os.path.join(tmpdir_path, "own.tiktoken")
    with open(ranks, "w") as f:
        for i, t in enumerate([b" the", b"\xff", b"th", b"a b", "é".encode()]):
            f.write(f"{base64.b64encode(t).decode()} {i}\n")
    got = {r.piece: r.score for r in PI.read_pieces(spark, ranks).collect()}
    assert set(got) == {"▁the", "th", "é"} and got["▁the"] == -693.0
    assert PI.load_segmenter(spark, ranks).unknown == min(got.values()) - PI.RANK_PENALTY
    with pytest.raises(ValueError):
        PI.segmenter(spark.range(PI.MOST_PIECES + 1).select(F.col("id").cast("string").alias("piece"), F.lit(0.0).alias("score")))


def test_one_tokeniser_for_corpus_ranks_and_vocabulary(spark):
    seg = SW.Segmenter(SCORES)
    tok = SW.tokenizer(seg)
    pairs = spark.createDataFrame([(1, "en", "ab abc", "ab"), (2, "en", "ab c", "éx"), (3, "en", None, "")], "pair_id long, lang string, source string, target string")
    ranks = R.ranks_from_corpus(pairs.select("lang", F.col("source").alias("text")), tokenizer=tok)
    want = {}
    for t in ("ab abc", "ab c"):
        for p in seg.pieces(t):
            want[p] = want.get(p, 0) + 1
    assert {r.word: r.cnt for r in ranks.collect()} == want
    vocabulary = {(r.side, r.token): r.cnt for r in R.vocabulary(pairs, tokenizer=tok).collect()}
    assert {k[1]: n for k, n in vocabulary.items() if k[0] == "src"} == want
    lines = {r.pair_id: r for r in C.control_corpus(FE.prepare_pairs(pairs, tok), ["frequency", "length"], ranks=ranks, tokenizer=tok).collect()}
    assert lines[1].source_line.endswith("> " + " ".join(seg.pieces("ab abc"))) and lines[2].target_line == " ".join(seg.pieces("éx"))
    assert lines[1].exact_frequency == pytest.approx(1.0, abs=0.7)


def test_roundtrip_with_a_piece_table(spark):
    seg = SW.Segmenter(SCORES)
    rows = [(0, "ab ba", "<Length_1.0> " + " ".join(seg.pieces("ab ba"))), (1, "ab  ba", " ".join(seg.pieces("ab ba"))),
            (2, "axb", " ".join(seg.pieces("axb"))), (3, "ab", "▁a c")]
    df = spark.createDataFrame(rows, "line_no int, original string, processed string")
    checked = {r.line_no: (r.same_raw, r.same_cleaned) for r in AU.roundtrip(df, "original", "processed", True, segmenter=seg).collect()}
    assert checked == {0: (True, True), 1: (False, True), 2: (False, True), 3: (False, False)}
    joined = {r.line_no: (r.same_raw, r.same_cleaned) for r in AU.roundtrip(df, "original", "processed", True, pieces=True, segmenter=seg).collect()}
    assert joined[2] == (True, False)                                # the stored pieces keep what the table cannot decode


def test_batches_are_cut_into_bounded_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from ctrltok.udfs import bounded_ranges

    assert list(bounded_ranges(np.array([3, 3, 9, 0, 4]), 6)) == [(0, 2), (2, 3), (3, 5)] and list(bounded_ranges(np.array([], int), 6)) == []
    monkeypatch.setattr(SW, "SLICE_BYTES", 8)
    monkeypatch.setattr(SW, "SLICE_PIECES", 3)
    seg = SW.Segmenter(SCORES)
    texts = ["ab ba", None, "", "abc ab cab axxyb", "é"] * 3
    lists = SW._piece_lists(seg, pa.array(texts).slice(2))
    assert lists.to_pylist() == [seg.pieces(t) for t in texts[2:]]
    assert SW._decoded(seg, lists).to_pylist() == [seg.decode(seg.pieces(t)) for t in texts[2:]]
    assert SW._piece_lists(seg, pa.array([], pa.string())).to_pylist() == []


def test_a_worker_holds_each_piece_once_and_no_long_words():
    seg = SW.Segmenter(SCORES)
    long = "▁" + "ab" * 500
    assert seg.word(long) == seg.segment(long) and long not in seg.cache
    first, second = seg.word("▁abab"), seg.word("▁babab")
    assert "▁abab" in seg.cache
    own = {p: p for p in seg.scores}
    assert all(p is seg.own[p] for p in first + second if p in own)
