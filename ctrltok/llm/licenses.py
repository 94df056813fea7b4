"""Licence scan by template-markup matching.

Words are the maximal runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased.  Every
template (:mod:`license_texts`) is compiled into a token automaton: mandatory words are transitions on that word, an
optional region may be passed without reading, a replaceable region reads any of the allowed number of words.
The automata of all templates share their start and are made deterministic as texts need it.  A place of a text is
tried where its first two words can begin a template (one table look-up per place); a template is accepted
where every mandatory word stands exactly as written.  A place is followed for at most the longest
template's words, so the work is linear in the text.

Beside the templates, fixed phrases give base labels wherever their words stand consecutively.

``score``: 1 where a template is accepted, else the largest share of a template's mandatory words that some place
of the text matches from the first word on, at least 0.5 if there is a base phrase.  Spans are
``struct(label, start, stop)`` in words, ``stop`` exclusive, the longest of each label and start.

Defined results: null text is empty; a text without words has score 0 and no labels; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ctrltok.llm.common import slices, texts, utf8
from ctrltok.llm.license_texts import PHRASES, TEMPLATES
from ctrltok.udfs import by_value

by_value(__name__)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
MARK = re.compile(r"<<\s*(beginOptional|endOptional|var\s*;\s*words\s*=\s*(\d+)\s*-\s*(\d+))\s*>>")
STEPS_KEPT = 1 << 18
SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def split_words(rows: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of the rows, and the number of the first word of every row (one more entry: all words)."""
    raw = LOWER[np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)]
    word = IS_WORD[raw]
    begins = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    ends = np.flatnonzero(~word & np.r_[False, word[:-1]])
    offsets = np.r_[0, np.cumsum(ends - begins)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word].tobytes())])
    limits = np.cumsum([0] + [len(r) + 1 for r in rows])
    return words, np.searchsorted(begins, limits).astype(np.int64)


def words_of(text: str) -> list[bytes]:
    return split_words([text.encode()])[0].to_pylist()


def parse(template: str) -> list:
    """Nested items of a template: ``bytes`` (a word), ``(least, most)`` (any words), ``list`` (optional items)."""
    stack, at = [[]], 0
    for m in MARK.finditer(template):
        stack[-1] += words_of(template[at:m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            least, most = int(m[2]), int(m[3])
            if least > most:
                raise ValueError(f"no number of words is in {least}-{most}")
            stack[-1].append((least, most))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + words_of(template[at:])


class Automata:
    """The automata of all templates with a common start, determinised on demand.

    A state of the deterministic automaton is the sorted tuple of the states that the templates' automata may be in;
    0 is the dead state, 1 the start.  Words are numbers in ``lexicon``; any other word is ``len(lexicon)``."""

    def __init__(self, templates: list[tuple[str, str]]):
        parsed = [(label, parse(text)) for label, text in templates]
        self.lexicon = sorted({w for _, items in parsed for w in flat_words(items)} | {w.encode() for p, _ in PHRASES for w in p.split()})
        self.number = {w: i for i, w in enumerate(self.lexicon)}
        self.on_word: list[tuple[int, int] | None] = []      # (word, next state); word -1: any
        self.skip: list[list[int]] = []                      # states reached without reading
        self.passed: list[int] = []                          # mandatory words before the state
        self.owner: list[int] = []
        self.final: dict[int, str] = {}
        self.mandatory: list[int] = []
        self.starts: list[int] = []
        for k, (label, items) in enumerate(parsed):
            total = sum(1 for x in items if isinstance(x, bytes))
            if not total or not isinstance(items[0], bytes):
                raise ValueError(f"template {label} must begin with a mandatory word")
            self.starts.append(self.state(k, 0))
            end = self.chain(items, self.starts[-1], k, True)
            self.final[end] = label
            self.mandatory.append(total)
        self.clear()

    def clear(self) -> None:
        """Forget all states of the deterministic automaton but the start."""
        self.sets: list[tuple[int, ...]] = [()]
        self.ids: dict[tuple[int, ...], int] = {(): 0}
        self.steps: dict[tuple[int, int], int] = {}
        self.labels: list[tuple[str, ...]] = [()]
        self.share: list[float] = [0.0]
        self.start = self.intern(self.closure(self.starts))

    def state(self, owner: int, passed: int) -> int:
        self.on_word.append(None)
        self.skip.append([])
        self.passed.append(passed)
        self.owner.append(owner)
        return len(self.on_word) - 1

    def chain(self, items: list, at: int, owner: int, mandatory: bool) -> int:
        """States that read ``items`` from state ``at`` on; returns the last one."""
        for x in items:
            done = self.passed[at]
            if isinstance(x, bytes):
                to = self.state(owner, done + mandatory)
                self.on_word[at] = (self.number[x], to)
                at = to
            elif isinstance(x, list):
                inner = self.state(owner, done)
                self.skip[at].append(inner)
                end = self.chain(x, inner, owner, False)
                to = self.state(owner, done)
                self.skip[at].append(to)
                self.skip[end].append(to)
                at = to
            else:
                least, most = x
                out = self.state(owner, done)
                for n in range(most):
                    if n >= least:
                        self.skip[at].append(out)
                    to = self.state(owner, done)
                    self.on_word[at] = (-1, to)
                    at = to
                self.skip[at].append(out)
                at = out
        return at

    def closure(self, states) -> tuple[int, ...]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.skip[s]
        return tuple(sorted(seen))

    def intern(self, states: tuple[int, ...]) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.labels.append(tuple(sorted({self.final[s] for s in states if s in self.final})))
            self.share.append(max((self.passed[s] / self.mandatory[self.owner[s]] for s in states), default=0.0))
        return self.ids[states]

    def step(self, state: int, word: int) -> int:
        to = self.steps.get((state, word))
        if to is None:
            moves = (self.on_word[s] for s in self.sets[state])
            to = self.steps[state, word] = self.intern(self.closure([m[1] for m in moves if m and m[0] in (word, -1)]))
        return to

    def begins(self) -> np.ndarray:
        """Which pairs of word numbers can begin a template."""
        n = len(self.lexicon) + 1
        out = np.zeros((n, n), bool)
        for a in {m[0] for s in self.sets[self.start] if (m := self.on_word[s])}:
            after = self.step(self.start, a)
            out[a] = [self.step(after, b) > 0 or bool(self.labels[after]) for b in range(n)]
        return out


def flat_words(items: list):
    for x in items:
        if isinstance(x, bytes):
            yield x
        elif isinstance(x, list):
            yield from flat_words(x)


class Scanner:
    """Base phrases and accepted templates of slices of texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        self.automata = Automata(templates)
        self.pairs = self.automata.begins()
        self.phrases = [([self.automata.number[w.encode()] for w in p.split()], label) for p, label in phrases]
        self.lexicon = pa.array(self.automata.lexicon, pa.binary())

    def follow(self, ids: list[int], at: int, stop: int) -> tuple[dict[str, int], float]:
        """Accepted labels with their last end from word ``at`` on, and the largest share of a template's words."""
        a = self.automata
        if len(a.steps) > STEPS_KEPT:
            a.clear()
        state, ends, share = a.start, {}, 0.0
        while at < stop and (state := a.step(state, ids[at])):
            at += 1
            share = max(share, a.share[state])
            for label in a.labels[state]:
                ends[label] = at
        return ends, share

    def scan(self, rows: list[bytes]) -> list[tuple]:
        """``(words, base starts and labels, spans, score)`` of every row."""
        words, first = split_words(rows)
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, self.lexicon).fill_null(len(self.lexicon)).to_numpy(zero_copy_only=False)
        ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        n = len(ids)
        base: dict[int, list] = {}
        spans: dict[int, list] = {}
        shares: dict[int, float] = {}

        def row_of(places: np.ndarray) -> np.ndarray:
            return np.searchsorted(first, places, side="right") - 1

        for phrase, label in self.phrases:
            hit = np.ones(max(0, n - len(phrase) + 1), bool)
            for k, w in enumerate(phrase):
                hit &= ids[k:k + len(hit)] == w
            places = np.flatnonzero(hit)
            for place, row in zip(places.tolist(), row_of(places).tolist(), strict=True):
                if place + len(phrase) <= first[row + 1]:
                    base.setdefault(row, []).append((place - int(first[row]), label))
        after = np.r_[ids[1:], len(self.lexicon)][:n]
        after[first[1:][first[1:] > first[:-1]] - 1] = len(self.lexicon)     # no word follows a row's last one
        places = np.flatnonzero(self.pairs[ids, after])
        rows_of = row_of(places).tolist()
        listed = None
        for place, row in zip(places.tolist(), rows_of, strict=True):
            if listed is None:
                listed = ids.tolist()
            ends, share = self.follow(listed, place, int(first[row + 1]))
            shares[row] = max(shares.get(row, 0.0), share)
            for label, end in sorted(ends.items()):
                spans.setdefault(row, []).append((label, place - int(first[row]), end - int(first[row])))
        out = []
        for r in range(len(rows)):
            score = 1.0 if r in spans else max(shares.get(r, 0.0), 0.5 if r in base else 0.0)
            out.append((int(first[r + 1] - first[r]), sorted(base.get(r, [])), spans.get(r, []), score))
        return out


def scans(docs: DataFrame, finish, schema: str, templates: list | None, phrases: list | None) -> DataFrame:
    """``finish(doc ids, results)`` of every slice of rows."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in batches:
            rows = utf8(b.column(1))
            for lo, hi in slices([len(r) for r in rows]):
                yield finish(b.column(0).slice(lo, hi - lo), scanner.scan(rows[lo:hi]))

    return texts(docs).mapInArrow(run, schema)


def license_spans(docs: DataFrame, templates: list | None = None, phrases: list | None = None) -> DataFrame:
    """``doc_id, n_words, base, spans, score`` of every row: base places and accepted templates by start."""
    def finish(ids, found):
        base = pa.array([[{"label": lab, "start": s} for s, lab in f[1]] for f in found],
                        pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])))
        spans = pa.array([[{"label": lab, "start": s, "stop": e} for lab, s, e in f[2]] for f in found], pa.list_(SPAN))
        return pa.RecordBatch.from_arrays([ids, pa.array([f[0] for f in found], pa.int64()), base, spans,
                                           pa.array([f[3] for f in found], pa.float64())],
                                          names=["doc_id", "n_words", "base", "spans", "score"])

    return scans(docs, finish, "doc_id long, n_words long, base array<struct<label:string,start:long>>, "
                               "spans array<struct<label:string,start:long,stop:long>>, score double", templates, phrases)


def digests(docs: DataFrame, templates: list | None = None, phrases: list | None = None) -> DataFrame:
    """Counts, places, labels and score of every row."""
    def finish(ids, found):
        base = [sorted({lab for _, lab in f[1]}) for f in found]
        every = [sorted({lab for _, lab in f[1]} | {lab for lab, _, _ in f[2]}) for f in found]
        columns = [[f[0] for f in found], [len(f[1]) for f in found],
                   [f[1][0][0] if f[1] else None for f in found], [f[1][-1][0] if f[1] else None for f in found]]
        return pa.RecordBatch.from_arrays(
            [ids, *[pa.array(c, pa.int64()) for c in columns], pa.array([",".join(x) for x in base]),
             pa.array([",".join(x) for x in every]), pa.array([f[3] for f in found], pa.float64())],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scans(docs, finish, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                               "labels string, score double", templates, phrases)
