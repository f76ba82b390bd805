"""Periodic runs against a plain search."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import EMPTY, ROWS, frame, plain

from corpusloom.llm import periodic_runs, support
from corpusloom.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    found = {}
    for period in range(1, len(words) // 4 + 1):
        i = 0
        while i + period < len(words):
            if words[i] == words[i + period]:
                start = i
                while i + period < len(words) and words[i] == words[i + period]:
                    i += 1
                if i + period - start >= max(6, 4 * period):
                    found.setdefault((start, i + period - start), period)
            i += 1
    return sorted((start, length, period) for (start, length), period in found.items())


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapse(words, runs):
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def digest(doc_id, text):
    words = plant(doc_id, (text or "").encode().split())
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=5))
def test_runs_of_small_texts(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    got = periodic_runs.runs_of(np.array([w for t in texts for w in t], np.int64), sizes)
    for k, text in enumerate(texts):
        mine = got[got["text"] == k]
        assert list(zip(mine["start"], mine["length"], mine["period"])) == sorted(plain_runs(text), key=lambda r: (r[0], r[2]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=60), st.data())
def test_grammar_tells_how_far_places_agree(word, data):
    symbols = np.array([9, *word, 8])
    symbols = np.unique(symbols, return_inverse=True)[1]
    rounds = periodic_runs.grammar(symbols)
    a, b = sorted(data.draw(st.lists(st.integers(1, len(word)), min_size=2, max_size=2, unique=True)))
    ahead = next(k for k in range(len(symbols)) if symbols[a + k] != symbols[b + k])
    behind = next(k for k in range(len(symbols)) if symbols[a - 1 - k] != symbols[b - 1 - k])
    assert periodic_runs.agreement(rounds, np.array([a]), np.array([b])).tolist() == [ahead]
    assert periodic_runs.agreement(rounds, np.array([a]), np.array([b]), back=True).tolist() == [behind]


@pytest.mark.parametrize("size", [60, 4_000_000])
def test_awkward_rows(spark, monkeypatch, size):
    monkeypatch.setattr(periodic_runs, "GRAMMAR_BYTES", size)
    got = periodic_runs.digests(periodic_runs.find_runs(frame(spark), plant=True)).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted((digest(r[0], r[1]) for r in ROWS), key=order)
    assert periodic_runs.find_runs(frame(spark, EMPTY)).count() == 0


def test_periods_of_many_kinds(spark):
    unit = " ".join(f"w{i}" for i in range(40))
    texts = [("a " * 5), ("a " * 6), ("a b c " * 4), ("a b c " * 3 + "a b"), f"{unit} " * 4, f"x {unit} " * 7 + "tail", "a b a b a b a b " + "c " * 9 + "a b a b a b a b"]
    rows = [(k, text, "en", "a", 1) for k, text in enumerate(texts)]
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(plain(spark, rows)).collect()}
    for k, text in enumerate(texts):
        runs = plain_runs(text.split())
        assert [tuple(r) for r in got[k]["runs"]] == sorted(runs, key=lambda r: (r[0], r[2]))
        assert got[k]["collapsed"] == collapse(text.encode().split(), runs).decode()


def test_a_long_text_of_few_words():
    words = np.zeros(400_000, np.int64)
    words[100_000::5] = 1
    got = periodic_runs.runs_of(words, np.array([len(words)]))
    assert got[["start", "length", "period"]].to_numpy().tolist() == [[0, 100_000, 1], [99_996, 300_004, 5]]


def test_query_against_a_plain_search(spark):
    docs = support.table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, SF).collect())
    assert got == sorted(digest(*r) for r in docs)
    assert sum(r[1] for r in got) > 0
