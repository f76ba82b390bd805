"""Repeated passages against a plain comparison of all windows."""

import hashlib

import numpy as np
import pytest
from llm_frames import EMPTY, LONG, ROWS, frame, plain

from corpusloom.llm import repeats

LAST = 2**63 - 1


def expected(rows):
    owner = {}
    texts = [(LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for doc, words in texts:
        for i in range(len(words) - 12):
            window = tuple(words[i : i + 13])
            owner[window] = min(owner.get(window, doc), doc)
    out = []
    for row, (doc, words) in zip(rows, texts):
        gone = {k for i in range(len(words) - 12) if owner[tuple(words[i : i + 13])] < doc for k in range(i, i + 13)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((row[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in repeats.digests(df).collect()), key=str)


def corpus(seed, n=120):
    """Few words, passages that recur in whole and in part, copies, unary texts, repeated ids."""
    random = np.random.default_rng(seed)
    draw = lambda k, vocabulary: [f"w{x}" for x in random.integers(0, vocabulary, k)]
    passages = [draw(random.integers(10, 60), 50) for _ in range(8)] + [["a"] * 40, ["a", "b"] * 20]
    rows = []
    for k in range(n):
        words = []
        for _ in range(random.integers(0, 5)):
            passage = passages[random.integers(0, len(passages))]
            cut = random.integers(0, len(passage))
            words += [*draw(random.integers(0, 20), 1000), *(passage if random.random() < 0.5 else passage[cut:] if random.random() < 0.5 else passage[:cut])]
        if rows and random.random() < 0.2:
            words = rows[random.integers(0, len(rows))][1].split()
            if words and random.random() < 0.5:
                words[random.integers(0, len(words))] = "changed"
        rows.append((None if random.random() < 0.05 else int(random.integers(0, n)), " ".join(words), "en", "a", 1))
    return rows


@pytest.mark.parametrize("seed,crowd,piece,tree", [(0, 2000, 4_000_000, 40_000), (1, 3, 2000, 10), (2, 1, 300, 1), (3, 12, 1, 30)])
def test_against_all_windows(spark, monkeypatch, seed, crowd, piece, tree):
    for name, value in (("CROWD", crowd), ("PIECE_BYTES", piece), ("TREE_ROWS", tree), ("BUCKET_BYTES", piece * 3)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus(seed)
    got = found(plain(spark, rows).repartition(5))
    assert got == expected(rows)
    assert sum(r[2] for r in got) > 1000


def test_awkward_rows(spark):
    rows = [*ROWS, (8, LONG, "en", "b", 1), (None, LONG + "more", "en", "b", 1), (9, "one " * 12, "en", "b", 1), (10, "one " * 12, "en", "b", 1)]
    assert found(frame(spark, rows)) == expected(rows)
    assert found(frame(spark, EMPTY)) == []


def test_spans_and_the_rest_of_a_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"first {passage} end"), (2, f"other  start {passage}\nown words"), (3, "w " * 3)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[2]["repeats"]] == [(2, 60)] and got[2]["kept"] == "other start own words"
    assert got[1]["repeats"] == [] and got[1]["kept"] == f"first {passage} end" and got[3]["kept"] == "w w w"


def test_ids_that_are_no_numbers_come_last(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    got = repeats.remove_repeats(spark.createDataFrame([("7", passage), ("x", passage + " a"), ("y", passage + " b")], "doc_id string, text string")).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == [("7", passage), ("None", "a"), ("None", "b")]
