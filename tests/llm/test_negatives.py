"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from corpusloom.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, norm string, block string, ints double"


def all_pairs(rows, every=100):
    taken = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (str(label), [math.floor(256 * float(np.float32(x))) for x in vector])
        taken[vec_id] = min(taken.get(vec_id, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for anchor, (label, vector) in taken.items():
        if anchor % every:
            continue
        scored = sorted((-dot(vector, v), i, other) for i, (other, v) in taken.items() if i != anchor)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(n, i) for n, i, other in scored if other != label and 80 * -score <= 100 * -n <= 100 * -score][:5]
            out += [(anchor, positive, k + 1, i, -score, -n) for k, (n, i) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, every=100):
    table = spark.createDataFrame([(*r, "x", "y", 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(table, every=every).collect())


def clusters(n, dims, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, dims))
    vectors = centres[random.integers(0, 12, n)] + random.normal(scale=0.15, size=(n, dims))
    vectors *= random.choice([0.2, 1, 4], n)[:, None]
    return [(i, [float(x) for x in v], int(label)) for i, (v, label) in enumerate(zip(vectors, random.integers(0, 3, n)))]


@pytest.mark.parametrize("block,group", [(8192, 4096), (37, 5)])
def test_against_all_pairs(spark, monkeypatch, block, group):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rows = clusters(400, 6, 1)
    got = mined(spark, rows, 10)
    assert got == all_pairs(rows, 10) and len(got) > 100


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (200, [1.0, 0.0], 1), (300, [0.0, 0.0], 2), (400, [-1.0, 0.0], 2)]
    rows += [(100, [1.0, 0.0], 1), (100, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, None, 1), (2, [1.0, 0.0], None), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [None, 1.0], 2)]
    rows += [(k, [0.9, 0.01 * (k % 3)], 2) for k in range(10, 30)] + [(k, [1.0, 0.0], 2) for k in range(30, 40)] + [(50, [], 2), (51, [1.0], 1), (52, [0.0, 0.0], 1)]
    assert mined(spark, rows) == all_pairs(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(7, [1.0], 1)]) == []


def test_equal_vectors_and_far_larger_numbers(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rows = [(k, [3e5, -2e5, 1e5 + (k % 2)], k % 3) for k in range(0, 600, 3)] + [(k, [3e5, -2e5, 1e5], k % 2) for k in range(1, 600, 3)]
    assert mined(spark, rows) == all_pairs(rows)
    with pytest.raises(ValueError, match="60 bits"):
        mined(spark, [(100, [3e30], 1)])


def test_windows_leave_most_rows_out():
    rows = clusters(2000, 6, 2)
    ints = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    norms = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    angles = hard_negatives._angles(ints, norms, hard_negatives.directions_of(ints)).astype("<f4").astype(float)

    def part(which):
        found = hard_negatives._Rows.__new__(hard_negatives._Rows)
        order = which[np.lexsort((angles[which].min(axis=1), angles[which].argmin(axis=1)))]
        found.norms, found.angles, found.cells, found.ints = norms[order], angles[order], angles[order].argmin(axis=1), ints[order]
        return found

    block, anchors = part(np.arange(2000)), part(np.arange(0, 2000, 100))
    scores = anchors.ints @ block.ints.T
    high = np.sort(scores, axis=1)[:, -5].astype(float)
    low = 0.8 * high
    seen = np.zeros(scores.shape, bool)
    for k, first, last in hard_negatives._stretches(block, anchors, low, high):
        seen[k, first:last] = True
    wanted = (scores >= low[:, None]) & (scores <= high[:, None])
    assert not (wanted & ~seen).any() and seen.mean() < 0.5


