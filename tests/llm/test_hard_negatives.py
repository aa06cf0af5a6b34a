"""Hard negatives against brute force on small tables with awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import hard_negatives as H

SHAPE = "vec_id long, label int, embedding array<double>, rank string, positive_id string"  # the last two clash with names of results


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)
    return sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 3 == 0, **more).collect())


def brute(rows, positives=5, negatives=5, scale=256):
    fine = [(i, y, tuple(math.floor(scale * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, y, v in {r for r in fine if r[0] % 3 == 0}:
        scored = sorted((-dot(v, w), j, z) for j, z, w in fine if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fits = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    """Close groups, ties, copies, nulls of every kind, repeated ids, two lengths and empty vectors."""
    rng, rows = random.Random(4), []
    centres = [[rng.gauss(0, 1) for _ in range(11)] for _ in range(5)]
    for i in range(150):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(3), [x + rng.gauss(0, 0.2) for x in c]))
    rows += [(200 + i, i % 2, rows[i % 4][2]) for i in range(20)]
    rows += [(300 + i, i % 2, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(40)] + [(400 + i, i % 2, []) for i in range(6)]
    rows += [(3, 1, rows[7][2]), (3, 1, rows[7][2]), (6, 0, [1.0] * 11), (6, 2, [-1.0] * 11), (501, None, [1.0] * 11), (None, 1, [1.0] * 11), (504, 1, None), (507, 1, [1.0] * 10 + [None]), (510, 1, [math.nan] * 11), (513, 1, [math.inf] * 11)]
    rows += [(600, 0, [0.0] * 11), (601, 0, [0.0] * 11), (603, 2, [7.0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("step", [(4096, 64), (7, 3)])
def test_same_as_brute_force(spark, vectors, step, monkeypatch):
    monkeypatch.setattr(H, "ROWS", step[0])
    monkeypatch.setattr(H, "ANCHORS", step[1])
    assert mined(spark, vectors) == brute(vectors)
    assert mined(spark, vectors, positives=2, negatives=3) == brute(vectors, 2, 3)


def test_blocks_of_anchors(spark, vectors, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_BYTES", 20_000)
    assert mined(spark, vectors) == brute(vectors)


def test_bounds_hold_and_draw_closer():
    """Every level's bounds hold the exact score, halving never loosens them, and rows of a summary decide without their components."""
    rng = np.random.default_rng(5)
    for dim in (1, 2, 5, 16, 33, 64):
        rows, asked = (np.round(rng.normal(0, 80, (n, dim)) + 60 * rng.normal(0, 1, (n, 1))).astype(np.int64) for n in (50, 9))
        block, anchors = (H.Block(np.arange(len(x)), np.zeros(len(x)), x, *H.summaries(x.astype(float))) for x in (rows, asked))
        f, exact, was = H.Filter(block, anchors), rows @ asked.T, None
        row, col = np.nonzero(np.ones_like(exact))
        for level in range(len(f.levels)):
            low, high = f.dense(level)
            pairs = f.of_pairs(level, row, col)
            assert np.all(low <= exact) and np.all(exact <= high)
            assert np.allclose(low.ravel(), pairs[0]) and np.allclose(high.ravel(), pairs[1])
            assert was is None or np.all(high - low <= was * (1 + 1e-5))
            was = high - low
        assert np.array_equal(f.exact(row, col), exact.ravel())


def test_filter_leaves_few_rows(monkeypatch):
    """On smooth vectors, whose segments are nearly even, hardly any row needs its exact score."""
    rng, seen = np.random.default_rng(6), []
    rows = (100 * np.repeat(rng.normal(0, 1, (2000, 8)), 8, axis=1) + rng.integers(-3, 4, (2000, 64))).astype(np.int64)
    block = H.Block(np.arange(2000), np.zeros(2000), rows, *H.summaries(rows.astype(float)))
    exact = H.Filter.exact
    monkeypatch.setattr(H.Filter, "exact", lambda self, row, col: seen.append(len(row)) or exact(self, row, col))
    best = H.Best(10, 5)
    H._positives(block, block.take(np.arange(10)), np.arange(10), best)
    which, ids, score = best.rows()
    want = rows @ rows[:10].T
    for a in range(10):
        order = [j for j in np.lexsort((np.arange(2000), -want[:, a])) if j != a][:5]
        assert ids[which == a].tolist() == order and score[which == a].tolist() == want[order, a].tolist()
    assert sum(seen) < 0.02 * 20_000


def test_large_components(spark):
    """Scores beyond double precision are exact; beyond 64 bits they are an error."""
    rows = [(i, i % 2, [float(2**21 + i), float(i * i), -3.0]) for i in range(12)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [2.0**40]), (1, 1, [2.0**41])])


def test_empty_table_and_single_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
