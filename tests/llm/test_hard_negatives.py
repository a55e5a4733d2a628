"""Hard negatives by angular filtering against direct integer scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from meridian.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def brute(rows, every=100):
    ok = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for a, va, ya in {(i, tuple(v), y) for i, v, y in ok if i % every == 0}:
        scored = [(-sum(p * q for p, q in zip(va, v, strict=True)), i, y) for i, v, y in ok if len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == ya and x[1] != a)[:5]:
            fits = sorted(x for x in scored if x[2] != ya and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, "other") for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clustered(seed, n, dims=6, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    return [(k, (scale * (centre[k % 12] + 0.3 * rng.normal(size=dims))).tolist(), int(rng.integers(0, 4))) for k in range(n)]


def test_against_direct_scores(spark):
    rows = clustered(1, 1500)
    assert mined(spark, rows, every=50, shard_rows=200) == brute(rows, 50)


def test_edges(spark):
    rows = clustered(2, 320)
    rows += [(400, None, 1), (401, [1.0] * 6, None), (402, [None, *[1.0] * 5], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(500, [0.0] * 6, 1), (501, [1.0, 2.0], 1), (600, [1.0, 1.0], 1), (602, [0.5, 0.5], 2), (700, [], 1), (701, [], 2), (702, [], 2)]
    rows += rows[10:20]  # repeated rows count each as partners
    rows += [(100, rows[100][1], rows[100][2])]  # an anchor repeated as a whole is one
    rows += [(200, [0.3, -0.1, 0.2, 0.9, -0.4, 0.1], 3)]  # another text under the id of an anchor
    rows += [(1000 + k, rows[7][1], 2) for k in range(150)]  # a very common vector
    assert mined(spark, rows, every=100, shard_rows=64) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(3, [1.0], 1)]) == []


def test_beyond_double_precision(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.randint(-(2**20), 2**20)) for _ in range(3)], k % 3) for k in range(40)]
    assert mined(spark, rows, every=20) == brute(rows, 20)
    tiny = [(k, [rng.random() * 1e-3 for _ in range(3)], k % 3) for k in range(40)]
    assert mined(spark, tiny, every=20) == brute(tiny, 20)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_filter(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(700, 5)) * rng.choice([1, 40, 4000], size=(700, 1)))
    x[:20] = 0
    x[20:60] = x[60] * np.arange(-20, 20)[:, None]
    refs = hn.references(5, x[:300])
    assert np.allclose(np.linalg.norm(refs, axis=1), 1)
    length, angle = hn.angles(x, refs)
    ids = np.arange(700)
    shard = hn.Shard(ids, ids % 3, x, length, angle)
    score = x[:50] @ shard.x.T
    low, high = shard._bounds(slice(0, 700), length[:50], angle[:50])
    slack = 1 + 1e-9 * length.max() ** 2
    assert (low - slack <= score).all() and (score <= high + slack).all()
    low, high = shard._group_bounds(length[:50], angle[:50])
    for g, first in enumerate(shard.first):
        part = score[:, first : first + hn.GROUP]
        assert (low[:, g, None] - slack <= part).all() and (part <= high[:, g, None] + slack).all()


def test_only_overlapping_pairs_are_scored():
    """Vectors in narrow cones: windows of high scores leave out most pairs before any is scored."""
    rng = np.random.default_rng(9)
    centre = np.eye(8) * 300
    x = np.floor(centre[np.arange(4000) % 8] + rng.normal(size=(4000, 8)) * 8)
    length, angle = hn.angles(x, hn.references(8, x[:500]))
    shard = hn.Shard(np.arange(4000), np.zeros(4000, dtype=int), x, length, angle)
    n = 100
    shard.search(np.arange(n), np.zeros(n, dtype=int), x[:n], length[:n], angle[:n], np.full((n, 1), hn.LONG_MIN), np.full((n, 1), hn.LONG_MAX), 5, True)
    assert shard.scored < 0.25 * n * 4000
