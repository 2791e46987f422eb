"""Centroid clustering against plain k-means in whole numbers, and the bounds' bookkeeping."""

import hashlib
import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id bigint, embedding array<float>, label int, own int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], SCHEMA)


def plain(rows, k=40, rounds=5, dims=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, hash) by measuring every pair."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(float(x)) * 256 < 2**26 for x in e)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in ranked[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        got = near()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, got) if m == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    got = near()
    sums = {}
    for d, n in got:
        sums[n] = sums.get(n, 0) + d
    total = sum(sums.values())
    written = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sums[n], total, written[n]) for (i, _), (d, n) in zip(kept, got)), key=str)


def rows(n=150, dims=64, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(8)]
    made = [(k, [x + rng.gauss(0, 0.08) for x in rng.choice(centres)]) for k in range(n)]
    made += [(n + k, made[0][1]) for k in range(60)]  # a common vector
    made += [(5, made[5][1]), (5, made[6][1]), (None, made[7][1]), (None, made[8][1])]
    odd = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [float("inf")] + [0.1] * 63, [1e30] + [0.0] * 63]
    made += [(1000 + k, e) for k, e in enumerate(odd)]
    made += [(2000, [2.0**17] + [0.0] * 63), (2001, [-0.001] * 64), (2002, [0.0] * 64)]
    return made


@pytest.mark.parametrize("k, rounds", [(40, 5), (3, 4), (1, 2), (500, 2), (40, 0)])
def test_equals_plain_clustering(spark, k, rounds):
    from maskflow.llm.centroids import CentroidRule, report

    got = sorted((tuple(r) for r in report(table(spark, rows()), CentroidRule(k=k, rounds=rounds)).collect()), key=str)
    assert got == plain(rows(), k, rounds)


def test_no_rows(spark):
    from maskflow.llm.centroids import report

    assert report(table(spark, [])).collect() == []
    assert report(table(spark, [(1, None)])).collect() == []


def test_bounds_hold_and_save_work():
    """Bounds stay on the right side of every distance, ties go to the smaller number, and later rounds measure few pairs."""
    from maskflow.llm.centroids import moved, reassigned, scanned, squared

    rng = np.random.default_rng(1)
    centres = rng.integers(-100, 100, (20, 16))
    v = centres[rng.integers(0, 20, 3000)] + rng.integers(-30, 30, (3000, 16))
    c = v[:20].copy()
    b = scanned(v, c, 5)
    rescans = []
    for n in (5, 5, 4, 3, 3, 3, 3, 3):
        d = squared(v, c)
        assert (b.own == d.argmin(1)).all()
        new = c.copy()
        for k in range(20):
            if (b.own == k).any():
                new[k] = v[b.own == k].sum(0) // (b.own == k).sum()
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + 1e-6)
        c = new
        b = reassigned(v, c, moved(b, drift, n))
        exact = np.sqrt(squared(v, c).astype(float))
        index = np.arange(len(v))
        assert (exact[index, b.own] <= b.upper).all()
        for j in range(n):
            assert (exact[index, b.near[:, j]] >= b.lower[:, j]).all()
        others = exact.copy()
        others[index, b.own] = np.inf
        for j in range(n):
            others[index, b.near[:, j]] = np.inf
        assert (others.min(1) >= b.rest).all()
        rescans.append(int((b.again != 0).sum()))
    assert (b.own == squared(v, c).argmin(1)).all()
    assert rescans[-1] < 600


def test_equal_distances_go_to_the_smaller_number():
    from maskflow.llm.centroids import moved, reassigned, scanned

    v = np.array([[0, 0], [10, 0]])
    c = np.array([[1, 0], [-5, 0], [9, 0]])
    b = scanned(v, c, 1)
    c2 = np.array([[3, 0], [-3, 0], [11, 0]])
    b = reassigned(v, c2, moved(b, np.array([2.0, 2.0, 2.0]) * (1 + 1e-6), 1))
    assert b.own.tolist() == [0, 2]
    c3 = np.array([[-3, 0], [3, 0], [11, 0]])
    b = reassigned(v, c3, moved(b, np.array([6.0, 6.0, 0.0]) * (1 + 1e-6), 1))
    assert b.own.tolist() == [0, 2]
