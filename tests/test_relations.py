"""Relations of distances against plain loops."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lexitab.operators import relations


def ranks(x: np.ndarray) -> np.ndarray:
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def spearman(x, y) -> float:
    return float(np.corrcoef(ranks(x), ranks(y))[0, 1])


def order(ids, seed) -> list[int]:
    return sorted(ids, key=lambda i: (hashlib.sha256(f"[{seed},{i}]".encode()).hexdigest(), i))


def cosine(m):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    return (1 - unit @ unit.T).round(9)


def variation(m):
    return (np.abs(m[:, None] - m[None]).sum(axis=2) / 2).round(9)


@pytest.fixture(scope="module")
def cases():
    """Groups of 300 points (cut at 150), 40 points, 2 points, and 6 points of which the second distance is constant."""
    rng, rows = np.random.default_rng(6), []
    for group, n in ((1, 300), (2, 40), (3, 2), (4, 6)):
        u = rng.normal(size=(n, 5))
        v = rng.dirichlet([1, 1, 1], n) if group != 4 else np.tile([0.2, 0.3, 0.5], (n, 1))
        if group == 2:
            v = np.exp(2 * u[:, :3]).round(1) + 0.1
            v /= v.sum(axis=1, keepdims=True)
        rows += [(group, 1000 * group + i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(u, v))]
    return rows


def test_relation_and_neighbours(spark, cases):
    df = spark.createDataFrame([*cases, (1, 9, None, [0.1, 0.2, 0.7]), (None, 8, [1.0] * 5, [1.0, 0.0, 0.0])], "g int, id long, u array<double>, v array<double>").repartition(6)
    points, pairs = relations.pairs_of_points(df, "id", "g", {"u": "cosine", "v": "total_variation"}, points=150)
    found = {r["g"]: r for r in relations.distance_relation(points, pairs, "g", "u", "v").collect()}
    near = {r["g"]: r for r in relations.neighbour_agreement(points, pairs, "g", "u", "v").collect()}
    for group in (1, 2):
        own = {i: (np.array(u), np.array(v)) for g, i, u, v in cases if g == group}
        ids = order(own, 42)[:150]
        a, b = cosine(np.array([own[i][0] for i in ids])), variation(np.array([own[i][1] for i in ids]))
        n, upper = len(ids), np.triu_indices(len(ids), 1)
        rho, null = spearman(a[upper], b[upper]), []
        for draw in range(1, 20):
            of = np.argsort([ids.index(i) for i in order(ids, 42 + draw)])
            null.append(spearman(a[upper], b[np.ix_(of, of)][upper]))
        ranges = []
        for part in range(8):
            keep = [i for i in range(n) if i % 8 != part]
            some = np.triu_indices(len(keep), 1)
            ranges.append(spearman(a[np.ix_(keep, keep)][some], b[np.ix_(keep, keep)][some]))
        r = found[group]
        assert (r["points"], r["pairs"], r["status"]) == (n, n * (n - 1) // 2, "measured")
        assert r["rho"] == pytest.approx(rho) and r["null_mean"] == pytest.approx(np.mean(null))
        assert r["p"] == (1 + sum(abs(x) >= abs(rho) - 1e-12 for x in null)) / 20
        assert (r["low"], r["high"]) == (pytest.approx(min(ranges)), pytest.approx(max(ranges)))
        k, shared = min(10, max(1, (n - 1) // 2)), 0.0
        for i in range(n):
            weights = []
            for m in (a, b):
                d = np.delete(m[i], i)
                edge = np.sort(d)[k - 1]
                weights.append((d < edge) + (d == edge) * (k - (d < edge).sum()) / (d == edge).sum())
            shared += (weights[0] * weights[1]).sum()
        assert near[group]["k"] == k and near[group]["overlap"] == pytest.approx(shared / (n * k)) and near[group]["chance"] == pytest.approx(k / (n - 1))
    for group in (3, 4):
        assert found[group]["status"] == "undefined" and found[group]["rho"] is None and found[group]["p"] is None
    assert found[2]["p"] == 0.05 and found[1]["p"] > 0.05


def test_published_size(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(7, i, rng.normal(size=8).tolist()) for i in range(520)], "g int, id long, u array<double>")
    points, pairs = relations.pairs_of_points(df, "id", "g", {"u": "cosine"})
    assert points.count() == 500 and pairs.count() == pairs.select("a", "b").distinct().count() == 124_750
