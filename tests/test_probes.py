"""Distributed logistic fits against plain ones."""

from __future__ import annotations

import numpy as np
import pytest

from lexitab.operators import probes, validation
from lexitab.plans import study_queries


def plain(rows, classes, grid=validation.C_GRID):
    """(key, fold, y, c, p) by whole-array Newton steps on one machine."""
    rows = sorted(rows)
    fold, y = (np.array([r[i] for r in rows], int) for i in (1, 2))
    x = np.array([r[3:] for r in rows], float)
    out = []

    def fit(z, t, c):
        w = np.zeros(z.shape[1] * (1 if classes == 2 else classes))
        penalty = np.tile(np.append(np.full(z.shape[1] - 1, 1 / c), 1e-9), len(w) // z.shape[1])
        for _ in range(50):
            p = predict(w, z)
            if classes == 2:
                g, h = z.T @ (p[:, 1] - t), (z * (p[:, 1] * p[:, 0])[:, None]).T @ z
            else:
                g = ((p - np.eye(classes)[t]).T @ z).ravel()
                h = np.block([[(z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z for b in range(classes)] for a in range(classes)])
            step = np.linalg.solve(h + np.diag(penalty), g + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-10:
                break
        return w

    def predict(w, z):
        if classes == 2:
            p = 1 / (1 + np.exp(-z @ w))
            return np.column_stack([1 - p, p])
        e = np.exp(z @ w.reshape(classes, -1).T)
        return e / e.sum(axis=1, keepdims=True)

    for f in sorted(set(fold)):
        train, test = fold != f, fold == f
        mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
        z = np.column_stack([(x - mean) / np.where(scale > 0, scale, 1), np.ones(len(x))])
        zt, t = z[train], y[train]
        prior = np.bincount(t, minlength=classes) / len(t)
        part, losses = np.arange(len(t)) % 5, {}
        for c in grid:
            p = np.tile(prior, (len(t), 1))
            for k in range(5):
                if len(set(t[part != k])) > 1:
                    p[part == k] = predict(fit(zt[part != k], t[part != k], c), zt[part == k])
            losses[c] = -np.log(np.clip(p[np.arange(len(t)), t], 1e-15, 1 - 1e-15)).mean()
        best = min(grid, key=lambda c: (losses[c], c))
        fitted = len(set(t)) > 1
        p = predict(fit(zt, t, best), z[test]) if fitted else np.tile(prior, (int(test.sum()), 1))
        out += [(r[0], int(f), r[2], best if fitted else None, q.tolist()) for r, q in zip([r for r in rows if r[1] == f], p)]
    return sorted(out)


def assert_close(found, want):
    found = sorted(tuple(r) for r in found)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in found], [r[4] for r in want], atol=1e-8)


@pytest.mark.parametrize("classes", [2, 4])
def test_equals_plain_newton(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(240, 3))
    y = (np.abs(x[:, 0] + x[:, 1] * 0.7 + rng.normal(size=240)) * classes / 3.2).astype(int).clip(0, classes - 1)
    rows = [(int(3 * i), int(i * 7 % 3), int(y[i]), float(x[i, 0]), float(x[i, 1]), 5.0 if i % 3 else float(x[i, 2])) for i in range(240)]
    df = spark.createDataFrame([*rows, (1, 0, None, 1.0, 1.0, 1.0)], "id long, fold int, y int, a double, b double, c double").repartition(6)
    found = probes.cross_validated_logistic(df, "id", ["a", "b", "c"], "y", "fold", classes=classes)
    assert found.columns == ["id", "fold", "y", "c", "p"]
    assert_close(found.collect(), plain(rows, classes))
    if classes == 2:
        one = {r["id"]: r["prediction"] for r in validation.cross_validate(df, "id", ["a", "b", "c"], "y", "fold", validation.LogisticProbe).collect()}
        assert max(abs(one[r["id"]] - r["p"][1]) for r in found.collect()) < 1e-8


def test_query_equals_plain_newton(spark, small):
    rows = [tuple(r) for r in study_queries._labelled(spark, small).select("doc_id", "fold", "quality", "size", "p0", "p1").collect()]
    want = {r[0]: (r[3], r[4][1]) for r in plain(rows, 2)}
    found = study_queries.cross_validated_probe(spark, small).collect()
    assert len(found) == len(rows) and all((r["c"], r["prediction"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1], abs=1e-6)) for r in found)


def test_single_classes_and_no_rows(spark):
    rows = [(i, i % 2, int(i % 2 == 0), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double")
    found = probes.cross_validated_logistic(df, "id", ["a"], "y", "fold").collect()
    assert all(r["c"] is None and r["p"][1] == 1 - r["y"] for r in found) and len(found) == 20
    assert probes.cross_validated_logistic(df.limit(0), "id", ["a"], "y", "fold").count() == 0


def test_thresholds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), int(rng.random() < 0.4), round(float(rng.random()), 2)) for i in range(300)]
    grid = [i / 20 for i in range(1, 20)]
    found = {r["fold"]: (r["threshold"], r["f1"]) for r in probes.chosen_thresholds(spark.createDataFrame(rows, "fold int, y int, p double"), "fold", "y", "p", grid).collect()}
    for f in range(3):
        scores = []
        for t in grid:
            tp, fp, fn = (sum(1 for g, y, p in rows if g != f and (p >= t) == hit and y == is_one) for hit, is_one in ((True, 1), (True, 0), (False, 1)))
            scores.append((round(2 * tp / (2 * tp + fp + fn), 12), -t))
        assert found[f] == (pytest.approx(-max(scores)[1]), pytest.approx(max(scores)[0]))
    none = probes.chosen_thresholds(spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2)], "fold int, y int, p double"), "fold", "y", "p", [0.5, 0.6])
    assert {(r["threshold"], r["f1"]) for r in none.collect()} == {(0.5, 0.0)}


def test_bins(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 10.0), (1, 20.0), (1, None)], "fold int, y double")
    found = {r["fold"]: r["edges"] for r in probes.equal_frequency_bins(df, "y", "fold", 2).collect()}
    assert found == {0: [15.0], 1: [2.0]}
    placed = df.join(probes.equal_frequency_bins(df, "y", "fold", 2), "fold").select("y", probes.bin_of("y", "edges").alias("b"))
    assert {(r["y"], r["b"]) for r in placed.collect()} == {(1.0, 0), (2.0, 0), (3.0, 0), (10.0, 1), (20.0, 1), (None, None)}
