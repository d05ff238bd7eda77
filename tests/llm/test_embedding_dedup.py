from __future__ import annotations

import math

import numpy as np
import pytest

from lexitab.llm import embedding_dedup
from tests.llm.test_simhash import classes_of


def brute(rows, threshold=0.93):
    ids = [i for i, *_ in rows]
    linked = []
    for x, (a, u, p) in enumerate(rows):
        for b, v, q in rows[x + 1 :]:
            usable = u and v and all(k is not None and math.isfinite(k) for k in [*u, *v]) and any(u) and any(v) and len(u) == len(v)
            if usable and p is not None and p == q:
                u64, v64 = np.array(u, float), np.array(v, float)
                if u64 @ v64 / (np.linalg.norm(u64) * np.linalg.norm(v64)) >= threshold:
                    linked.append((a, b))
    groups = classes_of(ids, linked)
    count = {i: sum(i in pair for pair in linked) for i in ids}
    return {i: (count[i], groups[i], groups[i] == i) for i in ids}


def found(df, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(df, **options).collect()}


@pytest.mark.parametrize(("cell_rows", "block"), [(4096, 2048), (20, 16), (8, 4)])
def test_clusters_equal_brute_force(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for centre in rng.normal(size=(12, 8)):
        for scale in (0.05, 0.2, 0.4):
            rows += [(len(rows) + k, (centre + scale * noise).astype(np.float32).tolist(), int(k % 2)) for k, noise in enumerate(rng.normal(size=(6, 8)))]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert found(df) == brute(rows)


def test_supplied_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    assert found(df) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def test_edges(spark):
    one = [1.0, 0.0]
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [None, 1.0], 0), (4, [math.nan, 1.0], 0), (5, [math.inf, 1.0], 0), (6, one, None), (7, one, 0), (8, [2.0, 0.0], 0), (9, one, 0), (10, [1.0, 0.0, 0.0], 0), (11, [1e-300, 0.0], 0), (12, [], 0), (13, [1e300, 0.0], 0)]
    df = spark.createDataFrame([(*r, "n", "home") for r in rows], "vec_id long, embedding array<double>, label int, n string, home string")
    out = found(df)
    assert all(out[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12))
    assert all(out[i] == (4, 7, i == 7) for i in (7, 8, 9, 11, 13))
    assert found(df.limit(0)) == {}
    nameless = spark.createDataFrame([(None, one, 0), (4, one, 0), (4, one, 0)], "vec_id long, embedding array<double>, label int")
    result = embedding_dedup.near_duplicate_vectors(nameless).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in result) == [(0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.6, -0.8000001], 0)], "vec_id long, embedding array<double>, label int")
    assert found(df, threshold=0.6) == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
