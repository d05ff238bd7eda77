from __future__ import annotations

import hashlib
import math

import numpy as np

from lexitab.llm import delta_lloyd
from lexitab.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


def plain(rows, clusters=16, rounds=3, dimensions=64, scale=64):
    """Lloyd's rounds in Python's integers: (id, cluster, distance) of every row, and the centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept)[:clusters]]
    for number in range(rounds + 1):
        own = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            own.append((i, d.index(min(d)), min(d)))
        if number < rounds:
            groups = [[v for (_, v), (_, c, _) in zip(kept, own) if c == k] for k in range(len(centroids))]
            centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    return own, centroids


def test_query_equals_sql(spark, small):
    assert_same(QUERIES["op13_centroid_clusters"](spark, small), connect(small), ORACLE_SQL["op13_centroid_clusters"])


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 2
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=4) * (0.02 if i < 200 else 1.5)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for clusters, rounds in ((16, 3), (5, 12), (1, 2), (3, 0)):
        want, centroids = plain(rows, clusters, rounds, 4)
        found = delta_lloyd.fit(df, clusters=clusters, rounds=rounds, dimensions=4)
        assert found.centroids == centroids
        assert sorted((r["id"], r["owner"], r["distance"]) for r in found.assigned.collect()) == sorted(want)
    # Far fewer distances than every vector against every centroid in every round, once most centroids stand still.
    found = delta_lloyd.fit(df, clusters=12, rounds=25, dimensions=4)
    assert found.centroids == plain(rows, 12, 25, 4)[1]
    assert sum(r["computed"] for r in found.rounds) < 0.6 * len(rows) * 12 * 26 and found.rounds[-1]["moved"] == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [(-1.0) ** i * 1e6 + i, 3e5 * i]) for i in range(20)] + [(99, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = [(i, [max(-float(1 << 27), min(float(1 << 27), 64 * x)) / 64 for x in v]) for i, v in rows]
    want, centroids = plain(held, 4, 3, 2)
    found = delta_lloyd.fit(df, clusters=4, dimensions=2)
    assert found.centroids == centroids
    assert sorted((r["id"], r["owner"], r["distance"]) for r in found.assigned.collect()) == sorted(want)


def test_edges(spark):
    v = [0.5] * 64
    rows = [(1, v, 1), (1, v, 2), (None, [0.1] * 64, 3), (2, None, 4), (3, [], 5), (4, [0.5] * 63, 6), (5, [0.5] * 63 + [None], 7), (6, [0.5] * 63 + [float("nan")], 8), (7, [float("inf")] * 64, 9), (8, [-0.01] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    out = delta_lloyd.cluster_vectors(df).collect()
    assert sorted((str(r["vec_id"]), r["distance"], r["cluster_inertia"]) for r in out) == [("1", 0, 0), ("1", 0, 0), ("8", 0, 0), ("None", 0, 0)]
    same = {r["centroid_sha256"] for r in out if r["vec_id"] == 1}
    assert same == {hashlib.sha256(",".join(["32"] * 64).encode()).hexdigest()}
    assert delta_lloyd.cluster_vectors(df.limit(0)).count() == 0
    assert delta_lloyd.cluster_vectors(df.where("vec_id = 2")).count() == 0
