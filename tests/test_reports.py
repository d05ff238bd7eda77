"""Field axes and their cache, the classification report, and vectors of long texts, against plain loops."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitab.operators import linear, long_texts
from lexitab.operators import metrics as M


def plain_axes(x, k, standardise=False):
    mean = x.mean(axis=0)
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1) if standardise else np.ones(x.shape[1])
    values, axes = np.linalg.eigh(np.cov(((x - mean) / scale).T))
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, scale, axes, values[order] / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(120, 6)) * [9, 5, 3, 1, 1, 1] + 100, rng.normal(size=(120, 4)) * [4, 2, 1, 0.5]
    return [(i, None if i % 11 == 0 else u[i].tolist(), None if i % 7 == 0 else v[i].tolist()) for i in range(120)]


SCHEMA = "id long, u array<double>, v array<double>"


def test_field_axes(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(5)
    found = linear.FieldAxes(["u", "v"], 3).fit(df)
    for name, at in (("u", 1), ("v", 2)):
        mean, _, axes, share = plain_axes(np.array([r[at] for r in vectors if r[at]]), 3)
        p = found.parameters[name]
        assert np.allclose(p["mean"], mean) and np.allclose(p["axes"], axes) and np.allclose(p["share"], share)
    out = {r["id"]: r for r in found.transform(df).collect()}
    assert out[0]["u_axes"] is None and out[11]["u_axes"] is None and out[7]["v_axes"] is None
    mean, _, axes, _ = plain_axes(np.array([r[1] for r in vectors if r[1]]), 3)
    assert np.allclose(out[5]["u_axes"], (np.array(vectors[5][1]) - mean) @ axes.T)


def test_joint_axes_impute_training_means(spark, vectors):
    train = spark.createDataFrame(vectors[:80], SCHEMA)
    found = linear.FieldAxes(["u", "v"], 4, "joint", True).fit(train)
    means = [np.mean([r[at] for r in vectors[:80] if r[at]], axis=0) for at in (1, 2)]
    joint = lambda r: np.concatenate([means[i] if r[i + 1] is None else r[i + 1] for i in (0, 1)])
    x = np.array([joint(r) for r in vectors[:80] if r[1] or r[2]])
    mean, scale, axes, share = plain_axes(x, 4, True)
    p = found.parameters["joint"]
    assert np.allclose(p["mean"], mean) and np.allclose(p["scale"], scale) and np.allclose(p["axes"], axes) and np.allclose(p["share"], share)
    out = {r["id"]: r["joint_axes"] for r in found.transform(spark.createDataFrame(vectors, SCHEMA)).collect()}
    assert out[77] is None and out[0] is None  # neither vector
    assert np.allclose(out[91], ((joint(vectors[91]) - mean) / scale) @ axes.T)
    none = linear.FieldAxes(["u"], 2).fit(train.where("u is null"))
    assert none.parameters["u"]["rows"][0] == 0


def test_wide_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 40)) * np.r_[20, 10, 5, np.full(37, 0.5)] + 7
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)
    mean, axes, share = linear.wide_axes(df, "v", 3, more=8)
    m, a, s = linear.principal_axes(df, "v", 3)
    assert np.allclose(mean, m) and np.allclose(axes, a, atol=1e-6) and np.allclose(share, s)
    want = plain_axes(x, 3)
    assert np.allclose(a, want[2]) and np.allclose(s, want[3])


def test_cache_finds_the_same_rows_only(spark, vectors, tmp_path):
    df = spark.createDataFrame(vectors, SCHEMA)
    cache = linear.FitCache(spark, f"file:{tmp_path}/fits")
    first = linear.FieldAxes(["u", "v"], 2).fit(df, cache).parameters
    again = linear.FieldAxes(["u", "v"], 2).fit(df.orderBy(F.desc("id")).repartition(3), linear.FitCache(spark, f"file:{tmp_path}/fits")).parameters
    assert all((first[f][n] == again[f][n]).all() for f in first for n in first[f]) and cache.made == 2
    linear.FieldAxes(["u", "v"], 2).fit(df, cache)
    assert (cache.made, cache.found) == (2, 2)
    for other, fit in ((df.where("id <> 5"), linear.FieldAxes(["u"], 2)), (df, linear.FieldAxes(["u"], 3)), (df, linear.FieldAxes(["u"], 2, "per_field", True)), (df.union(df.where("id = 5")), linear.FieldAxes(["u"], 2))):
        fit.fit(other, cache)
    assert cache.made == 6
    # A damaged fit is made anew.
    for folder in (tmp_path / "fits").iterdir():
        rows = spark.read.parquet(f"file:{folder}").collect()
        spark.createDataFrame([(r["name"], r["shape"], [x + 1 for x in r["numbers"]], r["checksum"]) for r in rows], "name string, shape array<int>, numbers array<double>, checksum string").write.mode("overwrite").parquet(f"file:{folder}")
    linear.FieldAxes(["u", "v"], 2).fit(df, cache)
    assert cache.made == 8


def plain_report(rows, k):
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def auc(t, s):
        pos, neg = s[t == 1], s[t == 0]
        return None if not len(pos) or not len(neg) else np.mean([(a > neg).sum() + (a == neg).sum() / 2 for a in pos]) / len(neg)

    def ap(t, s):
        if not t.sum() or t.all():
            return None
        total = 0.0
        for level in sorted(set(s)):
            taken = s >= level
            total += t[s == level].sum() * t[taken].sum() / taken.sum()
        return total / t.sum()

    out = {("log_loss", None): -np.log(p[np.arange(len(y)), y]).mean(), ("brier_sum", None): ((p - np.eye(k)[y]) ** 2).sum(axis=1).mean()}
    hits = np.array([sorted(range(k), key=lambda c: (-q[c], c)).index(t) for q, t in zip(p, y)])
    out |= {("accuracy", None): (hits < 1).mean()} | {(f"top_{n}", None): (hits < n).mean() for n in (2, 3) if n < k}
    support = np.bincount(y, minlength=k)
    aucs, aps = [auc((y == c).astype(int), p[:, c]) for c in range(k)], [ap((y == c).astype(int), p[:, c]) for c in range(k)]
    for c in range(k):
        out |= {("brier", c): ((p[:, c] - (y == c)) ** 2).mean(), ("support", c): support[c], ("roc_auc", c): aucs[c], ("average_precision", c): aps[c]}
    every = (support > 0).all()
    pairs = []
    for a, b in itertools.combinations(range(k), 2):
        some = (y == a) | (y == b)
        pairs.append((some.sum(), every and (auc((y[some] == a).astype(int), p[some, a]) + auc((y[some] == b).astype(int), p[some, b])) / 2))
    names = ["roc_auc_ovr_macro", "roc_auc_ovr_weighted", "average_precision_macro", "average_precision_weighted", "roc_auc_ovo_macro", "roc_auc_ovo_weighted", "average_precision_micro"]
    values = [np.mean(aucs), np.average(aucs, weights=support), np.mean(aps), np.average(aps, weights=support), np.mean([a for _, a in pairs]), np.average([a for _, a in pairs], weights=[w for w, _ in pairs]), ap(np.eye(k)[y].ravel(), p.ravel())] if every else [None] * 7
    return out | {(n, None): v for n, v in zip(names, values)}


@pytest.mark.parametrize("k,present", [(3, 3), (5, 5), (4, 3), (2, 2)])
def test_report(spark, k, present):
    rng = np.random.default_rng(k)
    p = (rng.dirichlet(np.ones(k), 150) * 20).round() + 1
    rows = [(int(rng.integers(present)), (q / q.sum()).tolist()) for q in p]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (0, None)], "y int, p array<double>").repartition(3)
    found = {(r["metric"], r["class"]): (r["value"], r["reason"]) for r in M.classification_report(df, "y", "p", k).collect()}
    want = plain_report(rows, k)
    assert set(found) == set(want)
    for name, value in want.items():
        assert found[name][0] == (None if value is None else pytest.approx(value)) and (found[name][1] is None) == (value is not None), name


def counted(texts):
    return np.array([[t.count("a"), t.count("b"), len(t)] for t in texts], float)


@pytest.mark.parametrize("overlap", [0, 3])
def test_long_texts(spark, overlap):
    rng = np.random.default_rng(9)
    texts = {i: " ".join(rng.choice(["ab", "b", "", "c", "aaa"], n)) for i, n in enumerate([1, 7, 8, 9, 13, 300, 20_000])} | {50: None, 51: "  ", 52: "z"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(3)
    found = {r["id"]: r for r in long_texts.embedded(df, "id", "t", counted, budget=8, overlap=overlap).collect()}
    assert set(found) == {i for i, t in texts.items() if t and t.strip()}
    for i, r in found.items():
        tokens, starts = texts[i].split(" "), [0]
        while starts[-1] + 8 < len(tokens):
            starts.append(starts[-1] + 8 - overlap)
        parts = [tokens[s : s + 8] for s in starts]
        assert overlap or sum(map(len, parts)) == len(tokens)
        mean = np.average(counted([" ".join(x) for x in parts]), axis=0, weights=[len(x) for x in parts])
        assert (r["pieces"], r["tokens"]) == (len(parts), sum(map(len, parts))) and r["norm"] == pytest.approx(np.linalg.norm(mean))
        assert np.allclose(r["vector"], mean / np.linalg.norm(mean)) and np.linalg.norm(r["vector"]) == pytest.approx(1)
    zero = long_texts.embedded(df.where("id = 52"), "id", "t", lambda t: np.zeros((len(t), 2)), budget=8).first()
    assert zero["vector"] is None and zero["norm"] == 0


def test_long_texts_are_read_once_and_cut_before_they_are_dealt(spark):
    """One scan and one shuffle give vectors and counts, and no row of a piece holds the text's other tokens."""
    df = spark.createDataFrame([(i, "a b c d e " * 20) for i in range(3)], "id long, t string").repartition(2)
    out = long_texts.embedded(df, "id", "t", counted, budget=8, overlap=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan and plan.count("Aggregate") == 1
    dealt = [line for line in plan.splitlines() if "Generate" in line]
    assert len(dealt) == 1 and "__tokens" not in dealt[0].rsplit("[", 1)[1]
    assert "explode(sequence" not in plan and {(r["pieces"], r["tokens"]) for r in out.collect()} == {(20, 158)}


def test_folds_are_standardised_by_the_others_only(spark):
    rows = [(0, 1.0, 5.0), (0, None, 5.0), (1, 3.0, 5.0), (1, 7.0, None), (2, 100.0, float("nan"))]
    df = spark.createDataFrame(rows, "f int, a double, b double")
    found = [tuple(r) for r in linear.standardised_by_fold(df, ["a", "b"], "f").collect()]
    for f, a, b in found:
        others = np.array([r[1] for r in rows if r[0] != f and r[1] is not None])
        assert b == 0.0 and any(a == pytest.approx((v - others.mean()) / others.std()) for v in [r[1] if r[1] is not None else others.mean() for r in rows if r[0] == f])
    assert len(found) == 5
    one = linear.standardised_by_fold(df.where("f = 0"), ["a"], "f").collect()
    assert all(r["a"] is None for r in one)
