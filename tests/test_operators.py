"""Operators on hand-computed cases, and against plain NumPy where numbers are drawn."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexitab.operators import dedup, gains, geometry, linear, ordered, ranks, statistics
from lexitab.operators import metrics as M


def first(df):
    return df.first().asDict()


def test_reuse_counts_types_apart(spark):
    df = spark.createDataFrame([(0, "1", "x"), (1, "1", "x"), (2, "same ", None), (3, "same", " "), (4, None, None), (5, "1", None)], "id long, a string, b string")
    out = {r["slot"]: r for r in dedup.reuse_profile(df, "id", ["a", "b"]).collect()}
    assert (out["a"]["nonempty"], out["a"]["unique_inputs"], out["a"]["largest_group"]) == (5, 3, 3)
    assert (out["b"]["nonempty"], out["b"]["unique_inputs"]) == (2, 1)
    assert (out["joint"]["rows"], out["joint"]["nonempty"], out["joint"]["unique_inputs"]) == (6, 5, 4)


def test_dictionary_has_first_appearance_order(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None), (5, "c")], "id long, t string")
    unique, links = dedup.dictionary(df, "id", ["t"])
    found = {(r["row_id"], r["slot"]): r["input_no"] for r in links.collect()}
    assert [found[i, "t"] for i in (1, 2, 3, 4, 5)] == [0, 1, 1, None, 2]
    assert all(found[i, "t"] == found[i, "joint"] for i in (1, 2, 3, 4, 5))
    assert unique.count() == 3


def test_joint_key_of_one_field_is_that_fields_key(spark):
    df = spark.createDataFrame([(1, "a", None)], "id long, x string, y string")
    keys = {r["slot"]: r["input_key"] for r in dedup.slots(df, "id", ["x", "y"]).collect()}
    assert keys["x"] == keys["joint"] and keys["y"] is None


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    same = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    other = spark.createDataFrame([(1, "z"), (4, "d")], "k long, v string")
    assert dedup.conflicts(old, same, ["k"]).count() == 0
    assert sorted(r["k"] for r in dedup.lossless_union(old, same, ["k"]).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="disagree"):
        dedup.lossless_union(old, other, ["k"])
    assert {r["k"]: r["v"] for r in dedup.upsert(old, other, ["k"]).collect()} == {1: "z", 2: None, 4: "d"}
    with pytest.raises(ValueError, match="repeated key"):
        dedup.many_to_one(old, same.union(same), ["k"])


def test_null_keys_match_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x long")
    right = spark.createDataFrame([(None, 10)], "k string, y long")
    assert {r["x"]: r["y"] for r in dedup.many_to_one(left, right, ["k"]).collect()} == {1: 10, 2: None}


def test_roc_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.4), ("a", 0, 0.5), ("b", 1, 0.5), ("b", 0, 0.5), ("c", 1, 0.2)], "g string, y int, s double")
    out = {r["g"]: r["auc"] for r in M.roc_auc(df, "y", "s", "g").collect()}
    assert out["a"] == pytest.approx(0.75) and out["b"] == pytest.approx(0.5) and out["c"] is None


def test_binary_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.5)], "y int, p double")
    brier = df.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0]
    assert brier == pytest.approx(0.1575)
    assert first(M.best_threshold(df, "y", "p"))["f1"] == pytest.approx(0.8)
    multi = df.select(M.brier(F.array(1 - F.col("p"), F.col("p")), F.col("y")).alias("b")).agg(F.avg("b")).first()[0]
    assert multi == pytest.approx(2 * brier)


def test_regression_report(spark):
    out = first(M.regression_report(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "y double, p double"), "y", "p"))
    assert out["rmse"] == pytest.approx(math.sqrt(2 / 3)) and out["mae"] == pytest.approx(2 / 3)
    assert out["r2"] == pytest.approx(0) and out["pearson"] == pytest.approx(0.5)
    flat = first(M.regression_report(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double"), "y", "p"))
    assert flat["r2"] is None and flat["pearson"] is None and flat["mape"] is None


def test_confusion_keeps_zeros(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    cells = {(r["y"], r["predicted"]): r["n"] for r in M.confusion(df, "y", "p", [0, 1]).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    out = first(M.decisions(M.confusion(df, "y", "p", [0, 1])))
    assert out["accuracy"] == pytest.approx(2 / 3) and out["balanced_accuracy"] == pytest.approx(0.5) and out["mcc"] == 0


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,), (0.2,)], "p double")
    q = {r["p"]: r["q"] for r in statistics.benjamini_hochberg(df, "p").collect()}
    assert q[None] is None and q[0.01] == pytest.approx(0.04) and q[0.03] == pytest.approx(0.04 * 4 / 3) and q[0.04] == pytest.approx(0.04 * 4 / 3) and q[0.2] == pytest.approx(0.2)
    adjusted = {r["p"]: r["adjusted"] for r in statistics.holm(df, "p").collect()}
    assert adjusted[0.01] == pytest.approx(0.04) and adjusted[0.03] == pytest.approx(0.09) and adjusted[0.04] == pytest.approx(0.09)


def test_corrections_read_their_input_once_and_join_it_once(spark, tmp_path):
    rows = [(g, p) for g in ("a", "b", None) for p in (0.01, 0.02, 0.02, 0.5, None, 0.04)]
    spark.createDataFrame(rows, "g string, p double").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for correct in (statistics.benjamini_hochberg, statistics.holm):
        out = correct(df, "p", "g")
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
        assert out.count() == len(rows)
    q = {(r["g"], r["p"]): r["q"] for r in statistics.benjamini_hochberg(df, "p", "g").collect()}
    assert q[None, 0.02] == pytest.approx(0.1 / 3) and q["b", 0.5] == pytest.approx(0.5) and q["a", None] is None and q["a", 0.01] == pytest.approx(0.1 / 3)
    adjusted = {(r["g"], r["p"]): r["adjusted"] for r in statistics.holm(df, "p", "g").collect()}
    assert adjusted[None, 0.02] == pytest.approx(0.08) and adjusted["a", 0.04] == pytest.approx(0.08) and adjusted["a", 0.5] == pytest.approx(0.5)


def test_joint_keys_come_from_parts(spark):
    """Types and white space count; a separator inside a text doesn't stand for another field."""
    cells = [("same", "text"), ("same", "text"), ("same", None), (None, "text"), (" ", None), (1, None), ("1", None), ("same ", "text")]
    df = spark.createDataFrame([(i, json.dumps(a), b) for i, (a, b) in enumerate(cells)], "id long, a string, b string")
    df = df.select("id", F.parse_json("a").alias("a"), "b")
    profile = {r["slot"]: r for r in dedup.reuse_profile(df, "id", ["a", "b"]).collect()}
    assert profile["joint"]["unique_inputs"] == 6 and profile["a"]["unique_inputs"] == 4 and profile["a"]["nonempty"] == 6
    keys = dedup.slots(df, "id", ["a", "b"]).where("input_key is not null")
    single, joint = (keys.where(f"slot {x} 'joint'").select("input_key").distinct() for x in ("<>", "="))
    assert single.intersect(joint).count() == 4
    assert [r["rows"] for r in dedup.top_frequencies(df, "id", ["a"], 9).where("slot = 'a'").orderBy("place").collect()] == [3, 1, 1, 1]
    for a, b in (("x\x1fb=y", "x"), ("x;s1:b;s1:y", "x")):
        two = spark.createDataFrame([(1, a, None), (2, b, "y")], "id long, a string, b string")
        assert dedup.slots(two, "id", ["a", "b"]).where("slot = 'joint'").select("input_key").distinct().count() == 2


def test_random_effects(spark):
    df = spark.createDataFrame([("a", 0.1, 0.01), ("a", 0.3, 0.02), ("a", 0.5, 0.01), ("b", 0.2, 0.1)], "g string, y double, v double")
    out = {r["g"]: r for r in statistics.random_effects(df, "y", "v", "g").collect()}
    w = np.array([100, 50, 100.0])
    y = np.array([0.1, 0.3, 0.5])
    q = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    tau2 = (q - 2) / (w.sum() - (w * w).sum() / w.sum())
    v = 1 / (1 / w + tau2)
    assert out["a"]["tau2"] == pytest.approx(tau2) and out["a"]["pooled"] == pytest.approx((v * y).sum() / v.sum())
    assert out["b"]["status"] == "too_few_studies" and out["b"]["pooled"] is None


def test_bootstrap_equals_numpy(spark):
    values = [0.125, 0.25, 0.5, 0.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("g", 9, None)], "g string, i long, v double").repartition(3)
    out = first(statistics.bootstrap_mean(df, "v", ["g"], ["i"], draws=2000, seed=3))
    draws = np.random.default_rng(3).integers(0, 4, (2000, 4))
    low, high = np.percentile(np.array(values)[draws].mean(axis=1), [2.5, 97.5])
    assert (out["n"], out["low"], out["high"]) == (4, pytest.approx(low), pytest.approx(high))


def test_permutation(spark):
    df = spark.createDataFrame([("up", i, float(i), float(i) ** 3) for i in range(12)] + [("flat", i, 1.0, float(i)) for i in range(6)] + [("few", 0, 1.0, 1.0)], "g string, i long, x double, y double")
    out = {r["g"]: r for r in statistics.permutation_spearman(df, "x", "y", ["g"], ["i"], permutations=999).collect()}
    assert out["up"]["rho"] == pytest.approx(1) and out["up"]["p"] == pytest.approx(1 / 1000)
    assert out["flat"]["status"] == "constant_input" and out["few"]["status"] == "too_few_rows"


def test_wilcoxon_exact(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.5, 0.0)], "d double").withColumn("g", F.lit(1))
    out = first(statistics.wilcoxon_signed_rank(df, "d", ["g"]))
    assert (out["n"], out["w"], out["p"]) == (5, 0.0, pytest.approx(2 / 32))


def test_spearman_and_kendall_with_ties(spark):
    x, y = [1.0, 2.0, 2.0, 3.0, 5.0], [2.0, 1.0, 4.0, 4.0, 3.0]
    df = spark.createDataFrame(list(zip(range(5), x, y)), "u long, x double, y double").withColumn("g", F.lit("g"))
    expected = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert first(ranks.spearman(df, "x", "y", "g"))["rho"] == pytest.approx(expected)
    ties = spark.createDataFrame([("g", 0, 1.0, 1.0), ("g", 1, 2.0, 2.0), ("g", 2, 2.0, 3.0)], "g string, u long, x double, y double")
    assert first(ranks.kendall_tau_b(ties, "u", "x", "y", "g"))["tau"] == pytest.approx(2 / math.sqrt(6))
    assert first(ranks.spearman(df.withColumn("x", F.lit(1.0)), "x", "y", "g"))["rho"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_pandas(spark, descending):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 500), "x": rng.integers(0, 40, 500) / 7, "i": range(500), "v": rng.integers(1, 9, 500)})
    df = spark.createDataFrame(frame)
    order = [F.desc("x") if descending else F.asc("x"), F.col("i")]
    got = ordered.running(df, ["k"], ordered.bucket_of("x", ordered.edges(df, "x", 16)), order, {"s": F.col("v")}, descending=descending)
    frame = frame.sort_values(["x", "i"], ascending=[not descending, True])
    frame["s"] = frame.groupby("k")["v"].cumsum()
    assert {r["i"]: r["s"] for r in got.collect()} == dict(zip(frame["i"], frame["s"]))


def test_nested_order(spark):
    df = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 90 else "c") for i in range(93)], "id long, g string")
    placed = ranks.nested_order(df, "id", "g", 1).toPandas().sort_values("position")
    assert placed["position"].tolist() == list(range(1, 94)) and set(placed["g"][:3]) == {"a", "b", "c"}
    share = (placed["g"][:40] == "a").mean()
    assert abs(share - 60 / 93) < 0.06


def test_neighbours_share_ties(spark):
    pairs = spark.createDataFrame([("p", "x", 1.0), ("p", "y", 2.0), ("p", "z", 2.0), ("p", "w", 3.0)], "p string, o string, d double")
    weights = {r["o"]: r["weight"] for r in ranks.neighbour_weights(pairs, "p", "d", 2).collect()}
    assert weights == {"x": 1.0, "y": 0.5, "z": 0.5}


def test_gains(spark):
    rows = [("d", "m", f, "base", 0.8) for f in range(5)] + [("d", "m", f, "arm", 0.9) for f in range(5)] + [("d", "m", f, "part", 0.9) for f in range(4)]
    df = spark.createDataFrame(rows, "dataset string, model string, fold int, arm string, value double")
    whole = gains.complete_arms(df, ["dataset", "model", "arm"])
    assert {r["arm"] for r in whole.select("arm").distinct().collect()} == {"base", "arm"}
    paired = gains.fold_gains(whole, F.col("arm") == "base", ["dataset", "model", "fold"])
    assert first(gains.headroom_gains(paired, ["arm"]))["gain"] == pytest.approx(0.5)
    full = gains.headroom_gains(paired.withColumn("base", F.lit(1.0)), ["arm"])
    assert first(full)["gain"] == pytest.approx(-100)


def test_balanced_mean(spark):
    df = spark.createDataFrame([("p", "big", 0.0), ("p", "big", 1.0), ("p", "small", 1.0), ("p", "none", None)], "p string, d string, v double")
    assert first(gains.balanced_mean(df, ["p"], "d", "v")) == {"p": "p", "mean": pytest.approx(0.75), "datasets": 2}


def test_geometry_and_axes(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "i long, v array<double>")
    pairs = geometry.query_distances(*[df.where("v is not null").withColumn("g", F.lit(1))] * 2, "i", "v", "g")
    found = {(r["query"], r["other"]): r["distance"] for r in pairs.collect()}
    assert found[0, 1] == pytest.approx(1) and found[0, 2] == pytest.approx(1 - 2**-0.5)
    mean, axes, share = linear.principal_axes(df, "v", 5)
    assert len(axes) == 2 and share.sum() == pytest.approx(1) and np.allclose(mean, [2 / 3, 2 / 3])
    out = {r["i"]: r["components"] for r in linear.project(df, "v", mean, axes).collect()}
    assert out[3] is None and np.linalg.norm(np.array(out[0]) - out[1]) == pytest.approx(2**0.5)


def test_fold_input(spark):
    train = spark.createDataFrame([(1.0, "red", "2020-01-01"), (math.inf, None, "bad")], "amount double, colour string, day string")
    test = spark.createDataFrame([(math.nan, "green", "2020-01-02"), (3.0, "red", None)], "amount double, colour string, day string")
    out = linear.FoldInput(["amount"], ["day"], ["colour"]).fit(train).transform(test, impute=True).orderBy("amount").collect()
    assert [r["amount"] for r in out] == [1.0, 3.0] and [r["colour"] for r in out] == [None, 0] and out[0]["day"] == 1577923200


@pytest.mark.parametrize("stretch", [4, 7, 1000])
def test_moving_frames_cross_stretches(spark, stretch):
    """Frames shorter and longer than a stretch, on keys of 1, 30 and no rows to spare, ties in the order told by id."""
    rng = np.random.default_rng(8)
    rows = [(g, int(i), int(rng.integers(12)), float(rng.integers(50))) for g, n in (("a", 30), ("b", 1), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, t long, v double").repartition(5)
    frames = {"sum": (9, 5, lambda w: F.sum("v").over(w)), "own": (0, 0, lambda w: F.max("v").over(w)), "before": (2, 0, lambda w: F.first("id").over(w))}
    found = ordered.moving(df, ["g"], ordered.bucket_of("t", ordered.edges(df, "t")), [F.col("t"), F.col("id")], frames, place="place", stretch=stretch).collect()
    assert len(found) == len(rows)
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        tiles = {}
        for n, r in enumerate(sorted((r for r in found if r["g"] == g), key=lambda r: r["place"])):
            assert (r["id"], r["place"], r["own"]) == (own[n][1], n + 1, own[n][3])
            assert r["sum"] == sum(x[3] for x in own[max(0, n - 9) : n + 6]) and r["before"] == own[max(0, n - 2)][1]
            tiles.setdefault(g, []).append(n + 1)
        told = spark.createDataFrame([(x,) for x in tiles[g]], "p long").select("p", ordered.tile(F.col("p"), F.lit(len(own)), 4).alias("t")).collect()
        cut = [k for k, part in enumerate(np.array_split(np.arange(len(own)), 4), 1) for _ in part]
        assert [r["t"] for r in sorted(told)] == cut


def test_exact_quantiles_sort_only_what_they_need(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g, values in (("a", rng.normal(size=3001).round(1)), ("b", [5.0]), (None, rng.normal(size=40))) for x in values] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    found = {r["g"]: r for r in ordered.exact_quantiles(df, "v", {"low": 0.1, "middle": 0.5, "most": 1.0}, "g").collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g]
        assert [found[g][n] for n in ("low", "middle", "most")] == pytest.approx(np.quantile(values, [0.1, 0.5, 1.0]).tolist())
    assert set(found) == {"a", "b", None}
    whole = ordered.exact_quantiles(df, "v", {"q": 0.25}).first()
    assert whole["q"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
