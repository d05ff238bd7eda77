"""Feature blocks, cross-validation and the vector functions of presentations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitab.functions import vectors as V
from lexitab.operators import features, validation


def test_selectors(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", None, 3)], "p string, q string, v long")
    assert features.exactly_one(features.select_where(df, {"p": "a", "q": None}), "row")["v"] == 1
    with pytest.raises(LookupError, match="missing"):
        features.exactly_one(features.select_where(df, {"p": "z"}), "row")
    with pytest.raises(LookupError, match="ambiguous"):
        features.exactly_one(features.select_where(df, {"p": "a"}), "row")


def test_blocks_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, prov__joint__0__a long, prov__joint__1__a long")
    assert features.without_block(df, "__0__").columns == ["id", "prov__joint__1__a"]
    with pytest.raises(ValueError, match="no column"):
        features.without_block(df, "__9__")
    assert features.column_groups(df.columns) == {("id",): ["id"], ("prov", "joint", "0"): ["prov__joint__0__a"], ("prov", "joint", "1"): ["prov__joint__1__a"]}


def test_assembly_refuses_other_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, " ")], "id long, t string")
    block = spark.createDataFrame([(2, 0.2), (1, 0.1)], "id long, p double")
    out = features.assemble(features.presence_flags(base, ["t"]), [block], "id").orderBy("id").collect()
    assert [(r["t__missing"], r["p"]) for r in out] == [(0, 0.1), (1, 0.2)]
    for bad, text in ((block.limit(1), "lacks rows"), (block.union(block), "repeated key"), (block.withColumnRenamed("p", "t"), "two blocks")):
        with pytest.raises(ValueError, match=text):
            features.assemble(base, [bad], "id")


def test_responses_to_block(spark):
    requests = spark.createDataFrame([(1, "a", "k1"), (1, "b", "k2"), (2, "a", "k1"), (2, "b", None)], "row long, grp string, key string")
    responses = spark.createDataFrame([("k1", 0.3)], "key string, p double")
    out = {r["row"]: (r["a"], r["b"]) for r in features.responses_to_block(requests, responses, "row", "grp", "key", "p", ["a", "b"]).collect()}
    assert out == {1: (0.3, None), 2: (0.3, None)}


def test_bins_and_shards(spark):
    train = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    query = spark.createDataFrame([(-1.0,), (1.0,), (2.5,), (9.0,)], "x double")
    assert [r["x_bin"] for r in features.training_bins(train, query, "x", [0.25, 0.5, 0.75]).orderBy("x").collect()] == [0, 1, 2, 3]
    for rows, shards in ((10, 3), (7, 7), (5, 8), (1000, 7)):
        got = [r[0] for r in spark.range(rows).orderBy("id").select(features.contiguous_shard(F.col("id"), rows, shards)).collect()]
        assert got == [next(i for i in range(shards) if rows * i // shards <= p < rows * (i + 1) // shards) for p in range(rows)]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def vector(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_presentations(spark):
    order = F.array(*[F.lit(i).cast("long") for i in (2, 0, 1)])
    assert one(spark, V.realigned(vector(0.5, 0.2, 0.3), order)) == [0.2, 0.3, 0.5]
    assert one(spark, V.mean_vector(vector(0, 1), vector(1, 0), vector(1, 1))) == pytest.approx([2 / 3, 2 / 3])
    assert one(spark, V.ordinal_target(F.lit(0), 4, 0.1)) == pytest.approx([0.9, 0.1, 0, 0])
    assert one(spark, V.ordinal_target(F.lit(2), 4, 0.1)) == pytest.approx([0, 0.05, 0.9, 0.05])
    assert one(spark, V.within_rounding(F.lit(0.12), 2)) and not one(spark, V.within_rounding(F.lit(0.123), 2))
    low, high = one(spark, V.score_range(vector(0.5, 0.5), 0.1, 0))
    assert (low, high) == (pytest.approx(0.4), pytest.approx(0.6))


def test_cross_validation_never_sees_the_test_fold(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    rows = [(i, float(x[i]), float(x[i] > 0), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    out = validation.cross_validate(df, "id", ["x"], "y", "fold", validation.LogisticProbe).collect()
    assert len(out) == 200 and np.mean([(r["prediction"] > 0.5) == bool(r["y"]) for r in out]) > 0.95
    noise = validation.cross_validate(df.withColumn("x", F.when(F.col("fold") == 0, F.col("y")).otherwise(0.0)), "id", ["x"], "y", "fold", validation.LogisticProbe)
    held = {round(r["prediction"], 9) for r in noise.where("fold = 0").collect()}
    assert len(held) == 1  # training rows hold a constant, so the test rows' own labels don't show
    flat = validation.cross_validate(df.withColumn("y", F.lit(1.0)), "id", ["x"], "y", "fold", validation.LogisticProbe)
    assert {r["prediction"] for r in flat.collect()} == {1.0}


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 2)), rng.integers(0, 2, 80).astype(float)

    def loss(w):
        p = validation.probability(w, x)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (w[:-1] ** 2).sum() / 2 / 0.5

    w = validation.logistic(x, y, 0.5)
    assert all(loss(w) <= loss(w + d) for d in 0.01 * rng.normal(size=(50, 3)))


def test_permutation_stays_in_its_stratum(spark):
    df = spark.createDataFrame([(i, i * 10, i * 10, "a" if i % 2 else None) for i in range(40)], "id long, x long, z long, g string")
    out = validation.permuted_within(df, "id", ["x", "z"], ["g"], 3).collect()
    assert all(r["x"] == r["z"] and (r["x"] // 10) % 2 == r["id"] % 2 for r in out)
    assert sorted(r["x"] for r in out) == [i * 10 for i in range(40)] and any(r["x"] != r["id"] * 10 for r in out)


def test_crossfit_assembly(spark):
    fits = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.2), (2, 1, 0.4)], "id long, part int, p double")
    rows = spark.createDataFrame([(1, 1), (2, None)], "id long, held_part int")
    assert {r["id"]: r["p"] for r in validation.assemble_crossfit(fits, rows, "id").collect()} == {1: 0.9, 2: pytest.approx(0.3)}


def test_rule_quality(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.1, -0.3), (-0.1, 0.5), (-0.1, -0.5)], "p double, g double")
    out = validation.rule_quality(df, "p", "g").first()
    assert (out["units"], out["use_accuracy"], out["regret"]) == (4, 0.5, pytest.approx((0.3 + 0.5) / 4))
