"""Cross-validation on Spark: folds are rows of a plan, fits see training rows only, predictions keep row ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, hash_bucket, numbered

#: Fixed values of the semantics.
C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0)
CROSSFIT_PARTS = 5


def logistic(x: np.ndarray, y: np.ndarray, c: float, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept, which isn't penalised) of an L2 logistic regression, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1 / c] * x.shape[1] + [1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))


class Estimator:
    """What a factory gives: fit(x, y) on training rows, then predict(x)."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Estimator:
        raise NotImplementedError

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class LogisticProbe(Estimator):
    """Standardised logistic regression whose C has the lowest log loss over parts; the class prior if one class is absent."""

    def fit(self, x, y):
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        z = (x - self.mean) / self.scale
        self.prior, self.w = float(np.mean(y)), None
        if 0 < self.prior < 1:
            part = np.arange(len(y)) % CROSSFIT_PARTS
            losses = {}
            for c in C_GRID:
                p = np.full(len(y), self.prior)
                for k in range(CROSSFIT_PARTS):
                    rest = part != k
                    if 0 < y[rest].mean() < 1:
                        p[~rest] = probability(logistic(z[rest], y[rest], c), z[~rest])
                p = np.clip(p, 1e-15, 1 - 1e-15)
                losses[c] = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            self.w = logistic(z, y, min(losses, key=losses.get))
        return self

    def predict(self, x):
        return np.full(len(x), self.prior) if self.w is None else probability(self.w, (x - self.mean) / self.scale)


class RidgeProbe(Estimator):
    """Standardised ridge regression; constant columns count nothing."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, x, y):
        self.mean, self.scale, self.level = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1), y.mean()
        z = (x - self.mean) / self.scale
        self.w = np.linalg.solve(z.T @ z + self.alpha * np.eye(x.shape[1]), z.T @ (y - self.level))
        return self

    def predict(self, x):
        return (x - self.mean) / self.scale @ self.w + self.level


def cross_validate(df: DataFrame, key: str, features: list[str], target: str, fold: str, make: Callable[[], Estimator], groups: list[str] = ()) -> DataFrame:
    """groups, key, fold, y, prediction: each row predicted by a fit on the other folds of its group.

    One task fits one fold of one group, so a group's rows must fit in a task's memory, as with any single-node model; the
    rows go once to each fold. Rows with a null are left out.
    """
    rows = df.dropna(subset=[*features, target, fold]).select(*groups, key, *features, F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    folds = rows.select("fold").distinct().agg(F.array_sort(F.collect_set("fold"))).first()[0]
    dealt = rows.withColumn("test_fold", F.explode(F.array(*map(F.lit, folds)))) if folds else rows.withColumn("test_fold", F.col("fold"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*groups, key])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        test = part["fold"] == part["test_fold"]
        train = part[~test]
        held = part[test]
        out = held[[*groups, key]].assign(fold=held["fold"], y=held["y"])
        if not len(train) or not len(held):
            return out.assign(prediction=np.nan)
        return out.assign(prediction=make().fit(train[features].to_numpy(float), train["y"].to_numpy(float)).predict(held[features].to_numpy(float)))

    return dealt.groupBy(*groups, "test_fold").applyInPandas(run, f"{kinds}, fold int, y double, prediction double")


def solved(alpha: float):
    """A column function: slopes and, last, the intercept of a standardised ridge regression from sums over its training rows."""

    def solve(n: pa.Array, sx: pa.Array, sxx: pa.Array, sy: pa.Array, sxy: pa.Array) -> pa.Array:
        out = []
        for rows, x, xx, y, xy in zip(*(a.to_pylist() for a in (n, sx, sxx, sy, sxy))):
            if not rows:
                out.append(None)
                continue
            mean, level = np.array(x) / rows, y / rows
            spread = np.array(xx).reshape(len(x), -1) - rows * np.outer(mean, mean)
            scale = np.sqrt(np.maximum(np.diag(spread), 0) / rows)
            scale = np.where(scale > 1e-9 * np.maximum(1, np.abs(mean)), scale, np.inf)  # a constant column counts nothing
            slopes = np.linalg.solve(spread / np.outer(scale, scale) + alpha * np.eye(len(x)), (np.array(xy) - mean * y) / scale) / scale
            out.append([*slopes.tolist(), float(level - slopes @ mean)])
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(solve, "array<double>")


def cross_validate_ridge(df: DataFrame, key: str, features: list[str], target: str, fold: str, groups: list[str] = (), alpha: float = 1.0) -> DataFrame:
    """What cross_validate() gives with RidgeProbe, from sums of products: no task holds a fold or a group.

    One aggregate gives each fold's sums; a fold's training sums are those of its group less its own; each fit solves a system
    as wide as the features, and rows get their fold's coefficients by a join with a row for each group and fold.
    """
    k = range(len(features))
    rows = df.dropna(subset=[*features, target, fold]).select(*groups, key, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    x = [F.col(f"__x{i}") for i in k]
    parts = {"n": F.count(F.lit(1)).cast("double"), "sy": F.sum("y")} | {f"x{i}": F.sum(x[i]) for i in k} | {f"y{i}": F.sum(x[i] * F.col("y")) for i in k} | {f"x{i}_{j}": F.sum(x[i] * x[j]) for i in k for j in k if i <= j}
    sums = rows.groupBy(*groups, "fold").agg(*[c.alias(name) for name, c in parts.items()])
    rest = {name: F.sum(name).over(W.partitionBy(*groups)) - F.col(name) for name in parts}  # a row for each fold of a group
    train = sums.select(*groups, "fold", *[c.alias(name) for name, c in rest.items()])
    lists = F.array(*[f"x{i}" for i in k]), F.array(*[f"x{min(i, j)}_{max(i, j)}" for i in k for j in k]), F.col("sy"), F.array(*[f"y{i}" for i in k])
    fits = train.select(*groups, "fold", solved(alpha)(F.col("n"), *lists).alias("__w"))
    value = sum((F.col("__w")[i] * x[i] for i in k), F.col("__w")[len(features)])
    return rows.join(fits, [*groups, "fold"]).select(*groups, key, "fold", "y", value.alias("prediction"))


def out_of_fold_r2(predictions: DataFrame, groups: list[str] = ()) -> DataFrame:
    """groups, r2 of predictions against y, null for a constant y."""
    spread = F.nullif(F.var_pop("y"), F.lit(0.0))
    return predictions.groupBy(*groups).agg((1 - F.avg(F.pow(F.col("y") - F.col("prediction"), 2)) / spread).alias("r2"))


def assemble_crossfit(fits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, p): for a training row the fit that held it out, for a test row the mean of all fits.

    fits has key, part, p (one row for each fit and row); rows has key and held_part, null for test rows.
    """
    joined = fits.join(rows, key).where("held_part is null or held_part = part")
    return joined.groupBy(key).agg(F.avg("p").alias("p"))


def permuted_within(df: DataFrame, key: str, columns: list[str], strata: list[str], seed: int) -> DataFrame:
    """df with the columns' values moved together to other rows of the same stratum, in an order by hash; the key is a number."""
    token = F.sha2(F.concat(F.lit(f"[{seed},"), F.col(key).cast("string"), F.lit("]")), 256)
    rows = df.withColumn("__token", token)
    to = numbered(rows, strata, bucket_of(key, edges(df, key)), [F.col(key)], "__at")
    source = numbered(rows, strata, hash_bucket("__token"), [F.col("__token"), F.col(key)], "__at")
    source = source.select(*strata, *[F.col(c).alias(f"__{c}") for c in columns], "__at")
    same = to["__at"] == source["__at"]
    for s in strata:
        same = same & to[s].eqNullSafe(source[s])
    kept = [to[c] for c in df.columns if c not in columns]
    return to.join(source, same).select(*kept, *[F.col(f"__{c}").alias(c) for c in columns])


def permutation_importance(df: DataFrame, key: str, groups: dict[str, list[str]], strata: list[str], loss: Callable[[DataFrame], DataFrame], seed: int) -> DataFrame:
    """feature_group, increase: mean loss with a group's columns permuted within strata, less the mean loss as it is.

    loss gives a DataFrame with a column loss for a DataFrame of rows.
    """
    base = loss(df).agg(F.avg("loss").alias("base"))
    out = None
    for name, columns in sorted(groups.items()):
        moved = loss(permuted_within(df, key, columns, strata, seed)).agg(F.avg("loss").alias("moved")).withColumn("feature_group", F.lit(name))
        out = moved if out is None else out.unionByName(moved)
    return out.crossJoin(F.broadcast(base)).select("feature_group", (F.col("moved") - F.col("base")).alias("increase"))  # one row


def rule_quality(predictions: DataFrame, prediction: str, outcome: str, threshold: float = 0.0) -> DataFrame:
    """units, use_accuracy, regret of the rule to use what is predicted to gain more than the threshold."""
    use, good = F.col(prediction) > threshold, F.col(outcome) > threshold
    best, taken = F.greatest(F.col(outcome), F.lit(0.0)), F.when(use, F.col(outcome)).otherwise(0.0)
    return predictions.agg(F.count(F.lit(1)).alias("units"), F.avg((use == good).cast("double")).alias("use_accuracy"), F.avg(best - taken).alias("regret"))
