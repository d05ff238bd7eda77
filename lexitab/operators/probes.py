"""Logistic probes of all folds at once: each Newton step is one pass over the rows and one sum for each fit.

A fit is told by its test fold, the inner part that it leaves out (none for the last fit), and its penalty. A task adds up gradients
and Hessians of every fit over the rows it has, whichever folds they are in, so no task holds a fold; executors add up
those sums and solve for the steps, so only models reach the driver: one row of weights for each fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, exact_quantiles, running
from lexitab.operators.validation import C_GRID, CROSSFIT_PARTS
from lexitab.session import written_once

#: Newton steps at most, and the largest change of a weight that ends them.
STEPS, SMALL = 50, 1e-10
#: Penalty of the intercept, so that a step has a solution.
_FREE = 1e-9


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(z - z.max(axis=1, keepdims=True), -60, 0))
    return e / e.sum(axis=1, keepdims=True)


def _probabilities(w: np.ndarray, z: np.ndarray, classes: int) -> np.ndarray:
    """Rows of class probabilities; two classes have one weight vector, more have one each."""
    if classes == 2:
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return np.column_stack([1 - p, p])
    return _softmax(z @ w.reshape(classes, -1).T)


def _sums(w: np.ndarray, z: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss over rows z of classes y, without penalties."""
    p = _probabilities(w, z, classes)
    if classes == 2:
        q = p[:, 1]
        return z.T @ (q - y), (z * (q * (1 - q))[:, None]).T @ z
    wide = z.shape[1]
    gap = p.copy()
    gap[np.arange(len(y)), y] -= 1
    hessian = np.empty((classes * wide, classes * wide))
    for a in range(classes):
        for b in range(a, classes):
            part = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
            hessian[a * wide : (a + 1) * wide, b * wide : (b + 1) * wide] = part
            hessian[b * wide : (b + 1) * wide, a * wide : (a + 1) * wide] = part
    return (gap.T @ z).ravel(), hessian


def _steps(told: dict[int, tuple[np.ndarray, np.ndarray]], size: int):
    """A column function: the Newton step of each fit from its gradient and Hessian; told has its weights and penalties."""

    def solve(fit: pa.Array, values: pa.Array) -> pa.Array:
        steps = []
        for i, v in zip(fit.to_pylist(), values.to_pylist()):
            w, penalty = told[i]
            v = np.array(v)
            steps.append(np.linalg.solve(v[size:].reshape(size, size) + np.diag(penalty), v[:size] + penalty * w).tolist())
        return pa.array(steps, pa.list_(pa.float64()))

    return F.arrow_udf(solve, "array<double>")


class Probes:
    """The rows of a study, and what is fitted on them.

    Rows have key, fold, y (0, 1, ...), x (array of features) and part (for each test fold the row's part among its training rows, -1
    where it is tested). scales has each test fold's feature means, deviations and class shares.
    """

    def __init__(self, rows: DataFrame, folds: list[int], scales: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], classes: int):
        self.rows, self.folds, self.scales, self.classes = rows, folds, scales, classes

    def _pass(self, each) -> DataFrame:
        """Rows (fit, values) that each(z, y, part, fold number) gives, over the training or test rows of each fold in each batch, added up by fit and place."""
        folds, scales = self.folds, self.scales

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                y = np.array(batch.column("y"), int)
                parts = np.array(batch.column("part").flatten(), int).reshape(batch.num_rows, -1)
                for number, fold in enumerate(folds):
                    mean, scale, _ = scales[fold]
                    some = parts[:, number] >= 0
                    z = np.column_stack([(x[some] - mean) / scale, np.ones(int(some.sum()))])
                    for fit, values in each(z, y[some], parts[some, number], number):
                        held[fit] = held[fit] + values if fit in held else values
            for fit, values in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([values], pa.list_(pa.float64()))], ["fit", "values"])

        parts = self.rows.select("x", "y", "part").mapInArrow(run, "fit int, values array<double>")
        summed = parts.select("fit", F.posexplode("values").alias("at", "v")).groupBy("fit", "at").agg(F.sum("v").alias("v"))
        return summed.groupBy("fit").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("values"))

    def fitted(self, fits: list[tuple[int, int, float]]) -> list[np.ndarray | None]:
        """Weights of each fit (fold number, part left out or -1, C); None where its training rows have one class only."""
        classes = self.classes
        wide = len(next(iter(self.scales.values()))[0]) + 1
        size = wide * (1 if classes == 2 else classes)
        seen = {r["fit"]: np.array(r["values"]) for r in self._pass(lambda z, y, part, number: [(number * (CROSSFIT_PARTS + 1) + out + 1, np.bincount(y[part != out], minlength=classes).astype(float)) for out in range(-1, CROSSFIT_PARTS)]).collect()}
        weights: list[np.ndarray | None] = [np.zeros(size) if (seen.get(number * (CROSSFIT_PARTS + 1) + out + 1, np.zeros(1)) > 0).sum() > 1 else None for number, out, _ in fits]
        penalties = [np.tile(np.append(np.full(wide - 1, 1 / c), _FREE), size // wide) for _, _, c in fits]
        moving = [i for i, w in enumerate(weights) if w is not None]
        for _ in range(STEPS):
            if not moving:
                break
            here, told = {i: (weights[i], *fits[i][:2]) for i in moving}, {i: (weights[i], penalties[i]) for i in moving}

            def each(z, y, part, number, here=here):
                for i, (w, of, out) in here.items():
                    if of == number:
                        some = part != out
                        gradient, hessian = _sums(w, z[some], y[some], classes)
                        yield i, np.concatenate([gradient, hessian.ravel()])

            found = self._pass(each).select("fit", _steps(told, size)("fit", "values").alias("step")).collect()
            moving = []
            for r in found:
                weights[r["fit"]] = weights[r["fit"]] - np.array(r["step"])
                if np.abs(r["step"]).max() >= SMALL:
                    moving.append(r["fit"])
        return weights

    def losses(self, fits: list[tuple[int, int, float]], weights: list[np.ndarray | None]) -> dict[tuple[int, float], float]:
        """For each fold number and C, the log loss of the training rows, each by the fit that left its part out."""
        classes, priors = self.classes, [self.scales[f][2] for f in self.folds]
        grid = sorted({c for _, _, c in fits})

        def each(z, y, part, number):
            for i, (of, out, c) in enumerate(fits):
                if of != number:
                    continue
                some = part == out
                p = np.tile(priors[number], (int(some.sum()), 1)) if weights[i] is None else _probabilities(weights[i], z[some], classes)
                p = np.clip(p[np.arange(len(p)), y[some]], 1e-15, 1 - 1e-15)
                yield number * len(grid) + grid.index(c), np.array([-np.log(p).sum(), float(len(p))])

        return {(r["fit"] // len(grid), grid[r["fit"] % len(grid)]): r["values"][0] / r["values"][1] for r in self._pass(each).collect() if r["values"][1]}


def _with_parts(df: DataFrame, key: str, folds: list[int]) -> DataFrame:
    """Adds part: for each of folds the row's place by key among the rows of other folds, modulo CROSSFIT_PARTS; -1 in that fold."""
    before = {f"__f{i}": (F.col("fold") == f).cast("long") for i, f in enumerate(folds)} | {"__all": F.lit(1).cast("long")}
    rows = running(df, [], bucket_of(key, edges(df, key)), [F.col(key)], before, before=True)
    place = lambda i: F.coalesce("__all", F.lit(0)) - F.coalesce(f"__f{i}", F.lit(0))
    parts = [F.when(F.col("fold") == f, -1).otherwise(place(i) % CROSSFIT_PARTS).cast("int") for i, f in enumerate(folds)]
    return rows.withColumn("part", F.array(*parts)).drop(*before)


def equal_frequency_bins(df: DataFrame, target: str, fold: str, bins: int = 9) -> DataFrame:
    """fold, edges: the bins - 1 inner quantiles of the target over the rows of all other folds, as a sorted array; nulls don't count.

    A row's bin is the number of edges at or below its target (see bin_of()).
    """
    known = df.where(F.col(target).isNotNull()).select(F.col(fold).alias("fold"), F.col(target).cast("double").alias("y"))
    folds = known.select("fold").distinct()
    others = known.withColumnRenamed("fold", "__own").join(folds, F.col("__own") != F.col("fold"))
    found = exact_quantiles(others, "y", {f"q{i}": i / bins for i in range(1, bins)}, "fold")
    return found.select("fold", F.array(*[f"q{i}" for i in range(1, bins)]).alias("edges"))


def bin_of(value: str, at: str):
    """How many of the edges in an array column are at or below the value; null for a null value."""
    return F.when(F.col(value).isNotNull(), F.size(F.filter(at, lambda e: e <= F.col(value))))


def cross_validated_logistic(df: DataFrame, key: str, features: list[str], target: str, fold: str, *, classes: int = 2, grid: tuple[float, ...] = C_GRID) -> DataFrame:
    """key, fold, y, c, p (array of class probabilities): each row predicted by a standardised L2 logistic fit on the other folds.

    The target counts classes from 0. A fold's C is the one of grid with the lowest log loss over CROSSFIT_PARTS parts of its training
    rows (by place of key, a number); the smaller C wins a tie. Training rows of one class only give the class shares. Rows with a null are left
    out. For two classes p[1] is what LogisticProbe predicts; more classes are fitted jointly, each with weights of its own.
    """
    picked = df.dropna(subset=[*features, target, fold]).select(key, F.col(fold).cast("int").alias("fold"), F.col(target).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    sums = picked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(features))], *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(len(features))], *[F.count_if(F.col("y") == k).alias(f"c{k}") for k in range(classes)]).orderBy("fold").collect()  # a row for each fold
    folds = [r["fold"] for r in sums]
    kind = df.schema[key].dataType.simpleString()
    result = f"`{key}` {kind}, fold int, y int, c double, p array<double>"
    scales = {}
    for f in folds:
        rest = [r for r in sums if r["fold"] != f]
        n = np.array([r["n"] for r in rest], float)
        if not len(n):
            scales[f] = (np.zeros(len(features)), np.ones(len(features)), np.full(classes, np.nan))
            continue
        means, variances = (np.array([[r[f"{c}{i}"] for i in range(len(features))] for r in rest]) for c in "mv")
        mean = n @ means / n.sum()
        scale = np.sqrt(n @ (variances + (means - mean) ** 2) / n.sum())
        scales[f] = (mean, np.where(scale > 0, scale, 1.0), np.array([sum(r[f"c{k}"] for r in rest) for k in range(classes)]) / n.sum())
    if not folds:
        return picked.sparkSession.createDataFrame([], result)
    rows = written_once(_with_parts(picked, key, folds))
    probes = Probes(rows, folds, scales, classes)
    numbers = range(len(folds))
    inner = [(f, k, c) for f in numbers for c in grid for k in range(CROSSFIT_PARTS)]
    losses = probes.losses(inner, probes.fitted(inner))
    chosen = [min(grid, key=lambda c, f=f: (losses.get((f, c), np.inf), c)) for f in numbers]
    weights = probes.fitted([(f, -1, chosen[f]) for f in numbers])

    def predict(batches):
        for batch in batches:
            x = np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            own = np.array(batch.column("fold"), int)
            p, c = np.empty((len(x), classes)), np.full(len(x), np.nan)
            for number, f in enumerate(folds):
                some = own == f
                mean, scale, prior = scales[f]
                fitted = weights[number] is not None
                p[some] = _probabilities(weights[number], np.column_stack([(x[some] - mean) / scale, np.ones(int(some.sum()))]), classes) if fitted else prior
                c[some] = chosen[number] if fitted else np.nan
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("fold"), batch.column("y"), pa.array(c, from_pandas=True), pa.array(list(p), pa.list_(pa.float64()))], [key, "fold", "y", "c", "p"])

    return rows.select(key, "fold", "y", "x").mapInArrow(predict, result)


def chosen_thresholds(predictions: DataFrame, fold: str, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """fold, threshold, f1: for each test fold the threshold of the highest F1 on the predictions of all other folds; the lowest wins a tie.

    One pass counts true and false positives for each fold and threshold; a fold's training counts are all counts less its own.
    """
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = predictions.select(F.col(fold).alias("fold"), F.col(y).alias("y"), F.col(p).alias("p"), at)
    hit = F.col("p") >= F.col("threshold")
    counts = rows.groupBy("fold", "threshold").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))
    every = counts.groupBy("threshold").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    rest = {c: F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn")}
    f1 = F.coalesce(2 * rest["tp"] / F.nullif(2 * rest["tp"] + rest["fp"] + rest["fn"], F.lit(0)), F.lit(0.0))
    best = counts.join(every, "threshold").select("fold", "threshold", F.round(f1, 12).alias("f1"))
    return best.groupBy("fold").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("b")).select("fold", (-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"))
