"""Corrections for many tests, random effects, and resampling by hash draws, which are the same for any partitioning."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, running
from lexitab.operators.ranks import average_rank, correlation
from lexitab.operators.validation import solved
from lexitab.session import written_once


def _by_value(df: DataFrame, p: str, keys: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """(keys, __p, __n, __upto, __m): each known p within keys, how often it comes, the rows up to it, and all known; and the order's bucket.

    df is read once: equal p are counted before they are ranked, and the counts are kept.
    """
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    counts = written_once(df.where(known).groupBy(*keys, F.col(p).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("__n")))
    bucket = bucket_of("__p", edges(counts, "__p"))
    upto = running(counts, list(keys), bucket, [F.col("__p")], {"__upto": F.col("__n")})
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__m")).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], "__m")
    return upto.join(sizes, _alike(upto, sizes, keys)).drop(*[f"__{i}" for i in range(len(keys))]), bucket


def _alike(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    """Keys of left equal columns __0, __1, ... of right, nulls too."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(right[f"__{i}"])
    return same


def _told(df: DataFrame, p: str, keys: tuple[str, ...], found: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value of the row of found that has its keys and p; null without p."""
    found = found.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], "__p", value.alias(name))
    same = _alike(df, found, keys) & (df[p].cast("double") == F.col("__p"))
    return df.join(found, same, "left").drop("__p", *[f"__{i}" for i in range(len(keys))])


def benjamini_hochberg(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """Adds q, the step-up false discovery rate within the keys; rows without p keep a null and don't count."""
    rows, bucket = _by_value(df, p, keys)
    # Of equal p the last has the lowest p * m / rank, and all of them take the lowest from there on.
    rows = running(rows, list(keys), bucket, [F.desc("__p")], {"__best": F.col("__p") * F.col("__m") / F.col("__upto")}, descending=True, how="min")
    return _told(df, p, keys, rows, "q", F.least(F.lit(1.0), F.col("__best")))


def holm(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """Adds adjusted, Holm's step-down p within the keys; rows without p keep a null and don't count."""
    rows, bucket = _by_value(df, p, keys)
    # Of equal p the first has the highest p * (m - rank + 1), and all of them take the highest up to there.
    rows = running(rows, list(keys), bucket, [F.col("__p")], {"__worst": F.col("__p") * (F.col("__m") - F.col("__upto") + F.col("__n"))}, how="max")
    return _told(df, p, keys, rows, "adjusted", F.least(F.lit(1.0), F.col("__worst")))


def random_effects(df: DataFrame, effect: str, variance: str, *keys: str, z: float = 1.959963984540054) -> DataFrame:
    """DerSimonian-Laird pooling: keys, k, pooled, se, tau2, i2, q, low, high, status (too_few_studies below two)."""
    w = 1 / F.col(variance)
    rows = df.where(F.col(effect).isNotNull() & (F.col(variance) > 0))
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col(effect)).alias("swy"), F.sum(w * F.col(effect) * F.col(effect)).alias("swyy"))
    first = first.withColumn("q", F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")))
    scale = F.nullif(F.col("sw") - F.col("sw2") / F.col("sw"), F.lit(0.0))
    first = first.withColumn("tau2", F.coalesce(F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / scale), F.lit(0.0)))
    join = list(keys)
    second = rows.join(first.select(*join, "tau2"), join) if join else rows.crossJoin(F.broadcast(first.select("tau2")))
    v = 1 / (F.col(variance) + F.col("tau2"))
    pooled = second.groupBy(*keys).agg((F.sum(v * F.col(effect)) / F.sum(v)).alias("pooled"), F.sqrt(1 / F.sum(v)).alias("se"))
    out = first.join(pooled, join) if join else first.crossJoin(pooled)
    enough = F.col("k") >= 2
    i2 = F.greatest(F.lit(0.0), F.when(F.col("q") > 0, (F.col("q") - (F.col("k") - 1)) / F.col("q")).otherwise(0.0))
    pick = lambda c: F.when(enough, c)
    return out.select(*join, "k", pick(F.col("pooled")).alias("pooled"), pick(F.col("se")).alias("se"), pick(F.col("tau2")).alias("tau2"), pick(i2).alias("i2"), pick(F.col("q")).alias("q"), pick(F.col("pooled") - z * F.col("se")).alias("low"), pick(F.col("pooled") + z * F.col("se")).alias("high"), F.when(enough, "ok").otherwise("too_few_studies").alias("status"))


def sign_resolution(n: Column) -> Column:
    """The smallest two-sided p that an exact sign test of n values can give."""
    return F.least(F.lit(1.0), F.pow(F.lit(2.0), 1 - n))


def _drawn(*parts: Column | str) -> Column:
    """A number below 2 ** 32 from the MD5 of the parts: the same draw for any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def bootstrap_mean(df: DataFrame, value: str, keys: list[str], order: list[str], *, draws: int = 2000, seed: int = 20261120) -> DataFrame:
    """keys, n, mean, low, high: 2.5 and 97.5 percentiles of the means of draws resamples; nulls don't count.

    Rows are numbered within the (not null) keys by order; the row of slot i in draw d is MD5(seed:d:i) modulo n. For tables of a
    statistic for each unit (datasets, folds): draws times their rows are joined and averaged on the executors.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long").alias("__at"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"))
    slots = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("__draw"))
    slots = slots.select(*keys, "n", "__draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("__slot"))
    slots = slots.withColumn("__at", _drawn(F.lit(str(seed)), "__draw", "__slot") % F.col("n"))
    means = slots.join(known, [*keys, "__at"]).groupBy(*keys, "__draw").agg(F.avg("__v").alias("__m"))
    ends = means.groupBy(*keys).agg(F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))
    every = df.select(*keys).distinct()
    out = every.join(sizes.join(ends, keys) if keys else sizes.crossJoin(F.broadcast(ends)), keys, "left") if keys else sizes.crossJoin(F.broadcast(ends))  # one row
    return out.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "low", "high")


def _ranked_columns(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """The rows on which all columns are known, with their average ranks within the keys in place of them; units are few."""
    rows = df.dropna(subset=columns)
    return rows.withColumns({c: average_rank(c, *keys) for c in columns})


def permutation_spearman(df: DataFrame, x: str, y: str, keys: list[str], order: list[str], *, permutations: int = 5000, seed: int = 20261120, least: int = 4) -> DataFrame:
    """keys, n, rho, p, status: two-sided (1 + hits) / (1 + permutations); null with a status for few or constant rows.

    A permutation puts the ranks of x in the order of MD5(seed:permutation:row number). For tables of a few units a key.
    """
    ranked = _ranked_columns(df, [x, y], keys)
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    lists = ranked.withColumn("__at", at).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("rho"), F.array_sort(F.collect_list(F.struct("__at", F.col(x).alias("x"), F.col(y).alias("y")))).alias("__rows"))
    each = lists.where((F.col("n") >= least) & F.col("rho").isNotNull()).withColumn("__p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    moved = F.array_sort(F.transform("__rows", lambda r: F.struct(_drawn(F.lit(str(seed)), F.col("__p"), r["__at"]).alias("h"), r["__at"].alias("a"), r["x"].alias("x"))))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    mean = (F.col("n") + 1) / 2.0  # of ranks, ties or none
    spread = lambda c: total(F.transform("__rows", lambda r: F.pow(r[c] - mean, 2)))
    each = each.select(*keys, "rho", (total(F.zip_with(moved, "__rows", lambda m, r: (m["x"] - mean) * (r["y"] - mean))) / F.sqrt(spread("x") * spread("y"))).alias("__r"))
    hits = each.groupBy(*keys).agg(F.count_if(F.abs("__r") >= F.abs("rho") - 1e-12).alias("__hits"))
    lists = lists.drop("__rows")
    every = df.select(*keys).distinct().join(lists, keys, "left").join(hits, keys, "left") if keys else lists.join(hits, F.lit(True), "left")  # one row
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = F.when(n < least, "too_few_rows").when(F.col("rho").isNull(), "constant_input").otherwise("ok")
    return every.select(*keys, n.alias("n"), F.when(n >= least, F.col("rho")).alias("rho"), ((1 + F.col("__hits")) / F.lit(1.0 + permutations)).alias("p"), status.alias("status"))


def partial_spearman(df: DataFrame, x: str, y: str, controls: list[str], keys: list[str]) -> DataFrame:
    """keys, n, rho: correlation of the ranks of x and y with those of the controls held fixed; null for fewer than controls + 3 rows, or where controls tell all.

    From the inverse of the correlation matrix of ranks, whose entries are one aggregate, whatever the number of rows.
    """
    names = [x, y, *controls]
    ranked = _ranked_columns(df, names, keys)
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[correlation(names[i], names[j]) for i, j in pairs]).alias("__r"))

    def fixed(correlations: pa.Array) -> pa.Array:
        out = []
        for known in correlations.to_pylist():
            matrix = np.eye(len(names))
            if known is None or None in known:
                out.append(None)
                continue
            for (i, j), r in zip(pairs, known):
                matrix[i, j] = matrix[j, i] = r
            # What the controls leave of x and of y.
            rest = matrix[:2, :2] - matrix[:2, 2:] @ np.linalg.pinv(matrix[2:, 2:], hermitian=True) @ matrix[2:, :2] if controls else matrix
            left = rest[0, 0] * rest[1, 1]
            out.append(float(rest[0, 1] / math.sqrt(left)) if min(rest[0, 0], rest[1, 1]) > 1e-12 else None)
        return pa.array(out, pa.float64())

    every = df.select(*keys).distinct().join(sums, keys, "left") if keys else sums
    every = every.withColumn("__rho", F.arrow_udf(fixed, "double")("__r"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.select(*keys, n.alias("n"), F.when(n >= len(controls) + 3, F.col("__rho")).alias("rho"))


def wilcoxon_signed_rank(df: DataFrame, value: str, keys: list[str], *, exact_up_to: int = 50) -> DataFrame:
    """keys, n, w, p: two-sided signed-rank test of zero; zeros are left out. Exact without ties, else the normal limit."""
    d = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(*keys, F.col(value).cast("double").alias("__d")).withColumn("__size", F.abs("__d"))
    ranked = d.withColumn("__rank", average_rank("__size", *keys)).withColumn("__same", F.count(F.lit(1)).over(W.partitionBy(*keys, "__size")))
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("__d") > 0, F.col("__rank")).otherwise(0.0)).alias("__plus"), F.sum((F.pow("__same", F.lit(2)) - 1)).alias("__ties"))
    n = F.col("n").cast("double")
    sums = sums.withColumn("w", F.least(F.col("__plus"), n * (n + 1) / 2 - F.col("__plus")))
    # How many sets of the ranks 1 to n have each sum; the rank r is added to the sums below it.
    most = (F.col("n") * (F.col("n") + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), most), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    add = lambda ways, r: F.transform(ways, lambda v, s: v + F.when(s >= r, F.get(ways, (s - r).cast("int"))).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), start, add)
    below = F.aggregate(F.slice(ways, 1, F.floor("w").cast("int") + 1), F.lit(0.0), lambda a, v: a + v)
    exact = F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48
    far = F.abs(F.col("w") - n * (n + 1) / 4) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    limit = F.coalesce(two_sided_normal(far), F.lit(1.0))
    p = F.when((F.col("n") <= exact_up_to) & (F.col("__ties") == 0), exact).otherwise(limit)
    tested = sums.select(*keys, "n", "w", p.alias("p"))
    if not keys:
        return tested.select("n", "w", F.when(F.col("n") > 0, F.col("p")).alias("p"))
    return df.select(*keys).distinct().join(tested, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "w", "p")


def two_sided_normal(z: Column) -> Column:
    """The chance that a normal value lies z standard deviations or further from its mean."""

    def tail(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.erfc(v / math.sqrt(2)) for v in values.to_pylist()], pa.float64())

    return F.arrow_udf(tail, "double")(z)


def ridge_leave_one_out(df: DataFrame, unit: str, features: list[str], outcome: str, keys: list[str], *, alpha: float = 1.0) -> DataFrame:
    """keys, unit, prediction: each unit predicted by a standardised ridge regression on all others of its key; null for fewer than two others.

    One aggregate gives each key's sums of products; a unit's fit comes from those sums less its own products, so no task holds a key.
    """
    k = range(len(features))
    x, y = [F.col(c).cast("double") for c in features], F.col(outcome).cast("double")
    own = {"n": F.lit(1.0), "sy": y} | {f"x{i}": x[i] for i in k} | {f"y{i}": x[i] * y for i in k} | {f"x{i}_{j}": x[i] * x[j] for i in k for j in k if i <= j}
    rows = df.select(*keys, unit, *[c.alias(f"__{name}") for name, c in own.items()])
    sums = rows.groupBy(*keys).agg(*[F.sum(f"__{name}").alias(f"__s_{name}") for name in own])
    sums = sums.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)], *[f"__s_{name}" for name in own])
    both = rows.join(sums, _alike(rows, sums, tuple(keys))) if keys else rows.crossJoin(F.broadcast(sums))  # one row
    rest = {name: F.col(f"__s_{name}") - F.col(f"__{name}") for name in own}
    lists = F.array(*[rest[f"x{i}"] for i in k]), F.array(*[rest[f"x{min(i, j)}_{max(i, j)}"] for i in k for j in k]), rest["sy"], F.array(*[rest[f"y{i}"] for i in k])
    fits = both.withColumn("__w", solved(alpha)(F.when(rest["n"] >= 2, rest["n"]), *lists))
    value = sum((F.col("__w")[i] * F.col(f"__x{i}") for i in k), F.col("__w")[len(features)])
    return fits.select(*keys, unit, value.alias("prediction"))


def pairs_of(names: list[str]) -> list[tuple[str, str]]:
    """All pairs of names, in order."""
    return list(itertools.combinations(sorted(names), 2))
