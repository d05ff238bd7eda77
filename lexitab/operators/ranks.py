"""Ranks, multiplicities and what is made of them: correlations that respect ties, top-k, samples, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, hash_bucket, numbered, running
from lexitab.session import written_once


def average_rank(value: str, *keys: str) -> Column:
    """Rank within the keys from 1; equal values share the mean of their places."""
    window = W.partitionBy(*keys)
    return F.rank().over(window.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def min_rank_desc(value: str, *keys: str) -> Column:
    """1 for the largest value; equal values share the smallest place."""
    return F.rank().over(W.partitionBy(*keys).orderBy(F.desc(value)))


def multiplicity(*keys: str) -> Column:
    """How many rows have this row's keys."""
    return F.count(F.lit(1)).over(W.partitionBy(*keys))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of the rows where both are known; null for fewer than two or a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    top = F.avg(a * b) - F.avg(a) * F.avg(b)
    below = F.sqrt(F.nullif(F.var_pop(a) * F.var_pop(b), F.lit(0.0)))
    return F.when(varies, top / below)


def with_average_rank(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Adds the average rank of value within the keys; ranks come from counts of equal values, bucket by bucket."""
    counts = written_once(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")))
    below = running(counts, list(keys), bucket_of(value, edges(counts, value)), [F.col(value)], {"__below": F.col("__n")}, before=True)
    ranks = below.select(*keys, value, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """keys, n, rho: Pearson correlation of average ranks over the rows where both are known; null where one is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = written_once(pairs.agg(F.count(F.lit(1)).alias("w")))  # equal pairs once
    ranked = pairs
    for c in ("x", "y"):
        counts = pairs.groupBy(*keys, c).agg(F.sum("w").alias("__n"))
        below = running(counts, list(keys), bucket_of(c, edges(counts, c)), [F.col(c)], {"__below": F.col("__n")}, before=True)
        ranked = ranked.join(below.select(*keys, c, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(f"r{c}")), [*keys, c])
    # Ranks are halves of whole numbers and their mean is (n + 1) / 2, so the sums are those of the rows one by one.
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(w * rx * ry).alias("xy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"))
    middle = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2))
    spread = (F.col("xx") - middle) * (F.col("yy") - middle)
    return sums.select(*keys, "n", ((F.col("xy") - middle) / F.sqrt(F.when(spread > 0, spread))).alias("rho"))


def kendall_tau_b(df: DataFrame, unit: str, x: str, y: str, *keys: str) -> DataFrame:
    """keys, tau: tie-corrected Kendall correlation from pairs of units; for tables of a few units a key."""
    left = df.select(*keys, F.col(unit).alias("u"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    right = df.select(*keys, F.col(unit).alias("v"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = left.join(right, list(keys)).where("u < v")
    dx, dy = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    sums = pairs.groupBy(*keys).agg(F.sum(dx * dy).alias("s"), F.sum(F.abs(dx)).alias("nx"), F.sum(F.abs(dy)).alias("ny"))
    return sums.select(*keys, (F.col("s") / F.sqrt(F.nullif(F.col("nx") * F.col("ny"), F.lit(0.0)))).alias("tau"))


def top_rows(df: DataFrame, k: int, order: list[Column], *keys: str) -> DataFrame:
    """The first k rows of each key; order must end in a unique column."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order."""
    return top_rows(df, 1, order, *keys).drop("place")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest SHA-256 of seed and key; the same rows for any partitioning."""
    return df.withColumn("token", _token(key, seed)).orderBy("token", key).limit(n).drop("token")


def _token(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"[{seed},"), F.col(key).cast("string"), F.lit("]")), 256)


def hash_folds(df: DataFrame, key: str, strata: list[str], folds: int, seed: int) -> DataFrame:
    """A fold for each row, even within each stratum, by hash order."""
    rows = numbered(df.withColumn("token", _token(key, seed)), strata, hash_bucket("token"), [F.col("token"), F.col(key)], "place")
    return rows.withColumn("fold", ((F.col("place") - 1) % folds).cast("int")).drop("token", "place")


def nested_order(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """Row numbers whose prefixes are nested samples: each stratum once first, then in proportion."""
    rows = numbered(df.withColumn("token", _token(key, seed)), [stratum], hash_bucket("token"), [F.col("token"), F.col(key)], "within")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")).withColumnRenamed(stratum, "__stratum")
    rows = rows.join(sizes, rows[stratum].eqNullSafe(sizes["__stratum"])).drop("__stratum")
    rows = rows.withColumn("share", F.round((F.col("within") - 0.5) / F.col("size"), 12)).withColumn("later", F.when(F.col("within") == 1, 0).otherwise(1))
    bucket = F.when(F.col("later") == 0, F.lit(-1)).otherwise(F.floor(F.col("share") * 1024))
    placed = numbered(rows, [], bucket, [F.col(c) for c in ("later", "share", "token", key)], "position")
    return placed.drop("token", "within", "share", "size", "later")


def neighbour_weights(pairs: DataFrame, point: str, distance: str, k: int) -> DataFrame:
    """Weight of each neighbour among the k nearest; those tied at the edge share what is left."""
    window = W.partitionBy(point)
    rows = pairs.withColumn("below", F.rank().over(window.orderBy(distance)) - 1).withColumn("ties", F.count(F.lit(1)).over(W.partitionBy(point, distance)))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - F.col("below")) / F.col("ties").cast("double")))
    return rows.withColumn("weight", weight).where("weight > 0").drop("below", "ties")
