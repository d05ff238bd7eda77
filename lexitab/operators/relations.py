"""Relations between two distances over the same points, by group: correlation of pair distances, its permutation null, neighbours.

Points are numbered within their group, and all pairs come from products of blocks of points: a task sees two blocks. Ranks are taken
once; a permutation only says which pair's rank goes with which, so its correlation is one join and one sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, running
from lexitab.session import written_once

#: Points of a block.
BLOCK = 128
#: Places for neighbours, permutations of the null, and parts left out one at a time: fixed values of the semantics.
NEIGHBOURS, PERMUTATIONS, PARTS = 10, 19, 8
#: Distances are rounded to so many digits, so that ties don't hang on the order of a sum.
DIGITS = 9


def token(seed: Column | int, key: Column) -> Column:
    """An order of rows that depends on seed and key alone."""
    return F.sha2(F.concat(F.lit("["), (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), F.lit(","), key.cast("string"), F.lit("]")), 256)


def distances(kind: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of all rows of left and right: cosine, or total_variation for probabilities."""
    if kind == "cosine":
        norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - left @ right.T / norms
    if kind == "total_variation":
        return np.abs(left[:, None, :] - right[None, :, :]).sum(axis=2) / 2
    raise ValueError(f"unknown distance {kind}")


def pairs_of_points(rows: DataFrame, id_column: str, group: str, vectors: dict[str, str], *, points: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(points, pairs): (group, id, at) of the points taken, and (group, a, b, a distance for each of vectors), a < b, by their places at.

    vectors says which distance each vector column takes. A group gives so many points at most, those of the smallest token; that sample is
    the operator's feature, and its pairs, up to points * (points - 1) / 2 a group, are all compared. Vectors must be known.
    """
    names = list(vectors)
    known = rows.where(F.col(group).isNotNull())
    for name in names:
        known = known.where(F.col(name).isNotNull())
    placed = known.select(group, F.col(id_column).alias("id"), *[F.col(n).cast("array<double>").alias(n) for n in names], token(seed, F.col(id_column)).alias("__token"))
    first = W.partitionBy(group).orderBy("__token", "id")
    # A group's first rows by token come from the first rows of each of its stretches.
    placed = placed.withColumn("__stretch", F.substring("__token", 1, 2)).withColumn("__n", F.row_number().over(W.partitionBy(group, "__stretch").orderBy("__token", "id"))).where(F.col("__n") <= points)
    placed = placed.withColumn("at", F.row_number().over(first) - 1).where(F.col("at") < points).drop("__token", "__stretch", "__n")
    placed = written_once(placed)
    last = placed.groupBy(F.col(group).alias("__g")).agg(F.floor(F.max("at") / BLOCK).cast("int").alias("__last"))
    own = F.floor(F.col("at") / BLOCK).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("__last")), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    dealt = placed.join(last, placed[group] == F.col("__g")).select(*placed.columns, F.explode(tasks).alias("t")).select(*placed.columns, "t.i", "t.j")

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        at = np.array(part.column("at"))
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        left, right = (np.flatnonzero(at // BLOCK == k) for k in (i, j))
        columns = [np.array(part.column(n).combine_chunks().flatten(), float).reshape(len(at), -1) for n in names]
        keep = at[left][:, None] < at[right][None, :]
        a, b = np.nonzero(keep)
        found = [distances(vectors[n], x[left], x[right])[keep].round(DIGITS) for n, x in zip(names, columns)]
        group_of = pa.array([part.column(group)[0].as_py()] * len(a), part.schema.field(group).type)
        return pa.table([group_of, pa.array(at[left][a], pa.int32()), pa.array(at[right][b], pa.int32()), *[pa.array(np.where(np.isfinite(d), d, np.nan)) for d in found]], [group, "a", "b", *names])

    kind = placed.schema[group].dataType.simpleString()
    pairs = dealt.groupBy(group, "i", "j").applyInArrow(compare, f"`{group}` {kind}, a int, b int, " + ", ".join(f"`{n}` double" for n in names))
    return placed.select(group, "id", "at"), pairs


def _ranked(pairs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """pairs, a written table, with the average rank of each column within keys in place of its value."""
    for c in columns:
        counts = written_once(pairs.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n")))
        below = running(counts, keys, bucket_of(c, edges(counts, c)), [F.col(c)], {"__below": F.col("__n")}, before=True)
        pairs = pairs.join(below.select(*keys, c, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(f"__r_{c}")), [*keys, c]).drop(c).withColumnRenamed(f"__r_{c}", c)
    return pairs


def _correlation(rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, n, rho of ranks, whose sums are exact; null where one is constant."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    middle = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2))
    spread = (F.col("xx") - middle) * (F.col("yy") - middle)
    return sums.select(*keys, "n", ((F.col("xy") - middle) / F.sqrt(F.when(spread > 0, spread))).alias("rho"))


def distance_relation(points: DataFrame, pairs: DataFrame, group: str, x: str, y: str, *, seed: int = 42, permutations: int = PERMUTATIONS, parts: int = PARTS) -> DataFrame:
    """group, points, pairs, rho, null_mean, p, low, high, status: how the distances x and y of a group's pairs go together.

    rho is Spearman's; the null permutes which points y's rows and columns belong to, so many times, each in the order of a token of
    seed + its number; p is two-sided, (1 + hits) / (1 + permutations). low and high are the least and largest rho with one of parts
    of the points left out (those of the same place modulo parts). Groups of fewer than 3 points, or with a constant distance, get the
    status undefined and nulls.
    """
    pairs = written_once(pairs.where(~F.isnan(x) & ~F.isnan(y)).select(group, "a", "b", x, y))
    ranked = written_once(_ranked(pairs, [group], [x, y]))
    base = _correlation(ranked, [group], F.col(x), F.col(y)).withColumnRenamed("n", "pairs")
    draws = points.select(group, "id", "at", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("draw"))
    # The point at place k becomes the one that is k-th in the draw's order.
    order = W.partitionBy(group, "draw").orderBy(token(F.lit(seed) + F.col("draw"), F.col("id")), "id")
    moved = draws.select(group, "draw", F.col("at").alias("new"), (F.row_number().over(order) - 1).alias("old"))
    ends = [moved.select(group, "draw", F.col("old").alias(end), F.col("new").alias(f"new_{end}")) for end in ("a", "b")]
    relabelled = ranked.select(group, "a", "b", F.col(y).alias("y")).join(ends[0], [group, "a"]).join(ends[1], [group, "draw", "b"])
    relabelled = relabelled.select(group, "draw", F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"), "y")
    null = _correlation(ranked.select(group, "a", "b", F.col(x).alias("x")).join(relabelled, [group, "a", "b"]), [group, "draw"], F.col("x"), F.col("y"))
    null = null.join(base.select(group, F.col("rho").alias("own")), group).groupBy(group).agg(F.avg("rho").alias("null_mean"), F.count_if(F.abs("rho") >= F.abs("own") - 1e-12).alias("hits"))
    part = F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: (F.col("a") % parts != k) & (F.col("b") % parts != k)))
    kept = written_once(pairs.select(group, part.alias("part"), x, y))
    ranges = _correlation(_ranked(kept, [group, "part"], [x, y]), [group, "part"], F.col(x), F.col(y)).groupBy(group).agg(F.min("rho").alias("low"), F.max("rho").alias("high"))
    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("points"))
    out = sizes.join(base, group, "left").join(null, group, "left").join(ranges, group, "left")
    measured = (F.col("points") >= 3) & F.col("rho").isNotNull()
    told = {"rho": F.col("rho"), "null_mean": F.col("null_mean"), "p": (1 + F.col("hits")) / F.lit(1.0 + permutations), "low": F.col("low"), "high": F.col("high")}
    return out.select(group, "points", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), *[F.when(measured, c).alias(n) for n, c in told.items()], F.when(measured, "measured").otherwise("undefined").alias("status"))


def neighbour_agreement(points: DataFrame, pairs: DataFrame, group: str, x: str, y: str, *, neighbours: int = NEIGHBOURS) -> DataFrame:
    """group, k, overlap, chance: the shared weight of each point's k nearest by x and by y, over k.

    k is neighbours, or half of the other points where they are fewer; points tied at the edge share what is left of it.
    """
    sizes = points.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.where("n >= 2").withColumn("k", F.least(F.lit(neighbours), F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 2))).cast("int"))
    both = pairs.select(group, F.col("a").alias("point"), x, y).union(pairs.select(group, F.col("b").alias("point"), x, y))
    both = both.join(sizes, both[group] == sizes["__g"]).drop("__g")

    def weight(c: str) -> Column:
        below = F.rank().over(W.partitionBy(group, "point").orderBy(c)) - 1
        ties = F.count(F.lit(1)).over(W.partitionBy(group, "point", c))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") - below) / ties))

    weights = both.select(group, "n", "k", weight(x).alias("wx"), weight(y).alias("wy"))
    return weights.groupBy(group, "n", "k").agg(F.sum(F.col("wx") * F.col("wy")).alias("s")).select(group, "k", (F.col("s") / (F.col("n") * F.col("k"))).alias("overlap"), (F.col("k") / (F.col("n") - 1)).alias("chance"))
