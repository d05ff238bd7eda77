"""Running sums and numbers over a total order without one task per key.

Rows are cut into buckets that follow the order, each bucket's sums are added up over the few buckets before it, and only
what is left runs within a bucket. The edges are quantiles of the whole column, taken once and put into the plan as
numbers, so every evaluation cuts alike. There are as many buckets as the rows take, so the rows of a task stay about the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket, about, within the least and the largest number of buckets.
BUCKET_ROWS = 200_000
LEAST, MOST = 256, 4_096


def edges(df: DataFrame, column: str, least: int = LEAST) -> list[float]:
    """Distinct approximate quantiles of a numeric column: what separates the buckets."""
    value = F.col(column).cast("double")

    def taken(buckets: int):
        return df.agg(F.count(column).alias("n"), F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()

    row = taken(least)
    wanted = min(MOST, max(least, 1 << (row["n"] // BUCKET_ROWS).bit_length()))
    if wanted > least:  # only a table of many rows is read again
        row = taken(wanted)
    return sorted({float(x) for x in row["q"] or [] if math.isfinite(x)})


def bucket_of(column: str, at: list[float]) -> Column:
    """The number of edges at or below the value, by halving; 0 for null."""
    name = "`" + column.replace("`", "``") + "`"

    def among(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"IF(CAST({name} AS DOUBLE) >= {at[middle]!r}D, {among(middle + 1, high)}, {among(low, middle)})"

    if len(at) < LEAST:
        return F.expr(among(0, len(at)))
    # So many branches outgrow generated code: the same halving by steps over an array.
    value, points = F.col(name).cast("double"), F.array(*map(F.lit, at))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(at)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = (s["low"] < s["high"]) & F.coalesce(value >= F.get(points, middle), F.lit(False))
        return F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when((s["low"] < s["high"]) & ~above, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(at).bit_length())), start, halve, lambda s: s["low"])


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column], *, descending: bool = False, before: bool = False, how: str = "sum") -> DataFrame:
    """Adds a running sum (or min or max) of each column of sums within the keys, up to a row or (with before) up to the one before it.

    bucket must grow with the order (fall, with descending), and order must be total within a bucket up to rows that may change places.
    """
    fold, join = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}[how]
    rows = df.withColumn("__bucket", F.coalesce(bucket.cast("long"), F.lit(0)))
    for name, value in sums.items():
        rows = rows.withColumn(f"__{name}", value)
    totals = rows.groupBy(*keys, "__bucket").agg(*[fold(f"__{name}").alias(f"__{name}_t") for name in sums])
    by = F.desc("__bucket") if descending else F.asc("__bucket")
    earlier = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), *[fold(f"__{name}_t").over(earlier).alias(f"__{name}_s") for name in sums])
    same = rows["__bucket"] == starts["__b"]
    for k in keys:
        same = same & rows[k].eqNullSafe(starts[f"__k_{k}"])
    within = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = rows.join(starts, same)
    for name in sums:
        out = out.withColumn(name, join(F.col(f"__{name}_s"), fold(f"__{name}").over(within)))
    drop = ["__bucket", "__b", *[f"__k_{k}" for k in keys]] + [f"__{n}{x}" for n in sums for x in ("", "_s")]
    return out.drop(*drop)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds row numbers from 1 within the keys."""
    return running(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def hash_bucket(token: str) -> Column:
    """65,536 buckets that follow the order of a hexadecimal token."""
    return F.conv(F.substring(token, 1, 4), 16, 10)


def moving(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], frames: dict[str, tuple[int, int, Callable[[WindowSpec], Column]]], *, place: str | None = None, stretch: int = BUCKET_ROWS) -> DataFrame:
    """Adds a column for each of frames: (rows before, rows after, function of a window of those rows), within the keys and a total order.

    Rows are numbered first and cut into stretches of so many rows; a row is copied to every stretch that has rows whose frames reach it, so a
    frame may be longer than a stretch and no task holds a key. bucket follows the order as for running(). lag and lead are frames of as
    many rows as they look away; the functions find the row's number from 1 in the column __at. place names a column that keeps it.
    """
    at = "__at"
    rows = numbered(df, keys, bucket, order, at)
    before, after = max((f[0] for f in frames.values()), default=0), max((f[1] for f in frames.values()), default=0)
    own = F.floor((F.col(at) - 1) / stretch)
    # Rows at+before and at-after are the furthest whose frames hold this one.
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - 1 - after) / stretch)), F.floor((F.col(at) - 1 + before) / stretch))
    dealt = rows.withColumn("__own", own).withColumn("__stretch", F.explode(reach))
    within = W.partitionBy(*keys, "__stretch").orderBy(at)
    for name, (low, high, function) in frames.items():
        dealt = dealt.withColumn(name, function(within.rowsBetween(-low, high) if low or high else within.rowsBetween(0, 0)))
    out = dealt.where(F.col("__own") == F.col("__stretch")).drop("__own", "__stretch")
    return out.withColumnRenamed(at, place) if place else out.drop(at)


def tile(place: Column, rows: Column, tiles: int) -> Column:
    """The tile from 1 of a row's place among so many rows: tiles of equal size, the first ones a row larger where they don't go up."""
    small, rest = F.floor(rows / tiles), rows % tiles
    wide = rest * (small + 1)
    return F.when(place <= wide, F.floor((place - 1) / (small + 1)) + 1).otherwise(rest + F.floor((place - 1 - wide) / F.greatest(small, F.lit(1))) + 1).cast("int")


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], *keys: str) -> DataFrame:
    """keys and a column for each named quantile of a numeric column, interpolated between the two values about it; nulls don't count.

    Rows are counted by bucket, and only the buckets that hold a wanted place are put in order, so no buffer holds a key's values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__b", bucket_of("__v", edges(rows, "__v")))
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    sized = counts.withColumn("__all", F.sum("__n").over(W.partitionBy(*keys)))  # a row for each bucket
    sized = sized.withColumn("__before", F.sum("__n").over(W.partitionBy(*keys).orderBy("__b")) - F.col("__n"))
    places = {name: (F.col("__all") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    holds = F.lit(False)
    for place in places.values():
        for f in (F.floor, F.ceil):
            holds = holds | ((f(place) >= F.col("__before")) & (f(place) < F.col("__before") + F.col("__n")))
    wanted = sized.where(holds).select(*[F.col(k).alias(f"__t_{k}") for k in keys], F.col("__b").alias("__t"), "__before", "__all")
    same = rows["__b"] == wanted["__t"]
    for k in keys:
        same = same & rows[k].eqNullSafe(wanted[f"__t_{k}"])
    near = rows.join(wanted, same).groupBy(*keys, "__t", "__before", "__all", "__v").agg(F.count(F.lit(1)).alias("__n"))  # equal values once
    near = near.withColumn("__upto", F.col("__before") + F.sum("__n").over(W.partitionBy(*keys, "__t").orderBy("__v")))
    out = []
    for name, place in places.items():
        low, high = (F.min(F.when(F.col("__upto") > f(place), F.col("__v"))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * (F.max(place) - F.floor(F.max(place)))).alias(name))
    return near.groupBy(*keys).agg(*out)
