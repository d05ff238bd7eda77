"""Paired comparisons over folds: gains over a baseline, balanced means, medians over models, wins and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the semantics.
TIE_TOLERANCE = 0.001
HEADROOM_FLOOR = 0.001
FOLDS = 5


def complete_arms(folds: DataFrame, keys: list[str], count: int = FOLDS) -> DataFrame:
    """The rows of arms that have a value in each of count distinct folds, and in no fold two."""
    per = folds.groupBy(*keys).agg(F.count("value").alias("values"), F.countDistinct("fold").alias("kinds"))
    whole = per.where((F.col("values") == count) & (F.col("kinds") == count)).select(*keys)
    return folds.join(whole, keys, "left_semi")


def fold_gains(folds: DataFrame, baseline: Column, pair_keys: list[str], arm: str = "arm") -> DataFrame:
    """Each other arm's rows beside the baseline's of the same pair keys: pair_keys, arm, value, base, difference."""
    base = folds.where(baseline).select(*pair_keys, F.col("value").alias("base"))
    arms = folds.where(~baseline).select(*pair_keys, arm, "value")
    return arms.join(base, pair_keys).withColumn("difference", F.col("value") - F.col("base"))


def headroom_gains(paired: DataFrame, keys: list[str]) -> DataFrame:
    """keys, raw_gain, gain (raw over what was left to 1, at least HEADROOM_FLOOR), variance of the folds' differences, folds."""
    raw = F.avg("value") - F.avg("base")
    left = F.greatest(1 - F.avg("base"), F.lit(HEADROOM_FLOOR))
    return paired.groupBy(*keys).agg(raw.alias("raw_gain"), (raw / left).alias("gain"), F.var_samp("difference").alias("variance"), F.count("difference").alias("folds"))


def median_over_models(gains: DataFrame, keys: list[str], value: str, model: str = "model", required: int | None = None) -> DataFrame:
    """keys, median, models where every model of the table (or required many) is present."""
    wanted = F.lit(required) if required else gains.select(F.countDistinct(model)).scalar()
    per = gains.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.countDistinct(model).alias("models"))
    return per.where(F.col("models") == wanted)


def balanced_mean(df: DataFrame, by: list[str], dataset: str, value: str) -> DataFrame:
    """by, mean, datasets: means within datasets first, then over datasets with equal weight."""
    inner = df.where(F.col(value).isNotNull()).groupBy(*by, dataset).agg(F.avg(value).alias("inner"))
    return inner.groupBy(*by).agg(F.avg("inner").alias("mean"), F.count(F.lit(1)).alias("datasets"))


def wins_ties_losses(gains: DataFrame, keys: list[str], value: str = "raw_gain", tie: float = TIE_TOLERANCE) -> DataFrame:
    """keys, units, mean, wins, ties, losses."""
    v = F.col(value)
    return gains.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.avg(v).alias("mean"), F.count_if(v > tie).alias("wins"), F.count_if(F.abs(v) <= tie).alias("ties"), F.count_if(v < -tie).alias("losses"))


def present_everywhere(df: DataFrame, unit: str, member: str) -> DataFrame:
    """The rows of units that have every member of the table (relational division)."""
    total = df.select(F.countDistinct(member)).scalar()
    whole = df.groupBy(unit).agg(F.countDistinct(member).alias("n")).where(F.col("n") == total).select(unit)
    return df.join(whole, unit, "left_semi")


def contrast(df: DataFrame, keys: list[str], label: str, a: str, b: str, value: str = "value") -> DataFrame:
    """keys, value_a, value_b, difference for two labels on the same keys."""
    left = df.where(F.col(label) == a).select(*keys, F.col(value).alias("value_a"))
    right = df.where(F.col(label) == b).select(*keys, F.col(value).alias("value_b"))
    return left.join(right, keys).withColumn("difference", F.col("value_a") - F.col("value_b"))


def slope_on_log2(df: DataFrame, keys: list[str], size: str, value: str) -> DataFrame:
    """keys, slope of value on log2(size), sizes; null for a single size."""
    return df.groupBy(*keys).agg(F.regr_slope(F.col(value), F.log2(F.col(size))).alias("slope"), F.countDistinct(size).alias("sizes"))
