"""Diversity of several models' answers to the same inputs, row by row and summed up, and how far benefits of two arms go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.operators.ordered import bucket_of, edges, numbered
from lexitab.operators.ranks import spearman
from lexitab.operators.statistics import bootstrap_mean
from lexitab.session import written_once

#: An exactly tied model casts no vote; distances are rounded to so many digits, and vectors this near are identical.
TIED, DIGITS, IDENTICAL = -99, 9, 1e-12
#: Bins of each side of the density of confidence and distance.
BINS = 20


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def row_diagnostics(df: DataFrame, row: str, model: str, p: str, models: list, options: int) -> DataFrame:
    """A row for each row of inputs: status, votes (by option), pattern, largest, unanimous, ambiguous, mean_pair_tv, max_pair_tv, confidence.

    df has a row for each row and model, with an array of so many probabilities. Rows for which a model has none are missing_text, and all
    else about them is null. The pattern has the votes of the options, largest first, as in 3:1; where a model is exactly tied
    between its best options the row is ambiguous and the pattern says so. confidence is the mean of the models' highest probabilities.
    One shuffle by row; a row has as many vectors as there are models.
    """
    known = df.where(F.col(model).isin(models) & F.col(p).isNotNull())
    every = df.select(row).distinct()
    ps = known.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(p).alias("p")))), lambda s: s["p"]).alias("ps"))
    rows = every.join(ps.where(F.size("ps") == len(models)), row, "left")
    best = lambda v: F.filter(v, lambda x: x == F.array_max(v))
    choices = F.transform("ps", lambda v: F.when(F.size(best(v)) > 1, TIED).otherwise((F.array_position(v, F.array_max(v)) - 1).cast("int")))
    rows = rows.withColumn("choices", choices)
    votes = F.transform(F.array(*map(F.lit, range(options))), lambda o: F.size(F.filter("choices", lambda c: c == o)))
    rows = rows.withColumn("votes", F.when(F.col("choices").isNotNull(), votes))
    gap = lambda a, b: F.round(_total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2, DIGITS)
    pairs = F.flatten(F.transform("ps", lambda a, i: F.transform(F.slice("ps", i + 2, F.lit(len(models))), lambda b: gap(a, b))))
    rows = rows.withColumn("gaps", pairs)
    ambiguous = F.array_contains("choices", TIED)
    counts = F.array_join(F.transform(F.filter(F.sort_array("votes", False), lambda v: v > 0), lambda v: v.cast("string")), ":")
    confidence = F.round(_total(F.transform("ps", F.array_max)) / len(models), DIGITS)
    mean = F.round(_total(F.col("gaps")) / F.greatest(F.size("gaps"), F.lit(1)), DIGITS)
    told = F.col("ps").isNotNull()
    return rows.select(
        row,
        F.when(told, "compared").otherwise("missing_text").alias("status"),
        "votes",
        F.when(ambiguous, "tied top probability").when(told, counts).alias("pattern"),
        F.array_max("votes").alias("largest"),
        ((F.array_max("votes") == len(models)) & ~ambiguous).alias("unanimous"),
        ambiguous.alias("ambiguous"),
        F.when(told, mean).alias("mean_pair_tv"),
        F.array_max("gaps").alias("max_pair_tv"),
        F.when(told, confidence).alias("confidence"),
    )


def weighted_rows(rows: DataFrame, row: str, inputs: DataFrame, key: str) -> DataFrame:
    """Compared rows twice: as they are (weighting rows), and one of each input (unique_inputs: the smallest row with its key)."""
    compared = rows.where("status = 'compared'").join(inputs.select(row, key), row)
    first = compared.groupBy(key).agg(F.min(row).alias(row))
    return compared.withColumn("weighting", F.lit("rows")).unionByName(compared.join(first, [key, row], "left_semi").withColumn("weighting", F.lit("unique_inputs")))


def diversity_summary(weighted: DataFrame, *keys: str) -> DataFrame:
    """keys, weighting, n, unanimous, ambiguous, mean_pair_tv, confidence (means), identical (share of rows whose vectors are all alike)."""
    share = lambda c: F.avg(c.cast("double"))
    return weighted.groupBy(*keys, "weighting").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("unanimous")).alias("unanimous"),
        share(F.col("ambiguous")).alias("ambiguous"),
        F.avg("mean_pair_tv").alias("mean_pair_tv"),
        F.avg("confidence").alias("confidence"),
        share(F.col("max_pair_tv") <= IDENTICAL).alias("identical"),
    )


def vote_patterns(weighted: DataFrame, *keys: str) -> DataFrame:
    """keys, weighting, pattern, n, share."""
    counts = weighted.groupBy(*keys, "weighting", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "weighting")))  # a row for each pattern


def confidence_density(weighted: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """keys, weighting, confidence_bin, tv_bin, n: a histogram of confidence and mean distance over [0, 1] x [0, 1]; bins without rows are left out."""
    place = lambda c: F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * bins)).cast("int")
    return weighted.groupBy(*keys, "weighting", place("confidence").alias("confidence_bin"), place("mean_pair_tv").alias("tv_bin")).agg(F.count(F.lit(1)).alias("n"))


def extreme_cases(weighted: DataFrame, row: str, *keys: str, n: int = 5) -> DataFrame:
    """keys, kind, place, row: of unique inputs those the models disagree on most (split) and those they agree on most surely (sure); ties by row."""
    unique = weighted.where("weighting = 'unique_inputs'")
    orders = {"split": [F.desc("mean_pair_tv"), F.col(row)], "sure": [F.desc("unanimous"), F.desc("confidence"), F.col("mean_pair_tv"), F.col(row)]}
    out = None
    for kind, order in orders.items():
        # The first of each stretch of rows, then the first of those: no key's rows meet in one task.
        near = unique.withColumn("__s", F.pmod(F.xxhash64(row), F.lit(256))).withColumn("place", F.row_number().over(W.partitionBy(*keys, "__s").orderBy(*order))).where(F.col("place") <= n)
        top = near.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n).select(*keys, F.lit(kind).alias("kind"), "place", row)
        out = top if out is None else out.unionByName(top)
    return out


def complementarity(df: DataFrame, keys: list[str], row: str, x: str, y: str, top_share: float = 0.1) -> DataFrame:
    """keys, n, rho, top_k, jaccard, chance: Spearman's correlation of two benefits, and the overlap of their top shares.

    The top are the ceil(top_share * n) rows of the highest benefit, ties by row; chance is the overlap expected of two random sets of
    that size. Rows with a null don't count; fewer than three rows, or a constant, leave rho null.
    """
    rows = written_once(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, row, x, y))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("top_k", F.greatest(F.lit(1), F.ceil(F.col("n") * top_share)).cast("long"))
    tops = []
    for c in (x, y):
        fallen = rows.withColumn("__d", -F.col(c))
        placed = numbered(fallen, keys, bucket_of("__d", edges(fallen, "__d")), [F.col("__d"), F.col(row)], "__at")
        tops.append(placed.join(sizes, keys).where(F.col("__at") <= F.col("top_k")).select(*keys, row))
    shared = tops[0].join(tops[1], [*keys, row]).groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"))
    rho = spearman(rows, x, y, *keys).select(*keys, "rho")
    both = sizes.join(rho, keys).join(shared, keys, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    chance = F.col("top_k") * F.col("top_k") / F.col("n")
    enough = F.col("n") >= 3
    pick = lambda c: F.when(enough, c)
    return both.select(*keys, "n", pick(F.col("rho")).alias("rho"), F.when(enough, F.col("top_k")).otherwise(F.lit(0)).cast("long").alias("top_k"), pick(F.col("shared") / (2 * F.col("top_k") - F.col("shared"))).alias("jaccard"), pick(chance / (2 * F.col("top_k") - chance)).alias("chance"))


def complementarity_summary(pairs: DataFrame, unit: str, keys: list[str], draws: int = 2000) -> DataFrame:
    """keys, n, mean_rho, low, high, jaccard, chance: means over units (data sets) of equal weight, with bootstrap percentiles of the mean of rho.

    Units with several pairs count by their mean. Pairs without a rho are left out.
    """
    per = written_once(pairs.where(F.col("rho").isNotNull()).groupBy(*keys, unit).agg(F.avg("rho").alias("rho"), F.avg("jaccard").alias("jaccard"), F.avg("chance").alias("chance")))
    means = per.groupBy(*keys).agg(F.avg("jaccard").alias("jaccard"), F.avg("chance").alias("chance"))
    ranges = bootstrap_mean(per, "rho", keys, [unit], draws=draws).withColumnRenamed("mean", "mean_rho")
    return ranges.join(means, keys).select(*keys, "n", "mean_rho", "low", "high", "jaccard", "chance")
