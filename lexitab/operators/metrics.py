"""Prediction metrics over tables of a true class or value and a probability vector or prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.functions.vectors import TIE_TOLERANCE, equal_width_bin
from lexitab.operators.ordered import bucket_of, edges, exact_quantiles, running
from lexitab.operators.ranks import correlation
from lexitab.session import written_once

CLIP = 1e-15


def _counted(df: DataFrame, y: str, score: str, name: str, *keys: str) -> DataFrame:
    """keys, the score under a name, pos, n: positives and rows of each distinct score, computed once."""
    return written_once(df.groupBy(*keys, F.col(score).alias(name)).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n")))


def roc_auc(df: DataFrame, y: str, score: str, *keys: str) -> DataFrame:
    """keys, auc of y in {0, 1}; ties count half; null if a class is absent. Scores are summed up before they are ranked."""
    by_score = _counted(df, y, score, "s", *keys)
    neg = F.col("n") - F.col("pos")
    rows = running(by_score, list(keys), bucket_of("s", edges(by_score, "s")), [F.col("s")], {"below": neg}, before=True)
    rows = rows.withColumn("wins", F.col("pos") * (F.col("below") + neg / 2))
    both = F.nullif(F.sum("pos") * F.sum(neg), F.lit(0.0))
    return rows.groupBy(*keys).agg((F.sum("wins") / both).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, *keys: str) -> DataFrame:
    """keys, ap (steps at distinct thresholds) and pr_auc (trapezoids between them); null without positives."""
    by_score = _counted(df, y, score, "s", *keys)
    rows = running(by_score, list(keys), bucket_of("s", edges(by_score, "s")), [F.desc("s")], {"tp": F.col("pos"), "taken": F.col("n")}, descending=True)
    rows = rows.withColumn("precision", F.col("tp") / F.col("taken"))
    # The threshold before has this one's running sums less its own counts.
    rows = rows.withColumn("before", F.coalesce((F.col("tp") - F.col("pos")) / F.nullif(F.col("taken") - F.col("n"), F.lit(0)), F.lit(1.0)))
    total = F.nullif(F.sum("pos"), F.lit(0.0))
    return rows.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("precision")) / total).alias("ap"), (F.sum(F.col("pos") * (F.col("precision") + F.col("before")) / 2) / total).alias("pr_auc"))


def log_loss(p_true: Column) -> Column:
    """Minus the logarithm of the clipped probability of the observed class."""
    return -F.ln(F.least(F.greatest(p_true, F.lit(CLIP)), F.lit(1 - CLIP)))


def brier(p: Column, y: Column) -> Column:
    """Sum over classes of squared differences from the one-hot truth (y counts from 0)."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


def top_k_hit(p: Column, y: Column, k: int) -> Column:
    """1 if class y is among the k most probable, the lower class first on ties."""
    own = F.element_at(p, y + 1)
    ahead = F.size(F.filter(p, lambda x, i: (x > own) | ((x == own) & (i < y))))
    return (ahead < k).cast("int")


def fractional_hit(p: Column, y: Column) -> Column:
    """Credit of the top answer: 1 over the number of tied best classes if y is one of them."""
    best = F.array_max(p)
    tied = F.size(F.filter(p, lambda x: x >= best - TIE_TOLERANCE))
    return F.when(F.element_at(p, y + 1) >= best - TIE_TOLERANCE, 1.0 / tied).otherwise(0.0)


def reliability(df: DataFrame, y: str, score: str, *keys: str, bins: int = 10, right_closed: bool = False) -> DataFrame:
    """keys, bin, n, mean_score, observed: equal-width bins closed on the left, or on the right."""
    place = equal_width_bin(score, 0.0, 1.0, bins)
    if right_closed:
        place = F.least(F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", place).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_error(table: DataFrame, *keys: str) -> DataFrame:
    """keys, ece, mce of a reliability table."""
    gap = F.abs(F.col("mean_score") - F.col("observed"))
    return table.groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def confusion(df: DataFrame, y: str, predicted: str, classes: list, *keys: str) -> DataFrame:
    """keys, y, predicted, n over the full grid of classes, zeros included."""
    spark = df.sparkSession
    counted = df.groupBy(*keys, F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], df.select(F.col(y).alias("y"), F.col(predicted).alias("predicted")).schema)
    if keys:
        grid = df.select(*keys).distinct().crossJoin(F.broadcast(grid))  # classes are a declared list
    return grid.join(counted, [*keys, "y", "predicted"], "left").select(*keys, "y", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def decisions(table: DataFrame, *keys: str) -> DataFrame:
    """keys, accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1, kappa, mcc of a confusion table; 0 where a ratio is undefined."""
    window = W.partitionBy(*keys)
    row, column = W.partitionBy(*keys, "y"), W.partitionBy(*keys, "predicted")
    cells = table.withColumn("actual", F.sum("n").over(row)).withColumn("called", F.sum("n").over(column)).withColumn("all", F.sum("n").over(window))
    cells = cells.where("y = predicted")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double")), F.lit(0.0))
    n, actual, called, every = (F.col(c) for c in ("n", "actual", "called", "all"))
    per = cells.select(*keys, "n", "actual", "called", "all", ratio(n, called).alias("p"), ratio(n, actual).alias("r"), ratio(2 * n, actual + called).alias("f"))
    right, size = F.sum(n).cast("double"), F.first(every).cast("double")
    chance = F.sum(actual.cast("double") * called)
    square = lambda c: F.sum(c.cast("double") * c)
    top = right * size - chance
    spread = F.sqrt((size * size - square(called)) * (size * size - square(actual)))
    return per.groupBy(*keys).agg(
        (right / size).alias("accuracy"),
        F.coalesce(F.avg(F.when(actual > 0, F.col("r"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
        F.coalesce(F.try_divide(top, size * size - chance), F.lit(0.0)).alias("kappa"),
        F.coalesce(F.try_divide(top, spread), F.lit(0.0)).alias("mcc"),
    )


def best_threshold(df: DataFrame, y: str, score: str, *keys: str) -> DataFrame:
    """keys, threshold, f1: the score at or above which F1 is highest; ties go to the one nearest 0.5, then the larger."""
    by_score = _counted(df, y, score, "threshold", *keys)
    rows = running(by_score, list(keys), bucket_of("threshold", edges(by_score, "threshold")), [F.desc("threshold")], {"tp": F.col("pos"), "taken": F.col("n")}, descending=True)
    positives = by_score.groupBy(*keys).agg(F.sum("pos").alias("positives"))
    rows = rows.join(positives, list(keys)) if keys else rows.crossJoin(F.broadcast(positives))  # one row
    rows = rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("taken") + F.col("positives")), F.lit(0.0)))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.abs(F.col("threshold") - 0.5), "threshold")).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.threshold", "best.f1")


def regression_report(df: DataFrame, y: str, predicted: str, *keys: str) -> DataFrame:
    """keys, n, mse, rmse, mae, median_ae, max_ae, mean_error, r2, explained_variance, pearson, mape, rmsle; null where undefined."""
    rows = df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    truth, guess = F.col(y).cast("double"), F.col(predicted).cast("double")
    error = guess - truth
    spread = F.nullif(F.var_pop(truth), F.lit(0.0))
    mape = F.when(F.min(F.abs(truth)) > 0, F.avg(F.abs(error) / F.nullif(F.abs(truth), F.lit(0.0))))
    logs = F.when((truth > -1) & (guess > -1), F.pow(F.log1p(guess) - F.log1p(truth), 2))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.max(F.abs(error)).alias("max_ae"),
        F.avg(error).alias("mean_error"),
        (1 - F.avg(error * error) / spread).alias("r2"),
        (1 - F.var_pop(error) / spread).alias("explained_variance"),
        correlation(y, predicted).alias("pearson"),
        mape.alias("mape"),
        F.when((F.min(truth) >= 0) & (F.min(guess) >= 0), F.sqrt(F.avg(logs))).alias("rmsle"),
    )
    medians = exact_quantiles(rows.select(*keys, F.abs(error).alias("__error")), "__error", {"median_ae": 0.5}, *keys)
    if not keys:
        return sums.join(F.broadcast(medians), F.lit(True), "left")  # one row
    same = F.lit(True)
    for k in keys:
        same = same & sums[k].eqNullSafe(medians[k])
    return sums.join(medians, same, "left").drop(*[medians[k] for k in keys])


def pinball(y: Column, predicted: Column, quantile: float) -> Column:
    """Pinball loss of one quantile."""
    return F.greatest(quantile * (y - predicted), (quantile - 1) * (y - predicted))


#: Why a summary over classes has no value.
NOT_ALL_CLASSES = "needs rows of every class"


def classification_report(df: DataFrame, y: str, p: str, classes: int) -> DataFrame:
    """(metric, class, value, reason) of class probabilities p (an array) for true classes y = 0, 1, ..., class null in summaries.

    log_loss, brier_sum, accuracy and top_2, top_3 accuracy (below the number of classes) of all rows; for each class support, brier,
    roc_auc and average_precision against the rest; their macro and support-weighted means; roc_auc_ovo_macro and _weighted over pairs of
    classes (each pair is ranked by either class's probability among its own rows, and weighted by its share of rows); and
    average_precision_micro over all rows and classes together. A value that isn't defined is null with a reason. One table of
    scores, counted once and ranked once, serves all of them; rows with a null are left out.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("int").alias("y"), F.col(p).alias("p"))
    c = range(classes)
    score = lambda a, b, hit: F.struct(F.lit(a).alias("a") if isinstance(a, int) else a.alias("a"), F.lit(b).alias("b") if isinstance(b, int) else b.alias("b"), hit.cast("int").alias("hit"))
    said = []
    for k in c:
        own = F.col("p")[k]
        # Against the rest (b = -1), among all classes together (a = b = -1), and in the pairs of k with each other class that has the row.
        said += [F.struct(score(k, -1, F.col("y") == k).alias("g"), own.alias("s")), F.struct(score(-1, -1, F.col("y") == k).alias("g"), own.alias("s"))]
        said += [F.when(F.col("y").isin(k, other), F.struct(score(k, other, F.col("y") == k).alias("g"), own.alias("s"))) for other in c if other != k]
    scores = rows.select(F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("x")).select("x.g.a", "x.g.b", "x.g.hit", "x.s")
    counts = _counted(scores, "hit", "s", "s", "a", "b")
    below = running(counts, ["a", "b"], bucket_of("s", edges(counts, "s")), [F.col("s")], {"pos_below": F.col("pos"), "n_below": F.col("n")}, before=True)
    totals = counts.groupBy("a", "b").agg(F.sum("pos").alias("pos_all"), F.sum("n").alias("n_all"))
    ranked = below.join(totals, ["a", "b"]).withColumns({x: F.coalesce(x, F.lit(0)) for x in ("pos_below", "n_below")})
    wins = F.col("pos") * (F.col("n_below") - F.col("pos_below") + (F.col("n") - F.col("pos")) / 2)
    precision = (F.col("pos_all") - F.col("pos_below")) / (F.col("n_all") - F.col("n_below"))
    each = ranked.groupBy("a", "b", "pos_all", "n_all").agg(F.sum(wins).alias("wins"), F.sum(F.col("pos") * precision).alias("hits"))
    both = F.nullif(F.col("pos_all") * (F.col("n_all") - F.col("pos_all")), F.lit(0.0))
    auc, ap = (F.col("wins") / both).alias("auc"), F.when(both.isNotNull(), F.col("hits") / F.nullif(F.col("pos_all"), F.lit(0.0))).alias("ap")
    each = written_once(each.select("a", "b", F.col("pos_all").alias("support"), "n_all", auc, ap))
    true = F.element_at("p", F.col("y") + 1)
    whole = {"log_loss": F.avg(log_loss(true)), "brier_sum": F.avg(brier(F.col("p"), F.col("y"))), "accuracy": F.avg(top_k_hit(F.col("p"), F.col("y"), 1))}
    whole |= {f"top_{k}": F.avg(top_k_hit(F.col("p"), F.col("y"), k)) for k in (2, 3) if k < classes}
    whole |= {f"brier:{k}": F.avg(F.pow(F.col("p")[k] - (F.col("y") == k).cast("double"), 2)) for k in c}
    sums = rows.agg(*[v.alias(name) for name, v in whole.items()])
    told = F.explode(F.array(*[F.struct(F.lit(name.split(":")[0]).alias("metric"), F.lit(int(name.split(":")[1]) if ":" in name else None).cast("int").alias("class"), F.col(f"`{name}`").alias("value")) for name in whole])).alias("x")
    simple = sums.select(told).select("x.*", F.when(F.col("x.value").isNull(), "needs rows").alias("reason"))
    own = spark_classes(df, classes).join(each.where("a >= 0 and b = -1"), F.col("class") == F.col("a"), "left")
    own = own.select("class", F.coalesce("support", F.lit(0.0)).alias("support"), "auc", "ap")
    per = own.select("class", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(v).alias("value")) for n, v in (("support", "support"), ("roc_auc", "auc"), ("average_precision", "ap"))])).alias("x"))
    per = per.select("x.metric", "class", "x.value", F.when(F.col("x.value").isNull(), "needs rows of the class and of others").alias("reason"))
    present = F.count_if(F.col("support") > 0) == classes
    mean = lambda v, w: F.when(present, F.sum(F.col(v) * w) / F.nullif(F.sum(w), F.lit(0.0)))
    summaries = own.agg(mean("auc", F.lit(1.0)).alias("roc_auc_ovr_macro"), mean("auc", F.col("support")).alias("roc_auc_ovr_weighted"), mean("ap", F.lit(1.0)).alias("average_precision_macro"), mean("ap", F.col("support")).alias("average_precision_weighted"), present.alias("all"))
    pairs = each.where("b >= 0").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.avg("auc").alias("auc"), F.max("n_all").alias("w"))
    pairs = pairs.agg(F.avg("auc").alias("roc_auc_ovo_macro"), (F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("roc_auc_ovo_weighted"))
    micro = each.where("a = -1").agg(F.max("ap").alias("average_precision_micro"))
    line = summaries.join(F.broadcast(pairs)).join(F.broadcast(micro))  # one row each
    names = [n for n in line.columns if n != "all"]
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.when(F.col("all"), F.col(n)).alias("value")) for n in names])).alias("x")
    line = line.select(told).select("x.metric", F.lit(None).cast("int").alias("class"), "x.value", F.when(F.col("x.value").isNull(), NOT_ALL_CLASSES).alias("reason"))
    return simple.unionByName(per).unionByName(line)


def spark_classes(df: DataFrame, classes: int) -> DataFrame:
    """A row for each class 0, 1, ...: a fixed dimension."""
    return df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
