"""Paired gains over folds, their summaries and tests, and associations between units."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.operators import dedup, gains as G
from lexitab.operators import ranks, statistics
from lexitab.plans.fixtures import FOLD_METRICS, fold_metrics, r6, rounded
from lexitab.plans.registry import register
from lexitab.session import table

_KEYS = ["dataset", "model", "fold"]


def _paired(spark, sf_dir):
    return G.fold_gains(fold_metrics(spark, sf_dir), F.col("arm") == "N", _KEYS)


def _gains(spark, sf_dir):
    return G.headroom_gains(_paired(spark, sf_dir), ["dataset", "model", "arm"])


@register("fold_gains", f"WITH {FOLD_METRICS} SELECT dataset, model, fold, arm, round(value, 6) AS value, round(base, 6) AS base, round(difference, 6) + 0.0 AS difference FROM paired")
def fold_gains(spark, sf_dir):
    """Every arm beside the baseline of the same fold."""
    return rounded(_paired(spark, sf_dir).select("dataset", "model", "fold", "arm", "value", "base", "difference"))


@register("dataset_gains", f"WITH {FOLD_METRICS} SELECT dataset, model, arm, round(raw_gain, 6) + 0.0 AS raw_gain, round(gain, 6) + 0.0 AS gain, round(variance * 1e6, 3) AS variance_e6, folds FROM gains")
def dataset_gains(spark, sf_dir):
    """Headroom-normalised gains with the variance over folds."""
    return rounded(_gains(spark, sf_dir).withColumn("variance_e6", F.round(F.col("variance") * 1e6, 3)).drop("variance"))


@register("complete_arms", f"WITH {FOLD_METRICS}, c AS (SELECT dataset, model, arm FROM fm GROUP BY ALL HAVING count(value) = 5 AND count(DISTINCT fold) = 5) SELECT dataset, model, arm, count(*) AS folds FROM fm JOIN c USING (dataset, model, arm) GROUP BY ALL")
def complete_arms(spark, sf_dir):
    """Arms that have all five folds."""
    return G.complete_arms(fold_metrics(spark, sf_dir), ["dataset", "model", "arm"]).groupBy("dataset", "model", "arm").agg(F.count(F.lit(1)).alias("folds"))


@register("median_gains", f"WITH {FOLD_METRICS} SELECT dataset, arm, round(quantile_cont(gain, 0.5), 6) + 0.0 AS median, count(DISTINCT model) AS models FROM gains GROUP BY dataset, arm HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM gains)")
def median_gains(spark, sf_dir):
    """Median over models where all of them are present."""
    return rounded(G.median_over_models(_gains(spark, sf_dir), ["dataset", "arm"], "gain"))


@register("wins_ties_losses", f"WITH {FOLD_METRICS} SELECT arm, model, count(*) AS units, round(avg(raw_gain), 6) + 0.0 AS mean, count(*) FILTER (raw_gain > 0.001) AS wins, count(*) FILTER (abs(raw_gain) <= 0.001) AS ties, count(*) FILTER (raw_gain < -0.001) AS losses FROM gains GROUP BY arm, model")
def wins_ties_losses(spark, sf_dir):
    return rounded(G.wins_ties_losses(_gains(spark, sf_dir), ["arm", "model"]))


@register("balanced_gains", f"WITH {FOLD_METRICS}, i AS (SELECT arm, dataset, avg(raw_gain) AS m FROM gains GROUP BY ALL) SELECT arm, round(avg(m), 6) + 0.0 AS mean, count(*) AS datasets FROM i GROUP BY arm")
def balanced_gains(spark, sf_dir):
    """Means over models within datasets, then over datasets."""
    return rounded(G.balanced_mean(_gains(spark, sf_dir), ["arm"], "dataset", "raw_gain"))


@register("arm_contrast", f"WITH {FOLD_METRICS} SELECT x.dataset, x.model, x.fold, round(x.value, 6) AS value_a, round(y.value, 6) AS value_b, round(x.value - y.value, 6) + 0.0 AS difference FROM fm x JOIN fm y USING (dataset, model, fold) WHERE x.arm = 'A' AND y.arm = 'R'")
def arm_contrast(spark, sf_dir):
    """Two arms on the same keys."""
    return rounded(G.contrast(fold_metrics(spark, sf_dir), _KEYS, "arm", "A", "R"))


@register("contrast_to_median", f"WITH {FOLD_METRICS}, m AS (SELECT dataset, arm, quantile_cont(raw_gain, 0.5) AS median FROM gains GROUP BY ALL) SELECT g.dataset, g.model, g.arm, round(raw_gain - median, 6) + 0.0 AS over_median FROM gains g JOIN m USING (dataset, arm)")
def contrast_to_median(spark, sf_dir):
    """Each model's gain less the median of all models."""
    gains = _gains(spark, sf_dir)
    medians = G.median_over_models(gains, ["dataset", "arm"], "raw_gain").select("dataset", "arm", "median")
    return dedup.many_to_one(gains, medians, ["dataset", "arm"], "inner").select("dataset", "model", "arm", r6(F.col("raw_gain") - F.col("median")).alias("over_median"))


@register("model_ranking", f"WITH {FOLD_METRICS}, m AS (SELECT arm, model, round(avg(raw_gain), 9) AS mean FROM gains GROUP BY ALL) SELECT arm, model, round(mean, 6) + 0.0 AS mean, CAST(rank() OVER (PARTITION BY arm ORDER BY mean DESC) AS INTEGER) AS place FROM m")
def model_ranking(spark, sf_dir):
    means = _gains(spark, sf_dir).groupBy("arm", "model").agg(F.round(F.avg("raw_gain"), 9).alias("mean"))
    return rounded(means.withColumn("place", ranks.min_rank_desc("mean", "arm")))


@register(
    "ranking_stability",
    f"""WITH {FOLD_METRICS}, w AS (SELECT dataset, model, max(round(raw_gain, 9)) FILTER (arm = 'A') AS x, max(round(raw_gain, 9)) FILTER (arm = 'R') AS y FROM gains GROUP BY ALL),
    p AS (SELECT a.dataset, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM w a JOIN w b ON a.dataset = b.dataset AND a.model < b.model) SELECT dataset, round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 6) + 0.0 AS tau FROM p GROUP BY dataset""",
)
def ranking_stability(spark, sf_dir):
    """Kendall's tau-b of the models' order under two arms."""
    wide = _gains(spark, sf_dir).groupBy("dataset", "model").pivot("arm", ["A", "R"]).agg(F.first(F.round("raw_gain", 9)))
    return rounded(ranks.kendall_tau_b(wide, "model", "A", "R", "dataset"))


@register("gain_pivot", f"WITH {FOLD_METRICS} SELECT model, round(avg(raw_gain) FILTER (dataset = 'AUTOMOBILE'), 6) + 0.0 AS automobile, round(avg(raw_gain) FILTER (dataset = 'BUILDING'), 6) + 0.0 AS building, round(avg(raw_gain) FILTER (dataset = 'FURNITURE'), 6) + 0.0 AS furniture FROM gains GROUP BY model")
def gain_pivot(spark, sf_dir):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    wide = _gains(spark, sf_dir).groupBy("model").pivot("dataset", names).agg(F.avg("raw_gain"))
    return wide.select("model", *[r6(n).alias(n.lower()) for n in names])


@register(
    "random_effects",
    f"""WITH {FOLD_METRICS}, w AS (SELECT arm, raw_gain AS y, variance / 5 AS v FROM gains WHERE variance > 0), a AS (SELECT arm, count(*) AS k, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2, sum(y / v) AS swy, sum(y * y / v) AS swyy FROM w GROUP BY arm),
    b AS (SELECT *, swyy - swy * swy / sw AS q, greatest(0, (swyy - swy * swy / sw - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM a), c AS (SELECT w.arm, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS pooled, sqrt(1 / sum(1 / (v + tau2))) AS se FROM w JOIN b USING (arm) GROUP BY w.arm)
    SELECT arm, k, round(pooled, 6) + 0.0 AS pooled, round(se, 6) AS se, round(tau2, 6) AS tau2, round(greatest(0, (q - (k - 1)) / q), 6) AS i2, round(q, 6) AS q, round(pooled - 1.959963984540054 * se, 6) + 0.0 AS low, round(pooled + 1.959963984540054 * se, 6) + 0.0 AS high, 'ok' AS status FROM b JOIN c USING (arm)""",
)
def random_effects(spark, sf_dir):
    """DerSimonian-Laird pooling of gains over datasets and models."""
    rows = _gains(spark, sf_dir).withColumn("v", F.col("variance") / 5)
    return rounded(statistics.random_effects(rows, "raw_gain", "v", "arm"))


#: A p-value from integers, and a null for each eleventh row.
_P = "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 7919 + 13) % 10007 AS DOUBLE) / 10007 END"


def _p_values(spark, sf_dir):
    p = F.when(F.col("c_custkey") % 11 != 0, ((F.col("c_custkey") * 7919 + 13) % 10007).cast("double") / 10007)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", p.alias("p"))


@register(
    "false_discovery",
    f"""WITH t AS (SELECT c_custkey, c_mktsegment, {_P} AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM t WHERE p IS NOT NULL),
    q AS (SELECT c_custkey, least(1.0, min(p * m / k) OVER (PARTITION BY c_mktsegment ORDER BY k DESC)) AS q FROM r) SELECT t.c_custkey, t.c_mktsegment, round(p, 6) AS p, round(q, 6) AS q FROM t LEFT JOIN q USING (c_custkey)""",
)
def false_discovery(spark, sf_dir):
    """Benjamini-Hochberg within segments."""
    return rounded(statistics.benjamini_hochberg(_p_values(spark, sf_dir), "p", "c_mktsegment"))


@register(
    "holm_adjusted",
    f"""WITH t AS (SELECT c_custkey, c_mktsegment, {_P} AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM t WHERE p IS NOT NULL),
    q AS (SELECT c_custkey, least(1.0, max(p * (m - k + 1)) OVER (PARTITION BY c_mktsegment ORDER BY k)) AS adjusted FROM r) SELECT t.c_custkey, t.c_mktsegment, round(p, 6) AS p, round(adjusted, 6) AS adjusted FROM t LEFT JOIN q USING (c_custkey)""",
)
def holm_adjusted(spark, sf_dir):
    return rounded(statistics.holm(_p_values(spark, sf_dir), "p", "c_mktsegment"))


@register("across_datasets", f"WITH {FOLD_METRICS}, d AS (SELECT arm, dataset, avg(difference) AS m, count(difference) AS n FROM paired GROUP BY ALL) SELECT arm, count(*) AS datasets, round(avg(m), 6) + 0.0 AS mean, round(quantile_cont(m, 0.5), 6) + 0.0 AS median, count(*) FILTER (m > 0.001) AS better, count(*) FILTER (m < -0.001) AS worse, round(least(1.0, pow(2.0, 1 - count(*))), 6) AS resolution FROM d WHERE n = 25 GROUP BY arm")
def across_datasets(spark, sf_dir):
    """Differences over datasets with all folds of all models, and the resolution of a sign test."""
    per = _paired(spark, sf_dir).groupBy("arm", "dataset").agg(F.avg("difference").alias("m"), F.count("difference").alias("n")).where("n = 25")
    m, n = F.col("m"), F.count(F.lit(1))
    return rounded(per.groupBy("arm").agg(n.alias("datasets"), F.avg(m).alias("mean"), F.percentile(m, 0.5).alias("median"), F.count_if(m > 0.001).alias("better"), F.count_if(m < -0.001).alias("worse"), statistics.sign_resolution(n.cast("double")).alias("resolution")))


@register(
    "bootstrap_intervals",
    f"""WITH {FOLD_METRICS}, u AS (SELECT arm, raw_gain AS v, row_number() OVER (PARTITION BY arm ORDER BY dataset, model) - 1 AS at, count(*) OVER (PARTITION BY arm) AS n FROM gains),
    d AS (SELECT arm, draw, CAST('0x' || substr(md5('20261120:' || draw || ':' || slot), 1, 8) AS BIGINT) % n AS at FROM (SELECT DISTINCT arm, n FROM u), (SELECT unnest(range(0, 2000)) AS draw), (SELECT unnest(range(0, 500)) AS slot) WHERE slot < n),
    m AS (SELECT d.arm, draw, avg(v) AS m FROM d JOIN u ON d.arm = u.arm AND d.at = u.at GROUP BY ALL), e AS (SELECT arm, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY arm)
    SELECT arm, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(any_value(low), 6) + 0.0 AS low, round(any_value(high), 6) + 0.0 AS high FROM u JOIN e USING (arm) GROUP BY arm""",
)
def bootstrap_intervals(spark, sf_dir):
    """Percentile intervals of mean gains."""
    return rounded(statistics.bootstrap_mean(_gains(spark, sf_dir), "raw_gain", ["arm"], ["dataset", "model"]))


#: Average ranks of gains, variances and base values within each arm.
_RANKED = """g AS (SELECT gains.*, b.base FROM gains JOIN (SELECT dataset, model, arm, avg(base) AS base FROM paired GROUP BY ALL) b USING (dataset, model, arm) WHERE variance IS NOT NULL), r AS (
    SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY dataset, model) AS pos,
        rank() OVER (PARTITION BY arm ORDER BY raw_gain) + (count(*) OVER (PARTITION BY arm, raw_gain) - 1) / 2.0 AS x,
        rank() OVER (PARTITION BY arm ORDER BY variance) + (count(*) OVER (PARTITION BY arm, variance) - 1) / 2.0 AS y,
        rank() OVER (PARTITION BY arm ORDER BY base) + (count(*) OVER (PARTITION BY arm, base) - 1) / 2.0 AS z
    FROM g)"""


@register(
    "gain_associations",
    f"""WITH {FOLD_METRICS}, {_RANKED}, s AS (SELECT arm, count(*) AS n, corr(x, y) AS rho, avg(x) AS m, sqrt(sum((x - avg_x) * (x - avg_x)) * sum((y - avg_x) * (y - avg_x))) AS spread FROM (SELECT *, avg(x) OVER (PARTITION BY arm) AS avg_x FROM r) GROUP BY arm),
    p AS (SELECT arm, k, x, row_number() OVER (PARTITION BY arm, k ORDER BY CAST('0x' || substr(md5('20261120:' || k || ':' || pos), 1, 8) AS BIGINT), pos) AS place FROM r, (SELECT unnest(range(1, 501)) AS k)),
    t AS (SELECT p.arm, k, sum((p.x - m) * (r.y - m)) / any_value(spread) AS v FROM p JOIN r ON p.arm = r.arm AND p.place = r.pos JOIN s ON s.arm = p.arm GROUP BY p.arm, k)
    SELECT s.arm, n, round(any_value(rho), 6) + 0.0 AS rho, round((1 + count(*) FILTER (abs(v) >= abs(rho) - 1e-12)) / 501.0, 6) AS p, 'ok' AS status FROM s JOIN t USING (arm) GROUP BY s.arm, n""",
)
def gain_associations(spark, sf_dir):
    """Spearman correlation of gains with fold variance, with a permutation p."""
    rows = _gains(spark, sf_dir)
    return rounded(statistics.permutation_spearman(rows, "raw_gain", "variance", ["arm"], ["dataset", "model"], permutations=500))


@register(
    "partial_associations",
    f"""WITH {FOLD_METRICS}, {_RANKED}, c AS (SELECT arm, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY arm) SELECT arm, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) + 0.0 AS rho FROM c""",
)
def partial_associations(spark, sf_dir):
    """The same correlation with the base value held fixed."""
    base = _paired(spark, sf_dir).groupBy("dataset", "model", "arm").agg(F.avg("base").alias("base"))
    rows = _gains(spark, sf_dir).join(base, ["dataset", "model", "arm"])
    return rounded(statistics.partial_spearman(rows, "raw_gain", "variance", ["base"], ["arm"]))


@register(
    "signed_rank_tests",
    f"""WITH RECURSIVE {FOLD_METRICS}, d AS (SELECT arm, round(raw_gain, 12) AS g FROM gains WHERE round(raw_gain, 12) <> 0), r AS (SELECT arm, g, rank() OVER (PARTITION BY arm ORDER BY abs(g)) + (count(*) OVER (PARTITION BY arm, abs(g)) - 1) / 2.0 AS k FROM d),
    s AS (SELECT arm, count(*) AS n, least(coalesce(sum(k) FILTER (g > 0), 0), count(*) * (count(*) + 1) / 2 - coalesce(sum(k) FILTER (g > 0), 0)) AS w FROM r GROUP BY arm),
    ways(r, v) AS (SELECT 0, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0 END) UNION ALL SELECT r + 1, list_transform(v, lambda x, i: x + CASE WHEN i > r + 1 THEN v[i - r - 1] ELSE 0 END) FROM ways WHERE r < 50),
    t AS (SELECT arm, n, w, least(1.0, 2 * list_sum(v[1:CAST(floor(w) AS BIGINT) + 1]) / pow(2.0, n)) AS p FROM s JOIN ways ON ways.r = n)
    SELECT arm, n, round(w, 6) AS w, round(p, 6) AS p, round(least(1.0, max(p * ((SELECT count(*) FROM t) - k + 1)) OVER (ORDER BY k)), 6) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p) AS k FROM t)""",
)
def signed_rank_tests(spark, sf_dir):
    """Wilcoxon tests of gains by arm, with Holm's correction."""
    rows = _gains(spark, sf_dir).withColumn("g", F.round("raw_gain", 12))
    return rounded(statistics.holm(statistics.wilcoxon_signed_rank(rows, "g", ["arm"]), "p"))


#: A ridge rule with one property and a penalty of 1, for each dataset from the others of its arm.
HELD_OUT = FOLD_METRICS + """, u AS (SELECT arm, dataset, avg(raw_gain) AS gain, avg(variance) AS v FROM gains GROUP BY ALL), rest AS (
    SELECT a.arm, a.dataset, a.v, a.gain, count(b.gain) AS n, avg(b.gain) AS level, avg(b.v) AS mean, nullif(stddev_pop(b.v), 0) AS scale, covar_pop(b.v, b.gain) AS together
    FROM u a JOIN u b ON a.arm = b.arm AND a.dataset <> b.dataset GROUP BY ALL
), held AS (
    SELECT arm, dataset, gain, level + coalesce((v - mean) / scale * (n * together / scale / (n + 1)), 0) AS prediction FROM rest WHERE n >= 2
)"""


@register("held_out_datasets", f"WITH {HELD_OUT} SELECT arm, dataset, round(prediction, 6) + 0.0 AS prediction FROM held")
def held_out_datasets(spark, sf_dir):
    """Each dataset's gain predicted by a ridge rule from the other datasets."""
    rows = _gains(spark, sf_dir).groupBy("arm", "dataset").agg(F.avg("raw_gain").alias("gain"), F.avg("variance").alias("v"))
    return rounded(statistics.ridge_leave_one_out(rows, "dataset", ["v"], "gain", ["arm"]))


@register(
    "size_curves",
    """WITH s AS (SELECT c_mktsegment AS dataset, CAST(pow(2, 1 + o_orderkey % 4) AS BIGINT) AS size, o_orderkey % 3 AS draw, CAST(o_orderkey % 5 AS INTEGER) AS fold, avg(o_totalprice / 1000) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    d AS (SELECT dataset, size, draw, avg(v) AS v FROM s GROUP BY ALL), e AS (SELECT dataset, size, avg(v) AS v, count(*) AS draws FROM d GROUP BY ALL) SELECT dataset, round(regr_slope(v, log2(size)), 4) + 0.0 AS slope, count(DISTINCT size) AS sizes FROM e GROUP BY dataset""",
)
def size_curves(spark, sf_dir):
    """Folds, then draws, then datasets: the slope of a value on the logarithm of the size."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    folds = orders.groupBy(F.col("c_mktsegment").alias("dataset"), F.pow(F.lit(2), 1 + key % 4).cast("long").alias("size"), (key % 3).alias("draw"), (key % 5).alias("fold")).agg(F.avg(F.col("o_totalprice") / 1000).alias("v"))
    draws = folds.groupBy("dataset", "size", "draw").agg(F.avg("v").alias("v"))
    sizes = draws.groupBy("dataset", "size").agg(F.avg("v").alias("v"))
    return G.slope_on_log2(sizes, ["dataset"], "size", "v").select("dataset", (F.round("slope", 4) + 0.0).alias("slope"), "sizes")


@register("stratified_folds", "WITH t AS (SELECT doc_id, quality, sha256('[20260929,' || doc_id || ']') AS h FROM labels) SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1) % 5 AS INTEGER) AS fold FROM t")
def stratified_folds(spark, sf_dir):
    """Five folds of the labelled documents, even within each class."""
    return ranks.hash_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", ["quality"], 5, 20260929)


@register(
    "nested_subsample",
    """WITH t AS (SELECT doc_id, quality, sha256('[7,' || doc_id || ']') AS h FROM labels), w AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM t)
    SELECT doc_id, quality, CAST(row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, round((k - 0.5) / n, 12), h, doc_id) AS INTEGER) AS position FROM w""",
)
def nested_subsample(spark, sf_dir):
    """An order of labelled documents whose prefixes are nested, proportional samples."""
    return ranks.nested_order(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 7)


@register("full_roster", f"WITH {FOLD_METRICS}, n AS (SELECT dataset FROM fm GROUP BY dataset HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM fm)) SELECT dataset, count(*) AS rows FROM fm JOIN n USING (dataset) GROUP BY dataset")
def full_roster(spark, sf_dir):
    """Datasets observed for every model (relational division)."""
    return G.present_everywhere(fold_metrics(spark, sf_dir), "dataset", "model").groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "leave_group_out_importance",
    f"""WITH {FOLD_METRICS}, w AS (SELECT dataset, model, fold, max(value) FILTER (arm = 'N') AS full_value, max(value) FILTER (arm = 'A') AS without_a, max(value) FILTER (arm = 'R') AS without_r FROM fm GROUP BY ALL) SELECT dataset, round(avg(full_value - without_a), 6) + 0.0 AS a, round(avg(full_value - without_r), 6) + 0.0 AS r FROM w GROUP BY dataset""",
)
def leave_group_out_importance(spark, sf_dir):
    """The full arm less the arms without a part, by dataset."""
    wide = fold_metrics(spark, sf_dir).groupBy(*_KEYS).pivot("arm", ["A", "N", "R"]).agg(F.max("value"))
    return wide.groupBy("dataset").agg(r6(F.avg(F.col("N") - F.col("A"))).alias("a"), r6(F.avg(F.col("N") - F.col("R"))).alias("r"))


@register("coverage_status", f"WITH {FOLD_METRICS}, plan AS (SELECT * FROM (SELECT DISTINCT dataset FROM fm), (SELECT DISTINCT model FROM fm), (SELECT unnest(['A', 'N', 'R', 'X']) AS arm)) SELECT arm, count(*) AS planned, count(done.n) AS complete FROM plan LEFT JOIN (SELECT dataset, model, arm, count(*) AS n FROM fm GROUP BY ALL HAVING count(*) = 5) done USING (dataset, model, arm) GROUP BY arm")
def coverage_status(spark, sf_dir):
    """Planned arms (datasets x models x declared arms) against complete ones."""
    folds = fold_metrics(spark, sf_dir)
    names = folds.select("dataset").distinct().withColumn("j", F.lit(1)).join(folds.select("model").distinct().withColumn("j", F.lit(1)), "j").drop("j")
    plan = names.withColumn("arm", F.explode(F.array(*map(F.lit, ["A", "N", "R", "X"]))))
    done = folds.groupBy("dataset", "model", "arm").agg(F.count(F.lit(1)).alias("n")).where("n = 5")
    return plan.join(done, ["dataset", "model", "arm"], "left").groupBy("arm").agg(F.count(F.lit(1)).alias("planned"), F.count("n").alias("complete"))


@register("metric_long", f"WITH {FOLD_METRICS} SELECT dataset, model, arm, metric, round(v, 6) + 0.0 AS value FROM (SELECT dataset, model, arm, unnest(['gain', 'raw_gain']) AS metric, unnest([gain, raw_gain]) AS v FROM gains)")
def metric_long(spark, sf_dir):
    """Gains melted to long rows."""
    wide = _gains(spark, sf_dir).select("dataset", "model", "arm", "gain", "raw_gain")
    return rounded(wide.unpivot(["dataset", "model", "arm"], ["gain", "raw_gain"], "metric", "value"))


@register("best_model_by_dataset", f"WITH {FOLD_METRICS}, m AS (SELECT dataset, model, round(avg(raw_gain), 9) AS g FROM gains GROUP BY ALL) SELECT dataset, model, round(g, 6) + 0.0 AS g FROM m QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY g DESC, model) = 1")
def best_model_by_dataset(spark, sf_dir):
    means = _gains(spark, sf_dir).groupBy("dataset", "model").agg(F.round(F.avg("raw_gain"), 9).alias("g"))
    return rounded(ranks.keep_first(means, ["dataset"], [F.desc("g"), F.col("model")]))


@register("running_budget", "WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, sum(o_totalprice) AS spent FROM orders GROUP BY ALL), r AS (SELECT day, spent, sum(spent) OVER (ORDER BY day) AS total FROM d) SELECT CAST(day AS DATE) AS day, round(spent, 2) AS spent, round(total, 2) AS total FROM r WHERE total <= (SELECT sum(o_totalprice) / 2 FROM orders)")
def running_budget(spark, sf_dir):
    """Days until half of all spending, by a running sum over one row a day."""
    orders = table(spark, sf_dir, "orders")
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("spent"))
    running = days.withColumn("total", F.sum("spent").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
    half = orders.agg((F.sum("o_totalprice") / 2).alias("half"))
    return running.join(F.broadcast(half), F.col("total") <= F.col("half")).select("day", F.round("spent", 2).alias("spent"), F.round("total", 2).alias("total"))
