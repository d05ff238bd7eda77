"""Prediction metrics, calibration, thresholds and cohorts over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitab.functions import vectors as V
from lexitab.operators import metrics as M
from lexitab.operators import ordered, ranks
from lexitab.plans.fixtures import CLASSES, SCORES, classes, r6, rounded, scores
from lexitab.plans.registry import register
from lexitab.session import table


@register(
    "roc_auc",
    f"""WITH {SCORES}, r AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS k FROM scores)
    SELECT grp, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r GROUP BY grp""",
)
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(scores(spark, sf_dir), "y", "score", "grp"))


@register(
    "average_precision",
    f"""WITH {SCORES}, s AS (SELECT grp, score, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL), c AS (SELECT grp, score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS taken FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
    p AS (SELECT *, tp / taken AS prec, coalesce(lag(tp / taken) OVER (PARTITION BY grp ORDER BY score DESC), 1.0) AS before FROM c) SELECT grp, round(sum(pos * prec) / sum(pos), 6) AS ap, round(sum(pos * (prec + before) / 2) / sum(pos), 6) AS pr_auc FROM p GROUP BY grp""",
)
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(scores(spark, sf_dir), "y", "score", "grp"))


@register(
    "log_loss_brier",
    f"""WITH {SCORES} SELECT grp, round(avg(-ln(greatest(least(CASE WHEN y = 1 THEN score ELSE 1 - score END, 1 - 1e-15), 1e-15))), 6) AS log_loss, round(avg((score - y) * (score - y)), 6) AS brier, count(*) AS n FROM scores GROUP BY grp""",
)
def log_loss_brier(spark, sf_dir):
    own = F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return scores(spark, sf_dir).groupBy("grp").agg(r6(F.avg(M.log_loss(own))).alias("log_loss"), r6(F.avg(F.pow(F.col("score") - F.col("y"), 2))).alias("brier"), F.count(F.lit(1)).alias("n"))


@register(
    "multiclass_scores",
    f"""WITH {CLASSES}, e AS (SELECT c.doc_id, c.y, k, c.p[k + 1] AS x, c.p[c.y + 1] AS own FROM classes c, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS k)),
    r AS (SELECT doc_id, y, own, sum((x - CAST(k = y AS DOUBLE)) * (x - CAST(k = y AS DOUBLE))) AS brier, count(*) FILTER (x > own OR (x = own AND k < y)) AS ahead, max(x) AS best, count(*) FILTER (x >= (SELECT max(z.x) FROM e z WHERE z.doc_id = e.doc_id) - 1e-12) AS tied FROM e GROUP BY ALL)
    SELECT y, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(CAST(ahead < 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(ahead < 2 AS DOUBLE)), 6) AS top2, round(avg(CASE WHEN own >= best - 1e-12 THEN 1.0 / tied ELSE 0 END), 6) AS credit FROM r GROUP BY y""",
)
def multiclass_scores(spark, sf_dir):
    """Brier score, top-1 and top-2 accuracy and tie-sharing credit by true class."""
    p, y = F.col("p"), F.col("y")
    return rounded(classes(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg(M.brier(p, y)).alias("brier"), F.avg(M.top_k_hit(p, y, 1).cast("double")).alias("top1"), F.avg(M.top_k_hit(p, y, 2).cast("double")).alias("top2"), F.avg(M.fractional_hit(p, y)).alias("credit")))


@register(
    "ovr_auc",
    f"""WITH {CLASSES}, e AS (SELECT k, CAST(c.y = k AS INTEGER) AS hit, c.p[k + 1] AS s FROM classes c, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS k)), r AS (SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS rk FROM e)
    SELECT k AS class, round((sum(rk) FILTER (hit = 1) - count(*) FILTER (hit = 1) * (count(*) FILTER (hit = 1) + 1) / 2.0) / (count(*) FILTER (hit = 1) * count(*) FILTER (hit = 0)), 6) AS auc FROM r GROUP BY k""",
)
def ovr_auc(spark, sf_dir):
    """One-versus-rest area under the curve of each class."""
    rows = classes(spark, sf_dir).select("y", F.posexplode("p").alias("class", "s")).withColumn("hit", (F.col("y") == F.col("class")).cast("int"))
    return rounded(M.roc_auc(rows, "hit", "s", "class"))


@register(
    "reliability_bins",
    f"""WITH {SCORES} SELECT grp, CAST(least(floor(score / 0.1), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(y AS DOUBLE)), 6) AS observed FROM scores GROUP BY ALL""",
)
def reliability_bins(spark, sf_dir):
    return rounded(M.reliability(scores(spark, sf_dir), "y", "score", "grp"))


@register(
    "reliability_bins_right",
    f"""WITH {SCORES} SELECT grp, CAST(greatest(least(ceil(score * 10) - 1, 9), 0) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(y AS DOUBLE)), 6) AS observed FROM scores GROUP BY ALL""",
)
def reliability_bins_right(spark, sf_dir):
    return rounded(M.reliability(scores(spark, sf_dir), "y", "score", "grp", right_closed=True))


@register(
    "calibration_error",
    f"""WITH {SCORES}, b AS (SELECT grp, least(floor(score / 0.1), 9) AS bin, count(*) AS n, abs(avg(score) - avg(CAST(y AS DOUBLE))) AS gap FROM scores GROUP BY ALL) SELECT grp, round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY grp""",
)
def calibration_error(spark, sf_dir):
    return rounded(M.calibration_error(M.reliability(scores(spark, sf_dir), "y", "score", "grp"), "grp"))


_CONFUSION = SCORES + """, c AS (SELECT grp, CAST(y AS INTEGER) AS y, CAST(score >= 0.5 AS INTEGER) AS predicted FROM scores), grid AS (SELECT * FROM (SELECT DISTINCT grp FROM c), (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS predicted)),
    conf AS (SELECT grp, y, predicted, count(c.grp) AS n FROM grid LEFT JOIN c USING (grp, y, predicted) GROUP BY ALL)"""


def _confusion(spark, sf_dir):
    rows = scores(spark, sf_dir).select("grp", F.col("y").cast("int").alias("y"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return M.confusion(rows, "y", "predicted", [0, 1], "grp")


@register("confusion_matrix", f"WITH {_CONFUSION} SELECT grp, y, predicted, n FROM conf")
def confusion_matrix(spark, sf_dir):
    return _confusion(spark, sf_dir)


@register(
    "decision_metrics",
    f"""WITH {_CONFUSION}, t AS (SELECT grp, max(n) FILTER (y=1 AND predicted=1) * 1.0 AS tp, max(n) FILTER (y=0 AND predicted=0) * 1.0 AS tn, max(n) FILTER (y=0 AND predicted=1) * 1.0 AS fp, max(n) FILTER (y=1 AND predicted=0) * 1.0 AS fn FROM conf GROUP BY grp)
    SELECT grp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) AS macro_precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS macro_recall,
        round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1, round(2 * (tp * tn - fn * fp) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn)), 6) AS kappa, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM t""",
)
def decision_metrics(spark, sf_dir):
    return rounded(M.decisions(_confusion(spark, sf_dir), "grp"))


@register(
    "best_threshold",
    f"""WITH {SCORES}, s AS (SELECT grp, score, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL), c AS (SELECT grp, score, sum(pos) OVER w AS tp, sum(n) OVER w AS taken, sum(pos) OVER (PARTITION BY grp) AS all_pos FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
    SELECT grp, score AS threshold, round(2.0 * tp / (taken + all_pos), 6) AS f1 FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY 2.0 * tp / (taken + all_pos) DESC, abs(score - 0.5), score DESC) = 1""",
)
def best_threshold(spark, sf_dir):
    return rounded(M.best_threshold(scores(spark, sf_dir), "y", "score", "grp"))


@register(
    "regression_report",
    f"""WITH t AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1450.0 AS g FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg((g-y)*(g-y)), 2) AS mse, round(sqrt(avg((g-y)*(g-y))), 4) AS rmse, round(avg(abs(g-y)), 4) AS mae, round(quantile_cont(abs(g-y), 0.5), 4) AS median_ae, round(max(abs(g-y)), 4) AS max_ae,
        round(avg(g-y), 4) AS mean_error, round(1 - avg((g-y)*(g-y)) / var_pop(y), 6) AS r2, round(1 - var_pop(g-y) / var_pop(y), 6) AS explained_variance, round(corr(y, g), 6) AS pearson, round(avg(abs(g-y)/abs(y)), 6) AS mape, round(sqrt(avg((ln(1+g)-ln(1+y))*(ln(1+g)-ln(1+y)))), 6) AS rmsle FROM t GROUP BY ALL""",
)
def regression_report(spark, sf_dir):
    """Regression metrics of a price guessed from the quantity, by return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1450.0).alias("g"))
    out = M.regression_report(rows, "y", "g", "l_returnflag")
    digits = {"mse": 2, "rmse": 4, "mae": 4, "median_ae": 4, "max_ae": 4, "mean_error": 4}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@register(
    "pinball_losses",
    """WITH t AS (SELECT l_linestatus, l_extendedprice AS y, l_quantity * 1450.0 AS g FROM lineitem) SELECT l_linestatus, q AS quantile, round(avg(greatest(q * (y - g), (q - 1) * (y - g))), 4) AS loss FROM t, (SELECT unnest(CAST([0.1, 0.5, 0.9] AS DOUBLE[])) AS q) GROUP BY ALL""",
)
def pinball_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    y, g = F.col("l_extendedprice"), F.col("l_quantity") * 1450.0
    sums = rows.groupBy("l_linestatus").agg(*[F.avg(M.pinball(y, g, q)).alias(str(i)) for i, q in enumerate((0.1, 0.5, 0.9))])
    return sums.select("l_linestatus", F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.round(F.col(str(i)), 4).alias("loss")) for i, q in enumerate((0.1, 0.5, 0.9))])).alias("s")).select("l_linestatus", "s.*")


@register(
    "row_cohorts",
    f"""WITH {SCORES}, r AS (SELECT s.doc_id, grp, -ln(greatest(least(CASE WHEN y = 1 THEN score ELSE 1 - score END, 1 - 1e-15), 1e-15)) AS loss, score, length(text) AS chars, lang FROM scores s JOIN documents d USING (doc_id)),
    u AS (SELECT 'all' AS axis, 'all' AS cohort, loss FROM r UNION ALL SELECT 'confidence', 'confidence_' || ((greatest(score, 1 - score) >= 0.5)::INT + (greatest(score, 1 - score) >= 0.7)::INT + (greatest(score, 1 - score) >= 0.9)::INT), loss FROM r
        UNION ALL SELECT 'length', 'length_' || ((chars >= 500)::INT + (chars >= 2000)::INT), loss FROM r UNION ALL SELECT 'language', lang, loss FROM r) SELECT axis, cohort, count(*) AS n, round(sum(loss), 6) AS loss_sum FROM u GROUP BY ALL""",
)
def row_cohorts(spark, sf_dir):
    """Loss sums by cohort; a row counts in one cohort of each axis."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", F.char_length("text").alias("chars"))
    own = F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))
    rows = scores(spark, sf_dir).join(documents, "doc_id")
    pair = lambda axis, c: F.struct(F.lit(axis).alias("axis"), c.alias("cohort"))
    axes = F.array(pair("all", F.lit("all")), pair("confidence", V.band(F.greatest(F.col("score"), 1 - F.col("score")), (0.5, 0.7, 0.9), "confidence")), pair("length", V.band("chars", (500, 2000), "length")), pair("language", F.col("lang")))
    return rows.select(F.explode(axes).alias("s"), M.log_loss(own).alias("loss")).groupBy("s.axis", "s.cohort").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("loss")).alias("loss_sum"))


@register(
    "benefit_overlap",
    f"""WITH {SCORES}, b AS (SELECT doc_id, round(abs(score - y) - abs((doc_id * 91 + 5) % 1000 / 1000.0 - y), 9) AS x, round(abs(score - y) - abs((doc_id * 53 + 7) % 1000 / 1000.0 - y), 9) AS z FROM scores),
    k AS (SELECT *, row_number() OVER (ORDER BY x DESC, doc_id) <= ceil(0.1 * count(*) OVER ()) AS tx, row_number() OVER (ORDER BY z DESC, doc_id) <= ceil(0.1 * count(*) OVER ()) AS tz FROM b)
    SELECT count(*) AS n, count(*) FILTER (tx) AS k, round(1.0 * count(*) FILTER (tx AND tz) / count(*) FILTER (tx OR tz), 6) AS jaccard, round(corr(x, z), 6) AS r FROM k""",
)
def benefit_overlap(spark, sf_dir):
    """Overlap of the top tenths of two benefits, and their correlation."""
    rows = scores(spark, sf_dir)
    benefit = lambda a, b: F.round(F.abs(F.col("score") - F.col("y")) - F.abs((F.col("doc_id") * a + b) % 1000 / 1000.0 - F.col("y")), 9)
    rows = rows.select("doc_id", benefit(91, 5).alias("x"), benefit(53, 7).alias("z"))
    n = rows.count()
    k = -(-n // 10)
    one = {"place": F.lit(1).cast("long")}
    top = lambda c: ordered.running(rows, [], ordered.bucket_of(c, ordered.edges(rows, c)), [F.desc(c), F.col("doc_id")], one, descending=True).where(F.col("place") <= k).select("doc_id", F.lit(1).alias(f"t{c}"))
    both = rows.join(top("x"), "doc_id", "left").join(top("z"), "doc_id", "left")
    x, z = F.col("tx").isNotNull(), F.col("tz").isNotNull()
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.count_if(x).alias("k"), (F.count_if(x & z) / F.nullif(F.count_if(x | z), F.lit(0))).alias("jaccard"), ranks.correlation("x", "z").alias("r")))


_LANGS = ["de", "en", "es", "fr"]
_SCORES4 = f"""langs AS (SELECT doc_id, list_position({_LANGS}, lang) - 1 AS y FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')), raw AS (SELECT doc_id, CAST(y AS INTEGER) AS y, k, (doc_id * (7 + 3 * k) + 5 * k) % 97 + 1 + CASE WHEN k = y THEN 40 ELSE 0 END AS x FROM langs, range(0, 4) AS t(k)),
    s AS MATERIALIZED (SELECT doc_id, y, k, round(CAST(x AS DOUBLE) / sum(x) OVER (PARTITION BY doc_id), 9) AS s FROM raw)"""


@register(
    "language_report",
    f"""WITH {_SCORES4}, g AS MATERIALIZED (SELECT k AS a, -1 AS b, CAST(y = k AS INTEGER) AS hit, s FROM s UNION ALL SELECT -1, -1, CAST(y = k AS INTEGER), s FROM s UNION ALL SELECT k, o, CAST(y = k AS INTEGER), s FROM s, range(0, 4) AS t(o) WHERE o <> k AND y IN (k, o)),
    c AS (SELECT a, b, s, sum(hit) AS pos, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT *, sum(pos) OVER u AS p1, sum(n) OVER u AS n1, sum(pos) OVER t AS pa, sum(n) OVER t AS na FROM c WINDOW u AS (PARTITION BY a, b ORDER BY s DESC), t AS (PARTITION BY a, b)),
    e AS MATERIALIZED (SELECT a, b, any_value(pa) AS support, any_value(na) AS rows, sum(pos * ((na - n1) - (pa - p1) + (n - pos) / 2.0)) / any_value(pa * (na - pa)) AS auc, sum(pos * p1 / n1) / any_value(pa) AS ap FROM w GROUP BY a, b),
    own AS (SELECT * FROM e WHERE a >= 0 AND b = -1), pairs AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, avg(auc) AS auc, max(rows) AS w FROM e WHERE b >= 0 GROUP BY ALL),
    v AS (SELECT doc_id, y, list(s ORDER BY k) AS p FROM s GROUP BY ALL), r AS (SELECT y, p, p[y + 1] AS t, (SELECT count(*) FROM (SELECT unnest(p) AS q, unnest(range(0, 4)) AS i) WHERE q > p[y + 1] OR (q = p[y + 1] AND i < y)) AS ahead FROM v),
    report AS (
        SELECT 'log_loss' AS metric, NULL AS class, avg(-ln(least(greatest(t, 1e-15), 1 - 1e-15))) AS value FROM r UNION ALL SELECT 'brier_sum', NULL, avg((SELECT sum(pow(q - CASE WHEN i = y THEN 1 ELSE 0 END, 2)) FROM (SELECT unnest(p) AS q, unnest(range(0, 4)) AS i))) FROM r
        UNION ALL SELECT 'accuracy', NULL, avg(CAST(ahead < 1 AS INTEGER)) FROM r UNION ALL SELECT 'top_2', NULL, avg(CAST(ahead < 2 AS INTEGER)) FROM r UNION ALL SELECT 'top_3', NULL, avg(CAST(ahead < 3 AS INTEGER)) FROM r
        UNION ALL SELECT 'brier', k, avg(pow(s - CAST(y = k AS INTEGER), 2)) FROM s GROUP BY k UNION ALL SELECT 'support', a, support FROM own UNION ALL SELECT 'roc_auc', a, auc FROM own UNION ALL SELECT 'average_precision', a, ap FROM own
        UNION ALL SELECT 'roc_auc_ovr_macro', NULL, avg(auc) FROM own UNION ALL SELECT 'roc_auc_ovr_weighted', NULL, sum(auc * support) / sum(support) FROM own UNION ALL SELECT 'average_precision_macro', NULL, avg(ap) FROM own UNION ALL SELECT 'average_precision_weighted', NULL, sum(ap * support) / sum(support) FROM own
        UNION ALL SELECT 'roc_auc_ovo_macro', NULL, avg(auc) FROM pairs UNION ALL SELECT 'roc_auc_ovo_weighted', NULL, sum(auc * w) / sum(w) FROM pairs UNION ALL SELECT 'average_precision_micro', NULL, ap FROM e WHERE a = -1)
    SELECT metric, CAST(class AS INTEGER) AS class, round(value, 6) + 0.0 AS value, CAST(NULL AS VARCHAR) AS reason FROM report""",
)
def language_report(spark, sf_dir):
    """The whole report of four languages as classes, of probabilities from the id and the language."""
    place = F.array_position(F.array(*map(F.lit, _LANGS)), F.col("lang"))
    rows = table(spark, sf_dir, "documents").where(F.col("lang").isin(_LANGS)).select("doc_id", (place - 1).cast("int").alias("y"))
    x = F.array(*[(F.col("doc_id") * (7 + 3 * k) + 5 * k) % 97 + 1 + F.when(F.col("y") == k, 40).otherwise(0) for k in range(4)])
    p = F.transform("x", lambda v: F.round(v.cast("double") / F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b), 9))
    return rounded(M.classification_report(rows.withColumn("x", x).select("y", p.alias("p")), "y", "p", 4))
