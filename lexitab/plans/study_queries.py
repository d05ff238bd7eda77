"""Feature plans, probes, associations, robustness and workload tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitab.functions import text as T
from lexitab.functions import vectors as V
from lexitab.operators import dedup, features, gains, linear, metrics, ordered, probes, ranks, statistics, validation
from lexitab.plans.fixtures import DECISIONS, FOLD_METRICS, SCORES, decisions, fold_metrics, r6, rounded, scores
from lexitab.plans.gain_queries import HELD_OUT
from lexitab.plans.registry import register
from lexitab.plans.text_queries import _FIELDS, _SLOTS
from lexitab.session import table, written_once


@register(
    "feature_plan",
    f"""WITH {_SLOTS} SELECT slot, count(input_key) AS requests, count(DISTINCT input_key) AS unique_requests, count(*) - count(input_key) AS empty FROM slots GROUP BY slot""",
)
def feature_plan(spark, sf_dir):
    """Requests that each slot takes, whole and distinct."""
    return features.feature_plan(dedup.slots(table(spark, sf_dir, "documents"), "doc_id", _FIELDS))


@register(
    "response_block",
    f"""WITH {DECISIONS} SELECT doc_id, round(max(p) FILTER (provider = 1 AND k = 2), 6) AS a, round(max(p) FILTER (provider = 2 AND k = 2), 6) AS b FROM decisions GROUP BY doc_id""",
)
def response_block(spark, sf_dir):
    """Responses by row and group, joined to a wide block through their request keys."""
    rows = decisions(spark, sf_dir).where("provider <= 2").select("doc_id", F.when(F.col("provider") == 1, "a").otherwise("b").alias("slot"), F.concat_ws("/", "doc_id", "provider").alias("request_key"), F.col("p")[2].alias("v"))
    return rounded(features.responses_to_block(rows.drop("v"), rows.select("request_key", "v"), "doc_id", "slot", "request_key", "v", ["a", "b"]))


@register(
    "assembled_features",
    f"""WITH {DECISIONS}, b AS (SELECT doc_id, round(max(p) FILTER (provider = 1 AND k = 0), 6) AS p0, round(max(p) FILTER (provider = 1 AND k = 1), 6) AS p1 FROM decisions GROUP BY doc_id)
    SELECT doc_id, n_chars, CAST(CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' OR text IS NULL THEN 1 ELSE 0 END AS INTEGER) AS text__missing, p0, p1 FROM documents JOIN b USING (doc_id)""",
)
def assembled_features(spark, sf_dir):
    """Numbers, presence flags and a provider's block, one to one by row."""
    base = features.presence_flags(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), ["text"]).drop("text")
    block = decisions(spark, sf_dir).where("provider = 1").select("doc_id", r6(F.col("p")[0]).alias("p0"), r6(F.col("p")[1]).alias("p1"))
    return features.assemble(base, [block], "doc_id")


@register(
    "training_bins",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem WHERE l_orderkey % 5 <> 0)
    SELECT l_returnflag, CAST((l_extendedprice >= e[1])::INT + (l_extendedprice >= e[2])::INT + (l_extendedprice >= e[3])::INT AS INTEGER) AS bin, count(*) AS n FROM lineitem, q WHERE l_orderkey % 5 = 0 GROUP BY ALL""",
)
def training_bins(spark, sf_dir):
    """Test rows by the quartiles of the training rows."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    test = features.training_bins(items.where("l_orderkey % 5 <> 0"), items.where("l_orderkey % 5 = 0"), "l_extendedprice", [0.25, 0.5, 0.75])
    return test.groupBy("l_returnflag", F.col("l_extendedprice_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "contiguous_shards",
    "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) SELECT CAST(i AS INTEGER) AS shard, min(o_orderkey) AS first_key, count(*) AS rows FROM r, (SELECT unnest(range(0, 7)) AS i) WHERE pos >= n * i // 7 AND pos < n * (i + 1) // 7 GROUP BY i",
)
def contiguous_shards(spark, sf_dir):
    """Seven contiguous ranges of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    placed = ordered.numbered(orders, [], ordered.bucket_of("o_orderkey", ordered.edges(orders, "o_orderkey")), [F.col("o_orderkey")], "pos")
    return placed.groupBy(features.contiguous_shard(F.col("pos") - 1, n, 7).alias("shard")).agg(F.min("o_orderkey").alias("first_key"), F.count(F.lit(1)).alias("rows"))


@register(
    "averaged_presentations",
    f"""WITH {DECISIONS}, m AS (SELECT doc_id, k, avg(p) AS p FROM decisions WHERE provider <= 2 GROUP BY ALL) SELECT doc_id, round(max(p), 6) AS top, round(-sum(p * ln(p)) / ln(3), 6) AS entropy FROM m GROUP BY doc_id""",
)
def averaged_presentations(spark, sf_dir):
    """The mean of two presentations, the second shown in another order and put back."""
    rows = decisions(spark, sf_dir).groupBy("doc_id").pivot("provider", [1, 2]).agg(F.first("p"))
    order = F.array(*[F.lit(i).cast("long") for i in (2, 0, 1)])
    shown = F.transform(order, lambda i: F.get(F.col("`2`"), i.cast("int")))
    p = V.mean_vector(F.col("`1`"), V.realigned(shown, order))
    return rows.select("doc_id", r6(F.array_max(p)).alias("top"), r6(V.entropy(p)).alias("entropy"))


@register(
    "effects_over_replay",
    f"""WITH {DECISIONS}, d AS (SELECT a.doc_id, b.provider, sum(abs(a.p - b.p)) / 2 AS tv FROM decisions a JOIN decisions b ON a.doc_id = b.doc_id AND a.k = b.k AND a.provider = 1 AND b.provider > 1 GROUP BY ALL),
    n AS (SELECT doc_id, tv AS noise FROM d WHERE provider = 2) SELECT CAST(provider AS INTEGER) AS provider, count(*) AS n, round(avg(tv), 6) AS tv, round(avg(tv - noise), 6) + 0.0 AS excess FROM d JOIN n USING (doc_id) WHERE provider > 2 GROUP BY provider""",
)
def effects_over_replay(spark, sf_dir):
    """Effects of interventions beyond what a replay alone changes."""
    rows = decisions(spark, sf_dir)
    reference = rows.where("provider = 1").select("doc_id", F.col("p").alias("q"))
    effects = rows.where("provider > 1").join(reference, "doc_id").select("doc_id", "provider", V.total_variation("p", "q").alias("tv"))
    noise = effects.where("provider = 2").select("doc_id", F.col("tv").alias("noise"))
    return rounded(effects.where("provider > 2").join(noise, "doc_id").groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.avg("tv").alias("tv"), F.avg(F.col("tv") - F.col("noise")).alias("excess")))


@register(
    "option_correlations",
    f"""WITH {DECISIONS}, c AS (SELECT a.k, b.provider, corr(a.p, b.p) AS r FROM decisions a JOIN decisions b ON a.doc_id = b.doc_id AND a.k = b.k AND a.provider = 1 AND b.provider > 1 GROUP BY ALL) SELECT CAST(provider AS INTEGER) AS provider, round(avg(r), 6) AS macro_r, count(r) AS options FROM c GROUP BY provider""",
)
def option_correlations(spark, sf_dir):
    """Pearson correlation option by option, and the mean over options that vary."""
    rows = decisions(spark, sf_dir).select("doc_id", "provider", F.posexplode("p").alias("k", "p"))
    reference = rows.where("provider = 1").select("doc_id", "k", F.col("p").alias("q"))
    per = rows.where("provider > 1").join(reference, ["doc_id", "k"]).groupBy("provider", "k").agg(ranks.correlation("p", "q").alias("r"))
    return rounded(per.groupBy("provider").agg(F.avg("r").alias("macro_r"), F.count("r").alias("options")))


@register(
    "cohort_scores",
    f"""WITH {SCORES}, s AS (SELECT y, score, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'seen' ELSE 'unseen' END AS cohort FROM documents LEFT JOIN scores USING (doc_id)), t AS (SELECT * FROM s WHERE y IS NOT NULL)
    SELECT cohort, count(*) AS n, round(avg((score - y) * (score - y)), 6) AS brier, round(avg(CAST((score >= 0.5)::INT = y AS DOUBLE)), 6) AS accuracy FROM t GROUP BY cohort""",
)
def cohort_scores(spark, sf_dir):
    """Scores of labelled documents by whether another document has their text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    counts = documents.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = scores(spark, sf_dir).join(documents, "doc_id").join(counts, "key")
    out = rows.groupBy(F.when(F.col("n") > 1, "seen").otherwise("unseen").alias("cohort"))
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"), F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy")))


@register(
    "row_benefits",
    f"""WITH {SCORES}, l AS (SELECT doc_id, -ln(greatest(least(CASE WHEN y = 1 THEN score ELSE 1 - score END, 1 - 1e-15), 1e-15)) AS arm, -ln(CASE WHEN y = 1 THEN 0.6 ELSE 0.4 END) AS base FROM scores) SELECT doc_id, round(arm, 6) AS arm, round(base - arm, 6) + 0.0 AS benefit FROM l""",
)
def row_benefits(spark, sf_dir):
    """Loss of a constant baseline less the arm's, row by row."""
    y = F.col("y") == 1
    own = metrics.log_loss(F.when(y, F.col("score")).otherwise(1 - F.col("score")))
    base = metrics.log_loss(F.when(y, 0.6).otherwise(0.4))
    return scores(spark, sf_dir).select("doc_id", r6(own).alias("arm"), r6(base - own).alias("benefit"))


@register(
    "model_diagnostics",
    f"""WITH {FOLD_METRICS}, a AS (SELECT model, avg(raw_gain) AS gain, count(*) AS cells FROM gains GROUP BY model), b AS (SELECT o_orderpriority AS model, count(*) AS orders, avg(o_totalprice) AS price FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
    SELECT coalesce(a.model, b.model) AS model, round(gain, 6) + 0.0 AS gain, cells, orders, round(price, 4) AS price FROM a FULL JOIN b ON a.model = b.model""",
)
def model_diagnostics(spark, sf_dir):
    """Summaries of several tables side by side; what a table lacks is null."""
    paired = gains.fold_gains(fold_metrics(spark, sf_dir), F.col("arm") == "N", ["dataset", "model", "fold"])
    a = gains.headroom_gains(paired, ["dataset", "model", "arm"]).groupBy("model").agg(r6(F.avg("raw_gain")).alias("gain"), F.count(F.lit(1)).alias("cells"))
    b = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("price"))
    return a.join(b, "model", "full")


@register(
    "context_screen",
    """SELECT source, CAST(cap AS BIGINT) AS cap, r AS chars_per_token, count(*) FILTER (ceil(length(text) / r) > cap) AS overflow, count(*) AS n FROM documents, (SELECT unnest([512, 2048, 8192]) AS cap), (SELECT unnest(CAST([3.0, 4.0] AS DOUBLE[])) AS r) GROUP BY ALL""",
)
def context_screen(spark, sf_dir):
    """Documents over each limit for each ratio of characters to tokens, in one pass over the documents."""
    cells = [(cap, r) for cap in (512, 2048, 8192) for r in (3.0, 4.0)]
    chars = F.char_length("text")
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.ceil(chars / r) > cap).alias(f"c{i}") for i, (cap, r) in enumerate(cells)])
    grid = F.explode(F.array(*[F.struct(F.lit(cap).cast("long").alias("cap"), F.lit(r).alias("chars_per_token"), F.col(f"c{i}").alias("overflow")) for i, (cap, r) in enumerate(cells)]))
    return sums.select("source", "n", grid.alias("s")).select("source", "s.*", "n")


@register(
    "dataset_audit",
    """SELECT column_name, rows, missing, distinct_values, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most FROM (
        SELECT 'o_totalprice' AS column_name, count(*) AS rows, count(*) - count(o_totalprice) AS missing, count(DISTINCT o_totalprice) AS distinct_values, avg(o_totalprice) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders
        UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey), avg(o_custkey), min(o_custkey), max(o_custkey) FROM orders
        UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL, NULL FROM orders
        UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), NULL, NULL, NULL FROM orders)""",
)
def dataset_audit(spark, sf_dir):
    """Columns of a table: missing and distinct values, and ranges of numbers, from one aggregate a column."""
    orders = table(spark, sf_dir, "orders")
    out = None
    for name in ("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"):
        number = T.finite(name) if orders.schema[name].dataType.typeName() != "string" else F.lit(None).cast("double")
        stats = orders.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(name)).alias("missing"), F.countDistinct(name).alias("distinct_values"), F.avg(number).alias("mean"), F.min(number).alias("least"), F.max(number).alias("most"))
        part = stats.select(F.lit(name).alias("column_name"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@register(
    "categorical_top",
    "WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY v) SELECT v, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS place FROM c QUALIFY place <= 3",
)
def categorical_top(spark, sf_dir):
    """The three most frequent values (a top-k report)."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return ranks.top_rows(counted, 3, [F.desc("n"), F.col("v")])


@register(
    "exact_subset",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 EXCEPT ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0",
)
def exact_subset(spark, sf_dir):
    """Rows that a store lacks, by all columns with their types."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.where("c_custkey % 2 = 0").exceptAll(customers.where("c_custkey % 4 = 0"))


@register(
    "replay_drift",
    """WITH a AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
    SELECT event_type, count(*) AS pairs, round(max(abs(a.v - b.v)), 6) AS largest_change, count(*) FILTER (abs(a.v - b.v) > 20) AS drifted FROM a JOIN b USING (user_id, event_type) GROUP BY event_type""",
)
def replay_drift(spark, sf_dir):
    """Largest change of repeated responses between two versions."""
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    change = F.abs(F.col("a") - F.col("b"))
    return rounded(means.where("a is not null and b is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.max(change).alias("largest_change"), F.count_if(change > 20).alias("drifted")))


@register(
    "model_profile",
    "WITH h AS (SELECT o_orderpriority AS model, sum(o_totalprice) / 3600 AS hours, count(*) AS requests FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT p.model, round(1000 * hours / requests, 6) AS hours_per_1000, CASE WHEN hours IS NULL THEN 'no_ledger' ELSE 'ok' END AS status FROM (SELECT DISTINCT o_orderpriority AS model FROM orders UNION SELECT 'unused') p LEFT JOIN h USING (model)",
)
def model_profile(spark, sf_dir):
    """Hours per thousand requests of every listed model, with a status where the ledger has none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), "o_orderstatus", "o_totalprice")
    hours = orders.where("o_orderstatus = 'F'").groupBy("model").agg((F.sum("o_totalprice") / 3600).alias("hours"), F.count(F.lit(1)).alias("requests"))
    listed = orders.select("model").union(spark.createDataFrame([("unused",)], "model string")).distinct()
    return listed.join(hours, "model", "left").select("model", r6(1000 * F.col("hours") / F.col("requests")).alias("hours_per_1000"), F.when(F.col("hours").isNull(), "no_ledger").otherwise("ok").alias("status"))


@register(
    "label_families",
    f"""WITH {FOLD_METRICS}, l AS (SELECT *, arm || '/' || model AS label FROM fm) SELECT split_part(label, '/', 1) AS family, count(*) AS rows, count(DISTINCT label) AS labels FROM l WHERE label LIKE 'A/%' OR label LIKE '%HIGH' GROUP BY family""",
)
def label_families(spark, sf_dir):
    """Arms by the first part of their label, some families and endings only."""
    rows = fold_metrics(spark, sf_dir).withColumn("label", F.concat_ws("/", "arm", "model"))
    kept = rows.where(F.col("label").startswith("A/") | F.col("label").endswith("HIGH"))
    return kept.groupBy(F.split("label", "/")[0].alias("family")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("labels"))


@register(
    "headline_rows",
    "SELECT task, metric, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'binary_classification' WHEN 1 THEN 'multiclass_classification' ELSE 'regression' END AS task, CASE o_custkey % 3 WHEN 0 THEN 'roc_auc' WHEN 1 THEN 'roc_auc_ovr_macro' ELSE 'r2' END AS metric FROM orders) WHERE (task, metric) IN (('binary_classification', 'roc_auc'), ('multiclass_classification', 'roc_auc_ovr_macro'), ('regression', 'r2')) GROUP BY ALL",
)
def headline_rows(spark, sf_dir):
    """Rows of each task's headline metric (a dimension of three fixed rows)."""
    headline = {"binary_classification": "roc_auc", "multiclass_classification": "roc_auc_ovr_macro", "regression": "r2"}
    pick = lambda key, names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(pick("o_orderkey", list(headline)).alias("task"), pick("o_custkey", list(headline.values())).alias("metric"))
    dimension = F.broadcast(spark.createDataFrame(list(headline.items()), "task string, metric string"))
    return rows.join(dimension, ["task", "metric"]).groupBy("task", "metric").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, sf_dir):
    """Labelled documents with their length, a provider's vector and a fold within quality."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.char_length("text")).alias("size"))
    block = decisions(spark, sf_dir).where("provider = 1").select("doc_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))
    labelled = ranks.hash_folds(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality", "toxic"), "doc_id", ["quality"], 5, 20260929)
    return labelled.join(documents, "doc_id").join(block, "doc_id")


@register("cross_validated_probe")
def cross_validated_probe(spark, sf_dir):
    """Out-of-fold probabilities of the quality label from a text's length and a provider's vector, and each fold's penalty."""
    found = probes.cross_validated_logistic(_labelled(spark, sf_dir), "doc_id", ["size", "p0", "p1"], "quality", "fold")
    return rounded(found.select("doc_id", "fold", F.col("y").cast("double").alias("y"), "c", F.col("p")[1].alias("prediction")))


@register("nested_threshold")
def nested_threshold(spark, sf_dir):
    """Each fold's threshold of the highest F1 on the other folds' predictions, and what it gives on the fold itself."""
    found = probes.cross_validated_logistic(_labelled(spark, sf_dir).where("toxic is not null"), "doc_id", ["size", "p0", "p1"], "toxic", "fold").select("doc_id", "fold", "y", F.round(F.col("p")[1], 9).alias("p"))
    found = written_once(found)
    chosen = probes.chosen_thresholds(found, "fold", "y", "p", [i / 50 for i in range(1, 50)])
    rows = found.join(chosen, "fold")
    hit, toxic = F.col("p") >= F.col("threshold"), F.col("y") == 1
    counts = rows.groupBy("fold", "threshold", "f1").agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit & toxic).alias("tp"), F.count_if(hit & ~toxic).alias("fp"), F.count_if(~hit & toxic).alias("fn"))
    return rounded(counts)


@register(
    "target_bins",
    """WITH t AS (SELECT c_custkey, CAST(c_custkey % 5 AS INTEGER) AS fold, c_acctbal AS y FROM customer), f AS (SELECT held, quantile_cont(y, [1/9, 2/9, 3/9, 4/9, 5/9, 6/9, 7/9, 8/9]) AS edges FROM t, (SELECT unnest(range(0, 5)) AS held) WHERE fold <> held GROUP BY held)
    SELECT fold, CAST(len(list_filter(edges, lambda e: e <= y)) AS INTEGER) AS bin, count(*) AS rows, round(min(y), 6) AS low, round(max(y), 6) AS high FROM t JOIN f ON t.fold = f.held GROUP BY ALL""",
)
def target_bins(spark, sf_dir):
    """Account balances in nine bins of equal frequency, whose edges come from the other folds only."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("fold"), F.col("c_acctbal").alias("y"))
    placed = rows.join(probes.equal_frequency_bins(rows, "y", "fold"), "fold").withColumn("bin", probes.bin_of("y", "edges"))
    return rounded(placed.groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("rows"), F.min("y").alias("low"), F.max("y").alias("high")))


@register(
    "decision_redundancy",
    f"""WITH {DECISIONS}, t AS (SELECT k AS option, doc_id, doc_id % 5 AS fold, p AS y, ln(1 + length(text)) AS a, CAST(doc_id % 97 AS DOUBLE) AS b FROM decisions JOIN documents USING (doc_id) WHERE provider = 1 AND text IS NOT NULL),
    f AS (SELECT option, held, count(*) AS n, avg(y) AS level, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb FROM t, (SELECT unnest(range(0, 5)) AS held) WHERE fold <> held GROUP BY ALL),
    w AS (SELECT *, n * ((n + 1) * ca - n * r * cb) / ((n + 1) * (n + 1) - n * r * n * r) AS wa, n * ((n + 1) * cb - n * r * ca) / ((n + 1) * (n + 1) - n * r * n * r) AS wb FROM f)
    SELECT CAST(t.option AS INTEGER) AS option, round(1 - avg(pow(y - (level + wa * (a - ma) / sa + wb * (b - mb) / sb), 2)) / var_pop(y), 6) + 0.0 AS r2 FROM t JOIN w ON t.option = w.option AND t.fold = w.held GROUP BY t.option""",
)
def decision_redundancy(spark, sf_dir):
    """How well other columns predict each element of a provider's vector, out of fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.char_length("text")).alias("size"), (F.col("doc_id") % 97).cast("double").alias("residue"))
    rows = decisions(spark, sf_dir).where("provider = 1").select("doc_id", F.posexplode("p").alias("option", "p")).join(documents, "doc_id").withColumn("fold", F.col("doc_id") % 5)
    out = validation.cross_validate_ridge(rows, "doc_id", ["size", "residue"], "p", "fold", ["option"])
    return rounded(validation.out_of_fold_r2(out, ["option"]))


@register(
    "group_importance",
    f"""WITH {SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY grp ORDER BY sha256('[7,' || doc_id || ']'), doc_id) AS b FROM scores),
    l AS (SELECT -ln(greatest(least(CASE WHEN x.y = 1 THEN x.score ELSE 1 - x.score END, 1 - 1e-15), 1e-15)) AS base, -ln(greatest(least(CASE WHEN x.y = 1 THEN z.score ELSE 1 - z.score END, 1 - 1e-15), 1e-15)) AS moved FROM t x JOIN t z ON x.grp = z.grp AND x.a = z.b)
    SELECT 'score' AS feature_group, round(avg(moved) - avg(base), 6) + 0.0 AS increase FROM l UNION ALL SELECT 'toxic', 0.0""",
)
def group_importance(spark, sf_dir):
    """Increase of the loss when a score is permuted within groups."""
    def loss(df):
        return df.select(metrics.log_loss(F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))).alias("loss"))

    return rounded(validation.permutation_importance(scores(spark, sf_dir), "doc_id", {"score": ["score"], "toxic": ["toxic"]}, ["grp"], loss, 7))


@register(
    "score_ranges",
    f"""WITH {DECISIONS}, w AS (SELECT doc_id, provider, k, greatest(round(p, 2) - 0.005, 0) AS lo, least(round(p, 2) + 0.005, 1) AS hi FROM decisions),
    v AS (SELECT doc_id, provider, sum(lo * (k - 1)) AS base, 1 - sum(lo) AS missing, max(hi - lo) FILTER (k = 0) AS a, max(hi - lo) FILTER (k = 1) AS b, max(hi - lo) FILTER (k = 2) AS c FROM w GROUP BY ALL),
    f AS (SELECT *, greatest(0, least(missing, a)) AS low_a, greatest(0, least(missing, c)) AS high_c FROM v)
    SELECT doc_id, CAST(provider AS INTEGER) AS provider, round(base - low_a + greatest(0, least(missing - low_a - greatest(0, least(missing - low_a, b)), c)), 6) + 0.0 AS low, round(base + high_c - greatest(0, least(missing - high_c - greatest(0, least(missing - high_c, b)), a)), 6) + 0.0 AS high FROM f""",
)
def score_ranges(spark, sf_dir):
    """Expected levels that rounding to two digits allows."""
    two = F.transform("p", lambda x: F.round(x, 2))
    return rounded(decisions(spark, sf_dir).select("doc_id", "provider", V.score_range(two, 0.005, -1).alias("s")).select("doc_id", "provider", "s.low", "s.high"))


@register("held_out_rule", f"WITH {HELD_OUT} SELECT count(*) AS units, round(avg(CAST((prediction > 0) = (gain > 0) AS DOUBLE)), 6) AS use_accuracy, round(avg(greatest(gain, 0) - CASE WHEN prediction > 0 THEN gain ELSE 0 END), 6) + 0.0 AS regret FROM held")
def held_out_rule(spark, sf_dir):
    """Accuracy and regret of a rule learned on the other data sets."""
    paired = gains.fold_gains(fold_metrics(spark, sf_dir), F.col("arm") == "N", ["dataset", "model", "fold"])
    rows = gains.headroom_gains(paired, ["dataset", "model", "arm"]).groupBy("arm", "dataset").agg(F.avg("raw_gain").alias("gain"), F.avg("variance").alias("v"))
    predictions = statistics.ridge_leave_one_out(rows, "dataset", ["v"], "gain", ["arm"]).join(rows, ["arm", "dataset"])
    return rounded(validation.rule_quality(predictions, "prediction", "gain"))


@register(
    "fold_standardised",
    """WITH r AS (SELECT c_custkey, CAST(c_custkey % 5 AS INTEGER) AS fold, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS balance, CAST(length(c_name) AS DOUBLE) AS width, CAST(c_nationkey AS DOUBLE) AS nation FROM customer),
    f AS (SELECT held, avg(balance) AS mb, stddev_pop(balance) AS sb, avg(nation) AS mn, stddev_pop(nation) AS sn FROM r, range(0, 5) AS t(held) WHERE fold <> held GROUP BY held)
    SELECT c_custkey, fold, round((coalesce(balance, mb) - mb) / sb, 6) + 0.0 AS balance, CAST(0.0 AS DOUBLE) AS width, round((nation - mn) / sn, 6) + 0.0 AS nation FROM r JOIN f ON fold = held""",
)
def fold_standardised(spark, sf_dir):
    """Customers' numbers standardised fold by fold from the other folds' rows; every thirteenth balance is missing, names are all equally long."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("fold"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("balance"), F.length("c_name").cast("double").alias("width"), F.col("c_nationkey").cast("double").alias("nation"))
    return rounded(linear.standardised_by_fold(rows, ["balance", "width", "nation"], "fold"))
