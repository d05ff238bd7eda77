"""Merges, ledgers, events, vectors and interventions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.functions.json_values import canonical_json, json_numbers, largest_change
from lexitab.operators import dedup, geometry, linear, long_texts, ordered, ranks
from lexitab.plans.fixtures import r6, rounded
from lexitab.plans.registry import register
from lexitab.session import scratch, table
from lexitab.sources.tables import flatten_numbers
from lexitab.streaming.incremental import event_sessions, event_windows


@register("version_ledger", "SELECT event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS version, count(*) AS responses, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL")
def version_ledger(spark, sf_dir):
    """Responses by kind and version, with the times of the first and the last."""
    version = F.get_json_object("props", "$.k").cast("long") % 5
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), version.alias("version")).agg(F.count(F.lit(1)).alias("responses"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


_CELLS = """cells AS (SELECT event_id, event_type, '{"a":{"user":' || user_id || ',"b":{"c":{"d":{"five":' || length(event_type) || '}}}},"list":[' || event_id || ',"12",true,null,{"x":[' || event_id % 7 || ',' || value || ']}],"s":"12","t":false,"props":' || props || '}' AS cell FROM events)"""


def _cells(spark, sf_dir):
    """Events as JSON cells of five levels, with lists, strings, booleans and nulls beside the numbers."""
    said = ['{"a":{"user":', "user_id", ',"b":{"c":{"d":{"five":', F.length("event_type"), '}}}},"list":[', "event_id", ',"12",true,null,{"x":[', F.col("event_id") % 7, ",", "value", ']}],"s":"12","t":false,"props":', "props", "}"]
    parts = [F.lit(x) if i % 2 == 0 else (F.col(x) if isinstance(x, str) else x).cast("string") for i, x in enumerate(said)]
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.concat(*parts).alias("cell"))


@register(
    "json_metrics",
    f"WITH {_CELLS} SELECT event_type, substr(t.fullkey, 3) AS metric, count(*) AS n, round(avg(CAST(t.atom AS DOUBLE)), 6) AS mean FROM cells, json_tree(cell) t WHERE t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') GROUP BY ALL",
)
def json_metrics(spark, sf_dir):
    """The numbers of nested JSON cells as long rows, summed up by path."""
    long = flatten_numbers(_cells(spark, sf_dir), ["event_id", "event_type"], "cell")
    return rounded(long.groupBy("event_type", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@register("canonical_cells", "SELECT o_orderkey, '{\"a\":[null,true,{\"k\":\"' || o_orderpriority || '\",\"é\":' || o_custkey || '}],\"b\":null,\"z\":{\"m\":\"' || o_orderstatus || '\",\"n\":[]}}' AS cell FROM orders")
def canonical_cells(spark, sf_dir):
    """JSON cells with keys in any order and white space, in their canonical form."""
    said = ['{ "z" : {"n": [ ], "m": "', "o_orderstatus", '"},\n "b":null, "a":[null, true, {"\\u00e9": ', "o_custkey", ', "k" :"', "o_orderpriority", '"}] }']
    cell = F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(said)])
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical_json(cell).alias("cell"))


@register(
    "replayed_answers",
    """WITH e AS (SELECT user_id, event_id, value, lead(event_id) OVER w AS other, lead(value) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, count(*) AS pairs, count(*) FILTER (event_id % 3 = other % 3) AS comparable, round(max(greatest(abs(later - value), abs(other % 7 - event_id % 7))) FILTER (event_id % 3 = other % 3), 6) AS largest_change FROM e WHERE other IS NOT NULL GROUP BY user_id""",
)
def replayed_answers(spark, sf_dir):
    """The largest change between a user's answers and the next ones, where both have the same numbers."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct(F.struct("value", F.array(F.col("event_id") % 7).alias("x")).alias("p"), F.when(F.col("event_id") % 3 == 0, 1).alias("three"), F.when(F.col("event_id") % 3 == 1, 1).alias("one"))).alias("cell"))
    rows = rows.withColumn("numbers", json_numbers("cell"))
    following = F.lead("numbers").over(W.partitionBy("user_id").orderBy("event_id"))
    pairs = rows.withColumn("later", following).where("later is not null").withColumn("change", largest_change(F.col("numbers"), F.col("later")))
    return rounded(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.count("change").alias("comparable"), F.max("change").alias("largest_change")))


@register("timing_summary", "SELECT event_type AS stage, CAST(user_id % 7 AS INTEGER) AS dataset, count(*) AS n, round(sum(value), 6) AS seconds, round(avg(value), 6) AS mean, round(max(value), 6) AS longest, count(*) FILTER (value > 50) AS slow FROM events GROUP BY ALL")
def timing_summary(spark, sf_dir):
    """A timing journal by stage and data set."""
    v = F.col("value")
    return rounded(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 7).cast("int").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("seconds"), F.avg(v).alias("mean"), F.max(v).alias("longest"), F.count_if(v > 50).alias("slow")))


@register("repeat_consistency", "SELECT lang, count(*) AS texts, count(*) FILTER (langs > 1) AS inconsistent FROM (SELECT md5(text) AS k, min(lang) AS lang, count(DISTINCT lang) AS langs FROM documents GROUP BY k) GROUP BY lang")
def repeat_consistency(spark, sf_dir):
    """Equal inputs that carry unlike values."""
    per = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.min("lang").alias("lang"), F.countDistinct("lang").alias("langs"))
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("langs") > 1).alias("inconsistent"))


def _stores(spark, sf_dir):
    """Two overlapping stores: even customers and customers in threes; the second has other balances for every thirtieth."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    first = customers.where("key % 2 = 0")
    return first, customers.where("key % 3 = 0").withColumn("value", F.when(F.col("key") % 30 == 0, F.col("value") + 1).otherwise(F.col("value")))


_STORES = "a AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 30 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS value FROM customer WHERE c_custkey % 3 = 0)"


@register("merge_conflicts", f"WITH {_STORES} SELECT key FROM a JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def merge_conflicts(spark, sf_dir):
    """Keys that two stores have with unlike values."""
    return dedup.conflicts(*_stores(spark, sf_dir), ["key"])


@register("store_upsert", f"WITH {_STORES} SELECT key, round(coalesce(b.value, a.value), 6) AS value FROM a FULL JOIN b USING (key)")
def store_upsert(spark, sf_dir):
    return rounded(dedup.upsert(*_stores(spark, sf_dir), ["key"]))


@register("store_union", f"WITH {_STORES} SELECT key, round(value, 6) AS value FROM a UNION ALL SELECT key, round(value, 6) FROM b WHERE key % 30 <> 0 AND key NOT IN (SELECT key FROM a)")
def store_union(spark, sf_dir):
    """Union of stores that agree on their common keys."""
    first, second = _stores(spark, sf_dir)
    return rounded(dedup.lossless_union(first, second.where("key % 30 <> 0"), ["key"]))


@register("store_differences", f"WITH {_STORES} SELECT key, round(value, 6) AS value, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT key, round(value, 6), 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def store_differences(spark, sf_dir):
    """Rows that one store has and the other hasn't."""
    return rounded(dedup.differences(*_stores(spark, sf_dir)))


@register("priority_distinct", "SELECT c_nationkey, c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 ELSE 1 END, c_custkey) = 1")
def priority_distinct(spark, sf_dir):
    """One customer for each nation, from a preferred segment if there is one."""
    order = F.struct(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("o"), "c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min(order).alias("m")).select("c_nationkey", "m.c_custkey", "m.c_mktsegment")


@register("pending_work", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pending_work(spark, sf_dir):
    """Wanted keys that the store lacks."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return wanted.join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key", "left_anti")


@register("event_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_by_window(spark, sf_dir):
    """Six-hour windows of event time."""
    return rounded(event_windows(table(spark, sf_dir, "events"), "6 hours"))


@register(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark, sf_dir):
    """Sessions of users with gaps under two hours."""
    return event_sessions(table(spark, sf_dir, "events"), "2 hours")


@register(
    "vector_neighbours",
    """WITH q AS (SELECT vec_id AS query, label, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.label, query, vec_id AS other, round(1 - list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS distance FROM q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.query),
    r AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY distance) - 1 AS below, count(*) OVER (PARTITION BY query, distance) AS ties FROM d) SELECT label, query, other, round(distance, 6) AS distance, round(greatest(0, least(1.0, (5 - below) / ties)), 6) AS weight FROM r WHERE 5 - below > 0""",
)
def vector_neighbours(spark, sf_dir):
    """The five nearest vectors of the same label of a stated query set, with shares for ties at the edge."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs = geometry.query_distances(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", "label")
    return rounded(ranks.neighbour_weights(pairs.withColumn("distance", F.round("distance", 9)), "query", "distance", 5))


@register("principal_components")
def principal_components(spark, sf_dir):
    """Every vector on four principal axes fitted on the vectors of even id."""
    vectors = table(spark, sf_dir, "embeddings")
    mean, axes, _ = linear.principal_axes(vectors.where("vec_id % 2 = 0"), "embedding", 4)
    out = linear.project(vectors, "embedding", mean, axes)
    return out.select("vec_id", *[r6(F.col("components")[i]).alias(f"c{i + 1}") for i in range(len(axes))])


@register(
    "fold_inputs",
    """WITH t AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderkey % 5 = 0 AS test FROM orders), v AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM t WHERE NOT test AND o_orderpriority <> '5-LOW'))
    SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, CAST(code AS INTEGER) AS o_orderpriority FROM t LEFT JOIN v ON o_orderpriority = v""",
)
def fold_inputs(spark, sf_dir):
    """Codes from the training rows' vocabulary; a category that training lacks is missing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    train = orders.where("o_orderkey % 5 <> 0 and o_orderpriority <> '5-LOW'")
    return rounded(linear.FoldInput(["o_totalprice"], [], ["o_orderpriority"]).fit(train).transform(orders))


@register(
    "interventions",
    """SELECT conv_id, turn, variant, CASE variant WHEN 'original' THEN role || ': ' || text WHEN 'reversed_fields' THEN text || ' (' || role || ')' ELSE reverse(role) || ': ' || text END AS request FROM conversations, (SELECT unnest(['original', 'reversed_fields', 'reversed_role']) AS variant)""",
)
def interventions(spark, sf_dir):
    """Variants of each request: as it is, with the fields the other way round, with the role's letters reversed."""
    option = lambda name, text: F.struct(F.lit(name).alias("variant"), text.alias("request"))
    options = F.array(option("original", F.concat("role", F.lit(": "), "text")), option("reversed_fields", F.concat("text", F.lit(" ("), "role", F.lit(")"))), option("reversed_role", F.concat(F.reverse("role"), F.lit(": "), "text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(options).alias("o")).select("conv_id", "turn", "o.*")


@register("plan_arms", "SELECT r_name AS dataset, p_brand AS provider, size, CAST(draw AS INTEGER) AS draw, sha256(r_name || '/' || p_brand || '/' || size || '/' || draw) AS arm_id FROM region, (SELECT DISTINCT p_brand FROM part), (SELECT unnest([16, 128, 512]) AS size), (SELECT unnest(range(0, 3)) AS draw)")
def plan_arms(spark, sf_dir):
    """Every combination of data set, provider, size and draw: dimensions of a few rows each, listed in the plan."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider")).distinct()
    names = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_set("r_name")).alias("names"))
    rows = brands.join(F.broadcast(names)).select(F.explode("names").alias("dataset"), "provider")
    rows = rows.withColumn("size", F.explode(F.array(*map(F.lit, (16, 128, 512))))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.withColumn("arm_id", F.sha2(F.concat_ws("/", "dataset", "provider", F.col("size").cast("string"), F.col("draw").cast("string")), 256))


@register("bucketed_hours", "SELECT event_type, CASE WHEN value <= 2 THEN 2 WHEN value <= 6 THEN 6 WHEN value <= 12 THEN 12 WHEN value <= 24 THEN 24 WHEN value <= 48 THEN 48 ELSE 72 END AS hours, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY ALL")
def bucketed_hours(spark, sf_dir):
    """The smallest time bucket that holds each duration."""
    bucket = F.coalesce(F.get(F.filter(F.array(*map(F.lit, (2, 6, 12, 24, 48))), lambda b: b >= F.col("value")), F.lit(0)), F.lit(72))
    return rounded(table(spark, sf_dir, "events").groupBy("event_type", bucket.alias("hours")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")))


@register("rollup_revenue", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark, sf_dir):
    """An extra: subtotals by grouping sets."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("field_components")
def field_components(spark, sf_dir):
    """Axes of two halves of the vectors, each by itself and joined, fitted on those of even id and found in the cache the second time."""
    half = lambda start: F.slice("embedding", start, 32)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 != 0, half(1)).alias("u"), F.when(F.col("vec_id") % 7 != 0, half(33)).alias("v"))
    train = rows.where("vec_id % 2 = 0")
    with scratch(spark) as folder:
        cache = linear.FitCache(spark, f"{folder}/fits")
        for scope, kind in (("per_field", False), ("joint", True)):
            linear.FieldAxes(["u", "v"], 3, scope, kind).fit(train, cache)
        made = cache.made
        fits = [linear.FieldAxes(["u", "v"], 3, scope, kind).fit(train.repartition(3), cache) for scope, kind in (("per_field", False), ("joint", True))]
        if cache.made != made or cache.found != made:
            raise ValueError("a fit on the same rows was made twice")
    for fit in fits:
        rows = fit.transform(rows)
    return rows.select("vec_id", *[r6(F.col(f"{name}_axes")[i]).alias(f"{name}{i}") for name in ("u", "v", "joint") for i in range(3)])


_LETTERS = "etaoinsr"


def _letter_counts(texts: list[str]):
    """How often each of eight letters comes in a text, after A-Z are lower-cased."""
    return np.array([[t.count(c) + t.count(c.upper()) for c in _LETTERS] for t in texts], float).reshape(-1, len(_LETTERS))


@register(
    "long_text_vectors",
    f"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''), c AS (SELECT doc_id, i, w[i * 96 + 1 : i * 96 + 128] AS part FROM t, range(0, 10000) AS r(i) WHERE i <= greatest(0, ceil((len(w) - 128) / 96.0))),
    v AS (SELECT doc_id, len(part) AS n, translate(array_to_string(part, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM c),
    s AS (SELECT doc_id, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, {", ".join(f"CAST(sum(n * (length(x) - length(replace(x, '{c}', '')))) AS DOUBLE) / sum(n) AS {c}" for c in _LETTERS)} FROM v GROUP BY doc_id), z AS (SELECT *, sqrt({" + ".join(f"{c} * {c}" for c in _LETTERS)}) AS norm FROM s)
    SELECT doc_id, pieces, tokens, round(norm, 6) AS norm, round(e / nullif(norm, 0), 6) AS first, round(r / nullif(norm, 0), 6) AS last FROM z""",
)
def long_text_vectors(spark, sf_dir):
    """Vectors of whole documents from overlapping pieces of 128 words, weighted by their words."""
    found = long_texts.embedded(table(spark, sf_dir, "documents"), "doc_id", "text", _letter_counts, budget=128, overlap=32)
    return rounded(found.select("doc_id", "pieces", "tokens", "norm", F.col("vector")[0].alias("first"), F.col("vector")[7].alias("last")))


@register(
    "moving_events",
    """SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS place, round(sum(value) OVER (w ROWS BETWEEN 150 PRECEDING AND 10 FOLLOWING), 6) AS total, round(max(value) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS highest, round(lag(value, 3) OVER w, 6) AS third_before, lead(event_id, 2) OVER w AS second_after,
    ntile(7) OVER w AS tile, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def moving_events(spark, sf_dir):
    """Frames of rows, rows before and after, tiles, and the ends of each type's events in order of time; stretches of 64 rows, so frames cross their edges."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    frames = {
        "total": (150, 10, lambda w: F.sum("value").over(w)),
        "highest": (7, 0, lambda w: F.max("value").over(w)),
        "third_before": (3, 0, lambda w: F.first(F.struct("value", F.col("__at").alias("n"))).over(w)),
        "second_after": (0, 2, lambda w: F.last(F.struct("event_id", F.col("__at").alias("n"))).over(w)),
    }
    order = [F.col("ts"), F.col("event_id")]
    rows = ordered.moving(events, ["event_type"], ordered.bucket_of("at", ordered.edges(events, "at")), order, frames, place="place", stretch=64)
    key = F.struct("ts", "event_id")
    ends = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.min_by("event_id", key).alias("first_id"), F.max_by("event_id", key).alias("last_id"))
    rows = rows.join(ends, "event_type")
    away = lambda c, field, n: F.when(F.abs(F.col(f"{c}.n") - F.col("place")) == n, F.col(f"{c}.{field}")).alias(c)
    return rounded(rows.select("event_id", "place", "total", "highest", away("third_before", "value", 3), away("second_after", "event_id", 2), ordered.tile(F.col("place"), F.col("rows"), 7).alias("tile"), "first_id", "last_id"))
