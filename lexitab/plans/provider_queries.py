"""Tables of several providers and encoders over the same rows, token audits, encoded texts, scaled inputs and sizing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.functions import text as X
from lexitab.functions import vectors as V
from lexitab.operators import alignment, features, linear, ranks, relations, statistics, validation
from lexitab.plans.fixtures import DECISIONS, SCORES, decisions, r6, rounded, scores
from lexitab.plans.registry import register
from lexitab.session import scratch, table, written_once
from lexitab.streaming.store import ImmutableStore


@register("aligned_providers", f"WITH {DECISIONS} SELECT doc_id, round(max(p) FILTER (provider = 1 AND k = 0), 6) AS p, round(max(p) FILTER (provider = 2 AND k = 0), 6) AS other FROM decisions GROUP BY doc_id")
def aligned_providers(spark, sf_dir):
    """Two providers side by side, the second in another order of rows; both must have the same rows."""
    rows = decisions(spark, sf_dir).select("doc_id", "provider", F.col("p")[0].alias("p"))
    first, second = (rows.where(F.col("provider") == i).drop("provider") for i in (1, 2))
    return rounded(alignment.aligned(first, second.orderBy(F.desc("doc_id")), "doc_id", {"p": "other"}))


@register("unequal_payloads", "SELECT doc_id, 3 AS providers, 2 AS inputs FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL")
def unequal_payloads(spark, sf_dir):
    """Rows about which one provider was asked with another text than the others."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("provider"))
    payload = F.when((F.col("provider") == 3) & (F.col("doc_id") % 10 == 0), F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return alignment.unequal_inputs(rows, "doc_id", "provider", payload)


@register(
    "merged_grids",
    f"""WITH {DECISIONS}, t AS (SELECT doc_id, provider, max(p) AS top, max(p) FILTER (k = 0) AS first FROM decisions GROUP BY ALL)
    SELECT least(CAST(floor(round(top, 9) / 0.1) AS INTEGER), 9) AS bx, least(CAST(floor(round(first, 9) / 0.1) AS INTEGER), 9) AS b_y, count(*) AS n, round(sum(top), 6) AS weight FROM t GROUP BY ALL""",
)
def merged_grids(spark, sf_dir):
    """The grids of four providers added up cell by cell."""
    rows = decisions(spark, sf_dir).select("provider", F.array_max("p").alias("top"), F.col("p")[0].alias("first"))
    cell = [V.equal_width_bin(F.round(c, 9), 0.0, 1.0, 10).alias(name) for c, name in (("top", "bx"), ("first", "b_y"))]
    grids = rows.groupBy("provider", *cell).agg(F.count(F.lit(1)).alias("n"), F.sum("top").alias("weight"))
    return rounded(alignment.merged_grids(grids, ["bx", "b_y"], ["n", "weight"]))


@register("scatter_sample", f"WITH {DECISIONS} SELECT CAST(provider AS INTEGER) AS provider, doc_id, round(max(p), 6) AS top FROM decisions GROUP BY doc_id, provider QUALIFY row_number() OVER (PARTITION BY provider ORDER BY sha256('[11,' || doc_id || ']'), doc_id) <= 25")
def scatter_sample(spark, sf_dir):
    """Twenty-five points of each provider (a sampling operator), the same for any partitioning."""
    rows = decisions(spark, sf_dir).select("provider", "doc_id", r6(F.array_max("p")).alias("top"))
    return alignment.sample_each(rows, ["provider"], "doc_id", 25, 11)


def count_words(text: str) -> int:
    """A token counter for audits: runs of letters and digits, and single other characters that aren't white space."""
    return len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", text, re.ASCII))


@register(
    "token_audit",
    """WITH t AS (SELECT source, text, length(regexp_replace(regexp_replace(text, '[A-Za-z0-9]+', 'a', 'g'), '[ \\t\\n\\r\\f\\v]', '', 'g')) AS tokens FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S'))
    SELECT source, count(*) AS texts, count(DISTINCT text) AS distinct_texts, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS longest, round(quantile_cont(tokens, 0.5), 6) AS q50, round(quantile_cont(tokens, 0.95), 6) AS q95, count(*) FILTER (tokens > 512) AS over_512, count(*) FILTER (tokens > 2048) AS over_2048 FROM t GROUP BY source""",
)
def token_audit(spark, sf_dir):
    """Exact tokens of each source by an injected counter, each distinct text counted once."""
    counter = alignment.token_counter(count_words)
    return rounded(alignment.token_audit(table(spark, sf_dir, "documents"), "text", ["source"], counter, [512, 2048], [0.5, 0.95]))


@register("token_audit_by_ranks")
def token_audit_by_ranks(spark, sf_dir):
    """Exact tokens of each source by a public vocabulary's byte-pair ranks, each distinct text counted once."""
    import public_tokenizers

    counter = alignment.rank_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rounded(alignment.token_audit(table(spark, sf_dir, "documents"), "text", ["source"], counter, [512, 2048], [0.5, 0.95]))


def letter_shares(texts: list[str]) -> list[list[float]]:
    """An encoder for tests and examples: how often e, n and a stand in each text, and one more."""
    return [[float(t.count("e")), float(t.count("n")), float(t.count("a")), 1.0] for t in texts]


@register(
    "encoded_store",
    """WITH t AS (SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 'n', '')) AS n, length(text) - length(replace(text, 'a', '')) AS a FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S'))
    SELECT doc_id, round(e / sqrt(e * e + n * n + a * a + 1), 6) AS x, round(n / sqrt(e * e + n * n + a * a + 1), 6) AS y, round(1 / sqrt(e * e + n * n + a * a + 1), 6) AS w FROM t""",
)
def encoded_store(spark, sf_dir):
    """Vectors of distinct texts put into a store in two runs, the second of which encodes what is pending only, and linked to rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.text_value("text").alias("text")).where("text is not null").withColumn("key", X.digest("text"))
    schema = T.StructType().add("key", "string").add("vector", T.ArrayType(T.DoubleType()))
    v = F.col("vector")
    with scratch(spark) as folder:
        store = ImmutableStore(spark, f"{folder}/vectors", schema, ["key"])
        for wanted in (rows.where("doc_id % 3 = 0"), rows):
            pending = store.pending(wanted)
            texts = wanted.join(pending, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
            store.put(alignment.encoded_texts(texts, "key", "text", letter_shares))
        return written_once(rows.select("doc_id", "key").join(store.read(), "key").select("doc_id", r6(v[0]).alias("x"), r6(v[1]).alias("y"), r6(v[3]).alias("w")))


_HALVES = """s AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS u, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY sha256('[42,' || vec_id || ']'), vec_id) - 1 AS pos FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL QUALIFY pos < 500),
    d AS MATERIALIZED (SELECT x.label, CAST(x.pos AS INTEGER) AS a, CAST(y.pos AS INTEGER) AS b, round(1 - list_cosine_similarity(x.u, y.u), 9) AS u, round(1 - list_cosine_similarity(x.v, y.v), 9) AS v FROM s x JOIN s y ON x.label = y.label AND x.pos < y.pos)"""


def _half_distances(spark, sf_dir):
    """(points, pairs): distances by the halves of the vectors, as two encoders would give them, over up to 500 vectors of each label."""
    halves = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("u"), F.slice("embedding", 33, 32).alias("v"))
    return relations.pairs_of_points(halves, "vec_id", "label", {"u": "cosine", "v": "cosine"})


_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"


@register(
    "distance_relation",
    f"""WITH {_HALVES}, r AS MATERIALIZED (SELECT label, a, b, {_RANK.format(k="label", c="u")} AS x, {_RANK.format(k="label", c="v")} AS y FROM d), base AS (SELECT label, count(*) AS pairs, corr(x, y) AS rho FROM r GROUP BY label),
    m AS (SELECT label, draw, pos AS new, row_number() OVER (PARTITION BY label, draw ORDER BY sha256('[' || (42 + draw) || ',' || vec_id || ']'), vec_id) - 1 AS old FROM s, range(1, 20) AS t(draw)),
    null_rho AS (SELECT r.label AS label, ma.draw AS draw, corr(own.x, r.y) AS rho FROM r JOIN m ma ON ma.label = r.label AND ma.old = r.a JOIN m mb ON mb.label = r.label AND mb.draw = ma.draw AND mb.old = r.b
        JOIN r own ON own.label = r.label AND own.a = least(ma.new, mb.new) AND own.b = greatest(ma.new, mb.new) GROUP BY ALL),
    n AS (SELECT label, avg(z.rho) AS null_mean, (1 + count(*) FILTER (abs(z.rho) >= abs(base.rho) - 1e-12)) / 20.0 AS p FROM null_rho z JOIN base USING (label) GROUP BY label),
    kept AS (SELECT label, part, u, v FROM d, range(0, 8) AS t(part) WHERE a % 8 <> part AND b % 8 <> part), kr AS (SELECT label, part, {_RANK.format(k="label, part", c="u")} AS x, {_RANK.format(k="label, part", c="v")} AS y FROM kept),
    o AS (SELECT label, min(rho) AS low, max(rho) AS high FROM (SELECT label, part, corr(x, y) AS rho FROM kr GROUP BY ALL) GROUP BY label)
    SELECT label, (SELECT count(*) FROM s WHERE s.label = base.label) AS points, pairs, round(rho, 6) + 0.0 AS rho, round(null_mean, 6) + 0.0 AS null_mean, round(p, 6) AS p, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, 'measured' AS status FROM base JOIN n USING (label) JOIN o USING (label)""",
)
def distance_relation(spark, sf_dir):
    """Spearman correlation of two encoders' distances within each label, its permutation null, and its range with parts left out."""
    return rounded(relations.distance_relation(*_half_distances(spark, sf_dir), "label", "u", "v"))


@register(
    "neighbour_overlap",
    f"""WITH {_HALVES}, e AS (SELECT label, a AS point, u, v FROM d UNION ALL SELECT label, b, u, v FROM d), z AS (SELECT label, count(*) AS n, least(10, greatest(1, (count(*) - 1) // 2)) AS k FROM s GROUP BY label),
    w AS (SELECT e.label, n, k, greatest(0, least(1, (k - (rank() OVER (PARTITION BY e.label, point ORDER BY u) - 1)) / count(*) OVER (PARTITION BY e.label, point, u))) AS x, greatest(0, least(1, (k - (rank() OVER (PARTITION BY e.label, point ORDER BY v) - 1)) / count(*) OVER (PARTITION BY e.label, point, v))) AS y FROM e JOIN z USING (label))
    SELECT label, CAST(k AS INTEGER) AS k, round(sum(x * y) / (n * k), 6) AS overlap, round(k / (n - 1), 6) AS chance FROM w GROUP BY label, n, k""",
)
def neighbour_overlap(spark, sf_dir):
    """How many of a vector's nearest two encoders agree on, and how many chance would give."""
    return rounded(relations.neighbour_agreement(*_half_distances(spark, sf_dir), "label", "u", "v"))


@register(
    "benchmark_sizing",
    """WITH t AS (SELECT event_type AS model, max(value) / 10 AS slowest, count(*) AS rows FROM events GROUP BY event_type), h AS (SELECT *, slowest * rows / 3600 AS hours FROM t)
    SELECT model, round(slowest, 6) AS slowest, round(hours, 6) AS hours, CASE WHEN hours <= 1 THEN 1 WHEN hours <= 4 THEN 4 WHEN hours <= 12 THEN 12 ELSE 24 END AS limit_hours, CAST(ceil(hours / 24) AS BIGINT) AS workers FROM h""",
)
def benchmark_sizing(spark, sf_dir):
    """The slowest seconds a row of each model, its hours, the least time limit that holds them, and how many workers 24 hours take."""
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg((F.max("value") / 10).alias("slowest"), F.count(F.lit(1)).alias("rows"))
    hours = sums.withColumn("hours", F.col("slowest") * F.col("rows") / 3600)
    limit = F.coalesce(F.get(F.filter(F.array(*map(F.lit, (1, 4, 12))), lambda b: b >= F.col("hours")), F.lit(0)), F.lit(24))
    return rounded(hours.select("model", "slowest", "hours", limit.alias("limit_hours"), F.ceil(F.col("hours") / 24).alias("workers")))


@register(
    "crossfit_assembly",
    f"""WITH {DECISIONS}, f AS (SELECT doc_id, provider AS part, p FROM decisions WHERE k = 0), r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 4 + 1 END AS held FROM documents) SELECT doc_id, round(avg(p), 6) AS p FROM f JOIN r USING (doc_id) WHERE held IS NULL OR held = part GROUP BY doc_id""",
)
def crossfit_assembly(spark, sf_dir):
    """For training rows the fit that held them out, for test rows (each seventh) the mean of all fits."""
    fits = decisions(spark, sf_dir).select("doc_id", F.col("provider").alias("part"), F.col("p")[0].alias("p"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 4 + 1).alias("held_part"))
    return rounded(validation.assemble_crossfit(fits, rows, "doc_id"))


@register(
    "ordinal_targets",
    f"""WITH {SCORES} SELECT doc_id, round(1 - score, 6) AS p0, round(score, 6) AS p1, round(score / (score + 1), 6) AS share, CAST(CASE WHEN y = 0 THEN 0.9 ELSE 0.05 END AS DOUBLE) AS t0, CAST(CASE WHEN y = 1 THEN 0.9 ELSE 0.1 END AS DOUBLE) AS t1, CAST(CASE WHEN y = 1 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS t2, round(score, 2) = score AS two_digits FROM scores""",
)
def ordinal_targets(spark, sf_dir):
    """Completed vectors, normalised weights, smoothed targets of three ordered levels, and which scores have two digits at most."""
    two, share = V.binary_vector("score"), V.normalised(F.array("score", F.lit(1.0)))
    target = V.ordinal_target("y", 3, 0.1)
    return scores(spark, sf_dir).select("doc_id", r6(two[0]).alias("p0"), r6(two[1]).alias("p1"), r6(share[0]).alias("share"), *[r6(target[i]).alias(f"t{i}") for i in range(3)], V.within_rounding("score", 2).alias("two_digits"))


@register("number_texts", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(CAST(vec_id AS DOUBLE) / 2 AS VARCHAR) END AS said FROM embeddings")
def number_texts(spark, sf_dir):
    """Numbers as text; NaN and infinity have none."""
    number = F.when(F.col("vec_id") % 6 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("vec_id").cast("double") / 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", X.number_text(number).alias("said"))


@register("order_multiplicity", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS alike FROM orders")
def order_multiplicity(spark, sf_dir):
    """How many orders have this one's customer and status."""
    return table(spark, sf_dir, "orders").select("o_orderkey", ranks.multiplicity("o_custkey", "o_orderstatus").alias("alike"))


@register(
    "selected_block",
    f"""WITH {DECISIONS} SELECT doc_id, round(max(p) FILTER (provider = 1 AND k = 1), 6) AS one, round(max(p) FILTER (provider = 2 AND k = 1), 6) AS two FROM decisions GROUP BY doc_id""",
)
def selected_block(spark, sf_dir):
    """The one block that a selector with a null names, without the columns of one field; what is left goes by provider."""
    blocks = spark.createDataFrame([("a", None, "wide"), ("a", "x", "narrow"), ("b", None, "narrow")], "provider string, mode string, kind string")
    chosen = features.exactly_one(features.select_where(blocks, {"provider": "a", "mode": None}), "block")
    wide = decisions(spark, sf_dir).where("provider <= 2").groupBy("doc_id").pivot("provider", [1, 2]).agg(F.first("p"))
    names = {1: "one", 2: "two"}
    columns = [F.col(f"`{i}`")[k].alias(f"{names[i]}__main__{field}__k{k}") for i in names for field, k in (("text", 0), ("joint", 1))]
    kept = features.without_block(wide.select("doc_id", *columns), "__text__") if chosen["kind"] == "wide" else wide
    groups = features.column_groups([c for c in kept.columns if c != "doc_id"])
    return rounded(kept.select("doc_id", *[F.col(c[0]).alias(provider) for (provider, _, _), c in groups.items()]))


@register("provider_pairs", f"WITH {DECISIONS} SELECT CAST(a.provider AS INTEGER) AS a, CAST(b.provider AS INTEGER) AS b, count(*) AS n, round(avg(abs(a.p - b.p)), 6) AS gap FROM decisions a JOIN decisions b USING (doc_id, k) WHERE a.provider < b.provider AND k = 0 GROUP BY ALL")
def provider_pairs(spark, sf_dir):
    """The mean gap of each pair of a declared roster, from one wide row a document."""
    wide = decisions(spark, sf_dir).groupBy("doc_id").pivot("provider", [1, 2, 3, 4]).agg(F.first(F.col("p")[0]))
    pairs = statistics.pairs_of(["1", "2", "3", "4"])
    sums = wide.agg(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b"), F.count(F.col(f"`{a}`") - F.col(f"`{b}`")).alias("n"), F.avg(F.abs(F.col(f"`{a}`") - F.col(f"`{b}`"))).alias("gap")).alias(f"s{a}{b}") for a, b in pairs])
    return rounded(sums.select(F.explode(F.array(*[f"s{a}{b}" for a, b in pairs])).alias("s")).select("s.*"))


@register(
    "scaled_inputs",
    """WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT o_orderkey, round((o_totalprice - m) / s, 6) + 0.0 AS o_totalprice, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent, CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS unsaid, 4 AS width FROM orders, m""",
)
def scaled_inputs(spark, sf_dir):
    """Numbers scaled and categories one-hot, both by the training rows; a category that training lacks has no place."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    train = orders.where("o_orderkey % 5 <> 0")
    hot = linear.one_hot(train.where("o_orderpriority <> '5-LOW'"), linear.standardised(train, orders, ["o_totalprice"]), "o_orderpriority")
    names = F.col("o_orderpriority_hot")
    return rounded(hot.select("o_orderkey", "o_totalprice", names[0].alias("urgent"), names[3].alias("unsaid"), F.size(names).alias("width")))
