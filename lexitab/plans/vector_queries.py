"""Comparison of the probability vectors that several providers give for the same documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.functions import vectors as V
from lexitab.operators import diagnostics, ranks
from lexitab.operators.gains import balanced_mean
from lexitab.plans.fixtures import DECISIONS, decisions, r6, rounded
from lexitab.plans.registry import register
from lexitab.session import table, written_once

#: The top answer of each vector in SQL.
_TOPS = DECISIONS + """, best AS (SELECT doc_id, provider, max(p) AS m FROM decisions GROUP BY ALL), tops AS (
    SELECT d.doc_id, d.provider, CAST(CASE WHEN count(*) FILTER (p >= m - 1e-12) > 1 THEN -99 ELSE min(k) FILTER (p = m) END AS INTEGER) AS answer, max(m) AS top_p
    FROM decisions d JOIN best b ON d.doc_id = b.doc_id AND d.provider = b.provider GROUP BY d.doc_id, d.provider)"""
_PAIRS = DECISIONS + """, pairs AS (
    SELECT a.doc_id, a.provider AS a, b.provider AS b, a.k, a.p, b.p AS q, sum(a.p - b.p) OVER (PARTITION BY a.doc_id, a.provider, b.provider ORDER BY a.k) AS run
    FROM decisions a JOIN decisions b ON a.doc_id = b.doc_id AND a.k = b.k AND a.provider < b.provider), distances AS (
    SELECT doc_id, a, b, sum(abs(p - q)) / 2 AS tv, sum(CASE WHEN k < 2 THEN abs(run) ELSE 0 END) AS emd, 0.5 * sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) AS js FROM pairs GROUP BY ALL)"""


def _tops(spark, sf_dir):
    return decisions(spark, sf_dir).select("doc_id", "provider", "p", V.top_answer("p").cast("int").alias("answer"), F.array_max("p").alias("top_p"))


def _pairs(spark, sf_dir):
    """Both vectors of each pair of providers: one row for each document first, so the join is on the document only."""
    rows = decisions(spark, sf_dir).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("provider", "p"))).alias("ps"))
    names = ranks_pairs()
    rows = rows.select("doc_id", "ps", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in names])).alias("pair"))
    return rows.select("doc_id", "pair.a", "pair.b", F.col("ps")[F.col("pair.a")].alias("p"), F.col("ps")[F.col("pair.b")].alias("q"))


def ranks_pairs():
    return [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]


@register(
    "vector_shapes",
    f"""WITH {DECISIONS} SELECT doc_id, provider, round(-sum(p * ln(p)) / ln(3), 6) AS entropy, round(sum(p * (k - 1)), 6) AS level, round(sum(p * (k - 1) * (k - 1)) - sum(p * (k - 1)) * sum(p * (k - 1)), 6) + 0.0 AS spread, round(max(p), 6) AS top_p FROM decisions GROUP BY ALL""",
)
def vector_shapes(spark, sf_dir):
    """Entropy, expected level, level variance and top probability of each vector."""
    return decisions(spark, sf_dir).select("doc_id", "provider", r6(V.entropy("p")).alias("entropy"), r6(V.expected_level("p", -1)).alias("level"), r6(V.level_variance("p", -1)).alias("spread"), r6(F.array_max("p")).alias("top_p"))


@register("vector_distances", f"WITH {_PAIRS} SELECT doc_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(tv, 6) AS tv, round(emd, 6) AS emd, round(js, 6) AS js FROM distances")
def vector_distances(spark, sf_dir):
    """Total variation, earth mover's distance and Jensen-Shannon divergence of every pair of providers."""
    return _pairs(spark, sf_dir).select("doc_id", "a", "b", r6(V.total_variation("p", "q")).alias("tv"), r6(V.earth_movers("p", "q")).alias("emd"), r6(V.js_divergence("p", "q")).alias("js"))


@register("top_answers", f"WITH {_TOPS} SELECT doc_id, CAST(provider AS INTEGER) AS provider, answer, round(top_p, 6) AS top_p FROM tops")
def top_answers(spark, sf_dir):
    """Top answers with abstention on ties."""
    return _tops(spark, sf_dir).select("doc_id", "provider", "answer", r6("top_p").alias("top_p"))


@register(
    "pair_agreement",
    f"""WITH {_TOPS}, pairs AS (SELECT x.doc_id, CAST(x.provider AS INTEGER) AS a, CAST(y.provider AS INTEGER) AS b, x.answer = y.answer AND x.answer >= 0 AS same, x.answer AS xa, y.answer AS ya FROM tops x JOIN tops y ON x.doc_id = y.doc_id AND x.provider < y.provider),
    base AS (SELECT a, b, count(*) AS n, avg(CAST(same AS DOUBLE)) AS agreement FROM pairs WHERE xa >= 0 AND ya >= 0 GROUP BY ALL),
    chance AS (SELECT a, b, sum(px * py) AS expected FROM (SELECT a, b, c, avg(CAST(xa = c AS DOUBLE)) AS px, avg(CAST(ya = c AS DOUBLE)) AS py FROM pairs, (SELECT unnest(range(0, 3)) AS c) WHERE xa >= 0 AND ya >= 0 GROUP BY ALL) GROUP BY ALL)
    SELECT a, b, n, round(agreement, 6) AS agreement, round((agreement - expected) / (1 - expected), 6) AS kappa FROM base JOIN chance USING (a, b)""",
)
def pair_agreement(spark, sf_dir):
    """Agreement and Cohen's kappa of every pair of providers, where both answer."""
    rows = _pairs(spark, sf_dir).select("a", "b", V.top_answer("p").alias("x"), V.top_answer("q").alias("y")).where("x >= 0 and y >= 0")
    share = lambda c: F.avg(c.cast("double"))
    chance = sum((share(F.col("x") == c) * share(F.col("y") == c) for c in range(1, 3)), share(F.col("x") == 0) * share(F.col("y") == 0))
    out = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), share(F.col("x") == F.col("y")).alias("agreement"), chance.alias("expected"))
    return out.select("a", "b", "n", r6("agreement").alias("agreement"), r6((F.col("agreement") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


@register(
    "vote_patterns",
    f"""WITH {_TOPS}, votes AS (SELECT doc_id, answer, count(*) AS n FROM tops WHERE answer >= 0 GROUP BY ALL), rows AS (SELECT doc_id, string_agg(CAST(n AS VARCHAR), ':' ORDER BY n DESC) AS pattern, max(n) AS most, sum(n) AS voters FROM votes GROUP BY doc_id)
    SELECT pattern, count(*) AS documents, CAST(sum(most) AS BIGINT) AS largest_votes FROM rows GROUP BY pattern""",
)
def vote_patterns(spark, sf_dir):
    """How votes split, as counts in falling order."""
    votes = _tops(spark, sf_dir).where("answer >= 0").groupBy("doc_id", "answer").agg(F.count(F.lit(1)).alias("n"))
    rows = votes.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), ":").alias("pattern"), F.max("n").alias("most"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("documents"), F.sum("most").alias("largest_votes"))


@register(
    "plurality_share",
    f"""WITH {_TOPS}, votes AS (SELECT doc_id, answer, count(*) AS n FROM tops WHERE answer >= 0 GROUP BY ALL) SELECT doc_id, round(1.0 * max(n) / sum(n), 6) AS share, CAST(sum(n) AS BIGINT) AS voters FROM votes GROUP BY doc_id HAVING sum(n) >= 2""",
)
def plurality_share(spark, sf_dir):
    """Share of the largest vote among the providers that answer, of two at least."""
    votes = _tops(spark, sf_dir).where("answer >= 0").groupBy("doc_id", "answer").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("doc_id").agg(r6(F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("voters")).where("voters >= 2")


@register(
    "peer_majority",
    f"""WITH {_TOPS}, votes AS (SELECT t.doc_id, t.provider, t.answer AS own, o.answer, count(*) AS n FROM tops t JOIN tops o ON t.doc_id = o.doc_id AND t.provider <> o.provider AND o.answer >= 0 WHERE t.answer >= 0 GROUP BY ALL),
    ranked AS (SELECT *, max(n) OVER (PARTITION BY doc_id, provider) AS most FROM votes), peers AS (SELECT doc_id, provider, own, count(*) FILTER (n = most) AS ties, min(answer) FILTER (n = most) AS peer FROM ranked GROUP BY ALL)
    SELECT CAST(provider AS INTEGER) AS provider, count(*) AS rows, count(*) FILTER (ties > 1) AS undecided, count(*) FILTER (ties = 1 AND own = peer) AS agreeing FROM peers GROUP BY provider""",
)
def peer_majority(spark, sf_dir):
    """Own answers against the unique plurality of the other providers; a tie is undecided."""
    rows = _tops(spark, sf_dir).where("answer >= 0").groupBy("doc_id").agg(F.collect_list(F.struct("provider", "answer")).alias("all"))
    own = rows.select("all", F.explode("all").alias("own"))
    others = F.transform(F.filter("all", lambda x: x["provider"] != F.col("own.provider")), lambda x: x["answer"])
    own = own.withColumn("others", others).where(F.size("others") > 0)
    counts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.size(F.filter("others", lambda x: x == c)))
    own = own.withColumn("counts", counts).withColumn("most", F.array_max("counts"))
    tied = F.size(F.filter("counts", lambda n: n == F.col("most")))
    peer = F.array_position("counts", F.col("most")) - 1
    return own.groupBy(F.col("own.provider").alias("provider")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(tied > 1).alias("undecided"), F.count_if((tied == 1) & (peer == F.col("own.answer"))).alias("agreeing"))


@register(
    "leave_one_out_consensus",
    f"""WITH {DECISIONS}, c AS (SELECT doc_id, provider, k, p, (sum(p) OVER (PARTITION BY doc_id, k) - p) / 3 AS c FROM decisions)
    SELECT doc_id, CAST(provider AS INTEGER) AS provider, round(sum(abs(p - c)) / 2, 6) AS tv, round(sum(p * (k - 1)) - sum(c * (k - 1)), 6) + 0.0 AS level_gap FROM c GROUP BY ALL""",
)
def leave_one_out_consensus(spark, sf_dir):
    """Distance of each vector from the mean of the others."""
    rows = decisions(spark, sf_dir)
    sums = rows.groupBy("doc_id").agg(F.array(*[F.sum(F.col("p")[k]) for k in range(3)]).alias("s"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(sums, "doc_id").withColumn("c", V.mean_of_others(F.col("s"), F.col("p"), F.col("n")))
    return joined.select("doc_id", "provider", r6(V.total_variation("p", "c")).alias("tv"), r6(V.expected_level("p", -1) - V.expected_level("c", -1)).alias("level_gap"))


@register(
    "confidence_bands",
    f"""WITH {_TOPS} SELECT CAST(provider AS INTEGER) AS provider, 'confidence_' || ((top_p >= 0.5)::INT + (top_p >= 0.7)::INT + (top_p >= 0.9)::INT) AS band, count(*) AS rows FROM tops GROUP BY ALL""",
)
def confidence_bands(spark, sf_dir):
    """Documents by band of the top probability."""
    return _tops(spark, sf_dir).groupBy("provider", V.band("top_p", (0.5, 0.7, 0.9), "confidence").alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "answer_histogram",
    f"""WITH {_TOPS}, b AS (SELECT provider, least(CAST(floor((top_p - 0.0) / 0.05) AS INTEGER), 19) AS bin, top_p FROM tops) SELECT CAST(provider AS INTEGER) AS provider, bin, count(*) AS n, round(1.0 * count(*) / sum(count(*)) OVER (PARTITION BY provider), 6) AS share FROM b GROUP BY provider, bin""",
)
def answer_histogram(spark, sf_dir):
    """Equal-width histogram of top probabilities, the last bin closed."""
    counted = _tops(spark, sf_dir).groupBy("provider", V.equal_width_bin("top_p", 0.0, 1.0, 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy("provider"))))


@register(
    "balanced_agreement",
    f"""WITH {_PAIRS}, s AS (SELECT a, b, source, avg(tv) AS m FROM distances JOIN documents USING (doc_id) GROUP BY ALL) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(avg(m), 6) AS mean, count(*) AS datasets FROM s GROUP BY a, b""",
)
def balanced_agreement(spark, sf_dir):
    """Mean total variation with every source weighing the same."""
    rows = _pairs(spark, sf_dir).select("doc_id", "a", "b", V.total_variation("p", "q").alias("tv")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rounded(balanced_mean(rows, ["a", "b"], "source", "tv"))


@register(
    "unique_input_agreement",
    f"""WITH {_PAIRS}, d AS (SELECT distances.*, text, row_number() OVER (PARTITION BY a, b, text ORDER BY doc_id) AS nth FROM distances JOIN documents USING (doc_id))
    SELECT 'rows' AS weighting, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) AS n, round(avg(tv), 6) AS tv FROM d GROUP BY a, b UNION ALL SELECT 'unique', CAST(a AS INTEGER), CAST(b AS INTEGER), count(*), round(avg(tv), 6) FROM d WHERE nth = 1 GROUP BY a, b""",
)
def unique_input_agreement(spark, sf_dir):
    """Every mean twice: over rows and over the first row of each distinct input."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = documents.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = _pairs(spark, sf_dir).select("doc_id", "a", "b", V.total_variation("p", "q").alias("tv")).join(first.select("doc_id", "first"), "doc_id", "left")
    rows = rows.withColumn("weighting", F.explode(F.when(F.col("first"), F.array(F.lit("rows"), F.lit("unique"))).otherwise(F.array(F.lit("rows")))))
    return rows.groupBy("weighting", "a", "b").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("tv")).alias("tv"))


@register(
    "disagreement_examples",
    f"""WITH {_PAIRS} SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY round(tv, 9) DESC, doc_id) AS INTEGER) AS place, doc_id, round(tv, 6) AS tv FROM distances QUALIFY place <= 5""",
)
def disagreement_examples(spark, sf_dir):
    """The five documents on which each pair of providers differs most (a top-k report)."""
    rows = _pairs(spark, sf_dir).select("doc_id", "a", "b", F.round(V.total_variation("p", "q"), 9).alias("tv"))
    top = ranks.top_rows(rows, 5, [F.desc("tv"), F.col("doc_id")], "a", "b")
    return top.select("a", "b", "place", "doc_id", r6("tv").alias("tv"))


@register(
    "simplex_projection",
    f"""WITH {DECISIONS} SELECT doc_id, CAST(provider AS INTEGER) AS provider, round(sum(round(p, 2)), 6) AS rounded_sum, CAST(abs(sum(round(p, 2)) - 1) <= 1e-5 AS BOOLEAN) AS valid FROM decisions GROUP BY ALL""",
)
def simplex_projection(spark, sf_dir):
    """Vectors rounded to two digits: their sums, and whether they still are probability vectors."""
    two = F.transform("p", lambda x: F.round(x, 2))
    return decisions(spark, sf_dir).select("doc_id", "provider", r6(V.total(two)).alias("rounded_sum"), V.is_simplex(two).alias("valid"))


@register(
    "rounded_vectors_projected",
    f"""WITH RECURSIVE {DECISIONS}, b(doc_id, provider, p, i, lo, hi) AS (
        SELECT doc_id, provider, list_transform(p, lambda x: round(x, 2)), 0, CAST(-0.005 AS DOUBLE), CAST(0.005 AS DOUBLE) FROM vectors
        UNION ALL SELECT doc_id, provider, p, i + 1, CASE WHEN sum < 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sum < 1 THEN hi ELSE (lo + hi) / 2 END
        FROM (SELECT *, list_sum(list_transform(p, lambda x: least(greatest(x + (lo + hi) / 2, x - 0.005, 0), x + 0.005, 1))) AS sum FROM b WHERE i < 60)
    ), q AS (SELECT doc_id, provider, list_transform(p, lambda x: least(greatest(x + (lo + hi) / 2, x - 0.005, 0), x + 0.005, 1)) AS q FROM b WHERE i = 60)
    SELECT doc_id, CAST(provider AS INTEGER) AS provider, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[3], 6) AS q2, round(list_sum(q), 6) AS total FROM q""",
)
def rounded_vectors_projected(spark, sf_dir):
    """Rounded vectors moved by one common shift within the rounding box to sum to 1 again."""
    two = F.transform("p", lambda x: F.round(x, 2))
    rows = decisions(spark, sf_dir).select("doc_id", "provider", V.bounded_projection(two, 0.005).alias("q"))
    return rows.select("doc_id", "provider", *[r6(F.col("q")[i]).alias(f"q{i}") for i in range(3)], r6(V.total("q")).alias("total"))


@register(
    "provider_ranks",
    f"""WITH {_TOPS}, m AS (SELECT provider, source, round(avg(top_p), 9) AS mean_top FROM tops JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT CAST(provider AS INTEGER) AS provider, source, round(mean_top, 6) AS mean_top, CAST(rank() OVER (PARTITION BY source ORDER BY mean_top DESC) AS INTEGER) AS min_rank, round(rank() OVER (PARTITION BY source ORDER BY mean_top) + (count(*) OVER (PARTITION BY source, mean_top) - 1) / 2.0, 6) AS average_rank FROM m""",
)
def provider_ranks(spark, sf_dir):
    """Rank of providers within each source by mean top probability."""
    rows = _tops(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("provider", "source").agg(F.round(F.avg("top_p"), 9).alias("mean_top"))
    return rows.select("provider", "source", r6("mean_top").alias("mean_top"), ranks.min_rank_desc("mean_top", "source").alias("min_rank"), r6(ranks.average_rank("mean_top", "source")).alias("average_rank"))


@register(
    "provider_spearman",
    f"""WITH {_TOPS}, w AS (SELECT a.doc_id, a.provider AS a, b.provider AS b, round(a.top_p, 9) AS x, round(b.top_p, 9) AS y FROM tops a JOIN tops b ON a.doc_id = b.doc_id AND a.provider < b.provider),
    r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM w)
    SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY a, b""",
)
def provider_spearman(spark, sf_dir):
    """Spearman correlation of top probabilities for each pair of providers."""
    rows = _pairs(spark, sf_dir).select("a", "b", F.round(F.array_max("p"), 9).alias("x"), F.round(F.array_max("q"), 9).alias("y"))
    return rounded(ranks.spearman(rows, "x", "y", "a", "b"))


@register(
    "prediction_shift",
    f"""WITH {_PAIRS} SELECT 'shift_' || ((tv >= 0.02)::INT + (tv >= 0.1)::INT + (tv >= 0.25)::INT) AS band, count(*) AS n FROM distances WHERE a = 1 AND b = 2 GROUP BY band""",
)
def prediction_shift(spark, sf_dir):
    """Bands of the total variation between two providers."""
    rows = _pairs(spark, sf_dir).where("a = 1 and b = 2").select(V.total_variation("p", "q").alias("tv"))
    return rows.groupBy(V.band("tv", (0.02, 0.1, 0.25), "shift").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "data_map",
    f"""WITH {_TOPS}, e AS (SELECT doc_id, provider, -sum(p * ln(p)) / ln(3) AS h FROM decisions GROUP BY ALL) SELECT least(CAST(floor(round(top_p, 9) / 0.05) AS INTEGER), 19) AS bx, least(CAST(floor(round(h, 9) / 0.05) AS INTEGER), 19) AS b_y, count(*) AS n, round(sum(top_p), 6) AS benefit FROM tops JOIN e USING (doc_id, provider) GROUP BY ALL""",
)
def data_map(spark, sf_dir):
    """A 20 x 20 grid of top probability and entropy: counts and a weighted sum."""
    rows = decisions(spark, sf_dir).select(F.array_max("p").alias("top"), V.entropy("p").alias("h"))
    return rows.groupBy(V.equal_width_bin(F.round("top", 9), 0.0, 1.0, 20).alias("bx"), V.equal_width_bin(F.round("h", 9), 0.0, 1.0, 20).alias("b_y")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("top")).alias("benefit"))


_DIVERSE = DECISIONS + """, held AS (SELECT doc_id, provider, p FROM vectors WHERE NOT (provider = 2 AND doc_id % 19 = 0)), per AS (SELECT doc_id, provider, p, list_max(p) AS top, len(list_filter(p, lambda x: x = list_max(p))) > 1 AS tied, list_position(p, list_max(p)) - 1 AS choice FROM held),
    pairs AS (SELECT a.doc_id, round((abs(a.p[1] - b.p[1]) + abs(a.p[2] - b.p[2]) + abs(a.p[3] - b.p[3])) / 2, 9) AS tv FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.provider < b.provider),
    gaps AS (SELECT doc_id, round(avg(tv), 9) AS mean_pair_tv, max(tv) AS max_pair_tv FROM pairs GROUP BY doc_id), votes AS (SELECT doc_id, o, count(*) FILTER (NOT tied AND choice = o) AS v FROM per, range(0, 3) AS t(o) GROUP BY ALL),
    patterns AS (SELECT doc_id, string_agg(CAST(v AS VARCHAR), ':' ORDER BY v DESC) FILTER (v > 0) AS pattern, max(v) AS largest FROM votes GROUP BY doc_id),
    said AS (SELECT doc_id, count(*) AS models, bool_or(tied) AS ambiguous, round(avg(top), 9) AS confidence FROM per GROUP BY doc_id),
    rowwise AS MATERIALIZED (SELECT doc_id, CASE WHEN ambiguous THEN 'tied top probability' ELSE coalesce(pattern, '') END AS pattern, largest, largest = 4 AND NOT ambiguous AS unanimous, ambiguous, mean_pair_tv, max_pair_tv, confidence, doc_id % 29 = 0 AS odd, source, sha256(text) AS key FROM said JOIN gaps USING (doc_id) JOIN patterns USING (doc_id) JOIN documents USING (doc_id) WHERE models = 4),
    weighted AS MATERIALIZED (SELECT *, 'rows' AS weighting FROM rowwise UNION ALL SELECT *, 'unique_inputs' FROM rowwise QUALIFY doc_id = min(doc_id) OVER (PARTITION BY key))"""


def _diverse(spark, sf_dir):
    """Diagnostics of four providers' vectors by document; the second has none for every nineteenth."""
    rows = diagnostics.row_diagnostics(decisions(spark, sf_dir).withColumn("p", F.when(~((F.col("provider") == 2) & (F.col("doc_id") % 19 == 0)), F.col("p"))), "doc_id", "provider", "p", [1, 2, 3, 4], 3)
    inputs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return rows, written_once(diagnostics.weighted_rows(rows, "doc_id", inputs, "key").join(inputs.select("doc_id", "source"), "doc_id"))


@register(
    "row_diversity",
    f"WITH {_DIVERSE} SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing_text' ELSE 'compared' END AS status, pattern, CAST(largest AS INTEGER) AS largest, unanimous, ambiguous, round(mean_pair_tv, 6) AS mean_pair_tv, round(max_pair_tv, 6) AS max_pair_tv, round(confidence, 6) AS confidence FROM documents d LEFT JOIN rowwise r ON r.doc_id = d.doc_id",
)
def row_diversity(spark, sf_dir):
    """Vote patterns, distances and confidence of each document's four vectors."""
    return rounded(_diverse(spark, sf_dir)[0].drop("votes"))


@register(
    "diversity_summary",
    f"WITH {_DIVERSE} SELECT source, weighting, count(*) AS n, round(avg(CAST(unanimous AS INTEGER)), 6) AS unanimous, round(avg(CAST(ambiguous AS INTEGER)), 6) AS ambiguous, round(avg(mean_pair_tv), 6) AS mean_pair_tv, round(avg(confidence), 6) AS confidence, round(avg(CAST(max_pair_tv <= 1e-12 AS INTEGER)), 6) AS identical FROM weighted GROUP BY ALL",
)
def diversity_summary(spark, sf_dir):
    """Diversity of each source's documents, by rows and by unique texts."""
    return rounded(diagnostics.diversity_summary(_diverse(spark, sf_dir)[1], "source"))


@register("diversity_patterns", f"WITH {_DIVERSE} SELECT weighting, pattern, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY weighting), 6) AS share FROM weighted GROUP BY weighting, pattern")
def diversity_patterns(spark, sf_dir):
    """How often each pattern of votes comes."""
    return rounded(diagnostics.vote_patterns(_diverse(spark, sf_dir)[1]))


@register("diversity_density", f"WITH {_DIVERSE} SELECT weighting, CAST(least(19, floor(confidence * 20)) AS INTEGER) AS confidence_bin, CAST(least(19, floor(mean_pair_tv * 20)) AS INTEGER) AS tv_bin, count(*) AS n FROM weighted GROUP BY ALL")
def diversity_density(spark, sf_dir):
    """Documents by confidence and distance."""
    return diagnostics.confidence_density(_diverse(spark, sf_dir)[1])


@register(
    "diversity_cases",
    f"WITH {_DIVERSE}, u AS (SELECT * FROM weighted WHERE weighting = 'unique_inputs') SELECT source, 'split' AS kind, row_number() OVER (PARTITION BY source ORDER BY mean_pair_tv DESC, doc_id) AS place, doc_id FROM u QUALIFY place <= 3 UNION ALL SELECT source, 'sure', row_number() OVER (PARTITION BY source ORDER BY unanimous DESC, confidence DESC, mean_pair_tv, doc_id) AS place, doc_id FROM u QUALIFY place <= 3",
)
def diversity_cases(spark, sf_dir):
    """The texts of each source that the providers are most split on, and those they are surest of (a top-k report)."""
    return diagnostics.extreme_cases(_diverse(spark, sf_dir)[1], "doc_id", "source", n=3)


_BENEFITS = DECISIONS + """, wide AS (SELECT doc_id, source, max(p) FILTER (provider = 1 AND k = 0) AS a, max(p) FILTER (provider = 2 AND k = 0) AS b, max(p) FILTER (provider = 3 AND k = 0) AS c FROM decisions JOIN documents USING (doc_id) GROUP BY ALL),
    benefit AS (SELECT source, 'b' AS other, doc_id, round(a, 9) AS x, round(b + a / 3, 9) AS y FROM wide UNION ALL SELECT source, 'c', doc_id, round(a, 9), round(c - a / 5, 9) FROM wide),
    ranked AS (SELECT *, rank() OVER (PARTITION BY source, other ORDER BY x) + (count(*) OVER (PARTITION BY source, other, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY source, other ORDER BY y) + (count(*) OVER (PARTITION BY source, other, y) - 1) / 2.0 AS ry,
        row_number() OVER (PARTITION BY source, other ORDER BY x DESC, doc_id) <= ceil(0.1 * count(*) OVER (PARTITION BY source, other)) AS tx, row_number() OVER (PARTITION BY source, other ORDER BY y DESC, doc_id) <= ceil(0.1 * count(*) OVER (PARTITION BY source, other)) AS ty FROM benefit),
    pair AS (SELECT source, other, count(*) AS n, corr(rx, ry) AS rho, count(*) FILTER (tx) AS top_k, count(*) FILTER (tx AND ty) / (2.0 * count(*) FILTER (tx) - count(*) FILTER (tx AND ty)) AS jaccard, (count(*) FILTER (tx) * count(*) FILTER (tx) / count(*)) / (2.0 * count(*) FILTER (tx) - count(*) FILTER (tx) * count(*) FILTER (tx) / count(*)) AS chance FROM ranked GROUP BY ALL)"""


def _complementarity(spark, sf_dir):
    """Correlation and overlap of one provider's benefit with those of two others, by source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = lambda i: F.max(F.when(F.col("provider") == i, F.col("p")[0]))
    wide = decisions(spark, sf_dir).groupBy("doc_id").agg(first(1).alias("a"), first(2).alias("b"), first(3).alias("c")).join(documents, "doc_id")
    arms = F.explode(F.array(F.struct(F.lit("b").alias("other"), (F.col("b") + F.col("a") / 3).alias("y")), F.struct(F.lit("c").alias("other"), (F.col("c") - F.col("a") / 5).alias("y")))).alias("s")
    rows = wide.select("source", "doc_id", F.round("a", 9).alias("x"), arms).select("source", "doc_id", "x", "s.other", F.round("s.y", 9).alias("y"))
    return diagnostics.complementarity(rows, ["source", "other"], "doc_id", "x", "y")


@register("complementarity_pairs", f"WITH {_BENEFITS} SELECT source, other, n, round(rho, 6) + 0.0 AS rho, top_k, round(jaccard, 6) AS jaccard, round(chance, 6) AS chance FROM pair")
def complementarity_pairs(spark, sf_dir):
    """How far the benefits of two arms go together within each source."""
    return rounded(_complementarity(spark, sf_dir))


@register(
    "complementarity_summary",
    f"""WITH {_BENEFITS}, u AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY source) - 1 AS pos, count(*) OVER (PARTITION BY other) AS m FROM pair WHERE rho IS NOT NULL),
    d AS (SELECT other, draw, CAST('0x' || substr(md5('20261120:' || draw || ':' || slot), 1, 8) AS BIGINT) % m AS pos FROM (SELECT DISTINCT other, m FROM u), range(0, 2000) AS t(draw), range(0, 200) AS q(slot) WHERE slot < m),
    b AS (SELECT d.other, draw, avg(rho) AS v FROM d JOIN u ON d.other = u.other AND d.pos = u.pos GROUP BY ALL), e AS (SELECT other, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM b GROUP BY other)
    SELECT other, count(*) AS n, round(avg(rho), 6) + 0.0 AS mean_rho, round(any_value(low), 6) + 0.0 AS low, round(any_value(high), 6) + 0.0 AS high, round(avg(jaccard), 6) AS jaccard, round(avg(chance), 6) AS chance FROM u JOIN e USING (other) GROUP BY other""",
)
def complementarity_summary(spark, sf_dir):
    """Mean correlation over sources of equal weight, with its bootstrap interval."""
    return rounded(diagnostics.complementarity_summary(_complementarity(spark, sf_dir), "source", ["other"]))
