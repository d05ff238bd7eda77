"""Text reuse, dictionary encoding, field profiles and audits over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.functions import text as T
from lexitab.operators import dedup, ranks
from lexitab.plans.fixtures import rounded
from lexitab.plans.registry import register
from lexitab.session import table

_FIELDS = ["text", "lang", "source"]
#: The rule for a missing text in SQL.
_VALUE = "CASE WHEN regexp_replace({c}, '^\\s+|\\s+$', '', 'g') <> '' THEN {c} END"
_SLOTS = (
    "vals AS (SELECT doc_id, " + ", ".join(f"{_VALUE.format(c=c)} AS {c}" for c in _FIELDS) + " FROM documents), parts AS (SELECT doc_id, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN 's{len(c)}:{c};s' || strlen({c}) || ':' || {c} || ';' END AS {c}, length({c}) AS {c}_n" for c in _FIELDS)
    + " FROM vals), slots AS ("
    + " UNION ALL ".join(f"SELECT doc_id AS row_id, '{c}' AS slot, sha256({c}) AS input_key, {c}_n AS chars FROM parts" for c in _FIELDS)
    + " UNION ALL SELECT doc_id, 'joint', CASE WHEN coalesce(text, lang, source) IS NOT NULL THEN sha256(concat_ws('', text, lang, source)) END,"
    + " CASE WHEN coalesce(text, lang, source) IS NOT NULL THEN coalesce(text_n, 0) + coalesce(lang_n, 0) + coalesce(source_n, 0) END FROM parts)"
)


@register(
    "text_reuse_profile",
    f"""WITH {_SLOTS}, by_key AS (SELECT slot, input_key, count(*) AS n FROM slots GROUP BY ALL)
    SELECT slot, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (input_key IS NOT NULL), 0) AS BIGINT) AS nonempty,
        count(input_key) AS unique_inputs, CAST(coalesce(sum(n) FILTER (input_key IS NOT NULL), 0) - count(input_key) AS BIGINT) AS repeated_rows,
        count(*) FILTER (input_key IS NOT NULL AND n > 1) AS groups_over_one, coalesce(max(n) FILTER (input_key IS NOT NULL), 0) AS largest_group,
        round(100.0 * (sum(n) FILTER (input_key IS NOT NULL) - count(input_key)) / sum(n) FILTER (input_key IS NOT NULL), 6) AS saved_pct
    FROM by_key GROUP BY slot""",
)
def text_reuse_profile(spark, sf_dir):
    return dedup.reuse_profile(table(spark, sf_dir, "documents"), "doc_id", _FIELDS)


@register(
    "text_top_frequencies",
    f"""WITH {_SLOTS}, counted AS (SELECT slot, input_key, count(*) AS rows FROM slots WHERE input_key IS NOT NULL GROUP BY ALL)
    SELECT slot, input_key, rows, CAST(row_number() OVER (PARTITION BY slot ORDER BY rows DESC, input_key) AS INTEGER) AS place
    FROM counted QUALIFY place <= 5""",
)
def text_top_frequencies(spark, sf_dir):
    return dedup.top_frequencies(table(spark, sf_dir, "documents"), "doc_id", _FIELDS, 5)


@register(
    "dictionary_inputs",
    f"""WITH {_SLOTS}, firsts AS (
        SELECT input_key, min((row_id, CASE slot WHEN 'text' THEN 0 WHEN 'lang' THEN 1 WHEN 'source' THEN 2 ELSE 3 END)) AS first, max(chars) AS chars, count(*) AS links
        FROM slots WHERE input_key IS NOT NULL GROUP BY input_key)
    SELECT row_number() OVER (ORDER BY first) - 1 AS input_no, input_key, CAST(chars AS INTEGER) AS chars, links FROM firsts""",
)
def dictionary_inputs(spark, sf_dir):
    return dedup.dictionary(table(spark, sf_dir, "documents"), "doc_id", _FIELDS)[0]


@register(
    "dictionary_links",
    f"""WITH {_SLOTS}, firsts AS (
        SELECT input_key, min((row_id, CASE slot WHEN 'text' THEN 0 WHEN 'lang' THEN 1 WHEN 'source' THEN 2 ELSE 3 END)) AS first
        FROM slots WHERE input_key IS NOT NULL GROUP BY input_key), numbered AS (SELECT row_number() OVER (ORDER BY first) - 1 AS input_no, input_key FROM firsts)
    SELECT row_id, slot, input_no FROM slots LEFT JOIN numbered USING (input_key)""",
)
def dictionary_links(spark, sf_dir):
    return dedup.dictionary(table(spark, sf_dir, "documents"), "doc_id", _FIELDS)[1]


@register("input_audit", "SELECT CAST(NULL AS BIGINT) AS row_id, '' AS slot, '' AS input_key, CAST(NULL AS INTEGER) AS chars, '' AS side WHERE false")
def input_audit(spark, sf_dir):
    """Links and inputs joined back against the slots recomputed from the rows: no row differs."""
    documents = table(spark, sf_dir, "documents")
    unique, links = dedup.dictionary(documents, "doc_id", _FIELDS)
    back = links.join(unique.select("input_no", "input_key", "chars"), "input_no", "left").select("row_id", "slot", "input_key", "chars")
    return dedup.differences(dedup.slots(documents, "doc_id", _FIELDS), back)


@register(
    "input_origins",
    f"""WITH {_SLOTS} SELECT input_key, count(DISTINCT row_id) AS origins, min(row_id) AS first_row, string_agg(DISTINCT slot, ',' ORDER BY slot) AS slots
    FROM slots WHERE input_key IS NOT NULL GROUP BY input_key HAVING count(*) > 1""",
)
def input_origins(spark, sf_dir):
    """Reverse lookup: where each repeated input comes from."""
    links = dedup.slots(table(spark, sf_dir, "documents"), "doc_id", _FIELDS).where("input_key is not null")
    found = links.groupBy("input_key").agg(F.countDistinct("row_id").alias("origins"), F.min("row_id").alias("first_row"), F.array_join(F.array_sort(F.collect_set("slot")), ",").alias("slots"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 1").drop("n")


_STATS = "count(*) AS rows, count(v) AS nonempty, count(DISTINCT v) AS distinct_values, count(*) FILTER (try_cast(regexp_replace(v, '[,$%\\s]', '', 'g') AS DOUBLE) IS NOT NULL) AS numeric_values, count(*) FILTER (v IS NOT NULL AND NOT regexp_matches(v, '\\s')) AS no_space, quantile_cont(length(v), 0.5) AS median_length"


@register(
    "field_types",
    "WITH vals AS (" + " UNION ALL ".join(f"SELECT '{t}.{c}' AS field, {_VALUE.format(c=c)} AS v FROM {t}" for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("conversations", "role"), ("conversations", "text"), ("pages", "url"), ("customer", "c_name"), ("events", "props")))
    + f"""), stats AS (SELECT field, {_STATS} FROM vals GROUP BY field)
    SELECT field, rows, nonempty, distinct_values, round(median_length, 6) AS median_length, CASE WHEN nonempty = 0 THEN 'empty' WHEN 1.0 * numeric_values / nonempty >= 0.9 THEN 'numeric_text'
        WHEN distinct_values <= 50 AND 1.0 * distinct_values / nonempty <= 0.05 THEN 'categorical' WHEN 1.0 * no_space / nonempty >= 0.9 AND median_length <= 16 THEN 'identifier_or_code'
        WHEN median_length <= 60 THEN 'short_text' ELSE 'long_text' END AS field_type FROM stats""",
)
def field_types(spark, sf_dir):
    """The kind of each text field of the supplied tables."""
    fields = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"], "pages": ["url"], "customer": ["c_name"], "events": ["props"]}
    out = None
    for name, columns in fields.items():
        rows = table(spark, sf_dir, name).select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("field"), T.text_value(c).alias("v")) for c in columns])).alias("s")).select("s.*")
        v = F.col("v")
        stats = rows.groupBy("field").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("nonempty"),
            F.countDistinct(v).alias("distinct_values"),
            F.count_if(T.lenient_number(v).isNotNull()).alias("numeric"),
            F.count_if(v.isNotNull() & ~v.rlike(r"\s")).alias("no_space"),
            F.percentile(F.char_length(v), 0.5).alias("median_length"),
        )
        kind = T.field_type(F.col("distinct_values"), F.col("nonempty"), F.col("numeric"), F.col("no_space"), F.col("median_length"))
        part = stats.select("field", "rows", "nonempty", "distinct_values", "median_length", kind.alias("field_type"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@register(
    "text_features_detected",
    """WITH stats AS (SELECT 'text' AS field, count(text) AS n, count(DISTINCT text) AS d, count(*) FILTER (try_cast(text AS DOUBLE) IS NOT NULL) AS num FROM documents
        UNION ALL SELECT 'lang', count(lang), count(DISTINCT lang), count(*) FILTER (try_cast(lang AS DOUBLE) IS NOT NULL) FROM documents
        UNION ALL SELECT 'source', count(source), count(DISTINCT source), count(*) FILTER (try_cast(source AS DOUBLE) IS NOT NULL) FROM documents)
    SELECT field, n, d, num = 0 AND (d >= 100 OR 1.0 * d / n >= 0.8) AS is_text FROM stats""",
)
def text_features_detected(spark, sf_dir):
    """Text features: not numeric, and many or mostly distinct values."""
    rows = table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in _FIELDS])).alias("s")).select("s.*")
    stats = rows.groupBy("field").agg(F.count("v").alias("n"), F.countDistinct("v").alias("d"), F.count_if(F.col("v").try_cast("double").isNotNull()).alias("num"))
    return stats.select("field", "n", "d", ((F.col("num") == 0) & ((F.col("d") >= 100) | (F.col("d") / F.col("n") >= 0.8))).alias("is_text"))


@register(
    "length_quantiles",
    """SELECT lang, count(*) AS n, CAST(min(length(text)) AS BIGINT) AS least, round(quantile_cont(length(text), 0.01), 6) AS p01, round(quantile_cont(length(text), 0.25), 6) AS q1, round(quantile_cont(length(text), 0.5), 6) AS median,
        round(quantile_cont(length(text), 0.75), 6) AS q3, round(quantile_cont(length(text), 0.99), 6) AS p99, CAST(max(length(text)) AS BIGINT) AS most FROM documents GROUP BY lang""",
)
def length_quantiles(spark, sf_dir):
    """Quantiles of text lengths by language."""
    n = F.char_length("text")
    q = F.percentile(n, F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99))))
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(n).cast("long").alias("least"), q.alias("q"), F.max(n).cast("long").alias("most"))
    return rounded(rows.select("lang", "n", "least", *[F.col("q")[i].alias(c) for i, c in enumerate(("p01", "q1", "median", "q3", "p99"))], "most"))


@register(
    "long_texts",
    """WITH t AS (SELECT doc_id, source, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN length(text) END AS chars FROM documents)
    SELECT source, count(chars) AS nonempty, CAST(max(chars) AS BIGINT) AS longest, arg_max(doc_id, (chars, -doc_id)) AS longest_doc, count(*) FILTER (chars > 2000) AS over_2000, count(*) FILTER (chars > 8000) AS over_8000,
        CAST(sum(ceil(chars / 4.0)) AS BIGINT) AS approx_tokens FROM t GROUP BY source""",
)
def long_texts(spark, sf_dir):
    """Long-text audit by source: counts over limits, the longest document (the first of ties), token estimate."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.text_value("text").alias("text"))
    n = F.char_length("text")
    return rows.groupBy("source").agg(F.count("text").alias("nonempty"), F.max(n).cast("long").alias("longest"), F.max_by("doc_id", F.when(n.isNotNull(), F.struct(n, -F.col("doc_id")))).alias("longest_doc"), F.count_if(n > 2000).alias("over_2000"), F.count_if(n > 8000).alias("over_8000"), F.sum(T.approx_tokens("text")).cast("long").alias("approx_tokens"))


@register(
    "word_counts",
    """SELECT role, count(*) AS turns, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, CAST(max(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS most FROM conversations GROUP BY role""",
)
def word_counts(spark, sf_dir):
    """Words of conversation turns by role."""
    words = T.word_count("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(words).cast("long").alias("words"), F.max(words).cast("long").alias("most"))


@register(
    "text_previews",
    """SELECT page_id, CASE WHEN length(html) <= 180 THEN html ELSE left(html, 60) || ' ... ' || substring(html, CAST(floor((length(html) - 60) / 2) AS BIGINT) + 1, 60) || ' ... ' || right(html, 60) END AS preview FROM pages""",
)
def text_previews(spark, sf_dir):
    """Head, middle and tail of each page."""
    return table(spark, sf_dir, "pages").select("page_id", T.preview("html", 60).alias("preview"))


@register(
    "length_order_examples",
    """WITH r AS (SELECT doc_id, lang, length(text) AS chars, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, CAST(i * 10 AS INTEGER) AS percent, doc_id, CAST(chars AS INTEGER) AS chars FROM r, (SELECT unnest(range(1, 10)) AS i) WHERE place = CAST(floor(n * i / 10.0) AS BIGINT) + 1""",
)
def length_order_examples(spark, sf_dir):
    """One document at each tenth of the order by length, within a language.

    Ranks come from counts of equal lengths, so no task holds a language's rows: only the rows of the lengths wanted are numbered.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.char_length("text").alias("chars"))
    sizes = rows.groupBy("lang", "chars").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.withColumn("upto", F.sum("c").over(W.partitionBy("lang").orderBy("chars"))).withColumn("n", F.sum("c").over(W.partitionBy("lang")))
    wanted = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("at", F.floor(F.col("n") * F.col("i") / 10.0) + 1)
    wanted = wanted.where((F.col("at") <= F.col("upto")) & (F.col("at") > F.col("upto") - F.col("c"))).select("lang", "chars", (F.col("i") * 10).alias("percent"), (F.col("at") - F.col("upto") + F.col("c")).alias("place"))
    numbered = rows.join(wanted.select("lang", "chars").distinct(), ["lang", "chars"], "left_semi").withColumn("place", F.row_number().over(W.partitionBy("lang", "chars").orderBy("doc_id")))
    return numbered.join(wanted, ["lang", "chars", "place"]).select("lang", F.col("percent").cast("int").alias("percent"), "doc_id", "chars")


@register(
    "dataset_covariates",
    """WITH cells AS (SELECT source, doc_id, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN text END AS v FROM documents), m AS (SELECT source, v, count(*) OVER (PARTITION BY source, v) AS k FROM cells)
    SELECT source, count(*) AS rows, round(1.0 * count(*) FILTER (v IS NULL) / count(*), 6) AS missing_share, round(1.0 * count(*) FILTER (v IS NOT NULL AND k > 1) / count(v), 6) AS repeated_share, round(quantile_cont(length(v), 0.5), 6) AS median_chars FROM m GROUP BY source""",
)
def dataset_covariates(spark, sf_dir):
    """Label-free properties of each source: missing and repeated shares, median length."""
    counted = table(spark, sf_dir, "documents").select("source", T.text_value("text").alias("v")).groupBy("source", "v").agg(F.count(F.lit(1)).alias("k"))
    total, known = F.sum("k"), F.sum(F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0))
    lengths = F.percentile(F.char_length("v"), F.lit(0.5), F.col("k"))
    return rounded(counted.groupBy("source").agg(total.alias("rows"), (F.sum(F.when(F.col("v").isNull(), F.col("k")).otherwise(0)) / total).alias("missing_share"), (F.sum(F.when(F.col("v").isNotNull() & (F.col("k") > 1), F.col("k")).otherwise(0)) / known).alias("repeated_share"), lengths.alias("median_chars")))


@register(
    "hash_probe_sample",
    "SELECT doc_id, source FROM documents ORDER BY sha256('[42,' || doc_id || ']'), doc_id LIMIT 50",
)
def hash_probe_sample(spark, sf_dir):
    """A reproducible sample of 50 documents by hash order."""
    return ranks.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50, 42)


@register(
    "cost_estimate",
    """WITH t AS (SELECT source, ceil(length(text) / r) AS tokens, r FROM documents, (SELECT unnest(CAST([3.0, 4.0, 5.0] AS DOUBLE[])) AS r))
    SELECT source, r AS chars_per_token, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(max(tokens) AS BIGINT) AS peak, count(*) FILTER (tokens > 1024) AS over_limit, round(sum(tokens) * 0.042 / 1000000, 9) AS usd FROM t GROUP BY ALL""",
)
def cost_estimate(spark, sf_dir):
    """Token and cost estimate by source for several ratios of characters to tokens."""
    rows = table(spark, sf_dir, "documents").select("source", F.char_length("text").alias("n")).withColumn("chars_per_token", F.explode(F.array(*map(F.lit, (3.0, 4.0, 5.0)))))
    tokens = F.ceil(F.col("n") / F.col("chars_per_token"))
    return rows.groupBy("source", "chars_per_token").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("peak"), F.count_if(tokens > 1024).alias("over_limit"), F.round(F.sum(tokens) * 0.042 / 1000000, 9).alias("usd"))


@register(
    "train_test_overlap",
    """WITH k AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS fold, lang, sha256('s' || strlen(text) || ':' || text || ';') AS key FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
    folds AS (SELECT unnest(range(0, 5)) AS test_fold), seen AS (SELECT f.test_fold, k.doc_id, k.lang, EXISTS (SELECT 1 FROM k t WHERE t.key = k.key AND t.fold <> f.test_fold) AS seen FROM folds f JOIN k ON k.fold = f.test_fold)
    SELECT CAST(test_fold AS INTEGER) AS test_fold, lang, count(*) AS rows, count(*) FILTER (seen) AS seen_rows FROM seen GROUP BY ALL""",
)
def train_test_overlap(spark, sf_dir):
    """Test texts of each fold that occur among its training texts: by the set of folds that a text has, in one pass."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("test_fold"), "lang", T.digest(T.text_value("text")).alias("key"), T.text_value("text").isNotNull().alias("there")).where("there")
    folds = keyed.groupBy("key").agg(F.count_distinct("test_fold").alias("folds"))
    return keyed.join(folds, "key").groupBy("test_fold", "lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("folds") > 1).alias("seen_rows"))


@register(
    "field_novelty",
    """WITH base AS (SELECT doc_id, doc_id % 5 = 0 AS test, lang, source, text FROM documents), u AS (SELECT 'lang' AS field, test, lang AS v FROM base UNION ALL SELECT 'source', test, source FROM base UNION ALL SELECT 'text', test, text FROM base)
    SELECT field, count(*) AS test_rows, count(*) FILTER (v NOT IN (SELECT v FROM u t WHERE NOT t.test AND t.field = u.field AND v IS NOT NULL)) AS unseen FROM u WHERE test AND v IS NOT NULL GROUP BY field""",
)
def field_novelty(spark, sf_dir):
    """Values of test rows that no training row has, by field."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5 == 0).alias("test"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in _FIELDS])).alias("s")).select("test", "s.*").where("v is not null")
    by_value = rows.groupBy("field", "v").agg(F.count_if("test").alias("n"), F.count_if(~F.col("test")).alias("train"))
    return by_value.groupBy("field").agg(F.sum("n").alias("test_rows"), F.sum(F.when(F.col("train") == 0, F.col("n")).otherwise(0)).alias("unseen"))


@register(
    "text_availability",
    """SELECT source, count(*) AS rows, CAST(sum(CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 1 ELSE 0 END) AS BIGINT) AS text_missing, CAST(sum(CASE WHEN lang IS NULL OR lang = '' THEN 1 ELSE 0 END) AS BIGINT) AS lang_missing FROM documents GROUP BY source""",
)
def text_availability(spark, sf_dir):
    """Missing flags of text fields, summed by source."""
    flag = lambda c: F.sum(T.text_value(c).isNull().cast("int"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"), flag("text").alias("text_missing"), flag("lang").alias("lang_missing"))


@register(
    "canonical_rows",
    """SELECT c_custkey, sha256('{"acctbal":"' || CAST(CAST(c_acctbal * 100 AS BIGINT) AS VARCHAR) || '","name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS identity FROM customer""",
)
def canonical_rows(spark, sf_dir):
    """Content identity of customers: SHA-256 of JSON with sorted keys."""
    fields = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("acctbal"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(T.canonical_map_json(fields), 256).alias("identity"))
