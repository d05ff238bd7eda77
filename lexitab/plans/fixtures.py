"""Tables that the queries derive from the supplied ones by integer arithmetic, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitab.session import table

PROVIDERS = 4
LEVELS = 3


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """All double columns by r6."""
    return df.select(*[r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, provider 1..4, p: three probabilities from the id."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    rows = documents.withColumn("provider", F.explode(F.sequence(F.lit(1), F.lit(PROVIDERS))))
    x = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: (F.col("doc_id") * (F.col("provider") * 7 + k * 3) + F.col("provider") * 13 + k * 5) % 97 + 1)
    rows = rows.withColumn("x", x)
    return rows.select("doc_id", "provider", F.transform("x", lambda v: v / F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b)).alias("p"))


#: decisions in long form: doc_id, provider, k, p.
DECISIONS = """raw AS (
    SELECT doc_id, provider, k, (doc_id * (provider * 7 + k * 3) + provider * 13 + k * 5) % 97 + 1 AS x
    FROM documents, (SELECT unnest(range(1, 5)) AS provider), (SELECT unnest(range(0, 3)) AS k)
), decisions AS (
    SELECT doc_id, provider, k, CAST(x AS DOUBLE) / sum(x) OVER (PARTITION BY doc_id, provider) AS p FROM raw
), vectors AS (
    SELECT doc_id, provider, list(p ORDER BY k) AS p FROM decisions GROUP BY doc_id, provider
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y (quality), toxic, score: a probability from the id and the label, grp: two groups."""
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    score = ((F.col("doc_id") * 37 + 11) % 800 + F.col("quality") * 200) / 1000.0
    return rows.select("doc_id", F.col("quality").alias("y"), "toxic", score.cast("double").alias("score"), (F.col("doc_id") % 2).cast("int").alias("grp"))


SCORES = """scores AS (
    SELECT doc_id, quality AS y, toxic, CAST((doc_id * 37 + 11) % 800 + quality * 200 AS DOUBLE) / 1000.0 AS score, CAST(doc_id % 2 AS INTEGER) AS grp
    FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y in 0..2, p: labelled documents with the vector of the first provider."""
    y = F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).cast("int")
    labelled = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", y.alias("y"))
    return decisions(spark, sf_dir).where("provider = 1").join(labelled, "doc_id").select("doc_id", "y", "p")


CLASSES = DECISIONS + """, classes AS (
    SELECT v.doc_id, CAST(CASE WHEN toxic = 1 THEN 2 ELSE quality END AS INTEGER) AS y, v.p
    FROM vectors v JOIN labels l ON v.doc_id = l.doc_id AND v.provider = 1 WHERE quality IS NOT NULL AND toxic IS NOT NULL
)"""


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, model, arm, fold, value: mean discounts by segment, priority, return flag and order number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model"), F.col("l_returnflag").alias("arm"), (F.col("o_orderkey") % 5).cast("int").alias("fold")]
    return rows.groupBy(*keys).agg(F.round(F.avg("l_discount"), 9).alias("value"))


FOLD_METRICS = """fm AS (
    SELECT c_mktsegment AS dataset, o_orderpriority AS model, l_returnflag AS arm, CAST(o_orderkey % 5 AS INTEGER) AS fold, round(avg(l_discount), 9) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), paired AS (
    SELECT a.dataset, a.model, a.fold, a.arm, a.value, b.value AS base, a.value - b.value AS difference
    FROM fm a JOIN fm b USING (dataset, model, fold) WHERE a.arm <> 'N' AND b.arm = 'N'
), gains AS (
    SELECT dataset, model, arm, avg(value) - avg(base) AS raw_gain, (avg(value) - avg(base)) / greatest(1 - avg(base), 0.001) AS gain,
        var_samp(difference) AS variance, CAST(count(difference) AS BIGINT) AS folds
    FROM paired GROUP BY ALL
)"""
