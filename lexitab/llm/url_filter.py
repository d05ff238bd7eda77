"""URL filtering by host-suffix and path-prefix expressions, in DataFrame functions only.

Every URL is expanded into the expressions (host suffix + path prefix) that the rules' shapes allow. They are joined
with the rules on a short hash prefix, the full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of the digest that the join is on.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table: rule (host + path), digest, short, verdict, host_size, size."""
    schema = T.StructType().add("verdict", "string").add("host", "string").add("path", "string")
    rows = spark.createDataFrame(rules, schema)
    expression = F.concat("host", F.lit("\n"), "path")
    digest = F.sha2(expression, 256)
    return rows.select(F.concat("host", "path").alias("rule"), digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"), "verdict", F.length("host").alias("host_size"), F.length(F.concat("host", "path")).alias("size"))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """A row for each input row: id, host, path, rule (null where none fits), verdict.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's. The longest
    host + path wins, then the longer host, then `block`. Null URLs and URLs without :// have empty host and path and get
    the default, as do all URLs without a fitting rule. Repeated rows stay; other columns are ignored; an empty table or rule
    list is fine. Only distinct (host, path start) pairs are expanded, so a host with a third of all rows costs a few keys,
    and the join back to the rows is one that AQE can split.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("page_id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted({len(path) for _, _, path in rules})
    depth = max(host.count(".") + 1 for _, host, _ in rules)
    rows = rows.withColumn("start", F.substring("path", 1, lengths[-1]))
    keys = rows.select("host", "start").distinct()
    # The last 1 to depth labels of the host, and the path's prefixes of the lengths that rules have.
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, depth + 1)]))
    prefixes = F.filter(F.array_distinct(F.array(*[F.substring("start", 1, n) for n in lengths])), lambda p: F.array_contains(F.array(*map(F.lit, lengths)), F.length(p)))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit("\n"), p), 256))))
    expanded = keys.select("host", "start", F.explode(expressions).alias("own")).withColumn("short", F.substring("own", 1, SHORT))
    found = expanded.join(rule_table(spark, rules), "short").where("own = digest")
    order = F.struct("size", "host_size", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = found.groupBy("host", "start").agg(F.max(order).alias("best"))
    return rows.join(best, ["host", "start"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
