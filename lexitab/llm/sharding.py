"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

A record goes to the shard with the highest score. A shard's score is -weight / ln(u), where u in (0, 1) comes from the
MD5 of key and shard, so adding a shard moves into it just the records whose score there beats all others, and no
record moves between old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.llm._support import cut_columnar

#: Distinct rows that are numbered in one go, about, and copies of a row that are written out in one go.
ROWS_A_BUCKET = 4_000


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the MD5 of key and shard."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: highest -weight / ln(u), the lower shard on a tie. Shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be nonnegative, one of them positive")
    options = [F.struct((-F.lit(float(w)) / F.log(unit(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*options) if len(options) > 1 else options[0]
    return (-best["shard"]).cast("int")


def record_key(id_column: Column) -> Column:
    """The stable key of a record: its id as text; null ids share one key."""
    return F.coalesce(id_column.cast("string"), F.lit("null"))


def shard_records(
    df: DataFrame,
    *,
    weights: list[float],
    grown: list[float] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row for each input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the weights alone decide, so equal ids always meet. size is the text's UTF-8 bytes plus 8 (null:
    8); text_crc32 is null for a null text; grown_shard is the shard under the weights `grown` (null without them). Slots count
    from 0 without a gap in each shard, in the order of the MD5 of id, checksum and size, then of these three (nulls first),
    whatever the partitions of df; rows equal in all three take neighbouring slots. Null ids form one key. Other columns are
    ignored; an empty table gives an empty one.
    Slots need no task per shard: a shard is cut by the MD5's first digits into buckets, and each bucket starts at the sum of
    the counts before it. Equal rows are counted before they are numbered, so a row that repeats is one row until the end.
    """
    key = record_key(F.col("doc_id"))
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size")
    shards = rendezvous(key, weights).alias("shard"), (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard")
    rows = rows.select("doc_id", size, F.crc32("text").alias("text_crc32"), *shards)
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    rows = cut_columnar(rows.withColumn("order", F.md5(F.concat_ws(":", key, "text_crc32", "size"))))
    total, digits = rows.count(), 1
    while 16**digits * len(weights) * ROWS_A_BUCKET < total:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("order", 1, digits))
    sized = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sized.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket").orderBy("order", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    placed = placed.withColumn("first", F.col("start") + F.col("ahead")).drop("start", "ahead", "order", "bucket")
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"]
    few = placed.where(F.col("n") <= ROWS_A_BUCKET).withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    many = placed.where(F.col("n") > ROWS_A_BUCKET).withColumn("last", F.col("first") + F.col("n") - 1)
    # A row with many copies is dealt out again, a stretch of slots at a time.
    many = many.withColumn("low", F.explode(F.sequence("first", "last", F.lit(ROWS_A_BUCKET).cast("long")))).repartition("doc_id", "low")
    many = many.withColumn("slot", F.explode(F.sequence("low", F.least(F.col("last"), F.col("low") + ROWS_A_BUCKET - 1))))
    return few.select(*columns).union(many.select(*columns))
