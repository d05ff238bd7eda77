"""Tables of several providers over the same rows: alignment, agreement of inputs, merged grids, token audits, encoded texts."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitab.functions.text import digest, text_value
from lexitab.operators.dedup import assert_unique
from lexitab.operators.ordered import hash_bucket, numbered


def aligned(left: DataFrame, right: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """left beside right's columns (old name: new name) by key, whatever the order of rows; an error unless both have the same keys once."""
    assert_unique(left, [key])
    other = assert_unique(right, [key]).select(F.col(key).alias("__key"), *[F.col(old).alias(new) for old, new in columns.items()])
    both = left.join(other, left[key] == other["__key"], "full")
    if not both.where(F.col(key).isNull() | F.col("__key").isNull()).isEmpty():
        raise ValueError(f"the tables differ in their values of {key}")
    return both.drop("__key")


def unequal_inputs(df: DataFrame, row: str, provider: str, payload: Column) -> DataFrame:
    """row, providers, inputs of the rows that providers were asked about with unlike payloads."""
    return df.groupBy(row).agg(F.countDistinct(provider).alias("providers"), F.countDistinct(F.sha2(payload, 256)).alias("inputs")).where("inputs > 1")


def merged_grids(grids: DataFrame, cell: list[str], sums: list[str]) -> DataFrame:
    """One grid from several: sums by cell."""
    return grids.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in sums])


def sample_each(df: DataFrame, keys: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, those of the smallest SHA-256 of seed and key; the same rows for any partitioning."""
    token = F.sha2(F.concat(F.lit(f"[{seed},"), F.col(key).cast("string"), F.lit("]")), 256)
    placed = numbered(df.withColumn("__token", token), keys, hash_bucket("__token"), [F.col("__token"), F.col(key)], "__place")
    return placed.where(F.col("__place") <= n).drop("__token", "__place")


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A column function from a Python counter of one text's tokens, called batch by batch; null for null."""
    return lambda c: F.arrow_udf(lambda texts: pa.array([None if t is None else count(t) for t in texts.to_pylist()], pa.int64()), "long")(c)


def rank_counter(path: str, pattern: str) -> Callable[[Column], Column]:
    """A token counter by a file of byte-pair ranks (a base64 token and its rank on each line) and the pattern that cuts texts; special tokens' strings are plain text."""

    def run(texts: pa.Array) -> pa.Array:
        encode = _encoding(path, pattern).encode_ordinary
        return pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return lambda c: F.arrow_udf(run, "long")(c)


@cache
def _encoding(path: str, pattern: str):
    """A worker's encoding."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_audit(df: DataFrame, text: str, groups: list[str], counter: Callable[[Column], Column], limits: list[int], quantiles: list[float]) -> DataFrame:
    """groups, texts, distinct_texts, tokens, longest, q<percent>, over_<limit>: each distinct text is counted once."""
    rows = df.select(*groups, text_value(text).alias("__text")).where("__text is not null")
    by_text = rows.groupBy(*groups, "__text").agg(F.count(F.lit(1)).alias("__n"))
    distinct = by_text.select("__text").distinct()
    counted = by_text.join(distinct.withColumn("__tokens", counter(F.col("__text"))).select(digest("__text").alias("__key"), "__tokens"), digest("__text") == F.col("__key"))
    tokens, n = F.col("__tokens"), F.col("__n")
    # A histogram of lengths is what quantiles need: as many rows as there are lengths.
    lengths = counted.groupBy(*groups, "__tokens").agg(F.sum(n).alias("__n"), F.count(F.lit(1)).alias("__texts"))
    return lengths.groupBy(*groups).agg(
        F.sum(n).alias("texts"),
        F.sum("__texts").alias("distinct_texts"),
        F.sum(tokens * n).alias("tokens"),
        F.max(tokens).alias("longest"),
        *[F.percentile(tokens, q, n).alias(f"q{int(round(100 * q))}") for q in quantiles],
        *[F.sum(F.when(tokens > limit, n).otherwise(0)).alias(f"over_{limit}") for limit in limits],
    )


def encoded_texts(texts: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, vector): what an encoder gives for each text, a batch at a time; vectors are scaled to length 1, and zero stays zero."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            vectors = encoder(batch.column("text").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(vectors, pa.list_(pa.float64()))], ["key", "vector"])

    found = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector"))
    return found.select(F.col("key").alias(key), unit.alias("vector"))
