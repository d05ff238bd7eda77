"""Vectors of texts longer than an encoder takes: pieces by token budget, each encoded, and their token-weighted mean of unit length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitab.functions.text import text_value


def words(text: Column) -> Column:
    """Tokens between single spaces, as they come."""
    return F.split(text, " ")


def pieces(df: DataFrame, key: str, text: str, *, budget: int, overlap: int = 0, tokens: Callable[[Column], Column] = words, glue: str = " ") -> DataFrame:
    """(key, piece, n_tokens, text): each text's tokens in runs of budget tokens, each run beginning overlap tokens before the last one's end.

    Without an overlap every token is in one piece. Texts that are missing give no row; the rows of a text need no shuffle.
    """
    if not 0 <= overlap < budget:
        raise ValueError("the overlap is below the budget")
    rows = df.select(key, text_value(text).alias("__text")).where("__text is not null").select(key, tokens(F.col("__text")).alias("__tokens"))
    step = budget - overlap
    # A last run that would lie in the one before it isn't begun.
    last = F.greatest(F.lit(0), F.ceil((F.size("__tokens") - budget) / step)).cast("int")
    # Cut before they are dealt into rows, or each of a text's rows would hold all of its tokens.
    part = lambda i: F.slice("__tokens", i * step + 1, budget)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("piece"), F.least(F.size("__tokens") - i * step, F.lit(budget)).alias("n_tokens"), F.array_join(part(i), glue).alias("text")))
    return rows.select(key, F.inline(cut))


def weighted_sums(df: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, weight, n, sums): the weights, the number and the weighted element-wise sums of each key's vectors.

    Each batch adds up its own keys first, so what is shuffled is a row for each key and batch, and what meets in a group are those few.
    """
    kind = df.schema[key].dataType.simpleString()

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").dictionary_encode()
            at = np.array(keys.indices)
            v = np.array(batch.column("vector").flatten(), float).reshape(batch.num_rows, -1)
            w = np.array(batch.column("weight"), float)
            sums, weights = np.zeros((len(keys.dictionary), v.shape[1])), np.zeros(len(keys.dictionary))
            np.add.at(sums, at, v * w[:, None])
            np.add.at(weights, at, w)
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(weights), pa.array(np.bincount(at, minlength=len(weights)), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], ["key", "weight", "n", "sums"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(weight).cast("double").alias("weight"))
    parts = rows.mapInArrow(add, f"key {kind}, weight double, n long, sums array<double>")
    total = F.aggregate(F.slice("l", 2, F.size("l")), F.col("l")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    grouped = parts.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.collect_list("sums").alias("l"))
    return grouped.select(F.col("key").alias(key), "weight", "n", total.alias("sums"))


def embedded(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], *, budget: int, overlap: int = 0, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """(key, pieces, tokens, vector, norm): the token-weighted mean of a text's pieces, scaled to length 1.

    encode gives a row for each of a batch of pieces. norm is the mean's length before scaling; where it is 0 or not finite the
    vector is null. Keys must be unique; texts that are missing give no row.
    """
    cut = pieces(df, key, text, budget=budget, overlap=overlap, tokens=tokens)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(np.asarray(encode(texts.to_pylist()), float)), pa.list_(pa.float64()))

    coded = cut.select(key, "n_tokens", F.arrow_udf(run, "array<double>")("text").alias("vector"))
    sums = weighted_sums(coded, key, "vector", "n_tokens")
    mean = F.transform("sums", lambda x: x / F.col("weight"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    rows = sums.select(key, F.col("n").alias("pieces"), F.col("weight").cast("long").alias("tokens"), mean.alias("mean")).withColumn("norm", length)
    unit = F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.transform("mean", lambda x: x / F.col("norm")))
    return rows.select(key, "pieces", "tokens", unit.alias("vector"), "norm")
