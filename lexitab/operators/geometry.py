"""Distances between vectors of a stated query set and all vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def query_distances(queries: DataFrame, rows: DataFrame, id_column: str, vector: str, *keys: str) -> DataFrame:
    """(keys, query, other, distance) of each query vector and each other row under equal keys.

    The query set is a stated small one; the join is on the keys, of which there must be one.
    """
    if not keys:
        raise ValueError("distances are taken under equal keys")
    left = queries.select(*keys, F.col(id_column).alias("query"), F.col(vector).alias("q"))
    right = rows.select(*keys, F.col(id_column).alias("other"), F.col(vector).alias("v"))
    return left.join(right, list(keys)).where("query <> other").select(*keys, "query", "other", cosine_distance(F.col("q"), F.col("v")).alias("distance"))
