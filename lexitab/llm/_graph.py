"""Connected components by rounds of hooking, pointer jumping and contraction; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import cut, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; the component is its smallest node.

    Null ends and loops are ignored, repeated edges count once. In each round every node hooks to its smallest
    smaller neighbour, the hooks are followed to their ends (in a logarithmic number of joins), and the edges are
    contracted to those ends, so at least one end of each edge goes away. Each round is checkpointed.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    pairs = cut(pairs.distinct())
    labels = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("component", F.col("node")))
    while not pairs.isEmpty():
        hooks = last = cut(pairs.groupBy("a").agg(F.min("b").alias("to")))
        while True:
            ends = hooks.select(F.col("a").alias("to"), F.col("to").alias("end"))
            jumped = cut(hooks.join(ends, "to", "left").select("a", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")))
            release(last)
            hooks, last = jumped.select("a", "to"), jumped
            if jumped.where("moved").isEmpty():
                break
        named, contracted = labels, pairs
        labels = cut(labels.join(hooks.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        upper = hooks.select("a", F.col("to").alias("upper"))
        lower = hooks.select(F.col("a").alias("b"), F.col("to").alias("lower"))
        ends = pairs.join(upper, "a", "left").join(lower, "b", "left").select(F.coalesce("upper", "a").alias("x"), F.coalesce("lower", "b").alias("y"))
        pairs = cut(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        release(named, contracted, last)
    release(pairs)
    return labels


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of n rows in each row's component, by the links (a, b)."""
    roots = np.arange(n)
    while True:
        low = np.minimum(roots[a], roots[b])
        new = roots.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == roots).all():
            return roots
        roots = new
