"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one kept per group.

Two unit vectors with cosine >= t are at most e = sqrt(2 - 2t) apart. If their nearest centroids differ, the plane halfway
between those centroids lies between them, so one of the two is within e / 2 of it. Every vector therefore also visits the
cells whose plane is that near, and no pair is lost, whatever centroids the sample gave. Home rows and visitors of a cell are cut
into blocks of about BLOCK rows by a hash; a task compares a block of home rows with one of home rows or of visitors, in
single precision first, in double precision where that comes near. It returns one row for each vector, not for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.llm._graph import connected_components, local_roots
from lexitab.llm._support import cut, hold, release, ship

#: Vectors that the centroids are fitted on at most, about, and for each centroid; every vector is assigned and compared.
SAMPLE, SAMPLE_A_CELL = 20_000, 16
#: Rows of the largest label for each cell, and cells at most.
CELL_ROWS = 4_096
MAX_CELLS = 8_192
BLOCK = 2_048
ITERATIONS = 8
#: Slack of bounds over rounding in double precision, and in single precision.
SLACK, SINGLE_SLACK = 1e-9, 1e-4
_PAIRS = 1 << 18
#: Products of vectors and centroids held at a time.
_PRODUCTS = 1 << 22


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows times powers of two, so that squares neither overflow nor vanish; exact but for subnormal parts."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each vector's centroid of the highest product, and that product."""
    step = max(1, _PRODUCTS // max(1, len(centroids)))
    found, highest = [], []
    for low in range(0, len(vectors), step):
        products = vectors[low : low + step] @ centroids.T
        found.append(products.argmax(axis=1))
        highest.append(products.max(axis=1))
    return np.concatenate(found), np.concatenate(highest)


def spherical_kmeans(vectors: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Unit centroids; empty clusters take the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(ITERATIONS):
        own, products = nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms < SLACK)
        if len(empty):
            worst = np.argsort(products)[: len(empty)]
            sums[empty], norms[empty] = vectors[worst], 1.0
        centroids = sums / norms[:, None]
    return np.unique(centroids, axis=0)


def visited(units: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each vector's home cell, and the cells that it also visits."""
    homes, visits = [], []
    step = max(1, _PRODUCTS // max(1, len(centroids)))
    for low in range(0, len(units), step):
        products = units[low : low + step] @ centroids.T
        own = np.arange(len(products))
        home = products.argmax(axis=1)
        gaps = np.sqrt(np.maximum(2 - 2 * centroids[home] @ centroids.T, 0))
        near = products[own, home][:, None] - products <= (reach / 2 + SLACK) * gaps
        near[own, home] = False
        homes.append(home)
        visits += [np.flatnonzero(flags).astype(np.int32) for flags in near]
    return np.concatenate(homes), visits


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of left and right rows with cosine >= threshold, in double precision."""
    left_norms, right_norms = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    near = (left / left_norms[:, None]).astype(np.float32) @ (right / right_norms[:, None]).astype(np.float32).T >= threshold - SINGLE_SLACK
    i, j = np.nonzero(near)
    keep = np.empty(len(i), bool)
    for low in range(0, len(i), _PAIRS):
        a, b = i[low : low + _PAIRS], j[low : low + _PAIRS]
        keep[low : low + _PAIRS] = np.einsum("ij,ij->i", left[a], right[b]) / (left_norms[a] * right_norms[b]) >= threshold
    return i[keep], j[keep]


def near_duplicate_vectors(
    df: DataFrame,
    *,
    threshold: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """A row for each input row: vec_id, n_links, component_id, kept.

    Vectors are compared only under equal, not null labels and equal lengths. A vector that is null, empty, zero or has a
    null or non-finite component, or has no label, links with nothing and is its own component. Equal vectors are compared once
    and counted as often as they occur; a repeated row is one more vector. n_links counts the other vectors linked directly,
    component_id is the smallest id that can be reached (null ids don't count), kept says that it is the row's own id. Other
    columns are ignored; an empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    # Single precision stays as it is on the way; all arithmetic is in double precision.
    kept_type = "array<float>" if df.schema[vector_column].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = df.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast(kept_type).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(usable, F.col("v")).alias("v"))
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = cut(distinct.withColumn("g", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    groups = distinct.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    common = groups.orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, total, most = common[0] if common else (0, 0, 0)
    centroids = np.zeros((0, dim))
    if total:  # other lengths than the commonest share one cell
        cells, slots = min(MAX_CELLS, -(-most // CELL_ROWS)), 1 << 20
        share = min(slots, -(-max(SAMPLE, SAMPLE_A_CELL * cells) * slots // total))
        sample = distinct.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("g"), F.lit(slots)) < share)).select("v").toArrow()
        vectors = np.array(sample.column("v").combine_chunks().flatten(), float).reshape(-1, dim) if sample.num_rows else np.ones((1, dim))
        vectors = scaled(vectors)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        centroids = spherical_kmeans(vectors, cells)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def assign(batches):
        hold("embedding")
        for batch in batches:
            dims = np.array(batch.column("dim"))
            homes, visits = np.zeros(len(dims), np.int32), [[] for _ in dims]
            own = np.flatnonzero(dims == dim)
            if len(own):
                units = np.array(batch.column("v").take(pa.array(own)).flatten(), float).reshape(-1, dim)
                units = scaled(units)
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                home, also = visited(units, centroids, reach)
                homes[own] = home
                for i, cells in zip(own, also):
                    visits[i] = cells
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "home", "visits"])

    columns = distinct.select("g", "n", "label", "dim", "v")
    schema = T.StructType([*columns.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
    placed = cut(columns.mapInArrow(assign, schema))
    cells = F.transform(F.concat(F.array("home"), "visits"), lambda c, i: F.struct(c.alias("cell"), (i == 0).alias("lives")))
    members = placed.select("*", F.explode(cells).alias("c")).select("*", "c.cell", "c.lives").drop("c")
    place = ["label", "dim", "cell"]
    blocks = lambda c: F.ceil(F.count_if(c) / F.lit(BLOCK)).cast("int")
    counts = members.groupBy(*place).agg(blocks(F.col("lives")).alias("homes"), blocks(~F.col("lives")).alias("guests"))
    members = members.join(counts, place).where("homes > 0")
    block = F.pmod(F.xxhash64("g"), F.when(F.col("lives"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    members = members.withColumn("block", block)
    task = lambda i, j, visit, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(visit).alias("visit"), F.lit(side).alias("side"))
    to = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<i:int,j:int,visit:boolean,side:int>>"))
    own = F.col("block")
    first = F.filter(to(F.col("homes"), lambda o: task(own, o, False, 0)), lambda t: t["j"] >= t["i"])
    second = F.filter(to(F.col("homes"), lambda o: task(o, own, False, 1)), lambda t: t["i"] < t["j"])
    host = to(F.col("guests"), lambda o: task(own, o, True, 0))
    guest = to(F.col("homes"), lambda o: task(o, own, True, 1))
    tasks = F.when(F.col("lives"), F.concat(first, second, host)).otherwise(guest)
    dealt = members.select(*place, "g", "n", "v", "home", "visits", F.explode(tasks).alias("t")).select("*", "t.*").drop("t")

    def compare(group: pa.Table) -> pa.Table:
        hold("embedding")
        cell, i, j, visit = (group.column(c)[0].as_py() for c in ("cell", "i", "j", "visit"))
        g, n, home = (np.array(group.column(c)) for c in ("g", "n", "home"))
        v = scaled(np.array(group.column("v").combine_chunks().flatten(), float).reshape(len(g), -1))
        side = np.array(group.column("side"))
        left = np.flatnonzero(side == 0)
        right = left if i == j and not visit else np.flatnonzero(side == 1)
        a, b = linked(v[left], v[right], threshold)
        a, b = left[a], right[b]
        if right is left:
            a, b = a[a < b], b[a < b]
        if visit and len(a):
            # A pair whose vectors visit each other's cell counts in the lower cell.
            shared = home[b] < cell
            calls = {row: set(group.column("visits")[row].as_py()) for row in np.unique(a[shared]).tolist()}
            twice = np.array([s and h in calls[row] for row, h, s in zip(a.tolist(), home[b].tolist(), shared.tolist())], bool)
            a, b = a[~twice], b[~twice]
        links = np.zeros(len(g), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        some = np.flatnonzero(links)
        return pa.table({"g": g[some], "root": g[local_roots(len(g), a, b)[some]], "links": links[some]})

    found = cut(dealt.groupBy(*place, "i", "j", "visit").applyInArrow(compare, "g long, root long, links long"))
    release(placed)
    components = connected_components(found.select(F.col("g").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("g").agg(F.sum("links").alias("links"))
    own = distinct.select("g", "label", "v", "first", "n").join(components.withColumnRenamed("node", "g"), "g", "left").join(links, "g", "left")
    own = cut(own.withColumn("component", F.coalesce("component", "g")))
    release(distinct, found, components)
    heads = own.groupBy("component").agg(F.min("first").alias("component_id"))
    known = own.join(heads, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(known, ["label", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
