"""Centroid clustering by delta Lloyd rounds in exact integer arithmetic.

Every round writes each vector's owner and distance, and keeps each cluster's component sums and count. A vector whose owner
stood still knows its distance already and is compared with the changed centroids only; one whose owner moved is compared with
all. Vectors that change owner add their components to one sum and take them from another: these signed transfers, summed by
cluster and component, are all that the next centroids need. They are integers, so the sums are exact whatever the order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.llm._support import cut_columnar, hold, release, ship

#: Components beyond this are held to it, so that a squared distance of 64 of them fits in a long.
LARGEST = 1 << 27
#: Products of vectors and centroids held at a time.
_PRODUCTS = 1 << 20


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors; in double precision where no sum reaches 2**53."""
    if not len(vectors) or not len(centroids):
        return np.zeros((len(vectors), len(centroids)), np.int64)
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * largest * largest * vectors.shape[1] < 1 << 53:
        a, b = vectors.astype(float), centroids.astype(float)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        gap = vectors - centroid
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def reassigned(vectors: np.ndarray, owners: np.ndarray, distances: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many distances were computed. Owner -1 is none; the smaller number wins a tie."""
    owners, distances = owners.copy(), distances.copy()
    moved = (owners < 0) | changed[owners]
    computed = 0
    for rows, columns in ((np.flatnonzero(moved), np.arange(len(centroids))), (np.flatnonzero(~moved), np.flatnonzero(changed))):
        if not len(columns):
            continue
        step = max(1, _PRODUCTS // len(columns))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            found = squared_distances(vectors[some], centroids[columns])
            computed += found.size
            best = found.argmin(axis=1)
            near, number = found[np.arange(len(some)), best], columns[best]
            better = moved[some] | (near < distances[some]) | ((near == distances[some]) & (number < owners[some]))
            owners[some[better]], distances[some[better]] = number[better], near[better]
    return owners, distances, computed


@dataclass
class Clustering:
    """Fitted centroids, and the written table of vectors: id, v, owner (0, 1, ...), distance (squared)."""

    centroids: list[list[int]]
    assigned: DataFrame
    #: For each assignment: distances computed, vectors that changed owner, centroids that had changed before it.
    rounds: list[dict] = field(default_factory=list)


def quantised(df: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v) of the rows with exactly so many components, none null or non-finite; v has floor(scale * x) of each."""
    v = F.col(vector_column).cast("array<double>")
    fit = F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))).cast("int"))
    return df.where(fit).select(F.col(id_column).alias("id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of `seed:id`; null ids come last, equal ids in the order of their vectors."""
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(token.alias("token"), "v").orderBy(F.asc_nulls_last("token"), "v").limit(clusters)
    return [list(r["v"]) for r in rows.collect()]  # so many rows as there are clusters


def _columns(id_type: T.DataType) -> T.StructType:
    named = {"id": id_type, "v": T.ArrayType(T.IntegerType()), "owner": T.IntegerType(), "distance": T.LongType(), "before": T.IntegerType(), "computed": T.LongType()}
    return T.StructType([T.StructField(name, kind) for name, kind in named.items()])


def _assign(rows: DataFrame, centroids: list[list[int]], changed: list[bool]) -> DataFrame:
    """rows (id, v, owner, distance) with new owners and distances, the owners before, and the distances computed, noted in each batch's first row."""
    points, flags, schema = np.array(centroids, np.int64), np.array(changed, bool), _columns(rows.schema["id"].dataType)

    def run(batches):
        hold("lloyd")
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("v").flatten(), np.int64).reshape(batch.num_rows, -1)
            before = np.array(batch.column("owner"), np.int32)
            owners, distances, computed = reassigned(v, before, np.array(batch.column("distance"), np.int64), points, flags)
            noted = np.zeros(batch.num_rows, np.int64)
            noted[0] = computed
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *map(pa.array, (owners.astype(np.int32), distances, before, noted))], schema.names)

    return rows.mapInArrow(run, schema)


def transfers(rows: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed sums of components (clusters x dimensions) and counts that rows (v, before, owner) with another owner than before move.

    Each batch adds up its own moves; what is shuffled are so many numbers for each partition, and clusters x dimensions reach the driver.
    """

    def run(batches):
        hold("lloyd")
        sums = np.zeros((clusters, dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column("v").flatten(), np.int64).reshape(batch.num_rows, -1)
                v = np.hstack([v, np.ones((len(v), 1), np.int64)])
                old, new = np.array(batch.column("before")), np.array(batch.column("owner"))
                np.add.at(sums, new, v)
                np.subtract.at(sums, old[old >= 0], v[old >= 0])
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "sums"])

    partial = rows.where("owner <> before").select("v", "before", "owner").mapInArrow(run, "cluster int, sums array<long>")
    total = partial.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((clusters, dimensions + 1), object)
    for r in total.collect():
        out[r["cluster"], r["at"]] = r["x"]
    return out[:, :-1], out[:, -1]


def fit(
    df: DataFrame,
    *,
    clusters: int = 16,
    rounds: int = 3,
    dimensions: int = 64,
    scale: int = 64,
    seed: int = 1,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> Clustering:
    """Clusters the whole vectors of df (see quantised()): so many rounds of assigning and moving centroids, then one more assignment.

    Components become floor(scale * x), held to +-LARGEST. Empty clusters keep their centroid. Fewer vectors than clusters give a
    cluster for each vector. Rows that aren't whole are left out; repeated rows are vectors of their own. A round reads the
    assignments written before it and writes its own, then the older ones go; once no centroid changes, nothing is written any more.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = quantised(df, id_column, vector_column, dimensions, scale)
    centroids = first_centroids(vectors, clusters, seed)
    none = vectors.select("*", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    if not centroids:
        return Clustering([], none.where(F.lit(False)))
    changed = [True] * len(centroids)
    sums, counts = np.zeros((len(centroids), dimensions), object), np.zeros(len(centroids), object)
    table, log = None, []
    for number in range(rounds + 1):
        if any(changed):
            last = table
            rows = none if last is None else last.select("id", "v", "owner", "distance")
            table = cut_columnar(_assign(rows, centroids, changed))
            if last is not None:
                release(last)
            told = table.agg(F.sum("computed").alias("computed"), F.count_if(F.col("owner") != F.col("before")).alias("moved")).first()
            log.append({"computed": told["computed"], "moved": told["moved"], "changed": sum(changed)})
            if number < rounds and told["moved"]:
                moved_sums, moved_counts = transfers(table, len(centroids), dimensions)
                sums, counts = sums + moved_sums, counts + moved_counts
        if number < rounds:
            new = [[int(s) // int(n) for s in row] if n else old for row, n, old in zip(sums, counts, centroids)]
            changed = [a != b for a, b in zip(new, centroids)]
            centroids = new
    return Clustering(centroids, table.select("id", "v", "owner", "distance"), log)


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(df: DataFrame, **options) -> DataFrame:
    """A row for each whole vector of df: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Options as for fit().

    Vectors that are null, of another length, or with a null or non-finite component give no row; null ids and repeated rows give one
    each; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    found = fit(df, **options)
    spark = df.sparkSession
    rows = found.assigned
    per = rows.groupBy("owner").agg(F.sum("distance").alias("cluster_inertia"))
    sums = {r["owner"]: r["cluster_inertia"] for r in per.collect()}  # a row for each cluster
    kept = [(k, sums.get(k), sum(sums.values()), digest(c)) for k, c in enumerate(found.centroids)]
    facts = spark.createDataFrame(kept, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = rows.join(F.broadcast(facts), "owner")  # a row for each cluster
    return joined.select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
