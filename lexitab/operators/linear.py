"""Learned transforms fitted on a training part only: PCA, imputation, scaling, one-hot and fold inputs."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _added(parts: DataFrame) -> np.ndarray:
    """The element-wise sums of rows (at, values) with the same at, in the order of at; executors add, and the sums alone reach the driver."""

    def add(group: pa.Table) -> pa.Table:
        values = np.array(group.column("values").combine_chunks().flatten()).reshape(group.num_rows, -1)
        return pa.table({"at": group.column("at").slice(0, 1), "values": pa.array([values.sum(axis=0)], pa.list_(pa.float64()))})

    found = parts.groupBy("at").applyInArrow(add, "at int, values array<double>").orderBy("at").collect()
    return np.array([r["values"] for r in found])


def _sums(df: DataFrame, vector: str, each) -> np.ndarray:
    """The matrix each(x) summed over all rows x of batches of known vectors; a row of the matrix is one row of the shuffle."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                some = each(np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1))
                held = some if held is None else held + some
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], ["at", "values"])

    return _added(rows.mapInArrow(run, "at int, values array<double>"))


def _moments(df: DataFrame, vector: str) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, variance) of known vectors."""
    found = _sums(df, vector, lambda x: np.vstack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(found):
        return 0.0, np.zeros(0), np.zeros(0)
    n, mean = found[0, 0], found[1] / found[0, 0]
    return n, mean, np.maximum(found[2] / n - mean * mean, 0)


def _signed(axes: np.ndarray) -> np.ndarray:
    """Each axis with its largest entry positive."""
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def principal_axes(df: DataFrame, vector: str, components: int, seed_sign: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, explained variance share) from one distributed sum of outer products; null vectors don't count.

    The covariance has dim * dim numbers whatever the number of rows; each axis has its largest entry positive. For vectors too wide for
    that see wide_axes().
    """
    n, mean, _ = _moments(df, vector)
    covariance = _sums(df, vector, lambda x: (x - mean).T @ (x - mean)) / max(1, n - 1)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][: min(components, int(n) - 1, len(mean))]
    axes = axes[:, order].T
    return mean, _signed(axes) if seed_sign else axes, values[order] / values.sum()


def wide_axes(df: DataFrame, vector: str, components: int, *, more: int = 10, passes: int = 6, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """principal_axes() by a randomised range finder: each pass multiplies the covariance with components + more columns.

    A pass sums dim * (components + more) numbers; the columns are made orthonormal between passes. Axes whose variance is well
    above that of the columns left out come out as those of the covariance.
    """
    n, mean, variance = _moments(df, vector)
    width = min(components + more, len(mean))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_sums(df, vector, lambda x, q=basis: (x - mean).T @ ((x - mean) @ q)))[0]
    small = _sums(df, vector, lambda x: ((x - mean) @ basis).T @ ((x - mean) @ basis)) / max(1, n - 1)
    values, inner = np.linalg.eigh(small)
    order = np.argsort(values)[::-1][: min(components, int(n) - 1, width)]
    total = variance.sum() * n / max(1, n - 1)
    return mean, _signed((basis @ inner[:, order]).T), values[order] / total


class FieldAxes:
    """Principal axes of several vector columns, each by itself (per_field) or all of them as one vector (joint), fitted on training rows.

    In the joint scope a missing vector becomes its column's training mean, and rows without any vector don't count; by itself a
    missing vector gives missing coordinates. With standardise, components are divided by their training deviation first. A column
    without training vectors has no axes.
    """

    def __init__(self, fields: list[str], components: int, scope: str = "per_field", standardise: bool = False):
        if scope not in ("per_field", "joint") or components < 1:
            raise ValueError("scope is per_field or joint, components are 1 or more")
        self.fields, self.components, self.scope, self.standardise = fields, components, scope, standardise
        self.parameters: dict[str, dict[str, np.ndarray]] = {}

    def _vector(self, df: DataFrame, name: str, means: dict[str, np.ndarray]) -> DataFrame:
        """df with __v, the vector that the axes of name are fitted on."""
        if name != "joint":
            return df.withColumn("__v", F.col(name).cast("array<double>"))
        parts = [F.coalesce(F.col(f).cast("array<double>"), F.array(*map(F.lit, means[f].tolist())).cast("array<double>")) for f in self.fields]
        return df.withColumn("__v", F.when(F.coalesce(*[F.when(F.col(f).isNotNull(), 1) for f in self.fields]) == 1, F.concat(*parts)))

    def fit(self, train: DataFrame, cache: FitCache | None = None, rows: DataFrame | None = None) -> FieldAxes:
        """Fits on train; with a cache, a fit on the same rows (rows, or train itself) and settings is read instead."""
        for name in self.fields if self.scope == "per_field" else ["joint"]:
            used = [name] if name != "joint" else self.fields
            fit = lambda name=name: self._fitted(train, name)
            if cache is None:
                self.parameters[name] = fit()
            else:
                settings = {"fields": used, "components": self.components, "scope": self.scope, "standardise": self.standardise}
                self.parameters[name] = cache.fitted(train.select(*used) if rows is None else rows, settings, fit)
        return self

    def _fitted(self, train: DataFrame, name: str) -> dict[str, np.ndarray]:
        means = {f: _moments(train, f)[1] for f in self.fields} if name == "joint" else {}
        rows = self._vector(train, name, means)
        n, mean, variance = _moments(rows, "__v")
        out = {f"mean:{f}": m for f, m in means.items()} | {"rows": np.array([n])}
        if n < 2:
            return out | {"mean": mean, "scale": np.ones(len(mean)), "axes": np.zeros((0, len(mean))), "share": np.zeros(0)}
        scale = np.where(variance > 0, np.sqrt(variance), 1.0) if self.standardise else np.ones(len(mean))
        covariance = _sums(rows, "__v", lambda x: ((x - mean) / scale).T @ ((x - mean) / scale)) / (n - 1)
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][: min(self.components, int(n) - 1, len(mean))]
        total = values.sum()
        return out | {"mean": mean, "scale": scale, "axes": _signed(axes[:, order].T), "share": values[order] / total if total > 0 else np.zeros(len(order))}

    def transform(self, df: DataFrame, suffix: str = "_axes") -> DataFrame:
        """df with an array of coordinates for each field, or one named joint; null for a missing vector."""
        for name, p in self.parameters.items():
            means = {f: p[f"mean:{f}"] for f in self.fields if f"mean:{f}" in p}
            rows = self._vector(df, name, means)
            df = project(rows, "__v", p["mean"], p["axes"] / p["scale"], f"{name}{suffix}").drop("__v")
        return df


class FitCache:
    """Fitted parameters by content: a fit is found again by its settings and the exact rows that it was made on, in any order.

    Each fit is a folder of its own under its digest, written once; what is read back must have the checksum it was written with,
    else the fit is made anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: Fits made and fits found since the start.
        self.made, self.found = 0, 0

    def fitted(self, rows: DataFrame, settings: dict, fit) -> dict[str, np.ndarray]:
        from lexitab.sources.tables import content_checksum

        key = hashlib.sha256(json.dumps([settings, *content_checksum(rows)], sort_keys=True).encode()).hexdigest()
        path = f"{self.folder}/{key}"
        known = self._read(path)
        if known is not None:
            self.found += 1
            return known
        self.made += 1
        made = fit()
        stored = [(name, list(x.shape), np.asarray(x, float).ravel().tolist()) for name, x in sorted(made.items())]
        df = self.spark.createDataFrame([(*row, self._checksum(made)) for row in stored], "name string, shape array<int>, numbers array<double>, checksum string")
        df.coalesce(1).write.mode("overwrite").parquet(path)
        return made

    @staticmethod
    def _checksum(parameters: dict[str, np.ndarray]) -> str:
        said = hashlib.sha256()
        for name, x in sorted(parameters.items()):
            said.update(json.dumps([name, list(x.shape)]).encode() + np.asarray(x, "<f8").tobytes())
        return said.hexdigest()

    def _read(self, path: str) -> dict[str, np.ndarray] | None:
        try:
            rows = self.spark.read.parquet(path).collect()  # the parameters of one fit
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
                return None
            raise
        found = {r["name"]: np.array(r["numbers"], float).reshape(r["shape"]) for r in rows}
        return found if rows and rows[0]["checksum"] == self._checksum(found) else None


def project(df: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, out: str = "components") -> DataFrame:
    """Adds the coordinates on the axes; null for a null vector."""
    def run(vectors: pa.Array) -> pa.Array:
        known = np.array(vectors.is_valid())
        result = [None] * len(vectors)
        if known.any():
            x = np.array(vectors.drop_null().flatten(), float).reshape(int(known.sum()), -1)
            for i, row in zip(np.flatnonzero(known), (x - mean) @ axes.T):
                result[i] = row.tolist()
        return pa.array(result, pa.list_(pa.float64()))

    return df.withColumn(out, F.arrow_udf(run, "array<double>")(F.col(vector).cast("array<double>")))


class FoldInput:
    """Numbers as doubles, ISO dates as seconds, and strings as codes of the training vocabulary; unseen is missing."""

    def __init__(self, numeric: list[str], dates: list[str], categorical: list[str]):
        self.numeric, self.dates, self.categorical = numeric, dates, categorical
        self.vocabulary: DataFrame | None = None
        self.means: dict[str, float] = {}

    def fit(self, train: DataFrame) -> FoldInput:
        """Vocabularies in order of value, and means, from the training rows."""
        from pyspark.sql import Window as W

        from lexitab.functions.text import finite

        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in self.categorical] or [F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value"))]))
        seen = train.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()
        # The first two characters cut a vocabulary into stretches that follow its order.
        seen = seen.withColumn("start", F.rpad(F.substring("value", 1, 2), 2, "\0"))
        sizes = seen.groupBy("field", "start").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("field", "start", F.coalesce(F.sum("n").over(W.partitionBy("field").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = seen.withColumn("at", F.row_number().over(W.partitionBy("field", "start").orderBy("value"))).join(before, ["field", "start"])
        self.vocabulary = placed.select("field", "value", (F.col("before") + F.col("at") - 1).cast("int").alias("code"))
        if self.numeric:
            row = train.agg(*[F.avg(finite(c)).alias(c) for c in self.numeric]).first()
            self.means = {c: row[c] for c in self.numeric}
        return self

    def transform(self, df: DataFrame, impute: bool = False) -> DataFrame:
        """The fitted columns replaced; with impute missing numbers are the training means."""
        from lexitab.functions.text import epoch_seconds, finite

        for c in self.numeric:
            df = df.withColumn(c, F.coalesce(finite(c), F.lit(self.means.get(c))) if impute else finite(c))
        for c in self.dates:
            df = df.withColumn(c, epoch_seconds(c))
        for c in self.categorical:
            codes = self.vocabulary.where(F.col("field") == c).select(F.col("value").alias(c), F.col("code").alias("__code"))
            df = df.withColumn(c, F.col(c).cast("string")).join(codes, c, "left").withColumn(c, F.col("__code")).drop("__code")
        return df


def standardised(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with missing numbers as the training mean, less that mean, over the training deviation; constant columns are 0."""
    from lexitab.functions.text import finite

    row = train.agg(*[x for c in columns for x in (F.avg(finite(c)).alias(f"m_{c}"), F.stddev_pop(finite(c)).alias(f"s_{c}"))]).first()
    out = {}
    for c in columns:
        mean, scale = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (F.coalesce(finite(c), F.lit(mean)) - F.lit(mean)) / F.lit(scale) if scale else F.lit(0.0)
    return df.withColumns(out)


def standardised_by_fold(df: DataFrame, columns: list[str], fold: str) -> DataFrame:
    """df with each fold's rows standardised by the rows of all other folds only: missing numbers become their mean, constant columns 0.

    One aggregate gives each fold's sums; a fold's training sums are all sums less its own, so no row can reach its own scaling. A column
    that no other fold knows is null.
    """
    from lexitab.functions.text import finite

    x = {i: finite(c) for i, c in enumerate(columns)}
    own = df.groupBy(F.col(fold).alias("__fold")).agg(*[a for i, v in x.items() for a in (F.count(v).alias(f"n{i}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"q{i}"))])
    every = own.agg(*[F.sum(f"{k}{i}").alias(f"all_{k}{i}") for i in x for k in "nsq"])
    rest = own.crossJoin(F.broadcast(every))  # one row
    facts = []
    for i in x:
        n, total, squares = (F.col(f"all_{k}{i}") - F.col(f"{k}{i}") for k in "nsq")
        mean = total / F.nullif(n, F.lit(0))
        spread = F.sqrt(F.greatest(squares / F.nullif(n, F.lit(0)) - mean * mean, F.lit(0.0)))
        facts += [mean.alias(f"__m{i}"), F.when(spread > 1e-9 * F.greatest(F.lit(1.0), F.abs(mean)), spread).alias(f"__d{i}")]
    told = df.join(F.broadcast(rest.select("__fold", *facts)), df[fold].eqNullSafe(F.col("__fold")))  # a row for each fold
    out = {c: F.when(F.col(f"__m{i}").isNotNull(), F.coalesce((F.coalesce(x[i], F.col(f"__m{i}")) - F.col(f"__m{i}")) / F.col(f"__d{i}"), F.lit(0.0))) for i, c in enumerate(columns)}
    return told.withColumns(out).select(*[f"`{c}`" for c in df.columns])


def one_hot(train: DataFrame, df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """df with <column>_hot, 1 in the place of the value in the training values' order, all 0 for an unseen or null value.

    An error beyond most training values, as each row carries as many numbers.
    """
    values = [r[0] for r in train.where(F.col(column).isNotNull()).select(F.col(column)).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.withColumn(f"{column}_hot", F.array(*[F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in sorted(values)]) if values else F.array().cast("array<int>"))
