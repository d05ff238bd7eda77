"""Catalogs of data sets and what stands beside the data: sidecars, pinned archives, folders of records, inventories, event logs.

Catalogs, pins and sidecars are small tables with a row for each data set or file; what they describe is read by Spark.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.operators.dedup import assert_unique

#: Roles of columns; a target never is an input.
ROLES = ("target", "text", "other")


def read_catalog(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """A catalog's entries: JSON lines, or a YAML list where the path ends in .yaml; an error if a key repeats."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ImportError("YAML catalogs need the package yaml; JSON lines don't") from missing
        (said,) = spark.read.text(path, wholetext=True).first()
        catalog = spark.createDataFrame(yaml.safe_load(said), schema)
    else:
        catalog = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for key in keys:
        assert_unique(catalog, [key])
    return catalog


def selected_entries(catalog: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """The entries whose key isn't among the excluded ones."""
    return catalog.join(excluded.select(key), key, "left_anti")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """A data set's JSON sidecar: target, task_type, num_rows, num_columns, num_classes, text_columns."""
    said = json.loads(spark.read.text(path, wholetext=True).first()[0])
    missing = {"target", "task_type", "num_rows", "num_columns"} - said.keys()
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    if said["task_type"] == "binary_classification" and said.get("num_classes") != 2:
        raise ValueError(f"{path}: a binary task has two classes")
    return said


def with_roles(df: DataFrame, target: str, text_columns: list[str]) -> DataFrame:
    """df with each column's role in its schema's metadata; an error for a column that isn't there or has two roles."""
    named = [target, *text_columns]
    if len(set(named)) != len(named) or not set(named) <= set(df.columns):
        raise ValueError(f"roles don't fit the columns {', '.join(df.columns)}")
    role = lambda c: "target" if c == target else "text" if c in text_columns else "other"
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"role": role(c)}) for c in df.columns])


def of_role(df: DataFrame, *roles: str) -> DataFrame:
    """The columns of these roles."""
    if not set(roles) <= set(ROLES):
        raise ValueError(f"roles are {', '.join(ROLES)}")
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if f.metadata.get("role") in roles])


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that a path or glob pattern names; a file is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, member, size, sha256, content) for each file in the ZIP archives of (path, content), member by member."""
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.infolist():
                        if not member.is_dir():
                            yield pa.RecordBatch.from_pylist([{"archive": name, "member": member.filename, "content": archive.read(member)}], schema)

    found = files.select("path", "content").mapInArrow(unpack, "archive string, member string, content binary")
    return found.select("archive", "member", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def pinned(members: DataFrame, pins: DataFrame) -> DataFrame:
    """The members that pins (member, sha256) name; an error if one is missing or isn't what was pinned."""
    wanted = pins.select("member", F.col("sha256").alias("pinned"))
    assert_unique(wanted, ["member"])
    joined = wanted.join(members, "member", "left")
    wrong = joined.where("sha256 is null or sha256 <> pinned").select("member").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0][0]} is missing or isn't the pinned file")
    return joined.drop("pinned")


def union_of_records(spark: SparkSession, pattern: str, schema: T.StructType | str, tag: str, wanted: str) -> DataFrame:
    """The JSON records of all files that a glob pattern names, with the file's name, those of another schema tag left out."""
    rows = spark.read.schema(schema).json(pattern)
    return rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).where(F.col(tag) == wanted).drop(tag)


def inventory(spark: SparkSession, path: str, columns: list[str], unwanted: Column | None = None) -> DataFrame:
    """columns, files, rows, bytes of a Parquet folder, from these columns and the files' metadata alone."""
    rows = spark.read.parquet(path)
    rows = rows if unwanted is None else rows.where(~unwanted)
    files = rows.groupBy(*columns, F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__rows"), F.first("_metadata.file_size").alias("__bytes"))
    return files.groupBy(*columns).agg(F.count(F.lit(1)).alias("files"), F.sum("__rows").alias("rows"), F.sum("__bytes").alias("bytes"))


def append_events(events: DataFrame, path: str, text_columns: tuple[str, ...] = ("text",)) -> None:
    """Adds JSON lines to an event log; an error for columns that hold row texts."""
    if set(text_columns) & set(events.columns):
        raise ValueError("row texts don't belong into the event log")
    events.write.mode("append").json(path)


def _each(function: Callable, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """A function of Arrow arrays from one of values that aren't null."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], kind)

    return run


def inflated(column: Column) -> Column:
    """The text in zlib-compressed bytes; null for null."""
    return F.arrow_udf(_each(lambda v: zlib.decompress(v).decode("utf-8"), pa.string()), "string")(column)


def deflated(column: Column) -> Column:
    """zlib-compressed UTF-8 of a text; null for null."""
    return F.arrow_udf(_each(lambda v: zlib.compress(v.encode("utf-8")), pa.binary()), "binary")(column)


def float_vector(column: Column) -> Column:
    """array<float> of little-endian 4-byte numbers; null for null."""
    return F.arrow_udf(_each(lambda v: np.frombuffer(v, "<f4"), pa.list_(pa.float32())), "array<float>")(column)


def float_bytes(column: Column) -> Column:
    """The little-endian 4-byte numbers of an array<float>; null for null."""
    return F.arrow_udf(_each(lambda v: np.array(v, "<f4").tobytes(), pa.binary()), "binary")(column)


def npz_arrays(files: DataFrame) -> DataFrame:
    """(file, name, shape, values) of the numeric arrays in the NPZ files of (path, content); arrays of objects are an error."""
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])

    def unpack(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        yield pa.RecordBatch.from_pylist([{"file": file.rsplit("/", 1)[-1], "name": name, "shape": list(arrays[name].shape), "values": arrays[name].astype(float).ravel().tolist()}], schema)

    return files.select("path", "content").mapInArrow(unpack, "file string, name string, shape array<long>, values array<double>")


def npz_bytes(values: Column, name: str = "values") -> Column:
    """An NPZ file with one array of numbers for each row's list; null for null."""

    def pack(lists: pa.Array) -> pa.Array:
        out = []
        for numbers in lists.to_pylist():
            file = io.BytesIO()
            if numbers is not None:
                np.savez_compressed(file, **{name: np.array(numbers, float)})
            out.append(None if numbers is None else file.getvalue())
        return pa.array(out, pa.binary())

    return F.arrow_udf(pack, "binary")(values.cast("array<double>"))
