"""Scans that check what they read: CSV with a sidecar, accounting text, JSON records, and checksummed table exports."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from lexitab.functions.json_values import json_numbers


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, through Spark's file systems."""
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """A CSV file with a header; an error if the numbers of rows or columns aren't those of the sidecar."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if columns is not None and len(df.columns) != columns:
        raise ValueError(f"{path}: {len(df.columns)} columns, not {columns}")
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{path}: {found} rows, not {rows}")
    return df


def with_row_ids(df: DataFrame, name: str = "row_id", prefix: str = "csv:") -> DataFrame:
    """csv:<position> for the rows of one scan, in its order; assigned once, at ingest.

    A row's place in its partition and the rows of the partitions before it: the counts are a row for each partition.
    """
    part, place = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = df.withColumns({"__part": part, "__place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    position = (F.col("__start") + F.col("__place")).cast("string")
    return rows.join(F.broadcast(starts), "__part").select(F.concat(F.lit(prefix), position).alias(name), *[f"`{c}`" for c in df.columns])  # a row for each partition


def scan_accounting(lines: DataFrame, fields: list[str], terminal: tuple[str, ...] = ("COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "OUT_OF_MEMORY"), whole: tuple[str, ...] = ("seconds",)) -> DataFrame:
    """Pipe-delimited lines whose last field may hold pipes; keeps terminal states, the state's first word only.

    Lines with too few fields, and those whose fields named in whole aren't digits only, are no records.
    """
    parts = F.split("value", r"\|", len(fields))
    rows = lines.where(F.size(parts) == len(fields)).select(*[parts[i].alias(f) for i, f in enumerate(fields)])
    for name in whole:
        if name in fields:
            rows = rows.where(F.col(name).rlike("^[0-9]+$") & F.col(name).try_cast("long").isNotNull())
    return rows.withColumn("state", F.split("state", " ")[0]).where(F.col("state").isin(*terminal))


def register_accounting(spark: SparkSession, name: str, fields: list[str], resources: str = "tres", seconds: str = "seconds") -> None:
    """Registers a table function of SQL: name(TABLE(lines)) gives a row for each resource of each record of accounting lines (column value).

    Columns: the fields but the resources, resource, amount (long), hours (of seconds times amount). A record's resources are a list such as
    cpu=4,mem=8G; amounts that begin with no digit give no row. Lines are records as for scan_accounting(), whatever their state.
    """
    kept = [f for f in fields if f != resources]
    at, timed = fields.index(resources), fields.index(seconds)

    class Resources:
        def eval(self, row: Row):
            parts = (row["value"] or "").split("|", len(fields) - 1)
            if len(parts) != len(fields) or not (parts[timed].isascii() and parts[timed].isdigit()):
                return
            own = [p for i, p in enumerate(parts) if i != at]
            for item in parts[at].split(","):
                resource, _, said = item.partition("=")
                digits = said[: len(said) - len(said.lstrip("0123456789"))] if said.isascii() else ""
                if resource and digits:
                    yield (*own, resource, int(digits), int(parts[timed]) * int(digits) / 3600)

    schema = ", ".join(f"`{f}` string" for f in kept) + ", resource string, amount long, hours double"
    spark.udtf.register(name, udtf(Resources, returnType=schema))


def tres(column: str, key: str):
    """The number of a key in a resource list such as cpu=4,mem=8G; 0 if absent."""
    said = F.str_to_map(F.col(column), F.lit(","), F.lit("="))[key]
    return F.coalesce(F.regexp_substr(said, F.lit("^[0-9]+")).cast("long"), F.lit(0))


def flatten_numbers(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, metric (path), value: a row for each number of a JSON cell at any depth, in objects and lists; see functions.json_values.

    Key columns may have any names but metric and value. Cells that are null or aren't JSON give no row.
    """
    cells = df.select(*[F.col(f"`{k}`") for k in keys], json_numbers(F.col(f"`{column}`")).alias("metric"))
    return cells.select(*[F.col(f"`{k}`") for k in keys], F.explode("metric").alias("metric", "value"))


def content_checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows: sums of row hashes, computed on the executors.

    It tells apart tables that differ by accident; sums of hashes are no proof against somebody who makes rows to fit.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]).first()
    said = json.dumps([sums["n"], *[str(sums[f"s{i}"]) for i in range(4)], sorted(df.dtypes)])
    return sums["n"], hashlib.sha256(said.encode()).hexdigest()


def write_export(spark: SparkSession, target: str, tables: dict[str, DataFrame], *, schema: str, identity: dict) -> dict:
    """Tables as Parquet under a fresh version folder, read back and checked, and the manifest last, so readers see all or nothing."""
    version = uuid.uuid4().hex
    manifest = {"schema": schema, "identity": identity, "version": version, "tables": {}}
    for name, df in sorted(tables.items()):
        path = f"{target}/{version}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        rows, digest = content_checksum(spark.read.parquet(path))
        manifest["tables"][name] = {"rows": rows, "digest": digest}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest")
    return manifest


def read_export(spark: SparkSession, target: str, *, schema: str, identity: dict | None = None) -> tuple[str, dict[str, DataFrame]]:
    """(status, tables): awaiting_export without a manifest, superseded_schema for another schema, else ok; an error if a table isn't what was written."""
    try:
        manifest = json.loads(read_text(spark, f"{target}/manifest"))
    except Exception as missing:  # the analyser's error for a path that isn't there
        if "PATH_NOT_FOUND" in str(missing):
            return "awaiting_export", {}
        raise
    if manifest["schema"] != schema or (identity is not None and manifest["identity"] != identity):
        return "superseded_schema", {}
    tables = {}
    for name, said in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{target}/{manifest['version']}/{name}")
        if content_checksum(tables[name]) != (said["rows"], said["digest"]):
            raise ValueError(f"{target}: table {name} isn't what was written")
    return "ok", tables


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV folder; nested columns as JSON."""
    nested = {c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
