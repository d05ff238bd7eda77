"""Feature blocks: selection, views, assembly by row, presence flags, and the plan of what a block would cost."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitab.functions.text import text_value
from lexitab.operators.dedup import assert_unique
from lexitab.operators.ordered import exact_quantiles


def select_where(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose fields equal the wanted values; a wanted None means null."""
    for field, value in wanted.items():
        df = df.where(F.col(field).isNull() if value is None else F.col(field) == value)
    return df


def exactly_one(df: DataFrame, what: str):
    """The only row; different errors for none and for several."""
    found = df.limit(2).collect()
    if not found:
        raise LookupError(f"{what} is missing")
    if len(found) > 1:
        raise LookupError(f"{what} is ambiguous")
    return found[0]


def without_block(df: DataFrame, marker: str) -> DataFrame:
    """df without the columns whose name holds the marker; an error if there is none."""
    gone = [c for c in df.columns if marker in c]
    if not gone:
        raise ValueError(f"no column holds {marker!r}")
    return df.drop(*gone)


def column_groups(columns: list[str], pattern: str = r"^(?P<provider>\w+?)__(?P<mode>\w+?)__(?P<group>\w+?)__(?P<key>\w+)$") -> dict[tuple[str, ...], list[str]]:
    """Columns by what their names say; those that don't match stand alone under their name."""
    out: dict[tuple[str, ...], list[str]] = {}
    for c in columns:
        m = re.match(pattern, c)
        out.setdefault((m["provider"], m["mode"], m["group"]) if m else (c,), []).append(c)
    return out


def presence_flags(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """Adds <column>__missing, 1 where the text is missing."""
    return df.withColumns({f"{c}__missing": text_value(c).isNull().cast("int") for c in text_columns})


def assemble(base: DataFrame, blocks: list[DataFrame], key: str) -> DataFrame:
    """base beside the columns of each block by key; a block must have every key of base once and no other."""
    assert_unique(base, [key])
    for block in blocks:
        assert_unique(block, [key])
        clash = set(base.columns) & set(block.columns) - {key}
        if clash:
            raise ValueError(f"columns in two blocks: {', '.join(sorted(clash))}")
        sides = base.select(key, F.lit(1).alias("a")).join(block.select(key, F.lit(1).alias("b")), key, "full")
        if not sides.where("a is null or b is null").isEmpty():
            raise ValueError("a block lacks rows or has rows of its own")
        base = base.join(block, key)
    return base


def responses_to_block(requests: DataFrame, responses: DataFrame, row: str, group: str, request_key: str, value: str, groups: list[str]) -> DataFrame:
    """A row for each row id and a column for each group with the response's value; null without a request or response."""
    assert_unique(responses, [request_key])
    joined = requests.join(responses.select(request_key, value), request_key, "left")
    return joined.groupBy(row).pivot(group, groups).agg(F.first(value, ignorenulls=True))


def feature_plan(slots: DataFrame) -> DataFrame:
    """slot, requests, unique_requests, empty: what it takes to answer the slots of row_id, slot, input_key."""
    known = F.col("input_key").isNotNull()
    by_key = slots.groupBy("slot", "input_key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("slot").agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("requests"), F.count_if(known).alias("unique_requests"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("empty"))


def training_bins(train: DataFrame, query: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """query with <column>_bin: the number of the training quantiles at or below the value."""
    found = exact_quantiles(train, column, {f"q{i}": q for i, q in enumerate(quantiles)}).first()
    kept = sorted({e for e in found or [] if e is not None})
    bucket: Column = F.size(F.filter(F.array(*map(F.lit, kept)), lambda e: e <= F.col(column))) if kept else F.lit(0)
    return query.withColumn(f"{column}_bin", bucket)


def contiguous_shard(position: Column, rows: int, shards: int) -> Column:
    """The shard of a position when shard i has [rows * i // shards, rows * (i + 1) // shards)."""
    # The largest i with rows * i / shards below position + 1.
    scaled = (position.cast("long") + 1) * shards
    return ((scaled - 1 - F.pmod(scaled - 1, F.lit(rows).cast("long"))) / rows).cast("int")
