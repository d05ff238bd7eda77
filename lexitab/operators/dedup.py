"""Exact text reuse, dictionary encoding with row links, and merges that refuse conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.functions.text import kind_of, spelt, text_value
from lexitab.operators import ordered
from lexitab.session import written_once


def slots(df: DataFrame, id_column: str, text_columns: list[str]) -> DataFrame:
    """(row_id, slot, input_key, chars): one row for each text column and one, named joint, for all that a row has.

    A missing text gives a null key. A key covers a field's name, its value's kind and its text, each with its length; the joint key covers
    those of all fields present, so with one field present it is the key of that field. In a variant column each value has a kind of its own.
    """
    texts = {c: text_value(c) for c in text_columns}
    kinds = {c: F.schema_of_variant(c) if isinstance(df.schema[c].dataType, T.VariantType) else kind_of(c) for c in text_columns}
    part = lambda c: F.when(texts[c].isNotNull(), F.concat(spelt(F.lit(c), F.lit("s")), spelt(texts[c], kinds[c])))
    joint = F.concat_ws("", *[part(c) for c in text_columns])
    options = [F.struct(F.lit(c).alias("slot"), F.sha2(part(c), 256).alias("input_key"), F.char_length(texts[c]).alias("chars")) for c in text_columns]
    some = F.coalesce(*[texts[c] for c in text_columns]).isNotNull()
    sizes = sum((F.coalesce(F.char_length(texts[c]), F.lit(0)) for c in text_columns[1:]), F.coalesce(F.char_length(texts[text_columns[0]]), F.lit(0)))
    options.append(F.struct(F.lit("joint").alias("slot"), F.when(some, F.sha2(joint, 256)).alias("input_key"), F.when(some, sizes).alias("chars")))
    return df.select(F.col(id_column).alias("row_id"), F.explode(F.array(*options)).alias("s")).select("row_id", "s.slot", "s.input_key", "s.chars")


def reuse_profile(df: DataFrame, id_column: str, text_columns: list[str]) -> DataFrame:
    """A row for each slot: rows, nonempty, unique_inputs, repeated_rows, groups_over_one, largest_group, saved_pct."""
    by_key = slots(df, id_column, text_columns).groupBy("slot", "input_key").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("input_key").isNotNull()
    nonempty = F.sum(F.when(known, F.col("n")).otherwise(0))
    unique = F.count_if(known)
    return by_key.groupBy("slot").agg(
        F.sum("n").alias("rows"),
        nonempty.alias("nonempty"),
        unique.alias("unique_inputs"),
        (nonempty - unique).alias("repeated_rows"),
        F.count_if(known & (F.col("n") > 1)).alias("groups_over_one"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("largest_group"),
        F.round(100 * (nonempty - unique) / F.nullif(nonempty, F.lit(0)), 6).alias("saved_pct"),
    )


def top_frequencies(df: DataFrame, id_column: str, text_columns: list[str], n: int) -> DataFrame:
    """The n most frequent inputs of each slot: slot, place, input_key, rows; ties by key."""
    counted = slots(df, id_column, text_columns).where("input_key is not null").groupBy("slot", "input_key").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("rows"), "input_key"))
    return counted.withColumn("place", place).where(F.col("place") <= n)


def dictionary(df: DataFrame, id_column: str, text_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(unique inputs, row links): inputs by the number of their first appearance, links with a null number for empty slots.

    The numbers are those of an order by first row (a number) and slot; the sort is over distinct inputs only.
    """
    order = {c: i for i, c in enumerate([*text_columns, "joint"])}
    links = slots(df, id_column, text_columns)
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("slot")]
    first = links.where("input_key is not null").groupBy("input_key").agg(F.min(F.struct("row_id", place.alias("slot_no"))).alias("first"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("links"))
    first = written_once(first.withColumn("row", F.col("first.row_id")))
    numbered = ordered.numbered(first, [], ordered.bucket_of("row", ordered.edges(first, "row")), [F.col("first")], "at")
    unique = numbered.select((F.col("at") - 1).alias("input_no"), "input_key", "chars", "links")
    return unique, links.join(unique.select("input_key", "input_no"), "input_key", "left").select("row_id", "slot", "input_no")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two tables has and the other hasn't, with side left or right; empty if they are equal."""
    columns = left.columns
    right = right.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def conflicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both tables have with unlike other columns (nulls equal nulls)."""
    values = [c for c in old.columns if c not in keys]
    unlike = ~F.struct(*[F.col(f"old.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in values]))
    same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    return old.alias("old").join(new.alias("new"), same).where(unlike).select(*[F.col(f"old.{k}") for k in keys])


def lossless_union(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks; an error if a common key has unlike values."""
    if not conflicts(old, new, keys).isEmpty():
        raise ValueError(f"the tables disagree on a common key ({', '.join(keys)})")
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both; new's row where it has one."""
    return new.select(*old.columns).unionByName(old.join(new, keys, "left_anti").select(*old.columns))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself, or an error naming a repeated key; a cheap aggregation before a join that must not multiply rows."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"repeated key {tuple(repeated[0][k] for k in keys)} in ({', '.join(keys)})")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must have each key once; null keys match null keys."""
    assert_unique(right, keys)
    renamed = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    same: Column | None = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__{k}"])
        same = one if same is None else same & one
    return left.join(renamed, same, how).drop(*[f"__{k}" for k in keys])
