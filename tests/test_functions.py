"""Expressions on hand-computed cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lexitab.functions import json_values as J
from lexitab.functions import text as T
from lexitab.functions import vectors as V


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", list: "array<double>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize(("value", "kept"), [("same ", "same "), ("   ", None), (" \t", None), (None, None), ("", None), ("0", "0")])
def test_text_value(spark, value, kept):
    assert one(spark, T.text_value("t"), t=value) == kept


@pytest.mark.parametrize(("value", "kept"), [(1.5, 1.5), (math.nan, None), (math.inf, None), (-math.inf, None)])
def test_finite(spark, value, kept):
    assert one(spark, T.finite("x"), x=value) == kept


def test_lengths(spark):
    assert one(spark, T.word_count("t"), t=" a  b c\n") == 3
    assert one(spark, T.approx_tokens("t"), t="abcde") == 2
    assert one(spark, F.char_length("t"), t="\U0001f600e") == 2
    assert one(spark, T.preview("t", 2), t="abcdef") == "abcdef"
    assert one(spark, T.preview("t", 2), t="abcdefgh") == "ab ... de ... gh"


def test_digest_keeps_parts_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("abc", None), (None, "abc")], "x string, y string")
    assert df.select(T.digest("x", "y")).distinct().count() == 4


def test_digest_keeps_kinds_apart(spark):
    row = spark.range(1).select(T.digest(F.lit(1)).alias("i"), T.digest(F.lit(1).cast("long")).alias("l"), T.digest(F.lit("1")).alias("s"), T.digest(F.lit(1.0)).alias("d"), T.digest(F.lit(True)).alias("b"), T.digest(F.lit("true")).alias("t")).first()
    assert row["i"] == row["l"] and len({row["i"], row["s"], row["d"], row["b"], row["t"]}) == 5


def test_canonical_json(spark):
    cells = ['{"b":1,"a":[1.5,{"d":null,"c":"\\u00e9\\n"}]}', "[NaN]", "[1e999]", "{", None, '"x"', "[true,false]"]
    want = ['{"a":[1.5,{"c":"é\\n","d":null}],"b":1}', None, None, None, None, '"x"', "[true,false]"]
    df = spark.createDataFrame(list(enumerate(cells)), "i long, c string").repartition(3)
    assert [r[0] for r in df.select("i", J.canonical_json("c").alias("c")).orderBy("i").select("c").collect()] == want


def test_largest_change(spark):
    df = spark.createDataFrame([('{"a":1,"b":[2,3]}', '{"b":[2,5],"a":0.5}'), ('{"a":1}', '{"b":1}'), ("{}", "{}"), ("{", "{}")], "x string, y string")
    maps = df.select(J.json_numbers("x").alias("x"), J.json_numbers("y").alias("y"))
    assert [r[0] for r in maps.select(J.largest_change(F.col("x"), F.col("y"))).collect()] == [2.0, None, None, None]


def test_epoch_seconds(spark):
    assert one(spark, T.epoch_seconds("t"), t="2020-01-01") == 1577836800
    assert one(spark, T.epoch_seconds("t"), t="no date") is None


def test_lenient_number(spark):
    assert one(spark, T.lenient_number("t"), t=" $1,234.5 ") == 1234.5
    assert one(spark, T.lenient_number("t"), t="12a") is None


@pytest.mark.parametrize(("p", "answer"), [([0.7, 0.3], 0), ([0.5, 0.5], V.TIED), ([0.2, 0.8], 1), ([math.nan, 0.1], V.UNAVAILABLE), ([0.5, 0.5, 0.0], V.TIED)])
def test_top_answer(spark, p, answer):
    assert one(spark, V.top_answer("p"), p=p) == answer


def test_distances(spark):
    p, q = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]
    assert one(spark, V.js_divergence("p", "q"), p=p, q=q) == pytest.approx(1)
    assert one(spark, V.js_divergence("p", "q"), p=p, q=p) == pytest.approx(0)
    assert one(spark, V.total_variation("p", "q"), p=p, q=q) == pytest.approx(1)
    assert one(spark, V.earth_movers("p", "q"), p=p, q=q) == pytest.approx(2)
    assert one(spark, V.entropy("p"), p=[0.25] * 4) == pytest.approx(1)
    assert one(spark, V.entropy("p"), p=p) == pytest.approx(0)
    assert one(spark, V.expected_level("p"), p=[0.0] * 8 + [1.0]) == pytest.approx(4)
    assert one(spark, V.level_variance("p", -1), p=[0.5, 0.0, 0.5]) == pytest.approx(1)


def test_simplex(spark):
    assert one(spark, V.is_simplex("p"), p=[0.2, 0.8])
    for bad in ([0.2, 0.6], [math.nan, 1.0], [1.2, -0.2]):
        assert not one(spark, V.is_simplex("p"), p=bad)
    moved = one(spark, V.bounded_projection("p", 0.005), p=[0.33, 0.33, 0.33])
    assert sum(moved) == pytest.approx(1) and max(abs(x - 0.33) for x in moved) <= 0.005 + 1e-12


@pytest.mark.parametrize(("x", "name"), [(0.0, "b_0"), (0.5, "b_1"), (0.69, "b_1"), (0.9, "b_3")])
def test_band(spark, x, name):
    assert one(spark, V.band("x", (0.5, 0.7, 0.9), "b"), x=x) == name


@pytest.mark.parametrize(("x", "place"), [(0.0, 0), (0.1, 1), (1.0, 9), (1.5, 9), (-1.0, 0)])
def test_equal_width_bin(spark, x, place):
    assert one(spark, V.equal_width_bin("x", 0.0, 1.0, 10), x=x) == place


def test_projection_works_its_vector_out_once(spark):
    """The vector and each round's sum come once in the plan, whatever the number of rounds; null elements count 0, a null vector gives null."""
    df = spark.createDataFrame([(1, [0.33, 0.33, 0.33]), (2, [0.5, None, 0.5]), (3, None), (4, [0.1, 0.1])], "i int, p array<double>")
    out = df.select("i", V.bounded_projection(F.transform("p", lambda x: F.round(x, 2)), 0.005).alias("q"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("round(") == 1 and plan.count(" < ") + plan.count("< cast(1") <= 2
    found = {r["i"]: r["q"] for r in out.collect()}
    assert found[1] == pytest.approx([1 / 3] * 3) and found[2] == pytest.approx([0.5, 0.0, 0.5]) and found[3] is None and found[4] == pytest.approx([0.105] * 2)
