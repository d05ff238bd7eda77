"""Scans, exports and stores that grow by batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.sources import tables as S
from lexitab.streaming.incremental import event_windows, keyset_pages
from lexitab.streaming.store import ImmutableStore


def test_csv_with_sidecar_counts(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('a,b\n1,"x, ""y""\nz"\n2,\n')
    df = S.scan_csv(spark, str(path), rows=2, columns=2)
    assert S.with_row_ids(df).orderBy("row_id").collect()[0]["b"] == 'x, "y"\nz'
    with pytest.raises(ValueError, match="rows"):
        S.scan_csv(spark, str(path), rows=3)


def test_accounting_lines(spark):
    lines = ["1|a|COMPLETED|cpu=8,gres/gpu=2|run --x | tee", "2|b|RUNNING||", "3|c|CANCELLED by 5|cpu=1|z", "short|line"]
    df = S.scan_accounting(spark.createDataFrame([(x,) for x in lines], "value string"), ["id", "name", "state", "tres", "line"])
    out = {r["id"]: r for r in df.withColumn("cpus", S.tres("tres", "cpu")).collect()}
    assert set(out) == {"1", "3"} and out["1"]["line"] == "run --x | tee" and out["1"]["cpus"] == 8 and out["3"]["state"] == "CANCELLED"


def test_flatten_numbers(spark):
    """Any depth, lists, and key columns named like what the operator works with."""
    deep = '{"a":' * 60 + "1" + "}" * 60
    cells = {
        1: ('{"a":{"b":{"c":{"d":{"e":5}}}},"s":"12","l":[1,2],"x":1.5,"t":true,"n":null}', {"a.b.c.d.e": 5.0, "l[0]": 1.0, "l[1]": 2.0, "x": 1.5}),
        2: ("[[1, [2]], {}, []]", {"[0][0]": 1.0, "[0][1][0]": 2.0}),
        3: ("7", {"": 7.0}),
        4: ('{"a.b": 1, "a": {"b": 2}}', {"a.b": 2.0}),
        5: (deep, {".".join(["a"] * 60): 1.0}),
        6: ("not json", {}),
        7: (None, {}),
        8: ('{"big": 1e400, "whole": 123456789012345678901234567890}', {"big": float("inf"), "whole": 1.2345678901234568e29}),
    }
    df = spark.createDataFrame([(i, i, i, i, c) for i, (c, _) in cells.items()], "k long, v long, m long, path long, j string")
    found = {i: {} for i in cells}
    for r in S.flatten_numbers(df, ["k", "v", "m", "path"], "j").collect():
        found[r["k"]][r["metric"]] = r["value"]
    assert found == {i: want for i, (_, want) in cells.items()}


def test_accounting_drops_what_is_no_number(spark):
    lines = ["1|a|COMPLETED|60|cpu=1|x", "2|a|COMPLETED|x|cpu=1|x", "3|a|COMPLETED||cpu=1|x", "4|a|FAILED|-5|cpu=1|x", "5|a|FAILED|99999999999999999999|cpu=1|x"]
    df = S.scan_accounting(spark.createDataFrame([(x,) for x in lines], "value string"), ["id", "stage", "state", "seconds", "tres", "line"])
    assert [(r["id"], r["s"]) for r in df.withColumn("s", F.col("seconds").cast("long")).collect()] == [("1", 60)]


def test_export_round_trip(spark, tmp_path):
    target = str(tmp_path / "export")
    assert S.read_export(spark, target, schema="v1")[0] == "awaiting_export"
    df = spark.createDataFrame([(1, [0.5], None), (2, None, "x")], "id long, p array<double>, t string")
    S.write_export(spark, target, {"t": df}, schema="v1", identity={"study": 1})
    status, found = S.read_export(spark, target, schema="v1")
    assert status == "ok" and found["t"].exceptAll(df).count() == 0
    assert S.read_export(spark, target, schema="v2")[0] == "superseded_schema"
    assert S.content_checksum(df) == S.content_checksum(df.orderBy(F.desc("id")).repartition(3)) != S.content_checksum(df.limit(1))


def test_store_is_immutable_and_replays(spark, tmp_path):
    schema = T.StructType().add("k", "long").add("v", "string")
    store = ImmutableStore(spark, str(tmp_path / "store"), schema, ["k"])
    store.put(spark.createDataFrame([(1, "a"), (1, "a")], schema))
    store.put(spark.createDataFrame([(1, "a"), (2, None)], schema))
    assert store.read().count() == 2
    with pytest.raises(ValueError, match="two values"):
        store.put(spark.createDataFrame([(2, "z")], schema))
    assert [r["k"] for r in store.pending(spark.createDataFrame([(2, ""), (3, "")], schema)).collect()] == [3]


def test_stream_into_store(spark, tmp_path):
    schema = T.StructType().add("k", "long").add("v", "string")
    spark.createDataFrame([(i, str(i)) for i in range(20)], schema).write.parquet(str(tmp_path / "in"))
    store = ImmutableStore(spark, str(tmp_path / "store"), schema, ["k"])
    for run in range(2):
        store.put_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / f"checkpoint{run}")).awaitTermination(60)
    assert store.read().count() == 20


def test_keyset_pages(spark):
    seen = []
    df = spark.createDataFrame([(i,) for i in range(10)], "k long").repartition(3)
    assert keyset_pages(df, "k", 4, lambda page: seen.append(sorted(r["k"] for r in page.collect())), after=1) == 9
    assert seen == [[2, 3, 4, 5], [6, 7, 8, 9]]


def test_windows_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", lateness="60 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windows")) == key(event_windows(events, "1 day"))


def test_resources_as_rows(spark):
    S.register_accounting(spark, "resources_of", ["id", "seconds", "tres", "line"])
    lines = ["1|3600|cpu=4,mem=8G,gres/gpu=2|run --x | tee", "2|x|cpu=1|z", "3|60||z", "4|60|cpu=,=3,node=a|z", "short|1", ""]
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    found = spark.sql("SELECT * FROM resources_of(TABLE({lines}))", lines=df)
    assert found.columns == ["id", "seconds", "line", "resource", "amount", "hours"]
    assert sorted((r["id"], r["resource"], r["amount"], r["hours"], r["line"]) for r in found.collect()) == [("1", "cpu", 4, 4.0, "run --x | tee"), ("1", "gres/gpu", 2, 2.0, "run --x | tee"), ("1", "mem", 8, 8.0, "run --x | tee")]
