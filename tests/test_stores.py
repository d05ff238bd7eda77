"""The store under concurrent writers and growth, and reservations as a stream, as a batch and as a plain loop."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import types as T

from lexitab.plans import source_queries
from lexitab.session import shared_folder
from lexitab.sources.tables import write_export
from lexitab.streaming import reservations as R
from lexitab.streaming.store import ImmutableStore

SCHEMA = T.StructType().add("k", "long").add("v", "string")


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    """Four threads put overlapping batches; two more put unlike values for one key, of which one must fail."""
    path, failed = f"file:{tmp_path}/s", []

    def put(rows):
        try:
            ImmutableStore(spark, path, SCHEMA, ["k"]).put(spark.createDataFrame(rows, SCHEMA))
        except ValueError as refused:
            failed.append(str(refused))

    batches = [[(k, f"v{k}") for k in range(10 * i, 10 * i + 15)] for i in range(4)] + [[(1000, "one")], [(1000, "two")]]
    threads = [threading.Thread(target=put, args=(rows,)) for rows in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = sorted((r["k"], r["v"]) for r in ImmutableStore(spark, path, SCHEMA, ["k"]).read().collect())
    assert found[:-1] == [(k, f"v{k}") for k in range(45)] and found[-1][0] == 1000
    assert len(failed) == 1 and "two values" in failed[0]


def test_a_taken_version_is_not_overwritten(spark, tmp_path):
    store = ImmutableStore(spark, f"file:{tmp_path}/s", SCHEMA, ["k"])
    store.put(spark.createDataFrame([(1, "a")], SCHEMA))
    now = store.manifest()
    assert not store._commit({**now, "rows": 99}) and store.manifest() == now and store.versions() == [1]
    store.put(spark.createDataFrame([(2, "b")], SCHEMA))
    assert store.read(1).count() == 1 and store.read().count() == 2


def test_buckets_grow_and_batches_read_only_theirs(spark, tmp_path):
    store = ImmutableStore(spark, f"file:{tmp_path}/s", SCHEMA, ["k"], bucket_rows=10)
    for low in (0, 200, 400):
        store.put(spark.createDataFrame([(k, str(k)) for k in range(low, low + 200)], SCHEMA))
    now = store.manifest()
    assert now["buckets"] == 64 and now["rows"] == 600 and store.read().count() == 600
    touched = store._rows(now, [3, 5]).inputFiles()
    assert touched and {p.split("__bucket=")[1].split("/")[0] for p in touched} == {"3", "5"}
    with pytest.raises(ValueError, match="two values"):
        store.put(spark.createDataFrame([(599, "other")], SCHEMA))
    assert store.put(spark.createDataFrame([(5, "5")], SCHEMA)) and store.manifest() == now


def test_folds_resume(spark, tmp_path):
    path, made = f"file:{tmp_path}/s", []

    def compute(fold):
        if fold == "c" and "c" not in made:
            made.append(fold)
            raise RuntimeError("interrupted")
        made.append(fold)
        return spark.createDataFrame([(ord(fold), fold)], SCHEMA)

    with pytest.raises(RuntimeError):
        ImmutableStore(spark, path, SCHEMA, ["k"]).run_folds("abcd", compute)
    assert ImmutableStore(spark, path, SCHEMA, ["k"]).run_folds("abcd", compute) == ["c", "d"]
    store = ImmutableStore(spark, path, SCHEMA, ["k"])
    assert made == ["a", "b", "c", "c", "d"] and store.manifest()["markers"] == dict.fromkeys("abcd", 1)
    assert store.run_folds("abcd", compute) == [] and not store.put(spark.createDataFrame([(9, "x")], SCHEMA), marker="a") and store.read().count() == 4


def test_damaged_snapshots_leave_the_store_as_it_was(spark, tmp_path):
    store = ImmutableStore(spark, f"file:{tmp_path}/s", SCHEMA, ["k"])
    store.put(spark.createDataFrame([(1, "a")], SCHEMA))
    write_export(spark, f"file:{tmp_path}/e", {"t": spark.createDataFrame([(2, "b"), (3, None)], SCHEMA)}, schema="x", identity={})
    files = sorted((tmp_path / "e").glob("*/t/*.parquet"))
    other = spark.createDataFrame([(2, "c")], SCHEMA)
    other.coalesce(1).write.parquet(f"file:{tmp_path}/other")
    kept = files[0].read_bytes()
    files[0].write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    files[0].with_name(f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="isn't what was written"):
        store.import_snapshot(f"file:{tmp_path}/e", "t", schema="x")
    assert store.versions() == [1] and store.read().count() == 1
    files[0].write_bytes(kept)
    assert store.import_snapshot(f"file:{tmp_path}/e", "t", schema="x") == "imported" and store.read().count() == 3
    assert store.restore(1) == 3 and store.read().count() == 1 and store.read(2).count() == 3


def test_queries_leave_no_folders(spark, small):
    from pathlib import Path

    folder = Path(shared_folder(spark).removeprefix("file:"), "sources")
    before = set(folder.glob("*"))
    for query in (source_queries.export_round_trip, source_queries.csv_with_sidecar, source_queries.store_feed, source_queries.record_union):
        assert query(spark, small).count() > 0
    assert set(folder.glob("*")) == before


LIMITS = R.Limits(budget=100.0, reservation=30.0, attempts=2, timeout_us=4 * 3_600_000_000)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, limits):
    """The rules of the module's docstring, account by account, with dictionaries of their own."""
    out, seen = [], set()
    for account in sorted({r[1] for r in rows}):
        status, attempts, held, since, spent = {}, {}, {}, {}, 0.0

        def note(request, at, outcome):
            out.append((account, request, at, outcome, status[request], attempts[request], held[request], spent))  # noqa: B023

        def overdue(upto):
            late = sorted((since[q] + limits.timeout_us, str(q), q) for q in status if status[q] == "sending" and since[q] + limits.timeout_us <= upto)  # noqa: B023
            for at, _, q in late:
                status[q] = "ambiguous"  # noqa: B023
                note(q, at, "timeout")

        for at, event, request, kind, cost in sorted((r[3], r[0], r[2], r[4], r[5]) for r in rows if r[1] == account):
            if (account, event) in seen or kind not in R.KINDS:
                continue
            seen.add((account, event))
            overdue(at)
            now = status.get(request, "pending")
            if kind == "reserve" and now == "pending":
                status[request] = now
                attempts.setdefault(request, 0)
                held.setdefault(request, 0.0)
                if attempts[request] >= limits.attempts:
                    note(request, at, "attempt_limit")
                elif spent + sum(held.values()) + limits.reservation > limits.budget + 1e-12:
                    note(request, at, "budget_stop")
                else:
                    status[request], held[request], since[request] = "sending", limits.reservation, at
                    attempts[request] += 1
                    note(request, at, "claimed")
            elif now == "sending" and kind in ("answer", "reject", "error"):
                if kind == "answer" and cost is not None and cost >= 0:
                    spent += cost
                    status[request], held[request] = "done", 0.0
                    note(request, at, "answered")
                elif kind == "reject":
                    status[request], held[request] = "pending", 0.0
                    note(request, at, "rejected")
                else:
                    status[request] = "ambiguous"
                    note(request, at, "unknown_cost" if kind == "answer" else "error")
            elif now == "ambiguous" and kind == "review":
                status[request], held[request] = "pending", 0.0
                note(request, at, "reviewed")
    return sorted(out)


EVENT = "id long, account long, request long, ts timestamp, kind string, cost double"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, q, START + timedelta(microseconds=at), kind, cost) for i, a, q, at, kind, cost in rows], EVENT)


def made(seed=1, n=500):
    """Rows (id, account, request, microseconds, kind, cost), some of them twice."""
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(3), rnd.randrange(4), rnd.randrange(60 * 3_600_000) * 1000 + rnd.randrange(1000), rnd.choice([*R.KINDS, "reserve", "answer", "other"]), rnd.choice([None, -1.0, 2.0, 3.5])) for i in range(n)]
    return rows + rows[::9]


def relative(rows):
    """Microseconds since 1970 as those since START."""
    zero = int(START.timestamp()) * 1_000_000
    return sorted((r["account"], r["request"], r["at"] - zero, r["outcome"], r["status"], r["attempts"], r["reserved"], r["spent"]) for r in rows)


def test_batch_equals_plain_rules(spark):
    rows = made()
    found = relative(R.ledger(frame(spark, rows).repartition(7), LIMITS).collect())
    assert found == plain(rows, LIMITS)
    assert {r[3] for r in found} == {"claimed", "answered", "rejected", "error", "unknown_cost", "timeout", "reviewed", "attempt_limit", "budget_stop"}


def test_query_equals_plain_rules(spark, small):
    zero = int(START.timestamp()) * 1_000_000
    rows = [(r["id"], r["account"], r["request"], int((r["ts"].replace(tzinfo=timezone.utc) - START) / timedelta(microseconds=1)), r["kind"], r["cost"]) for r in source_queries.request_events(spark, small).collect()]
    want = [(a, q, at + zero, outcome, status, n, held, round(spent, 6)) for a, q, at, outcome, status, n, held, spent in plain(rows, source_queries.RESERVATIONS)]
    assert sorted(map(tuple, source_queries.reservation_ledger(spark, small).collect())) == sorted(want) and len({w[3] for w in want}) >= 7


def test_stream_equals_batch_with_late_and_repeated_events(spark, tmp_path):
    """Files in another order than time, within the lateness; repeated ids; one event far too late; a restart in between."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(made(5, 240), key=lambda r: r[3])
    end = max(r[3] for r in rows) + 10 * 24 * 3_600_000_000
    close = [(10_000 + a, a, 99, end, "other", None) for a in range(3)] + [(20_000 + a, a, 99, end, "answer", 1.0) for a in range(3)]
    # A step of time in each file, with some events of the step after it; what waits for the watermark is put in order.
    rnd, files = random.Random(3), [[] for _ in range(4)]
    for i, r in enumerate(rows):
        at = min(3, i * 4 // len(rows))
        files[min(3, at + (rnd.random() < 0.2))].append(r)
    lateness = f"{max(r[3] for f in files for r in f) // 1_000_000} seconds"
    source = tmp_path / "in"

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"file:{source}")
        query = R.ledger_stream(stream, LIMITS, lateness).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        query.awaitTermination(240)
        if query.exception():
            raise query.exception()

    for some in files[:2]:
        frame(spark, some).coalesce(1).write.mode("append").parquet(f"file:{source}")
    run()
    for some in [*files[2:], close]:
        frame(spark, some).coalesce(1).write.mode("append").parquet(f"file:{source}")
    run()
    frame(spark, [(50_000, 0, 0, 5, "reserve", None), (50_001, 0, 7, end + 10**12, "other", None), (50_002, 0, 7, end + 10**12, "reject", None)]).coalesce(1).write.mode("append").parquet(f"file:{source}")
    run()
    found = relative(spark.read.parquet(str(tmp_path / "out")).collect())
    batch = relative(R.ledger(frame(spark, rows), LIMITS, int(START.timestamp()) * 1_000_000 + end).collect())
    assert found == batch and len(found) > 40
    last = {(r["account"], r["request"]): r["status"] for r in R.final_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert "sending" not in last.values()
