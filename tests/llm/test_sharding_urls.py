from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from lexitab.llm import queries, sharding, url_filter
from tests.oracle import assert_same, connect


def brute_shard(key: str, weights: list[float]) -> int:
    best = None
    for i, w in enumerate(weights):
        if w > 0:
            u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if best is None or -w / math.log(u) > best[0]:
                best = (-w / math.log(u), i)
    return best[1]


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op5_rendezvous_shards(spark, small).collect()
    assert len(out) == len(texts) and gapless(out)
    for r in out:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == brute_shard(str(r["doc_id"]), [1.0] * 24)
        assert r["grown_shard"] in (r["shard"], 24) and r["grown_shard"] == brute_shard(str(r["doc_id"]), [1.0] * 25)


def brute_slots(rows: list[tuple[int | None, str | None]], weights: list[float]) -> list[tuple]:
    """(id, checksum, shard, slot) of each row, by sorting each shard whole."""
    shards = defaultdict(list)
    for doc, text in rows:
        key, raw = "null" if doc is None else str(doc), None if text is None else text.encode()
        size, crc = len(raw or b"") + 8, None if raw is None else zlib.crc32(raw)
        order = hashlib.md5(":".join([key, *([] if crc is None else [str(crc)]), str(size)]).encode()).hexdigest()
        shards[brute_shard(key, weights)].append((order, doc is not None, doc or 0, crc is not None, crc or 0, size, doc, crc))
    return [(*r[-2:], shard, slot) for shard, members in shards.items() for slot, r in enumerate(sorted(members, key=lambda r: r[:6]))]


def test_slots_equal_brute_force_for_any_partitions(spark, small, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", 5)  # several buckets a shard, and repeated rows in stretches
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in documents.collect()] + [(7, "again")] * 37 + [(None, None)] * 3 + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(brute_slots(rows, [1.0] * 3), key=key)
    for parts in (2, 7):
        out = sharding.shard_records(df.repartition(parts), weights=[1.0] * 3).collect()
        assert sorted(((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in out), key=key) == want


def test_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    counts = {r["shard"]: r["count"] for r in sharding.shard_records(df, weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and abs(counts[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError, match="weights"):
        sharding.shard_records(df, weights=[0.0])


def test_hot_rows_and_edges(spark):
    rows = [(1, "same", 1)] * 300 + [(None, None, 2), (2, "", 3), (3, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(7)
    out = sharding.shard_records(df, weights=[1.0] * 3).collect()
    assert len(out) == len(rows) and gapless(out) and len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    assert [(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 3] == [(8, None)]
    assert [(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 2] == [(8, 0)]
    assert sharding.shard_records(df.limit(0), weights=[1.0]).count() == 0


def test_pages_equal_sql(spark, small):
    assert_same(queries.op6_url_filter(spark, small), connect(small), queries.ORACLE_SQL["op6_url_filter"])


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://Example.ORG/en/12?x=/es/", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://sub.example.org/es/", "sub.example.org", "/es/", "example.org/es/", "block"),
        ("http://example.org/es", "example.org", "/es", "org/", "allow"),
        ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        ("http://org", "org", "", None, "allow"),
        ("x://a.com/de/#f", "a.com", "/de/", "com/de/", "block"),
        ("a://b://c.com/de/", "b:", "//c.com/de/", None, "allow"),
        ("http://" + "a." * 3000 + "com/fr/" + "x" * 9000, "a." * 3000 + "com", "/fr/" + "x" * 9000, "com/fr/", "allow"),
        ("http://İ.com/\n/de/", "İ.com", "/\n/de/", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, start string")
    assert tuple(url_filter.judge_urls(df, queries.RULES).first()) == (1, host, path, rule, verdict)


def test_longest_rule_wins(spark):
    rules = [("allow", "a.b", "/x"), ("block", "b", "/x/y"), ("block", "a.b", "/q"), ("allow", "b", "/q/r")]
    df = spark.createDataFrame([(1, "u://a.b/x/y"), (2, "u://a.b/q/r"), (2, "u://a.b/q/r"), (3, "u://b/x")], "page_id long, url string")
    out = sorted((r["page_id"], r["rule"]) for r in url_filter.judge_urls(df, rules).collect())
    # host + path of equal length: the longer host
    assert out == [(1, "a.b/x"), (2, "a.b/q"), (2, "a.b/q"), (3, None)]
    assert url_filter.judge_urls(df, []).where("verdict = 'allow'").count() == 4
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
