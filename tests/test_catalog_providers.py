"""Catalogs and archives, tables of several providers, and statistics against plain NumPy."""

from __future__ import annotations

import io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexitab.operators import alignment, linear, ordered, ranks, statistics, validation
from lexitab.sources import catalog
from lexitab.streaming import incremental


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    (tmp_path / "d.json").write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n')
    found = catalog.read_catalog(spark, str(tmp_path / "c.json"), "id string, n int", ["id"])
    assert [r["id"] for r in catalog.selected_entries(found, found.where("n = 1"), "id").collect()] == ["b"]
    with pytest.raises(ValueError, match="repeated key"):
        catalog.read_catalog(spark, str(tmp_path / "d.json"), "id string, n int", ["id"])
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("- {id: a, n: 1}\n- {id: b, n: 2}\n")
    assert catalog.read_catalog(spark, str(tmp_path / "c.yaml"), "id string, n int", ["id"]).count() == 2


def test_sidecar_and_roles(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"target": "y", "task_type": "binary_classification", "num_rows": 1, "num_columns": 3, "num_classes": 3}')
    with pytest.raises(ValueError, match="two classes"):
        catalog.read_sidecar(spark, str(tmp_path / "s.json"))
    (tmp_path / "t.json").write_text('{"target": "y"}')
    with pytest.raises(ValueError, match="lacks"):
        catalog.read_sidecar(spark, str(tmp_path / "t.json"))
    df = catalog.with_roles(spark.createDataFrame([(1, "t", 2.0)], "y int, t string, x double"), "y", ["t"])
    assert catalog.of_role(df, "text", "other").columns == ["t", "x"] and catalog.of_role(df, "target").columns == ["y"]
    with pytest.raises(ValueError, match="roles"):
        catalog.with_roles(df, "y", ["y"])
    with pytest.raises(ValueError, match="roles"):
        catalog.of_role(df, "input")


def test_archives_are_what_was_pinned(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("x/one.txt", "one")
        archive.writestr("two.txt", "two")
    members = catalog.archive_members(catalog.archive_files(spark, str(tmp_path / "*.zip")))
    good = members.select("member", "sha256")
    assert {r["member"]: bytes(r["content"]) for r in catalog.pinned(members, good).collect()} == {"x/one.txt": b"one", "two.txt": b"two"}
    with pytest.raises(ValueError, match="isn't the pinned file"):
        catalog.pinned(members, good.withColumn("sha256", F.lit("0")))
    with pytest.raises(ValueError, match="missing"):
        catalog.pinned(members, spark.createDataFrame([("other", "0")], "member string, sha256 string"))


def test_arrays_and_compressed_cells(spark):
    file = io.BytesIO()
    np.savez(file, a=np.arange(6).reshape(2, 3), b=np.array([0.5]))
    found = {r["name"]: r for r in catalog.npz_arrays(spark.createDataFrame([("f.npz", bytearray(file.getvalue()))], "path string, content binary")).collect()}
    assert found["a"]["shape"] == [2, 3] and found["a"]["values"] == [0, 1, 2, 3, 4, 5] and found["b"]["values"] == [0.5]
    df = spark.createDataFrame([("é" * 100, [1.5, -2.0]), (None, None)], "t string, v array<float>")
    back = df.select(catalog.inflated(catalog.deflated(F.col("t"))).alias("t"), catalog.float_vector(catalog.float_bytes(F.col("v"))).alias("v"))
    assert back.collect() == df.collect()
    with pytest.raises(ValueError, match="row texts"):
        catalog.append_events(df.withColumnRenamed("t", "text"), "unused")


def test_alignment(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(alignment.aligned(left, left.orderBy(F.desc("k")), "k", {"v": "w"}).collect()) == [(1, "a", "a"), (2, "b", "b")]
    with pytest.raises(ValueError, match="differ"):
        alignment.aligned(left, left.where("k = 1"), "k", {"v": "w"})
    with pytest.raises(ValueError, match="repeated key"):
        alignment.aligned(left, left.union(left), "k", {"v": "w"})


def test_encoded_texts_and_token_audit(spark):
    df = spark.createDataFrame([(1, "aab"), (2, ""), (3, "zz"), (4, "zz")], "k int, t string")
    encode = lambda texts: [[t.count("a"), t.count("b")] for t in texts]
    out = {r["k"]: r["vector"] for r in alignment.encoded_texts(df, "k", "t", encode).collect()}
    assert out[1] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)]) and out[2] == out[3] == [0.0, 0.0]
    (audit,) = alignment.token_audit(df, "t", [], alignment.token_counter(len), [2], [0.5]).collect()
    assert (audit["texts"], audit["distinct_texts"], audit["tokens"], audit["longest"], audit["q50"], audit["over_2"]) == (3, 2, 7, 3, 2.0, 1)


def test_reservations(spark):
    rows = [("a", 1, "send"), ("a", 2, "receive"), ("a", 3, "stop"), ("a", 4, "complete"), ("b", 2, "receive"), ("b", 1, "send"), ("b", 3, "send"), ("c", 1, "other")]
    out = incremental.reservation_states(spark.createDataFrame(rows, "k string, t int, e string"), "k", "t", "e", ["send", "receive", "complete"], ["stop"])
    assert sorted(out.collect()) == [("a", "stop", 1), ("b", "receive", 2)]


@pytest.mark.parametrize("least", [16, 1024])
def test_buckets_and_quantiles(spark, least):
    """Both ways of halving, the nested branches and the array, agree with NumPy."""
    rng = np.random.default_rng(2)
    values = rng.normal(size=4000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(4000) % 3, "v": values})).union(spark.createDataFrame([(1, None)], "k long, v double"))
    at = ordered.edges(df, "v", least)
    got = {(r["v"], r["b"]) for r in df.select("v", ordered.bucket_of("v", at).alias("b")).collect()}
    assert got == {(float(v), int(np.searchsorted(at, v, "right"))) for v in values} | {(None, 0)}
    out = ordered.exact_quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.999}, "k").collect()
    for r in out:
        assert [r["a"], r["m"], r["z"]] == pytest.approx(np.quantile(values[np.arange(4000) % 3 == r["k"]], [0.1, 0.5, 0.999]).tolist())
    assert ordered.exact_quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(values))


def test_ridge_from_sums_equals_ridge_on_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 50, 0] + [0, 300, 7]  # the last column is constant
    frame = pd.DataFrame({"i": range(400), "g": np.arange(400) % 2, "f": np.arange(400) % 5, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": x[:, 0] * 2 - x[:, 1] / 9 + rng.normal(size=400)})
    df = spark.createDataFrame(frame)
    plain = {r["i"]: r["prediction"] for r in validation.cross_validate(df, "i", ["a", "b", "c"], "y", "f", validation.RidgeProbe, ["g"]).collect()}
    sums = {r["i"]: r["prediction"] for r in validation.cross_validate_ridge(df, "i", ["a", "b", "c"], "y", "f", ["g"]).collect()}
    assert sums.keys() == plain.keys() and all(sums[i] == pytest.approx(plain[i], abs=1e-7) for i in plain)


def test_partial_correlation_and_signed_ranks(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(size=(60, 4)).round(1), columns=list("xyzw"))
    frame["g"] = 1
    df = spark.createDataFrame(frame)
    r = frame[list("xyzw")].rank().to_numpy()
    basis = np.column_stack([np.ones(60), r[:, 2:]])
    left = [v - basis @ np.linalg.lstsq(basis, v, rcond=None)[0] for v in (r[:, 0], r[:, 1])]
    (row,) = statistics.partial_spearman(df, "x", "y", ["z", "w"], ["g"]).collect()
    assert row["n"] == 60 and row["rho"] == pytest.approx(np.corrcoef(*left)[0, 1])
    assert statistics.partial_spearman(df.limit(4), "x", "y", ["z", "w"], ["g"]).first()["rho"] is None
    # With ties the normal limit with its correction.
    d = frame["x"][frame["x"] != 0].to_numpy()
    rank = pd.Series(np.abs(d)).rank().to_numpy()
    n, ties = len(d), np.unique(np.abs(d), return_counts=True)[1]
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    z = abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    (row,) = statistics.wilcoxon_signed_rank(df, "x", ["g"]).collect()
    assert (row["n"], row["w"]) == (n, w) and row["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert [tuple(r) for r in statistics.wilcoxon_signed_rank(df.withColumn("x", F.lit(0.0)), "x", ["g"]).collect()] == [(1, 0, None, None)]


def test_spearman_counts_equal_pairs(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": np.arange(900) % 3, "x": rng.integers(0, 9, 900), "y": rng.integers(0, 6, 900)})
    frame["y"] += frame["x"]
    got = {r["k"]: (r["n"], r["rho"]) for r in ranks.spearman(spark.createDataFrame(frame), "x", "y", "k").collect()}
    for k, part in frame.groupby("k"):
        assert got[k] == (300, pytest.approx(part["x"].rank().corr(part["y"].rank())))
    flat = ranks.spearman(spark.createDataFrame(frame).withColumn("x", F.lit(1)), "x", "y").first()
    assert (flat["n"], flat["rho"]) == (900, None)


def test_scaling_and_one_hot(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "z"), (5.0, None)], "x double, c string")
    train = df.where("c <> 'z'")
    out = linear.one_hot(train, linear.standardised(train, df, ["x"]), "c").collect()
    assert [r["x"] for r in out] == [-1.0, 1.0, 0.0, 3.0] and [r["c_hot"] for r in out] == [[0, 1], [1, 0], [0, 0], [0, 0]]
    with pytest.raises(ValueError, match="more than 1"):
        linear.one_hot(train, df, "c", most=1)


def test_token_audit_by_ranks_equals_the_library(spark, small):
    import base64

    import public_tokenizers
    import tiktoken

    from lexitab.plans import provider_queries

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        if r["text"] and r["text"].strip():
            counts.setdefault(r["source"], []).append(len(encoding.encode_ordinary(r["text"])))
    found = {r["source"]: r for r in provider_queries.token_audit_by_ranks(spark, small).collect()}
    assert set(found) == set(counts)
    for source, n in counts.items():
        r = found[source]
        assert (r["texts"], r["tokens"], r["longest"], r["over_512"], r["over_2048"]) == (len(n), sum(n), max(n), sum(x > 512 for x in n), sum(x > 2048 for x in n))
        assert abs(r["q95"] - np.quantile(n, 0.95)) < 1e-6
