from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitab.llm import mixing, queries, substring_dedup


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_gear_hash_is_the_rolling_one():
    raw = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    value, want = 0, []
    for b in raw:
        value = ((value << 2) + int(substring_dedup._GEAR[b])) & 0xFFFFFFFF
        want.append(value)
    assert substring_dedup.gear_hashes(raw).tolist() == want


def test_chunks_cover_the_text_and_resist_insertions():
    rnd = random.Random(2)
    text = words(rnd, 3000)
    digest, span = substring_dedup.chunks(text.encode())
    starts, sizes = (span >> 8).tolist(), (span & 0xFF).tolist()
    assert starts[0] == 0 and starts[1:] == np.cumsum(sizes)[:-1].tolist() and sum(sizes) == 3000 and max(sizes) <= substring_dedup.LONGEST
    moved = set(substring_dedup.chunks(("inserted here " + text[:5000] + " and there " + text[5000:]).encode())[0].tolist())
    assert len(set(digest.tolist()) - moved) <= 8


def repeated_words(texts: dict[int, str | None], least: int) -> tuple[dict[int, list], dict[int, list[bool]]]:
    """Each text's words as byte ranges, and whether a word lies in a window of least words that a text of a smaller id has."""
    spans, marks, first = {}, {}, {}
    for doc in sorted(texts):
        raw = (texts[doc] or "").encode()
        spans[doc] = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        said = [raw[a:b] for a, b in spans[doc]]
        marks[doc] = [False] * len(said)
        for i in range(len(said) - least + 1):
            if first.setdefault(tuple(said[i : i + least]), doc) != doc:
                marks[doc][i : i + least] = [True] * least
    return spans, marks


def test_documents_equal_brute_force(spark):
    """Of the words in repeated passages nearly all are cut, and clean documents stay."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    spans, marks = repeated_words(texts, substring_dedup.MIN_WORDS)
    repeated = caught = clean = left = 0
    for r in queries.op10_substring_dedup(spark, sf_dir).collect():
        doc, raw = r["doc_id"], (texts[r["doc_id"]] or "").encode()
        cut = [any(s["start"] <= a and b <= s["end"] for s in r["cut_spans"]) for a, b in spans[doc]]
        ends = [0, *[s["end"] for s in r["cut_spans"]]]
        rest = b"".join(raw[a:b] for a, b in zip(ends, [*[s["start"] for s in r["cut_spans"]], len(raw)]))
        assert sum(cut) == r["cut_words"] and rest.decode() == (r["text"] or "")
        repeated += sum(marks[doc])
        caught += sum(a and b for a, b in zip(cut, marks[doc]))
        clean += not any(marks[doc])
        left += not any(marks[doc]) and not any(cut)
    assert repeated > 10_000 and caught >= 0.99 * repeated and clean > 500 and left >= 0.99 * clean


def test_long_white_space_and_words(spark):
    """Repeats are cut exactly whatever lies between their words: megabytes of spaces, words of a megabyte."""
    rnd = random.Random(5)
    passage = words(rnd, 60) + " " * 17_000_000 + words(rnd, 60)
    giant = (b"a" * 1_000_000 + b" ").decode() * 40
    rows = [(1, "one two " + passage), (2, "three four " + passage + " five"), (3, "six " + giant + words(rnd, 80)), (4, "seven")]
    rows.append((5, rows[2][1].replace("six", "eight")))
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[4] == "seven"
    assert out[2] == "three four five" and out[5] == "eight "


def test_equal_rows_are_counted_once(spark):
    """A row repeated many times has one span of each chunk in its group."""
    rnd = random.Random(6)
    passage = words(rnd, 200)
    rows = [(1, passage)] + [(2, "x " + passage + " y")] * 3000
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "text").count().collect()
    assert sorted((r["doc_id"], r["text"], r["count"]) for r in out) == [(1, passage, 1), (2, "x y", 3000)]


def test_planted_passages_go_and_clean_documents_stay(spark):
    rnd = random.Random(3)
    rows, planted = [], []
    for k in range(30):
        passage = words(rnd, rnd.randrange(51, 90))
        group = []
        for _ in range(rnd.randrange(2, 6)):
            group.append(len(rows))
            rows.append((len(rows), words(rnd, rnd.randrange(0, 200)) + "\n" + passage + rnd.choice([" ", "\n", "\n\n"]) + words(rnd, rnd.randrange(0, 200))))
        planted.append((passage, group))
    clean = [(10_000 + k, words(rnd, 300)) for k in range(30)]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, spans_column="cut_spans", words_column="cut_words").collect()}
    before = dict(rows + clean)
    for passage, group in planted:
        assert out[group[0]]["text"] == before[group[0]]
        for doc in group[1:]:
            assert passage not in out[doc]["text"] and 50 <= out[doc]["cut_words"] <= len(passage.split()) + 1
    assert all(out[doc]["text"] == text and out[doc]["cut_words"] == 0 and out[doc]["cut_spans"] == [] for doc, text in clean)


def test_substring_edges(spark):
    rnd = random.Random(4)
    text = words(rnd, 100)
    loop = words(rnd, 60) + " "
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (None, text, "c"), (None, text + " more", "d"), (3, None, "e"), (4, "", "f"), (5, "short one", "g"), (6, "short one", "h"), (7, loop * 5, "i"), (8, "x" * 3_000_000 + " " + text, "j"), (9, "the " * 5000, "k"), (10, "é " + text + " ü", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` string").withColumn("__cuts", F.lit(1))
    out = substring_dedup.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "key", "__cuts"] and out.count() == len(rows)
    got = {r["key"]: r["text"] for r in out.collect()}
    assert got["a"] == text and got["b"] == "" and got["c"] == "" and len(got["d"]) < len(text) / 2
    assert got["e"] is None and got["f"] == "" and got["g"] == got["h"] == "short one" and got["i"] == loop * 5 and got["k"] == "the " * 5000
    assert got["j"].startswith("x" * 3_000_000) and len(got["j"]) < 3_000_000 + len(text) / 2
    assert got["l"].startswith("é ") and len(got["l"]) < len(text) / 2
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.3, 0.3], 3000)
    tokens = rng.integers(1, 500, 3000)
    df = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "n_tokens long, posterior array<double>")
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}):
        fit = mixing.fit_rates(df, ["a", "b", "c"], weights)
        rates = np.array([r[0] for r in df.select(fit.rate(F.col("posterior"))).collect()])
        share = np.array([weights[k] for k in "abc"]) / sum(weights.values())
        assert (rates >= 0).all() and np.abs((rates * tokens) @ p - share * tokens.sum()).max() < 1e-5 * tokens.sum()
    grown = mixing.fit_rates(df, ["a", "b", "c"], {"a": 1, "b": 1, "c": 1}, keep=["a", "b"])
    assert (grown.targets[:2] >= (tokens[:, None] * p).sum(axis=0)[:2] - 1e-6).all()
    with pytest.raises(ValueError, match="weights"):
        mixing.fit_rates(df, ["a", "b", "c"], {})


def test_unreachable_targets_equal_a_plain_solver(spark):
    rng = np.random.default_rng(7)
    p = 0.5 * rng.dirichlet([1, 1, 1], 400) + 0.5 / 3  # no document is of one domain
    tokens = rng.integers(1, 50, 400).astype(float)
    df = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "n_tokens long, posterior array<double>")
    fit = mixing.fit_rates(df, ["a", "b", "c"], {"a": 1.0})
    m = (tokens[:, None] * p).T @ p
    inverse = np.linalg.inv(m)
    rate = np.ones(400)
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ (inverse @ ((rate * tokens) @ p - fit.targets)))
    loss = lambda s: float((s - fit.targets) @ inverse @ (s - fit.targets))
    assert loss(fit.reached) <= loss((rate * tokens) @ p) * 1.02


def test_classifier_on_held_out_labels(spark):
    """Recall and calibration by domain on a fifth of the labels that the fit hasn't seen."""
    sf_dir = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = mixing.train_domains(documents, labels.where(~held), queries.domain_of_labels(), queries.DOMAINS)
    wanted = labels.where(held).select("doc_id", queries.domain_of_labels().alias("d")).where("d is not null")
    known = mixing.posteriors(documents.join(wanted.select("doc_id"), "doc_id", "left_semi"), model).join(wanted, "doc_id").collect()
    p, d = np.array([r["posterior"] for r in known]), np.array([queries.DOMAINS.index(r["d"]) for r in known])
    recall = [float((p[d == k].argmax(axis=1) == k).mean()) for k in range(3)]
    assert len(known) > 700 and np.allclose(p.sum(axis=1), 1)
    assert recall[0] > 0.97 and recall[1] > 0.8 and recall[2] > 0.75, recall
    assert np.abs(p.sum(axis=0) / np.bincount(d) - 1).max() < 0.2


def test_posteriors_equal_a_plain_sum(spark):
    """Posteriors from each token's weights, one by one."""
    sf_dir = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.train_domains(documents, labels, queries.domain_of_labels(), queries.DOMAINS)
    texts = {r["doc_id"]: r["text"] for r in documents.limit(60).collect()}
    place = {int(b): i for i, b in enumerate(model.kept)}
    for r in mixing.posteriors(documents.limit(60), model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        low = re.findall(rb"[0-9a-z\x80-\xff]+", raw.lower())
        seen = [zlib.crc32(w) % mixing.BUCKETS for w in low] + [zlib.crc32(w, 1) % mixing.BUCKETS for w in re.findall(rb"[!-/:-@\[-`{-~]+", raw)]
        seen += [1 for a, b in zip(low, low[1:]) if a == b]
        logits = model.bias.copy()
        for bucket in set(seen) & set(place):
            i = place[bucket]
            density = min(1.0, mixing.DENSITY * seen.count(bucket) / len(low))
            logits = logits + model.scale[i] * (model.weights[i] + density * model.weights[len(place) + i])
        want = np.exp(logits - logits.max())
        assert np.allclose(r["posterior"], want / want.sum(), atol=1e-9) and r["n_tokens"] == len(raw.split())


def test_sample_is_bounded_under_a_hot_label(spark):
    """A labelled id that 200,000 rows share is one row of the sample."""
    df = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    df = df.union(spark.createDataFrame([(8, "other words"), (9, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, "a"), (7, "b"), (8, "b"), (9, "b")], "doc_id long, d string")
    sample = mixing.labelled_sample(df, labels, F.col("d"), ["a", "b"], "doc_id", "text", 4000).collect()
    assert sorted((r["doc_id"], r["domain"]) for r in sample) == [(7, "a"), (8, "b"), (9, "b")]
    model = mixing.train_domains(df, labels, F.col("d"), ["a", "b"])
    assert len(model.kept) <= mixing.KEPT and np.isfinite(model.weights).all()


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.op1_source_mixing(spark, sf_dir).collect()
    assert len(out) == documents.count()
    total = sum(r["n_tokens"] for r in out)
    for name, weight in queries.WEIGHTS.items():
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{name}"] for r in out) / total == pytest.approx(weight, abs=1e-3)
    assert all(abs(r["copies"] - r["rate"]) <= 1 for r in out)


def test_mixing_edges(spark):
    schema = "doc_id long, text string, rate string"
    df = spark.createDataFrame([(1, "good words here", "x"), (2, "bad words there", "x"), (2, "bad words there", "x"), (3, None, "x"), (4, "", "x"), (None, "good words here", "x")], schema)
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, "a"), (3, None), (9, "a"), (1, "z")], "doc_id long, d string")
    model = mixing.train_domains(df, labels, F.col("d"), ["a", "b"])
    mixed, fit = mixing.mix(df, model, {"a": 1, "b": 1})
    rows = mixed.collect()
    assert len(rows) == 6 and sum(r["n_tokens"] for r in rows) == 12 and len({(r["p_a"], r["rate"]) for r in rows if r["doc_id"] == 2}) == 1
    taken = mixing.take(df, mixed)
    assert taken.columns == df.columns
    assert taken.where("doc_id = 1").count() == next(r["copies"] for r in rows if r["doc_id"] == 1)
    nothing = mixing.train_domains(df, labels.limit(0), F.col("d"), ["a", "b"])
    assert {(r["p_a"], r["p_b"]) for r in mixing.mix(df, nothing, {"a": 1, "b": 1})[0].collect()} == {(0.5, 0.5)}
    assert mixing.mix(df.limit(0), model, {"a": 1})[0].count() == 0 and mixing.take(df.limit(0), mixed).count() == 0
