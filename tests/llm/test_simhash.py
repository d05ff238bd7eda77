from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from lexitab.llm import simhash
from lexitab.llm._graph import connected_components


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes_of(nodes, linked) -> dict:
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_documents_equal_brute_force(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in documents.collect()}
    want = classes_of(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == {k: (f"{v:016x}", want[k]) for k, v in fps.items()}
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_crowded_cells(spark):
    """Balls of fingerprints within a few bits, where many meet in one cell."""
    rnd = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(50):
            fp = centre
            for _ in range(rnd.randrange(5)):
                fp ^= 1 << rnd.randrange(64)
            fps.add(fp - (1 << 64) if fp >> 63 else fp)
    nodes = sorted(fps)
    array = np.array(nodes, np.int64)
    linked = [(a, int(b)) for i, a in enumerate(nodes) for b in array[i + 1 :][np.bitwise_count((array[i + 1 :] ^ a).view(np.uint64)) <= 2]]
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df)).collect()}
    assert {n: found.get(n, n) for n in nodes} == classes_of(nodes, linked)


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000 + i, 999) for i in range(1, 100)] + [(5000, 1000 + i) for i in range(1, 100)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (7, 8), (8, 7)], "a long, b long").union(spark.createDataFrame([(None, 3)], "a long, b long"))
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {found[i] for i in range(201)} == {0} and found[5000] == 999 and len(found) == 201 + 101
    assert connected_components(edges.limit(0)).count() == 0


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (4, "one two three four"), (4, "one two three four"), (None, "one two three four"), (None, "alone here in the world"), (7, "word " * 200_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    out = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    assert sorted(c for i, f, c in out if i in (3, 5, 9)) == [3, 3, 3] and all(f == "0" * 16 for i, f, c in out if i in (3, 5, 9))
    named = [c for i, f, c in out if f == f"{brute_fingerprint('one two three four'):016x}"]
    assert named == [4, 4, 4]
    assert [c for i, f, c in out if i is None and c is None] == [None]
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 4, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_similar_texts_meet_in_grids_of_their_fingerprints():
    """Sets of similarity 0.8 share a cell of some grid and are linked there; the first word is the plain SimHash of the distinct shingles."""
    rng = np.random.default_rng(5)
    unions = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in rng.integers(20, 200, 300)]
    parts = [(u[rng.permutation(len(u))], len(u) // 10) for u in unions]
    left, right = ([np.sort(u[k:] if side else u[: len(u) - k]) for u, k in parts] for side in (0, 1))
    assert all(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for a, b in zip(left, right))
    for found in (left[0], left[1][:7], left[2][:1]):
        bits = [2 * sum(int(h) >> i & 1 for h in found) + (int(found[0]) >> i & 1) > len(found) for i in range(64)]
        assert int(simhash.long_fingerprint(found)[0]) == sum(1 << i for i in range(64) if bits[i])
    prints = np.array([simhash.long_fingerprint(s) for s in left + right])
    laid, n = simhash.grids(100_000), len(left)
    cells = simhash.grid_cells(prints, laid)
    assert sum((cells[i] == cells[n + i]).any() for i in range(n)) >= 0.99 * n and (cells[0] == cells[1]).sum() <= 3
    words = [int(w) for w in prints[3, simhash.COMPARED :]]
    counts = [(w >> 2 * i & 3).bit_count() for w in words for i in range(32)]
    assert all(cells[3, j] == sum(counts[s] * 3**k for k, s in enumerate(segments.tolist())) for j, segments in enumerate(laid))
    words = [prints[:, w] for w in range(simhash.COMPARED)]
    met = simhash.meetings(np.zeros(2 * n, np.int64), np.arange(2 * n), words).to_pylist()
    assert {(r["lead"], r["key"], r["n"]) for r in met} == {(i, k, 2) for i in range(n) for k in (i, n + i)} and len({r["band"] for r in met}) == n


def test_large_cells_are_compared_whole(monkeypatch):
    """A cell over AT_ONCE gives the same components as one below."""
    rng = np.random.default_rng(6)
    mixed = rng.permutation(900)
    words = [np.concatenate([rng.integers(0, 1 << 64, 300, dtype=np.uint64), *[rng.integers(0, 1 << 64, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(2)]])[mixed] for _ in range(simhash.COMPARED)]
    whole = simhash.near_roots(words)
    monkeypatch.setattr(simhash, "AT_ONCE", 10)
    assert (simhash.near_roots(words) == whole).all() and len(set(whole.tolist())) == 302


def rows_made(spark, node: str, since: int) -> int:
    """Rows out of the plan nodes of a name in all executions from the number since on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for at in range(since, store.executionsCount()):
        run = store.executionsList(at, 1).head().executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size()) if nodes.apply(i).name() == node):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_near_copies_that_do_not_link_move_once_for_each_block(spark):
    """Copies of one text, most of which are just less alike than 0.8: exact classes, and few rows for each copy however many grids they meet in."""
    rnd = random.Random(11)
    base, n = [f"w{k}" for k in range(300)], 600
    texts = []
    for k in range(n):
        words = list(base)
        for at in rnd.sample(range(5, 295), rnd.choice([2, 4, 5, 6, 7, 7])):
            words[at] = f"new{k}_{at}"
        texts.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(296)} for w in texts]
    want = classes_of(range(n), [(a, b) for b in range(n) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    kept = simhash.keep_one(df, shingle=5, similarity=0.8)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and 50 < len(set(want.values())) < n - 50
    assert 0 < rows_made(spark, "Generate", since) <= 6 * n


def test_blocks_of_a_cluster_join_what_all_its_pairs_join(spark, monkeypatch):
    """Clusters in one block and in many, with classes that exist already and sizes far apart."""
    rng = np.random.default_rng(12)
    sets, clusters = [], []
    for c in range(3):
        base = rng.integers(-(1 << 62), 1 << 62, 100)
        for k in range((5, 60, 150)[c]):
            own = rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 30))
            sets.append(np.unique(np.concatenate([base[: rng.choice([40, 95, 100])], own])))
            clusters.append(c)
    roots = [k - k % 2 if clusters[k - k % 2] == clusters[k] and k % 10 < 4 else k for k in range(len(sets))]
    given = [(r, k) for k, r in enumerate(roots) if r != k]
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if clusters[a] == clusters[b] and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    want = classes_of(range(len(sets)), given + alike)
    members = spark.createDataFrame([(c, k, roots[k], len(s), s.tolist()) for k, (c, s) in enumerate(zip(clusters, sets))], "cluster long, key long, root long, size long, shingles array<long>")
    for small in (False, True):
        if small:
            monkeypatch.setattr(simhash, "SETS", 10)
            monkeypatch.setattr(simhash, "BLOCK_BYTES", 20_000)
        links = [(r["a"], r["b"]) for r in simhash.cluster_links(members, 0.8).collect()]
        assert classes_of(range(len(sets)), given + links) == want
    assert len(set(want.values())) > 20
    assert simhash.cluster_links(members.limit(0), 0.8).count() == 0


def test_tiny_sets_have_a_wider_radius():
    """Sets of 4 and 5 shingles, of similarity 0.8, are linked by all bits of their fingerprints; so are larger pairs, whichever hashes they lack."""
    rng = np.random.default_rng(13)
    unions = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in [5] * 600 + [10] * 300 + [15] * 300 + [25] * 300 + [400] * 100]
    pairs = [(np.sort(rng.permutation(u)[: len(u) * 4 // 5]), u) for u in unions]
    near = 0
    for a, b in pairs:
        prints = np.array([simhash.long_fingerprint(a), simhash.long_fingerprint(b)])
        reach = np.where(np.array([len(a), len(b)]) <= simhash.TINY, simhash.TINY_FAR, simhash.FAR)
        near += simhash.near_roots(list(prints.T), reach)[1] == 0
    assert near == len(pairs)
    opposite = [np.array([0, (1 << 64) - 1], np.uint64) for _ in range(4)]  # 256 bits apart
    assert simhash.near_roots(opposite).tolist() == [0, 1]
