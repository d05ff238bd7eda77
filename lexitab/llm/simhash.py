"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 32 two-bit segments have bit counts from 0 to 2. The Manhattan distance of two count vectors never
exceeds the Hamming distance of the fingerprints. Vectors at most 2 apart have a common grid cell at most 1 from both, so each
distinct fingerprint enters its own cell and the up to 64 next to it, and every pair within 2 bits meets in a cell. The
members of a cell are dealt into blocks of BLOCK, a block is compared with itself and the others, and the pairs that come near are
verified exactly. Two fingerprints drawn evenly share a cell with a chance of 0.375 ** 32, so cells stay nearly empty
up to billions of fingerprints; and at most 65 fingerprints lie within 2 bits of each other, so links stay linear in them.

Texts whose shingle sets have a Jaccard similarity of 0.8 differ in 9.7 of 64 bits on average. Within so many bits the counts of
32 segments tell nothing: two fingerprints drawn evenly are hardly further apart. With a similarity keep_one therefore takes fingerprints
of 1,024 bits and lays many grids over their segments' counts, each over a few segments drawn at random. Fingerprints that share
a cell of any grid are compared by their first 256 bits, those within RADIUS of these by all bits, and what is left is verified on the
whole shingle sets: with the first of its group, then, where that leaves a group in parts, with all others of the groups it overlaps.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitab.llm._graph import connected_components, local_roots
from lexitab.llm._support import arrow_column, cut, cut_columnar, fresh, hold, release, ship, utf8_parts

SEED = 42
DISTANCE = 2
SHINGLE = 3
_SEGMENTS, _WIDTH = 32, 2
#: Fingerprints of a cell that are compared at a time, and rows that one task expands into cells.
BLOCK, EXPANDED = 64, 20_000
_PIECE = 1 << 16
#: Words of a long fingerprint: the first four are compared, the segments of the others make the grids.
WORDS, COMPARED = 16, 4
#: A bit of two sets of Jaccard similarity 0.8 differs with this probability (cosine 8/9), so a segment's counts are equal with SAME, and
#: with CHANCE where the sets have nothing in common. More than RADIUS of the compared bits differ in about 1e-4 of such
#: pairs, more than FAR of all in less. Bits of sets of 4 and 5 differ with 0.1875 (1.5e-3 then), so sets of up to TINY have the radius TINY_FAR.
DIFFERS = math.acos(8 / 9) / math.pi
SAME, CHANCE, RADIUS, FAR, TINY, TINY_FAR = (1 - DIFFERS) ** 2 + DIFFERS**2 / 2, 0.375, 66, 216, 4, 250
#: Unlike fingerprints that one finds in its cell, the chance that a pair of similarity 0.8 meets in no grid, and grids laid at a time.
COMPANY, MISS, GRIDS = 32, 3e-4, 64
#: Rows of (cell, fingerprint) in a task, and fingerprints of a cell that are compared with each other at once.
MET, AT_ONCE = 700_000, 1024
#: Sets of a group that are compared at a time, and shingles that are counted at a time.
SETS, COLUMNS = 128, 4096
#: Bytes of shingles of a block of sets. A block has SETS sets, and of a cluster of m, over SETS ** 2 / WIDER ** 2, WIDER * sqrt(m).
BLOCK_BYTES, WIDER = 4 << 20, 2.75
_FLIPS, _FACTORS = np.random.default_rng(20_240_301).integers(0, 1 << 64, (2, WORDS - 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)
_TIES = np.unpackbits(_FLIPS.view(np.uint8), bitorder="little")


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of UTF-8 text: A-Z lower-cased, words between ASCII white space, word shingles."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, _PIECE):
        part = np.fromiter(hashes, "<u8", min(_PIECE, n - low))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> pa.Array:
    return pa.array([fingerprint(raw, shingle) for raw in utf8_parts(texts)], pa.int64())


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a long."""
    return arrow_column("simhash", lambda texts: fingerprints(texts, shingle), "long")(text)


def bit_counts(fps: np.ndarray) -> np.ndarray:
    """The bit count of each two-bit segment of unsigned fingerprints, in the place of that segment."""
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + (fps >> np.uint64(1) & odd)


def near_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, cell) for the cells at Manhattan distance 0 or 1 from each fingerprint's count vector."""
    counts = bit_counts(fps)
    owners, cells = [np.arange(len(fps))], [counts]
    for i in range(_SEGMENTS):
        one = np.uint64(1) << np.uint64(_WIDTH * i)
        here = counts >> np.uint64(_WIDTH * i) & np.uint64(3)
        for inside, moved in ((here < _WIDTH, counts + one), (here > 0, counts - one)):  # no step leaves the grid
            some = np.flatnonzero(inside)
            owners.append(some)
            cells.append(moved[some])
    return np.concatenate(owners), np.concatenate(cells)


def near_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """The links (a, b), a > b, of all pairs of distinct fingerprints within DISTANCE bits of each other."""
    found = distinct.select(F.col(fp).alias("fp"))
    found = found.repartition(max(1, found.sparkSession.sparkContext.defaultParallelism, found.count() // EXPANDED), "fp")

    def expand(batches):
        hold("simhash")
        for batch in batches:
            fps = np.array(batch.column("fp"), np.int64)
            owners, cells = near_cells(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fps[owners]), pa.array(cells.view(np.int64))], ["fp", "cell"])

    cells = found.mapInArrow(expand, "fp long, cell long")
    same = W.partitionBy("cell")
    placed = cells.select("*", F.row_number().over(same.orderBy("fp")).alias("at"), F.lead("fp").over(same.orderBy("fp")).alias("next")).where("at > 1 or next is not null")
    placed = placed.withColumn("n", F.max("at").over(same)).withColumn("block", F.floor((F.col("at") - 1) / F.lit(BLOCK)).cast("int"))
    last = F.floor((F.col("n") - 1) / F.lit(BLOCK)).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), last), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    groups = placed.select("cell", "fp", F.explode(tasks).alias("t")).groupBy("cell", "t").agg(F.collect_list("fp").alias("near"))
    near = F.expr(f"flatten(transform(near, x -> transform(filter(near, y -> y < x and bit_count(x ^ y) <= {DISTANCE}), y -> struct(x as a, y as b))))")
    return groups.select(F.explode(near).alias("link")).select("link.*").distinct()


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component_id, keeper, keeper_fp) for each distinct fingerprint of rows (doc_id, fp).

    component_id is the smallest id of the class, null if all its ids are null; keeper and keeper_fp name its first row.
    """
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(near_links(distinct))
    roots = found.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    own = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    release(distinct, found)
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("best")
    heads = own.groupBy("root").agg(best)
    return own.join(heads, "root").select("fp", F.col("best.first").alias("component_id"), F.col("best.first").alias("keeper"), F.col("best.fp").alias("keeper_fp"))


def near_duplicates(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. Ids may repeat: equal ids
    with unlike texts can be in unlike classes. A null id never names a class that has other ids. Other columns are
    ignored; an empty table gives an empty one. Copies share one fingerprint, which is what is compared.
    """
    ship(df.sparkSession)
    marked = cut_columnar(df.select(F.col(id_column).alias("doc_id"), fingerprint_of(F.col(text_column)).alias("fp")))
    found = classes(marked).select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(raw: bytes | None, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes, in order, of a text's word shingles; words are those of fingerprint()."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, max(1, len(words) - shingle + 1)))


def long_fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of WORDS words of a set of 64-bit hashes in order; the first word is of the hashes themselves, and its ties go to the first hash's bit.

    Ties of the others go to fixed bits, as a set and one without its first hash would differ in half of their ties.
    """
    ones = np.zeros(64 * WORDS, np.int64)
    for low in range(0, len(found), _PIECE // 2):
        part = found[low : low + _PIECE // 2, None]
        mixed = (part ^ _FLIPS) * _FACTORS
        mixed = (mixed ^ mixed >> np.uint64(32)) * _FACTORS
        bits = np.unpackbits(np.hstack([part, mixed ^ mixed >> np.uint64(29)]).view(np.uint8), axis=1, bitorder="little")
        if not low:
            first = np.concatenate([bits[0, :64], _TIES])
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones + first > len(found), bitorder="little").view(np.uint64)


def grids(n: int) -> list[np.ndarray]:
    """The segments of each grid over n long fingerprints: as many as leave COMPANY to a cell, in as many grids as leave MISS."""
    depth = max(4, int(math.log(max(1, n / COMPANY)) / -math.log(CHANCE)))
    rng = np.random.default_rng(20_240_301)
    return [rng.choice((WORDS - COMPARED) * _SEGMENTS, depth, replace=False) for _ in range(math.ceil(math.log(MISS) / math.log1p(-(SAME**depth))))]


def grid_cells(prints: np.ndarray, laid: list[np.ndarray]) -> np.ndarray:
    """The cell of each long fingerprint (a row) in each grid (a column): the bit counts of the grid's segments as digits."""
    packed = bit_counts(prints[:, COMPARED:]).view(np.uint8)
    counts = np.stack([packed >> np.uint8(_WIDTH * i) & np.uint8(3) for i in range(8 // _WIDTH)], axis=2).reshape(len(prints), -1)
    digits = np.zeros((counts.shape[1], len(laid)))
    for i, segments in enumerate(laid):
        digits[segments, i] = 3.0 ** np.arange(len(segments))
    return (counts.astype(float) @ digits).astype(np.int64)


def near_roots(fps: list[np.ndarray], radius: int | np.ndarray = RADIUS) -> np.ndarray:
    """The first fingerprint in each one's component, by links within radius bits; fps has an array for each word.

    With an array of radii, the larger of a pair's two counts.
    """
    n = len(fps[0])
    radius = np.broadcast_to(np.asarray(radius, np.uint16), n)
    within = lambda left, right: np.maximum(radius[left][:, None], radius[right])
    near = lambda left, right: sum((np.bitwise_count(f[left][:, None] ^ f[right]) for f in fps), np.uint16(0)) <= within(left, right)
    if n <= AT_ONCE:
        return local_roots(n, *np.nonzero(np.triu(near(slice(None), slice(None)), 1)))
    # Those that a component has taken are not looked at again, so large groups of near copies take few rounds.
    roots, rest = np.arange(n), np.arange(n)
    while len(rest):
        first, fringe, rest = rest[0], [rest[:1]], rest[1:]
        while fringe and len(rest):
            own = fringe.pop()
            for low in range(0, len(own), SETS):
                if len(rest):
                    some = own[low : low + SETS]
                    taken = np.concatenate([near(some, rest[i : i + _PIECE]).any(axis=0) for i in range(0, len(rest), _PIECE)])
                    if taken.any():
                        roots[rest[taken]] = first
                        fringe.append(rest[taken])
                        rest = rest[~taken]
    return roots


def meetings(cells: np.ndarray, keys: np.ndarray, fps: list[np.ndarray], radius: int | np.ndarray = RADIUS) -> pa.RecordBatch:
    """(band, key, lead, n) for rows in components of two or more within a cell: the component, its smallest key and its size.

    band is a sum over the component's keys, so components that several grids find alike have one name.
    """
    order = np.lexsort((keys, cells))
    cells, keys, fps = cells[order], keys[order], [f[order] for f in fps]
    radius = np.broadcast_to(radius, len(cells))[order]
    edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    roots = np.arange(len(cells))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if high - low > 1:
            roots[low:high] = near_roots([f[low:high] for f in fps], radius[low:high]) + low
    sizes = np.bincount(roots, minlength=len(roots))
    some = np.flatnonzero(sizes[roots] > 1)
    heads, at = np.unique(roots[some], return_inverse=True)
    mixed = keys[some].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    names = np.zeros(len(heads), np.uint64)
    np.add.at(names, at, mixed ^ mixed >> np.uint64(31))
    columns = names[at].view(np.int64), keys[some], keys[roots[some]], sizes[roots[some]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["band", "key", "lead", "n"])


def candidates(sets: DataFrame) -> DataFrame:
    """(band, key, lead, n): groups of keys of sets (key, prints, size) that share a cell of some grid and are linked there within RADIUS and FAR bits."""
    prints = sets.where("prints is not null").select("key", "prints")
    n = prints.count()
    laid, found = grids(n), []
    names = ["cell", "key", *[f"fp{i}" for i in range(COMPARED)]]
    for start in range(0, len(laid), GRIDS):
        some = laid[start : start + GRIDS]

        def place(batches, some=some):
            hold("shingles")
            base = np.arange(len(some)) * 3 ** len(some[0])
            for batch in batches:
                for low in range(0, batch.num_rows, 2048):
                    part = batch.slice(low, 2048)
                    longs = np.array(part.column("prints").flatten()).reshape(-1, WORDS)
                    cells = grid_cells(longs.view(np.uint64), some) + base
                    columns = cells.ravel(), *[np.repeat(c, len(some)) for c in (np.array(part.column("key")), *longs[:, :COMPARED].T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        def meet(batches):
            hold("shingles")
            batches = list(batches)
            if batches:
                cells, keys, *fps = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in names)
                batches.clear()
                yield meetings(cells, keys, [f.view(np.uint64) for f in fps])

        parts = max(sets.sparkSession.sparkContext.defaultParallelism, n * len(some) // MET)
        placed = prints.mapInArrow(place, ", ".join(f"{c} long" for c in names)).repartition(parts, "cell")
        found.append(cut_columnar(placed.mapInArrow(meet, "band long, key long, lead long, n long")))
    grouped = cut_columnar(reduce(DataFrame.union, found).dropDuplicates(["band", "key"]).select("band", "key"))
    release(*found)

    def sharpen(batches):
        hold("shingles")
        batches = list(batches)
        if batches:
            bands, keys, sizes = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("band", "key", "size"))
            longs = np.concatenate([np.array(b.column("prints").flatten()).reshape(-1, WORDS) for b in batches]).view(np.uint64)
            batches.clear()
            yield meetings(bands, keys, list(longs.T), np.where(sizes <= TINY, TINY_FAR, FAR))

    parts = max(sets.sparkSession.sparkContext.defaultParallelism, grouped.count() * 4 // MET)
    whole = grouped.join(sets.select("key", "prints", "size"), "key").repartition(parts, "band")
    sharp = cut_columnar(whole.mapInArrow(sharpen, "band long, key long, lead long, n long").dropDuplicates(["band", "key"]))
    release(grouped)
    return sharp


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of left and right sets with at least that Jaccard similarity, from exact counts of common members."""
    sizes, sides = [np.array([len(s) for s in side]) for side in (left, right)], (left, right)
    owners = [np.repeat(np.arange(len(side)), n) for side, n in zip(sides, sizes)]
    members = [np.concatenate([np.zeros(0, np.int64), *side]) for side in sides]
    # Only what both sides have can be common.
    both = np.intersect1d(members[0], members[1])
    places = [np.searchsorted(both, m) for m in members]
    known = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == m) if len(both) else np.zeros(len(m), bool) for p, m in zip(places, members)]
    places, owners = [p[k] for p, k in zip(places, known)], [o[k] for o, k in zip(owners, known)]
    orders = [np.argsort(p, kind="stable") for p in places]
    places, owners = [p[o] for p, o in zip(places, orders)], [o[i] for o, i in zip(owners, orders)]
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), COLUMNS):
        halves = []
        for p, o, side in zip(places, owners, sides):
            a, b = np.searchsorted(p, [low, low + COLUMNS])
            half = np.zeros((len(side), min(COLUMNS, len(both) - low)), np.float32)
            half[o[a:b], p[a:b] - low] = 1
            halves.append(half)
        common += halves[0] @ halves[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return np.nonzero((common >= similarity * union) & (common > 0))


def join_alike(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """roots (a row of each set's class) after joining the classes of all pairs of a left and a right row that are alike.

    SETS times SETS are compared at a time, in order of size; blocks that are of one class, or too unlike in size, are passed over.
    """
    sizes = np.array([len(s) for s in sets])
    same = left is right
    left, right = (side[np.argsort(sizes[side], kind="stable")] for side in (left, right))
    for i in range(0, len(left), SETS):
        for j in range(i if same else 0, len(right), SETS):
            rows, others = left[i : i + SETS], right[j : j + SETS]
            if similarity * sizes[others[0]] >= sizes[rows[-1]] + 1:
                break
            if similarity * sizes[rows[0]] >= sizes[others[-1]] + 1 or (np.concatenate([roots[rows], roots[others]]) == roots[rows[0]]).all():
                continue
            a, b = alike([sets[k] for k in rows], [sets[k] for k in others], similarity)
            a, b = roots[rows[a]], roots[others[b]]
            if (a != b).any():
                roots = local_roots(len(roots), a, b)[roots]
    return roots


def cluster_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes (root) of keys of members (cluster, key, root, size, shingles), from all pairs within each cluster.

    A cluster's keys are dealt into blocks, and each pair of blocks is a task. The blocks grow with the square root of the cluster until
    they have BLOCK_BYTES, so a cluster of m keys moves them sqrt(m) / WIDER times, not once for every SETS of m.
    """
    count = F.count("*")
    fewest = F.least(count / F.lit(SETS), F.sqrt(count) / F.lit(WIDER))
    blocks = F.ceil(F.greatest(fewest, 8 * F.sum("size") / F.lit(BLOCK_BYTES))).cast("int")
    dealt = members.join(members.groupBy("cluster").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "cluster")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.select("cluster", "key", "root", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cluster", "key", "root", "shingles", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        hold("shingles")
        own = np.array(group.column("own"))
        i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
        shingles = group.column("shingles").combine_chunks()
        ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        _, first, at = np.unique(np.array(group.column("root")), return_index=True, return_inverse=True)
        roots = join_alike([values[a:b] for a, b in zip(ends[:-1], ends[1:])], first[at], left, right, similarity)
        keys = np.array(group.column("key"))
        some = first[roots[first] != first]
        return pa.table({"a": keys[roots[some]], "b": keys[some]})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def similar_links(df: DataFrame, sets: DataFrame, row: list[Column], text: Column, shingle: int, similarity: float) -> DataFrame:
    """Verified links (a, b) between keys of sets (key, rep, prints, size), whose shingles are read again from the row rep of df.

    Each member of a group of candidates is compared with the group's first. Groups that these links leave in parts are put together where
    they share a key, as the same texts meet in many grids, and within such a cluster all pairs of unlike parts are compared.
    """
    grouped = candidates(sets)
    pairs = grouped.where("key <> lead").select("lead", "key").distinct()
    wanted = cut_columnar(grouped.select("key").distinct().join(sets.select("key", "size", "rep.*"), "key"))
    read = arrow_column("shingles", lambda texts: pa.array([shingle_set(raw, shingle).view(np.int64) for raw in utf8_parts(texts)], pa.list_(pa.int64())), "array<long>")
    found = df.select(row[0].alias("x"), row[1].alias("y"), text.alias("text")).join(wanted, ["x", "y"]).dropDuplicates(["x", "y"])
    found = cut_columnar(found.select("key", "size", read(F.col("text")).alias("shingles")))
    release(wanted)
    sides = [found.select(F.col("key").alias(key), F.col("shingles").alias(side)) for key, side in (("lead", "left"), ("key", "right"))]
    both = pairs.join(sides[0], "lead").join(sides[1], "key")
    common = F.size(F.array_intersect("left", "right"))
    close = cut_columnar(both.where(common >= similarity * (F.size("left") + F.size("right") - common)).select("lead", "key"))
    joined = connected_components(close, "lead", "key").toDF("key", "root")
    rooted = grouped.where("n > 2").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    parted = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    clusters = connected_components(grouped.join(parted, "band", "left_semi"), "lead", "key").toDF("key", "cluster")
    members = clusters.join(found, "key").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    links = cut_columnar(close.toDF("a", "b").union(cluster_links(members, similarity)).distinct())
    release(grouped, found, close, joined, clusters)
    return links


def keep_similar(df: DataFrame, id_column: str, text_column: str, shingle: int, similarity: float) -> DataFrame:
    """keep_one() by Jaccard similarity."""
    text, doc = df[f"`{text_column}`"], df[f"`{id_column}`"]
    row = [F.xxhash64(doc, text), F.xxhash64(F.lit("row"), doc, text)]  # of 128 bits together

    def mark(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(raw, shingle) for raw in utf8_parts(texts)]
        return pa.array([{"key": xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), "prints": long_fingerprint(s).view(np.int64) if len(s) else None, "size": len(s)} for s in sets], pa.struct([("key", pa.int64()), ("prints", pa.list_(pa.int64())), ("size", pa.int64())]))

    marked = df.select(doc.alias("doc_id"), F.struct(row[0].alias("x"), row[1].alias("y")).alias("row"), arrow_column("shingles", mark, "key long, prints array<long>, size long")(text).alias("s"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    sets = cut_columnar(marked.groupBy("s.key").agg(best, F.min("row").alias("rep"), F.first("s.prints").alias("prints"), F.first("s.size").alias("size")))
    links = similar_links(df, sets, row, text, shingle, similarity)
    components = connected_components(links)
    roots = components.select(F.col("node").alias("key"), F.col("component").alias("root"))
    release(links)
    own = sets.select("key", "best").join(roots, "key", "left")
    names = fresh(df, "x", "y")
    kept = own.groupBy(F.coalesce("root", "key")).agg(F.min("best").alias("best")).select(F.col("best.row.x").alias(names[0]), F.col("best.row.y").alias(names[1]))
    kept = cut_columnar(kept)
    release(sets, components)
    rows = df.withColumns(dict(zip(names, row))).join(kept, names, "left_semi")
    return rows.dropDuplicates(names).drop(*names)


def keep_one(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of df without near-duplicates: the row with the smallest id of each class stays, once if it is repeated.

    Classes join fingerprints of word shingles within DISTANCE bits; with a similarity (0.8 or more, as the grids are made for), texts
    whose sets of word shingles have at least that Jaccard similarity. Then texts without words form one class. Rows of a
    null id come after all others. Other columns stay as they are; an empty table gives an empty one.
    """
    ship(df.sparkSession)
    if similarity is not None:
        return keep_similar(df, id_column, text_column, shingle, similarity)
    fp, keeper, keeper_fp = fresh(df, "fp", "keeper", "keeper_fp")
    text, doc = df[f"`{text_column}`"], df[f"`{id_column}`"]
    marked = cut_columnar(df.select(doc.alias("doc_id"), fingerprint_of(text, shingle).alias("fp")))
    kept = classes(marked).select(F.col("keeper").alias(keeper), F.col("keeper_fp").alias(keeper_fp)).distinct()
    rows = df.withColumn(fp, fingerprint_of(text, shingle))
    same = rows[f"`{id_column}`"].eqNullSafe(kept[keeper]) & (rows[fp] == kept[keeper_fp])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_column, fp]).drop(fp)
