"""Substring de-duplication by content-defined chunking with a gear rolling hash.

Texts are read as words with one space between them. A chunk starts at a word whose gear hash of the bytes before it is
the largest among the REACH words on either side, so boundaries depend on nearby bytes only and an insertion moves one or two
of them. A chunk that an earlier document has already is a duplicate, and neighbouring duplicates join into runs. At both ends a
run is widened word by word as far as the earlier document says the same; what has min_words words then is cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import arrow_column, cut_columnar, fresh, hold, release, ship, utf8_parts

REACH = 4
#: A chunk ends after so many words where nothing else ends it, as in one word repeated.
LONGEST = 24
#: Each byte shifts the hash by two bits: it covers the last 16 bytes.
_SHIFT, _WINDOW = 2, 16
#: Passages of fewer words stay: phrases, notices and sentences recur by chance or for good reason.
MIN_WORDS = 50
#: Runs of duplicate chunks of so many words are widened and measured; a passage of MIN_WORDS has one, but for rare words.
SEED_WORDS = 8
#: Words that a run may be widened by on either side: more than a chunk has.
CONTEXT = 64
_WORD_BYTES = 1 << 20
_GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: span = number of the first word << 8 | words
_FIRST = 8


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte, the rolling hash of it and the 15 before, built up in four doublings."""
    out = _GEAR[raw]
    width = 1
    while width < _WINDOW:
        grown = out.copy()
        grown[width:] += out[:-width] << np.uint32(_SHIFT * width)
        out = grown
        width *= 2
    return out


def word_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of words; a word longer than _WORD_BYTES counts as several, cut between characters."""
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(raw) > _WORD_BYTES:
        more = np.arange(0, len(raw), _WORD_BYTES)
        for _ in range(3):
            inside = (raw[more] & 0xC0) == 0x80
            more = np.minimum(more + inside, len(raw) - 1)
        gap = np.searchsorted(starts, more, "right")
        far = (gap > 0) & (more - starts[np.maximum(gap - 1, 0)] >= _WORD_BYTES)
        starts = np.union1d(starts, more[far & ~space[more]])
    return starts


def words_of(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with one space between words, and the words' first bytes in it and in raw."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = word_starts(data)
    space = _SPACE[data]
    kept = ~space
    kept[1:] |= ~space[:-1]
    plain = np.where(space, np.uint8(32), data)[kept]
    return plain.tobytes(), (np.cumsum(kept) - 1)[starts], starts


def chunk_words(hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words that start a chunk, from each word's hash of what stands before it."""
    n = len(hashes)
    padded = np.concatenate([np.zeros(REACH, np.uint32), hashes, np.zeros(REACH, np.uint32)])
    top = np.ones(n, bool)
    for step in range(1, REACH + 1):
        top &= hashes > padded[REACH - step : REACH - step + n]
        top &= hashes >= padded[REACH + step : REACH + step + n]
    top[0] = True
    cuts = np.flatnonzero(top)
    lengths = np.diff(np.append(cuts, n))
    if lengths.max() > LONGEST:
        cuts = np.concatenate([np.arange(a, a + size, LONGEST) for a, size in zip(cuts, lengths)])
    return cuts


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(digest, span) of each chunk; the chunks cover all words."""
    plain, places, _ = words_of(raw)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gear_hashes(np.frombuffer(plain, np.uint8))
    before = np.where(places > 0, hashes[np.maximum(places - 1, 0)], np.uint32(0))
    first = chunk_words(before)
    start = places[first]
    end = np.append(start[1:], len(plain))
    digest = xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(plain[a:b].rstrip(b" ")) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(first))
    return found.view(np.int64), first << _FIRST | np.diff(np.append(first, len(places)))


def runs(pieces: list[dict] | None, seed_words: int = SEED_WORDS) -> list[dict]:
    """Stretches of adjoining duplicate chunks (span, digest, first) of at least seed_words words: at, n, and the chunks at both ends."""
    out: list[dict] = []
    for piece in sorted(pieces or (), key=lambda p: p["span"]):
        at, n = piece["span"] >> _FIRST, piece["span"] & 0xFF
        if out and out[-1]["at"] + out[-1]["n"] == at:
            out[-1]["n"] += n
        else:
            out.append({"at": at, "n": n, "left": piece["digest"], "left_doc": piece["first"]})
        out[-1]["right"], out[-1]["right_doc"] = piece["digest"], piece["first"]
    return [run for run in out if run["n"] >= seed_words]


class Words:
    """The hash of each word of a text, by number."""

    def __init__(self, raw: bytes):
        self.plain, self.places, self.starts = words_of(raw)
        self.size = len(raw)

    def hash(self, i: int) -> int:
        end = self.places[i + 1] if i + 1 < len(self.places) else len(self.plain)
        return xxhash.xxh3_64_intdigest(self.plain[self.places[i] : end].rstrip(b" ")) - (1 << 63)

    def around(self, span: int) -> dict:
        """Hashes of the CONTEXT words before a chunk, the nearest first, and of those after it."""
        at, end = span >> _FIRST, (span >> _FIRST) + (span & 0xFF)
        before = [self.hash(i) for i in range(at - 1, max(-1, at - 1 - CONTEXT), -1)]
        return {"span": span, "before": before, "after": [self.hash(i) for i in range(end, min(len(self.places), end + CONTEXT))]}

    def passages(self, found: list[dict], min_words: int) -> list[tuple[int, int]]:
        """(first word, word after the last) of each widened run (at, n, before, after) of at least min_words words."""
        wide = []
        for run in found:
            low, high = run["at"], run["at"] + run["n"]
            for said in run["before"] or ():
                if not low or self.hash(low - 1) != said:
                    break
                low -= 1
            for said in run["after"] or ():
                if high >= len(self.places) or self.hash(high) != said:
                    break
                high += 1
            wide.append((low, high))
        out: list[tuple[int, int]] = []
        for low, high in sorted(wide):
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return [(low, high) for low, high in out if high - low >= min_words]

    def byte_range(self, low: int, high: int) -> tuple[int, int]:
        return int(self.starts[low]), int(self.starts[high]) if high < len(self.starts) else self.size


def without(raw: bytes, found: list[dict], min_words: int) -> dict:
    """The text without its repeated passages, their byte ranges and words; no text if there are none."""
    words = Words(raw)
    passages = words.passages(found, min_words)
    spans = [words.byte_range(low, high) for low, high in passages]
    ends = [0, *[end for _, end in spans]]
    rest = b"".join(raw[a:b] for a, b in zip(ends, [*[start for start, _ in spans], len(raw)]))
    return {"text": rest if spans else None, "spans": [{"start": a, "end": b} for a, b in spans], "words": sum(high - low for low, high in passages)}


_RUNS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("left", pa.int64()), ("left_doc", pa.int64()), ("right", pa.int64()), ("right_doc", pa.int64())]))
_AROUND = pa.list_(pa.struct([("span", pa.int64()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))]))
_CUT = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("words", pa.int64())])


def _identity(doc: Column, text: Column) -> tuple[Column, Column]:
    """(rank, key) of a row: its id, and a hash of id and text. A null id ranks after all others by another hash of its text."""
    unnamed = F.xxhash64(F.lit("rank"), text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return F.coalesce(doc.cast("long"), unnamed), F.xxhash64(doc, text)


def remove_repeats(
    df: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = MIN_WORDS,
    spans_column: str | None = None,
    words_column: str | None = None,
) -> DataFrame:
    """Every row of df, its text without the passages that a document with a smaller id has too.

    Ids are whole numbers below 2**62; rows with a null id come after all others, in the order of a hash of their text. A
    passage repeated only within one document, or in rows with the same id, stays. White space is ASCII white space; how much of it
    stands between two words doesn't matter, and what follows a cut passage goes with it. spans_column and words_column name
    columns for the cut byte ranges (array of start and end, empty if none) and the number of words cut. Null and empty texts
    stay as they are; texts under min_words words are never cut; a text that is all repeats becomes empty. Other columns, types
    and repeated rows stay. Digests are 64 bits wide; a cut takes at least min_words words in equal chunks and equal words beside
    them. What moves are 32 bytes for each chunk of about nine words, the texts that hold an original or a repeat, and twice CONTEXT
    hashes for each run. The two joins with the texts sort both sides at every size; tables and shuffle files between go once the next table is written.
    """
    spark = df.sparkSession
    ship(spark)
    doc, text = df[f"`{id_column}`"], df[f"`{text_column}`"]
    rank, key = _identity(doc, text)
    keyed = df.select(rank.alias("rank"), key.alias("key"), text.alias("text"))

    def split(batches):
        hold("substring")
        for batch in batches:
            named = set()  # repeated rows of a batch say the same
            for row, raw in zip(zip(batch.column("rank").to_pylist(), batch.column("key").to_pylist()), utf8_parts(batch.column("text"))):
                digest, span = chunks(raw or b"") if row not in named else ((), ())
                named.add(row)
                if len(span):
                    fill = [np.full(len(span), x, np.int64) for x in row]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (digest, *fill, span)], ["digest", "rank", "key", "span"])

    pieces = cut_columnar(keyed.mapInArrow(_gathered(split), "digest long, rank long, key long, span long"))
    shared = pieces.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
    common = cut_columnar(pieces.join(shared.select("digest", "first"), "digest"))
    release(pieces)
    find = arrow_column("substring", lambda found: pa.array([runs(p) for p in found.to_pylist()], _RUNS), "array<struct<at:long,n:long,left:long,left_doc:long,right:long,right_doc:long>>")
    repeats = common.where("first < rank").groupBy("rank", "key").agg(F.collect_set(F.struct("span", "digest", "first")).alias("pieces"))
    found = cut_columnar(repeats.select("rank", "key", F.explode(find("pieces")).alias("run")).select("rank", "key", "run.*"))
    # Where the chunks at the runs' ends stand in the first document that has them, and the words around them there.
    ends = found.select("left", "left_doc").union(found.select("right", "right_doc")).toDF("digest", "first").distinct()
    origin = common.where("first = rank").join(ends, ["digest", "first"]).groupBy("digest", "first").agg(F.min(F.struct("key", "span")).alias("at"))
    origin = cut_columnar(origin.select("digest", F.col("first").alias("rank"), "at.key", "at.span"))
    release(common)
    asked = cut_columnar(origin.groupBy("rank", "key").agg(F.collect_set("span").alias("asked")))
    read = arrow_column("substring", lambda raws, spans: pa.array([[w.around(s) for s in some] for w, some in ((Words(raw or b""), some) for raw, some in zip(utf8_parts(raws), spans.to_pylist()))], _AROUND), "array<struct<span:long,before:array<long>,after:array<long>>>")
    around = keyed.join(asked.hint("merge"), ["rank", "key"]).select("rank", "key", F.explode(read("text", "asked")).alias("w")).select("rank", "key", "w.*").dropDuplicates(["rank", "key", "span"])
    around = cut_columnar(origin.join(around, ["rank", "key", "span"]).select("digest", "rank", "before", "after"))
    release(origin, asked)
    wide = found.join(around.select(F.col("digest").alias("left"), F.col("rank").alias("left_doc"), "before"), ["left", "left_doc"], "left")
    wide = wide.join(around.select(F.col("digest").alias("right"), F.col("rank").alias("right_doc"), "after"), ["right", "right_doc"], "left")
    rank_name, key_name, runs_name, cut_name = fresh(df, "rank", "key", "runs", "cut")
    cuts = wide.groupBy(F.col("rank").alias(rank_name), F.col("key").alias(key_name)).agg(F.collect_list(F.struct("at", "n", "before", "after")).alias(runs_name))
    cuts = cut_columnar(cuts)
    release(found, around)
    joined = df.withColumns({rank_name: rank, key_name: key}).join(cuts.hint("merge"), [rank_name, key_name], "left")
    whole = F.when(F.col(runs_name).isNotNull(), F.col(f"`{text_column}`"))
    clean = arrow_column("substring", lambda raws, some: pa.array([None if raw is None or not r else without(raw, r, min_words) for raw, r in zip(utf8_parts(raws), some.to_pylist())], _CUT), "struct<text:string,spans:array<struct<start:int,end:int>>,words:long>")
    out = joined.withColumn(cut_name, clean(whole, F.col(runs_name)))
    cut = F.col(cut_name)
    out = out.withColumn(text_column, F.coalesce(cut["text"], F.col(f"`{text_column}`")))
    if spans_column:
        out = out.withColumn(spans_column, F.coalesce(cut["spans"], F.array().cast("array<struct<start:int,end:int>>")))
    if words_column:
        out = out.withColumn(words_column, F.coalesce(cut["words"], F.lit(0).cast("long")))
    return out.drop(rank_name, key_name, runs_name, cut_name)


def _gathered(split, rows: int = 200_000):
    """Joins the small batches of split into larger ones."""

    def run(batches):
        kept, size = [], 0
        for batch in split(batches):
            kept.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, size = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return run
