"""Alignment of two tokenizers over the same bytes, with packed bitsets of token ends.

All texts of a batch are laid end to end. Bit p of a bitset says that a token ends after byte p. The AND of both bitsets has the cuts
that the tokenizers share: they bound the groups. Popcounts added up over 64-bit words give a cut's rank, which is the number of
tokens before it, and so each group's range of tokens on both sides. The OR has all cuts: a stretch between two of them lies in exactly one
token of each side, and no two stretches in the same pair, so the stretches are the links.

A batch is a block: its documents name their pairs by place in the block's own sorted list of linked id pairs. So the corpus-wide counts
move one row for each pair of a block, not for each pair of a document. The list is dealt over the rows of the block's documents, no more of
it to each than the document has pairs: a row stays as small as its document, and no reader or writer has to hold whole blocks as rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.llm._encoder import byte_letters, encoder, vocabulary_path
from lexitab.llm._support import cut_columnar, hold, release, ship

#: Bits of an id in a packed pair, and so the largest vocabulary.
_ID_BITS = 20
_FACTS = ["n_a", "n_b", "n_groups", "n_links"]
#: Letters of texts that are aligned at once. A block is a batch, but what aligning needs meanwhile is many times its text.
_PIECE = 1 << 18
#: Bytes of a row group of the written blocks. Spark's reader takes up to 4,096 rows of a group at once, its writer holds a group.
_GROUP_BYTES = 16 << 20


class Bitset:
    """Marked byte places, 64 to a word, with popcounts added up for ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of_places(cls, places: np.ndarray, size: int) -> Bitset:
        marks = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def __or__(self, other: Bitset) -> Bitset:
        return Bitset(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks are before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.upto[word] + np.bitwise_count(below)

    def select(self) -> np.ndarray:
        """The marked places, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Vocabulary:
    """A tokenizer's ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = own.encode
            self.pieces = [bytes([int(own.id_to_piece(i)[3:-1], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
        else:
            known = encoder(path, True)
            own = known.own
            # The library's tokenizer of this kind adds no space itself, the other one does.
            self.encode = lambda text: np.frombuffer(known.encode(" " + text), known.dtype).tolist()
            byte_of = byte_letters()
            named = {i: piece for piece, i in own.get_vocab(with_added_tokens=True).items()}
            spell = lambda piece: bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
            self.pieces = [spell(named[i]) if i in named else b"" for i in range(max(named) + 1)]
        if len(self.pieces) > 1 << _ID_BITS:
            raise ValueError(f"vocabularies of up to {1 << _ID_BITS} ids")
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.said = {end: np.array([f"{i}{end}" for i in range(len(self.pieces))], object) for end in ",|;"}

    def spelt(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@cache
def vocabulary(name: str) -> Vocabulary:
    """A worker's vocabulary."""
    return Vocabulary(vocabulary_path(name))


def _forget() -> None:
    vocabulary.cache_clear()
    encoder.cache_clear()


class Aligned:
    """The shared cuts, groups and links of texts laid end to end. Texts without tokens on both sides have none.

    tokens, groups and links hold, for each text and side, how many come before it (one more at the end); a_of and b_of have each link's
    tokens, a_upto and b_upto the tokens before each group's end, ends and cuts the byte places of groups and links.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary, texts: list[str | None]):
        ids, counts, sizes = ([], []), np.zeros((2, len(texts) + 1), np.int64), np.zeros(len(texts) + 1, np.int64)
        for n, text in enumerate(texts, 1):
            if text:
                one, two, raw = a.encode(text), b.encode(text), b" " + text.encode()
                if a.spelt(one) == raw == b.spelt(two):
                    ids[0].append(np.array(one, np.int32))
                    ids[1].append(np.array(two, np.int32))
                    counts[0, n], counts[1, n], sizes[n] = len(one), len(two), len(raw)
        self.a_ids, self.b_ids = (np.concatenate([np.zeros(0, np.int32), *x]) for x in ids)
        self.tokens, bounds = np.cumsum(counts, axis=1), np.cumsum(sizes)
        size = int(bounds[-1])
        a_set, b_set = (Bitset.of_places(np.cumsum(v.lengths[x]) - 1, size) for v, x in ((a, self.a_ids), (b, self.b_ids)))
        shared, either = a_set & b_set, a_set | b_set
        self.ends, self.cuts = shared.select(), either.select()
        self.a_upto, self.b_upto = a_set.rank(self.ends) + 1, b_set.rank(self.ends) + 1
        # A link's tokens are the first on each side that don't end before the link's stretch does.
        self.a_of, self.b_of = a_set.rank(self.cuts), b_set.rank(self.cuts)
        last = np.maximum(bounds - 1, 0)
        self.groups, self.links = (np.where(bounds > 0, s.rank(last) + 1, 0) if size else np.zeros(len(bounds), np.int64) for s in (shared, either))
        self.bounds = bounds

    def group_texts(self, a: Vocabulary, b: Vocabulary) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text: decimal ids by group."""
        out = np.empty(len(self.a_ids) + len(self.b_ids), object)
        a_from, b_from = np.concatenate([[0], self.a_upto]), np.concatenate([[0], self.b_upto])
        a_at = np.arange(len(self.a_ids)) + np.repeat(b_from[:-1], np.diff(a_from))
        b_at = np.arange(len(self.b_ids)) + np.repeat(a_from[1:], np.diff(b_from))
        out[a_at], out[b_at] = a.said[","][self.a_ids], b.said[","][self.b_ids]
        a_last, b_last = self.a_upto - 1, self.b_upto - 1
        out[a_at[a_last]], out[b_at[b_last]] = a.said["|"][self.a_ids[a_last]], b.said[";"][self.b_ids[b_last]]
        ends = self.tokens.sum(axis=0).tolist()
        return ["".join(out[low:high])[:-1] for low, high in zip(ends, ends[1:])]


def _pieces(texts: list[str | None]) -> list[tuple[int, int]]:
    """(first, after the last) of runs of texts that are aligned at once."""
    ends, size = [0], 0
    for n, text in enumerate(texts, 1):
        size += 1 + len(text or "")
        if size >= _PIECE or n == len(texts):
            ends.append(n)
            size = 0
    return list(zip(ends, ends[1:]))


def _piece(a: Vocabulary, b: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(facts, digests, number of pairs) of each text; (pair, times) of each text's pairs, ascending."""
    found = Aligned(a, b, texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(found.links))
    pair = found.a_ids[found.a_of].astype(np.int64) << _ID_BITS | found.b_ids[found.b_of]
    both, times = np.unique(doc << 2 * _ID_BITS | pair, return_counts=True)
    said = [hashlib.sha256(t.encode("ascii")).hexdigest() if t else "" for t in found.group_texts(a, b)]
    facts = np.stack([*np.diff(found.tokens, axis=1), np.diff(found.groups), np.diff(found.links)])
    return facts, said, np.bincount(both >> 2 * _ID_BITS, minlength=len(texts)), both & (1 << 2 * _ID_BITS) - 1, times.astype(np.int32)


def _block(a: Vocabulary, b: Vocabulary, ids: pa.Array, texts: list[str | None], number: int) -> pa.RecordBatch:
    """A row for each document of a block."""
    facts, said, pairs, pair, times = zip(*[_piece(a, b, texts[low:high]) for low, high in _pieces(texts)])
    facts = np.concatenate(facts, axis=1)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(pairs))])
    keys, local, holders = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
    of_keys = ends * len(keys) // max(1, ends[-1])
    lists = {"keys": (of_keys, keys), "holders": (of_keys, holders.astype(np.int32)), "local": (ends, local.astype(np.int32)), "times": (ends, np.concatenate(times))}
    columns = {"block": pa.array(np.full(len(texts), number)), "doc_id": ids} | dict(zip(_FACTS, map(pa.array, facts)))
    columns |= {name: pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values)) for name, (upto, values) in lists.items()}
    return pa.RecordBatch.from_pydict(columns | {"groups_sha256": pa.array([x for own in said for x in own], pa.string())})


def blocks_of(df: DataFrame, a: str, b: str, id_column: str, text_column: str) -> DataFrame:
    """A row for each row of df: its block (a batch of df), id and facts; keys, its share of the block's sorted pairs, with how many of the
    block's documents hold them (holders); its own pairs by place in the block's (local) and how often it has each (times)."""
    picked = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hold("alignment", _forget)
        one, two = vocabulary(a), vocabulary(b)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            if batch.num_rows:
                texts = batch.column("text").to_pylist()
                rows = _block(one, two, batch.column("doc_id"), texts, first + number)
                yield from (rows.slice(low, high - low) for low, high in _pieces(texts))

    lists = "keys array<long>, holders array<int>, local array<int>, times array<int>"
    return picked.mapInArrow(run, f"block long, doc_id {kind}, " + ", ".join(f"{n} long" for n in _FACTS) + f", {lists}, groups_sha256 string")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(key, count, best): in how many documents each id pair is linked, and whether no pair of its first id has a higher count."""
    pairs = blocks.select(F.explode(F.arrays_zip("keys", "holders")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.holders").alias("count"))
    pairs = pairs.withColumn("a", F.shiftright("key", _ID_BITS))
    highest = pairs.groupBy("a").agg(F.max("count").alias("highest"))
    return pairs.join(highest, "a").select("key", "count", (F.col("count") == F.col("highest")).alias("best"))


def linked_ids(df: DataFrame, *, a: str, b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(a, b, count, best) of every pair of ids linked in some document: the table that maps one vocabulary to the other."""
    ship(df.sparkSession)
    blocks = cut_columnar(blocks_of(df, a, b, id_column, text_column).select("keys", "holders"), _GROUP_BYTES)
    mask = F.lit((1 << _ID_BITS) - 1).cast("long")
    return pair_counts(blocks).select(F.shiftright("key", _ID_BITS).alias("a"), F.col("key").bitwiseAND(mask).alias("b"), "count", "best")


def token_groups(df: DataFrame, *, a: str, b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, groups) of every row: each group's byte range of space + text, and its range of tokens on both sides."""
    ship(df.sparkSession)
    picked = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    names = ["start", "end", "a_start", "a_end", "b_start", "b_end"]

    def run(batches):
        hold("alignment", _forget)
        one, two = vocabulary(a), vocabulary(b)
        for batch in batches:
            found = Aligned(one, two, batch.column("text").to_pylist())
            ends = [found.ends + 1, found.a_upto, found.b_upto]
            of = np.repeat(np.arange(batch.num_rows), np.diff(found.groups))
            columns = []
            for upto, zero in zip(ends, (found.bounds, *found.tokens)):
                columns += [np.concatenate([[0], upto])[:-1] - zero[of], upto - zero[of]]
            groups = pa.ListArray.from_arrays(pa.array(found.groups, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), groups], ["doc_id", "groups"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, groups array<struct<{','.join(f'{n}:long' for n in names)}>>")


def align_documents(df: DataFrame, *, a: str, b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a names a byte-level vocabulary, which encodes space + text, b a vocabulary of pieces, which adds the space itself; special tokens'
    strings are plain text. Texts that are null, empty, or not spelt by both sides' tokens have zeros and an empty digest. A repeated row is
    one more document; null ids are passed on; other columns are ignored, whatever their names; an empty table gives an empty one.
    Texts are encoded once: the blocks are written, counted, and read again with the counts of their own pairs.
    """
    ship(df.sparkSession)
    blocks = cut_columnar(blocks_of(df, a, b, id_column, text_column), _GROUP_BYTES)
    counts = pair_counts(blocks)
    asked = blocks.select(F.col("block").alias("home"), F.explode("keys").alias("key"))
    told = asked.join(counts, "key")
    kind = df.schema[id_column].dataType

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        hold("alignment", _forget)
        if right.num_rows != pc.sum(left.column("n_keys")).as_py():
            raise ValueError("a block's pairs weren't all counted")
        at = np.argsort(right.column("key").to_numpy())
        count, best = right.column("count").to_numpy()[at], right.column("best").to_numpy()[at]
        parts = []
        for rows in left.to_batches():
            local, times = (rows.column(n).flatten().to_numpy() for n in ("local", "times"))
            ends = np.concatenate([[0], np.cumsum(rows.column("local").value_lengths().to_numpy())]).astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[local] * times.astype(np.int64))])[ends]) for x in (best, count)]
            parts.append(pa.RecordBatch.from_arrays([*(rows.column(n) for n in ["doc_id", *_FACTS]), *map(pa.array, sums), rows.column("groups_sha256")], names))
        return pa.Table.from_batches(parts)

    names = ["doc_id", *_FACTS, "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string"
    rows = blocks.select("block", "doc_id", *_FACTS, F.size("keys").alias("n_keys"), "local", "times", "groups_sha256")
    out = cut_columnar(rows.groupBy("block").cogroup(told.groupBy("home")).applyInArrow(finish, schema))
    release(blocks)
    return out
