"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token becomes a linked list of byte symbols. Adjacent pairs that a vocabulary entry covers wait in the
bucket of that entry's rank; a two-level bitmap over the ranks gives the next non-empty bucket by find-first-set.
Popped positions whose pair has changed meanwhile are stale and skipped. A pre-token of n bytes costs O(n log n),
so runs of 100,000 letters are no special case.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import hold, ship

#: Pre-tokens whose ids a worker remembers, in each of two generations; the older one goes when the newer is full.
REMEMBERED = 350_000
#: Longer pre-tokens are encoded each time.
REMEMBERED_BYTES = 64
_SEEN = 1 << 22
#: Single bits, for the bitmap's words of 256 bits and its top level (up to 2**18 ranks).
_BITS = [1 << i for i in range(1024)]


class Remembered(dict):
    """Decimal ids of pre-tokens, joined by commas; one that is missing is encoded.

    Once a generation has been full, a pre-token is kept when it comes for the second time: a table of bytes by hash says what
    has been seen, as most pre-tokens of a corpus come once. A full generation becomes the older one, whose entries return by use.
    """

    def __init__(self, merge):
        super().__init__()
        self.merge = merge
        self.older: dict[str, str] = {}
        self.seen = bytearray(_SEEN)

    def __missing__(self, token: str) -> str:
        ids = self.older.get(token)
        if ids is None:
            raw = token.encode("utf-8")
            ids = ",".join(map(str, self.merge(raw)))
            place = hash(token) & (_SEEN - 1)
            known, self.seen[place] = self.seen[place], 1
            if len(raw) > REMEMBERED_BYTES or self.older and not known:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = ids
        return ids


class BytePairCodec:
    """Encodes and decodes with a table of bytes -> rank; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.said = {str(rank): piece for piece, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        words = max(ranks.values(), default=0) // 256 + 1
        self.low = [0] * words
        self.known = Remembered(self.merge)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"vocabulary lacks {len(missing)} single bytes")

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairCodec:
        """From a rank file: a base64 token and its rank on each line."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The rank queue is kept in local names, as a call for each step would double the time: buckets has a rank's positions as
        a heap, so equal ranks merge from the left; bit r of low[w] says that rank w * 256 + r has a bucket, bit w of
        top that low[w] isn't empty. All of them are empty again at the end.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        low, bits_of, top = self.low, _BITS, 0
        buckets: dict[int, list[int]] = {}
        end = list(range(1, size + 2))
        before = list(range(-1, size))
        for i in range(size - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    low[rank >> 8] |= bits_of[rank & 255]
                    top |= bits_of[rank >> 8]
                else:
                    bucket.append(i)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                left = heappop(bucket)
            else:
                (left,) = bucket
                del buckets[rank]
                bits ^= first
                low[word] = bits
                if not bits:
                    top &= top - 1
            middle = end[left]
            # A dead position has end 0; a changed pair has another rank.
            if not middle or middle >= size:
                continue
            right = end[middle]
            if get(piece[left:right]) != rank:
                continue
            end[left] = right
            end[middle] = 0
            previous = before[left]
            if right < size:
                before[right] = left
                rank = get(piece[left : end[right]])
                if rank is not None:
                    bucket = buckets.get(rank)
                    if bucket is None:
                        buckets[rank] = [left]
                        low[rank >> 8] |= bits_of[rank & 255]
                        top |= bits_of[rank >> 8]
                    else:
                        heappush(bucket, left)
            if previous >= 0:
                rank = get(piece[previous:right])
                if rank is not None:
                    bucket = buckets.get(rank)
                    if bucket is None:
                        buckets[rank] = [previous]
                        low[rank >> 8] |= bits_of[rank & 255]
                        top |= bits_of[rank >> 8]
                    else:
                        heappush(bucket, previous)
        ranks, out, at = self.ranks, [], 0
        while at < size:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def encode_text(self, text: str | None) -> str:
        """The decimal ids of a text, joined by commas; empty for null or empty."""
        return ",".join(map(self.known.__getitem__, self.split(text))) if text else ""

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        said = self.encode_text(text)
        return list(map(int, said.split(","))) if said else []

    def decode(self, ids) -> bytes:
        """The bytes of the ids; KeyError for an id that isn't in the vocabulary."""
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode_text(self, ids: list[str]) -> bytes:
        """The bytes of decimal ids."""
        return b"".join(map(self.said.__getitem__, ids))


@cache
def codec(name: str, pattern: str | None = None) -> BytePairCodec:
    """A worker's codec for a vocabulary of public_tokenizers, or for the rank file at a path."""
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    return BytePairCodec.load(path, pattern or public_tokenizers.PATTERN)


def encode_documents(
    df: DataFrame,
    *,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encodes every whole text and decodes the ids again, a row for each input row.

    Columns: the id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded
    bytes), and with with_ids also ids array<int> and decoded binary. A null or empty text has no tokens; repeated
    rows give repeated rows; a null id is passed on; other columns are ignored, whatever their names; an empty table
    gives an empty one. One narrow map: no shuffle, and a worker's memory is bounded by one Arrow batch and REMEMBERED.
    """
    ship(df.sparkSession)
    picked = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    extra = ", ids array<int>, decoded binary" if with_ids else ""
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hold("bpe", codec.cache_clear)
        book = codec(vocabulary)
        for batch in batches:
            counts, hashes, decoded_hashes, all_ids, decoded = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                joined = book.encode_text(text)
                ids = joined.split(",") if joined else []
                back = book.decode_text(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(joined.encode("ascii")).hexdigest())
                decoded_hashes.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
                    decoded.append(back)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                places = pa.array(np.cumsum([0, *counts]), pa.int32())
                columns += [pa.ListArray.from_arrays(places, pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids]))), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def decode_documents(df: DataFrame, *, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of each row's ids (invalid UTF-8 becomes U+FFFD); null ids give an empty text."""
    ship(df.sparkSession)
    picked = df.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))

    def run(batches):
        hold("bpe", codec.cache_clear)
        book = codec(vocabulary)
        for batch in batches:
            texts = [book.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")
