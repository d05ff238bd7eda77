"""Token ids in binary files: a static range asymmetric numeral system over frequencies that all files share.

A file holds the ids of consecutive documents. It is a sequence of records, each followed by a line feed, as Spark's text writer
puts them (so Spark's own commit protocol guards the files, on any file system):

    header   MAGIC, precision, lanes, CRC-32 of the frequency table
    block    CRC-32 of what follows; n ids, CRC-32 of the ids (unsigned 32-bit, little-endian), words, checkpoints; then for each
             checkpoint (the first is the block's start) the number of words before it and the state of every lane; then the words
    footer   zlib of the directory (ids and lengths of the documents, offset and length of each block's record), its length and CRC-32, MAGIC

Lane j of a block codes its ids j, j + LANES, j + 2 LANES, ... into a 64-bit state that sheds 32-bit words; all lanes share one
stream of words. Blocks are independent, and a checkpoint repeats the lanes' states, so decoding starts anywhere near a checkpoint and
all stretches between checkpoints are decoded side by side in one vector.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitab.llm._encoder import encoder, vocabulary_path
from lexitab.llm._support import checkpoint_dir, cut_columnar, hold, release, remove, ship
from lexitab.operators.ordered import running

MAGIC = b"LXRANS01"
#: Bits of the frequencies' total; every id that occurs has a frequency of 1 at least.
PRECISION = 20
LANES = 32
#: Ids of a block, and between two checkpoints; multiples of LANES.
BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 1 << 14
#: Blocks that are coded side by side.
TOGETHER = 32
#: Ids of a file, about.
FILE_IDS = 1 << 24
#: Ids or documents that a reader hands on at a time.
READ_IDS = 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEADER = struct.Struct("<8sBxHI")
_BLOCK = struct.Struct("<IIIII")
_TRAILER = struct.Struct("<II8s")


class Frequencies:
    """A table of integer frequencies that add up to 2**PRECISION."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(self.frequency)[:-1]]).astype(np.uint64)
        if int(self.frequency.sum()) != 1 << PRECISION:
            raise ValueError("frequencies don't add up")
        self.checksum = zlib.crc32(frequencies.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Frequencies:
        """In proportion to the counts, those of ids that occur being 1 at least."""
        counts, total = counts.astype(object), 1 << PRECISION
        occurs = np.flatnonzero(counts)
        if len(occurs) > total:
            raise ValueError("more ids than frequencies")
        if not len(occurs):
            return cls(np.array([total]))
        every = int(counts.sum())
        exact = np.array([max(1, int(n) * total // every) for n in counts[occurs]], np.int64)
        order = np.argsort(-exact, kind="stable")
        gap = int(exact.sum()) - total
        if gap < 0:
            exact[order[0]] -= gap
        elif gap:
            spare = exact - 1
            exact -= spare * gap // spare.sum()
            rest = int(exact.sum()) - total
            some = order[exact[order] > 1][:rest]
            exact[some] -= 1
        out = np.zeros(int(occurs[-1]) + 1, np.int64)
        out[occurs] = exact
        return cls(out)

    @property
    def symbols(self) -> np.ndarray:
        """The id of each of the 2**PRECISION places."""
        if not hasattr(self, "_symbols"):
            self._symbols = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        return self._symbols

    def to_bytes(self) -> bytes:
        return MAGIC + zlib.compress(self.frequency.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, said: bytes) -> Frequencies:
        if said[: len(MAGIC)] != MAGIC:
            raise ValueError("not a frequency table")
        return cls(np.frombuffer(zlib.decompressobj().decompress(said[len(MAGIC) :]), "<u4"))


def encode_blocks(table: Frequencies, ids: np.ndarray) -> list[bytes]:
    """The records of equally long blocks, a row of ids each."""
    blocks, n = ids.shape
    if n and (int(ids.max()) >= len(table.frequency) or not table.frequency[ids.ravel()].all()):
        raise ValueError("an id without a frequency")
    steps, every = -(-n // LANES), CHECKPOINT_IDS // LANES
    states = np.full((blocks, LANES), _LOW)
    words = np.zeros((steps, blocks, LANES), np.uint32)
    shed = np.zeros((steps, blocks, LANES), bool)
    kept = {}
    shift, most = np.uint64(PRECISION), np.uint64(63 - PRECISION)
    for step in range(steps - 1, -1, -1):
        some = ids[:, step * LANES : (step + 1) * LANES]
        width = some.shape[1]
        x, f = states[:, :width], table.frequency[some]
        full = x >= f << most
        words[step, :, :width] = x & np.uint64(0xFFFFFFFF)
        shed[step, :, :width] = full
        x = np.where(full, x >> _WORD, x)
        whole = x // f
        states[:, :width] = (whole << shift) + (x - whole * f) + table.before[some]
        if step % every == 0:
            kept[step] = states.copy()
    if not steps:
        kept[0] = states
    counts = shed.sum(axis=2, dtype=np.int64)
    upto = np.vstack([np.zeros((1, blocks), np.int64), np.cumsum(counts, axis=0)])
    out = []
    for b in range(blocks):
        stream = words[:, b][shed[:, b]]
        marks = b"".join(struct.pack("<I", upto[step, b]) + kept[step][b].astype("<u8").tobytes() for step in sorted(kept))
        head = struct.pack("<IIII", n, zlib.crc32(ids[b].astype("<u4").tobytes()), len(stream), len(kept))
        body = head + marks + stream.astype("<u4").tobytes()
        out.append(struct.pack("<I", zlib.crc32(body)) + body)
    return out


class Block:
    """A record of encode_blocks(), checked."""

    def __init__(self, record: bytes):
        if len(record) < _BLOCK.size:
            raise ValueError("a block is cut short")
        said, self.n, self.checksum, n_words, n_marks = _BLOCK.unpack_from(record)
        size = _BLOCK.size + n_marks * (4 + 8 * LANES) + 4 * n_words
        if len(record) != size or zlib.crc32(record[4:]) != said:
            raise ValueError("a block's checksum differs")
        marks = np.frombuffer(record, np.dtype([("words", "<u4"), ("states", "<u8", LANES)]), n_marks, _BLOCK.size)
        self.words = np.frombuffer(record, "<u4", n_words, size - 4 * n_words)
        self.first_words, self.states = marks["words"].astype(np.int64), marks["states"]

    def stretches(self, low: int = 0, high: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(ids, states, words) of the stretches between checkpoints that hold the ids from low up to high."""
        high = self.n if high is None else high
        ends = np.append(self.first_words[1:], len(self.words))
        out = []
        for k in range(low // CHECKPOINT_IDS, -(-high // CHECKPOINT_IDS)):
            ids = min(self.n - k * CHECKPOINT_IDS, CHECKPOINT_IDS)
            out.append((ids, self.states[k], self.words[self.first_words[k] : ends[k]]))
        return out


def decode_stretches(table: Frequencies, stretches: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The ids of each stretch; those of one length are decoded side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(stretches)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    for n in {s[0] for s in stretches}:
        if not n:
            continue
        some = [i for i, s in enumerate(stretches) if s[0] == n]
        states = np.stack([stretches[i][1] for i in some]).astype(np.uint64)
        sizes = [len(stretches[i][2]) for i in some]
        words = np.concatenate([*[stretches[i][2] for i in some], np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        found = np.empty((-(-n // LANES), len(some), LANES), np.uint32)
        for step in range(len(found)):
            width = min(LANES, n - step * LANES)
            x = states[:, :width]
            place = x & mask
            ids = table.symbols[place]
            found[step, :, :width] = ids
            x = table.frequency[ids] * (x >> shift) + (place - table.before[ids])
            low = x < _LOW
            taken = np.cumsum(low, axis=1)
            from_stream = np.minimum(at[:, None] + taken - 1, len(words) - 1)
            states[:, :width] = np.where(low, x << _WORD | words[from_stream], x)
            at += taken[:, -1]
        ids = found.transpose(1, 0, 2).reshape(len(some), -1)[:, :n]
        for i, row in zip(some, ids):
            out[i] = row
    return out


class FileWriter:
    """Turns documents into the records of one file."""

    def __init__(self, table: Frequencies):
        self.table, self.waiting, self.held = table, [], 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.at, self.blocks = 0, []

    def _said(self, record: bytes) -> bytes:
        self.at += len(record) + 1
        return record

    def header(self) -> bytes:
        return self._said(_HEADER.pack(MAGIC, PRECISION, LANES, self.table.checksum))

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[bytes]:
        """Takes a document in and gives the records that are full."""
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= TOGETHER * BLOCK_IDS:
            yield from self._coded(last=False)

    def _coded(self, last: bool) -> Iterator[bytes]:
        ids = np.concatenate([np.zeros(0, np.uint16), *self.waiting])
        full = len(ids) // BLOCK_IDS
        for low in range(0, full, TOGETHER):
            yield from self._blocks(ids[low * BLOCK_IDS : min(full, low + TOGETHER) * BLOCK_IDS].reshape(-1, BLOCK_IDS))
        rest = ids[full * BLOCK_IDS :]
        if last and len(rest):
            yield from self._blocks(rest[None, :])
            rest = rest[:0]
        self.waiting, self.held = [rest], len(rest)

    def _blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        for record in encode_blocks(self.table, ids.astype(np.int64)):
            self.blocks.append((self.at, len(record)))
            yield self._said(record)

    def close(self) -> Iterator[bytes]:
        yield from self._coded(last=True)
        null = np.array([d is None for d in self.docs], bool)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        said = struct.pack("<QQ", len(docs), len(self.blocks)) + np.packbits(null).tobytes() + docs.tobytes() + np.array(self.lengths, "<u8").tobytes() + np.array(self.blocks, "<u8").reshape(-1, 2).tobytes()
        packed = zlib.compress(said, 1)
        yield self._said(packed + _TRAILER.pack(len(packed), zlib.crc32(packed), MAGIC))


class FileReader:
    """Reads what FileWriter has written."""

    def __init__(self, table: Frequencies, content: bytes):
        self.table, self.content = table, content
        end = len(content) - 1
        if end < _HEADER.size + _TRAILER.size or content[end:] != b"\n":
            raise ValueError("a file of ids is cut short")
        magic, precision, lanes, checksum = _HEADER.unpack_from(content)
        size, said, last = _TRAILER.unpack_from(content, end - _TRAILER.size)
        packed = content[max(0, end - _TRAILER.size - size) : end - _TRAILER.size]
        if magic != MAGIC or last != MAGIC or (precision, lanes) != (PRECISION, LANES) or zlib.crc32(packed) != said:
            raise ValueError("not a file of ids, or its directory is damaged")
        if checksum != table.checksum:
            raise ValueError("the file was written with other frequencies")
        directory = zlib.decompress(packed)
        n, blocks = struct.unpack_from("<QQ", directory)
        at = 16 + -(-n // 8)
        self.null = np.unpackbits(np.frombuffer(directory, np.uint8, at - 16, 16), count=n).astype(bool)
        self.docs = np.frombuffer(directory, "<i8", n, at)
        self.lengths = np.frombuffer(directory, "<u8", n, at + 8 * n).astype(np.int64)
        self.blocks = np.frombuffer(directory, "<u8", 2 * blocks, at + 16 * n).astype(np.int64).reshape(-1, 2)

    def block(self, number: int) -> Block:
        at, size = self.blocks[number].tolist()
        return Block(self.content[at : at + size])

    def ids(self) -> Iterator[np.ndarray]:
        """All ids in order, some blocks at a time; an error if a checksum differs."""
        for low in range(0, len(self.blocks), TOGETHER):
            blocks = [self.block(k) for k in range(low, min(len(self.blocks), low + TOGETHER))]
            parts = iter(decode_stretches(self.table, [s for b in blocks for s in b.stretches()]))
            for b in blocks:
                ids = np.concatenate([next(parts) for _ in b.first_words])
                if zlib.crc32(ids.astype("<u4").tobytes()) != b.checksum:
                    raise ValueError("the ids of a block differ from their checksum")
                yield ids

    def window(self, start: int, stop: int) -> np.ndarray:
        """The file's ids from start up to stop, from the nearest checkpoints."""
        stretches, skipped = [], None
        stop = min(stop, int(self.lengths.sum()))
        if start >= stop:
            return np.zeros(0, np.uint32)
        for k in range(start // BLOCK_IDS, -(-stop // BLOCK_IDS)):
            low, high = max(0, start - k * BLOCK_IDS), min(BLOCK_IDS, stop - k * BLOCK_IDS)
            if skipped is None:
                skipped = low // CHECKPOINT_IDS * CHECKPOINT_IDS + k * BLOCK_IDS
            stretches += self.block(k).stretches(low, high)
        ids = np.concatenate(decode_stretches(self.table, stretches))
        return ids[start - skipped : stop - skipped]

    def documents(self, start: int = 0) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(id, number of ids, ids in pieces) of each document."""
        pieces, have = self.ids(), np.zeros(0, np.uint32)
        for doc, null, n in zip(self.docs.tolist(), self.null.tolist(), self.lengths.tolist()):
            some, wanted = [], n
            while wanted:
                if not len(have):
                    have = next(pieces)
                some.append(have[:wanted])
                have = have[wanted:]
                wanted -= len(some[-1])
            yield None if null else doc, n, some


def tokenise(df: DataFrame, *, vocabulary: str, end_id: int | None, id_column: str, text_column: str, plain_special: bool = False) -> DataFrame:
    """(doc_id, tie, row, width, ids) of every row: ids are little-endian numbers of width bytes, the end id last; tie is a hash of the text."""
    picked = df.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("tie"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches):
        hold("tokens", encoder.cache_clear)
        own = encoder(vocabulary_path(vocabulary), plain_special)
        tail = np.array([] if end_id is None else [end_id], own.dtype).tobytes()
        for batch in batches:
            said = [own.encode(text) + tail for text in batch.column("text").to_pylist()]
            width = pa.array(np.full(len(said), own.dtype.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], width, pa.array(said, pa.binary())], ["doc_id", "tie", "row", "width", "ids"])

    return picked.mapInArrow(run, "doc_id long, tie long, row long, width int, ids binary")


def ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each row of tokenise()."""
    return [np.frombuffer(said, f"<u{width}") for said, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows; what reaches the driver is a number for each id of the vocabulary."""

    def run(batches):
        hold("token files")
        counts = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.concatenate([np.zeros(0, np.uint16), *ids_of(batch)])
            some = np.bincount(ids, minlength=len(counts))
            some[: len(counts)] += counts
            counts = some
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.array(rows.column("id"), np.int64), np.array(rows.column("n"), np.int64)
    counts = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    counts[ids] = n
    return counts


def write_tokens(tokens: DataFrame, folder: str, file_ids: int = FILE_IDS) -> None:
    """Writes rows of tokenise(), which must be a written table, as folder/table and folder/files/part-*, in ascending order of doc_id (nulls first).

    Rows of one id follow each other by the hash of their text. A file is one partition of a range partitioning by id, hash and row,
    so no id or copied row, however frequent, falls to one task.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens)
    table = Frequencies.of_counts(counts)
    spark.createDataFrame([(table.to_bytes(),)], "record binary").select(F.col("record").cast("string")).coalesce(1).write.option("lineSep", "\n").text(f"{folder}/table")
    files = max(1, -(-int(counts.sum()) // file_ids))
    order = ["doc_id", "tie", "row"]
    dealt = tokens.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        hold("token files")
        writer = None
        said = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = FileWriter(table)
                said.append(writer.header())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch)):
                said += writer.add(doc, ids)
            if said:
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary())], ["record"])
                said = []
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*said, *writer.close()], pa.binary())], ["record"])

    records = dealt.select("doc_id", "width", "ids").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n").text(f"{folder}/files")


def read_table(spark: SparkSession, folder: str) -> Frequencies:
    """The frequencies of a folder, which has a number for each id of the vocabulary."""
    found = spark.read.format("binaryFile").load(f"{folder}/table").where("length > 0").select("content").collect()
    return Frequencies.from_bytes(bytes(found[0]["content"]))


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files of write_tokens(): file (its number), at (place of the first id in the file), doc_id, n_tokens, ids_crc32, and ids on request.

    Every block's checksums are verified; a damaged file, or one written with other frequencies, is an error.
    """
    table = read_table(spark, folder)
    files = spark.read.format("binaryFile").load(f"{folder}/files").where("length > 0")
    files = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("file"), "content")
    names = ["file", "at", "doc_id", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        hold("token files")
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows, at, held = [], 0, 0
                for doc, n, pieces in FileReader(table, content.as_py()).documents():
                    checksum = 0
                    for piece in pieces:
                        checksum = zlib.crc32(piece.astype("<u4").tobytes(), checksum)
                    ids = [np.concatenate([np.zeros(0, np.uint32), *pieces]).astype(np.int32)] if with_ids else []
                    rows.append((number, at, doc, n, checksum, *ids))
                    at += n
                    held += 16 + n * with_ids
                    if held >= READ_IDS:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, "file long, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start to rows of read_tokens(), which must be a written table: the ids of all documents before a row's."""
    sums = read.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    starts = running(sums, [], F.floor(F.col("file") / 1024), [F.col("file")], {"before": F.col("all")}, before=True)
    starts = starts.select(F.col("file"), F.coalesce("before", F.lit(0)).alias("before"))
    return read.join(starts, "file").withColumn("start", F.col("before") + F.col("at")).drop("before")


def store_documents(df: DataFrame, folder: str, *, vocabulary: str, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text", plain_special: bool = False, file_ids: int = FILE_IDS) -> None:
    """Encodes every whole text of df and writes the ids into folder.

    Ids of rows are whole numbers or null. A null or empty text has the end id alone; special tokens' strings in texts become those tokens
    unless plain_special. Repeated rows are stored as often as they come; other columns are ignored, whatever their names; an empty
    table gives a folder without documents. The ids are written once (4 bytes each, compressed) before they are dealt to files.
    """
    ship(df.sparkSession)
    tokens = cut_columnar(tokenise(df, vocabulary=vocabulary, end_id=end_id, id_column=id_column, text_column=text_column, plain_special=plain_special))
    write_tokens(tokens, folder, file_ids)
    release(tokens)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """A row for each row of df from files written for it: doc_id, start, n_tokens, ids_crc32. Options as for store_documents(); the files go once they are read."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"
    store_documents(df, folder, **options)
    read = cut_columnar(read_tokens(spark, folder))
    remove(spark, folder)
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
