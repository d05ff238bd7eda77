from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexitab.llm import token_files
from lexitab.llm.queries import QUERIES
from lexitab.llm.token_files import BLOCK_IDS, CHECKPOINT_IDS, Block, FileReader, FileWriter, Frequencies, decode_stretches, encode_blocks

VOCABULARY = "byte_bpe_50k.json"


def file_of(table, docs) -> bytes:
    writer = FileWriter(table)
    records = [writer.header()]
    for doc, ids in docs:
        records += writer.add(doc, np.array(ids, np.uint32))
    return b"".join(r + b"\n" for r in [*records, *writer.close()])


def expected(rows):
    """start, length and checksum of each row in order of id, by the library alone."""
    to_ids, start, out = Tokenizer.from_file(public_tokenizers.path(VOCABULARY)), 0, []
    for doc, text in rows:
        ids = [*to_ids.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_frequencies_add_up():
    rng = np.random.default_rng(1)
    for counts in ([5], [1, 0, 0, 10**15], rng.zipf(1.2, 50_000) % 10**9, np.ones(70_000, int), [0, 1, 1], []):
        table = Frequencies.of_counts(np.array(counts, np.int64))
        assert int(table.frequency.sum()) == 1 << token_files.PRECISION
        assert all((table.frequency[: len(counts)] > 0) == (np.array(counts) > 0)) or not len(counts)
        again = Frequencies.from_bytes(table.to_bytes() + b"\n")
        assert (again.frequency == table.frequency).all()


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, CHECKPOINT_IDS, CHECKPOINT_IDS + 5, BLOCK_IDS])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, (3, n)) - 1, 40_000)
    table = Frequencies.of_counts(np.bincount(ids.ravel(), minlength=2))
    for row, record in zip(ids, encode_blocks(table, ids)):
        block = Block(record)
        assert (np.concatenate(decode_stretches(table, block.stretches()) or [[]]) == row).all()
        # Far below four bytes an id, near the entropy.
        if n > 10_000:
            p = np.bincount(ids.ravel()) / ids.size
            entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
            assert len(record) * 8 / n < entropy * 1.05 + 0.2


def test_files_windows_and_damage():
    rng = np.random.default_rng(3)
    docs = [(int(i) if i else None, rng.integers(0, 900, int(rng.integers(0, 4000)))) for i in range(60)] + [(99, rng.integers(0, 900, 3 * BLOCK_IDS))]
    table = Frequencies.of_counts(np.bincount(np.concatenate([d[1] for d in docs])))
    content = file_of(table, docs)
    back = [(d, np.concatenate([[], *p])) for d, n, p in FileReader(table, content).documents()]
    assert [d for d, _ in back] == [d for d, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(back, docs))
    every, reader = np.concatenate([d[1] for d in docs]), FileReader(table, content)
    for low, high in ((0, 1), (5, 5), (CHECKPOINT_IDS - 3, CHECKPOINT_IDS + 3), (BLOCK_IDS - 9, 2 * BLOCK_IDS + 9), (len(every) - 7, len(every) + 50)):
        assert (reader.window(low, high) == every[low:high]).all()
    for at in (3, 40, 5000, len(content) // 2, len(content) - 200, len(content) - 9):
        broken = content[:at] + bytes([content[at] ^ 4]) + content[at + 1 :]
        with pytest.raises((ValueError, zlib.error)):
            list(FileReader(table, broken).documents())
    with pytest.raises(ValueError):
        FileReader(table, content[:-30])
    with pytest.raises(ValueError):
        FileReader(Frequencies.of_counts(np.array([1, 2])), content)
    with pytest.raises(ValueError):
        encode_blocks(table, np.array([[900]]))


def test_query_equals_the_library(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    found = QUERIES["op12_token_files"](spark, small)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == expected(docs)


def test_many_files_keep_the_order(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    docs = sorted((r["doc_id"], r["text"]) for r in df.collect())
    folder = f"file:{tmp_path}/ids"
    token_files.store_documents(df, folder, vocabulary=VOCABULARY, file_ids=9_000)
    files = [p for p in (tmp_path / "ids/files").glob("part-*") if p.stat().st_size]
    assert len(files) > 5
    read = token_files.read_tokens(spark, folder, with_ids=True)
    rows = token_files.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32", "ids").orderBy("start").collect()
    assert [tuple(r)[:4] for r in rows] == expected(docs)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    files[0].write_bytes(files[0].read_bytes()[:50] + b"!" + files[0].read_bytes()[51:])
    Path(files[0].parent, f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="checksum|damaged"):
        token_files.read_tokens(spark, folder).collect()


def test_edges(spark):
    hot = [(7, "the same row", "x")] * 40
    rows = [(None, "no id", "x"), (1, None, "x"), (2, "", "x"), (3, "w " * 30_000, "x"), (7, "another text", "x"), (8, "<|endoftext|> é🙂\x00", "x"), *hot]
    df = spark.createDataFrame(rows, "doc_id int, text string, start string").repartition(4)
    out = token_files.round_trip(df, vocabulary=VOCABULARY, file_ids=6_000).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, 1, 2, 3, *[7] * 41, 8] and out[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(out, out[1:]))
    assert [r["n_tokens"] for r in out][1:3] == [1, 1]
    special = {plain: token_files.round_trip(df.where("doc_id = 8"), vocabulary=VOCABULARY, plain_special=plain).first()["n_tokens"] for plain in (False, True)}
    assert special[True] == special[False] + 6
    assert token_files.round_trip(df.limit(0), vocabulary=VOCABULARY).count() == 0
