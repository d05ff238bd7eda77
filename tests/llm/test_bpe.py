from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lexitab.llm import bpe
from lexitab.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.codec(VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(reference):
    rnd = random.Random(1)
    codec = bpe.codec(VOCABULARY)
    pools = [range(32, 127), range(0x250), range(0x370, 0x500), range(0x4E00, 0x4F00), range(0x1F300, 0x1F600), [97, 32, 10, 9, 39, 0x85, 0xA0, 0x1C]]
    for _ in range(1500):
        text = "".join(chr(rnd.choice(rnd.choice(pools))) for _ in range(rnd.randrange(60)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "é" * 20_000, " " * 30_000 + "x", "thethe" * 9_000, "🙂" * 5_000])
def test_long_pretokens(reference, text):
    assert bpe.codec(VOCABULARY).encode(text) == reference.encode_ordinary(text)


def test_documents(spark, small, reference):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    out = {r["doc_id"]: r for r in bpe.encode_documents(documents, vocabulary=VOCABULARY, with_ids=True).collect()}
    for row in documents.collect():
        ids = reference.encode_ordinary(row["text"])
        assert out[row["doc_id"]]["ids"] == ids and out[row["doc_id"]]["n_tokens"] == len(ids)
        assert out[row["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "x y", 9)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(df, vocabulary=VOCABULARY).collect()
    assert len(rows) == 4 and [r["n_tokens"] for r in rows if r["doc_id"]] == [0, 0, 0]
    assert all(r["ids_sha256"] == r["decoded_sha256"] == empty for r in rows if r["doc_id"])
    assert bpe.encode_documents(df.limit(0), vocabulary=VOCABULARY).count() == 0
    ids = bpe.encode_documents(df, vocabulary=VOCABULARY, with_ids=True)
    assert sorted(r["text"] for r in bpe.decode_documents(ids, vocabulary=VOCABULARY).collect()) == ["", "", "", "x y"]
    with pytest.raises(KeyError):
        bpe.codec(VOCABULARY).decode([10**9])
