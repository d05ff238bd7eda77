from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexitab.llm import token_alignment
from lexitab.llm._support import cut_columnar, release, ship
from lexitab.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(BYTE_TOKENIZER))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_TOKENIZER))


def plain(libraries, text):
    """([(first byte, byte after the last, id)] of both sides) of a text by the libraries' own spellings; None without tokens."""
    a, b = libraries
    if not text:
        return None
    letters = {}
    n = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + n)] = byte
            n += 1
    sides = []
    encoded = a.encode(" " + text, add_special_tokens=False)
    sides.append([(bytes(letters[c] for c in piece), i) for piece, i in zip(encoded.tokens, encoded.ids)])
    ids = b.encode(text)
    sides.append([(bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode(), i) for i in ids])
    if any(b"".join(s for s, _ in side) != (" " + text).encode() for side in sides):
        return None
    out = []
    for side in sides:
        at, tokens = 0, []
        for said, i in side:
            tokens.append((at, at + len(said), i))
            at += len(said)
        out.append(tokens)
    return out


def expected(libraries, rows):
    found = [(doc, plain(libraries, text)) for doc, text in rows]
    links, counts = [], Counter()
    for _, sides in found:
        own = []
        if sides:
            for low, high, i in sides[0]:
                own += [(i, j) for x, y, j in sides[1] if x < high and low < y]
        links.append(own)
        counts.update(set(own))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc, sides), own in zip(found, links):
        if not sides:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({t[1] for t in sides[0]} & {t[1] for t in sides[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for x, y, i in side if low < y <= cut) for side in sides))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, len(sides[0]), len(sides[1]), len(groups), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), digest))
    return out


TEXTS = ["a", " ", "a▁b", "x\x00\ty  z\n\n", "<|endoftext|> and </s>", "é🙂日本語 word", "naïve  café 12345.67", "  wide", "the the the", "Straße ﬁne", "İstanbul", "ab" * 40, "é", None, ""]


def test_equals_plain_alignment(spark, libraries):
    rnd = random.Random(4)
    pools = [range(97, 123), range(32, 127), range(0xC0, 0x250), range(0x4E00, 0x4F00), [32, 32, 10, 9, 0xA0], range(0x1F600, 0x1F640)]
    made = ["".join(chr(rnd.choice(rnd.choice(pools))) for _ in range(rnd.randrange(80))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *made])] + [(3, TEXTS[3]), (3, TEXTS[3]), (None, "the end")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(5)
    found = token_alignment.align_documents(df, a=BYTE_TOKENIZER, b=PIECE_TOKENIZER)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected(libraries, rows)))


def test_query_on_the_small_table(spark, small, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r["text"]) < 1500]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = token_alignment.align_documents(df, a=BYTE_TOKENIZER, b=PIECE_TOKENIZER)
    assert sorted(map(tuple, found.collect())) == sorted(expected(libraries, rows))
    whole = QUERIES["op11_token_alignment"](spark, small)
    assert whole.columns == found.columns and whole.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert whole.where("n_a = 0 or n_links < n_groups or n_best > n_links").count() == 0


def test_groups_and_table(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in token_alignment.token_groups(df, a=BYTE_TOKENIZER, b=PIECE_TOKENIZER).collect():
        sides = plain(libraries, dict(rows)[r["doc_id"]])
        if not sides:
            assert r["groups"] == []
            continue
        for g in r["groups"]:
            for side, name in zip(sides, "ab"):
                some = side[g[f"{name}_start"] : g[f"{name}_end"]]
                assert (some[0][0], some[-1][1]) == (g["start"], g["end"])
    table = token_alignment.linked_ids(df, a=BYTE_TOKENIZER, b=PIECE_TOKENIZER)
    assert table.count() == table.select("a", "b").distinct().count()
    assert sum(r["count"] for r in table.collect()) == sum(len({(i, j) for x, y, i in s[0] for u, v, j in s[1] if u < y and x < v}) for s in (plain(libraries, t) for t in TEXTS) if s)


def test_rows_are_as_small_as_their_documents(spark):
    texts = [None if i % 50 == 7 else f"word{i} and {chr(97 + i % 26) * 3} " * (1 + i % 5) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ship(spark)
    rows = token_alignment.blocks_of(df, BYTE_TOKENIZER, PIECE_TOKENIZER, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    blocks = {}
    for r in rows:
        assert len(r["keys"]) == len(r["holders"]) <= len(r["local"]) == len(r["times"]) <= r["n_links"] == sum(r["times"])
        blocks.setdefault(r["block"], []).append(r)
    for own in blocks.values():
        keys = sorted((k, n) for r in own for k, n in zip(r["keys"], r["holders"]))
        held = Counter(i for r in own for i in r["local"])
        assert len({k for k, _ in keys}) == len(keys) and [n for _, n in keys] == [held[i] for i in range(len(keys))]


def test_pieces_of_a_block(monkeypatch):
    a, b = (token_alignment.vocabulary(n) for n in (BYTE_TOKENIZER, PIECE_TOKENIZER))
    texts = [*TEXTS, None, "the end " * 50, *TEXTS]
    ids = pa.array(range(len(texts)))
    whole = token_alignment._block(a, b, ids, texts, 5)
    monkeypatch.setattr(token_alignment, "_PIECE", 20)
    pieces = token_alignment._pieces(texts)
    assert len(pieces) > 5 and [i for low, high in pieces for i in range(low, high)] == list(range(len(texts)))
    assert token_alignment._block(a, b, ids, texts, 5).equals(whole)


def test_row_groups_of_long_lists_are_small(spark):
    rows = spark.range(0, 2000, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.xxhash64("id", i)).alias("keys"))
    table = cut_columnar(rows, 1 << 20)
    parts = [ParquetFile(p).metadata for p in Path(table._lexitab_path.removeprefix("file:")).glob("*.parquet")]
    assert sum(p.num_rows for p in parts) == 2000 and max(p.row_group(i).total_byte_size for p in parts for i in range(p.num_row_groups)) < 2 << 20
    release(table)


def test_bitset():
    rng = np.random.default_rng(0)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.4)
        found = token_alignment.Bitset.of_places(places, size)
        assert (found.select() == places).all()
        every = np.arange(size)
        assert (found.rank(every) == np.searchsorted(places, every)).all()


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    out = token_alignment.align_documents(df, a=BYTE_TOKENIZER, b=PIECE_TOKENIZER).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(str((i, 0, 0, 0, 0, 0, 0, "")) for i in (1, 2, None))
    assert token_alignment.align_documents(df.limit(0), a=BYTE_TOKENIZER, b=PIECE_TOKENIZER).count() == 0
    long = spark.createDataFrame([(1, "word and words, " * 20_000)], "doc_id long, text string")
    assert token_alignment.align_documents(long, a=BYTE_TOKENIZER, b=PIECE_TOKENIZER).first()["n_a"] > 60_000
