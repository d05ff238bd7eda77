from __future__ import annotations

import collections
import hashlib
import json
import math
import re
import struct
import zlib

import numpy as np
import pytest

from lexitab.llm import license_scan, media, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text: str | None):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_documents_equal_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op7_license_scan(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert any(r["n_base"] for r in out)


@pytest.mark.parametrize("text", ["MIT License MIT licenseMIT license", "cc by cc by-nc", "gnu general public license", "xmit license", "mit\x00license", "mit licenseé", "é mit license é" * 3, ""])
def test_scan(text):
    found = license_scan.scan(text.encode())
    assert tuple(found[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_scan(text)


@pytest.mark.parametrize(
    ("text", "postfix", "permitted"),
    [
        ("MIT", "mit", True),
        ("MIT OR GPL-2.0-only AND X", "mit gpl-2.0-only x and or", True),
        ("(MIT OR X) AND GPL-2.0+", "mit x or gpl-2.0+ and", False),
        ("GPL-2.0-only WITH Y AND MIT", "gpl-2.0-only y with mit and", False),
        ("MIT AND", "mit", True),
        ("MIT) AND X", "mit", True),
        ("(MIT", None, None),
        ("AND MIT", None, None),
        ("", None, None),
    ],
)
def test_expressions(text, postfix, permitted):
    found = license_scan.parse_expression(text)
    assert (found and (" ".join(found.postfix), found.permitted)) == (postfix and (postfix, permitted))


def test_tags():
    found = license_scan.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nx spdx-license-identifier:\n")
    assert found["labels"] == "apache-2.0,gpl-2.0-only,mit" and found["permitted"] is False and found["score"] == 0.75


@pytest.mark.parametrize(
    ("text", "labels", "expressions", "permitted"),
    [
        ("Licensed under the Apache License, Version 2.0 or the MIT License.", "apache,apache-2.0,mit", ["apache-2.0 mit or"], True),
        ("Licensed under the MIT License and the GNU General Public License, version 3.", "gpl,gpl-3,mit", ["mit gpl-3 and"], False),
        ("the GNU General Public License version 2 or later, or, at your option, under the BSD license", "bsd,gpl,gpl-2+", ["gpl-2+ bsd or"], False),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc,cc-by-nc-4.0", ["cc-by-nc-4.0"], False),
        ("CC BY 4.0 pictures and texts. MIT License", "cc-by,cc-by-4.0,mit", ["cc-by-4.0", "mit"], True),
        ("MIT license v2 MIT license 2024", "mit,mit-2", ["mit-2", "mit"], False),
        ("no licence or notice", "", [], None),
    ],
)
def test_statements(text, labels, expressions, permitted):
    found = license_scan.scan(text.encode())
    assert (found["labels"], found["expressions"], found["permitted"]) == (labels, expressions, permitted)


def test_license_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "mit license", 3), (None, "mit license", 3), (4, "mit license " * 100_000, 3)], "doc_id long, text string, n_words int")
    out = license_scan.scan_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in out) == [(0, 1), (0, 1), (1, 0), (2, 0), (4, 100_000)]
    assert [r["labels"] for r in out if r["doc_id"] == 1] == [""] and license_scan.scan_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("raw", [b"", b"a", bytes(64), bytes(range(256)) * 40, b"\xff\x00" * 5000, np.random.default_rng(1).bytes(100_000)])
def test_round_trip(raw):
    payload = media.payload_of(raw)
    assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and len(payload) - len(raw) < 64 + (not raw)
    frames, length, rate = media.read_avi(media.write_avi(payload))
    assert np.concatenate(frames).tobytes()[:length] == payload and rate == 25


def huffman(at: int) -> dict[int, tuple[int, int]]:
    """symbol -> (length, code) of the standard's typical table, counted up here."""
    lengths, symbols = map(bytes.fromhex, media._TYPICAL[at])
    out, code, k = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = (length, code)
            code, k = code + 1, k + 1
        code *= 2
    return out


def foreign_frame(luma: np.ndarray, sampling: tuple[int, int], restart: int, tables: bool, grey: bool) -> bytes:
    """A JPEG as others write it: typical tables (told or not), a DC quantiser of 4, AC terms, chroma, restarts. luma has a level for each block."""
    rows, columns = luma.shape
    h, v = (1, 1) if grey else sampling
    out = [b"\xff\xd8", media._segment(0xE0, b"AVI1" + bytes(10)), media._segment(0xDB, bytes([0, 4] + [3] * 63) + bytes([0x11]) + b"".join(struct.pack(">H", 5) for _ in range(64)))]
    parts = bytes([1, h << 4 | v, 0]) + (b"" if grey else bytes([2, 0x11, 1, 3, 0x11, 1]))
    out.append(media._segment(0xC0, struct.pack(">BHHB", 8, rows * 8 - 3, columns * 8 - 5, len(parts) // 3) + parts))
    if tables:
        out.append(media._segment(0xC4, b"".join(bytes([at]) + b"".join(map(bytes.fromhex, media._TYPICAL[at])) for at in media._TYPICAL)))
    if restart:
        out.append(media._segment(0xDD, struct.pack(">H", restart)))
    out.append(media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]) if grey else bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])))
    codes = {at: huffman(at) for at in media._TYPICAL}
    bits, scan, before = "", b"", [0, 0, 0]

    def put(table, symbol, value=0, size=0):
        nonlocal bits
        length, code = codes[table][symbol]
        bits += f"{code:0{length}b}"
        if size:
            bits += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"

    def block(part, level):
        d, before[part] = level - before[part], level
        size = abs(d).bit_length()
        put(0x00 if part == 0 else 0x01, size, d, size)
        ac = 0x10 if part == 0 else 0x11
        for run, value in ((0, 3), (15, -1), (2, -7)):
            put(ac, run << 4 | abs(value).bit_length(), value, abs(value).bit_length())
        put(ac, 0xF0)
        put(ac, 0)

    def flush():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        bits = ""

    wide, high, done = -(-columns // h), -(-rows // v), 0
    for y in range(high):
        for x in range(wide):
            if restart and done and done % restart == 0:
                flush()
                scan += bytes([0xFF, 0xD0 + (done // restart - 1) % 8])
                before = [0, 0, 0]
            for k in range(h * v):
                r, c = y * v + k // h, x * h + k % h
                block(0, (int(luma[min(r, rows - 1), min(c, columns - 1)]) - 128) * 2)
            if not grey:
                block(1, 40 + x)
                block(2, -30 - y)
            done += 1
    flush()
    return b"".join([*out, scan, b"\xff\xd9"])


def foreign_avi(frames: list[bytes], kind: str) -> bytes:
    """An AVI with a sound stream before the video, and frames in the movi list, in its rec lists, under OpenDML indexes, or in a second RIFF part."""
    chunk = media._chunk
    sound = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + bytes(52)))
    stream = struct.pack("<4s4sIHHII", b"vids", b"mjpg", 0, 0, 0, 0, 1) + struct.pack("<I", 10) + bytes(28)
    body = [chunk(b"01dc", f) for f in frames]
    between = chunk(b"00wb", b"abc")
    if kind == "rec":
        movie = b"".join(chunk(b"LIST", b"rec " + between + f) for f in body)
    else:
        movie = between + b"".join(body)
    indx = chunk(b"indx", struct.pack("<HBBI4s", 4, 0, 0, 1, b"01dc") + bytes(12) + struct.pack("<QII", 3, 1, 4)) if kind == "opendml" else b""
    video = chunk(b"LIST", b"strl" + chunk(b"strh", stream) + indx)
    header = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + sound + video)
    if kind == "opendml":
        start = 8 + len(header) + 12
        entries, at = b"", start + len(between)
        for f in frames:
            entries += struct.pack("<II", at + 8, len(f))
            at += 8 + len(f) + len(f) % 2
        ours = start + len(movie)
        ix = chunk(b"ix01", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"01dc", 0, 0) + entries)
        header = header.replace(struct.pack("<QII", 3, 1, 4), struct.pack("<QII", ours, len(ix), len(frames)))
        return chunk(b"RIFF", header + chunk(b"LIST", b"movi" + movie + ix))
    if kind == "parts":
        half = len(body) // 2
        first, second = b"".join(body[:half]), b"".join(body[half:])
        index, at = b"", 4
        for f in frames[:half]:
            index += struct.pack("<4sIII", b"01dc", 16, at, len(f))
            at += 8 + len(f) + len(f) % 2
        return chunk(b"RIFF", header + chunk(b"LIST", b"movi" + first) + chunk(b"idx1", index)) + chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + second))
    return chunk(b"RIFF", header + chunk(b"LIST", b"movi" + movie))


@pytest.mark.parametrize("grey,sampling", [(True, (2, 2)), (False, (1, 1)), (False, (2, 1)), (False, (2, 2))])
@pytest.mark.parametrize("restart,tables", [(0, False), (3, True), (1, False)])
def test_frames_of_others(grey, sampling, restart, tables):
    luma = np.random.default_rng(restart + 7 * grey).integers(0, 256, (5, 7))
    assert np.array_equal(media.decode_frame(foreign_frame(luma, sampling, restart, tables, grey)).reshape(5, 7), luma)


@pytest.mark.parametrize("kind", ["plain", "rec", "opendml", "parts"])
def test_files_of_others(spark, kind):
    rng = np.random.default_rng(4)
    dark, bright = rng.integers(0, 40, (4, 6)), rng.integers(200, 255, (4, 6))
    frames = [foreign_frame(x, (2, 2), 2, False, False) for x in (dark, dark, bright, bright, bright)]
    levels, length, rate = media.read_avi(foreign_avi(frames, kind))
    assert length is None and rate == 10 and [x.tolist() for x in levels] == [x.ravel().tolist() for x in (dark, dark, bright, bright, bright)]
    df = spark.createDataFrame([(1, bytearray(foreign_avi(frames, kind))), (2, bytearray(foreign_avi([frames[0], b"", frames[2]], "plain")))], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in media.read_media(df).collect()}
    assert (rows[1]["status"], rows[1]["frames"]) == ("ok", 5) and [(c["first_frame"], c["frames"], c["start_s"]) for c in rows[1]["clips"]] == [(0, 2, 0.0), (2, 3, 0.2)]
    assert (rows[2]["status"], [c["first_frame"] for c in rows[2]["clips"]]) == ("ok", [0, 2])


def test_status_says_what_was_not_read(spark):
    luma = np.full((2, 2), 99)
    frame = foreign_frame(luma, (1, 1), 0, False, False)
    progressive = frame.replace(b"\xff\xc0", b"\xff\xc2")
    good = foreign_avi([frame], "plain")
    files = [good, None, b"", b"RIFF", foreign_avi([progressive], "plain"), foreign_avi([frame[:-30]], "plain"), good.replace(b"mjpg", b"h264"), good.replace(b"vids", b"txts"), foreign_avi([], "plain")]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    found = {r["doc_id"]: r["status"] for r in media.read_media(df).collect()}
    assert found == {0: "ok", 1: "no_file", 2: "not an AVI file", 3: "not an AVI file", 4: "unsupported: not a baseline frame", 5: found[5], 6: "unsupported: not motion-JPEG", 7: "no video", 8: "no frames"}
    assert found[5].startswith("damaged") and {r["doc_id"] for r in media.clips(df).collect()} == {0}


def test_other_huffman_tables_decode_the_same():
    samples = np.random.default_rng(2).integers(0, 256, 128, dtype=np.uint8)
    frame = media.encode_frame(samples)
    slow = media._luma_levels(media._parsed(frame), 2, 64)
    assert np.array_equal(slow + 128, samples) and np.array_equal(media.decode_frame(frame), samples)


def plain_features(payload: bytes):
    """Features and clips of a payload by loops over its bytes: frames of equal height, shots by histograms of 64 levels."""
    rows = len(payload) // 64
    count = -(-rows // 64)
    high = -(-rows // count)
    padded = payload + bytes(count * high * 64 - len(payload))
    frames = [padded[i * high * 64 : (i + 1) * high * 64] for i in range(count)]
    starts, recent, last = [0], [], None
    for i, f in enumerate(frames):
        histogram = [0.0] * 64
        for b in f:
            histogram[b // 4] += 1 / len(f)
        if last:
            change = sum(abs(x - y) for x, y in zip(histogram, last)) / 2
            mean = sum(recent) / len(recent) if recent else 0
            limit = max(0.25, mean + 3 * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5) if recent else 0.25
            if change > limit:
                starts, recent = [*starts, i], []
            else:
                recent = [*recent, change][-8:]
        last = histogram
    counts = collections.Counter(payload)
    entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in counts.values()) + 0.0
    feature = f"frames={count};shots={len(starts)};mean={sum(payload) / len(payload):.4f};distinct={len(counts)};entropy={entropy:.4f}"
    return feature, [{"clip": k, "first_frame": a, "frames": b - a, "start_s": a / 25, "end_s": b / 25} for k, (a, b) in enumerate(zip(starts, [*starts[1:], count]))]


def test_media_documents(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op9_media_columns(spark, small).collect():
        raw = texts[r["doc_id"]].encode()
        payload = media.payload_of(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.write_avi(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        feature, cut = plain_features(payload)
        assert r["feature"] == feature and json.loads(r["clips"]) == cut


def test_damaged_files_give_no_clips(spark):
    """Any byte of the headers set to 0 or 255, cut files, lists within lists, no frame rate: clips or none, but no error."""
    good = media.write_avi(bytes(range(256)) * 40)
    at = good.index(b"strh") + 8
    bad = [good[: at + 20] + b"\x00" * 4 + good[at + 24 :], good[: at + 24] + b"\x00" * 4 + good[at + 28 :], b"", b"RIFF", good[:300]]
    nested = b"".join(b"LIST\xff\xff\xff\x7fhdrl" for _ in range(50_000))
    bad.append(b"RIFF\xff\xff\xff\x7fAVI " + nested)
    damaged = [good[:i] + bytes([value]) + good[i + 1 :] for i in [*range(320), *range(len(good) - 80, len(good))] for value in (0, 255)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([good, *bad, *damaged])], "doc_id long, media binary")
    found = {r["doc_id"] for r in media.clips(df).collect()}
    assert 0 in found and not found & set(range(1, len(bad) + 1))


def test_clips(spark):
    quiet, loud = bytes(4096 * 3), bytes(range(256)) * 16 * 2
    df = spark.createDataFrame([(1, media.write_avi(quiet + loud + quiet)), (2, None), (3, bytearray(b"RIFF")), (4, media.write_avi(bytes(64)))], "doc_id long, media binary")
    out = sorted(tuple(r) for r in media.clips(df).collect())
    assert out == [(1, 0, 0, 3, 0.0, 0.12), (1, 1, 3, 2, 0.12, 0.2), (1, 2, 5, 3, 0.2, 0.32), (4, 0, 0, 1, 0.0, 0.04)]


def test_media_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "é" * 200_000, "x")], "doc_id long, text string, feature string")
    out = media.describe_documents(df).collect()
    assert len(out) == 3 and len({str(tuple(r)[1:]) for r in out if r["doc_id"]}) == 1 and out[0]["payload_bytes"] == 64
    assert media.describe_documents(df.limit(0)).count() == 0
    assert media.store_documents(df).where("media is null").count() == 0
