"""Media columns: AVI motion-JPEG files that hold bytes losslessly, and timed clips between shot changes.

A byte is the DC level of one 8x8 block of a baseline grey JPEG: with a DC quantiser of 8 and no AC terms the whole block has
that grey value, so any decoder gives it back exactly. The DC Huffman code has one code of each length from 1 to 9, the shortest for
the largest differences: code and extra bits always take 9 bits, plus 1 for end of block, so frames are packed and
unpacked as arrays. Files of others are read too: frames with other codes or the standard's typical tables, several components (their luma
counts), restarts; files with OpenDML indexes, with idx1, or with none.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import arrow_column, ship, utf8_parts

#: Bytes of a row of blocks, and rows of a frame at most.
ROW, ROWS = 64, 64
RATE = 25
#: Lists within lists of a file that is read.
DEEPEST = 16
#: Frames that the adaptive threshold looks back on; a shot change exceeds their mean by DEVIATIONS and LEAST itself.
WINDOW, DEVIATIONS, LEAST = 8, 3.0, 0.25

_DIFFERENCES = np.arange(-255, 256)
_SIZES = np.array([int(abs(d)).bit_length() for d in _DIFFERENCES])
#: The 10 bits of each difference: code, extra bits, end of block.
_WORDS = ((((1 << (9 - _SIZES)) - 2) << _SIZES | np.where(_DIFFERENCES >= 0, _DIFFERENCES, _DIFFERENCES + (1 << _SIZES) - 1)) << 1).astype(np.uint64)
_BACK = np.full(1024, 9999, np.int32)
_BACK[_WORDS.astype(np.int64)] = _DIFFERENCES
_DC_LENGTHS, _DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
_AC_LENGTHS, _AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_frame(samples: np.ndarray) -> bytes:
    """A JPEG of rows x ROW bytes, a block for each."""
    rows = len(samples) // ROW
    levels = samples.astype(np.int64) - 128
    words = _WORDS[np.diff(levels, prepend=0) + 255].reshape(-1, 4)
    packed = words[:, 0] << np.uint64(30) | words[:, 1] << np.uint64(20) | words[:, 2] << np.uint64(10) | words[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + _DC_LENGTHS + _DC_SYMBOLS + bytes([0x10]) + _AC_LENGTHS + _AC_SYMBOLS),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        scan,
        b"\xff\xd9",
    ))


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Canonical Huffman codes: (length, code) -> symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


#: Fixed values of the JPEG standard's typical tables, which motion-JPEG frames without tables of their own use: how many codes
#: there are of each length from 1 to 16, and their symbols.
_TYPICAL = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", ""),
    ),
}


@dataclass
class _Frame:
    """What stands before a JPEG's scan: quantisers of the DC level, (id, across, down, quantiser) of each component, Huffman tables, MCUs between restarts."""

    quantisers: dict[int, int]
    size: tuple[int, int]
    parts: list[tuple[int, int, int, int]]
    tables: dict[int, tuple[bytes, bytes]]
    restart: int
    scanned: list[tuple[int, int]]
    scan: bytes


def _parsed(jpeg: bytes) -> _Frame:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, found = 2, _Frame({}, (0, 0), [], {k: tuple(map(bytes.fromhex, v)) for k, v in _TYPICAL.items()}, 0, [], b"")
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("damaged frame")
        marker = jpeg[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        length = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + length]
        if length < 2 or len(body) != length - 2:
            raise ValueError("damaged frame")
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            depth, high, across, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not high or not across:
                raise ValueError("unsupported: not 8 bits a sample, or no size")
            found.size = (high, across)
            found.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("unsupported: not a baseline frame")
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                found.tables[body[0]] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            found.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            found.scanned = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            break
    if [i for i, *_ in found.parts] != [i for i, _ in found.scanned] or not found.parts:
        raise ValueError("unsupported: more than one scan")
    if any(not 1 <= n <= 4 for _, across, down, _ in found.parts for n in (across, down)):
        raise ValueError("damaged frame")
    end = jpeg.rfind(b"\xff\xd9")
    found.scan = jpeg[at : end if end >= at else len(jpeg)]
    return found


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The level of each block (rounded block mean) of a baseline JPEG, row by row: of the grey values, or of the luma of several components."""
    frame = _parsed(jpeg)
    (high, wide), parts = frame.size, frame.parts
    rows, columns = -(-high // 8), -(-wide // 8)
    blocks = rows * columns
    if blocks > 4 * len(frame.scan):  # a block takes two bits at least
        raise ValueError("damaged frame")
    quantiser = frame.quantisers.get(parts[0][3])
    if quantiser is None:
        raise ValueError("damaged frame")
    if len(parts) == 1 and not frame.restart and frame.tables[0x00] == (_DC_LENGTHS, _DC_SYMBOLS) and frame.tables[0x10] == (_AC_LENGTHS, _AC_SYMBOLS) and not blocks % 4:
        scan = frame.scan.replace(b"\xff\x00", b"\xff")
        padded = np.zeros((blocks // 4, 8), np.uint8)
        padded[:, 3:] = np.frombuffer(scan, np.uint8)[: blocks // 4 * 5].reshape(-1, 5)
        packed = padded.view(">u8").ravel().astype(np.uint64)
        words = np.stack([packed >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()
        differences = _BACK[words.astype(np.int64)]
        if (differences == 9999).any():
            raise ValueError("damaged frame")
        levels = np.cumsum(differences)
    else:
        levels = _luma_levels(frame, rows, columns)
    return np.clip(np.rint(levels * quantiser / 8) + 128, 0, 255).astype(np.uint8)


def _luma_levels(frame: _Frame, rows: int, columns: int) -> np.ndarray:
    """DC levels of the first component's blocks, row by row, read symbol by symbol; each restart begins anew."""
    parts = frame.parts
    across, down = (1, 1) if len(parts) == 1 else (max(p[1] for p in parts), max(p[2] for p in parts))
    if len(parts) > 1 and parts[0][1:3] != (across, down):
        raise ValueError("unsupported: luma isn't the finest component")
    mcu_rows, mcu_columns = -(-rows // down), -(-columns // across)
    places = [(n, 1, 1) if len(parts) == 1 else (n, p[1], p[2]) for n, p in enumerate(parts)]
    codes = [(_codes(*frame.tables[tables >> 4]), _codes(*frame.tables[0x10 | tables & 15])) for _, tables in frame.scanned]
    grid = np.zeros((mcu_rows * down, mcu_columns * across), np.int64)
    total, done = mcu_rows * mcu_columns, 0
    for piece in re.split(rb"\xff[\xd0-\xd7]", frame.scan):
        reader = _Bits(piece.replace(b"\xff\x00", b"\xff"))
        levels = [0] * len(parts)
        for _ in range(min(total - done, frame.restart or total)):
            for n, h, v in places:
                for k in range(h * v):
                    levels[n] += reader.block(*codes[n])
                    if not n:
                        grid[done // mcu_columns * down + k // h, done % mcu_columns * across + k % h] = levels[0]
            done += 1
    if done < total:
        raise ValueError("damaged frame")
    return grid[:rows, :columns].ravel()


class _Bits:
    """A scan's bits, read symbol by symbol."""

    def __init__(self, scan: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in scan), 0

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("damaged frame")

    def block(self, dc: dict, ac: dict) -> int:
        """The difference of a block's DC level; its AC terms are passed over."""
        size, difference = self.symbol(dc), 0
        if size:
            value = int(self.bits[self.at : self.at + size], 2)
            self.at += size
            difference = value if value >> (size - 1) else value - (1 << size) + 1
        k = 1
        while k < 64:
            found = self.symbol(ac)
            if not found:
                break
            self.at += found & 15
            k += (found >> 4) + 1
        return difference


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI of motion-JPEG frames that hold payload, whose length is a positive multiple of ROW."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"payload must be a positive multiple of {ROW} bytes")
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // ROW
    count = -(-rows // ROWS)
    high = -(-rows // count)
    samples = np.concatenate([samples, np.zeros(count * high * ROW - len(samples), np.uint8)])
    frames = [encode_frame(samples[i * high * ROW : (i + 1) * high * ROW]) for i in range(count)]
    largest = max(map(len, frames))
    width, height = ROW * 8, high * 8
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, count, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, count, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    own = struct.pack("<Q", len(payload))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form) + _chunk(b"strd", own)))
    movie, index, at = [b"movi"], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movie.append(chunk)
        at += len(chunk)
    body = b"AVI " + header + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


@dataclass
class _File:
    """What the lists of an AVI file say; movies are the (start, end) of its movi lists, ours are offsets of OpenDML indexes."""

    movies: list[tuple[int, int]]
    index: list[tuple[bytes, int, int, int]]
    ours: list[int]
    streams: int = 0
    video: int | None = None
    codec: bytes = b""
    length: int | None = None
    rate: float = float(RATE)


def _walk(data: bytes, at: int, end: int, found: _File, depth: int = 0) -> None:
    if depth > DEEPEST:
        raise ValueError("lists within lists")
    for name, start, size in _chunks(data, at, end):
        stop = min(end, start + size)
        if name == b"LIST" and data[start : start + 4] == b"movi":
            found.movies.append((start, stop))
        elif name == b"LIST":
            _walk(data, start + 4, stop, found, depth + 1)
        elif name == b"strd" and size == 8:
            (found.length,) = struct.unpack("<Q", data[start : start + 8])
        elif name == b"strh":
            if data[start : start + 4] == b"vids" and found.video is None:
                scale, ticks = struct.unpack("<II", data[start + 20 : start + 28])
                if not scale or not ticks:
                    raise ValueError("no frame rate")
                found.video, found.rate, found.codec = found.streams, ticks / scale, data[start + 4 : start + 8]
            found.streams += 1
        elif name == b"indx" and found.video == found.streams - 1 and data[start + 3 : start + 4] == b"\x00":
            (entries,) = struct.unpack("<I", data[start + 4 : start + 8])
            found.ours += [struct.unpack("<Q", data[p : p + 8])[0] for p in range(start + 24, min(stop - 15, start + 24 + 16 * entries), 16)]
        elif name == b"idx1":
            found.index = list(struct.iter_unpack("<4sIII", data[start : start + min(size, stop - start) // 16 * 16]))


def _movie_frames(data: bytes, at: int, end: int, wanted: set[bytes], depth: int = 0) -> list[tuple[int, int]]:
    """(start, size) of the video's chunks of a movi list, those of its rec lists too."""
    if depth > DEEPEST:
        raise ValueError("lists within lists")
    out = []
    for name, start, size in _chunks(data, at, end):
        if name == b"LIST":
            out += _movie_frames(data, start + 4, min(end, start + size), wanted, depth + 1)
        elif name in wanted:
            out.append((start, size))
    return out


def _frame_places(data: bytes, found: _File) -> list[tuple[int, int]]:
    """(start, size) of each frame: by the OpenDML indexes, else by idx1 and the later movi lists, else by the movi lists alone."""
    wanted = {b"%02ddc" % found.video, b"%02ddb" % found.video}
    if found.ours:
        places = []
        for at in found.ours:
            longs, _, kind, entries, _, base = struct.unpack("<HBBI4sQ", data[at + 8 : at + 28])
            if longs != 2 or kind != 1:
                raise ValueError("unsupported: an index of fields")
            for p in range(at + 32, min(len(data) - 7, at + 32 + 8 * entries), 8):
                offset, size = struct.unpack("<II", data[p : p + 8])
                places.append((base + offset, size & 0x7FFFFFFF))
        return places
    own = [(at, size) for name, _, at, size in found.index if name in wanted]
    first, later = found.movies[0], found.movies[1:]
    if own:
        # Offsets count from the word movi, or in some files from the start of the file.
        at = own[0][0]
        shift = first[0] if data[first[0] + at : first[0] + at + 4] in wanted else 0
        places = [(shift + at + 8, size) for at, size in own]
    else:
        places, later = [], found.movies
    for start, end in later:
        places += _movie_frames(data, start + 4, end, wanted)
    return places


def read_avi(data: bytes) -> tuple[list[np.ndarray], int | None, float]:
    """Block levels of each frame of the first video stream, the payload's length if the file says it, and frames a second.

    ValueError says why a file can't be read: not an AVI file, no video, unsupported: ..., damaged ... An empty chunk repeats the frame before.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found = _File([], [], [])
    for name, start, size in _chunks(data, 0, len(data)):
        if name == b"RIFF" and data[start : start + 4] in (b"AVI ", b"AVIX"):
            _walk(data, start + 4, min(len(data), start + size), found)
    if found.video is None or not found.movies:
        raise ValueError("no video")
    if found.codec.upper() not in (b"MJPG", b"AVRN", b"LJPG", b"JPEG", bytes(4)):
        raise ValueError("unsupported: not motion-JPEG")
    frames = []
    for at, size in _frame_places(data, found):
        if size:
            frames.append(decode_frame(data[at : at + size]))
        elif frames:
            frames.append(frames[-1])
    return frames, found.length, found.rate


def shot_starts(frames: list[np.ndarray]) -> list[int]:
    """First frames of shots: where the histogram changes more than the frames before let expect."""
    starts, recent, last = [0] if frames else [], [], None
    for i, frame in enumerate(frames):
        histogram = np.bincount(frame >> 2, minlength=64) / max(1, len(frame))
        if last is not None:
            change = float(np.abs(histogram - last).sum() / 2)
            limit = max(LEAST, np.mean(recent) + DEVIATIONS * np.std(recent)) if recent else LEAST
            if change > limit:
                starts.append(i)
                recent = []
            else:
                recent = [*recent[1 - WINDOW :], change]
        last = histogram
    return starts


def timed_clips(frames: list[np.ndarray], rate: float) -> list[dict]:
    """first_frame, frames, start_s and end_s of each shot, numbered from 0."""
    starts = shot_starts(frames)
    return [{"clip": i, "first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate} for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)]))]


def payload_of(raw: bytes | None) -> bytes:
    """The text's bytes with zero bytes up to a positive multiple of ROW."""
    raw = raw or b""
    return raw + b"\x00" * (-len(raw) % ROW if raw else ROW)


def _described(raw: bytes | None) -> dict:
    media = write_avi(payload_of(raw))
    frames, length, rate = read_avi(media)
    back = np.concatenate(frames).tobytes()[:length]
    levels = np.frombuffer(back, np.uint8)
    counts = np.bincount(levels, minlength=256)
    share = counts[counts > 0] / len(levels)
    cut = timed_clips(frames, rate)
    feature = f"frames={len(frames)};shots={len(cut)};mean={levels.mean():.4f};distinct={len(share)};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"
    return {
        "n_bytes": len(raw or b""),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-64:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature,
        "clips": cut,
    }


_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
_CLIPS_KIND = "array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>"
_RESULT = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", _CLIPS)])


def describe_documents(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each input row: its text written as AVI and read back, as sizes, digests, features and timed clips.

    Null and empty texts are 64 zero bytes. Repeated rows and null ids are passed on, other columns ignored. No shuffle; a
    worker holds one text's file at a time.
    """
    ship(df.sparkSession)
    kind = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {_CLIPS_KIND}"
    described = arrow_column("media", lambda texts: pa.array([_described(raw) for raw in utf8_parts(texts)], _RESULT), kind)
    return df.select(F.col(id_column).alias("doc_id"), described(F.col(text_column)).alias("s")).select("doc_id", "s.*")


def store_documents(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, media): the AVI file of each text."""
    ship(df.sparkSession)
    stored = arrow_column("media", lambda texts: pa.array([write_avi(payload_of(raw)) for raw in utf8_parts(texts)], pa.binary()), "binary")
    return df.select(F.col(id_column).alias("doc_id"), stored(F.col(text_column)).alias("media"))


def _read(data: bytes | None) -> tuple[str, list[np.ndarray], float]:
    """(status, frames, rate) of a file: ok, no_file, or why it isn't read."""
    if data is None:
        return "no_file", [], 0.0
    try:
        frames, _, rate = read_avi(data)
        return "ok" if frames else "no frames", frames, rate
    except ValueError as why:
        return str(why), [], 0.0
    except (KeyError, IndexError, struct.error):
        return "damaged file", [], 0.0


_READ = pa.struct([("status", pa.string()), ("frames", pa.int32()), ("rate", pa.float64()), ("clips", _CLIPS)])


def read_media(df: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """A row for each file: doc_id, status, frames, rate, clips. status is ok, no_file for null, or says what of the file can't be read."""
    ship(df.sparkSession)

    def cut_into(files: pa.Array) -> pa.Array:
        out = []
        for data in files.to_pylist():
            status, frames, rate = _read(data)
            out.append({"status": status, "frames": len(frames), "rate": rate, "clips": timed_clips(frames, rate) if frames else []})
        return pa.array(out, _READ)

    found = arrow_column("media", cut_into, f"struct<status:string,frames:int,rate:double,clips:{_CLIPS_KIND}>")(F.col(media_column))
    return df.select(F.col(id_column).alias("doc_id"), found.alias("m")).select("doc_id", "m.*")


def clips(df: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """A row for each shot of each file: doc_id, clip, first_frame, frames, start_s, end_s.

    A null file and one that can't be read give no rows here; read_media() says why.
    """
    return read_media(df, id_column=id_column, media_column=media_column).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
