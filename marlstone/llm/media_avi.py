"""AVI motion-JPEG media: lossless storage, index parsing, intra-frame decoding, shot detection."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents

#: A frame is 32 x 32 grey pixels: 16 blocks of 64 coefficients, one payload byte each.
SIDE = 32
BLOCKS = (SIDE // 8) ** 2
FRAME = BLOCKS * 64
FPS = 25
#: Histogram bins, frames on both sides of a cut that its threshold adapts to, and its factors.
BINS, AROUND, FACTOR, FLOOR = 32, 6, 1.5, 0.25

# The zigzag order of the coefficients of a block in baseline JPEG.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

# A byte b is the coefficient b + 1 if b < 128, else 127 - b: never 0, so no run of zeros occurs
# and every coefficient is one symbol of its size in bits. The Huffman code of size s takes
# DC_BITS - s or AC_BITS - s bits, hence any coefficient takes the same number of bits in all.
DC_BITS, AC_BITS = 10, 9
_COEFFICIENT = np.array([b + 1 if b < 128 else 127 - b for b in range(256)], np.int16)


def _word(value: int, width: int) -> int:
    size = abs(value).bit_length()
    code = (1 << (width - size)) - 2  # ones and a final zero, as canonical codes of falling size are
    return code << size | (value if value > 0 else value + (1 << size) - 1)


_DC = np.array([_word(v, DC_BITS) for v in range(-256, 257)], ">u2")
_AC = np.array([_word(int(v), AC_BITS) for v in _COEFFICIENT], ">u2")
_DC_BACK = np.zeros(1 << DC_BITS, np.int32)
_DC_BACK[_DC.astype(int)] = np.arange(-256, 257)
_AC_BACK = np.zeros(1 << AC_BITS, np.int16)
_AC_BACK[_AC.astype(int)] = _COEFFICIENT
_BYTE = np.zeros(512, np.uint8)
_BYTE[_COEFFICIENT + 256] = np.arange(256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, sizes: range, width: int) -> bytes:
    """A Huffman table with one symbol of each length from 1 up, the largest size first."""
    symbols = sorted(sizes, reverse=True)
    counts = [1 if any(width - s == n for s in symbols) else 0 for n in range(1, 17)]
    return _segment(0xC4, bytes([kind, *counts, *symbols]))


HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _table(0x00, range(0, 10), DC_BITS) + _table(0x10, range(1, 9), AC_BITS) + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def _bits(words: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(*words.shape, 2), axis=-1)[..., 16 - width :]


def _numbers(bits: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((*bits.shape[:-1], 16), np.uint8)
    full[..., 16 - width :] = bits
    return np.packbits(full, axis=-1).view(">u2")[..., 0]


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG images whose quantised coefficients are the payload's bytes; the last is filled with zeros."""
    data = np.frombuffer(payload + b"\0" * (-len(payload) % FRAME), np.uint8).reshape(-1, BLOCKS, 64)
    dc = _COEFFICIENT[data[:, :, 0]].astype(np.int32)
    step = np.diff(dc, axis=1, prepend=0)
    first = _bits(_DC[step + 256], DC_BITS)
    rest = _bits(_AC[data[:, :, 1:]], AC_BITS).reshape(*data.shape[:2], 63 * AC_BITS)
    bits = np.concatenate([first, rest], axis=2).reshape(len(data), -1)
    scans = np.packbits(bits, axis=1)  # 16 blocks of 577 bits end at a byte
    return [HEAD + s.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for s in scans]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames, with an index and the payload's length as a comment."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    index, at = [], 4
    for f, c in zip(frames, chunks, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(media: bytes) -> tuple[list[bytes], int | None, float]:
    """(frames, payload length if the comment has it, frames a second), by the file's own index.

    A file without an index is read chunk by chunk. Chunks that run past the end are cut.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, list[tuple[int, int]]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            stop = min(end, at + 8 + size)
            if name == b"LIST":
                found.setdefault(media[at + 8 : at + 12], []).append((at + 8, stop))
                if media[at + 8 : at + 12] != b"movi" or b"idx1" not in media[stop : stop + 8]:
                    walk(at + 12, stop)
            else:
                found.setdefault(name, []).append((at + 8, stop))
            at = stop + size % 2

    walk(12, len(media))
    length = next((int(media[a:b].split(b"=")[1]) for a, b in found.get(b"ICMT", []) if media[a:b].startswith(b"payload=")), None)
    rate = next((1e6 / max(1, struct.unpack_from("<I", media, a)[0]) for a, _ in found.get(b"avih", [])), float(FPS))
    if b"idx1" in found and b"movi" in found:
        base, (a, b) = found[b"movi"][0][0], found[b"idx1"][0]
        entries = [struct.unpack_from("<4sIII", media, i) for i in range(a, b - 15, 16)]
        frames = [media[base + at + 8 : base + at + 8 + size] for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    else:
        frames = [media[a:b] for name, spans in found.items() if name[2:] in (b"dc", b"db") for a, b in spans]
    return frames, length, rate


def _read_head(jpeg: bytes) -> tuple[dict, int]:
    """Tables and size of a baseline grey image, and where its scan starts."""
    got: dict = {"q": {}, "h": {}}
    at = 2
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xDB:
            got["q"][body[0] & 15] = np.frombuffer(body, np.uint8, 64, 1).astype(np.int32)
        elif marker == 0xC0:
            got["height"], got["width"], got["parts"] = struct.unpack_from(">HHB", body, 1)
            got["quant"] = body[8]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                got["h"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDA:
            got["tables"] = (body[2] >> 4, 0x10 | body[2] & 15)
            return got, at + 2 + size
        elif marker in (0xC1, 0xC2, 0xDD):
            raise ValueError("only baseline images without restarts are read")
        at += 2 + size


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    counts, symbols = table
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _decode_any(scan: bytes, head: dict, blocks: int) -> np.ndarray:
    """Coefficients of any baseline grey scan, symbol by symbol."""
    dc, ac = (_codes(head["h"][t]) for t in head["tables"])
    bits, at = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0

    def symbol(table: dict) -> int:
        nonlocal at
        code = length = 0
        while True:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
            if (length, code) in table:
                return table[length, code]

    def value(size: int) -> int:
        nonlocal at
        v = 0
        for b in bits[at : at + size]:
            v = v << 1 | b
        at += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    out, last = np.zeros((blocks, 64), np.int32), 0
    for block in out:
        last += value(symbol(dc))
        block[0], k = last, 1
        while k < 64:
            run, size = divmod(symbol(ac), 16)
            if not size and run != 15:
                break
            k += run
            if size:
                block[k] = value(size)
            k += 1
    return out


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Quantised coefficients of all frames in zigzag order, (frames, blocks, 64).

    Frames with this module's tables have blocks of equal length in bits and are read together.
    """
    if all(f.startswith(HEAD) for f in frames):
        scans = b"".join(f[len(HEAD) : -2].replace(b"\xff\0", b"\xff") for f in frames)
        bits = np.unpackbits(np.frombuffer(scans, np.uint8)).reshape(len(frames), BLOCKS, -1)
        dc = np.cumsum(_DC_BACK[_numbers(bits[..., :DC_BITS], DC_BITS)], axis=1)
        ac = _AC_BACK[_numbers(bits[..., DC_BITS:].reshape(len(frames), BLOCKS, 63, AC_BITS), AC_BITS)]
        return np.concatenate([dc[..., None].astype(np.int16), ac], axis=2)
    out = []
    for f in frames:
        head, at = _read_head(f)
        if head["parts"] != 1:
            raise ValueError("only grey images are read")
        blocks = -(-head["width"] // 8) * -(-head["height"] // 8)
        out.append(_decode_any(f[at : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff"), head, blocks))
    return np.array(out)


_K = np.arange(8)
_DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)


def pixels(coefficients: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """Grey values of the blocks, by the inverse cosine transform."""
    flat = np.zeros((coefficients.shape[0] * coefficients.shape[1], 64), np.float32)
    flat[:, ZIGZAG] = coefficients.reshape(-1, 64) * (1 if quant is None else quant)
    rows = (flat.reshape(-1, 8) @ _DCT).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _DCT
    return np.clip(np.rint(rows + 128), 0, 255).astype(np.uint8).reshape(coefficients.shape)


def histograms(grey: np.ndarray, filled: int | None = None) -> np.ndarray:
    """Shares of the grey values of each frame in BINS bins; of the last frame, ``filled`` blocks count."""
    n = len(grey)
    at = (grey.reshape(n, -1) >> 3).astype(np.int64) + np.arange(n)[:, None] * BINS
    used = at.reshape(-1)[: (n - 1) * grey[0].size + (filled or grey.shape[1]) * 64]
    counts = np.bincount(used, minlength=n * BINS).reshape(n, BINS)
    return counts / counts.sum(1, keepdims=True)


def shots(shares: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, one past the last) of each shot.

    A cut is a histogram difference above FLOOR and above FACTOR times the mean of the AROUND
    differences on both sides of it, so a restless passage needs a larger jump.
    """
    step = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    total = np.r_[0, np.cumsum(step)]
    k = np.arange(len(step))
    low, high = np.maximum(k - AROUND, 0), np.minimum(k + AROUND + 1, len(step))
    mean = (total[high] - total[low] - step) / np.maximum(high - low - 1, 1)
    cuts = np.flatnonzero((step > FLOOR) & (step > FACTOR * mean)) + 1
    edges = [0, *cuts.tolist(), len(shares)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def read_back(media: bytes) -> tuple[bytes, list[tuple[int, float, float, int]]]:
    """(payload, clips): clips are (number, start, end in seconds, busiest bin of the first frame)."""
    frames, length, rate = parse_avi(media)
    coefficients = decode_frames(frames)
    payload = _BYTE[coefficients + 256].tobytes()
    shares = histograms(pixels(coefficients), None if length is None else -(-length // 64) - (len(frames) - 1) * BLOCKS)
    clips = [(k, a / rate, b / rate, int(shares[a].argmax())) for k, (a, b) in enumerate(shots(shares))]
    return payload[:length], clips


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(id, n_bytes, payload digest, media digest, clips, media) of every document; media is null unless it is kept.

    The payload is the whole text in UTF-8 (null: empty), filled with zeros to a positive multiple
    of 64. It is stored as the quantised coefficients of grey JPEG frames in an AVI file, read
    back by the file's index, and its frames are decoded to pixels for shot detection. Every
    document is worked on alone, a group of a batch at a time; equal texts give equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            low = held = 0
            for k, t in enumerate(batch.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                media = write_avi(raw + b"\0" * (64 - len(raw) if len(raw) < 64 else -len(raw) % 64))
                payload, clips = read_back(media)
                rows.append((
                    len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                    [{"clip": c[0], "start_s": c[1], "end_s": c[2], "bin": c[3]} for c in clips], media if keep else None,
                ))
                held += len(media)
                if held > 8 << 20 or k == batch.num_rows - 1:
                    columns = [pa.array(x, ty) for x, ty in zip(zip(*rows, strict=True), KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows)), *columns], ["id", *NAMES])
                    rows, low, held = [], k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(
        run,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "clips array<struct<clip:int,start_s:double,end_s:double,bin:int>>, media binary",
    )


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "media"]
KINDS = [
    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
    pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("bin", pa.int32())])), pa.binary(),
]


def clip_rows(stored: DataFrame) -> DataFrame:
    """One row per clip: (id, clip, start_s, end_s, bin)."""
    return stored.select("id", F.explode("clips").alias("c")).select("id", "c.*")


def op8_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as AVI files and read back, with their digests and timed clips."""
    stored = store(documents(spark, sf_dir), keep=False)
    clip = F.transform("clips", lambda c: F.format_string("%.2f-%.2f:%d", c["start_s"], c["end_s"], c["bin"]))
    return stored.select(F.col("id").alias("doc_id"), *NAMES[:6], F.array_join(clip, ",").alias("feature"))
