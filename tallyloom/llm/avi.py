"""AVI motion-JPEG columns: payloads stored losslessly as quantised DCT coefficients, RIFF indexes, intra frames, shots and timed clips.

A payload (the text's UTF-8 bytes, zeros added up to a positive multiple of 64) fills 8x8 blocks, a byte per coefficient in zigzag order, 16 blocks to a frame of 32x32
pixels at 25 frames a second. Byte b is the coefficient whose 8 value bits in the stream are b (b from 128 on, else b - 255), so all have size 8, the one
symbol of both Huffman tables, with a code of 8 bits. The predictor restarts with each block. These are ordinary baseline JPEG files in an ordinary AVI file with an idx1
index; the payload's length is in a comment of its INFO list, since the last frame is filled up with zeros.

Reading goes by the RIFF structure and idx1. Every frame is entropy-decoded by the Huffman tables of its own header, dequantised and inverse-transformed; all restart
intervals of a batch's frames are read side by side. Frames of other baseline JPEG encoders, grey or coloured in one scan, are decoded by the same code.

Shots: a frame starts a new shot if the distance of its luminance histogram (16 bins of decoded samples) to that of the frame before exceeds 0.1 and the mean plus one and a half standard
deviations of the distances up to 8 frames around. Each shot is a clip row with its times.

Null and empty texts have a payload of 64 zeros. Equal texts have equal media. Repeated rows give equal rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

BLOCK, PER_FRAME, EDGE, RATE = 64, 16, 32, 25
FRAME = BLOCK * PER_FRAME
REACH, BINS, LEAST_JUMP = 8, 16, 0.1
#: Bytes of frames that are decoded at a time.
TOGETHER = 4 << 20


def payload_of(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


ONE_CODE = bytes(8 * [0])[:7] + b"\x01" + bytes(8) + b"\x08"  # one code of 8 bits, for size 8
HEADER = b"\xff\xd8" + segment(0xDB, b"\x00" + b"\x01" * 64) + segment(0xC0, struct.pack(">BHHB3B", 8, EDGE, EDGE, 1, 1, 0x11, 0)) + segment(0xC4, b"\x00" + ONE_CODE) + segment(0xC4, b"\x10" + ONE_CODE) + segment(0xDD, b"\x00\x01") + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
MARKS = np.array([[0xFF, 0xD0 + i % 8] for i in range(PER_FRAME - 1)] + [[0xFF, 0xD9]], dtype=np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload, whose length is a positive multiple of 64."""
    data = np.frombuffer(payload + bytes(-len(payload) % FRAME), dtype=np.uint8).reshape(-1, PER_FRAME, BLOCK)
    scan = np.zeros((len(data), PER_FRAME, 2 * BLOCK + 2), dtype=np.uint8)
    scan[:, :, 1 : 2 * BLOCK : 2] = data
    scan[:, :, 2 * BLOCK :] = MARKS
    if (data == 0xFF).any():  # a zero is stuffed behind each 0xFF
        frames = [HEADER + b"".join(bytes(b[:-2]).replace(b"\xff", b"\xff\x00") + bytes(b[-2:]) for b in f) for f in scan]
        chunks = [chunk(b"00dc", f) for f in frames]
        movi, sizes = b"".join(chunks), np.array([len(f) for f in frames])
    else:
        size = len(HEADER) + PER_FRAME * (2 * BLOCK + 2)
        head = np.frombuffer(b"00dc" + struct.pack("<I", size) + HEADER, dtype=np.uint8)
        tail = np.zeros((len(data), size % 2), dtype=np.uint8)
        movi = np.hstack([np.broadcast_to(head, (len(data), len(head))), scan.reshape(len(data), -1), tail]).tobytes()
        sizes = np.full(len(data), size)
    starts = 4 + np.cumsum(8 + sizes + sizes % 2) - (8 + sizes + sizes % 2)
    index = np.zeros((len(data), 4), dtype="<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, starts, sizes
    n = len(data)
    avih = struct.pack("<14I", 1_000_000 // RATE, int(sizes.max()) * RATE, 0, 0x10, n, 0, 1, int(sizes.max()), EDGE, EDGE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, int(sizes.max()), 0xFFFFFFFF, 0, 0, 0, EDGE, EDGE)
    strf = struct.pack("<IiiHH4sIiiII", 40, EDGE, EDGE, 1, 24, b"MJPG", EDGE * EDGE * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload %d\x00" % len(payload)))
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index.tobytes()))


def chunks(raw: memoryview, start: int, end: int):
    while start + 8 <= end:
        size = struct.unpack_from("<I", raw, start + 4)[0]
        yield bytes(raw[start : start + 4]), start + 8, min(size, end - start - 8)
        start += 8 + size + size % 2


def index_of(media: bytes) -> tuple[np.ndarray, np.ndarray, float, int | None]:
    """Offsets and sizes of the frames by idx1, frames a second, and the payload's length if the file tells it."""
    raw = memoryview(media)
    if len(raw) < 12 or bytes(raw[:4]) != b"RIFF" or bytes(raw[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    movi, rows, rate, length = 0, np.zeros((0, 4), np.uint32), float(RATE), None
    for name, at, size in chunks(raw, 12, len(raw)):
        if name == b"LIST":
            kind = bytes(raw[at : at + 4])
            if kind == b"movi":
                movi = at
            for inner, a, n in chunks(raw, at + 4, at + size) if kind in (b"hdrl", b"INFO") else ():
                if inner == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", raw, a)[0])
                elif inner == b"ICMT" and bytes(raw[a : a + 8]) == b"payload ":
                    length = int(bytes(raw[a + 8 : a + n]).rstrip(b"\x00"))
        elif name == b"idx1":
            rows = np.frombuffer(raw[at : at + size - size % 16], dtype="<u4").reshape(-1, 4)
    rows = rows[(rows[:, 0] & 0xFFFF0000) == int.from_bytes(b"\x00\x00dc", "little")]
    return movi + rows[:, 2].astype(np.int64) + 8, rows[:, 3].astype(np.int64), rate, length


@dataclass(frozen=True)
class Head:
    """What a frame's header tells: size, restart interval, tables and, for each block of an MCU, its component."""

    length: int
    high: int
    wide: int
    restart: int
    parts: tuple[tuple[int, int], ...]  # of each component, blocks across and down in an MCU
    quantisers: tuple[np.ndarray, ...]  # of each component, in zigzag order
    dc: tuple[np.ndarray, ...]  # of each component, by 16 bits: code length * 256 + symbol
    ac: tuple[np.ndarray, ...]

    @property
    def mcus(self) -> tuple[int, int]:
        if len(self.parts) == 1:
            return -(-self.high // 8), -(-self.wide // 8)
        across, down = max(h for h, _ in self.parts), max(v for _, v in self.parts)
        return -(-self.high // (8 * down)), -(-self.wide // (8 * across))

    @property
    def pattern(self) -> list[int]:
        return [0] if len(self.parts) == 1 else [c for c, (h, v) in enumerate(self.parts) for _ in range(h * v)]


def code_table(counts: bytes, values: bytes) -> np.ndarray:
    table, at, k = np.zeros(65536, dtype=np.int64), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            table[at : at + (1 << (16 - bits))] = bits << 8 | values[k]
            at, k = at + (1 << (16 - bits)), k + 1
    return table


def head_end(jpeg: bytes) -> int:
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    return at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")


def head_of(jpeg: bytes) -> Head:
    at, quantisers, codes, restart, frame = 2, {}, {}, 0, None
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            frame = body
        elif marker == 0xDA:
            break
    high, wide, n = struct.unpack_from(">HHB", frame, 1)
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    parts = [(frame[6 + 3 * i], frame[7 + 3 * i], frame[8 + 3 * i]) for i in range(n)]
    if len(tables) != n:
        raise ValueError("only frames of one scan are read")
    return Head(at, high, wide, restart, tuple((s >> 4, s & 15) for _, s, _ in parts), tuple(quantisers[q] for _, _, q in parts), tuple(codes[tables[c] >> 4] for c, _, _ in parts), tuple(codes[0x10 | tables[c] & 15] for c, _, _ in parts))


def entropy_decode(scans: list[bytes], head: Head) -> np.ndarray:
    """Frames x blocks (in the order of the scan) x 64 quantised coefficients in zigzag order, of frames with one header.

    All restart intervals of all frames are read side by side: each step takes the next coefficient of every interval."""
    raw = np.frombuffer(b"".join(scans), dtype=np.uint8)
    begins = np.cumsum([0, *map(len, scans)])[:-1]
    full = np.flatnonzero(raw[:-1] == 0xFF)
    behind = raw[full + 1]
    keep = np.ones(len(raw), dtype=bool)
    keep[full[behind == 0] + 1] = False  # zeros stuffed behind 0xFF
    marks = full[(behind >= 0xD0) & (behind <= 0xD9)]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    restarts = marks[(raw[marks + 1] <= 0xD7)] + 2
    starts = np.sort(np.concatenate([begins, restarts]))
    data = np.append(raw[keep], np.zeros(8, np.uint8)).astype(np.uint64)
    words = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | data[k : len(data) - 7 + k]
    pattern, mcus = head.pattern, head.mcus[0] * head.mcus[1]
    per_frame, each = mcus * len(pattern), (head.restart or mcus) * len(pattern)
    frame = np.searchsorted(begins, starts, side="right") - 1
    first = np.arange(len(starts)) - np.searchsorted(starts, begins)[frame]  # number of the interval in its frame
    left = np.minimum(per_frame - first * each, each)  # blocks of each interval
    row = frame * per_frame + first * each
    out = np.zeros((len(scans) * per_frame, 64), dtype=np.int32)
    at = place[starts] * 8
    last = np.zeros((len(starts), len(head.parts)), dtype=np.int64)
    one = np.int64(1)

    def take(bit: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next symbol and value, and the place behind them."""
        held = (words[bit >> 3] >> (32 - (bit & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF
        found = table[held >> 16]
        size, bits = found & 15, found >> 8
        value = held >> (32 - bits - size) & (one << size) - 1
        value = np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), value - (one << size) + 1, value)
        return found & 255, value, bit + bits + size

    for j in range(each):
        c = pattern[j % len(pattern)]
        own = np.flatnonzero(j < left)
        _, value, bit = take(at[own], head.dc[c])
        last[own, c] += value
        to = (row[own] + j) * 64
        flat = out.reshape(-1)
        flat[to] = last[own, c]
        k, turn = np.ones(len(own), dtype=np.int64), np.arange(len(own))
        ends = bit.copy()
        while len(turn):
            symbol, value, bit = take(bit, head.ac[c])
            k += symbol >> 4
            some = (symbol & 15) > 0
            if some.all():
                flat[to + k] = value
            else:
                flat[(to + k)[some]] = value[some]
            k += 1
            go = (symbol != 0) & (k < 64)
            if not go.all():
                ends[turn[~go]] = bit[~go]
                bit, k, to, turn = bit[go], k[go], to[go], turn[go]
        at[own] = ends
    return out.reshape(len(scans), per_frame, 64)


def cosines() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: samples of a block, row by row."""
    place = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    wave = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    return np.array([np.outer(wave[u], wave[v]).ravel() for u, v in place], dtype=np.float32)


COSINES = cosines()


def pixels(coefficients: np.ndarray, head: Head) -> np.ndarray:
    """Frames x luminance samples (8 bits), block by block, without those beyond the frame's edges."""
    n, pattern = len(coefficients), head.pattern
    down, across = head.mcus
    own = [i for i, c in enumerate(pattern) if c == 0]
    blocks = coefficients.reshape(n, down * across, len(pattern), 64)[:, :, own].reshape(-1, 64)
    levels = blocks.astype(np.float32) @ (head.quantisers[0][:, None] * COSINES)
    levels = np.clip(np.rint(levels) + 128, 0, 255).astype(np.uint8).reshape(n, -1)
    h, v = head.parts[0] if len(pattern) > 1 else (1, 1)
    if head.high == down * v * 8 and head.wide == across * h * 8:
        return levels
    mcu, block, y, x = np.unravel_index(np.arange(levels.shape[1]), (down * across, h * v, 8, 8))
    inside = ((mcu // across * v + block // h) * 8 + y < head.high) & ((mcu % across * h + block % h) * 8 + x < head.wide)
    return levels[:, inside]


@dataclass
class Film:
    """What is read back of a file: its payload, frames a second, histograms (frames x BINS) and mean level of each frame."""

    payload: bytes
    rate: float
    bins: np.ndarray
    level: np.ndarray


def films(files: list[bytes]) -> list[Film]:
    """Files as read back; frames with equal headers are decoded together, up to TOGETHER bytes at a time."""
    indexes = [index_of(m) for m in files]
    jpegs = [m[a : a + n] for m, (at, size, _, _) in zip(files, indexes, strict=True) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    heads, of = {}, []
    for x in jpegs:
        key = x[: head_end(x)]
        if key not in heads:
            heads[key] = head_of(x)
        of.append(heads[key])
    stored, bins, level = [b""] * len(jpegs), np.zeros((len(jpegs), BINS), np.int64), np.zeros(len(jpegs))
    for head in set(map(id, of)):
        numbers = [i for i, h in enumerate(of) if id(h) == head]
        head = of[numbers[0]]
        size = np.cumsum([len(jpegs[i]) for i in numbers]) // TOGETHER
        for part in np.split(np.array(numbers), np.flatnonzero(np.diff(size)) + 1):
            found = entropy_decode([jpegs[i][head.length :] for i in part], head)
            data = np.where(found < 0, found + 255, found).astype(np.uint8).reshape(len(part), -1)
            seen = pixels(found, head)
            width = seen.shape[1]
            bins[part] = np.bincount(np.repeat(np.arange(len(part)) * BINS, width) + (seen >> 4).ravel(), minlength=len(part) * BINS).reshape(-1, BINS)
            level[part] = seen.mean(axis=1)
            for i, row in zip(part.tolist(), data, strict=True):
                stored[i] = row.tobytes()
    ends = np.cumsum([0] + [len(at) for at, *_ in indexes])
    return [Film(b"".join(stored[a:b])[:length], rate, bins[a:b], level[a:b]) for a, b, (_, _, rate, length) in zip(ends, ends[1:], indexes)]


def read_back(media: bytes) -> bytes:
    return films([media])[0].payload


def shots(bins: np.ndarray) -> np.ndarray:
    """First frames of the shots, by the histograms of the frames' samples."""
    n = len(bins)
    if n < 2:
        return np.zeros(min(n, 1), dtype=np.int64)
    jump = np.abs(np.diff(bins, axis=0)).sum(axis=1) / np.maximum(1, bins[1:].sum(axis=1) + bins[:-1].sum(axis=1))
    sums, squares = np.append(0, np.cumsum(jump)), np.append(0, np.cumsum(jump * jump))
    lo, hi = np.maximum(0, np.arange(n - 1) - REACH), np.minimum(n - 1, np.arange(n - 1) + REACH + 1)
    mean = (sums[hi] - sums[lo]) / (hi - lo)
    spread = np.sqrt(np.maximum(0, (squares[hi] - squares[lo]) / (hi - lo) - mean * mean))
    return np.append(0, 1 + np.flatnonzero((jump > LEAST_JUMP) & (jump > mean + 1.5 * spread)))


def clip_rows(film: Film) -> list[tuple[int, float, float, int, float]]:
    """clip, start_s, end_s, n_frames, mean_level."""
    first = shots(film.bins)
    last = np.append(first[1:], len(film.bins))
    return [(i, float(round(a / film.rate, 6)), float(round(b / film.rate, 6)), int(b - a), round(float(film.level[a:b].mean()), 6)) for i, (a, b) in enumerate(zip(first, last, strict=True))]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the AVI file)."""

    def work(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array([encode(payload_of(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), "doc_id long, n_bytes long, media binary", work)


def clips(stored: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, n_frames, mean_level: a row for each shot of each file."""

    def work(batches):
        for b in batches:
            rows = [(d, *r) for d, m in zip(b.column(0).to_pylist(), films(b.column(1).to_pylist()), strict=True) for r in clip_rows(m)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))], ["doc_id", "clip", "start_s", "end_s", "n_frames", "mean_level"])

    return in_arrow(stored.select("doc_id", "media"), "doc_id long, clip int, start_s double, end_s double, n_frames long, mean_level double", work)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long, clips string"


def digests(docs: DataFrame) -> DataFrame:
    """The columns of DIGESTS: each text is stored, read back and described in its task. clips are start-end in seconds, joined by commas."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in DIGESTS.split(", ")]

    def described(doc_id: int, text: bytes | None, media: bytes, film: Film) -> tuple:
        clips, back = clip_rows(film), film.payload
        feature = f"frames={len(film.bins)};seconds={len(film.bins) / film.rate:g};mean={film.level.mean():.3f};levels={','.join(map(str, film.bins.sum(axis=0).tolist()))}"
        return (doc_id, len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(clips), ",".join(f"{a:g}-{e:g}" for _, a, e, _, _ in clips))

    def work(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            files = [encode(payload_of(x)) for x in texts]
            rows = list(map(described, ids, texts, files, films(files)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), DIGESTS, work)
