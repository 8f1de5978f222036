"""AVI motion-JPEG columns: writing bytes as intra frames, parsing, decoding, and shots.

A payload byte is stored as one quantised DCT coefficient of size category 8 (-255..-128, 128..255),
in baseline grey JPEG frames with a restart marker after each block, so that no rounding touches it.
Reading goes through the RIFF index and the JPEG entropy code. Frames are then decoded to samples,
and a new shot starts where the histogram differs by more than a threshold that follows the
differences before it.

Defined results: null is the empty payload, padded to 64 zero bytes; equal payloads make equal
files; damaged or unknown files raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa

from .common import mapped, texts, widened

#: Blocks of 8 x 8 in a frame at most: a frame is a strip of 8 lines.
BLOCKS = 64
FPS = 25
BINS = 16

# Fixed values of ITU-T T.81: the zigzag order of coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_CODE = bytes([0] * 7 + [1] + [0] * 8)  # one code, of eight bits


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _head(blocks: int) -> bytes:
    """A frame's markers up to the entropy-coded data."""
    return b"".join([
        b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * blocks, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + _CODE + b"\x08"), _segment(0xC4, b"\x10" + _CODE + b"\x08"), _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode_frame(payload: bytes) -> bytes:
    """A baseline JPEG of one coefficient for each byte; the length is a multiple of 64."""
    blocks = len(payload) // 64
    out = np.zeros((blocks, 130), np.uint8)
    out[:, 1:128:2] = np.frombuffer(payload, np.uint8).reshape(blocks, 64)
    out[:, 128] = 0xFF
    out[:, 129] = 0xD0 + np.arange(blocks) % 8
    if b"\xff" in payload:
        data = b"".join(row[:128].tobytes().replace(b"\xff", b"\xff\0") + row[128:].tobytes() for row in out)
    else:
        data = out.tobytes()
    return _head(blocks) + data[:-2] + b"\xff\xd9"


def _markers(jpeg: bytes) -> tuple[dict, int]:
    """Tables and sizes of a baseline grey JPEG, and where its entropy-coded data starts."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    info: dict = {"q": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4])
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                info["q"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC0:
            bits, info["height"], info["width"], parts = struct.unpack(">BHHB", body[:6])
            if bits != 8 or parts != 1:
                raise ValueError("only 8-bit grey frames are decoded")
            info["table"] = body[8]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                info["huff"][body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            info["restart"] = int.from_bytes(body[:2])
        elif marker == 0xDA:
            info["dc"], info["ac"] = body[2] >> 4, 16 + (body[2] & 15)
            return info, at
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
            raise ValueError("only baseline frames are decoded")
    raise ValueError("no scan in the JPEG")


def _lookup(table: tuple) -> dict:
    """(length, code) -> symbol of a canonical Huffman table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _decode_any(info: dict, data: bytes, blocks: int) -> np.ndarray:
    """Coefficients by the general rules of baseline entropy coding."""
    out, dc_codes, ac_codes = np.zeros((blocks, 64), np.int32), _lookup(info["huff"][info["dc"]]), _lookup(info["huff"][info["ac"]])
    runs, part, k = [], bytearray(), 0
    while k < len(data):
        if data[k] == 0xFF:
            if data[k + 1] == 0:
                part.append(0xFF)
            elif 0xD0 <= data[k + 1] <= 0xD7:
                runs.append(bytes(part))
                part = bytearray()
            else:
                break
            k += 2
        else:
            part.append(data[k])
            k += 1
    runs.append(bytes(part))
    block = 0
    for run in runs:
        bits, total, at, last = int.from_bytes(run), 8 * len(run), 0, 0

        def take(n: int, bits=bits, total=total) -> int:
            nonlocal at
            at += n
            if at > total:
                raise ValueError("the entropy-coded data ends early")
            return bits >> total - at & (1 << n) - 1

        def symbol(codes: dict) -> int:
            code = length = 0
            while length < 16:
                code, length = code << 1 | take(1), length + 1  # noqa: B023
                if (length, code) in codes:
                    return codes[length, code]
            raise ValueError("unknown Huffman code")

        def value(n: int) -> int:
            v = take(n) if n else 0  # noqa: B023
            return v if not n or v >> n - 1 else v - (1 << n) + 1

        for _ in range(info["restart"] or blocks):
            if block == blocks:
                break
            last += value(symbol(dc_codes))
            out[block, 0] = last
            place = 1
            while place < 64:
                s = symbol(ac_codes)
                if s == 0:
                    break
                place += s >> 4
                if s & 15:
                    if place > 63:
                        raise ValueError("coefficient past the block's end")
                    out[block, place] = value(s & 15)
                place += 1
            block += 1
    return out


def coefficients(jpeg: bytes) -> tuple[dict, np.ndarray]:
    """The frame's tables and its quantised coefficients in zigzag order, a row for each block."""
    info, at = _markers(jpeg)
    blocks = -(-info["width"] // 8) * -(-info["height"] // 8)
    one = (tuple(_CODE), (8,))
    size = blocks * 130 - 2
    data = jpeg[at:]
    if info["restart"] == 1 and info["huff"].get(info["dc"]) == one and info["huff"].get(info["ac"]) == one and data[size : size + 2] == b"\xff\xd9":
        rows = np.frombuffer(data[:size] + b"\xff" + bytes([0xD0 + (blocks - 1) % 8]), np.uint8).reshape(blocks, 130)
        if not rows[:, :128:2].any() and (rows[:, 128] == 0xFF).all() and not (rows[:, 1:128:2] == 0xFF).any():
            v = rows[:, 1:128:2].astype(np.int32)
            return info, np.where(v >= 128, v, v - 255)
    return info, _decode_any(info, data, blocks)


def payload_of(values: np.ndarray) -> bytes:
    """The bytes that coefficients of size category 8 hold."""
    if ((abs(values) < 128) | (abs(values) > 255)).any():
        raise ValueError("a coefficient outside size category 8 holds no payload")
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


_T = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)
_UNZIGZAG = np.argsort(ZIGZAG)


def samples(info: dict, values: np.ndarray) -> np.ndarray:
    """8-bit samples of each block, 64 a row, row by row."""
    f = (values.astype(np.float32) * info["q"][info["table"]])[:, _UNZIGZAG]
    rows = (f.reshape(-1, 8) @ _T).reshape(-1, 8, 8)
    both = (rows.transpose(0, 2, 1).reshape(-1, 8) @ _T).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.rint(both + 128), 0, 255).astype(np.uint8).reshape(-1, 64)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file whose frames hold the payload, a multiple of 64 bytes; INFO/ICMT holds its length."""
    blocks = min(BLOCKS, len(payload) // 64)
    step = 64 * blocks
    full = payload + b"\0" * (-len(payload) % step)
    frames = [encode_frame(full[k : k + step]) for k in range(0, len(full), step)]
    width, biggest = 8 * blocks, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, biggest * fps, 0, 0x10, len(frames), 0, 1, biggest, width, 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, width, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 8, b"MJPG", 64 * blocks, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + note + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> dict:
    """fps, payload (its length, None where no note says it), and frames: the indexed JPEGs in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"fps": None, "payload": None, "frames": []}
    movi, index = None, b""

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                else:
                    walk(body + 4, body + size)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                if data[body + 4 : body + 8] != b"MJPG":
                    raise ValueError("the video is not motion-JPEG")
                scale, rate = struct.unpack("<II", data[body + 20 : body + 28])
                out["fps"] = rate / scale
            elif name == b"ICMT" and data[body : body + 8] == b"payload=":
                out["payload"] = int(data[body + 8 : body + size].rstrip(b"\0"))
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + size % 2

    walk(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))
    if movi is None or out["fps"] is None or not index:
        raise ValueError("no frames or no index in the AVI file")
    for k in range(0, len(index) - 15, 16):
        _, offset, size = struct.unpack("<III", index[k + 4 : k + 16])
        if index[k + 2 : k + 4] in (b"dc", b"db"):
            start = movi + offset
            if data[start : start + 4] != index[k : k + 4]:
                raise ValueError("the index does not point at its chunk")
            out["frames"].append(data[start + 8 : start + 8 + size])
    return out


def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A shot starts where half the sum of absolute histogram differences exceeds the mean of up to
    `window` differences before it by `factor` standard deviations and by `least`.
    """
    share = histograms / np.maximum(1, histograms.sum(axis=1, keepdims=True))
    d = abs(np.diff(share, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for k, x in enumerate(d):
        past = d[max(0, k - window) : k]
        mean, spread = (past.mean(), past.std()) if len(past) else (0.0, 0.0)
        if x > mean + factor * spread + least:
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], len(histograms)]))


def probe(data: bytes) -> dict:
    """What the file holds: payload, histograms (a row for each frame), fps and shots."""
    avi = read_avi(data)
    parts, counts = [], []
    for jpeg in avi["frames"]:
        info, values = coefficients(jpeg)
        parts.append(payload_of(values))
        counts.append(np.bincount(samples(info, values).ravel() >> 4, minlength=BINS))
    payload = b"".join(parts)
    counts = np.array(counts)
    return {"payload": payload[: avi["payload"]], "histograms": counts, "fps": avi["fps"], "shots": shots(counts)}


def clips(df, media: str = "media"):
    """Timed clip rows of a column of AVI files: df's other columns with clip, first_frame, n_frames, start_s, end_s."""
    rest = [c for c in df.columns if c != media]
    names = ["clip", "first_frame", "n_frames", "start_s", "end_s"]

    def run(batches):
        for batch in batches:
            rows, cut = [], []
            for k, data in enumerate(batch.column(batch.schema.get_field_index(media)).to_pylist()):
                found = probe(data) if data else {"shots": [], "fps": 1}
                for j, (a, b) in enumerate(found["shots"]):
                    rows.append(k)
                    cut.append((j, a, b - a, a / found["fps"], b / found["fps"]))
            kept = batch.select(rest).take(pa.array(rows, pa.int64()))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([c[i] for c in cut], t) for i, t in enumerate(types)]], names=[*rest, *names])

    return mapped(df, run, widened(df, rest, "clip int, first_frame int, n_frames int, start_s double, end_s double"))


def with_media(df, text: str = "text"):
    """df's columns but the text, with media: the AVI file of the padded text, and n_bytes, its unpadded length."""
    rest = [c for c in df.columns if c not in (text, "media", "n_bytes")]

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                items = texts(part, text)
                files = [write_avi(padded(x)) for x in items]
                yield pa.RecordBatch.from_arrays([*part.select(rest).columns, pa.array([len(x) for x in items], pa.int64()), pa.array(files, pa.binary())], names=[*rest, "n_bytes", "media"])

    return mapped(df.select(*rest, text), run, widened(df, rest, "n_bytes long, media binary"))


def padded(x: bytes) -> bytes:
    return x + b"\0" * ((-len(x) % 64) or (0 if x else 64))


def digest(df, key: str = "doc_id", media: str = "media"):
    """Digest columns of stored files, each read back: see the query's contract."""
    def run(batches):
        for batch in batches:
            out = []
            for doc, n, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "n_bytes", media))):
                found = probe(data)
                p = found["payload"]
                mean = np.rint(1000 * found["histograms"].sum(axis=0) / max(1, found["histograms"].sum())).astype(int)
                feature = f"frames={len(found['histograms'])};shots={','.join(f'{a}-{b}' for a, b in found['shots'])};hist={','.join(map(str, mean))}"
                out.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            types = [batch.schema.field(key).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    new = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return mapped(df.select(key, "n_bytes", media), run, widened(df, [key], new))
