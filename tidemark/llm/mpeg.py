"""MPEG audio columns: a payload carried in Layer III frames, and a reader for MPEG audio streams.

The writer puts an ID3v2.4 tag (the payload's length), a Xing frame (frame and byte counts, seek table) and protected frames, each with
its CRC-16; a payload's bytes take the place of the frames' main data. The reader knows MPEG-1, 2 and 2.5, Layers I to III, one channel
or two. It resynchronises on frame headers, parses ID3v2.2 to 2.4 and skips ID3v1 tags, reads variable-bitrate tables (Xing, Info, VBRI),
verifies checksums and returns exact durations and frame offsets. Frames of free bit rate, whose headers don't tell their size, are skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded, map_texts, pick

#: Bit rates (kbit/s) by index from 1, by layer, of MPEG-1 and of the lower sample rates; sample rates of MPEG-1.
BIT_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
#: Bits of allocation by subband of Layer II, as (bits, subbands): at lower sample rates, and at rates by channel of MPEG-1.
ALLOCATION = {"low": ((4, 4), (3, 7), (2, 19)), "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10))}
SIDE = 32  # bytes of side information of what the writer makes: MPEG-1, two channels
HEAD = 4 + 2 + SIDE  # header, CRC and side information


class Header(NamedTuple):
    """A frame's header: version 1, 2 or 3 (2.5), layer, CRC or none, kbit/s, samples by second, size in bytes, samples, channels, bytes of side information, first joint subband."""

    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    channels: int
    side: int
    bound: int


@lru_cache(maxsize=4096)
def read_header(b: bytes) -> Header | None:
    """The header of four bytes; None if they are none, or have a free bit rate."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 3}.get(b[1] >> 3 & 3), 4 - (b[1] >> 1 & 3)
    index, fs, padding, mode = b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1, b[3] >> 6
    if version is None or layer == 4 or index in (0, 15) or fs == 3:
        return None
    kbps, rate = BIT_RATES[min(version, 2), layer][index - 1], SAMPLE_RATES[fs] >> version - 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    size = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples * 125 * kbps // rate + padding
    channels = 1 if mode == 3 else 2
    side = (0 if layer < 3 else 32 if version == 1 and channels == 2 else 9 if version > 1 and channels == 1 else 17)
    return Header(version, layer, not b[1] & 1, kbps, rate, size, samples, channels, side, 4 * (1 + (b[3] >> 4 & 3)) if mode == 1 else 32)


def frame_bytes(index: int, rate: int, padding: int) -> int:
    """Size of an MPEG-1 Layer III frame."""
    return 144000 * BIT_RATES[1, 3][index - 1] // SAMPLE_RATES[rate] + padding


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(bits: str) -> int:
    """The same over a string of 0 and 1."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ 0x8005 if crc >> 15 != int(bit) else crc << 1) & 0xFFFF
    return crc


def allocation_bits(h: Header, data: bytes) -> str:
    """What the checksum of a Layer I or II frame covers after the header: allocation, and in Layer II the selection of scale factors."""
    bits = "".join(f"{x:08b}" for x in data)
    if h.layer == 1:
        return bits[: 4 * (h.channels * min(h.bound, 32) + 32 - min(h.bound, 32))] if h.channels == 2 else bits[:128]
    each = h.kbps // h.channels
    kind = "low" if h.version > 1 else ("d" if h.rate == 32000 else "c") if each < 56 else "b" if each > 80 and h.rate != 48000 else "a"
    at = selected = 0
    for band, n in enumerate(n for n, count in ALLOCATION[kind] for _ in range(count)):
        for _ in range(h.channels if band < h.bound else 1):
            used = "1" in bits[at : at + n]
            selected += used * (h.channels if band >= h.bound else 1)
            at += n
    return bits[: at + 2 * selected]


def checked(h: Header, data: bytes, at: int) -> bool:
    """Whether the checksum of the protected frame there holds."""
    told = data[at + 4 : at + 6]
    if h.layer == 3:
        return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(told, "big")
    return crc16_bits(f"{data[at + 2]:08b}{data[at + 3]:08b}" + allocation_bits(h, data[at + 6 : at + 6 + 96])) == int.from_bytes(told, "big")


def header(index: int, rate: int = 1, padding: int = 0) -> bytes:
    """Sync word, MPEG-1, Layer III, protected, stereo."""
    return bytes([0xFF, 0xFA, index << 4 | rate << 2 | padding << 1, 0x00])


@lru_cache(maxsize=64)
def frame_start(index: int, rate: int = 1) -> bytes:
    h, side = header(index, rate), bytes(SIDE)
    return h + crc16(h[2:] + side).to_bytes(2, "big") + side


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        frame = b"\x03" + k.encode() + b"\x00" + v.encode()
        body += b"TXXX" + _synchsafe(len(frame)) + b"\x00\x00" + frame
    return b"ID3\x04\x00\x00" + _synchsafe(len(body)) + body


BIG = len(BIT_RATES[1, 3])
ROOM = frame_bytes(BIG, 1, 0) - HEAD


def encode(payload: bytes) -> bytes:
    """A stream that carries the payload: full frames at the highest rate, the rest in the smallest frame that holds it."""
    full = len(payload) // ROOM
    rest = payload[full * ROOM :]
    frames = np.empty((full, ROOM + HEAD), np.uint8)
    frames[:, :HEAD] = np.frombuffer(frame_start(BIG), np.uint8)
    frames[:, HEAD:] = np.frombuffer(payload, np.uint8, full * ROOM).reshape(full, ROOM)
    tail = b""
    if rest:
        index = next(i for i in range(1, BIG + 1) if frame_bytes(i, 1, 0) - HEAD >= len(rest))
        tail = frame_start(index) + rest + bytes(frame_bytes(index, 1, 0) - HEAD - len(rest))
    count, size = full + bool(rest), frames.size + len(tail)
    index = 4  # the Xing frame: 192 bytes hold the table
    total = size + frame_bytes(index, 1, 0)
    toc = bytes(min(255, 256 * (frame_bytes(index, 1, 0) + (i * count // 100) * (ROOM + HEAD)) // total) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    info = frame_start(index) + xing
    return id3({"payload_bytes": str(len(payload))}) + info + bytes(frame_bytes(index, 1, 0) - len(info)) + frames.tobytes() + tail


def _text(frame: bytes) -> list[str]:
    """The strings of a text frame, by its first byte's encoding."""
    if not frame:
        return []
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(frame[0], "latin-1")
    return frame[1:].decode(code, "replace").rstrip("\0").split("\0")


def read_id3(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag that starts there (user-defined ones by their description), and where the tag ends."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return {}, at
    major, flags = data[at + 3], data[at + 5]
    number = lambda b, bits: sum(x << bits * (len(b) - 1 - i) for i, x in enumerate(b))
    size = number(data[at + 6 : at + 10], 7)
    body, end = data[at + 10 : at + 10 + size], at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    p, tags = 0, {}
    if flags & 0x40 and major > 2:
        p = number(body[:4], 7) if major == 4 else number(body[:4], 8) + 4
    name_bytes, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p : p + name_bytes].isalnum():
        name = body[p : p + name_bytes].decode("ascii")
        n = number(body[p + name_bytes : p + 2 * name_bytes], 7 if major == 4 else 8)
        frame = body[p + head : p + head + n]
        if major == 4 and (body[p + 9] & 2 or flags & 0x80):
            frame = frame.replace(b"\xff\x00", b"\xff")
        if major == 4 and body[p + 9] & 1:
            frame = frame[4:]
        if name in ("TXXX", "TXX"):
            parts = _text(frame)
            if len(parts) > 1:
                tags[parts[0]] = parts[1].lstrip("\ufeff")
        elif name[0] == "T":
            tags[name] = "\0".join(_text(frame))
        p += head + n
    return tags, end


def read_table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table of the frame there: kind, frames, bytes and seek table, as far as it has them."""
    p, number = at + 4 + 2 * h.protected + h.side, lambda q, n: int.from_bytes(data[q : q + n], "big")
    if data[p : p + 4] in (b"Xing", b"Info"):
        flags, out, q = number(p + 4, 4), {"kind": data[p : p + 4].decode(), "frames": None, "bytes": None, "toc": None}, p + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], q = number(q, 4), q + 4
        return out | ({"toc": data[q : q + 100]} if flags & 4 else {})
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        entries, width = number(p + 18, 2), number(p + 22, 2)
        return {"kind": "VBRI", "bytes": number(p + 10, 4), "frames": number(p + 14, 4), "toc": data[p + 26 : p + 26 + entries * width]}
    return None


def decode(data: bytes) -> dict:
    """What a stream holds: payload, frames, byte offsets of the frames, samples by sample rate, failed checks, skipped bytes.

    A header counts where a whole frame follows whose CRC holds, or that ends at another header of its kind, at a tag or at the end.
    Anything else is skipped up to the next sync word. A frame whose CRC fails is counted and left out of the payload.
    """
    out = {"tags": {}, "vbr": None, "offsets": [], "samples": {}, "bad_crc": 0, "skipped": 0, "bits": 0}
    at, parts = 0, []
    while (found := read_id3(data, at))[1] > at:
        out["tags"] |= found[0]
        at = found[1]
    end = len(data)
    tag = end - 128 if end - at >= 128 and data[-128:-125] == b"TAG" else end  # a tag if no frame covers its place
    while at < end and at != tag:
        h = read_header(data[at : at + 4])
        stop = at + h.size if h else 0
        ok = bool(h) and stop <= end and (not h.protected or checked(h, data, at))
        if not h or stop > end or not (h.protected and ok or stop in (tag, end) or (n := read_header(data[stop : stop + 4])) and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)):
            limit = tag if at < tag else end
            nxt = data.find(b"\xff", at + 1, limit)
            out["skipped"] += (nxt if nxt >= 0 else limit) - at
            at = nxt if nxt >= 0 else limit
            continue
        table = read_table(data, at, h) if h.layer == 3 and out["vbr"] is None and not out["offsets"] else None
        if table:
            out["vbr"] = table
        else:
            out["offsets"].append(at)
            out["samples"][h.rate] = out["samples"].get(h.rate, 0) + h.samples
            out["bits"] += h.kbps
            out["bad_crc"] += not ok
            if ok:
                parts.append(data[at + 4 + 2 * h.protected + h.side : stop])
        at = stop
    payload = b"".join(parts)
    n = out["tags"].get("payload_bytes", "")
    out["payload"] = payload[: int(n)] if n.isdigit() else payload
    return out


def duration_us(stream: dict) -> int:
    """Microseconds, cut off only once for each sample rate."""
    return sum(n * 1_000_000 // rate for rate, n in stream["samples"].items())


def feature(stream: dict) -> str:
    """Frames, duration in microseconds, mean bit rate, failed checks, skipped bytes and a checksum of the seek offsets."""
    n = len(stream["offsets"])
    seek = zlib.crc32(np.asarray(stream["offsets"], "<u8").tobytes())
    return f"frames={n};us={duration_us(stream)};kbps={stream['bits'] // n if n else 0};vbr={stream['vbr']['frames'] if stream['vbr'] else -1};bad_crc={stream['bad_crc']};skipped={stream['skipped']};seek={seek:08x}"


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % 64 if data else 64)


FIELDS = [
    ("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()),
    ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("media", "binary", pa.binary()),
]


def _store(texts: list, keep: bool) -> list[list]:
    rows = []
    for t in texts:
        n, payload = padded(t)
        media = encode(payload)
        back = decode(media)
        p = back["payload"]
        rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back), media if keep else None))
    cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in FIELDS]
    return cols if keep else cols[:-1]


def _digest(texts: list) -> list[list]:
    return _store(texts, keep=False)


def _media(texts: list) -> list[list]:
    return _store(texts, keep=True)


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text through write, store and read; digests and features of what was read back. See `media_columns`."""
    return map_texts(docs, key, text, FIELDS[:-1], _digest)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `media_digests`, with the stream itself in `media`.

    Null and empty texts carry 64 zero bytes; equal texts give equal values; null and repeated keys stay rows of their own; an empty
    table gives no rows.
    """
    return map_texts(docs, key, text, FIELDS, _media)


def _read(streams: list) -> list[list]:
    got = [None if s is None else decode(s) for s in streams]
    return [
        [None if x is None else duration_us(x) for x in got],
        [None if x is None else len(x["offsets"]) for x in got],
        [None if x is None else x["bad_crc"] for x in got],
        [None if x is None else x["skipped"] for x in got],
        [None if x is None else x["offsets"] for x in got],
    ]


def read_streams(media: DataFrame, key: str = "doc_id", stream: str = "media") -> DataFrame:
    """Durations (microseconds), frame counts, failed checks, skipped bytes and seek offsets of any MPEG audio streams; null for null."""
    fields = [("duration_us", "bigint", pa.int64()), ("frames", "bigint", pa.int64()), ("bad_crc", "bigint", pa.int64()), ("skipped", "bigint", pa.int64()), ("offsets", "array<bigint>", pa.list_(pa.int64()))]
    kind = dict(media.dtypes)[key]
    names = [key, *[f[0] for f in fields]]

    def run(batches):
        for b in batches:
            cols = _read(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=f[2]) for c, f in zip(cols, fields)]], names=names)

    return bounded(pick(media, key, stream)).mapInArrow(run, ", ".join([f"`{key}` {kind}", *[f"`{n}` {t}" for n, t, _ in fields]]))
