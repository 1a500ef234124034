"""MPEG audio as a media column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

`parse` resynchronises on frame headers (a header counts where the next one follows it, or the stream ends), reads
ID3v1 and ID3v2 tags and Xing, Info and VBRI tables, and checks the 16-bit CRC of protected Layer III frames. Durations
are exact: whole samples over the sample rate.

`mux` stores bytes losslessly: a silent mono Layer III stream at 48 kHz whose frames carry 192 bytes each as ancillary
data, with that chunk's number and CRC-32. Chunks of many different bytes take a larger frame, so the bitrate varies.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass

CHUNK = 192
TAIL = 16
# fixed values: the tables of ISO/IEC 11172-3 and 13818-3, by (version 1 or 2, layer) in kbit/s, and by version in Hz
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(maxsize=4096)
def header(word: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(bytes, samples, sample rate, kbit/s, side information bytes, protected) of a 4-byte header, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, at = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or at == 3:
        return None
    one = version == 3
    kbps, hz, pad = BITRATES[1 if one else 2, layer if one or layer == 1 else 2][rate - 1], RATES[version][at], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return size, samples, hz, kbps, side, not word[1] & 1


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC with polynomial 0x8005, started at 0xFFFF."""
    crc = 0xFFFF
    for octet in data:
        crc ^= octet << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _resynchronised(data: bytes) -> bytes:
    """data without the zero bytes that unsynchronisation puts after each 0xFF."""
    return data.replace(b"\xff\x00", b"\xff")


def _text(value: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8")
    return value[1:].decode(kind, "replace").rstrip("\0")


def _tag_frames(body: bytes, version: int, flags: int) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the frames of an ID3v2 tag body; damaged rests are left out.

    Unsynchronisation, extended headers, data length indicators and the three-letter names of version 2 are handled;
    compressed and encrypted frames are skipped.
    """
    if flags & 0x80 and version < 4:
        body = _resynchronised(body)
    at, wide = 0, 3 if version == 2 else 4
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = _syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + (6 if wide == 3 else 10) <= len(body) and body[at] != 0:
        name, size = body[at : at + wide].decode("latin-1"), body[at + wide : at + 2 * wide]
        size = _syncsafe(size) if version == 4 else int.from_bytes(size, "big")
        marks = 0 if wide == 3 else body[at + 9]
        at += 6 if wide == 3 else 10
        content = body[at : at + size]
        at += size
        if version == 4:
            if marks & 0x0C:
                continue
            content = content[4:] if marks & 1 else content
            content = _resynchronised(content) if marks & 2 or flags & 0x80 else content
        elif marks & 0xC0:
            continue
        yield name, content


def tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(text frames and ID3v1 fields, first byte after the leading tags, first byte of the trailing one)."""
    found: dict[str, str] = {}
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= len(data):
        body, version, flags = start + 10, data[start + 3], data[start + 5]
        stop = min(len(data), body + _syncsafe(data[start + 6 : body]))
        if version in (2, 3, 4):
            for name, value in _tag_frames(data[body:stop], version, flags):
                if name[0] == "T" and value:
                    found[name] = _text(value)
        start = stop + (10 if flags & 0x10 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                found.setdefault(name, value)
    return found, start, end


def vbr_table(frame: bytes, side: int, protected: bool) -> dict | None:
    """Frames, bytes and table of contents of a Xing, Info or VBRI frame."""
    at = 4 + 2 * protected + side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        return out | ({"toc": list(frame[at : at + 100])} if flags & 4 else {})
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, n_frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = [int.from_bytes(frame[62 + width * k : 62 + width * (k + 1)], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": n_frames, "bytes": size, "toc": toc}
    return None


def frames(data: bytes, start: int, end: int) -> Iterator[tuple[int, tuple]]:
    """(offset, header) of each frame; bytes that are no frame are skipped.

    A frame is followed by another header or the end, or follows a frame of its own version, layer and sample rate.
    """
    at, kind = start, None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h[0] if h else 0
        own = (data[at + 1] >> 1, data[at + 2] >> 2 & 3)
        if h and after <= end and (kind == own or after + 4 > end or header(data[after : after + 4])):
            yield at, h
            at, kind = after, own
            continue
        at, kind = data.find(b"\xff", at + 1, end), None
        if at < 0:
            return


def parse(data: bytes | None) -> dict:
    """What a stream holds. Null, empty and foreign bytes have no frames and no duration."""
    data = data or b""
    found, start, end = tags(data)
    offsets, samples, hz, kbps, bad, checked, table, by_rate = [], 0, 0, 0, 0, 0, None, Counter()
    for at, (size, n, rate, k, side, protected) in frames(data, start, end):
        if not offsets and table is None and (table := vbr_table(data[at : at + size], side, protected)):
            continue
        offsets.append(at)
        samples, hz, kbps = samples + n, rate, kbps + k
        by_rate[rate] += n
        if protected and side:
            checked += 1
            bad += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) != int.from_bytes(data[at + 4 : at + 6], "big")
    return {
        "tags": found, "n_frames": len(offsets), "samples": samples, "sample_rate": hz, "duration_ms": sum(n * 1000 / rate for rate, n in by_rate.items()) or 0.0,
        "mean_kbps": kbps / len(offsets) if offsets else 0.0, "vbr_kind": table and table["kind"], "vbr_frames": table and table.get("frames"),
        "toc": (table or {}).get("toc", []), "crc_checked": checked, "crc_failed": bad, "offsets": offsets,
    }


def seek(info: dict, ms: float) -> int | None:
    """Offset of the frame that sounds at a time."""
    if not info["offsets"]:
        return None
    per_frame = info["samples"] / info["n_frames"]
    return info["offsets"][min(info["n_frames"] - 1, max(0, int(ms * info["sample_rate"] / 1000 / per_frame)))]


@lru_cache(maxsize=16)
def _lead(kbps: int) -> bytes:
    """Header, CRC and empty side information of a protected mono frame at 48 kHz."""
    head = bytes([0xFF, 0xFA, BITRATES[1, 3].index(kbps) + 1 << 4 | 1 << 2, 0xC0])
    return head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def mux(payload: bytes, title: str = "") -> bytes:
    """A stream that carries the payload, whose length is a multiple of CHUNK."""
    parts, sizes = [], []
    for k in range(len(payload) // CHUNK):
        chunk = payload[k * CHUNK : (k + 1) * CHUNK]
        kbps = 96 if len(set(chunk)) > 28 else 80
        frame = _lead(kbps) + chunk + struct.pack(">II", k & 0xFFFFFFFF, zlib.crc32(chunk))
        parts.append(frame.ljust(3 * kbps, b"\0"))
        sizes.append(3 * kbps)
    total, starts, at = sum(sizes) + 240, [], 240
    for s in sizes:
        starts.append(at)
        at += s
    toc = bytes(min(255, starts[min(len(starts) - 1, p * len(starts) // 100)] * 256 // total) if starts else 0 for p in range(100))
    info = (_lead(80) + b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc).ljust(240, b"\0")
    text = b"\x03" + title.encode("utf-8", "replace")
    safe = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    frame = b"TIT2" + safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + safe(len(frame)) + frame + info + b"".join(parts)


def demux(data: bytes, info: dict) -> bytes:
    """The payload of a stream that mux made. Raises where a chunk is missing or damaged."""
    view, out = memoryview(data), []
    at = 4 + 2 + 17
    for k, offset in enumerate(info["offsets"]):
        chunk = view[offset + at : offset + at + CHUNK]
        number, crc = struct.unpack_from(">II", data, offset + at + CHUNK)
        if number != k & 0xFFFFFFFF or crc != zlib.crc32(chunk):
            raise ValueError(f"chunk {k} is damaged")
        out.append(chunk)
    return b"".join(out)


def text_payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with spaces to a positive multiple of CHUNK, bytes before that)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // CHUNK)) * CHUNK, b" "), len(raw)


def to_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media) of every row; a null or empty text is stored as one chunk of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text_payload(t) for t in b.column(1).to_pylist()]
            media = [mux(p, f"{n} bytes") for p, n in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_pass(docs.select(F.col(doc_id).alias("doc_id"), F.col(text)), run, f"doc_id {kind}, n_bytes long, media binary")


INFO = (
    "n_frames long, samples long, sample_rate int, duration_ms double, mean_kbps double, vbr_kind string, vbr_frames long, toc array<int>, "
    "crc_checked long, crc_failed long, offsets array<long>, tags map<string,string>"
)


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns of every row and those of INFO, without the media themselves. Clashing columns are replaced."""
    names = [f.split()[0] for f in INFO.split(", ")]
    media = media.drop(*names)
    kept = [f for f in media.schema if f.name != column]
    kinds = [
        pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(),
        pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            infos = [parse(x) for x in b.column(len(kept)).to_pylist()]
            cols = [pa.array([list(i[n].items()) if n == "tags" else i[n] for i in infos], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *cols], [*(f.name for f in kept), *names])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + INFO
    return arrow_pass(media.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{column}`")), run, schema)


DIGESTS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, duration_ms double, offsets array<long>, error string"
)


def digest(data: bytes | None, n_bytes: int | None) -> tuple:
    """The columns of DIGESTS for one medium. Null or damaged media have an error, and null where nothing can be read."""
    if data is None:
        return (n_bytes, *[None] * 9, "no media")
    info = parse(data)
    offsets, whole = info["offsets"], (len(data), hashlib.sha256(data).hexdigest())
    try:
        payload = demux(data, info)
    except (ValueError, struct.error) as error:
        return (n_bytes, None, None, None, *whole, None, info["n_frames"], info["duration_ms"], offsets, str(error))
    all_offsets = hashlib.sha256(struct.pack(f">{len(offsets)}Q", *offsets)).hexdigest()[:16]
    half = seek(info, info["duration_ms"] / 2)
    feature = f"{info['n_frames']}:{info['samples']}:{info['sample_rate']}:{info['mean_kbps']:.3f}:{info['crc_failed']}:{half}:{all_offsets}"
    tail = zlib.crc32(payload[-TAIL:])
    return (
        n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), tail, *whole, feature, info["n_frames"], info["duration_ms"], offsets,
        None,
    )


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, ...) of every row of to_media: the stored form and what is read back from it, as DIGESTS says.

    feature: frames, samples, sample rate, mean bitrate, failed checksums, the offset halfway and a digest of all
    offsets. duration_ms is exact, offsets are those of all frames. A medium that is null, or whose chunks are missing or
    damaged, has an error and doesn't stop the others; foreign bytes have no chunk, so their payload is empty.
    """
    names = ["doc_id", *(f.split()[0] for f in DIGESTS.split(", "))]
    kinds = [
        pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(),
        pa.list_(pa.int64()), pa.string(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [digest(data, n) for n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return arrow_pass(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, {DIGESTS}")
