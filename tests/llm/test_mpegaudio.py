from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import mpegaudio as M
from tests.llm.helpers import no_documents, odd_documents


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_round_trip_of_any_bytes(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b"\xff")
    media = M.mux(payload, "título")
    info = M.parse(media)
    assert M.demux(media, info) == payload
    assert info["n_frames"] == len(payload) // 192 == info["vbr_frames"] and info["crc_failed"] == 0 and info["crc_checked"] == info["n_frames"]
    assert info["samples"] == 1152 * info["n_frames"] and info["duration_ms"] == 24.0 * info["n_frames"] and info["tags"] == {"TIT2": "título"}


def test_headers_and_foreign_streams():
    assert M.header(b"\xff\xfb\x90\x00") == (417, 1152, 44100, 128, 32, False)
    assert M.header(b"\xff\xf3\x80\xc0")[:3] == (208, 576, 22050)
    assert M.header(b"\xff\xff\x10\x00")[1] == 384  # layer I
    for bad in (b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff"):
        assert M.header(bad) is None
    for nothing in (None, b"", b"text", b"\xff" * 50):
        assert M.parse(nothing)["n_frames"] == 0 and M.parse(nothing)["duration_ms"] == 0


def test_resynchronises_and_counts_damage():
    media = bytearray(M.mux(b"a" * 192 * 5))
    first = M.parse(bytes(media))
    media[first["offsets"][2] + 5] ^= 1  # a CRC
    assert M.parse(bytes(media))["crc_failed"] == 1
    junk = bytes(media[: first["offsets"][3]]) + b"\xff\xfbjunk" + bytes(media[first["offsets"][3] :]) + b"TAG" + b"t".ljust(125, b"\0")
    again = M.parse(junk)
    assert again["n_frames"] == 5 and again["tags"]["title"] == "t"
    assert M.seek(again, 0) == again["offsets"][0] and M.seek(again, 1e9) == again["offsets"][-1] and M.seek(M.parse(b""), 1) is None
    media[first["offsets"][1] + 30] ^= 1
    with pytest.raises(ValueError):
        M.demux(bytes(media), M.parse(bytes(media)))


def test_vbri_table():
    frame = bytearray(417)
    frame[36:40] = b"VBRI"
    frame[46:60] = (1000).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"\0\2\0\1\0\2"
    frame[62:66] = b"\0\5\0\6"
    assert M.vbr_table(bytes(frame), 32, False) == {"kind": "VBRI", "frames": 7, "bytes": 1000, "toc": [5, 6]}


def walk(data: bytes) -> list[int]:
    """Offsets of the frames of a clean 48 kHz Layer III stream, by the bit fields of each header alone."""
    at, out = 10 + int("".join(f"{b:07b}" for b in data[6:10]), 2), []
    while at < len(data):
        bits = f"{int.from_bytes(data[at : at + 4], 'big'):032b}"
        assert bits[:15] == "1" * 12 + "101" and bits[20:22] == "01"
        kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][int(bits[16:20], 2)]
        out.append(at)
        at += 144 * kbps * 1000 // 48000 + int(bits[22])
    return out


def test_offsets_and_durations_against_a_plain_walk():
    for n in (1, 2, 57):
        data = M.mux((b"ab" * 96) * n)
        info = M.parse(data)
        assert info["offsets"] == walk(data)[1:] and info["duration_ms"] == n * 1152 / 48  # the first frame holds the table
        assert [M.seek(info, 24.0 * k + 1) for k in range(n)] == info["offsets"]


def test_tags_of_all_versions():
    safe = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    media = M.mux(b"a" * 192)[28:]
    old = b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    three = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0abc"
    four = b"TIT2" + safe(4) + b"\0\0" + b"\0abc"
    wide = b"TIT2" + (9).to_bytes(4, "big") + b"\0\0" + b"\x01\xff\xfea\0b\0c\0"
    cases = [
        (2, 0, old, {"TT2": "abc"}), (3, 0, three, {"TIT2": "abc"}), (4, 0, four, {"TIT2": "abc"}),
        (3, 0x40, (6).to_bytes(4, "big") + b"\0" * 6 + three, {"TIT2": "abc"}), (4, 0x40, safe(6) + b"\1\0" + four, {"TIT2": "abc"}),
        (3, 0x80, wide.replace(b"\xff\xfe", b"\xff\x00\xfe"), {"TIT2": "abc"}),
        (4, 0, b"TIT2" + safe(8) + b"\0\1" + safe(4) + b"\0abc", {"TIT2": "abc"}),
        (3, 0, b"TIT2" + (4).to_bytes(4, "big") + b"\0\x80" + b"zzzz" + three, {"TIT2": "abc"}),
        (2, 0, b"TT2\0", {}), (4, 0x40, b"", {}),
    ]
    for version, flags, body, expected in cases:
        found, start, end = M.tags(b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body + media)
        assert found == expected and start == 10 + len(body) and end == start + len(media)


def test_null_damaged_and_foreign_media_have_errors(spark):
    good = M.mux(b"a" * 192 * 2)
    bad = bytearray(good)
    bad[M.parse(good)["offsets"][1] + 40] ^= 1
    cut = good[: M.parse(good)["offsets"][1] + 100]
    rows = [(1, 5, good), (2, 5, None), (3, None, bytes(bad)), (4, 5, b"foreign"), (5, 0, b""), (6, 5, cut), (1, 5, good)]
    found = M.digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 7 and by[1]["error"] is None and by[2]["error"] == "no media" and "damaged" in by[3]["error"]
    assert by[1]["offsets"] == M.parse(good)["offsets"] and by[1]["duration_ms"] == 48.0 and by[3]["payload_sha256"] is None
    assert by[4]["payload_bytes"] == by[5]["payload_bytes"] == 0 and by[6]["n_frames"] == 1
    assert len(M.probe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()) == 7


def test_durations_add_up_over_sample_rates():
    a, b = b"\xff\xfb\x90\x00".ljust(417, b"\0"), b"\xff\xfb\x94\x00".ljust(384, b"\0")
    info = M.parse(a * 3 + b * 2)
    assert info["n_frames"] == 5 and abs(info["duration_ms"] - (3 * 1152 / 44.1 + 2 * 1152 / 48)) < 1e-9


def test_tables(spark):
    media = M.to_media(odd_documents(spark))
    rows = {r["doc_id"]: r for r in M.digests(media).collect()}
    empty = b" " * 192
    for i in (2, 3):
        assert (
            rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"],
        ) == (0, 192, hashlib.sha256(empty).hexdigest(), zlib.crc32(empty[-16:]))
    assert rows[8]["n_bytes"] == 100_000 and rows[1]["feature"] == rows[6]["feature"]
    infos = M.probe(media.withColumnRenamed("n_bytes", "samples")).collect()
    assert len(infos) == 10 and all(r["crc_failed"] == 0 and len(r["offsets"]) == r["n_frames"] for r in infos)
    assert M.digests(M.to_media(no_documents(spark))).count() == 0
