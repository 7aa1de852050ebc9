from __future__ import annotations

import hashlib
import struct
import zlib

from foliant.llm import mpeg_media as m
from tests.llm.data import awkward, prose


def frame(version=3, layer=3, rate=9, pitch=0, padding=0, mode=3, protected=False, fill=b"\0"):
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (0 if protected else 1), rate << 4 | pitch << 2 | padding << 1, mode << 6))
    h = m.header(head)
    body = (fill * h["size"])[: h["size"] - 4]
    if protected:
        side = body[2 : 2 + h["side"]]
        body = m.crc16(head[2:] + side).to_bytes(2, "big") + body[2:]
    return head + body


def test_headers():
    h = m.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h["kbps"], h["hertz"], h["samples"], h["size"], h["side"]) == (128, 44100, 1152, 417, 32)
    assert m.header(bytes((0xFF, 0xFB, 0xF0, 0x00))) is None and m.header(b"\xff\xfb") is None
    assert m.header(bytes((0xFF, 0xF3, 0x90, 0xC0)))["samples"] == 576
    assert m.header(bytes((0xFF, 0xFF, 0x90, 0x00)))["size"] == (12000 * 288 // 44100) * 4


def test_resynchronises_after_rubbish_and_finds_offsets():
    f = frame()
    data = b"ID3\x03\0\0\0\0\0\x0a" + b"\0" * 10 + b"\xff\xfb\x00rubbish" + f * 3 + b"\xff\xff noise \xff" + f * 2 + b"TAG" + b"\0" * 125
    s = m.scan(data)
    assert s["n_frames"] == 5 and s["samples"] == 5 * 1152 and s["duration_us"] == 5 * 1152 * 1_000_000 // 44100
    assert all(data[x : x + 4] == f[:4] for x in s["seek_offsets"]) and s["junk_bytes"] == 10 + 10


def test_variable_rate_tables_and_checksums():
    mixed = [frame(rate=r, protected=True, fill=b"\x15") for r in (9, 5, 12, 9)]
    size = sum(map(len, mixed))
    info = frame()
    xing = info[:21] + b"Xing" + struct.pack(">III", 7, 4, size) + bytes(range(100))
    s = m.scan(xing.ljust(len(info), b"\0") + b"".join(mixed))
    assert s["vbr"]["kind"] == "Xing" and s["vbr"]["frames"] == 4 and len(s["vbr"]["toc"]) == 100
    assert s["n_frames"] == 4 and (s["crc_checked"], s["crc_bad"]) == (4, 0)
    broken = bytearray(mixed[0])
    broken[8] ^= 1
    assert m.scan(bytes(broken) + b"".join(mixed[1:]))["crc_bad"] == 1
    vbri = info[:36] + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, size, 4, 2, 1, 2, 2) + struct.pack(">HH", 417, 418)
    s = m.scan(vbri.ljust(len(info), b"\0") + b"".join(mixed))
    assert s["vbr"]["kind"] == "VBRI" and s["vbr"]["frames"] == 4 and s["vbr"]["toc"] == [417, 418]


def test_joined_streams_of_several_rates():
    a, b = frame(pitch=0), frame(pitch=1)
    s = m.scan(a * 20 + b * 20 + b"\xffjunk" + frame(version=2, pitch=0) * 5)
    assert (s["n_frames"], s["junk_bytes"], s["hertz"]) == (45, 5, 44100)
    assert s["duration_us"] == 20 * 1152 * 1_000_000 // 44100 + 20 * 1152 * 1_000_000 // 48000 + 5 * 576 * 1_000_000 // 22050 + 1  # the parts' fractions add up to more than one
    assert m.scan(a * 20 + b * 2 + a * 3)["n_frames"] == 23, "two headers of another kind are rubbish"
    assert m.scan(a * 5 + b * 2)["n_frames"] == 7, "unless the stream ends exactly with them"


def test_short_frames_have_no_table():
    short = frame(version=2, rate=2, pitch=1)
    assert len(short) == 48
    data = short[:36] + b"VBRI" + short[40:]
    assert m.scan(data * 3)["n_frames"] == 3 and m.scan(data * 3)["vbr"] is None


def bitwise_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


def test_checksums_of_layers_one_and_two():
    cases = [  # layer, rate index, pitch, mode, fields: (bits, value) ...
        (1, 9, 0, 3, [(4, i % 15) for i in range(32)]),
        (1, 9, 0, 0, [(4, i % 15) for i in range(64)]),
        (1, 9, 0, 1, [(4, i % 15) for i in range(8 + 28)]),  # joint from band 4 on
        (2, 8, 0, 3, [(4, 1)] * 11 + [(3, 0)] * 12 + [(2, 1)] * 7 + [(2, 3)] * 18),  # mono, 30 bands
        (2, 1, 0, 3, [(4, 1)] * 2 + [(3, 2)] * 6 + [(2, 1)] * 8),  # mono, low rate, 8 bands
        (2, 12, 1, 0, [(4, 0)] * 22 + [(3, 1)] * 24 + [(2, 0)] * 8 + [(2, 2)] * 24),  # two channels, 27 bands
    ]
    for layer, rate, pitch, mode, fields in cases:
        head = bytes((0xFF, 0xE0 | 3 << 3 | (4 - layer) << 1, rate << 4 | pitch << 2, mode << 6))
        h = m.header(head)
        bits = [v >> n - 1 - i & 1 for n, v in fields for i in range(n)]
        body = bytes(int("".join(map(str, (bits + [1] * 16)[i : i + 8])), 2) for i in range(0, len(bits) + 8, 8))
        crc = bitwise_crc([x >> 7 - i & 1 for x in head[2:] for i in range(8)] + bits)
        whole = (head + crc.to_bytes(2, "big") + body).ljust(h["size"], b"\0")
        s = m.scan(whole * 3)
        assert (s["n_frames"], s["crc_checked"], s["crc_bad"]) == (3, 3, 0), (layer, rate, mode)
        broken = bytearray(whole)
        broken[4] ^= 1
        assert m.scan(whole + bytes(broken) + whole)["crc_bad"] == 1


def test_nothing_is_no_error():
    for x in (None, b"", b"\xff", b"\xff" * 999, b"TAG", b"ID3"):
        assert m.scan(x)["n_frames"] == 0 and m.scan(x)["duration_us"] == 0


def test_payload_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        raw = bytes((i * i) % 251 for i in range(n))
        for data in (raw, b"\xff\xfb\x90\x00" * (n // 4)):
            p = m.padded(data)
            back, seen = m.unpack_payload(m.pack_payload(p, len(data)))
            assert back == p and len(p) % 576 == 0 and p and seen["junk_bytes"] == 0


def test_stored_texts(spark):
    texts = {0: None, 1: "", 2: "kurz", 3: prose(1, 20000), 4: "é" * 288, 5: "kurz", None: "z"}
    got = {r["doc_id"]: r for r in m.stored_texts(awkward(spark, [*texts.items(), (2, "kurz")])).collect()}
    for i, t in texts.items():
        p = m.padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2]["media_sha256"] == got[5]["media_sha256"] and got[2]["feature"] == got[5]["feature"]
    assert m.stored_texts(awkward(spark, {})).count() == 0


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(frame() * 3), 5), (2, None, 6), (3, bytearray(b"none"), 7)], "id int, content binary, media int")
    got = {r["id"]: r["media"] for r in m.media_columns(df, "content").collect()}
    assert got[1]["n_frames"] == 3 and got[1]["seek_offsets"] == [0, 417, 834] and got[2]["n_frames"] == got[3]["n_frames"] == 0
