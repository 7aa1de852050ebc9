"""Media columns for MPEG audio.

``scan`` reads any MPEG-1/2/2.5 layer I-III byte string: it skips leading ID3v2 and trailing ID3v1/APEv2
tags, resynchronises on frame headers (a header counts once the header that it points to is there too, or
the data ends exactly where it says; one of another version, layer or rate than those before it once RUN such headers
point to each other, as where streams are joined), reads Xing/Info and VBRI tables, checks the CRC-16 of protected frames
and returns exact sample counts and the byte offset of every frame.

``media_columns`` adds those columns to a table of binary rows; ``pack_payload``/``unpack_payload`` store
arbitrary bytes losslessly as the ancillary data of silent layer III frames, 576 bytes to a frame.

Defined results: null content reads as empty; bytes without any frame give 0 frames, duration 0 and an empty
offset list; repeated rows give repeated results; columns of other names are passed through, those named like
an output column are replaced by it; a stream of several rates tells its first, and its duration adds up each rate's; an
empty table gives an empty one; contents of any length are read whole, in
memory. A protected frame too short for what its checksum covers counts as bad; a VBRI mark in a frame too short for
a table is none. Free-format frames count as junk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

UNIT = 576
#: Headers in step that start another kind of frames within a stream.
RUN = 3
OWNER = b"foliant.payload\0"

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version group, layer), Hz by version, samples a frame.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(maxsize=65536)
def header(four: bytes) -> dict | None:
    """The fields of a frame header, or None if these bytes are none (free format counts as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, pitch = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or pitch == 3 or four[3] & 3 == 2:
        return None
    group = 1 if version == 3 else 2
    kbps, hertz, padding, mode = KBPS[group, layer][rate], HERTZ[version][pitch], four[2] >> 1 & 1, four[3] >> 6
    samples = 384 if layer == 1 else 576 if layer == 3 and group == 2 else 1152
    size = (12000 * kbps // hertz + padding) * 4 if layer == 1 else samples * 125 * kbps // hertz + padding
    side = 0 if layer != 3 else {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}[group, mode == 3]
    return {"version": version, "layer": layer, "kbps": kbps, "hertz": hertz, "samples": samples, "size": size, "mode": mode, "extension": four[3] >> 4 & 3, "side": side, "protected": not four[1] & 1}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of a frame's bytes, or of their first *bits* bits: polynomial 8005, start FFFF."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for i in range(0 if bits is None else bits % 8):
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ data[whole] >> 7 - i) & 1 else 0)) & 0xFFFF
    return c


# Fixed values of ISO/IEC 11172-3 and 13818-3, layer II: the allocation tables, as (subbands, bits of an allocation) runs.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: dict) -> str:
    """The allocation table of a layer II frame, by rate a channel and sampling frequency."""
    if h["version"] != 3:
        return "low"
    rate = h["kbps"] // (1 if h["mode"] == 3 else 2)
    if rate <= 48:
        return "d" if h["hertz"] == 32000 else "c"
    return "a" if rate <= 80 or h["hertz"] == 48000 else "b"


def protected_bits(h: dict, body: bytes) -> int:
    """How many bits behind the checksum it covers: side information, allocations, in layer II also scale factor selections.

    *body* are the frame's bytes behind the checksum. 0 if the frame ends before.
    """
    if h["layer"] == 3:
        return 8 * h["side"]
    channels = 1 if h["mode"] == 3 else 2
    bound = 4 * (h["extension"] + 1) if h["mode"] == 1 else 32
    if h["layer"] == 1:
        out = 4 * (channels * min(bound, 32) + max(0, 32 - bound))
        return out if out <= 8 * len(body) else 0
    at, chosen, band = 0, 0, 0
    bits = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    for count, width in ALLOCATION[_allocation(h)]:
        for _ in range(count):
            one = band >= bound  # both channels share the allocation of a band above the bound
            for _ in range(1 if one else channels):
                chosen += (channels if one else 1) * bool(bits >> 512 - at - width & (1 << width) - 1)
                at += width
            band += 1
    out = at + 2 * chosen
    return out if out <= 8 * len(body) else 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[int, int, dict[str, bytes]]:
    """Where the audio begins and ends, and the frames of ID3v2 tags by id."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        major, size = data[start + 3], _synchsafe(data[start + 6 : start + 10])
        at, stop = start + 10, min(end, start + 10 + size)
        while major >= 3 and at + 10 <= stop and data[at] != 0:
            n = _synchsafe(data[at + 4 : at + 8]) if major >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            tags.setdefault(data[at : at + 4].decode("latin-1"), data[at + 10 : min(stop, at + 10 + n)])
            at += 10 + n
        start = min(end, start + 10 + size + (10 if data[start + 5] & 0x10 else 0))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(start, end - size - (32 if flags & 0x80000000 else 0))
    return start, end, tags


def _vbr(frame: bytes, h: dict) -> dict | None:
    """The Xing, Info or VBRI table that this frame carries instead of sound."""
    at = 4 + h["side"]
    if h["layer"] == 3 and (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        body = frame[62 : 62 + entries * width]
        toc = [scale * int.from_bytes(body[i : i + width], "big") for i in range(0, len(body), max(1, width))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "step": step}
    return None


def scan(data: bytes | None) -> dict:
    """Everything that the columns hold; see the module's description."""
    data = bytes(data or b"")
    start, end, tags = _tags(data)
    at, junk_from, offsets, sizes, vbr, junk, bad, checked, samples, kind = start, start, [], [], None, 0, 0, 0, {}, None

    def of(h: dict) -> tuple:
        return h["version"], h["layer"], h["hertz"]

    def in_step(at: int, h: dict, most: int) -> bool:
        """Whether *most* headers of one kind point to each other from *at* on, or fewer up to the very end."""
        one = of(h)
        for _ in range(most - 1):
            at += h["size"]
            if at == end:
                return True
            if at + 4 > end or not (h := header(data[at : at + 4])) or of(h) != one:
                return False
        return True

    while at + 4 <= end:
        h = header(data[at : at + 4])
        fine = h and at + h["size"] <= end
        if fine and kind and of(h) == kind and junk_from == at:
            pass  # in step with those before it, whatever comes after it
        elif not fine or not in_step(at, h, 2 if kind in (None, of(h)) else RUN):
            nxt = data.find(b"\xff", at + 1, end)
            junk += (end if nxt < 0 else nxt) - at
            at = end if nxt < 0 else nxt
            continue
        kind = of(h)
        frame = data[at : at + h["size"]]
        if vbr is None and not offsets and (vbr := _vbr(frame, h)):
            at += h["size"]
            junk_from = at
            continue
        if h["protected"]:
            covered = protected_bits(h, frame[6:])
            checked += 1
            bad += not covered or crc16(frame[2:4] + frame[6 : 6 + -(-covered // 8)], 16 + covered) != int.from_bytes(frame[4:6], "big")
        offsets.append(at)
        sizes.append(h["size"])
        samples[h["hertz"]] = samples.get(h["hertz"], 0) + h["samples"]
        at += h["size"]
        junk_from = at
    return {
        "n_frames": len(offsets), "hertz": next(iter(samples), None), "samples": sum(samples.values()), "duration_us": int(sum(Fraction(n * 1_000_000, hertz) for hertz, n in samples.items())),
        "seek_offsets": offsets, "sizes": sizes, "crc_checked": checked, "crc_bad": bad, "junk_bytes": junk, "vbr": vbr, "tags": tags,
    }


_HEAD = bytes((0xFF, 0xFA, 0xB0, 0xC4))  # MPEG-1 layer III, CRC, 192 kbit/s, 44.1 kHz, mono
_FRAME = header(_HEAD)
_SIDE = bytes(_FRAME["side"])
_LEAD = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_TAIL = bytes(_FRAME["size"] - len(_LEAD) - UNIT)


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def padded(raw: bytes) -> bytes:
    """*raw* with bytes 255 up to a positive multiple of the unit."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def pack_payload(payload: bytes, n_bytes: int) -> bytes:
    """An MPEG stream of silent frames whose ancillary data is *payload*, after a tag and an Info frame."""
    count = len(payload) // UNIT
    private = OWNER + struct.pack(">QQI", n_bytes, len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _safe(len(private)) + b"\0\0" + private
    size = _FRAME["size"]
    toc = bytes(256 * (i * count // 100 + 1) // (count + 1) for i in range(100))
    info = bytes((0xFF, 0xFB, 0xB0, 0xC4)) + _SIDE + b"Info" + struct.pack(">III", 7, count, (count + 1) * size) + toc
    parts = [b"ID3\x04\0\0", _safe(len(tag)), tag, info.ljust(size, b"\0")]
    for i in range(0, len(payload), UNIT):
        parts += (_LEAD, payload[i : i + UNIT], _TAIL)
    return b"".join(parts)


def unpack_payload(media: bytes) -> tuple[bytes, dict]:
    """The payload and what ``scan`` says; raises ValueError if any checksum or count disagrees."""
    seen = scan(media)
    at = len(_LEAD)
    payload = b"".join([media[x + at : x + at + UNIT] for x in seen["seek_offsets"]])
    private = seen["tags"].get("PRIV", b"")
    if not private.startswith(OWNER):
        raise ValueError("no payload tag")
    _, size, crc = struct.unpack(">QQI", private[len(OWNER) :])
    if seen["crc_bad"] or size != len(payload) or crc != zlib.crc32(payload) or seen["vbr"]["frames"] != seen["n_frames"]:
        raise ValueError("the stored stream is damaged")
    return payload, seen


MEDIA = "n_frames int, hertz int, samples long, duration_us long, seek_offsets array<long>, crc_checked int, crc_bad int, junk_bytes long, vbr_kind string, vbr_frames long"


def media_columns(df: DataFrame, content: str) -> DataFrame:
    """*df* with a struct column ``media`` of what ``scan`` finds in the binary column *content*."""

    @F.pandas_udf(MEDIA)
    def read(col):
        import pandas as pd

        rows = []
        for x in col:
            s = scan(x)
            v = s["vbr"] or {}
            rows.append([s[k] for k in ("n_frames", "hertz", "samples", "duration_us", "seek_offsets", "crc_checked", "crc_bad", "junk_bytes")] + [v.get("kind"), v.get("frames")])
        out = pd.DataFrame(rows, columns=["n_frames", "hertz", "samples", "duration_us", "seek_offsets", "crc_checked", "crc_bad", "junk_bytes", "vbr_kind", "vbr_frames"])
        return out.astype({"vbr_frames": "Int64"})

    return df.withColumn("media", read(F.col(content)))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, n_frames int"


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text stored as an MPEG stream and read back, one row a document; a map-only pass.

    Null texts are stored as empty ones, null ids stay null.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = b"" if (raw := text.as_buffer()) is None else raw.to_pybytes()
                media = pack_payload(padded(raw), len(raw))
                payload, seen = unpack_payload(media)
                seek = zlib.crc32(struct.pack(f"<{len(seen['seek_offsets'])}Q", *seen["seek_offsets"]))
                rows.append((
                    len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(),
                    f"mpeg1-layer3 {seen['hertz']}Hz mono {seen['vbr']['kind']} frames={seen['n_frames']} us={seen['duration_us']} crc={seen['crc_checked']}/{seen['crc_bad']} seek={seek:08x}",
                    seen["duration_us"], seen["n_frames"],
                ))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(9)]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [pa.array(cols[8], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], names=["doc_id", *names, "n_frames"])

    return docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, STORED)


def op10_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored MPEG stream, read back."""
    return stored_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mpeg_media": op10_mpeg_media}
