"""Stream filters of PDF and the predictors behind two of them."""

from __future__ import annotations

import re
import zlib

import numpy as np


def flate(data: bytes, parms: dict) -> bytes:
    return unpredicted(zlib.decompressobj().decompress(data), parms)


def lzw(data: bytes, parms: dict) -> bytes:
    """Codes of 9 to 12 bits; the width grows one code early unless EarlyChange is 0."""
    early = int(parms.get("EarlyChange", 1))
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", bytearray()
    value = bits = 0
    for byte in data:
        value, bits = (value << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits & (1 << width) - 1
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} of {len(table)}")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return unpredicted(bytes(out), parms)


def ascii85(data: bytes, parms: dict) -> bytes:
    text = re.sub(rb"\s", b"", data).removeprefix(b"<~").split(b"~")[0].replace(b"z", b"!!!!!")
    short = -len(text) % 5
    digits = np.frombuffer(text + b"u" * short, np.uint8).astype(np.int64).reshape(-1, 5) - 33
    if ((digits < 0) | (digits > 84)).any():
        raise ValueError("not a base-85 digit")
    out = (digits @ (85 ** np.arange(4, -1, -1))).astype(">u4").tobytes()
    return out[: len(out) - short]


def ascii_hex(data: bytes, parms: dict) -> bytes:
    digits = re.sub(rb"\s", b"", data).split(b">")[0]
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def run_length(data: bytes, parms: dict) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


#: Decoders by the names of their filters, long and short (fixed values).
FILTERS = {"FlateDecode": flate, "Fl": flate, "LZWDecode": lzw, "LZW": lzw, "ASCII85Decode": ascii85, "A85": ascii85, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length}


def unpredicted(data: bytes, parms: dict) -> bytes:
    """*data* without its predictor: none (1), differences between pixels (2), or a filter named by each row's first byte (10 and more)."""
    kind = int(parms.get("Predictor", 1))
    if kind == 1:
        return data
    colours, bits, columns = int(parms.get("Colors", 1)), int(parms.get("BitsPerComponent", 8)), int(parms.get("Columns", 1))
    row, pixel = (colours * bits * columns + 7) // 8, max(1, colours * bits // 8)
    if kind == 2:
        if bits not in (8, 16):
            raise ValueError(f"predictor 2 with {bits} bits")
        whole = np.frombuffer(data[: len(data) // row * row], np.uint8 if bits == 8 else ">u2").reshape(-1, columns, colours)
        return np.cumsum(whole, axis=1, dtype=np.uint8 if bits == 8 else np.uint16).astype(whole.dtype).tobytes()
    if kind < 10:
        raise ValueError(f"predictor {kind}")
    out, above = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data) // (row + 1) * (row + 1), row + 1):
        above = _unfiltered(data[at], np.frombuffer(data, np.uint8, row, at + 1), above, pixel)
        out += above.tobytes()
    return bytes(out)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    """A row of a PNG filter: each byte was stored less a guess from the bytes to the left and above."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:  # running sums of each byte of a pixel
        wide = np.zeros(-(-len(line) // pixel) * pixel, np.uint8)
        wide[: len(line)] = line
        return np.cumsum(wide.reshape(-1, pixel), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind not in (3, 4):
        raise ValueError(f"row filter {kind}")
    out, up, stored = [0] * pixel, [0] * pixel + above.tolist(), line.tolist()
    for i, x in enumerate(stored):
        a, b, c = out[i], up[i + pixel], up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            near = a + b - c
            guess = min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]
        out.append((x + guess) & 255)
    return np.array(out[pixel:], np.uint8)
