"""Raw pixels to PNG, binarization and scaling, with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def to_rgba(raw: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """(height, width, 4) pixels from grey, RGB or RGBA bytes; missing alpha is opaque."""
    if channels not in (1, 3, 4):
        raise ValueError(f"{channels} channels")
    px = np.frombuffer(raw, np.uint8, width * height * channels).reshape(height, width, channels)
    if channels == 4:
        return px.copy()
    colour = np.repeat(px, 3, axis=2) if channels == 1 else px
    return np.concatenate((colour, np.full((height, width, 1), 255, np.uint8)), axis=2)


def binarized(rgba: np.ndarray) -> np.ndarray:
    """Black and white around the mean luminance; pixels at the mean are white."""
    grey = rgba[..., 0] * 0.299 + rgba[..., 1] * 0.587 + rgba[..., 2] * 0.114
    out = rgba.copy()
    out[..., :3] = np.where(grey >= grey.mean(), 255, 0).astype(np.uint8)[..., None]
    return out


def scaled(rgba: np.ndarray, scale: float) -> np.ndarray:
    """Nearest-neighbour scaling to sides of floor(n * scale + 0.5) pixels; the image itself at scale 1."""
    if scale == 1:
        return rgba
    h, w = (max(1, int(np.floor(n * scale + 0.5))) for n in rgba.shape[:2])
    rows, cols = np.minimum((np.arange(h) / scale).astype(int), rgba.shape[0] - 1), np.minimum((np.arange(w) / scale).astype(int), rgba.shape[1] - 1)
    return rgba[rows][:, cols]


def encode(rgba: np.ndarray) -> bytes:
    """A PNG file of 8-bit RGBA."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = rgba.shape[:2]
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = rgba.reshape(h, 4 * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
