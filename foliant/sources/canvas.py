"""A page renderer for scanned pages: the page's images, resampled into one canvas by the matrices that place them."""

from __future__ import annotations

import hashlib

import numpy as np

from foliant.sources import pdf, png

IDENTITY = np.eye(3)


def placed_images(page: pdf.Page) -> list[np.ndarray]:
    """The matrix of each image that the page shows, from the unit square to the page; restoring more than was saved gives the identity."""
    now, stack, out = IDENTITY, [], []
    for op, m, _, _ in page.ops:
        if op == "save":
            stack.append(now)
        elif op == "restore":
            now = stack.pop() if stack else IDENTITY
        elif op == "transform":
            a, b, c, d, e, f = m
            now = now @ np.array([[a, c, e], [b, d, f], [0, 0, 1]])
        elif op == "image":
            out.append(now)
        elif op == "inline_image":
            raise ValueError("an inline image needs a renderer")
    return out


def draw(canvas: np.ndarray, image: np.ndarray, matrix: np.ndarray, page_top: float, scale: float) -> None:
    """Draws *image* (height, width, RGBA) where *matrix* puts the unit square; each pixel takes the image's pixel under its middle."""
    down = np.array([[scale, 0, 0], [0, -scale, page_top * scale], [0, 0, 1]])
    whole = down @ matrix
    if abs(np.linalg.det(whole)) < 1e-9:
        return
    corners = whole @ np.array([[0, 1, 0, 1], [0, 0, 1, 1], [1, 1, 1, 1]])
    low = np.maximum(0, np.floor(corners[:2].min(axis=1)).astype(int))
    high = np.minimum((canvas.shape[1], canvas.shape[0]), np.ceil(corners[:2].max(axis=1)).astype(int))
    if (low >= high).any():
        return
    x, y = np.meshgrid(np.arange(low[0], high[0]) + 0.5, np.arange(low[1], high[1]) + 0.5)
    u, v, _ = np.linalg.inv(whole) @ np.stack((x.ravel(), y.ravel(), np.ones(x.size)))
    inside = ((u >= 0) & (u < 1) & (v >= 0) & (v < 1)).reshape(x.shape)
    rows = np.minimum(((1 - v) * image.shape[0]).astype(int), image.shape[0] - 1).reshape(x.shape)  # an image's first row is at the top
    cols = (u * image.shape[1]).astype(int).reshape(x.shape)
    part = canvas[low[1] : high[1], low[0] : high[0]]
    part[inside] = image[rows[inside], cols[inside]]


class ImageCanvas:
    """An ``engines.Renderer`` of pages that are images only; it raises for pages with text, without images, or with ones that it can't unpack."""

    def __init__(self):
        self.key, self.document = None, None

    def __call__(self, content: bytes, page_idx: int, scale: float) -> bytes:
        key = hashlib.sha256(content).digest()
        if key != self.key:
            self.key, self.document = key, pdf.Document(content)
        page = self.document.pages[page_idx]
        if any(item[0].strip() for item in page.items):
            raise ValueError("text needs a renderer")
        matrices = placed_images(page)
        if not matrices:
            raise ValueError("no image on the page")
        canvas = np.full((max(1, round(page.height * scale)), max(1, round(page.width * scale)), 4), 255, np.uint8)
        for image, matrix in zip(page.images, matrices, strict=True):
            form, data = pdf.image_bytes(image["stream"])
            if form != "raw":
                raise ValueError(f"a {form} image needs a renderer")
            draw(canvas, png.to_rgba(data, image["width"], image["height"], image["channels"]), matrix, page.height, scale)
        return png.encode(canvas)
