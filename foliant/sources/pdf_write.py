"""Small PDF files from lines of text and grey images."""

from __future__ import annotations

import zlib

#: Points of a page, from its edges to its text, of text and from line to line.
WIDTH, HEIGHT, EDGE, SIZE, STEP = 612, 792, 36, 10, 12


def _literal(text: str) -> bytes:
    raw = text.encode("latin-1", "replace")
    for c in (b"\\", b"(", b")"):
        raw = raw.replace(c, b"\\" + c)
    return b"(" + raw + b")"


def write_pdf(pages: list[tuple[list[str], list[tuple[int, tuple[float, ...]]]]], images: list[tuple[int, int, bytes]] = ()) -> bytes:
    """A file whose pages have lines of text, one below the other from the top, and show numbered *images* (width, height, grey pixels) by a matrix each.

    Characters beyond Latin-1 become question marks. Pixels are stored with the predictor that keeps differences to the row above.
    """
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    first = 4 + len(images)
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    objects[2] = b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /MediaBox [0 0 %d %d] >>" % (len(pages), WIDTH, HEIGHT)
    for n, (w, h, px) in enumerate(images):
        rows = [px[i * w : (i + 1) * w] for i in range(h)]
        stored = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)) if row != above else b"\2" + bytes(w) for row, above in zip(rows, [bytes(w), *rows], strict=False))
        packed = zlib.compress(stored)
        objects[4 + n] = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns %d >> /Length %d >>\nstream\n" % (w, h, w, len(packed)) + packed + b"\nendstream"
    names = b" ".join(b"/I%d %d 0 R" % (n, 4 + n) for n in range(len(images)))
    for i, (lines, shown) in enumerate(pages):
        body = b"".join(b"q %s cm /I%d Do Q\n" % (b" ".join(b"%g" % v for v in m), n) for n, m in shown)
        body += b"BT /F1 %d Tf %d %d Td %d TL\n" % (SIZE, EDGE, HEIGHT - EDGE, STEP) + b"".join(_literal(line) + b" Tj T*\n" for line in lines) + b"ET"
        packed = zlib.compress(body)
        objects[first + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> >>" % (first + 2 * i + 1, names)
        objects[first + 2 * i + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"
