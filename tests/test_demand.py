"""OCR on demand: what is asked for, how often, what it costs, and what a missing tool gives."""

from __future__ import annotations

import collections
import hashlib
import os
import time
import uuid
import zlib

import numpy as np
import pytest

from foliant.plans import demand, evaluate
from foliant.sources import pdf, pdf_filters
from tests.test_sources import make_pdf


class Counting:
    """An engine that leaves a file for each call in a folder; it reads the size of what it gets, or the rectangle."""

    def __init__(self, folder, pause=0.0):
        self.folder, self.pause = folder, pause

    def __call__(self, png, rectangle=None):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{hashlib.sha256(png).hexdigest()} {rectangle}")
        time.sleep(self.pause)
        return [("seen", 90.0), ("unsure", 10.0), *([(f"{rectangle[2]}x{rectangle[3]}", 90.0)] if rectangle else [])]


class Draw:
    def __call__(self, content, page_idx, scale):
        return b"page %d of %s" % (page_idx, hashlib.sha256(content).hexdigest().encode())


def with_images(contents, images):
    """A PDF whose pages may show /I0, /I1 ... of (width, height, bytes)."""
    data = make_pdf(contents)
    objects = b"".join(b"%d 0 obj\n<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (60 + n, w, h, len(z := zlib.compress(b))) + z + b"\nendstream\nendobj\n" for n, (w, h, b) in enumerate(images))
    names = b" ".join(b"/I%d %d 0 R" % (n, 60 + n) for n in range(len(images)))
    return data.replace(b"/XObject << /Im 4 0 R >>", b"/XObject << " + names + b" >>").replace(b"trailer", objects + b"trailer")


def files_of(spark, **docs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc string, content binary")


@pytest.fixture
def documents(spark):
    grey, light = bytes(400 * 300), bytes([200]) * (500 * 300)
    text = b"BT /F1 9 Tf 10 10 Td (Hi) Tj ET "
    one = with_images([b"q 100 0 0 50 20 30 cm /I0 Do Q q 80 0 0 60 0 0 cm /I1 Do Q " + text], [(400, 300, grey), (500, 300, light)])
    other = with_images([text + b"/I0 Do", text, text], [(400, 300, grey)])
    return files_of(spark, one=one, other=other)


def calls(folder):
    return collections.Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def texts(spark, files, names, tools):
    return {(r["extractor"], r["doc"]): r for r in evaluate.runs(spark, files, names, tools).collect()}


def test_each_call_is_made_once_and_kept(spark, documents, tmp_path):
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "calls")
    tools = evaluate.Tools(ocr=lambda: Counting(folder), best_ocr=lambda: Counting(folder), render=lambda: Draw(), commands={}, store=str(tmp_path / "store"))
    got = texts(spark, documents, ["hibrido-unpdf-img", "hibrido-unpdf-img-hash-clean", "hibrido-clean-conf", "hibrido-clean-multi"], tools)
    assert all(r["error"] is None for r in got.values())
    # On one page both images fill half of the pages, so that for one pipeline they are background by their bytes, for the other only the more frequent size is.
    assert got["hibrido-unpdf-img", "one"]["text"] == "Hi\nseen unsure" and got["hibrido-unpdf-img-hash-clean", "one"]["text"] == "Hi"
    assert got["hibrido-unpdf-img", "other"]["text"] == "Hi\nseen unsure\n\nHi\n\nHi" and got["hibrido-clean-conf", "other"]["text"] == "Hi\n\nHi\n\nHi"
    # the second image of one; the shared image at two scales
    assert sorted(calls(folder).values()) == [1, 1, 1]
    again = texts(spark, documents, ["hibrido-unpdf-img", "hibrido-clean-multi"], tools)
    assert again["hibrido-unpdf-img", "one"]["text"] == got["hibrido-unpdf-img", "one"]["text"] and sum(calls(folder).values()) == 3
    texts(spark, documents, ["hibrido-clean-best", "hibrido-clean-prep"], tools)
    assert sum(calls(folder).values()) == 5, "another model and another preparation are other calls"


def test_pages_are_read_where_gates_ask(spark, documents, tmp_path):
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "calls")
    long = make_pdf([b"BT /F1 9 Tf (" + b"long text " * 30 + b") Tj ET", b"BT /F1 9 Tf (short) Tj ET"])
    tools = evaluate.Tools(ocr=lambda: Counting(folder), render=lambda: Draw(), commands={})
    got = texts(spark, files_of(spark, long=long, copy=long), ["hibrido", "hibrido2", "hibrido-unpdf"], tools)
    assert got["hibrido", "long"]["text"].endswith("\n\nshort\nseen unsure") == got["hibrido", "copy"]["text"].endswith("\n\nshort\nseen unsure") is True
    assert sum(calls(folder).values()) == 1, "one poor page, in two files of the same bytes"


def test_rectangles_of_images_are_read_in_runs(spark, documents, tmp_path):
    (tmp_path / "calls").mkdir()
    tools = evaluate.Tools(ocr=lambda: Counting(str(tmp_path / "calls")), render=lambda: Draw(), commands={})
    got = texts(spark, documents, ["hibrido-unpdf-bbox", "unpdf"], tools)
    # 80 x 60 points at two pixels a point and four pixels around; the other image's size is the background
    assert got["hibrido-unpdf-bbox", "one"]["text"] == "Hi\nseen unsure 168x128" and got["hibrido-unpdf-bbox", "other"]["text"].startswith("Hi\nseen unsure 10x10\n\n")
    assert sorted(x.split(" ", 1)[1] for x in calls(tmp_path / "calls")) == ["(0, 476, 168, 128)", "(0, 594, 10, 10)"]


def test_missing_tools_are_errors(spark, documents):
    names = ["unpdf", "tesseract", "hibrido-unpdf-bbox", "hibrido-clean-best", "hibrido-clean-conf", "docling"]
    got = texts(spark, documents, names, evaluate.Tools(ocr=lambda: Counting("/nowhere"), commands={}))
    wanted = {"unpdf": None, "tesseract": evaluate.NO_RENDERER, "hibrido-unpdf-bbox": evaluate.NO_RENDERER, "hibrido-clean-best": evaluate.NO_BEST, "hibrido-clean-conf": None, "docling": evaluate.NO_CONVERTER}
    assert {(n, d): r["error"] for (n, d), r in got.items()} == {(n, d): e for n, e in wanted.items() for d in ("one", "other")}
    assert got["tesseract", "one"]["num_pages"] == 0 and got["hibrido-clean-conf", "one"]["text"] == "Hi", "an engine that fails has no words"


def test_runs_write_no_pixels(spark, documents, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    monkeypatch.setattr(evaluate, "new_folder", lambda spark: str(tmp_path / "run"))
    tools = evaluate.Tools(ocr=lambda: Counting(str(tmp_path / "calls")), commands={})
    got = texts(spark, documents, ["hibrido-unpdf-img"], tools)
    assert got["hibrido-unpdf-img", "other"]["text"] == "Hi\nseen unsure\n\nHi\n\nHi"
    held = pdf.images_of(spark.read.parquet(str(tmp_path / "run" / "parsed"))).collect()
    assert len(held) == 3 and all(r["hash"] and r["bytes"] is None for r in held)


def test_images_are_unpacked_again_only_from_the_pages_that_have_them_first(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    shown = [bytes([i]) * (400 * 300) for i in range(3)]
    files = files_of(spark, a=with_images([b"/I%d Do" % (i % 3) for i in range(70)], [(400, 300, x) for x in shown]), b=with_images([b"/I0 Do"], [(400, 300, shown[2])]))
    where = pdf.images_of(pdf.parsed(files.selectExpr("*", "'hash' AS images"))).drop("bytes", "error")
    wanted = [(hashlib.sha256(x).hexdigest(), "standard", False, s) for x in (*shown, b"none has it") for s in (1.0, 2.0)]
    calls_ = spark.createDataFrame(wanted, "hash string, model string, prep boolean, scale double")
    done = demand.calls_on_files(calls_, where, files, {"standard": lambda: Counting(str(tmp_path / "calls"))}).collect()
    assert sorted((r["hash"], r["scale"]) for r in done) == sorted((h, s) for h, *_, s in wanted[:6]) and all(r["error"] is None for r in done)
    assert sorted(calls(tmp_path / "calls").values()) == [1] * 6
    lost = demand.calls_on_files(calls_, where, files_of(spark, a=b"no file"), {"standard": lambda: Counting(str(tmp_path / "calls"))}).collect()
    assert len(lost) == 6 and all("no PDF header" in r["error"] for r in lost)


def test_seconds_count_the_calls_of_each_pipeline(spark, documents, tmp_path):
    (tmp_path / "calls").mkdir()
    tools = evaluate.Tools(ocr=lambda: Counting(str(tmp_path / "calls"), 0.2), render=lambda: Draw(), commands={})
    got = texts(spark, documents, ["unpdf", "tesseract", "hibrido-unpdf-img"], tools)
    of = lambda n, d: got[n, d]["seconds"] - got["unpdf", d]["seconds"]
    assert of("tesseract", "other") > 0.59 and 0.19 < of("tesseract", "one") < 0.55
    assert of("hibrido-unpdf-img", "one") > 0.19 and of("hibrido-unpdf-img", "other") > 0.19


def filtered(rows, kinds, pixel):
    """Rows as a PNG filter stores them, by the definition of each kind."""
    out, above = bytearray(), bytes(len(rows[0]))
    for kind, row in zip(kinds, rows, strict=True):
        out.append(kind)
        for i, x in enumerate(row):
            a, b, c = (row[i - pixel] if i >= pixel else 0), above[i], (above[i - pixel] if i >= pixel else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        above = row
    return bytes(out)


def lzw_codes(data, early=1):
    """LZW by its definition, starting and ending with the marks."""
    table, width, out, word = {bytes([i]): i for i in range(256)}, 9, "", b""
    emit = lambda code: format(code, f"0{width}b")
    out += emit(256)
    size = 258
    for i in range(len(data)):
        if word + data[i : i + 1] in table:
            word += data[i : i + 1]
            continue
        out += emit(table[word])
        if size < 4096:
            table[word + data[i : i + 1]] = size
            size += 1
        width = min(12, max(9, (size - 1 + early).bit_length()))
        word = data[i : i + 1]
    out += emit(table[word]) if word else ""
    size += 1
    width = min(12, max(9, (size - 1 + early).bit_length()))
    out += emit(257)
    return bytes(int(out[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(out), 8))


def test_filters_give_back_what_was_stored():
    g = np.random.default_rng(1)
    rows = [bytes(g.integers(0, 256, 21, dtype=np.uint8)) for _ in range(25)]
    parms = {"Predictor": 15, "Colors": 3, "Columns": 7}
    assert pdf_filters.flate(zlib.compress(filtered(rows, [i % 5 for i in range(25)], 3)), parms) == b"".join(rows)
    pixels = np.frombuffer(b"".join(rows), np.uint8).reshape(25, 7, 3)
    steps = np.diff(np.concatenate((np.zeros((25, 1, 3), np.uint8), pixels), axis=1), axis=1)
    assert pdf_filters.flate(zlib.compress(steps.tobytes()), {"Predictor": 2, "Colors": 3, "Columns": 7}) == b"".join(rows)
    for data in (b"", b"a", b"abab" * 900, bytes(g.integers(0, 4, 9000, dtype=np.uint8)), bytes(g.integers(0, 256, 3000, dtype=np.uint8))):
        for early in (0, 1):
            assert pdf_filters.lzw(lzw_codes(data, early), {"EarlyChange": early}) == data
    import base64

    assert pdf_filters.ascii85(b"<~" + base64.a85encode(rows[0] + bytes(8)) + b"~>", {}) == rows[0] + bytes(8)
    assert pdf_filters.ascii_hex(b"48 65 6C6c 7>", {}) == b"Hellp"
    assert pdf_filters.run_length(bytes([2, 65, 66, 67, 254, 90, 128, 9]), {}) == b"ABCZZZ"
    with pytest.raises(ValueError):
        pdf_filters.unpredicted(b"x", {"Predictor": 5})
    with pytest.raises(ValueError):
        pdf_filters.ascii85(b"\x7f\x7f", {})


def test_filters_in_files(spark):
    pixels = bytes(range(24))
    stored = zlib.compress(filtered([pixels[:12], pixels[12:]], [4, 1], 3))
    image = b"<< /Type /XObject /Subtype /Image /Width 4 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter [/ASCIIHexDecode /FlateDecode] /DecodeParms [null << /Predictor 15 /Colors 3 /Columns 4 >>] /Length %d >>\nstream\n%s>\nendstream" % (2 * len(stored) + 1, stored.hex().encode())
    data = make_pdf([b"/Im Do"], bytes(12)).replace(b"4 0 obj\n<< /Type /XObject", b"4 0 obj\n" + image + b"\nendobj\n5 0 obj\n<< /Type /XObject")
    fax = make_pdf([b"/Im Do"], bytes(12)).replace(b"/BitsPerComponent 8", b"/BitsPerComponent 8 /Filter /CCITTFaxDecode")
    deep = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n" + b"".join(b"%d 0 obj\n<< /Kids [%d 0 R] >>\nendobj\n" % (n, n + 1) for n in range(2, 90))
    loop = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n2 0 R\nendobj\n"
    rows = pdf.parsed(files_of(spark, a=data, fax=fax, deep=deep, loop=loop))
    found = {r["doc"]: r for r in pdf.images_of(rows).collect()}
    assert bytes(found["a"]["bytes"]) == pixels and found["fax"]["error"] == "ValueError: filter CCITTFaxDecode" and found["fax"]["hash"] is None
    errors = {r["doc"]: r["error"] for r in pdf.pages_of(rows).collect()}
    assert "64 levels" in errors["deep"] and "without an end" in errors["loop"] and errors["a"] is None


def test_a_file_is_parsed_once_in_a_run(spark, documents, monkeypatch, tmp_path):
    made = []
    real = pdf.parsed
    monkeypatch.setattr(evaluate.pdf, "parsed", lambda files: made.append(1) or real(files))
    tools = evaluate.Tools(ocr=lambda: Counting(str(tmp_path)), render=lambda: Draw(), commands={})
    got = texts(spark, documents, ["unpdf", "pdfjs-dist", "hibrido2", "hibrido-unpdf-bbox"], tools)
    assert len(made) == 1 and len(got) == 8


def test_items_have_places_sizes_and_widths(spark):
    data = make_pdf([b"BT /F1 10 Tf 5 50 Td (ab) Tj (c) Tj 2 0 0 2 100 50 Tm [(x) -1000 (y)] TJ ET"])
    items = pdf.read_items(files_of(spark, a=data)).orderBy("item_idx").collect()
    assert [(r["str"], r["x"], r["size"], r["width"], r["font"]) for r in items] == [("ab", 5, 10, 10, "Helvetica"), ("c", 15, 10, 5, "Helvetica"), ("x y", 100, 20, 40, "Helvetica")]
