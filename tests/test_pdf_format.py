"""PDF files as a data source, batch and stream; scanned pages without an external renderer."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest

from foliant.plans import evaluate
from foliant.sources import canvas, pdf, pdf_format, results
from tests.test_demand import with_images
from tests.test_sources import make_pdf


def text(*words):
    return [b"BT /F1 9 Tf 10 10 Td (" + w + b") Tj ET" for w in words]


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(pdf_format.PdfFormat)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    (tmp_path / "a.pdf").write_bytes(make_pdf(text(b"a0", b"a1", b"a2", b"a3", b"a4")))
    (tmp_path / "b c.PDF").write_bytes(make_pdf(text(b"b0"), bytes(range(12))))
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    (tmp_path / "none.txt").write_bytes(b"x")
    return str(tmp_path)


def test_rows_equal_those_of_a_scan(spark, folder):
    columns = ["doc", "file", "page_idx", "num_pages", "error", "width", "text", "items", "ops", "images"]
    want = sorted(map(str, pdf.parsed(results.scan_documents(spark, folder)).select(*columns).collect()))
    for most in (pdf_format.BYTES, 700):  # the larger file is then read in ranges of its pages
        read = spark.read.format("foliant-pdf").option("bytes", most).load(folder)
        assert sorted(map(str, read.select(*columns).collect())) == want
    assert read.rdd.getNumPartitions() > 2
    assert spark.read.format("foliant-pdf").load(folder + "/nowhere").count() == 0
    assert spark.read.format("foliant-pdf").load("file://" + folder).count() == 7


def test_filters_reach_the_reader(spark, folder, tmp_path):
    read = spark.read.format("foliant-pdf").load(folder)
    assert [r["text"] for r in read.filter("doc = 'a' AND page_idx >= 1 AND page_idx < 3").orderBy("page_idx").collect()] == ["a1", "a2"]
    assert [r["text"] for r in read.filter("page_idx IN (0, 4)").orderBy("text").collect()] == ["a0", "a4", "b0"]
    assert read.filter("error IS NOT NULL").count() == 1 and read.filter("doc = 'none'").count() == 0
    reader = pdf_format.PdfReader(folder, pdf_format.BYTES, read.schema)
    left = list(reader.pushFilters([pdf_format.EqualTo(("doc",), "a"), pdf_format.LessThan(("page_idx",), 1), pdf_format.GreaterThan(("width",), 5)]))
    assert len(left) == 3 and reader.docs == {"a"}
    (tmp_path / "broken.pdf").unlink()  # not opened, so not missed
    part = reader.partitions()
    assert [f for p in part for f in p.files] == [(f"{folder}/a.pdf", "a")]
    assert [r["text"] for b in reader.read(part[0]) for r in b.to_pylist()] == ["a0"]
    seen = []
    pdf.Document((tmp_path / "a.pdf").read_bytes(), lambda i, n: seen.append((i, n)) or i == 2)
    assert seen == [(i, 5) for i in range(5)]


def test_arriving_files_are_streamed_once(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format("foliant-pdf").load(folder).select("doc", "page_idx", "text")
        stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["doc"], r["page_idx"], r["text"]) for r in spark.read.parquet(str(out / "rows")).collect() if r["text"] is not None)

    first = run()
    assert first == [("a", i, f"a{i}") for i in range(5)] + [("b c", 0, "b0")]
    late = os.path.join(folder, "late.pdf")
    with open(late, "wb") as f:
        f.write(make_pdf(text(b"new")))
    last = max(os.stat(os.path.join(folder, n)).st_mtime_ns for n in os.listdir(folder))
    os.utime(late, ns=(last, last))
    assert run() == sorted([*first, ("late", 0, "new")]) == run()


def pixels(data):
    w, h = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT") + 4
    rows = np.frombuffer(zlib.decompress(data[at : at + int.from_bytes(data[at - 8 : at - 4], "big")]), np.uint8).reshape(h, 1 + 4 * w)
    return rows[:, 1:].reshape(h, w, 4)[..., 0]


def test_images_are_drawn_where_they_stand():
    grey = bytes([0, 50, 100, 150])  # two rows of two
    data = with_images([b"q 100 0 0 200 50 60 cm /I0 Do Q", b"q 0 100 -100 0 150 100 cm /I0 Do Q", b"", b"BT /F1 9 Tf (x) Tj ET /I0 Do"], [(2, 2, grey)])
    draw = canvas.ImageCanvas()
    upright = pixels(draw(data, 0, 1.0))
    assert upright.shape == (300, 200) and upright[0, 0] == 255
    # the box is 50 to 150 across and 60 to 260 up, so 40 to 240 down
    assert [upright[y, x] for y, x in ((41, 51), (41, 149), (239, 51), (239, 149), (39, 51), (41, 49))] == [0, 50, 100, 150, 255, 255]
    turned = pixels(draw(data, 1, 2.0))
    assert turned.shape == (600, 400)
    # a quarter turn to the left: the first row of the image is on the left, its first pixel at the bottom
    assert [turned[y, x] for y, x in ((399 - 2, 101 + 2), (201 + 2, 101 + 2), (399 - 2, 299 - 2), (201 + 2, 299 - 2))] == [0, 50, 100, 150]
    for page, says in ((2, "no image"), (3, "text needs")):
        with pytest.raises(ValueError, match=says):
            draw(data, page, 1.0)


class Darkest:
    def __call__(self, png, rectangle=None):
        px = pixels(png)
        if rectangle:
            left, top, w, h = rectangle
            px = px[top : top + h, left : left + w]
        return [(f"darkest-{px.min()}-{px.shape[1]}x{px.shape[0]}", 90.0)]


def test_scanned_pages_run_without_a_renderer(spark):
    data = with_images([b"q 200 0 0 300 0 0 cm /I0 Do Q", b"q 100 0 0 100 20 30 cm /I1 Do Q", b"BT /F1 9 Tf (words) Tj ET", b""], [(400, 300, bytes([7]) * 120000), (500, 300, bytes([9]) * 150000)])
    files = spark.createDataFrame([("scan", bytearray(data))], "doc string, content binary")
    got = {r["extractor"]: r for r in evaluate.runs(spark, files, ["tesseract", "hibrido-unpdf-bbox"], evaluate.Tools(ocr=lambda: Darkest(), render=lambda: canvas.ImageCanvas(), commands={})).collect()}
    assert got["tesseract"]["text"] == "darkest-7-400x600\n\ndarkest-9-400x600\n\n\n\n" and got["tesseract"]["error"] is None
    assert got["hibrido-unpdf-bbox"]["text"] == "darkest-7-400x600\n\ndarkest-9-208x208\n\nwords\n\n"
