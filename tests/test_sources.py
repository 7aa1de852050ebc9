from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import geometry, scoreboard
from foliant.sources import engines, pdf, png, results
from foliant.streaming import incremental


def make_pdf(contents: list[bytes], image: bytes | None = None, flate: bool = True) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects[2] = b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /MediaBox [0 0 200 300] >>" % len(contents)
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    if image is not None:
        objects[4] = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length %d >>\nstream\n" % len(image) + image + b"\nendstream"
    for i, c in enumerate(contents):
        body = zlib.compress(c) if flate else c
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im 4 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if flate else b"") + body + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


CONTENT = [
    b"BT /F1 12 Tf 10 250 Td (Ol\\341 \\(mundo\\)) Tj 0 -20 Td [(ab) -300 (cd)] TJ ET",
    b"q 30 0 0 40 10 20 cm /Im Do Q Q /Im Do BT /F1 9 Tf 1 0 0 1 5 5 Tm <48 69> Tj ET",
]


def test_pdf_tables(spark):
    image = bytes(range(12))
    rows = [("good", bytearray(make_pdf(CONTENT, image))), ("plain", bytearray(make_pdf(CONTENT[:1], image, False))), ("bad", bytearray(b"no pdf")), ("locked", bytearray(make_pdf(CONTENT).replace(b"trailer << ", b"trailer << /Encrypt 9 0 R ")))]
    files = spark.createDataFrame(rows, "doc string, content binary")
    got = {(r["doc"], r["page_idx"]): r for r in pdf.read_pages(files).collect()}
    assert got["good", 0]["text"] == "Olá (mundo)\nab cd" == got["plain", 0]["text"]
    assert got["good", 1]["text"] == "Hi" and (got["good", 1]["width"], got["good", 1]["height"]) == (200, 300)
    assert "ValueError" in got["bad", None]["error"] and "encrypted" in got["locked", None]["error"]
    items = pdf.read_items(files).filter("doc = 'good' AND page_idx = 0").orderBy("item_idx").collect()
    assert [(r["str"], r["x"], r["y"]) for r in items] == [("Olá (mundo)", 10, 250), ("ab cd", 10, 230)]
    placed = pdf.read_images(files).filter("doc = 'good'").collect()
    assert len(placed) == 2 and bytes(placed[0]["bytes"]) == image and placed[0]["channels"] == 3
    ops = pdf.read_operators(files).filter("doc = 'good' AND page_idx = 1").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("op_idx", "op", "m", "width", "height"))), lambda x: F.struct(x["op"].alias("op"), x["m"].alias("m"), x["width"].alias("width"), x["height"].alias("height"))).alias("ops"))
    boxes = ops.select(geometry.image_boxes(F.col("ops")).alias("b")).first()["b"]
    assert [tuple(b)[:4] for b in boxes] == [(10, 20, 30, 40), (0, 0, 1, 1)]


def test_pixels():
    grey = png.to_rgba(bytes([0, 100, 200, 255]), 2, 2, 1)
    assert grey[1, 0].tolist() == [200, 200, 200, 255] and png.to_rgba(bytes(12), 2, 2, 3)[0, 0].tolist() == [0, 0, 0, 255]
    assert png.binarized(grey)[..., 0].tolist() == [[0, 0], [255, 255]]
    assert png.scaled(grey, 2).shape == (4, 4, 4) and png.scaled(grey, 1) is grey
    data = png.encode(grey)
    w, h = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT") + 4
    rows = np.frombuffer(zlib.decompress(data[at : at + int.from_bytes(data[at - 8 : at - 4], "big")]), np.uint8).reshape(h, 1 + 4 * w)
    assert (w, h) == (2, 2) and (rows[:, 1:].reshape(2, 2, 4) == grey).all()


def test_engines(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"))], "doc string, content binary")
    run = lambda *c: engines.convert(files, list(c)).first()
    assert run("sh", "-c", "cp {pdf} {out}/a.md")["text"] == "x"
    assert run("sh", "-c", "echo no >&2; exit 3")["error"].startswith("exit 3: no") and run("true")["error"] == "no output file"
    assert "FileNotFoundError" in run("no-such-command-here")["error"]
    images = spark.createDataFrame([("h", 1, 1, 1, bytearray(b"\x01")), ("h", 1, 1, 1, bytearray(b"\x01")), ("bad", 9, 9, 2, bytearray(b""))], "hash string, width int, height int, channels int, bytes binary")
    words = engines.recognize(images, lambda: lambda data, rectangle=None: [(f"{len(data) > 50}", 70.0)], scales=(1.0, 2.0)).collect()
    assert sorted((r["hash"], r["scale"], r["text"]) for r in words) == [("h", 1.0, "True"), ("h", 2.0, "True")]
    wanted = spark.createDataFrame([("a", 0), ("a", 1)], "doc string, page_idx long")
    pages = engines.recognize_pages(files, wanted, lambda: lambda content, page, scale: b"" if page else 1 / 0, lambda: lambda data, rectangle=None: [("p", 1.0), ("q", 1.0)])
    assert [tuple(r) for r in pages.collect()] == [("mupdf", "a", 1, "p q")]


def test_results_round_trip(spark, tmp_path):
    rows = [("a", "x", 1, 0.5, 2, 0.1, 0.2, 0.3, 0.4, 0.5, 'quote " and, comma\nand line'), ("b", "x", 1, 1.25, 2, 1.0, 1.0, 1.0, 1.0, 1.0, None)]
    results.write_results(spark.createDataFrame(rows, scoreboard.RESULT), str(tmp_path / "r"))
    got = sorted(map(tuple, results.read_results(spark, str(tmp_path / "r")).collect()))
    assert got == [rows[0], (*rows[1][:-1], "")]
    assert results.read_results(spark, str(tmp_path / "none")).count() == 0
    names = [f.name for f in scoreboard.RESULT.fields]
    (tmp_path / "old.csv").write_text(",".join(names) + "\n" + "new,x,1,0.5,2,0.1,0.2,0.3,0.4,0.5,\n" + "old,x,1,0.5,2,0.1,0.2,0.3,0.4,bad\n" + "short,x,1,0.5,2,0.1,0.2,0.3,bad\n")
    got = {r["pdf"]: r for r in results.read_results(spark, str(tmp_path / "old.csv")).collect()}
    assert set(got) == {"new", "old"} and got["new"]["qualidade_excesso"] == 0.5
    assert (got["old"]["qualidade_excesso"], got["old"]["erro"]) == (0.0, "bad")


def test_averages_and_json(spark):
    rows = [("a", "x", 1.0, ""), ("b", "x", 2.0, ""), ("c", "x", 0.0, "failed"), ("a", "z", 5.0, "")]
    df = spark.createDataFrame(rows, "pdf string, extrator string, v double, erro string")
    registry = spark.createDataFrame([("x",), ("y",)], "extrator string")
    got = scoreboard.averages(df, "extrator", ["v"], "erro", registry)
    assert {tuple(r) for r in got.collect()} == {("x", 3, 1, 1.5), ("y", 0, 0, 0.0)}
    value = json.loads(results.averages_json(got, "extrator").first()["value"])
    assert value["porExtrator"]["x"] == {"num_rows": 3, "num_errors": 1, "mean_v": 1.5} and "y" in value["porExtrator"]


def test_manifest_and_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schemaVersion": 1, "pdfs": {"a.pdf": {"tipo": "slides", "area": "x", "temImagens": None, "copyright": True, "notas": "n"}}}))
    assert results.read_manifest(spark, str(tmp_path / "m.json")).first().asDict() == {"doc_name": "a.pdf", "tipo": "slides", "area": "x", "fonte": None, "temImagens": None, "copyright": True, "notas": "n"}
    (tmp_path / "g.json").write_text(json.dumps({"a": {"numPaginas": 3, "chunks": [{"paginas": "pg 1-3", "depth": 0, "foiDividido": False}]}, "b": {"erro": "no", "recusaDetectada": True}}))
    got = {r["doc"]: r for r in results.read_gold_metadata(spark, str(tmp_path / "g.json")).collect()}
    assert got["a"]["chunks"][0]["paginas"] == "pg 1-3" and got["b"]["recusaDetectada"] and got["b"]["numPaginas"] is None


def test_scans(spark, tmp_path):
    (tmp_path / "Aula 1.PDF").write_bytes(b"12345")
    (tmp_path / "x.txt").write_text("um\n\ndois")
    assert [(r["doc"], r["length"]) for r in results.scan_documents(spark, str(tmp_path)).collect()] == [("Aula 1", 5)]
    assert [tuple(r) for r in results.scan_gold(spark, str(tmp_path)).collect()] == [("x", "um\n\ndois")]


def test_streamed_upsert(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], [("b", 6, 3), ("c", 7, 1)]):
        spark.createDataFrame(rows, "k string, v int, at int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v int, at int").parquet(source)
        incremental.upsert_stream(stream, out, ["k"], "at", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r["k"], r["v"]) for r in incremental.current(spark, out, ["k"]).collect()) == [("a", 2), ("b", 6), ("c", 7)]
