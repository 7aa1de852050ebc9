"""Whole runs from files, the command line, and files of results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foliant import cli
from foliant.operators import extractors, gold
from foliant.plans import evaluate
from foliant.sources import engines, pdf, pdf_slice, results
from foliant.sources.pdf_write import write_pdf
from tests.test_sources import CONTENT, make_pdf


@pytest.fixture
def folders(spark, tmp_path):
    for name in ("pdfs", "gold", "out"):
        (tmp_path / name).mkdir()
    (tmp_path / "pdfs" / "Aula 1.pdf").write_bytes(make_pdf(CONTENT, bytes(range(12))))
    (tmp_path / "pdfs" / "outra.PDF").write_bytes(make_pdf(CONTENT[:1]))
    (tmp_path / "pdfs" / "broken.pdf").write_bytes(b"no pdf")
    (tmp_path / "pdfs" / "without gold.pdf").write_bytes(make_pdf(CONTENT))
    for name, text in (("Aula 1", "Olá (mundo)\nab cd\n\nHi"), ("outra", "Olá mundo"), ("broken", "x")):
        (tmp_path / "gold" / f"{name}.txt").write_text(text, encoding="utf-8")
    return {k: str(tmp_path / k) for k in ("pdfs", "gold", "out")}


def options(folders, *more):
    return [*(x for k, v in folders.items() for x in (f"--{k}", v)), *more]


def test_benchmark(spark, folders):
    tools = evaluate.Tools(commands={"docling": ["false"], "mineru": ["sh", "-c", "printf 'Hi there' > {out}/a.md"]})
    assert cli.main(["benchmark", *options(folders)], spark, tools) == 0
    rows = {(r["pdf"], r["extrator"]): r for r in results.read_results(spark, folders["out"] + "/benchmark.csv").collect()}
    assert len(rows) == 3 * 23
    best = rows["Aula 1", "unpdf"]
    assert (best["num_paginas"], best["sim_levenshtein"], best["cobertura_palavras"], best["erro"]) == (2, 1.0, 1.0, "") and best["tempo_seg"] >= 0
    assert rows["Aula 1", "pdfjs-dist"]["sim_levenshtein"] == 1.0 and rows["Aula 1", "pdf2json"]["num_paginas"] == 2
    assert "no PDF header" in rows["broken", "unpdf"]["erro"] and rows["broken", "unpdf"]["num_paginas"] == 0
    assert rows["Aula 1", "hibrido"]["erro"] == evaluate.NO_OCR and rows["outra", "docling"]["erro"].startswith("exit 1")
    assert rows["outra", "mineru"]["num_caracteres"] == 8 and rows["outra", "mineru"]["erro"] == ""
    means = json.load(open(folders["out"] + "/benchmark.json"))["porExtrator"]
    assert len(means) == 23 and means["unpdf"]["num_errors"] == 1 and means["hibrido"]["mean_sim_levenshtein"] == 0
    # A filtered run replaces its own rows and keeps the others.
    mine = sum("unpdf" in n for n in extractors.REGISTRY)
    got = evaluate.benchmark(spark, **folders, only="AULA", only_extractor="UNPDF", tools=tools)
    assert (got.problem, got.rows, got.kept) == ("", mine, 69 - mine)
    assert results.read_results(spark, folders["out"] + "/benchmark.csv").count() == 69


def test_report_names_what_was_left_out(spark, folders, capsys):
    assert cli.main(["benchmark", *options(folders, "--apenas-extrator", "pdf-parse")], spark, evaluate.Tools(commands={})) == 0
    out = capsys.readouterr().out
    assert "left out, no gold text: without gold" in out and "pdf-parse: 1 failed, ValueError: no PDF header" in out and "\npdf-parse   " in out


def test_xray_files(spark, folders):
    assert cli.main(["xray", *options(folders)], spark) == 0
    import os

    where = folders["out"] + "/raio-x"
    assert sorted(f for f in os.listdir(where) if f[0] != ".") == ["Aula 1.json", "outra.json", "without gold.json"]
    got = json.load(open(where + "/Aula 1.json"))
    assert got["arquivo"] == "Aula 1.pdf" and got["numPaginas"] == 2 and got["dimensoesMedias"] == {"largura": 200, "altura": 300} and got["numImagensReportadas"] == 2 and got["paginasComPoucoTexto"] == [1, 2]
    assert got["caracteresPorPagina"]["min"] == 2 and got["comGabarito"]["caracteresGabarito"] == 21
    assert "comGabarito" not in json.load(open(where + "/without gold.json"))
    assert cli.main(["xray", *options(folders, "--apenas", "nosuch")], spark) == 1


class PageText:
    """A model that reads the text of the pages it is sent, and fails for more than two."""

    def __call__(self, prompt, pdf_base64):
        import base64

        pages = pdf.Document(base64.b64decode(pdf_base64)).pages
        if len(pages) > 2:
            raise RuntimeError("too many pages")
        return {"text": "|".join(p.text() for p in pages), "tokens_in": len(prompt), "tokens_out": 3, "stop_reason": "end_turn"}


def test_gold_from_a_model_that_gets_slices(spark, folders, tmp_path):
    spark.sparkContext.setCheckpointDir(folders["out"] + "/checkpoints")
    (tmp_path / "pdfs" / "five.pdf").write_bytes(make_pdf([b"BT /F1 9 Tf (p%d) Tj ET" % i for i in range(5)]))
    got = cli.make_gold(spark, folders["pdfs"], folders["gold"], folders["out"], only="five", model=lambda: PageText(), prompt="read")
    assert (got.problem, got.rows) == ("", 1)
    assert {r["doc"]: r["text"] for r in results.scan_gold(spark, folders["gold"]).collect()}["five"] == "p0|p1\n\np2\n\np3|p4\n"
    row = results.gold_metadata(spark, folders["out"] + "/gabaritos_metadata.json").first()
    assert row["numChunks"] == 5 and row["tokensInput"] == 12 and row["tempoSegundos"] >= 0
    assert [c["erro"] for c in row["chunks"]].count("too many pages") == 2


def test_nothing_to_do(spark, folders, tmp_path):
    assert cli.main(["benchmark", *options(folders, "--apenas", "nosuch")], spark) == 1
    assert cli.main(["benchmark", *options(folders, "--apenas-extrator", "nosuch")], spark) == 1
    assert cli.main(["benchmark", *options(folders, "--apenas", "without")], spark) == 1
    assert cli.main(["gold", *options(folders, "--apenas", "nosuch")], spark) == 1


class Ocr:
    def __call__(self, png, rectangle=None):
        return [("legivel", 90.0), ("baixo", 10.0)]


class Draw:
    def __call__(self, content, page_idx, scale):
        return b"page"


def test_pipelines_with_ocr(spark, folders):
    big = make_pdf([b"q 500 0 0 500 0 0 cm /Im Do Q BT /F1 9 Tf (Hi) Tj ET", b"", b""], bytes(400 * 300 * 3)).replace(b"/Width 2 /Height 2", b"/Width 400 /Height 300")
    two = make_pdf([b"BT /F1 9 Tf (a) Tj ET"] * 3)
    files = spark.createDataFrame([("big", bytearray(big)), ("two", bytearray(two))], "doc string, content binary")
    names = ["unpdf", "tesseract", "hibrido", "hibrido-unpdf-img", "hibrido-clean-conf"]
    got = {(r["extractor"], r["doc"]): r for r in evaluate.runs(spark, files, names, evaluate.Tools(ocr=lambda: Ocr(), render=lambda: Draw(), commands={})).collect()}
    assert len(got) == 10 and all(r["error"] is None for r in got.values())
    assert got["tesseract", "two"]["text"] == "legivel baixo\n\nlegivel baixo\n\nlegivel baixo" and got["hibrido", "big"]["text"].startswith("Hi\nlegivel baixo\n\n")
    assert got["hibrido-unpdf-img", "big"]["text"] == "Hi\nlegivel baixo\n\n\n\n" and got["unpdf", "big"]["text"] == "Hi\n\n\n\n"
    assert got["hibrido-clean-conf", "big"]["text"] == "Hi\nlegivel\n\n\n\n"  # the second word is too unsure


def test_gold(spark, folders):
    (spark.sparkContext.setCheckpointDir(folders["out"] + "/checkpoints"))
    assert cli.main(["gold", *options(folders)], spark) == 0
    texts = {r["doc"]: r["text"] for r in results.scan_gold(spark, folders["gold"]).collect()}
    assert texts["without gold"] == "Olá (mundo)\nab cd\n\nHi\n" and texts["outra"] == "Olá mundo"
    path = folders["out"] + "/gabaritos_metadata.json"
    first = {r["doc"]: r for r in results.read_gold_metadata(spark, path).collect()}
    assert set(first) == {"without gold"} and first["without gold"]["numPaginas"] == 2 and first["without gold"]["chunks"][0]["paginas"] == "pg 1-2"
    assert cli.main(["gold", *options(folders, "--apenas", "aula", "--forcar")], spark) == 0
    both = {r["doc"]: r for r in results.read_gold_metadata(spark, path).collect()}
    assert set(both) == {"without gold", "Aula 1"} and both["without gold"] == first["without gold"]


def test_rate_limits_in_any_case(spark):
    rows = spark.createDataFrame([("Rate_Limit_Error",), ("HTTP 429",), ("other",), (None,)], "e string")
    assert [r[0] for r in rows.select(gold.rate_limited(F.col("e"))).collect()] == [True, True, False, False]


def test_slices_and_counts(spark):
    data = make_pdf([b"BT /F1 9 Tf (p%d) Tj ET" % i for i in range(4)], bytes(range(12)))
    part = pdf_slice.slice_pages(data, 1, 3)
    document = pdf.Document(part)
    assert [p.text() for p in document.pages] == ["p1", "p2"] and document.pages[0].width == 200 and b"(p0)" not in part
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"none"))], "doc string, content binary")
    assert {r["doc"]: r["num_pages"] for r in pdf_slice.page_counts(files).collect()} == {"a": 4, "b": 0}
    ranges = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "doc string, start long, end long")
    got = {r["doc"]: r for r in pdf_slice.page_ranges(files, ranges).collect()}
    assert pdf.Document(bytes(got["a"]["pdf"])).pages[0].text() == "p0" and got["a"]["pdf_base64"] and got["b"]["pdf"] is None


def test_jpeg_images_are_read_as_files(spark):
    data = make_pdf(CONTENT[1:], b"\xff\xd8jpegbytes\xff\xd9").replace(b"/BitsPerComponent 8", b"/BitsPerComponent 8 /Filter /DCTDecode")
    files = spark.createDataFrame([("a", bytearray(data))], "doc string, content binary")
    found = pdf.read_images(files)
    assert [(r["format"], bytes(r["bytes"])) for r in found.collect()] == [("jpeg", b"\xff\xd8jpegbytes\xff\xd9")] * 2
    assert [r["text"] for r in engines.recognize(found, lambda: Ocr()).orderBy("word_idx").collect()] == ["legivel", "baixo"]


def test_one_file_for_each_document(spark, tmp_path):
    rows = spark.createDataFrame([("a b/ç", "eins\nzwei"), ("x=1", "")], "doc string, text string")
    results.write_texts(rows, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("*.txt")) == ["a b_ç.txt", "x=1.txt"]
    results.write_json(rows, str(tmp_path / "j"), "doc")
    assert json.loads((tmp_path / "j" / "x=1.json").read_text()) == {"text": ""}


def test_profiles_unpack_no_images(spark, monkeypatch):
    kept = []
    parsed = pdf.parsed
    monkeypatch.setattr(pdf, "parsed", lambda *a: kept.append(parsed(*a)) or kept[-1])
    content = write_pdf([(["some words"], [(0, (100, 0, 0, 80, 0, 0))])], [(400, 300, bytes(400 * 300))])
    files = spark.createDataFrame([("d", bytearray(content), len(content), 0.0)], "doc string, content binary, length int, mb double")
    got = evaluate.profiles(files, None).first()
    assert (got["numImagensReportadas"], got["caracteresExtraidos"], got["tamanhoBytes"]) == (1, 12, len(content))
    image = kept[0].first()["images"][0]
    assert (image["width"], image["height"], image["bytes"], image["hash"]) == (400, 300, None, None)
