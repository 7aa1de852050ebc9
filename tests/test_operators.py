from __future__ import annotations

import random

from pyspark.sql import functions as F

from foliant.operators import blocks, geometry, gold, images, pages, scoreboard
from foliant.operators.extractors import REGISTRY, Inputs, extract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_overlap_cleaning(spark):
    clean = lambda o, v: one(spark, images.clean_overlap(F.lit(o), F.lit(v)))
    assert clean("Plano anual. Meta nova 2024", "plano anual da empresa") == "Meta nova 2024"
    assert clean("a\nb. C", "") == "a\nb. C"
    assert clean("aa bb cc dd ee", "aa bb cc") == ""  # three of five
    assert clean("aa bb cc dd ee. ??", "aa bb") == "aa bb cc dd ee"


def test_scale_merge(spark):
    rows = [("k", 1.0, "a casa azul"), ("k", 2.0, "casa,"), ("t", 1.0, "ab cd"), ("t", 2.0, "ef gh"), ("e", 1.0, ""), ("e", 2.0, "")]
    got = {r["key"]: r["text"] for r in images.merge_scales(spark.createDataFrame(rows, "key string, scale double, text string")).collect()}
    assert got == {"k": "a casa azul casa,", "t": "ab cd ef gh", "e": ""}


def test_confidence(spark):
    words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence")) for t, c in (("a", 59.9), ("b", 60.0), ("", 90.0), ("c", 95.0))])
    assert one(spark, images.confident(words)) == "b c"
    assert one(spark, images.confident(words, 0.0, F.lit("raw"))) == "raw"


PLACED = "doc string, page_idx long, img_idx int, width int, height int, hash string"


def test_backgrounds(spark):
    rows = [("one", 0, 0, 400, 400, "h")] + [("five", p, 0, 10 + p, 10, "x" if p < 2 else f"y{p}") for p in range(5)] + [("six", p, 0, 500 if p < 3 else 600, 500, f"z{p}") for p in range(6)]
    df = spark.createDataFrame(rows, PLACED)
    counts = spark.createDataFrame([("one", 1), ("five", 5), ("six", 6)], "doc string, num_pages int")
    assert [tuple(r) for r in images.background_by_hash(df, counts).collect()] == [("one", "h", 1)]
    assert sorted((r["doc"], r["width"]) for r in images.background_by_size(df, counts).collect()) == [("one", 400), ("six", 500)]


def test_an_image_twice_on_a_page_is_appended_twice(spark):
    df = spark.createDataFrame([("d", 1, 0, 400, 400, "h"), ("d", 1, 1, 400, 400, "h"), ("d", 0, 0, 400, 400, "g")], PLACED)
    nothing = spark.createDataFrame([], "doc string, hash string")
    found = images.targets(df, nothing)
    text = spark.createDataFrame([("h", "Text H"), ("g", "Text G")], "hash string, text string")
    own = spark.createDataFrame([("d", 0, ""), ("d", 1, "own"), ("d", 2, "left")], "doc string, page_idx long, text string")
    got = {r["page_idx"]: r["text"] for r in images.append(own, images.fan_out(found, text)).collect()}
    assert got == {0: "Text G", 1: "own\nText H\nText H", 2: "left"}


def test_rectangles_and_boxes(spark):
    c = geometry.canvas_rectangle(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0), F.lit(0.0), F.lit(200.0))
    assert [one(spark, c[k]) for k in ("left", "top", "width", "height")] == [16, 276, 68, 88]
    ops = spark.createDataFrame([([("transform", [30.0, 0.0, 0.0, 40.0, 10.0, 20.0], 0, 0), ("image", None, 7, 8), ("restore", None, 0, 0), ("inline_image", None, None, None)],)], "ops array<struct<op:string,m:array<double>,width:int,height:int>>")
    got = ops.select(geometry.image_boxes(F.col("ops")).alias("b")).first()["b"]
    assert [tuple(b) for b in got] == [(10, 20, 30, 40, 7, 8), (0, 0, 1, 1, 0, 0)]


def test_scoreboard_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "pdf string, extrator string, v int")
    new = spark.createDataFrame([("b", "x", 9), ("c", "y", 3)], "pdf string, extrator string, v int")
    merged = scoreboard.upsert(old, new, scoreboard.KEY)
    want = {("a", "x", 1), ("b", "x", 9), ("c", "y", 3)}
    assert {tuple(r) for r in merged.collect()} == want == {tuple(r) for r in scoreboard.upsert(merged, new, scoreboard.KEY).collect()}
    assert [r["pdf"] for r in scoreboard.merge_run(old, new, True).collect()] == ["a", "b", "c"]
    assert scoreboard.preserved(old, new).first()[0] == 1


def test_refusals_and_costs(spark):
    ask = lambda s, i, o: one(spark, gold.refused(F.lit(s), F.lit(i), F.lit(o)))
    assert ask("end_turn", 10000, 499) and not ask("end_turn", 10000, 500) and not ask(None, 10000, 1)
    assert one(spark, gold.cost(F.lit(52291), F.lit(2849))) == 0.1996
    assert one(spark, gold.rate_limited(F.lit("got 429"))) and not one(spark, gold.rate_limited(F.lit(None).cast("string")))


def test_transcription_bisects(spark):
    bad = {(0, 21), (10, 21), (15, 21), (15, 18), (16, 18)}

    def client():
        def ask(doc, start, end):
            if doc == "limited":
                raise RuntimeError("429 slow down")
            if (start, end) in bad:
                raise RuntimeError("too much")
            return {"text": f"{start + 1}-{end}", "tokens_in": 10, "tokens_out": 1000, "stop_reason": "end_turn"}

        return ask

    counts = spark.createDataFrame([("d", 21), ("limited", 4)], "doc string, num_pages int")
    got = {r["doc"]: r for r in gold.assemble(gold.transcribe(counts, client, wait=lambda s: None)).collect()}
    d = got["d"]
    assert d["text"].split("\n\n") == ["1-10", "11-15", "16-16", "17-17", "18-18", "19-21"]
    assert d["num_chunks"] == 11 and max(c["depth"] for c in d["chunks"]) == 5 and not d["partial"] and not d["refused"]
    assert got["limited"]["partial"] and got["limited"]["num_chunks"] == 1 and got["limited"]["text"] == ""


def test_pages(spark):
    df = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("e", 0, None)], "doc string, page_idx long, text string")
    assert {r["doc"]: r["text"] for r in pages.join_pages(df).collect()} == {"d": "a\n\nb", "e": ""}
    four = spark.createDataFrame([("s", p, "") for p in range(4)], "doc string, page_idx long, text string")
    p = pages.profile(four, gold=spark.createDataFrame([("s", "x" * 80)], "doc string, text string")).first()
    assert (p["chars"], p["chars_max"], p["few_text_pages"]) == (8, 0, [1, 2, 3, 4]) and tuple(p["with_gold"]) == (80, 0.1, 0.9)


def test_blocks(spark):
    rows = [("title", "T", 0, 1, None, 50.0), ("odd", "x", 0, None, None, None), ("list", None, -1, 7, [1.0], 101.0)]
    df = spark.createDataFrame(rows, "type string, text string, page_idx int, level int, bbox array<double>, ocr_confidence double")
    assert [r[0] for r in df.select(blocks.violations()).collect()] == [[], ["type"], ["text", "page_idx", "level", "bbox", "ocr_confidence"]]
    keys = F.array(F.lit("type"), F.lit("colour"))
    assert df.limit(1).select(blocks.violations(keys=keys)).first()[0] == ["extra"]


def test_reading_order(spark):
    rows = [("d", 0, x, y, 100.0, 10.0, t) for x, y, t in ((300.0, 100.0, "c"), (0.0, 100.0, "a"), (0.0, 115.0, "b"), (300.0, 115.0, "d"))] + [("d", 0, 0.0, 20.0, 400.0, 10.0, "title")]
    df = spark.createDataFrame(rows, "doc string, page_idx int, x double, y double, w double, h double, text string")
    got = blocks.reading_order(df).orderBy("turn").collect()
    assert [r["text"] for r in got] == ["title", "a", "b", "c", "d"]
    many = [("d", 0, 0.0, float(30 * i), 100.0, 10.0, str(i)) for i in range(30)]
    random.Random(1).shuffle(many)
    got = blocks.reading_order(spark.createDataFrame(many, df.schema)).orderBy("turn").collect()
    assert [r["text"] for r in got] == [str(i) for i in range(30)]


def test_reading_order_of_many_cuts_and_of_pages_across_batches(spark):
    schema = "doc string, page_idx int, x double, y double, w double, h double, place int"
    rows = [("deep", 0, 0.0, float(30 * i), 100.0, 10.0, i) for i in range(1500)]  # one cut below another
    rows += [("d", p, 300.0 * c, 12.0 * i, 200.0, 10.0, n * c + i) for p, n in enumerate((1, 5, 40, 3)) for c in (0, 1) for i in range(n)]
    random.Random(2).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = blocks.reading_order(spark.createDataFrame(rows, schema)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and all(r["turn"] == r["place"] for r in got)
    assert blocks.reading_order(spark.createDataFrame([], schema)).count() == 0


def inputs(spark):
    backends = ("pdf-parse", "pdfjs-dist", "unpdf", "pdf2json", "mupdf", "docling", "mineru")
    vector = [(b, "d", p, t) for b in backends for p, t in ((0, "plano anual da empresa"), (1, "x" * 150), (2, ""))]
    placed = [("d", 0, 0, 400, 400, "h1"), ("d", 1, 0, 300, 500, "h2"), ("d", 1, 1, 10, 10, "small"), ("d", 2, 0, 640, 480, "h1"), ("d", 0, 9, 999, 999, "bg"), ("d", 1, 9, 999, 999, "bg"), ("d", 2, 9, 999, 999, "bg"), ("d", 0, 3, 700, 300, "h3")]
    words = [(h, m, p, s, i, t, c) for m in ("standard", "best") for p in (False, True) for s in (1.0, 2.0) for h, ws in (("h1", [("Plano", 90.0), ("anual.", 90.0), ("Novo", 90.0), ("texto", 20.0)]), ("h2", [("Tabela", 80.0), (m, 80.0)]), ("h3", [("Tres", 99.0), ("scale" + str(int(s)), 99.0)])) for i, (t, c) in enumerate(ws)]
    page_text = [(r, "d", p, f"page ocr {p}") for r in ("mupdf", "unpdf") for p in range(3)]
    return Inputs(
        counts=spark.createDataFrame([("d", 3)], "doc string, num_pages int"),
        vector=spark.createDataFrame(vector, "backend string, doc string, page_idx long, text string"),
        placements=spark.createDataFrame(placed, PLACED),
        words=spark.createDataFrame(words, "hash string, model string, prep boolean, scale double, word_idx int, text string, confidence double"),
        page_text=spark.createDataFrame(page_text, "renderer string, doc string, page_idx long, text string"),
        box_text=spark.createDataFrame([("d", 0, 0, 400, 400, " boxed text "), ("d", 1, 0, 400, 401, "no")], "doc string, page_idx long, img_idx int, width int, height int, text string"),
        blocks=spark.createDataFrame([("d", 2, "image", 80.0, 80.0)], "doc string, page_idx long, type string, w double, h double"),
        sizes=spark.createDataFrame([("d", p, 100.0, 100.0) for p in range(3)], "doc string, page_idx long, width double, height double"),
        failures=spark.createDataFrame([("mineru", "d", "exit 1")], "extractor string, doc string, error string"),
    )


def test_every_registered_pipeline(spark):
    assert len(REGISTRY) == 23
    x = "x" * 150
    names = ["unpdf", "hibrido", "hibrido2", "hibrido-unpdf", "hibrido-unpdf-img", "hibrido-unpdf-img-hash", "hibrido-unpdf-img-hash-clean", "hibrido-clean-conf", "hibrido-clean-best", "hibrido-clean-multi", "hibrido-unpdf-bbox", "mineru"]
    got = {r["extractor"]: r for r in extract(inputs(spark), names).collect()}
    own = "plano anual da empresa"
    text = {k: r["text"].split("\n\n") for k, r in got.items()}
    assert text["unpdf"] == [own, x, ""]
    assert text["hibrido"] == [own + "\npage ocr 0", x, "page ocr 2"]
    assert text["hibrido2"] == [own, x, "page ocr 2"]
    assert text["hibrido-unpdf"] == ["page ocr 0", "page ocr 1", "page ocr 2"]
    assert text["hibrido-unpdf-img-hash"] == [own + "\nTres scale1", x + "\nTabela standard", ""]  # h1 is on two of three pages: background
    assert text["hibrido-unpdf-img-hash-clean"] == [own + "\nTres scale1", x + "\nTabela standard", ""]
    assert text["hibrido-clean-best"][1] == x + "\nTabela best"
    assert text["hibrido-clean-multi"][0] == own + "\nTres scale1 scale2"
    assert text["hibrido-unpdf-img"][2] == "Plano anual. Novo texto" and text["hibrido-unpdf-bbox"][0] == own + "\nboxed text"
    assert (got["mineru"]["text"], got["mineru"]["num_pages"], got["mineru"]["error"]) == ("", 0, "exit 1")
