"""Kinds, blocks and structured text of built PDFs."""

from __future__ import annotations

import pytest

from foliant.operators import blocks, layout
from foliant.sources import pdf
from tests.test_sources import make_pdf


def page(*lines):
    """Content that shows (size, x, y, text) lines; *font* F2 is bold, F3 of one width."""
    out = b""
    for size, x, y, text, *font in lines:
        out += b"BT /%s %d Tf 1 0 0 1 %d %d Tm (%s) Tj ET " % ((font or [b"F1"])[0], size, x, y, text)
    return out


def with_fonts(contents):
    fonts = b"/F1 3 0 R /F2 << /Type /Font /BaseFont /Helvetica-Bold >> /F3 << /Type /Font /BaseFont /Courier >>"
    return make_pdf(contents).replace(b"/F1 3 0 R", fonts)


BODY = [(10, 50, 640 - 12 * i, b"plain text of the body that goes on and on, line %d" % i) for i in range(3)]


def book(spark):
    pages = [
        page((8, 50, 760, b"A Book of Things"), (20, 50, 700, b"The Great Title"), *BODY, (14, 50, 590, b"A lesser title"), (10, 50, 570, b"- first item of the list"), (10, 60, 558, b"that goes on here"), (10, 50, 546, b"- second item"), (8, 50, 20, b"7")),
        page((8, 50, 760, b"A Book of Things"), *BODY, (10, 50, 590, b"a"), (10, 150, 590, b"b"), (10, 250, 590, b"c"), (10, 50, 578, b"1"), (10, 150, 578, b"2"), (10, 250, 578, b"3"), (10, 50, 540, b"Figure 2 shows it"), (8, 50, 20, b"8")),
        page((8, 50, 760, b"A Book of Things"), *BODY, (10, 50, 590, b"Exercise 3. Show that"), (10, 50, 560, b"x2 + 1 = 3*(4-2)/5"), (10, 50, 530, b"if (a) { b();", b"F3"), (10, 50, 500, b"> so it was said"), (10, 50, 470, b"Definition 1.2: a thing"), (10, 50, 440, b"Strong words", b"F2"), (8, 50, 20, b"9")),
    ]
    return pdf.parsed(spark.createDataFrame([("book", bytearray(with_fonts(pages)))], "doc string, content binary"))


@pytest.fixture(scope="module")
def typed(spark):
    rows = book(spark)
    return layout.classified(layout.text_lines(pdf.items_of(rows)), pdf.counts_of(rows)).persist()


def test_kinds_of_lines(typed):
    got = {(r["page_idx"], r["text"]): (r["type"], r["level"]) for r in typed.collect()}
    want = {
        (0, "A Book of Things"): ("header", None), (0, "The Great Title"): ("title", 1), (0, "A lesser title"): ("title", 2), (0, "- first item of the list"): ("list_item", None), (0, "7"): ("page_number", None),
        (0, "plain text of the body that goes on and on, line 1"): ("paragraph", None), (1, "b"): ("table", None), (1, "3"): ("table", None), (1, "Figure 2 shows it"): ("caption", None),
        (2, "Exercise 3. Show that"): ("exercise", None), (2, "x2 + 1 = 3*(4-2)/5"): ("formula", None), (2, "if (a) { b();"): ("code", None), (2, "> so it was said"): ("quote", None), (2, "Definition 1.2: a thing"): ("definition", None),
    }
    assert {k: got[k] for k in want} == want
    assert got[2, "Strong words"][0] == "title"


def test_blocks_keep_the_rules_and_render(spark, typed):
    images = spark.createDataFrame([("book", 1, 50.0, 552.0, 100.0, 20.0)], "doc string, page_idx int, x double, y double, w double, h double")
    made = layout.blocks(typed, images).persist()
    assert made.select(blocks.violations().alias("v")).filter("size(v) > 0").count() == 0
    rows = {(r["page_idx"], r["type"], r["text"]): r for r in made.collect()}
    item = rows[0, "list_item", "- first item of the list that goes on here"]
    parents = [r for r in rows.values() if r["type"] == "list"]
    assert len(parents) == 1 and item["parent_id"] == parents[0]["block_id"] == rows[0, "list_item", "- second item"]["parent_id"]
    assert (0, "paragraph", " ".join(b[3].decode() for b in BODY)) in rows
    assert rows[1, "image", ""]["image_caption"] == "Figure 2 shows it"
    assert (1, "table", "a\nb\nc\n1\n2\n3") in rows
    text = blocks.rendered(made).first()["markdown"]
    assert text.startswith("# The Great Title\n\nplain text") and "\n\n## A lesser title\n\n- - first item" in text and "A Book of Things" not in text
    assert "![Figure 2 shows it]()" in text


def test_columns_are_read_one_after_another(spark):
    left = [(10, 50, 700 - 12 * i, b"left column line %d" % i) for i in range(4)]
    right = [(10, 300, 700 - 12 * i, b"right column line %d" % i) for i in range(4)]
    rows = pdf.parsed(spark.createDataFrame([("two", bytearray(make_pdf([page(*[x for pair in zip(left, right) for x in pair])])))], "doc string, content binary"))
    own = rows.first()["text"]
    got = layout.structured_text(pdf.items_of(rows)).first()["text"]
    assert own.startswith("left column line 0 right column line 0\nleft")
    assert got == "\n".join(x[3].decode() for x in left) + "\n\n" + "\n".join(x[3].decode() for x in right)


def test_blanks_are_kept(spark):
    rows = pdf.parsed(spark.createDataFrame([("gaps", bytearray(make_pdf([page((10, 50, 700, b"ab"), (10, 70, 700, b"cd"), (10, 80, 700, b"ef"), (10, 50, 690, b" "), (10, 50, 680, b"next"))])))], "doc string, content binary"))
    lines = [r["text"] for r in layout.text_lines(pdf.items_of(rows)).orderBy("band", "line").collect()]
    assert lines == ["ab  cdef", "next"]


def test_nothing_gives_nothing(spark):
    items = spark.createDataFrame([], "doc string, page_idx int, item_idx int, str string, x double, y double, size double, width double, font string")
    counts = spark.createDataFrame([("a", 1)], "doc string, num_pages long")
    assert layout.blocks(layout.classified(layout.text_lines(items), counts)).count() == 0 == layout.structured_text(items).count()
