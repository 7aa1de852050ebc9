"""Queries over whole runs from files: conversations written as PDF files, read and run through the pipelines.

A conversation is a document, a turn a page: its words in lines of eight, and one of the document's three images, which are
of one grey and of different widths. The OCR engine reads an image's grey, or a rectangle's size.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans import evaluate
from foliant.plans.text_queries import long
from foliant.sources import pdf
from foliant.sources.pdf_write import write_pdf
from foliant.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Words of a line, images of a document, the smallest image's sides, and what one more is wider; where a page shows its image.
WORDS, IMAGES, WIDE, HIGH, WIDER = 8, 3, 400, 300, 50
PLACE = (120, 0, 0, 90, 36, 36)


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def conversation_files(spark: SparkSession, d: str) -> DataFrame:
    """doc, content and ``shade``, the grey of the document's first image."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), "").alias("w"))
    docs = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "w"))), lambda x: x["w"]).alias("pages"))

    @F.pandas_udf("binary")
    def content(pages, shade):
        import pandas as pd

        out = []
        for of_doc, grey in zip(pages, shade, strict=True):
            lines = [[" ".join(w[i : i + WORDS]) for i in range(0, len(w), WORDS)] for w in of_doc]
            images = [(WIDE + WIDER * k, HIGH, bytes([(grey + k) % 256]) * ((WIDE + WIDER * k) * HIGH)) for k in range(IMAGES)]
            out.append(write_pdf([(page, [(i % IMAGES, PLACE)]) for i, page in enumerate(lines)], images))
        return pd.Series(out)

    shaded = docs.withColumn("shade", (F.col("conv_id") % 256).cast("int"))
    return shaded.select(F.col("conv_id").cast("string").alias("doc"), content("pages", "shade").alias("content"), "shade")


class Shade:
    """An OCR engine that reads the grey of a PNG, or a rectangle's sides."""

    def __call__(self, png: bytes, rectangle=None):
        if rectangle:
            return [(f"box{rectangle[2]}x{rectangle[3]}", 90.0)]
        at = png.index(b"IDAT")
        row = zlib.decompressobj().decompress(png[at + 4 :], 2)
        return [(f"shade{row[1]}", 90.0), ("faint", 10.0)]


class Sheet:
    """A renderer for an engine that looks at rectangles only."""

    def __call__(self, content: bytes, page_idx: int, scale: float) -> bytes:
        return b""


_PAGES = f"""w AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM conversations),
pages AS (SELECT CAST(conv_id AS VARCHAR) AS doc, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, w) - 1 AS page_idx, count(*) OVER (PARTITION BY conv_id) AS num_pages,
  regexp_replace(array_to_string(list_transform(range(0, len(w), {WORDS}), lambda i: array_to_string(w[i + 1:i + {WORDS}], ' ')), chr(10)), '[^\\x00-\\xff]', '?', 'g') AS text FROM w)"""


@query(f"WITH {_PAGES} SELECT doc, page_idx, num_pages, sha256(text) AS digest, len(text) AS letters, 612.0 AS width, 792.0 AS height, {WIDE} + {WIDER} * (page_idx % {IMAGES}) AS image_width FROM pages")
def q_pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of files as they are read: text, sizes, images."""
    rows = pdf.parsed(conversation_files(spark, d))
    return rows.select("doc", long(F.col("page_idx")).alias("page_idx"), long(F.col("num_pages")).alias("num_pages"), F.sha2("text", 256).alias("digest"), long(F.length("text")).alias("letters"), "width", "height", long(F.col("images")[0]["width"]).alias("image_width"))


@query(f"""WITH {_PAGES} SELECT doc, count(*) AS pages, CAST(sum(len(text) + 2) AS BIGINT) AS letters, CAST(min(len(text)) AS BIGINT) AS least, CAST(max(len(text)) AS BIGINT) AS most,
  CAST(floor(sum(len(text)) / count(*) + 0.5) AS BIGINT) AS mean, count(*) FILTER (len(text) < 100) AS few, count(*) AS images, 612.0 AS width, 792.0 AS height FROM pages GROUP BY doc""")
def q_pdf_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The published profile of each file."""
    files = conversation_files(spark, d).withColumns({"length": F.length("content"), "mb": F.lit(0.0)})
    p = evaluate.profiles(files, None)
    return p.select(
        "doc", long(F.col("numPaginas")).alias("pages"), long(F.col("caracteresExtraidos")).alias("letters"), "caracteresPorPagina.min", "caracteresPorPagina.max", "caracteresPorPagina.media",
        long(F.size("paginasComPoucoTexto")).alias("few"), long(F.col("numImagensReportadas")).alias("images"), F.col("dimensoesMedias.largura").cast("double").alias("width"), F.col("dimensoesMedias.altura").cast("double").alias("height"),
    ).withColumnsRenamed({"min": "least", "max": "most", "media": "mean"})


_BEHIND = "CASE WHEN ocr IS NULL THEN text WHEN text = '' THEN ocr ELSE text || chr(10) || ocr END"
_NAMES = ["unpdf", "mupdf", "hibrido-unpdf-img-hash", "hibrido-clean-conf", "hibrido-unpdf-bbox"]


@query(f"""WITH {_PAGES}, shown AS (SELECT *, page_idx % {IMAGES} AS k FROM pages),
often AS (SELECT doc, k, count(*) AS pages, min(page_idx) AS first, any_value(num_pages) AS num_pages FROM shown GROUP BY doc, k),
by_size AS (SELECT doc, arg_min(k, struct_pack(a := -pages, b := first)) AS k, max(pages) AS pages, any_value(num_pages) AS num_pages FROM often GROUP BY doc),
found AS (SELECT s.*, CASE WHEN 2 * o.pages >= s.num_pages THEN NULL ELSE 'shade' || ((conv_id % 256 + s.k) % 256) END AS shade,
  CASE WHEN z.k = s.k AND 2 * z.pages >= s.num_pages THEN NULL ELSE 'box248x188' END AS box FROM shown s JOIN often o ON o.doc = s.doc AND o.k = s.k JOIN by_size z ON z.doc = s.doc),
runs AS (SELECT doc, page_idx, text, unnest({_NAMES}) AS extractor, shade, box FROM found),
read AS (SELECT extractor, doc, page_idx, text, CASE extractor WHEN 'hibrido-unpdf-img-hash' THEN shade || ' faint' WHEN 'hibrido-clean-conf' THEN shade WHEN 'hibrido-unpdf-bbox' THEN box END AS ocr FROM runs)
SELECT extractor, doc, sha256(string_agg({_BEHIND}, chr(10) || chr(10) ORDER BY page_idx)) AS digest, count(*) AS num_pages FROM read GROUP BY extractor, doc""")
def q_runs_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Five pipelines on the files, with an engine that is asked for what their gates let through."""
    tools = evaluate.Tools(ocr=lambda: Shade(), render=lambda: Sheet(), commands={})
    done = evaluate.runs(spark, conversation_files(spark, d).select("doc", "content"), _NAMES, tools)
    return done.filter("error IS NULL").select("extractor", "doc", F.sha2("text", 256).alias("digest"), long(F.col("num_pages")).alias("num_pages"))
