"""Registered extraction pipelines as plan builders.

All of them read one set of tables, ``Inputs``; a pipeline gives (doc, page_idx, text) rows, ``extract`` assembles
documents. OCR words are keyed by hash, model, pre-processing and scale, so that pipelines with the same calls share
them. A back-end whose engine is missing gives error rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import geometry, images
from foliant.operators.pages import dense_area, join_pages, ordered, pad_pages, poor


@dataclass(frozen=True)
class Inputs:
    """counts (doc, num_pages), vector (backend, doc, page_idx, text), placements, image_boxes, words, page_text, box_text, blocks, sizes."""

    counts: DataFrame
    vector: DataFrame
    placements: DataFrame | None = None  # doc, page_idx, img_idx, width, height, hash
    words: DataFrame | None = None  # hash, model, prep, scale, word_idx, text, confidence
    raw: DataFrame | None = None  # hash, model, prep, scale, text: OCR text where an engine reports no words
    page_text: DataFrame | None = None  # renderer, doc, page_idx, text: OCR of whole pages
    box_text: DataFrame | None = None  # doc, page_idx, img_idx, width, height, text: OCR of rectangles
    blocks: DataFrame | None = None  # doc, page_idx, type, w, h
    sizes: DataFrame | None = None  # doc, page_idx, width, height
    failures: DataFrame | None = None  # extractor, doc, error


@dataclass(frozen=True)
class HybridOptions:
    """Variants of the image hybrid: better model, least confidence, binarization before scaling, OCR scales."""

    best_model: bool = False
    least_confidence: float = 0.0
    binarize: bool = False
    scales: tuple[float, ...] = (1.0,)


def vector_pages(i: Inputs, backend: str) -> DataFrame:
    return pad_pages(i.vector.filter(F.col("backend") == backend).select("doc", "page_idx", "text"), i.counts)


def page_ocr(i: Inputs, renderer: str) -> DataFrame:
    return i.page_text.filter(F.col("renderer") == renderer).select("doc", F.col("page_idx").cast("long"), "text")


def every_page(i: Inputs) -> DataFrame:
    """doc, page_idx of all pages."""
    return i.counts.filter("num_pages > 0").select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_pages").cast("long") - 1)).alias("page_idx"))


def gate_poor(i: Inputs) -> DataFrame:
    """Pages with little text of their own."""
    return vector_pages(i, "mupdf").filter(poor(F.col("text"))).select("doc", "page_idx")


def gate_area(i: Inputs) -> DataFrame:
    """Pages that images fill."""
    return vector_pages(i, "mupdf").join(geometry.area_ratio(i.blocks, i.sizes), ["doc", "page_idx"]).filter(dense_area(F.col("text"), F.col("area_ratio"))).select("doc", "page_idx")


def gate_size(i: Inputs) -> DataFrame:
    """Pages with a large image in front of the background."""
    return images.needs_ocr(vector_pages(i, "unpdf"), i.placements, images.background_by_size(i.placements, i.counts)).select("doc", "page_idx")


def poor_pages(i: Inputs) -> DataFrame:
    """Own text, and OCR behind it on pages with little of it."""
    ocr = page_ocr(i, "mupdf").join(gate_poor(i), ["doc", "page_idx"], "left_semi")
    return images.append(vector_pages(i, "mupdf"), ocr.filter(F.length(F.trim("text")) > 0).select("doc", "page_idx", "text", F.lit(0).alias("turn"), F.lit(0).alias("copy")))


def area_pages(i: Inputs) -> DataFrame:
    """OCR instead of own text on pages that images fill."""
    return images.replace(vector_pages(i, "mupdf"), page_ocr(i, "mupdf").join(gate_area(i), ["doc", "page_idx"], "left_semi"))


def size_pages(i: Inputs) -> DataFrame:
    """OCR instead of own text on pages with a large image in front of the background."""
    return images.replace(vector_pages(i, "unpdf"), page_ocr(i, "unpdf").join(gate_size(i), ["doc", "page_idx"], "left_semi"))


def front(placements: DataFrame, counts: DataFrame) -> DataFrame:
    """Large placements that aren't of the background's size."""
    background = images.background_by_size(placements, counts).select("doc", "width", "height")
    return placements.filter(images.large(F.col("width"), F.col("height"))).join(background, ["doc", "width", "height"], "left_anti")


def every_image(i: Inputs) -> DataFrame:
    """OCR of each placement behind the page's text, in the page's order."""
    parts = front(i.placements, i.counts).join(image_text(i, HybridOptions()), "hash").filter(F.length(F.trim("text")) >= images.LEAST_TEXT)
    return images.append(vector_pages(i, "unpdf"), parts.select("doc", F.col("page_idx").cast("long"), F.trim("text").alias("text"), F.col("img_idx").alias("turn"), F.lit(0).alias("copy")))


def boxes(i: Inputs) -> DataFrame:
    """OCR of each image's rectangle on the rendered page, behind the page's text."""
    parts = front(i.box_text, i.counts)
    parts = parts.filter(F.length(F.trim("text")) >= images.LEAST_TEXT)
    return images.append(vector_pages(i, "unpdf"), parts.select("doc", F.col("page_idx").cast("long"), F.trim("text").alias("text"), F.col("img_idx").alias("turn"), F.lit(0).alias("copy")))


def image_text(i: Inputs, o: HybridOptions) -> DataFrame:
    """One OCR text for each hash under the options."""
    want = (F.col("model") == ("best" if o.best_model else "standard")) & (F.col("prep") == o.binarize) & F.col("scale").isin(*o.scales)
    key = ["hash", "model", "prep", "scale"]
    words = i.words.filter(want).groupBy(*key).agg(ordered(F.struct("text", "confidence"), F.col("word_idx")).alias("words"))
    one = words if i.raw is None else i.raw.filter(want).withColumnRenamed("text", "raw").join(words, key, "left")
    raw = F.array_join(F.transform("words", lambda w: w["text"]), " ") if i.raw is None else F.col("raw")
    one = one.select("hash", "scale", F.coalesce(images.confident(F.col("words"), o.least_confidence, raw), F.lit("")).alias("text"))
    if len(o.scales) == 1:
        return one.select("hash", "text")
    return images.merge_scales(one.withColumnRenamed("hash", "key")).select(F.col("key").alias("hash"), "text")


def hash_images(i: Inputs, o: HybridOptions = HybridOptions(), clean: bool = True) -> DataFrame:  # noqa: B008
    """OCR once for each image, on all its pages, without what the page says already."""
    pages = vector_pages(i, "unpdf")
    found = images.targets(i.placements, images.background_by_hash(i.placements, i.counts))
    text = image_text(i, o).filter(F.length("text") >= images.LEAST_TEXT)
    parts = images.fan_out(found, text).withColumn("page_idx", F.col("page_idx").cast("long"))
    if clean:
        own = pages.select("doc", "page_idx", F.col("text").alias("_own"))
        parts = parts.join(own, ["doc", "page_idx"]).withColumn("text", images.clean_overlap(F.col("text"), F.col("_own"))).drop("_own")
    return images.append(pages, parts.filter(F.length("text") >= images.LEAST_TEXT))


def _backend(name: str) -> Callable[[Inputs], DataFrame]:
    return lambda i: vector_pages(i, name)


def _whole(name: str) -> Callable[[Inputs], DataFrame]:
    return lambda i: pad_pages(page_ocr(i, name), i.counts)


#: Hybrids that read each image once (fixed values): their options, and whether what the page says already is left out.
HYBRIDS: dict[str, tuple[HybridOptions, bool]] = {
    "hibrido-unpdf-img-hash": (HybridOptions(), False),
    "hibrido-unpdf-img-hash-clean": (HybridOptions(), True),
    "hibrido-clean-best": (HybridOptions(best_model=True), True),
    "hibrido-clean-conf": (HybridOptions(least_confidence=60.0), True),
    "hibrido-clean-prep": (HybridOptions(binarize=True), True),
    "hibrido-clean-multi": (HybridOptions(scales=(1.0, 2.0)), True),
    "hibrido-clean-conf-multi": (HybridOptions(least_confidence=60.0, scales=(1.0, 2.0)), True),
    "hibrido-clean-prep-conf": (HybridOptions(binarize=True, least_confidence=60.0), True),
    "hibrido-clean-conf-best": (HybridOptions(least_confidence=60.0, best_model=True), True),
}

#: Pipelines by name (fixed values), in the order of their reports.
REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {
    "pdf-parse": _backend("pdf-parse"),
    "pdfjs-dist": _backend("pdfjs-dist"),
    "unpdf": _backend("unpdf"),
    "pdf2json": _backend("pdf2json"),
    "mupdf": _backend("mupdf"),
    "tesseract": _whole("mupdf"),
    "tesseract-unpdf": _whole("unpdf"),
    "hibrido": poor_pages,
    "hibrido2": area_pages,
    "hibrido-unpdf": size_pages,
    "hibrido-unpdf-img": every_image,
    **{name: (lambda i, o=o, clean=clean: hash_images(i, o, clean)) for name, (o, clean) in HYBRIDS.items()},
    "docling": _backend("docling"),
    "mineru": _backend("mineru"),
    "hibrido-unpdf-bbox": boxes,
}

#: What each pipeline asks of an OCR engine: the renderer and gate of its pages.
PAGE_GATES: dict[str, tuple[str, Callable[[Inputs], DataFrame]]] = {
    "tesseract": ("mupdf", every_page),
    "tesseract-unpdf": ("unpdf", every_page),
    "hibrido": ("mupdf", gate_poor),
    "hibrido2": ("mupdf", gate_area),
    "hibrido-unpdf": ("unpdf", gate_size),
}


def extract(i: Inputs, names: list[str] | None = None) -> DataFrame:
    """extractor, doc, text, num_pages, num_chars, error of each pipeline on each document; failed ones have no text."""
    out = None
    for name in names or list(REGISTRY):
        rows = join_pages(REGISTRY[name](i)).select(F.lit(name).alias("extractor"), "doc", "text", "num_pages")
        out = rows if out is None else out.unionByName(rows)
    if i.failures is not None:
        failed = i.failures.select("extractor", "doc", "error")
        out = out.join(failed, ["extractor", "doc"], "left")
        out = out.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise("")).withColumn("num_pages", F.when(F.col("error").isNull(), F.col("num_pages")).otherwise(0))
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.withColumn("num_chars", F.length("text")).select("extractor", "doc", "text", "num_pages", "num_chars", "error")
