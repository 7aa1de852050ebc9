"""Images on pages: background detection, OCR targets, merging OCR text into pages.

Placements are (doc, page_idx, img_idx, width, height, hash) rows; bytes stay in a table of their own, by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.textnorm import fold, let, split_words
from foliant.operators.pages import ordered

# Pixels of a large image, share of pages that a background fills, share of known words, letters of a text.
LARGE = 100_000
SHARE = 0.5
OVERLAP = 0.6
LEAST_TEXT = 5


def background_by_size(images: DataFrame, counts: DataFrame) -> DataFrame:
    """The most frequent size of each document by distinct pages (the first seen of equals), if half of the pages have it."""
    pages = images.groupBy("doc", "width", "height", "page_idx").agg(F.min("img_idx").alias("img_idx"))
    seen = pages.groupBy("doc", "width", "height").agg(F.count("*").alias("pages"), F.min(F.struct("page_idx", "img_idx")).alias("first"))
    best = seen.groupBy("doc").agg(F.min(F.struct((-F.col("pages")).alias("p"), "first", "width", "height")).alias("b")).select("doc", "b.width", "b.height", (-F.col("b.p")).alias("pages"))
    return best.join(counts, "doc").filter(F.col("pages") / F.col("num_pages") >= SHARE).select("doc", "width", "height", "pages")


def background_by_hash(images: DataFrame, counts: DataFrame) -> DataFrame:
    """All images that at least half of their document's pages hold."""
    seen = images.select("doc", "hash", "page_idx").distinct().groupBy("doc", "hash").agg(F.count("*").alias("pages"))
    return seen.join(counts, "doc").filter(F.col("pages") >= SHARE * F.col("num_pages")).select("doc", "hash", "pages")


def large(width: Column, height: Column, least: int = LARGE) -> Column:
    return width.cast("long") * height >= least


def needs_ocr(pages: DataFrame, images: DataFrame, background: DataFrame, letters: int = 200) -> DataFrame:
    """Pages with a large image that is no background, or with any large image and fewer than *letters* characters."""
    marked = images.filter(large(F.col("width"), F.col("height"))).join(background.select("doc", "width", "height", F.lit(True).alias("_bg")), ["doc", "width", "height"], "left")
    by_page = marked.groupBy("doc", "page_idx").agg(F.bool_or(F.col("_bg").isNull()).alias("_front"))
    return pages.join(by_page, ["doc", "page_idx"]).filter(F.col("_front") | (F.length("text") < letters)).drop("_front")


def targets(images: DataFrame, background: DataFrame) -> DataFrame:
    """Each image to read once: its pages with repetitions in order, the place it is first seen at."""
    use = images.filter(large(F.col("width"), F.col("height"))).join(background.select("doc", "hash"), ["doc", "hash"], "left_anti")
    return use.groupBy("doc", "hash").agg(ordered(F.col("page_idx"), F.struct("page_idx", "img_idx")).alias("pages"), F.min(F.struct("page_idx", "img_idx")).alias("first"))


def fan_out(found: DataFrame, text: DataFrame) -> DataFrame:
    """OCR text of each target on each of its pages: doc, page_idx, turn (order of first sight), text."""
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("first"))
    return found.withColumn("turn", turn).join(text, "hash").select("doc", F.posexplode("pages").alias("copy", "page_idx"), "turn", "text")


def append(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Pages with OCR parts behind their own text, a line feed before each, in order of first sight."""
    by_page = parts.groupBy("doc", "page_idx").agg(ordered(F.col("text"), F.struct("turn", "copy")).alias("_parts"))
    joined = pages.join(by_page, ["doc", "page_idx"], "left")
    full = F.array_join(F.concat(F.when(F.length("text") > 0, F.array("text")).otherwise(F.array().cast("array<string>")), F.col("_parts")), "\n")
    return joined.withColumn("text", F.when(F.col("_parts").isNull(), F.col("text")).otherwise(full)).drop("_parts")


def replace(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages whose text is the OCR text where there is one."""
    return pages.join(ocr.select("doc", "page_idx", F.col("text").alias("_ocr")), ["doc", "page_idx"], "left").withColumn("text", F.coalesce("_ocr", "text")).drop("_ocr")


def confident(words: Column, least: float = 60.0, raw: Column | None = None) -> Column:
    """Text of OCR words (text, confidence) that are sure enough; the raw text if *least* is 0 or there are no words."""
    kept = F.trim(F.array_join(F.transform(F.filter(words, lambda w: (w["confidence"] >= least) & (F.length(w["text"]) > 0)), lambda w: w["text"]), " "))
    return kept if raw is None else F.when(F.lit(least <= 0) | (F.size(F.coalesce(words, F.array())) == 0), raw).otherwise(kept)


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Parts between stops and line ends, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"[.!?\n\r]+"), _trim), lambda s: F.length(s) > 0)


def clean_overlap(ocr: Column, vector: Column, share: float = OVERLAP) -> Column:
    """Sentences of *ocr* that the page's own text doesn't hold already; all of it if the page has no text."""

    def cleaned(known: Column) -> Column:
        def new(sentence: Column) -> Column:
            shared = lambda parts: (F.size(parts) > 0) & (F.size(F.filter(parts, lambda w: F.array_contains(known, w))) / F.size(parts) < share)
            return let(split_words(fold(sentence), 2), shared)

        return F.when(F.size(known) == 0, ocr).otherwise(F.array_join(F.filter(sentences(ocr), new), " "))

    return let(F.array_distinct(split_words(fold(vector), 2)), cleaned)


def merge_scales(texts: DataFrame) -> DataFrame:
    """One text from several scales (key, scale, text): the longest, and words of the others that it lacks.

    Words are parts between blanks with their marks; one is new if its folded form, of at least 2 letters, is neither
    in the base nor among new words before it. Ties in length keep the earlier scale.
    """
    order = Window.partitionBy("key").orderBy(F.desc(F.length("text")), "scale")
    ranked = texts.withColumn("_rank", F.row_number().over(order))
    base = ranked.filter("_rank = 1").select("key", F.col("text").alias("_base"))
    known = base.select("key", F.explode(F.array_distinct(split_words(fold(F.col("_base")), 2))).alias("_n"))
    words = ranked.filter("_rank > 1").select("key", "_rank", F.posexplode(F.split("text", r"(?U)\s+")).alias("_pos", "_w")).withColumn("_n", fold(F.col("_w"))).filter(F.length("_n") >= 2)
    new = words.join(known, ["key", "_n"], "left_anti").groupBy("key", "_n").agg(F.min(F.struct("_rank", "_pos", "_w")).alias("_x"))
    more = new.groupBy("key").agg(F.array_join(ordered(F.col("_x._w"), F.struct("_x._rank", "_x._pos")), " ").alias("_more"))
    return base.join(more, "key", "left").select("key", F.concat_ws(" ", F.when(F.length("_base") > 0, F.col("_base")), "_more").alias("text"))
