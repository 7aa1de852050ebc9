"""Pages of documents: assembly, gates, profiles. Pages are (doc, page_idx, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.textnorm import half_up, places

POOR = 100
PAGE_BREAK = "\n\n"
#: What a back-end prints between pages, with the page number (fixed value).
BREAK_LINE = r"-{16}Page \(\d+\) Break-{16}"


def ordered(value: Column, by: Column) -> Column:
    """Values of a group in the order of *by*, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), value.alias("v")))), lambda x: x["v"])


def join_pages(pages: DataFrame, doc: str = "doc", page: str = "page_idx", text: str = "text") -> DataFrame:
    """One text per document, its pages in order with an empty line between them."""
    return pages.groupBy(doc).agg(F.array_join(ordered(F.coalesce(text, F.lit("")), F.col(page)), PAGE_BREAK).alias("text"), F.count("*").alias("num_pages"))


def pad_pages(pages: DataFrame, counts: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages 0 to num_pages-1 of each document of *counts*, empty where *pages* has none."""
    all_ = counts.filter("num_pages > 0").select(doc, F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_pages").cast("long") - 1)).alias("page_idx"))
    return all_.join(pages.select(doc, F.col("page_idx").cast("long"), "text"), [doc, "page_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def split_form_feeds(text: Column) -> Column:
    """Pseudo-pages of a whole-document text: at form feeds and empty lines."""
    return F.split(text, r"\f|\n{2,}")


def split_break_lines(text: Column) -> Column:
    """Pages between break lines; empty ones go."""
    return F.filter(F.split(text, BREAK_LINE), lambda p: F.length(F.trim(p)) > 0)


def poor(text: Column, most: int = POOR) -> Column:
    """The gate for pages with too little text."""
    return F.length(text) < most


def dense_area(text: Column, area_ratio: Column, area: float = 0.3, letters: int = 500) -> Column:
    """The gate for pages that images fill and that hold little text."""
    return (area_ratio >= area) & (F.length(text) < letters)


def profile(pages: DataFrame, blocks: DataFrame | None = None, gold: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """A profile per document: characters by page, few-text pages (from 1), size, images, comparison with gold.

    *pages* may have width and height; *blocks* are (doc, page_idx, type); *gold* is (doc, text).
    """
    n = F.length(F.coalesce("text", F.lit("")))
    aggregates = [
        F.count("*").alias("num_pages"), F.sum(n + 2).alias("chars"), half_up(F.sum(n) / F.count("*")).cast("long").alias("chars_mean"), F.min(n).cast("long").alias("chars_min"), F.max(n).cast("long").alias("chars_max"),
        F.array_sort(F.collect_list(F.when(n < POOR, F.col("page_idx").cast("long") + 1))).alias("few_text_pages"),
    ]
    if "width" in pages.columns:
        aggregates += [half_up(F.avg("width")).alias("mean_width"), half_up(F.avg("height")).alias("mean_height")]
    out = pages.groupBy(doc).agg(*aggregates)
    if blocks is not None:
        images = blocks.filter("type = 'image'").groupBy(doc).agg(F.count("*").alias("images"))
        out = out.join(images, doc, "left").withColumn("images", F.coalesce("images", F.lit(0)))
    if gold is not None:
        known = gold.select(doc, F.length("text").cast("long").alias("gold_chars"))
        ratio = F.when(F.col("gold_chars") == 0, 0.0).otherwise(F.col("chars") / F.col("gold_chars"))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - ratio))
        with_gold = F.struct(F.col("gold_chars"), places(ratio, 4).alias("ratio"), places(share, 4).alias("image_share"))
        out = out.join(known, doc, "left").withColumn("with_gold", F.when(F.col("gold_chars").isNotNull(), with_gold)).drop("gold_chars")
    return out


def lines_of_items(items: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Page text from positioned items (doc, page_idx, item_idx, str, x, y): lines from top to bottom, items from left to right.

    A line ends where the next item, from the top, is more than *tolerance* lower than the one before it.
    """
    page = ["doc", "page_idx"]
    down = Window.partitionBy(*page).orderBy(F.desc("y"), "x", "item_idx")
    step = F.when(F.lag("y").over(down) - F.col("y") > tolerance, 1).otherwise(0)
    lined = items.withColumn("_new", step).withColumn("_line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    line = lined.groupBy(*page, "_line").agg(F.array_join(ordered(F.col("str"), F.struct("x", "item_idx")), " ").alias("_t"))
    return line.groupBy(*page).agg(F.array_join(ordered(F.col("_t"), F.col("_line")), "\n").alias("text"), F.count("*").alias("num_lines"))
