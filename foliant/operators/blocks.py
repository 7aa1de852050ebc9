"""Text blocks of pages: validation, repeated headers and footers, reading order, rendering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.operators.pages import ordered

# The kinds of block.
KINDS = ["title", "paragraph", "list", "list_item", "table", "image", "caption", "exercise", "definition", "formula", "header", "footer", "page_number", "code", "quote"]
BLOCK = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("page_idx", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("block_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("image_path", T.StringType()), T.StructField("image_caption", T.StringType()), T.StructField("ocr_confidence", T.DoubleType()),
])
GOLD_V2 = T.StructType([
    T.StructField("pdf_name", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("model", T.StringType()), T.StructField("tokens_input", T.LongType()),
    T.StructField("tokens_output", T.LongType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("elapsed_seconds", T.DoubleType()),
])
EXTRACTION = T.StructType([
    T.StructField("extrator", T.StringType()), T.StructField("texto", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("markdown", T.StringType()), T.StructField("num_paginas", T.IntegerType()),
    T.StructField("num_caracteres", T.IntegerType()), T.StructField("tempo_segundos", T.DoubleType()), T.StructField("erro", T.StringType()),
])


def violations(kinds: list[str] | None = None, keys: Column | None = None) -> Column:
    """Names of the rules that a block row breaks, in a fixed order; *keys* are its JSON's keys, if it came as JSON."""
    level, seen = F.col("level"), F.col("ocr_confidence")
    rules = {
        "type": F.col("type").isNull() | ~F.col("type").isin(kinds or KINDS),
        "text": F.col("text").isNull(),
        "page_idx": F.col("page_idx").isNull() | (F.col("page_idx") < 0),
        "level": level.isNotNull() & ~level.between(1, 6),
        "bbox": F.col("bbox").isNotNull() & (F.size("bbox") != 4),
        "ocr_confidence": seen.isNotNull() & ~seen.between(0, 100),
    }
    if keys is not None:
        rules["extra"] = F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in BLOCK.fields]))) > 0
    broken = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return F.filter(broken, lambda x: x.isNotNull())


def repeated_lines(lines: DataFrame, counts: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines (doc, page_idx, line) on at least *share* of their document's pages: headers and footers."""
    seen = lines.groupBy("doc", "line").agg(F.countDistinct("page_idx").alias("pages"))
    return seen.join(counts, "doc").filter(F.col("pages") >= share * F.col("num_pages")).select("doc", "line", "pages")


def edge_lines(pages: DataFrame, edge: int = 1) -> DataFrame:
    """The first and last non-empty lines of each page."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.withColumn("_l", lines)
    both = F.array_distinct(F.concat(F.slice("_l", 1, edge), F.slice(F.reverse("_l"), 1, edge)))
    return rows.select("doc", "page_idx", F.explode(both).alias("line"))


def _strips(part, low, high):
    """The widest empty strip of each part along an axis (the first of equals, 0 where there is none) and its middle; *part* numbers them from 0."""
    order = np.lexsort((low, part))
    low, part, known = low[order], part[order], np.unique(high)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    reach = known[np.maximum.accumulate(part * len(known) + np.searchsorted(known, high[order])) - part * len(known)]
    with np.errstate(invalid="ignore"):
        wide = np.append(0.0, low[1:] - reach[:-1])
        wide[starts] = 0.0
        wide = np.where(wide > 0, wide, 0.0)
        best = np.maximum.reduceat(wide, starts)
        first = np.minimum.reduceat(np.where(wide == best[part], np.arange(len(wide)), len(wide)), starts)
        return best, np.where(best > 0, (low[first] + reach[first - 1]) / 2, np.nan)


def _turns(sizes, x, y, w, h, gap):
    """Places by recursive XY cuts of the blocks of several pages, which follow each other with *sizes* blocks each; all pages are cut level by level."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, many = first.copy(), np.repeat(sizes, sizes)  # of each block: where its part starts in the order, and how many that has
    right, below = (np.where(np.isnan(v), -np.inf, v) for v in (x + w, y + h))
    live = np.flatnonzero(many > 1)
    while len(live):
        part = np.unique(place[live], return_inverse=True)[1]
        (wide, x_at), (tall, y_at) = _strips(part, x[live], right[live]), _strips(part, y[live], below[live])
        across = wide >= tall
        behind = ~(np.where(across[part], x[live], y[live]) < np.where(across, x_at, y_at)[part])
        before = np.bincount(part, ~behind, len(wide)).astype(np.int64)
        cut = ((np.maximum(wide, tall) >= gap) & (before > 0) & (before < np.bincount(part)))[part]
        done = live[~cut]
        done = done[np.lexsort((done, x[done], y[done], place[done]))]
        if len(done):
            starts = np.flatnonzero(np.diff(place[done], prepend=-1))
            place[done] += np.arange(len(done)) - np.repeat(starts, np.diff(starts, append=len(done)))
        live, behind, before = live[cut], behind[cut], before[part[cut]]
        place[live] += np.where(behind, before, 0)
        many[live] = np.where(behind, many[live] - before, before)
        live = live[many[live] > 1]
    return place - first


def reading_order(blocks: DataFrame, gap: float = 20.0) -> DataFrame:
    """Blocks (doc, page_idx, x, y, w, h, ...) with ``turn``, their place by recursive XY cuts of the page.

    A page is cut at its widest empty strip, columns before rows of equal strips, strips of less than *gap* don't
    count; parts without one go from top to bottom, then from left to right. A page's blocks come to one task, whose pages
    are cut many at a time.
    """
    schema = T.StructType([*blocks.schema.fields, T.StructField("turn", T.IntegerType())])

    def run(batches):
        waiting, have, need = [], 0, 1
        for batch in batches:
            waiting.append(batch)
            have += batch.num_rows
            if have < need:  # the first page isn't whole yet
                continue
            rows = pa.Table.from_batches(waiting)
            sizes, of, at = rows["_rows"].to_numpy(), [], 0
            while at < have and at + sizes[at] <= have:
                of.append(sizes[at])
                at += sizes[at]
            if of:
                whole = rows.slice(0, at).drop_columns("_rows").combine_chunks()
                turn = _turns(np.array(of, np.int64), *(whole[c].cast(pa.float64()).to_numpy() for c in ("x", "y", "w", "h")), gap)
                yield from whole.append_column("turn", pa.array(turn.astype(np.int32))).to_batches()
            need = sizes[at] if at < have else 1
            waiting, have = rows.slice(at).to_batches(), have - at

    page = Window.partitionBy("doc", "page_idx")
    return blocks.withColumn("_rows", F.count("*").over(page)).sortWithinPartitions("doc", "page_idx").mapInArrow(run, schema)


def rendered(blocks: DataFrame, order: str = "turn") -> DataFrame:
    """Markdown and plain text of each document from its blocks, headers and footers left out."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    markdown = (
        F.when(kind == "title", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.lit("- "), text))
        .when(kind == "quote", F.concat(F.lit("> "), text))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "image", F.concat(F.lit("!["), F.coalesce("image_caption", F.lit("")), F.lit("]("), F.coalesce("image_path", F.lit("")), F.lit(")")))
        .otherwise(text)
    )
    key = F.struct("page_idx", order)
    shown = blocks.filter(~kind.isin("header", "footer", "page_number") & ~((kind == "list") & (text == "")))  # a list without text of its own holds items
    return shown.groupBy("doc").agg(F.array_join(ordered(markdown, key), "\n\n").alias("markdown"), F.array_join(ordered(text, key), "\n").alias("text"))
