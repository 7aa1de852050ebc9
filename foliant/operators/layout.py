"""Layout of pages: positioned items to lines with their blanks, features of lines, kinds of line, and blocks.

A line's kind follows from rules in a fixed order over what it says, its size against the document's body text, its place
on the page and whether other pages have it there too. Everything is windows and aggregates by document or page;
only the reading order of a page (``blocks.reading_order``) is a function of a page's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.blocks import BLOCK, reading_order
from foliant.operators.pages import ordered

#: Sizes of text, in parts of its own size: a lower line, a blank, a column's gap; a title against body text.
LOWER, BLANK, COLUMN, TITLE = 0.4, 0.15, 2.5, 1.15
#: Lines at each edge of a page that may be its header, footer or number; share of pages that repeat one.
EDGE, REPEATED = 2, 0.5
#: Between lines of a block, in parts of their size.
LEADING = 1.8

# Patterns of kinds in English and Portuguese; plain enough for both Java's and RE2's syntax.
PAGE_NUMBER = r"(?i)^(page|p[aá]gina|p[aá]g\.|p\.)? ?-? ?[0-9]{1,4} ?-?( ?(/|of|de) ?[0-9]{1,4})?$"
CAPTION = r"(?i)^(figure|fig\.|figura|table|tabela|quadro|chart|gr[aá]fico) ?[0-9]+"
EXERCISE = r"(?i)^(exercise|exerc[ií]cio|quest[aã]o|question|problem|problema) ?[0-9]*[.:)]"
DEFINITION = r"(?i)^(definition|defini[cç][aã]o)( [0-9.]+)?[.:]"
BULLET = r"^([-*•–▪◦]|[(]?[0-9]{1,2}[.)]|[(]?[a-z][.)]) "
QUOTE = r"^(>|“|«)"
CODE = r"[{};]$"
CODE_FONT = r"(?i)(courier|mono|consol)"
BOLD_FONT = r"(?i)(bold|black|heavy)"
FORMULA = r"^[^=]{1,40}=[^=]+$"
MARKS = r"[-+*/=^_()0-9∑∫√≤≥<>|]"


def text_lines(items: DataFrame) -> DataFrame:
    """Lines (doc, page_idx, band, line, x0, x1, y, size, font, text, cells) of positioned items; bands from top to bottom, lines from left to right.

    An item lower than the one before it by LOWER of its size starts a band; in a band one farther to the right than COLUMN
    of its size starts a line of its own. Gaps become as many blanks as they are wide, of half a size each, and one at least
    from BLANK of a size on. ``cells`` is the number of lines in the band.
    """
    page = ["doc", "page_idx"]
    usable = items.filter(F.length(F.trim("str")) > 0).withColumn("size", F.greatest("size", F.lit(1.0)))
    down = Window.partitionBy(*page).orderBy(F.desc("y"), "x", "item_idx")
    lower = F.lag("y").over(down) - F.col("y") > LOWER * F.col("size")
    banded = usable.withColumn("_new", F.coalesce(lower, F.lit(False)).cast("int")).withColumn("band", F.sum("_new").over(down))
    along = Window.partitionBy(*page, "band").orderBy("x", "item_idx")
    end = F.max(F.col("x") + F.col("width")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("x") - end) / F.col("size")
    placed = banded.withColumn("_gap", gap).withColumn("line", F.sum((F.coalesce("_gap", F.lit(0.0)) > COLUMN).cast("int")).over(along))
    blanks = F.when(F.row_number().over(Window.partitionBy(*page, "band", "line").orderBy("x", "item_idx")) == 1, "").when(F.col("_gap") < BLANK, "").otherwise(F.repeat(F.lit(" "), F.greatest(F.lit(1), F.round(F.col("_gap") * 2)).cast("int")))
    spaced = placed.withColumn("_s", F.concat(blanks, "str"))
    largest = F.max_by(F.struct("size", "font"), F.length("str"))
    lines = spaced.groupBy(*page, "band", "line").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max("y").alias("y"), largest.alias("_f"), F.array_join(ordered(F.col("_s"), F.struct("x", "item_idx")), "").alias("text"))
    return lines.select(*page, "band", "line", "x0", "x1", "y", "_f.size", "_f.font", "text", F.count("*").over(Window.partitionBy(*page, "band")).alias("cells"))


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc and ``body``, the size (to half a point) of most of its letters, the smaller of equals."""
    size = F.round(F.col("size") * 2) / 2
    seen = lines.groupBy("doc", size.alias("body")).agg(F.sum(F.length("text")).alias("n"))
    return seen.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("n"), "body"))["body"].alias("body"))


def with_features(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """*lines* with body, from_top and from_bottom (bands of the page, from 1), ``repeats`` (this text, whatever its digits, at the edge of
    REPEATED of the pages, two at least) and ``in_table`` (short cells beside each other, in the band above or below too)."""
    page = Window.partitionBy("doc", "page_idx")
    out = lines.withColumn("_bands", F.max("band").over(page)).withColumn("_first", F.min("band").over(page))
    out = out.withColumn("from_top", F.col("band") - F.col("_first") + 1).withColumn("from_bottom", F.col("_bands") - F.col("band") + 1)
    same = F.regexp_replace(F.trim("text"), "[0-9]+", "#")
    edge = out.filter((F.col("from_top") <= EDGE) | (F.col("from_bottom") <= EDGE)).groupBy("doc", same.alias("_same")).agg(F.count_distinct("page_idx").alias("_on"))
    often = edge.join(counts, "doc").filter((F.col("_on") >= REPEATED * F.col("num_pages")) & (F.col("_on") >= 2)).select("doc", "_same", F.lit(True).alias("_often"))
    out = out.withColumn("_same", same).join(often, ["doc", "_same"], "left").withColumn("repeats", F.coalesce("_often", F.lit(False)) & ((F.col("from_top") <= EDGE) | (F.col("from_bottom") <= EDGE)))
    bands = lines.groupBy("doc", "page_idx", "band").agg(F.count("*").alias("_n"), F.max(F.length("text")).alias("_longest"))
    down = Window.partitionBy("doc", "page_idx").orderBy("band")
    cell = (F.col("_n") >= 2) & (F.col("_longest") <= 30)
    beside = F.coalesce(F.lag(cell).over(down) & (F.lag("_n").over(down) == F.col("_n")), F.lit(False)) | F.coalesce(F.lead(cell).over(down) & (F.lead("_n").over(down) == F.col("_n")), F.lit(False))
    tables = bands.withColumn("in_table", cell & beside).select("doc", "page_idx", "band", "in_table")
    return out.join(tables, ["doc", "page_idx", "band"]).join(body_sizes(lines), "doc").drop("_same", "_often", "_bands", "_first")


def kind() -> Column:
    """The kind of a line with features: the first rule that holds."""
    text = F.trim("text")
    n = F.length(text)
    says = lambda p: text.rlike(p)
    at_edge = (F.col("from_top") <= EDGE) | (F.col("from_bottom") <= EDGE)
    short = (n <= 80) & ~says(r"[.;,]$")
    large = F.col("size") >= TITLE * F.col("body")
    strong = F.coalesce(F.col("font").rlike(BOLD_FONT), F.lit(False)) | ((F.upper(text) == text) & says("[A-Z]{3}"))
    marks = n - F.length(F.regexp_replace(text, MARKS, ""))
    rules = [
        ("page_number", at_edge & says(PAGE_NUMBER)),
        ("header", F.col("repeats") & (F.col("from_top") <= F.col("from_bottom"))),
        ("footer", F.col("repeats")),
        ("caption", says(CAPTION)),
        ("table", F.col("in_table")),
        ("exercise", says(EXERCISE)),
        ("definition", says(DEFINITION)),
        ("title", large & short),
        ("list_item", says(BULLET)),
        ("quote", says(QUOTE)),
        ("code", F.coalesce(F.col("font").rlike(CODE_FONT), F.lit(False)) | says(CODE)),
        ("formula", says(FORMULA) & (marks >= 0.3 * n)),
        ("title", strong & short),
    ]
    out = F.lit("paragraph")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def classified(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines with features, ``type`` and ``level`` (of titles: the rank of their size in the document, at most 6)."""
    typed = with_features(lines, counts).withColumn("type", kind())
    sizes = typed.filter("type = 'title'").groupBy("doc", F.round(F.col("size") * 2).alias("_half")).agg(F.lit(1).alias("_one"))
    ranked = sizes.withColumn("level", F.least(F.lit(6), F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("_half"))))).drop("_one")
    return typed.withColumn("_half", F.when(F.col("type") == "title", F.round(F.col("size") * 2))).join(ranked, ["doc", "_half"], "left").drop("_half")


def blocks(lines: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc and the columns of BLOCK, with ``turn``, from classified lines and images (doc, page_idx, x, y, w, h; y upwards, of the lower edge).

    Lines are put in reading order; a line goes on with the block before it if it is of its kind and size and close below
    it. A paragraph's line that stands farther right than the list item above it goes on with that. List items next to each
    other get a list as their parent; an image takes the nearest caption below or above it.
    """
    page = ["doc", "page_idx"]
    boxes = lines.select(*page, "text", "size", "type", "level", F.col("x0").alias("x"), (-F.col("y") - F.col("size")).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), F.col("size").alias("h"))
    if images is not None:
        boxes = boxes.unionByName(images.select(*page, F.lit("").alias("text"), F.lit(0.0).alias("size"), F.lit("image").alias("type"), F.lit(None).cast("int").alias("level"), "x", (-F.col("y") - F.col("h")).alias("y"), "w", "h"))
    on = Window.partitionBy(*page).orderBy("turn")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(on)
    far = F.coalesce((gap > (LEADING - 1) * F.col("size") + 2) | (gap < -F.col("size")), F.lit(True))
    placed = reading_order(boxes).withColumn("_far", far)
    start = placed.withColumn("_g", F.sum(((F.col("type") != "paragraph") | F.col("_far")).cast("int")).over(on))
    lead = Window.partitionBy(*page, "_g").orderBy("turn")
    inside = (F.col("type") == "paragraph") & (F.first("type").over(lead) == "list_item") & (F.col("x") > F.first("x").over(lead) + 1)
    typed = start.withColumn("_on", inside).withColumn("type", F.when(inside, "list_item").otherwise(F.col("type")))
    whole = F.col("type").isin("list_item", "image", "caption", "exercise", "definition", "page_number")
    new = (F.col("type") != F.coalesce(F.lag("type").over(on), F.lit(""))) | F.col("_far") | (F.abs(F.col("size") - F.lag("size").over(on)) > 0.1 * F.col("size")) | (whole & ~F.col("_on"))
    grouped = typed.withColumn("_b", F.sum(new.cast("int")).over(on))
    joiner = lambda t, sep: F.array_join(ordered(F.col(t), F.col("turn")), sep)
    made = grouped.groupBy(*page, "_b").agg(
        F.first("type").alias("type"), F.when(F.first("type").isin("table", "code"), joiner("text", "\n")).otherwise(joiner("text", " ")).alias("text"), F.first("level").alias("level"),
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max(F.col("x") + F.col("w")).alias("_x1"), F.max(F.col("y") + F.col("h")).alias("_y1"), F.min("turn").alias("turn"),
    )
    by = Window.partitionBy(*page).orderBy("turn")
    run = F.sum(((F.col("type") == "list_item") & (F.coalesce(F.lag("type").over(by), F.lit("")) != "list_item")).cast("int")).over(by)
    made = made.withColumn("_list", F.when(F.col("type") == "list_item", run))
    name = lambda letter, c: F.concat(F.lit("p"), F.col("page_idx").cast("string"), F.lit(f"-{letter}"), F.col(c).cast("string"))
    made = made.withColumn("block_id", name("b", "_b")).withColumn("parent_id", F.when(F.col("_list").isNotNull(), name("l", "_list")))
    lists = made.filter("_list IS NOT NULL").groupBy(*page, "parent_id").agg(F.min("_x0").alias("_x0"), F.min("_y0").alias("_y0"), F.max("_x1").alias("_x1"), F.max("_y1").alias("_y1"), F.min("turn").alias("turn"))
    parents = lists.select(*page, F.lit("list").alias("type"), F.lit("").alias("text"), F.lit(None).cast("int").alias("level"), F.array("_x0", "_y0", "_x1", "_y1").alias("bbox"), F.col("parent_id").alias("block_id"), F.lit(None).cast("string").alias("parent_id"), "turn", F.lit(0).alias("_inner"))
    out = made.select(*page, "type", "text", "level", F.array("_x0", "_y0", "_x1", "_y1").alias("bbox"), "block_id", "parent_id", "turn", F.lit(1).alias("_inner")).unionByName(parents)
    captions = out.filter("type = 'caption'").select(*page, F.col("text").alias("image_caption"), F.col("bbox").alias("_c"))
    away = F.least(F.abs(F.col("_c")[1] - F.col("bbox")[3]), F.abs(F.col("bbox")[1] - F.col("_c")[3]))
    nearest = out.filter("type = 'image'").join(captions, page).groupBy(*page, "block_id").agg(F.min_by("image_caption", away).alias("image_caption"))
    full = out.join(nearest, [*page, "block_id"], "left").withColumn("page_idx", F.col("page_idx").cast("int"))
    empty = {"image_path": F.lit(None).cast("string"), "ocr_confidence": F.lit(None).cast("double"), "level": F.col("level").cast("int")}
    return full.withColumns(empty).select("doc", *[f.name for f in BLOCK.fields], (F.col("turn") * 2 + F.col("_inner")).alias("turn"))


def structured_text(items: DataFrame) -> DataFrame:
    """doc, page_idx and text of pages as blocks of lines with their blanks: columns one after another, an empty line between blocks.

    What a page says in content order may run across columns; this doesn't.
    """
    lines = text_lines(items)
    page = ["doc", "page_idx"]
    boxes = lines.select(*page, "text", "size", F.col("x0").alias("x"), (-F.col("y") - F.col("size")).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), F.col("size").alias("h"))
    on = Window.partitionBy(*page).orderBy("turn")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(on)
    apart = F.coalesce((gap > (LEADING - 1) * F.col("size") + 2) | (gap < -F.col("size")), F.lit(False))
    lead = F.when(F.row_number().over(on) == 1, "").when(apart, "\n\n").when(gap < -0.5 * F.col("size"), F.repeat(F.lit(" "), F.lit(4))).otherwise("\n")
    return reading_order(boxes).withColumn("_s", F.concat(lead, "text")).groupBy(*page).agg(F.array_join(ordered(F.col("_s"), F.col("turn")), "").alias("text"))
