"""Affine matrices, boxes and pixel rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.textnorm import half_up

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
STATE = "struct<ctm:array<double>,stack:array<array<double>>,out:array<struct<x:double,y:double,w:double,h:double,width:int,height:int>>>"


def multiply(m: Column, n: Column) -> Column:
    """The matrix that applies *n* first and *m* after; both [a, b, c, d, e, f]."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    g, h, i, j, k, l = (n[i] for i in range(6))  # noqa: E741
    return F.array(a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The image of a point."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def unit_box(m: Column) -> dict[str, Column]:
    """The box around the image of the unit square."""
    xs = [m[4], m[0] + m[4], m[2] + m[4], m[0] + m[2] + m[4]]
    ys = [m[5], m[1] + m[5], m[3] + m[5], m[1] + m[3] + m[5]]
    return {"x": F.least(*xs), "y": F.least(*ys), "w": F.greatest(*xs) - F.least(*xs), "h": F.greatest(*ys) - F.least(*ys)}


def canvas_rectangle(x: Column, y: Column, w: Column, h: Column, page_x: Column, page_top: Column, scale: float = 2.0, margin: int = 4) -> dict[str, Column]:
    """A box in page space (y upwards) as pixels of the page rendered at *scale* (y downwards), with a margin."""
    left = F.greatest(F.lit(0), half_up((x - page_x) * scale) - margin)
    top = F.greatest(F.lit(0), half_up((page_top - y - h) * scale) - margin)
    return {"left": left, "top": top, "width": half_up(w * scale) + 2 * margin, "height": half_up(h * scale) + 2 * margin}


def area_ratio(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Area of image blocks over page area, by page; 0 for pages without area."""
    images = blocks.filter("type = 'image'").groupBy("doc", "page_idx").agg(F.sum(F.col("w") * F.col("h")).alias("_a"))
    area = F.col("width") * F.col("height")
    return pages.join(images, ["doc", "page_idx"], "left").withColumn("area_ratio", F.when(area <= 0, 0.0).otherwise(F.coalesce("_a", F.lit(0.0)) / area)).drop("_a")


def image_boxes(ops: Column) -> Column:
    """Boxes of the images of one page from its operators in order.

    *ops* is an array of (op, m, width, height); op is save, restore, transform, image or inline_image. Restoring
    more than was saved gives the identity; unknown sizes are 0.
    """
    start = F.struct(F.array(*map(F.lit, IDENTITY)).alias("ctm"), F.array().cast("array<array<double>>").alias("stack"), F.array().cast("array<struct<x:double,y:double,w:double,h:double,width:int,height:int>>").alias("out"))

    def step(state: Column, op: Column) -> Column:
        ctm, stack, out = state["ctm"], state["stack"], state["out"]
        kind = op["op"]
        box = unit_box(ctm)
        item = F.struct(*[v.alias(k) for k, v in box.items()], F.coalesce(op["width"], F.lit(0)).alias("width"), F.coalesce(op["height"], F.lit(0)).alias("height"))
        new_ctm = F.when(kind == "transform", multiply(ctm, op["m"])).when(kind == "restore", F.coalesce(F.try_element_at(stack, F.lit(-1)), F.array(*map(F.lit, IDENTITY)))).otherwise(ctm)
        new_stack = F.when(kind == "save", F.concat(stack, F.array(ctm))).when((kind == "restore") & (F.size(stack) > 0), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        new_out = F.when(kind.isin("image", "inline_image"), F.concat(out, F.array(item))).otherwise(out)
        return F.struct(new_ctm.alias("ctm"), new_stack.alias("stack"), new_out.alias("out")).cast(STATE)

    return F.aggregate(ops, start.cast(STATE), step, lambda s: s["out"])
