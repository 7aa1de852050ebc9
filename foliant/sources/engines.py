"""External engines: command-line converters, OCR and page renderers, all pluggable."""

from __future__ import annotations

import os
import subprocess
import tempfile
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources import png


class OcrEngine(Protocol):
    def __call__(self, png: bytes, rectangle: tuple[int, int, int, int] | None = None) -> list[tuple[str, float]]:
        """Words and their confidence."""


class Renderer(Protocol):
    def __call__(self, pdf: bytes, page_idx: int, scale: float) -> bytes:
        """A page as PNG."""


#: Command lines of known converters; {pdf} and {out} are filled in. Fixed values.
COMMANDS = {
    "docling": ["docling", "{pdf}", "--to", "md", "--output", "{out}"],
    "mineru": ["mineru", "-p", "{pdf}", "-o", "{out}", "-b", "pipeline", "-l", "latin", "-d", "cuda"],
}


def convert(files: DataFrame, command: list[str], suffix: str = ".md", timeout: int = 1800) -> DataFrame:
    """doc, text, error and seconds of each binary file (doc, content) by a command that writes a text file.

    Each call has a folder of its own, which goes when it is read. A missing command, a failing one and one that
    writes nothing give an error and no text.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc"], batch["content"], strict=True):
                text, error, began = "", None, time.perf_counter()
                with tempfile.TemporaryDirectory() as folder:
                    pdf, out = os.path.join(folder, "in.pdf"), os.path.join(folder, "out")
                    os.mkdir(out)
                    with open(pdf, "wb") as f:
                        f.write(bytes(content))
                    try:
                        done = subprocess.run([c.format(pdf=pdf, out=out) for c in command], capture_output=True, timeout=timeout, check=False)
                        found = sorted(os.path.join(d, n) for d, _, names in os.walk(out) for n in names if n.endswith(suffix))
                        if done.returncode:
                            error = f"exit {done.returncode}: {done.stderr.decode('utf-8', 'replace')[-500:]}"
                        elif not found:
                            error = "no output file"
                        else:
                            with open(found[0], encoding="utf-8", errors="replace") as f:
                                text = f.read()
                    except (OSError, subprocess.TimeoutExpired) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append((doc, text, error, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["doc", "text", "error", "seconds"])

    return files.select("doc", "content").mapInPandas(run, "doc string, text string, error string, seconds double")


IMAGE_CALL = ["hash", "model", "prep", "scale"]
#: A whole page has no rectangle: -1 throughout.
PAGE_CALL = ["file", "page_idx", "renderer", "left", "top", "width", "height"]
#: Pages of a file that one row takes to an engine.
PAGES_AT_ONCE = 32


def answers(started: dict[str, OcrEngine], engines: dict[str, Callable[[], OcrEngine]], asked, image: Callable[[], tuple[int, int, int, str, bytes]]):
    """model, prep, scale, words, seconds and error of each of what is *asked* of an image (width, height, channels, format, bytes); *started* has the engines by model."""
    for a in asked:
        words, error, began = [], None, time.perf_counter()
        try:
            width, height, channels, form, data = image()
            ocr = started.get(a["model"])
            if ocr is None:
                ocr = started[a["model"]] = engines[a["model"]]()
            began = time.perf_counter()
            if form != "raw":  # an image file of its own, which the engine reads
                words = ocr(bytes(data))
            else:
                rgba = png.to_rgba(data, width, height, channels)
                words = ocr(png.encode(png.scaled(png.binarized(rgba) if a["prep"] else rgba, a["scale"])))
        except Exception as e:  # noqa: BLE001  any failure is the call's error
            error = f"{type(e).__name__}: {e}"
        yield a["model"], a["prep"], a["scale"], [{"text": w, "confidence": float(c)} for w, c in words], time.perf_counter() - began, error


def image_calls(calls: DataFrame, images: DataFrame, engines: dict[str, Callable[[], OcrEngine]]) -> DataFrame:
    """Words, seconds and error of each distinct call (hash, model, prep, scale) on *images* (hash, width, height, channels, bytes, maybe format).

    Pixels are binarized and scaled and go to the engine as PNG; JPEG files go to it as they are. An engine starts with
    its first image. An image goes to a task once, with all that is asked of it.
    """
    format_ = F.col("format") if "format" in images.columns else F.lit("raw")
    asked = calls.select(*IMAGE_CALL).distinct().groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("model", "prep", "scale"))).alias("asked"))
    place = [c for c in ("doc", "page_idx", "img_idx") if c in images.columns]
    known = images.filter("bytes IS NOT NULL").select(*place, "hash", "width", "height", "channels", format_.alias("format"), "bytes")

    def run(batches):
        import pandas as pd

        started = {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                rows += [(r.hash, *a) for a in answers(started, engines, r.asked, lambda r=r: (r.width, r.height, r.channels, r.format, r.bytes))]
            yield pd.DataFrame(rows, columns=[*IMAGE_CALL, "words", "seconds", "error"])

    if len(place) == 3:  # one of an image's places is chosen before its bytes are looked at
        first = known.groupBy("hash").agg(F.min(F.struct(*place)).alias("at")).join(asked, "hash").select(*[F.col(f"at.{c}") for c in place], "asked")
        once = known.join(first, place)
    else:
        once = known.join(asked, "hash").dropDuplicates(["hash"])
    return once.select("hash", "width", "height", "channels", "format", "bytes", "asked").mapInPandas(run, "hash string, model string, prep boolean, scale double, words array<struct<text:string,confidence:double>>, seconds double, error string")


def page_calls(calls: DataFrame, files: DataFrame, render: Callable[[], Renderer], engine: Callable[[], OcrEngine], scale: float = 2.0) -> DataFrame:
    """Text, seconds and error of each distinct call (PAGE_CALL) on the files (file, content): whole pages, or rectangles in pixels of the rendered page.

    A page is rendered once for all that is asked of it; ``render_seconds`` are told with each of its calls.
    """
    rectangle = F.struct("left", "top", "width", "height")
    pages = calls.select(*PAGE_CALL).distinct().groupBy("file", "renderer", "page_idx").agg(F.array_sort(F.collect_list(rectangle)).alias("parts"))
    chunks = pages.groupBy("file", F.floor(F.col("page_idx") / PAGES_AT_ONCE).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("page_idx", "renderer", "parts"))).alias("pages"))

    def run(batches):
        import pandas as pd

        draw = ocr = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = []
                for p in r.pages:
                    image, failed, began = b"", None, time.perf_counter()
                    try:
                        draw, ocr = draw or render(), ocr or engine()
                        began = time.perf_counter()
                        image = draw(bytes(r.content), int(p["page_idx"]), scale)
                    except Exception as e:  # noqa: BLE001
                        failed = f"{type(e).__name__}: {e}"
                    rendered = time.perf_counter() - began
                    for part in p["parts"]:
                        text, error, began = "", failed, time.perf_counter()
                        if not failed:
                            box = tuple(int(part[k]) for k in ("left", "top", "width", "height"))
                            try:
                                text = " ".join(w for w, _ in ocr(image, box if box[0] >= 0 else None))
                            except Exception as e:  # noqa: BLE001
                                error = f"{type(e).__name__}: {e}"
                        rows.append((r.file, int(p["page_idx"]), p["renderer"], *(int(part[k]) for k in ("left", "top", "width", "height")), text, rendered, time.perf_counter() - began, error))
                yield pd.DataFrame(rows, columns=[*PAGE_CALL, "text", "render_seconds", "seconds", "error"])

    schema = "file string, page_idx long, renderer string, left int, top int, width int, height int, text string, render_seconds double, seconds double, error string"
    return chunks.join(files.select("file", "content"), "file").mapInPandas(run, schema)


def recognize(images: DataFrame, engine: Callable[[], OcrEngine], scales: tuple[float, ...] = (1.0,), binarize: bool = False, model: str = "standard") -> DataFrame:
    """OCR words of distinct images at each scale; an image that fails has no words."""
    calls = images.select("hash", F.lit(model).alias("model"), F.lit(binarize).alias("prep"), F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    done = image_calls(calls, images, {model: engine})
    return done.select(*IMAGE_CALL, F.posexplode("words").alias("word_idx", "w")).select(*IMAGE_CALL, "word_idx", "w.text", "w.confidence")


def whole_pages(pages: DataFrame, renderer: str) -> DataFrame:
    """Calls for whole pages (file, page_idx)."""
    return pages.select("file", F.col("page_idx").cast("long").alias("page_idx"), F.lit(renderer).alias("renderer"), *[F.lit(-1).alias(c) for c in ("left", "top", "width", "height")])


def recognize_pages(files: DataFrame, wanted: DataFrame, render: Callable[[], Renderer], engine: Callable[[], OcrEngine], scale: float = 2.0, renderer: str = "mupdf") -> DataFrame:
    """OCR text of pages (doc, page_idx), and of rectangles where *wanted* has left, top, width and height; a failing one is left out."""
    named = wanted.withColumnRenamed("doc", "file")
    boxed = {"left", "top", "width", "height"} <= set(wanted.columns)
    calls = named.withColumn("renderer", F.lit(renderer)) if boxed else whole_pages(named, renderer)
    done = page_calls(calls, files.withColumnRenamed("doc", "file"), render, engine, scale).filter("error IS NULL")
    return done.select("renderer", F.col("file").alias("doc"), "page_idx", "text")
