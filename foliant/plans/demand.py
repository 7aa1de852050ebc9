"""OCR on demand: the calls that the chosen pipelines' gates ask for, made once each and kept by what they read.

A call is named by the digest of what it reads (an image's bytes, or a file's and a page's number and rectangle) and by how.
Calls that the store has are not made again, in later runs too; failed ones are. Each result carries the seconds it
took, which count for every pipeline that uses it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import extractors, geometry, images
from foliant.sources import engines, pdf, results

IMAGES = "hash string, model string, prep boolean, scale double, words array<struct<text:string,confidence:double>>, seconds double, error string"
PAGES = "file string, page_idx long, renderer string, left int, top int, width int, height int, text string, render_seconds double, seconds double, error string"
RENDER_SCALE = 2.0


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def wanted_images(i: extractors.Inputs, names: list[str]) -> DataFrame | None:
    """extractor, doc and call of every image that a pipeline reads; None if none of *names* reads images."""
    parts = []
    if "hibrido-unpdf-img" in names:
        parts.append(_image_calls(extractors.front(i.placements, i.counts), "hibrido-unpdf-img", extractors.HybridOptions()))
    hybrids = [n for n in names if n in extractors.HYBRIDS]
    if hybrids:
        found = images.targets(i.placements, images.background_by_hash(i.placements, i.counts))
        parts += [_image_calls(found, n, extractors.HYBRIDS[n][0]) for n in hybrids]
    return _union(parts)


def _image_calls(rows: DataFrame, name: str, o: extractors.HybridOptions) -> DataFrame:
    scales = F.explode(F.array(*map(F.lit, o.scales))).alias("scale")
    return rows.select(F.lit(name).alias("extractor"), "doc", "hash", F.lit("best" if o.best_model else "standard").alias("model"), F.lit(o.binarize).alias("prep"), scales).distinct()


def wanted_pages(i: extractors.Inputs, names: list[str], files: DataFrame) -> DataFrame | None:
    """extractor, doc, file and call of every page that a gate lets through; *files* are (doc, file)."""
    parts = []
    for n in names:
        if n in extractors.PAGE_GATES:
            renderer, gate = extractors.PAGE_GATES[n]
            parts.append(engines.whole_pages(gate(i).join(files, "doc"), renderer).join(files, "file").withColumn("extractor", F.lit(n)))
    return _union(parts)


def wanted_boxes(boxes: DataFrame, i: extractors.Inputs, files: DataFrame) -> DataFrame:
    """extractor, doc, img_idx, file and call of the rectangle of every large image in front of the background.

    boxes: doc, page_idx, img_idx, width and height of the image, and its place b on the page; pixels of the page as rendered.
    """
    lead = extractors.front(boxes, i.counts).join(i.sizes.select("doc", "page_idx", F.col("height").alias("page_top")), ["doc", "page_idx"])
    pixels = geometry.canvas_rectangle(F.col("b.x"), F.col("b.y"), F.col("b.w"), F.col("b.h"), F.lit(0.0), F.col("page_top"), RENDER_SCALE)
    return lead.join(files, "doc").select(F.lit("hibrido-unpdf-bbox").alias("extractor"), "doc", "img_idx", "file", F.col("page_idx").cast("long").alias("page_idx"), F.lit("unpdf").alias("renderer"), *[c.cast("int").alias(n) for n, c in pixels.items()])


def _unpacked(document: pdf.Document, page_idx: int, img_idx: int) -> tuple[int, int, int, str, bytes]:
    """Width, height, channels, format and bytes of an image on a page."""
    image = document.pages[page_idx].images[img_idx]
    return image["width"], image["height"], image["channels"], *pdf.image_bytes(image["stream"])


def calls_on_files(calls: DataFrame, placements: DataFrame, files: DataFrame, by_model: dict) -> DataFrame:
    """IMAGES rows of each distinct call, made on the first of an image's places: the page is read again from its file and the image unpacked where OCR is, so that no pixels are kept or moved.

    Images go to a task with their file, those of engines.PAGES_AT_ONCE pages at a time.
    """
    asked = calls.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("model", "prep", "scale"))).alias("asked"))
    first = placements.groupBy("hash").agg(F.min(F.struct("doc", "page_idx", "img_idx")).alias("at")).join(asked, "hash")
    image = F.struct("at.page_idx", "at.img_idx", "hash", "asked")
    chunks = first.groupBy(F.col("at.doc").alias("doc"), F.floor(F.col("at.page_idx") / engines.PAGES_AT_ONCE).alias("chunk")).agg(F.array_sort(F.collect_list(image)).alias("found"))

    def run(batches):
        import pandas as pd

        started = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                pages = {x["page_idx"] for x in r.found}
                document = cache(lambda r=r, pages=pages: pdf.Document(bytes(r.content), lambda i, n: i in pages))
                for x in r.found:
                    unpacked = cache(lambda x=x, document=document: _unpacked(document(), x["page_idx"], x["img_idx"]))
                    rows = [(x["hash"], *a) for a in engines.answers(started, by_model, x["asked"], unpacked)]
                    yield pd.DataFrame(rows, columns=[*engines.IMAGE_CALL, "words", "seconds", "error"])

    return chunks.join(files.select("doc", "content"), "doc").select("found", "content").mapInPandas(run, IMAGES)


@dataclass(frozen=True)
class Store:
    """Results of calls in a folder, as two tables that only grow."""

    spark: SparkSession
    folder: str

    def known(self, kind: str, schema: str, key: list[str]) -> DataFrame:
        """One result for each call that went well."""
        path = f"{self.folder}/{kind}"
        if not results.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).filter("error IS NULL").dropDuplicates(key)

    def images(self) -> DataFrame:
        return self.known("images", IMAGES, engines.IMAGE_CALL)

    def pages(self) -> DataFrame:
        return self.known("pages", PAGES, engines.PAGE_CALL)

    def make_images(self, wanted: DataFrame, placements: DataFrame, files: DataFrame, by_model: dict) -> None:
        """Makes the calls of *wanted* that are not there on the images of the files (doc, content)."""
        todo = wanted.select(*engines.IMAGE_CALL).distinct().join(self.images(), engines.IMAGE_CALL, "left_anti")
        calls_on_files(todo, placements, files, by_model).write.mode("append").parquet(f"{self.folder}/images")

    def make_pages(self, wanted: DataFrame, files: DataFrame, render, engine) -> None:
        """Makes the calls of *wanted* that are not there on the files (file, content)."""
        todo = wanted.select(*engines.PAGE_CALL).distinct().join(self.pages(), engines.PAGE_CALL, "left_anti")
        engines.page_calls(todo, files, render, engine, RENDER_SCALE).write.mode("append").parquet(f"{self.folder}/pages")


def seconds_used(wanted_i: DataFrame | None, wanted_p: DataFrame | None, store: Store) -> DataFrame | None:
    """extractor, doc and the seconds of all calls that each pipeline uses for each document, a page's rendering once."""
    parts = []
    if wanted_i is not None:
        parts.append(wanted_i.join(store.images(), engines.IMAGE_CALL).select("extractor", "doc", "seconds"))
    if wanted_p is not None:
        used = wanted_p.join(store.pages(), engines.PAGE_CALL).groupBy("extractor", "doc", "renderer", "page_idx").agg((F.sum("seconds") + F.max("render_seconds")).alias("seconds"))
        parts.append(used.select("extractor", "doc", "seconds"))
    all_ = _union(parts)
    return None if all_ is None else all_.groupBy("extractor", "doc").agg(F.sum("seconds").alias("seconds"))
