"""A whole run from files: PDFs and gold texts to the table of results and its averages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.metrics import with_metrics
from foliant.functions.textnorm import places
from foliant.operators import extractors, geometry
from foliant.operators.layout import structured_text
from foliant.operators.pages import lines_of_items, profile, split_break_lines, split_form_feeds
from foliant.operators.scoreboard import METRICS, RESULT, averages, contains, merge_run, preserved, summary_line, with_gold
from foliant.plans import demand
from foliant.sources import engines, pdf, results
from foliant.sources.workspace import new_folder

#: Pipelines that read a file's own text only.
TEXT_ONLY = ("pdf-parse", "pdfjs-dist", "unpdf", "pdf2json", "mupdf")
NO_OCR, NO_BEST, NO_RENDERER, NO_CONVERTER = "no OCR engine", "no better OCR engine", "no page renderer", "no converter"


@dataclass(frozen=True)
class Tools:
    """What is plugged in: an OCR engine, the better OCR model, a page renderer, command lines of converters, and the folder
    that keeps what OCR has read (None: for this run only)."""

    ocr: Callable[[], engines.OcrEngine] | None = None
    best_ocr: Callable[[], engines.OcrEngine] | None = None
    render: Callable[[], engines.Renderer] | None = None
    commands: dict[str, list[str]] = field(default_factory=lambda: dict(engines.COMMANDS))
    store: str | None = None

    def missing(self, name: str) -> str | None:
        """Which tool the pipeline *name* lacks."""
        best = name in extractors.HYBRIDS and extractors.HYBRIDS[name][0].best_model
        pages = name in extractors.PAGE_GATES or name == "hibrido-unpdf-bbox"
        if name in TEXT_ONLY or name in self.commands:
            return None
        if name in engines.COMMANDS:
            return NO_CONVERTER
        if best:
            return None if self.best_ocr else NO_BEST
        if not self.ocr:
            return NO_OCR
        return NO_RENDERER if pages and not self.render else None


def own_text(parsed: DataFrame) -> DataFrame:
    """backend, doc, page_idx, text: the file's own text as each text back-end gives its pages.

    One gives form feeds and empty lines between pseudo-pages, one break lines, one lines put together from positioned
    items, one the pages as they are, one blocks of lines with their blanks.
    """
    fine = parsed.filter("page_idx IS NOT NULL").select("doc", F.col("page_idx").cast("long").alias("page_idx"), F.coalesce("text", F.lit("")).alias("text"))
    whole = fine.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_idx", "text"))).alias("p"))
    fed = F.array_join(F.transform("p", lambda p: p["text"]), "\f")
    broken = F.array_join(F.transform("p", lambda p: F.concat(p["text"], F.lit("\n----------------Page ("), p["page_idx"].cast("string"), F.lit(") Break----------------\n"))), "")
    parts = [whole.select(F.lit(name).alias("backend"), "doc", F.posexplode(cut).alias("page_idx", "text")) for name, cut in (("pdf-parse", split_form_feeds(fed)), ("pdf2json", split_break_lines(broken)))]
    items = lines_of_items(pdf.items_of(parsed)).select("doc", "page_idx", F.col("text").alias("lined"))
    parts.append(fine.join(items, ["doc", "page_idx"], "left").select(F.lit("pdfjs-dist").alias("backend"), "doc", "page_idx", F.coalesce("lined", F.lit("")).alias("text")))
    parts.append(fine.select(F.lit("unpdf").alias("backend"), "doc", "page_idx", "text"))
    blocks = structured_text(pdf.items_of(parsed)).select("doc", "page_idx", F.col("text").alias("blocks"))
    parts.append(fine.join(blocks, ["doc", "page_idx"], "left").select(F.lit("mupdf").alias("backend"), "doc", "page_idx", F.coalesce("blocks", F.lit("")).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _for_each(spark: SparkSession, names: list[str], docs: DataFrame) -> DataFrame:
    """*docs* once for each of *names*, which are few and fixed."""
    return docs.withColumn("extractor", F.explode(F.array(*map(F.lit, names)))) if names else docs.limit(0).withColumn("extractor", F.lit(""))


def prepare(spark: SparkSession, files: DataFrame, names: list[str], tools: Tools) -> tuple[extractors.Inputs, DataFrame]:
    """The tables that the pipelines *names* read, and the seconds of each (extractor, doc).

    Files are parsed once, into a written table that all else reads; pixels are in none, an image that OCR reads is unpacked again
    from the file that has it first. OCR is asked for what the pipelines' gates let through,
    once for each call (``demand``). A pipeline whose tool is missing fails for every document. Seconds are those of
    reading the file, or of the converter, and of all OCR calls that the pipeline uses for the document.
    """
    folder = new_folder(spark)
    pdf.parsed(files.withColumn("images", F.lit("hash"))).write.parquet(f"{folder}/parsed")
    parsed = spark.read.parquet(f"{folder}/parsed")
    read = parsed.groupBy("doc").agg(F.max("seconds").alias("seconds"), F.max("error").alias("error"), F.max("file").alias("file"))
    counts, vector = pdf.counts_of(parsed), own_text(parsed)
    fine, bad = read.filter("error IS NULL"), read.filter("error IS NOT NULL")
    lacking = {n: m for n in names if (m := tools.missing(n))}
    seconds = _for_each(spark, [n for n in names if n not in tools.commands], read.select("doc", "seconds"))
    failures = _for_each(spark, names, bad.select("doc", "error")).select("extractor", "doc", "error")
    for name, message in lacking.items():
        failures = failures.unionByName(fine.select(F.lit(name).alias("extractor"), "doc", F.lit(message).alias("error")))
    for name, command in tools.commands.items():
        if name in names:
            engines.convert(files, command).write.parquet(f"{folder}/{name}")
            done = spark.read.parquet(f"{folder}/{name}")
            vector = vector.unionByName(done.filter("error IS NULL").select(F.lit(name).alias("backend"), "doc", F.lit(0).cast("long").alias("page_idx"), "text"))
            failures = failures.unionByName(done.filter("error IS NOT NULL").select(F.lit(name).alias("extractor"), "doc", "error"))
            seconds = seconds.unionByName(done.select("doc", "seconds", F.lit(name).alias("extractor")))
    vector.write.partitionBy("backend").parquet(f"{folder}/vector")  # pipelines and their gates read it many times
    vector = spark.read.schema(vector.schema).parquet(f"{folder}/vector")
    sizes = parsed.filter("page_idx IS NOT NULL").select("doc", "page_idx", "width", "height")
    able = [n for n in names if n not in lacking]
    inputs = extractors.Inputs(counts=counts, vector=vector, sizes=sizes, failures=failures.groupBy("extractor", "doc").agg(F.min("error").alias("error")))
    if any(n not in TEXT_ONLY and n not in tools.commands for n in able):
        inputs, used = with_ocr(spark, files, parsed, inputs, able, tools, demand.Store(spark, tools.store or folder))
        if used is not None:
            seconds = seconds.join(used.withColumnRenamed("seconds", "_more"), ["extractor", "doc"], "left").select("extractor", "doc", (F.col("seconds") + F.coalesce("_more", F.lit(0.0))).alias("seconds"))
    return inputs, seconds.select("extractor", "doc", "seconds")


def with_ocr(spark: SparkSession, files: DataFrame, parsed: DataFrame, inputs: extractors.Inputs, names: list[str], tools: Tools, store: demand.Store) -> tuple[extractors.Inputs, DataFrame | None]:
    """*inputs* with what OCR reads for the pipelines *names*, and the seconds of the calls that each uses."""
    found = pdf.images_of(parsed).filter("error IS NULL")
    ops = parsed.filter(F.size("ops") > 0).select("doc", "page_idx", F.array_sort("ops").alias("ops"))
    op = F.transform("ops", lambda x: F.struct(x["op"].alias("op"), x["m"].alias("m"), x["width"].alias("width"), x["height"].alias("height")))
    boxes = ops.select("doc", "page_idx", F.posexplode(geometry.image_boxes(op)).alias("img_idx", "b")).withColumns({"width": F.col("b.width"), "height": F.col("b.height")})
    blocks = boxes.select("doc", "page_idx", F.lit("image").alias("type"), F.col("b.w").alias("w"), F.col("b.h").alias("h"))
    placements = found.select("doc", "page_idx", "img_idx", "width", "height", "hash")
    inputs = replace(inputs, placements=placements, blocks=blocks)
    named = parsed.select("doc", "file").distinct()
    of_images, of_pages = demand.wanted_images(inputs, names), demand.wanted_pages(inputs, names, named)
    of_boxes = demand.wanted_boxes(boxes, inputs, named) if "hibrido-unpdf-bbox" in names else None
    call = ["extractor", "doc", *engines.PAGE_CALL]
    parts = [p.select(*call) for p in (of_pages, of_boxes) if p is not None]
    every_page = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None
    if of_images is not None:
        store.make_images(of_images, placements, files, {"standard": tools.ocr, "best": tools.best_ocr})
        words = store.images().join(of_images.select(*engines.IMAGE_CALL).distinct(), engines.IMAGE_CALL, "left_semi")
        inputs = replace(inputs, words=words.select(*engines.IMAGE_CALL, F.posexplode("words").alias("word_idx", "w")).select(*engines.IMAGE_CALL, "word_idx", "w.text", "w.confidence"))
    if every_page is not None:
        first = named.groupBy("file").agg(F.min("doc").alias("doc"))  # files of equal bytes are read once
        store.make_pages(every_page, first.join(files.select("doc", "content"), "doc"), tools.render, tools.ocr)
        if of_pages is not None:
            texts = of_pages.drop("extractor").distinct().join(store.pages(), engines.PAGE_CALL)
            inputs = replace(inputs, page_text=texts.select("renderer", "doc", "page_idx", "text"))
        if of_boxes is not None:
            texts = of_boxes.join(store.pages(), engines.PAGE_CALL).select("doc", "page_idx", "img_idx", "text")
            inputs = replace(inputs, box_text=boxes.select("doc", F.col("page_idx").cast("long").alias("page_idx"), "img_idx", "width", "height").join(texts, ["doc", "page_idx", "img_idx"], "left").withColumn("text", F.coalesce("text", F.lit(""))))
    return inputs, demand.seconds_used(of_images, every_page, store)


def runs(spark: SparkSession, files: DataFrame, names: list[str], tools: Tools = Tools()) -> DataFrame:  # noqa: B008
    """extractor, doc, text, num_pages, num_chars, error and seconds of each pipeline on each file, failed ones too."""
    inputs, seconds = prepare(spark, files, names, tools)
    able = [n for n in names if not tools.missing(n)]
    texts = extractors.extract(replace(inputs, failures=None), able) if able else None
    every = seconds.join(inputs.failures, ["extractor", "doc"], "left")
    if texts is None:
        empty = every.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("num_pages"))
    else:
        empty = every.join(texts.select("extractor", "doc", "text", "num_pages"), ["extractor", "doc"], "left")
    failed = F.col("error").isNotNull()
    text = F.when(failed, "").otherwise(F.coalesce("text", F.lit("")))
    return empty.select("extractor", "doc", text.alias("text"), F.when(failed, 0).otherwise(F.coalesce("num_pages", F.lit(0))).cast("int").alias("num_pages"), F.length(text).alias("num_chars"), "error", "seconds")


def profiles(files: DataFrame, gold: DataFrame | None) -> DataFrame:
    """The published profile of each readable PDF (doc, length, mb, content): pages, letters, images, and how much the gold text has."""
    parsed = pdf.parsed(files.withColumn("images", F.lit("size"))).persist()
    text = structured_text(pdf.items_of(parsed)).select("doc", "page_idx", "text")
    pages = parsed.filter("page_idx IS NOT NULL").select("doc", "page_idx", "width", "height").join(text, ["doc", "page_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    blocks = pdf.operators_of(parsed).filter("op IN ('image', 'inline_image')").select("doc", "page_idx", F.lit("image").alias("type"))
    p = profile(pages, blocks, gold).join(files.select("doc", "length", "mb"), "doc")
    with_gold_ = F.lit(None) if gold is None else F.when(F.col("with_gold").isNotNull(), F.struct(F.col("with_gold.gold_chars").alias("caracteresGabarito"), F.col("with_gold.ratio").alias("razaoExtraidoSobreGabarito"), F.col("with_gold.image_share").alias("estimativaConteudoEmImagem")))
    return p.select(
        "doc", F.concat("doc", F.lit(".pdf")).alias("arquivo"), F.col("length").alias("tamanhoBytes"), F.col("mb").alias("tamanhoMB"), F.col("num_pages").alias("numPaginas"),
        F.struct(F.col("mean_width").alias("largura"), F.col("mean_height").alias("altura")).alias("dimensoesMedias"), F.col("chars").alias("caracteresExtraidos"),
        F.struct(F.col("chars_mean").alias("media"), F.col("chars_min").alias("min"), F.col("chars_max").alias("max")).alias("caracteresPorPagina"), F.col("few_text_pages").alias("paginasComPoucoTexto"), F.col("images").alias("numImagensReportadas"),
        with_gold_.alias("comGabarito"),
    )


def result_rows(done: DataFrame, gold: DataFrame) -> DataFrame:
    """The published columns of each run on a document that has a gold text (doc, text)."""
    known = with_gold(done, gold.select("doc", F.col("text").alias("gold")), "doc")
    scored = with_metrics(known, "text", "gold")
    mine = dict(zip(METRICS, ("sim_lev", "cov", "sim_bi", "rel_len", "excess_q"), strict=True))
    columns = {"pdf": F.col("doc"), "extrator": F.col("extractor"), "num_paginas": F.col("num_pages"), "tempo_seg": places(F.col("seconds"), 3), "num_caracteres": F.col("num_chars")}
    columns |= {name: places(F.col(c), 4) for name, c in mine.items()} | {"erro": F.coalesce("error", F.lit(""))}
    return scored.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in RESULT.fields])


@dataclass(frozen=True)
class Outcome:
    """Why a run ended early (empty if it didn't), the rows it made, older rows that stayed, what there is to tell: a line for each
    document that was left out, up to TOLD, and for each pipeline."""

    problem: str = ""
    rows: int = 0
    kept: int = 0
    told: tuple[str, ...] = ()


#: Most documents that a run's report names.
TOLD = 100


def benchmark(spark: SparkSession, pdfs: str, gold: str, out: str, only: str | None = None, only_extractor: str | None = None, tools: Tools = Tools()) -> Outcome:  # noqa: B008
    """Runs the pipelines on the PDFs that have a gold text; writes out/benchmark.csv and out/benchmark.json.

    A run with a filter is merged into the rows that are there; one without takes their place.
    """
    files = results.scan_documents(spark, pdfs).filter(contains(F.col("doc"), only))
    if files.isEmpty():
        return Outcome(f"no PDF in {pdfs} (filter {only!r})")
    names = [n for n in extractors.REGISTRY if not only_extractor or only_extractor.lower() in n.lower()]
    if not names:
        return Outcome(f"no extractor matches {only_extractor!r}")
    texts = results.scan_gold(spark, gold)
    without = files.select("doc").join(texts.select("doc"), "doc", "left_anti").orderBy("doc")
    told = [f"left out, no gold text: {r['doc']}" for r in without.limit(TOLD).collect()]
    if len(told) == TOLD:
        told.append(f"left out, no gold text: {without.count() - TOLD} more")
    files = files.join(texts.select("doc"), "doc", "left_semi")
    if files.isEmpty():
        return Outcome("no PDF has a gold text", told=tuple(told))
    rows = result_rows(runs(spark, files, names, tools), texts).persist()
    path = f"{out.rstrip('/')}/benchmark.csv"
    filtered = bool(only or only_extractor)
    old = results.read_results(spark, path)
    kept = preserved(old, rows).first()[0] if filtered else 0
    merged = merge_run(old, rows, filtered).persist()
    results.replace_results(merged, path)
    means = averages(results.read_results(spark, path), "extrator", ["tempo_seg", *METRICS], "erro")
    results.write_value(spark, results.averages_json(means, "extrator").first()["value"], f"{out.rstrip('/')}/benchmark.json")
    failed = rows.filter("erro <> ''").groupBy("extrator", "erro").agg(F.count("*").alias("n")).orderBy("extrator", F.desc("n"), "erro").limit(TOLD)
    told += [f"{r['extrator']}: {r['n']} failed, {r['erro'][:80]}" for r in failed.collect()]
    told += [r["line"] for r in means.orderBy("extrator").select(summary_line(F.col("extrator"), F.col(f"mean_{METRICS[0]}"), F.col("mean_tempo_seg")).alias("line")).collect()]  # a line for each pipeline
    return Outcome("", rows.count(), kept, tuple(told))
