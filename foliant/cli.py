"""Command line: ``python -m foliant.cli benchmark|gold|xray``; the exit code is 1 where there is nothing to do.

Options have the published names: --apenas (part of a document's name), --apenas-extrator, --forcar.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.operators import gold
from foliant.operators.scoreboard import contains
from foliant.plans import evaluate
from foliant.sources import pdf, results
from foliant.sources.pdf_slice import page_counts


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliant")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("benchmark", "gold", "xray"):
        c = commands.add_parser(name)
        c.add_argument("--pdfs", required=True, help="folder of PDF files")
        c.add_argument("--gold", required=True, help="folder of gold texts, <document>.txt")
        c.add_argument("--out", required=True, help="folder of results")
        c.add_argument("--apenas", help="documents whose name holds this, in any case")
        if name == "benchmark":
            c.add_argument("--apenas-extrator", help="pipelines whose name holds this, in any case")
        elif name == "gold":
            c.add_argument("--forcar", action="store_true", help="also documents that have a gold text or were refused")
    return out


def make_gold(spark: SparkSession, pdfs: str, texts: str, out: str, only: str | None = None, force: bool = False, client=None, model=None, prompt: str = gold.PROMPT) -> evaluate.Outcome:
    """Gold texts of the documents that have none, and their metadata.

    They come from a *client* that knows the documents, or from a *model* that is sent their pages with a *prompt*; without
    either a file's own text is taken.
    """
    files = results.scan_documents(spark, pdfs).filter(contains(F.col("doc"), only))
    if files.isEmpty():
        return evaluate.Outcome(f"no PDF in {pdfs} (filter {only!r})")
    path = f"{out.rstrip('/')}/gabaritos_metadata.json"
    known = results.gold_metadata(spark, path)
    known = spark.createDataFrame([], "doc string, recusaDetectada boolean") if known is None else known
    there = results.scan_gold(spark, texts) if results.exists(spark, texts) else spark.createDataFrame([], "doc string, text string")
    todo = gold.to_do(files, there, known.select("doc", F.coalesce("recusaDetectada", F.lit(False)).alias("refused")), force)
    counts = page_counts(todo).persist()
    if client is None and model is None:
        pages = pdf.read_pages(todo).filter("error IS NULL").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda p: p["text"]).alias("t"))
        own = {r["doc"]: r["t"] for r in pages.toLocalIterator()}  # an offline trial of a few files
        client = lambda: gold.OfflineClient(own)
    some = counts.filter("num_pages > 0")
    done = gold.assemble(gold.transcribe_files(todo, some, model, prompt) if model else gold.transcribe(some, client)).persist()
    n = done.count()
    if n:
        results.write_texts(done.filter("NOT refused AND NOT partial"), texts)
        results.save_gold_metadata(spark, gold.metadata_rows(done, done.select("doc", "seconds"), counts), path)
        results.export_gold_metadata(spark, path)
    return evaluate.Outcome("", n)


def make_xray(spark: SparkSession, pdfs: str, texts: str, out: str, only: str | None = None) -> evaluate.Outcome:
    """A profile of each PDF as a file <document>.json below *out*/raio-x."""
    files = results.scan_documents(spark, pdfs).filter(contains(F.col("doc"), only))
    if files.isEmpty():
        return evaluate.Outcome(f"no PDF in {pdfs} (filter {only!r})")
    known = results.scan_gold(spark, texts) if results.exists(spark, texts) else None
    rows = evaluate.profiles(files, known).persist()
    results.write_json(rows, f"{out.rstrip('/')}/raio-x", "doc")
    return evaluate.Outcome("", rows.count())


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, tools: evaluate.Tools | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    if a.command == "benchmark":
        got = evaluate.benchmark(spark, a.pdfs, a.gold, a.out, a.apenas, a.apenas_extrator, tools or evaluate.Tools())
    elif a.command == "xray":
        got = make_xray(spark, a.pdfs, a.gold, a.out, a.apenas)
    else:
        got = make_gold(spark, a.pdfs, a.gold, a.out, a.apenas, a.forcar)
    for line in got.told:
        print(line)
    print(got.problem or f"{got.rows} rows, {got.kept} older ones kept")
    return 1 if got.problem else 0


if __name__ == "__main__":
    sys.exit(main())
