"""Making gold texts with a language model: calls, refusals, costs, bisection of page ranges.

The model is a client given by the caller; everything around it is a frontier table of page ranges that a loop of at
most MOST_DEPTH + 1 rounds bisects.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.textnorm import places
from foliant.operators.pages import PAGE_BREAK, ordered
from foliant.sources.pdf_slice import slice_pages

#: Prices in USD per million tokens, refusal bounds, retries and depth.
PRICE_IN, PRICE_OUT = 3.0, 15.0
REFUSAL_IN, REFUSAL_OUT = 10_000, 500
RETRIES, FIRST_WAIT = 3, 30
MOST_DEPTH = 6
CALL = "doc string, start long, end long, depth int, text string, tokens_in long, tokens_out long, stop_reason string, error string, seconds double"


class GoldClient(Protocol):
    def __call__(self, doc: str, start: int, end: int) -> dict:
        """text, tokens_in, tokens_out, stop_reason of pages [start, end); raises on failure."""


class PageModel(Protocol):
    def __call__(self, prompt: str, pdf_base64: str) -> dict:
        """As GoldClient, for the pages of a PDF; raises on failure."""


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return places((tokens_in * PRICE_IN + tokens_out * PRICE_OUT) / 1e6, 4)


def refused(stop_reason: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """A regular end after a long input and a short output is a refusal."""
    return F.coalesce((stop_reason == "end_turn") & (tokens_in >= REFUSAL_IN) & (tokens_out < REFUSAL_OUT), F.lit(False))


def rate_limited(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike("429|rate_limit"), F.lit(False))


def _limited(error: str) -> bool:
    return any(mark in error.lower() for mark in ("429", "rate_limit"))


def _calls(rows: DataFrame, make: Callable[[], Callable], wait: Callable[[float], None]) -> DataFrame:
    """One call for each row, which has doc, start, end and depth, retried on rate limits with growing waits; failures are rows with an error.

    *make* gives, in the task, a function of a row.
    """

    def run(batches):
        import pandas as pd

        ask = make()
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                got, error, began = {}, None, time.perf_counter()
                for turn in range(RETRIES + 1):
                    try:
                        got, error = ask(r), None
                        break
                    except Exception as e:  # noqa: BLE001  the client's failure is the row's error
                        error = str(e)
                        if not _limited(error) or turn == RETRIES:
                            break
                        wait(FIRST_WAIT * 2**turn)
                if error and _limited(error):
                    error = f"RATE_LIMIT: {error}"
                done.append((r.doc, r.start, r.end, r.depth, got.get("text", ""), got.get("tokens_in", 0), got.get("tokens_out", 0), got.get("stop_reason"), error, time.perf_counter() - began))
            yield pd.DataFrame(done, columns=[c.split()[0] for c in CALL.split(", ")])

    return rows.mapInPandas(run, CALL)


def call_pages(ranges: DataFrame, client: Callable[[], GoldClient], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """One call for each range, of a client that knows the documents."""

    def make():
        ask = client()
        return lambda r: ask(r.doc, int(r.start), int(r.end))

    return _calls(ranges.select("doc", "start", "end", "depth"), make, wait)


def call_slices(ranges: DataFrame, files: DataFrame, model: Callable[[], PageModel], prompt: str, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """One call for each range, of a model that gets a prompt and the range's pages as a PDF of their own in base64.

    Slices are cut in the tasks that send them; a file goes to a task once for each of its open ranges.
    """

    def make():
        ask = model()
        return lambda r: ask(prompt, base64.b64encode(slice_pages(bytes(r.content), int(r.start), int(r.end))).decode("ascii"))

    return _calls(ranges.select("doc", "start", "end", "depth").join(files.select("doc", "content"), "doc"), make, wait)


def judged(calls: DataFrame) -> DataFrame:
    """Calls with ``refused`` and ``was_split``: whether the range goes on in two halves."""
    no = refused(F.col("stop_reason"), F.col("tokens_in"), F.col("tokens_out"))
    failed = F.col("error").isNotNull() | (F.coalesce("stop_reason", F.lit("")) == "max_tokens")
    split = failed & ~rate_limited(F.col("error")) & ~no & (F.col("end") - F.col("start") > 1) & (F.col("depth") < MOST_DEPTH)
    return calls.withColumns({"refused": no, "was_split": split}).withColumn("error", F.when(F.col("refused"), F.lit("RECUSA: resposta curta demais")).otherwise(F.col("error")))


def halves(split: DataFrame) -> DataFrame:
    """The two halves of each range, the first with floor(n / 2) pages."""
    middle = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    return split.select("doc", F.explode(F.array(F.struct(F.col("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end")))).alias("r"), (F.col("depth") + 1).alias("depth")).select("doc", "r.start", "r.end", "depth")


def transcribe(counts: DataFrame, client: Callable[[], GoldClient], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """All calls of a client for documents (doc, num_pages)."""
    return _levels(counts, lambda ranges: call_pages(ranges, client, wait))


#: What the model is asked when the caller gives no prompt.
PROMPT = "Transcribe all text of these pages in reading order, images of text included. Answer with the text alone."


def transcribe_files(files: DataFrame, counts: DataFrame, model: Callable[[], PageModel], prompt: str = PROMPT, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """All calls of a model for the PDF files (doc, content) with their numbers of pages; each call gets its pages alone."""
    return _levels(counts, lambda ranges: call_slices(ranges, files, model, prompt, wait))


def _levels(counts: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Calls level by level, a failed range in two halves on the next; checkpointed, so that no call is made twice."""
    frontier = counts.select("doc", F.lit(0).cast("long").alias("start"), F.col("num_pages").cast("long").alias("end"), F.lit(0).alias("depth"))
    done = None
    for _ in range(MOST_DEPTH + 1):
        calls = judged(call(frontier)).checkpoint()
        done = calls if done is None else done.unionByName(calls)
        open_ = calls.filter("was_split")
        if open_.isEmpty():
            break
        frontier = halves(open_)
    return done


def assemble(calls: DataFrame) -> DataFrame:
    """One row per document: text of the leaves in page order, totals, refusal; ``partial`` marks leaves that were lost."""
    leaf = ~F.col("was_split")
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("start", leaf.alias("leaf"), F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["leaf"]), lambda x: x["text"]), PAGE_BREAK)
    label = F.concat(F.lit("pg "), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))
    chunk = F.struct(label.alias("pages"), "depth", "stop_reason", "error", "was_split")
    return calls.groupBy("doc").agg(
        text.alias("text"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("seconds").alias("seconds"), places(F.sum(cost(F.col("tokens_in"), F.col("tokens_out"))), 4).alias("cost_usd"),
        F.count("*").alias("num_chunks"), ordered(chunk, F.struct("depth", "start")).alias("chunks"), F.bool_or("refused").alias("refused"), F.bool_or(leaf & F.col("error").isNotNull()).alias("partial"),
    )


def to_do(docs: DataFrame, texts: DataFrame, metadata: DataFrame, force: bool = False) -> DataFrame:
    """Documents that have neither a gold text nor a recorded refusal."""
    if force:
        return docs
    return docs.join(texts.select("doc"), "doc", "left_anti").join(metadata.filter("refused").select("doc"), "doc", "left_anti")


def bisection_trees(counts: DataFrame) -> DataFrame:
    """doc, start, end and depth of all ranges of documents (doc, num_pages) that are split down to single pages, as far as MOST_DEPTH."""
    level = counts.filter("num_pages > 0").select("doc", F.lit(0).cast("long").alias("start"), F.col("num_pages").cast("long").alias("end"), F.lit(0).alias("depth"))
    out = level
    for _ in range(MOST_DEPTH):
        level = halves(level.filter("end - start > 1"))
        out = out.unionByName(level)
    return out


class OfflineClient:
    """A client without a model: the files' own text, so that runs need no network. Tokens are counted as words."""

    def __init__(self, pages: dict[str, list[str]], prompt: str = PROMPT):
        self.pages, self.prompt = pages, prompt

    def __call__(self, doc: str, start: int, end: int) -> dict:
        text = PAGE_BREAK.join(self.pages[doc][start:end])
        return {"text": text, "tokens_in": len(self.prompt.split()), "tokens_out": len(text.split()), "stop_reason": "end_turn"}


def metadata_rows(assembled: DataFrame, seconds: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the gold metadata, in the published names: those with an error have no characters and no chunks."""
    rows = assembled.drop("seconds").join(counts, "doc").join(seconds, "doc", "left")
    failed = F.col("refused") | F.col("partial")
    first = F.filter("chunks", lambda c: c["error"].isNotNull())[0]["error"]
    chunks = F.transform("chunks", lambda c: F.struct(c["pages"].alias("paginas"), c["depth"].alias("depth"), c["stop_reason"].alias("stopReason"), c["error"].alias("erro"), c["was_split"].alias("foiDividido")))
    return rows.select(
        "doc", F.col("num_pages").cast("int").alias("numPaginas"), F.when(~failed, F.length("text")).cast("int").alias("numCaracteres"), places(F.coalesce("seconds", F.lit(0.0)), 2).alias("tempoSegundos"),
        F.col("tokens_in").alias("tokensInput"), F.col("tokens_out").alias("tokensOutput"), F.col("cost_usd").alias("custoUsd"), F.when(~failed, F.col("num_chunks")).cast("int").alias("numChunks"),
        F.when(~failed, chunks).alias("chunks"), F.when(failed, first).alias("erro"), F.when(failed, F.col("refused")).alias("recusaDetectada"),
    )
