"""Dropping boilerplate lines by their frequency within a site.

A line (what stands between line feeds, without blanks around it) is boilerplate on a host if more than RATIO of
the host's pages hold it, and at least MIN_PAGES of them. All of it is DataFrame operations: each page's distinct
lines are hashed to 64 bits and counted by host with partial sums before the shuffle; only lines that reach
MIN_PAGES meet the host totals; what is left, at most lines-per-page / RATIO for a host, is gathered by host, written,
counted, and joined back: by broadcast up to BROADCAST hashes, so that texts stay where they are; beyond that by a
sort-merge join whose large partitions adaptive execution splits, so a host with a third of all pages is no single
task.

With a RARE ratio, lines count as boilerplate too that at least RARE_PAGES different texts hold and more than that
smaller share of the host's different texts; the pages of a group of copies, which share all their lines, are then
too few on a small host, and exact copies count once.

Defined results: a null host is a host of its own; a null text stays null and counts as a page without lines;
empty lines are never dropped; a line that repeats within a page counts once but is dropped everywhere; repeated
rows are pages of their own; columns of any other name are passed through; an empty table gives an empty one.

MIN_PAGES matters for hosts of fewer than 60 pages alone (a line on two pages is more than a twentieth of up to 39): without
it every line of a host of one page is boilerplate. RARE_PAGES keeps lines that fewer than 10 different texts of a host hold
and more than a twentieth but not more than a tenth of them: on hosts of fewer than 200 different texts a menu line may stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch
from foliant.sources.tables import table

#: Share of a host's pages above which a line is boilerplate, as a fraction.
RATIO = (1, 20)
MIN_PAGES = 3
#: With two shares, the larger one for lines of few texts, the smaller one for lines of at least RARE_PAGES different texts.
FEW, RARE = (1, 10), (1, 20)
RARE_PAGES = 10
#: Most hashes of boilerplate lines (8 bytes each), with 8 more for each host, that are sent to all executors.
BROADCAST = 1 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: tuple[int, int] = RATIO, min_pages: int = MIN_PAGES, rare: tuple[int, int] | None = None) -> DataFrame:
    """One row for each host that has boilerplate: ``_host`` and the hashes of its lines, ``_lines``."""
    pages = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    hashes = F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x)))
    number, lines = [F.count("*")], [F.explode(F.array_distinct(hashes)).alias("_line")]
    if rare:
        pages = pages.withColumn("_page", F.xxhash64("_text"))
        number, lines = [*number, F.count_distinct("_page")], [*lines, "_page"]
    counted = pages.select("_host", *lines).groupBy("_host", "_line").agg(*(n.alias(c) for n, c in zip(number, ("_pages", "_texts"), strict=False))).filter(F.col("_pages") >= min_pages)
    totals = pages.groupBy(F.col("_host").alias("_of")).agg(*(n.alias(c) for n, c in zip(number, ("_total", "_all_texts"), strict=False)))
    often = F.col("_pages") * ratio[1] > F.col("_total") * ratio[0]
    if rare:
        often |= (F.col("_texts") >= RARE_PAGES) & (F.col("_texts") * rare[1] > F.col("_all_texts") * rare[0])
    common = counted.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).filter(often)
    return common.groupBy("_host").agg(F.array_sort(F.collect_set("_line")).alias("_lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: tuple[int, int] = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, rare: tuple[int, int] | None = None) -> DataFrame:
    """*docs* with boilerplate lines taken out of *text*; with *counts* also ``n_lines`` and ``n_dropped``."""
    found = Scratch(docs.sparkSession).save(boilerplate(docs, host, text, ratio, min_pages, rare))
    if found.agg(F.coalesce(F.sum(F.size("_lines") + 8), F.lit(0))).first()[0] <= BROADCAST:
        found = F.broadcast(found)
    joined = docs.join(found, docs[host].eqNullSafe(found["_host"]), "left")
    lines = _lines(docs[text])
    kept = F.when(found["_lines"].isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(found["_lines"], F.xxhash64(F.trim(x)))))
    out = [F.array_join(kept, "\n").alias(c) if c == text else docs[c] for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0))
        n = F.when(docs[text].isNull(), 0).otherwise(n)
        out += [n.cast("long").alias("n_lines"), (n - F.when(docs[text].isNull(), 0).otherwise(F.size(kept))).cast("long").alias("n_dropped")]
    return joined.select(*out)


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication does to every document, with its source as host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op8_site_lines": op8_site_lines}

ORACLE = {
    "op8_site_lines": """
WITH pages AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
seen AS (SELECT DISTINCT rowid_, source, trim(line) AS line
         FROM (SELECT row_number() OVER () AS rowid_, source, unnest(lines) AS line FROM pages) WHERE trim(line) <> ''),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
        GROUP BY s.source, s.line, t.total HAVING count(*) >= 3 AND count(*) * 20 > t.total),
sets AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cut AS (SELECT p.doc_id, p.lines,
               list_filter(p.lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(s.bad, []), trim(x))) AS kept
        FROM pages p LEFT JOIN sets s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM cut
""",
}
