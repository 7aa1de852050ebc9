"""Queries over the layout of pages: kinds of line, rendered documents, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import blocks, layout
from foliant.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# Sites as documents: what stands right behind a tag is a line of the page, sized as a browser would.
_TAG = r"(?s)<(h1|p|b|li|a|footer|div)( [^>]*)?>([^<]+)"
_HOST = "^https?://([^/]+)"


def html_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.regexp_extract("url", _HOST, 1).alias("doc"), F.col("page_id").alias("page_idx"), "html")
    found = lambda n: F.regexp_extract_all("html", F.lit(_TAG), F.lit(n))
    rows = pages.select("doc", "page_idx", F.posexplode(F.arrays_zip(found(1).alias("tag"), found(3).alias("text"))).alias("band", "t")).select("doc", "page_idx", "band", "t.tag", F.trim("t.text").alias("text")).filter("text <> ''")
    tag, size = F.col("tag"), F.when(F.col("tag") == "h1", 24.0).when(F.col("tag").isin("footer", "a"), 9.0).otherwise(11.0)
    return rows.select("doc", "page_idx", "band", F.lit(0).alias("line"), F.lit(72.0).alias("x0"), (72.0 + 5 * F.length("text")).alias("x1"), (-14.0 * F.col("band")).alias("y"), size.alias("size"), F.when(tag == "b", "Helvetica-Bold").otherwise("Helvetica").alias("font"), "text", F.lit(1).cast("long").alias("cells"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    lines = html_lines(spark, d)
    return layout.classified(lines, lines.groupBy("doc").agg(F.count_distinct("page_idx").alias("num_pages")))


def _says(pattern: str) -> str:
    return f"regexp_matches(trim(text), '{pattern}')"


_EDGE = f"(from_top <= {layout.EDGE} OR from_bottom <= {layout.EDGE})"
_SHORT = f"(len(trim(text)) <= 80 AND NOT {_says('[.;,]$')})"
_MARKS = f"(len(trim(text)) - len(regexp_replace(trim(text), '{layout.MARKS}', '', 'g')))"
_LINES = f"""found AS (SELECT regexp_extract(url, '{_HOST}', 1) AS doc, page_id AS page_idx, regexp_extract_all(html, '{_TAG}', 1) AS tags, regexp_extract_all(html, '{_TAG}', 3) AS texts FROM pages),
cut AS (SELECT doc, page_idx, unnest(range(len(texts))) AS band, unnest(tags) AS tag, trim(unnest(texts)) AS text FROM found),
lines AS (SELECT doc, page_idx, band, text, CASE WHEN tag = 'h1' THEN 24.0 WHEN tag IN ('footer', 'a') THEN 9.0 ELSE 11.0 END AS size, CASE tag WHEN 'b' THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font FROM cut WHERE text <> ''),
counts AS (SELECT doc, count(DISTINCT page_idx) AS num_pages FROM lines GROUP BY doc),
placed AS (SELECT *, band - min(band) OVER w + 1 AS from_top, max(band) OVER w - band + 1 AS from_bottom, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS same FROM lines WINDOW w AS (PARTITION BY doc, page_idx)),
often AS (SELECT doc, same FROM placed JOIN counts USING (doc) WHERE {_EDGE} GROUP BY doc, same, num_pages HAVING count(DISTINCT page_idx) >= {layout.REPEATED} * num_pages AND count(DISTINCT page_idx) >= 2),
bodies AS (SELECT doc, arg_min(size, struct_pack(n := -n, size := size)) AS body FROM (SELECT doc, size, sum(len(text)) AS n FROM lines GROUP BY ALL) GROUP BY doc),
kinds AS (SELECT p.*, CASE
  WHEN {_EDGE} AND {_says(layout.PAGE_NUMBER)} THEN 'page_number'
  WHEN o.doc IS NOT NULL AND {_EDGE} AND from_top <= from_bottom THEN 'header'
  WHEN o.doc IS NOT NULL AND {_EDGE} THEN 'footer'
  WHEN {_says(layout.CAPTION)} THEN 'caption'
  WHEN {_says(layout.EXERCISE)} THEN 'exercise'
  WHEN {_says(layout.DEFINITION)} THEN 'definition'
  WHEN size >= {layout.TITLE} * body AND {_SHORT} THEN 'title'
  WHEN {_says(layout.BULLET)} THEN 'list_item'
  WHEN {_says(layout.QUOTE)} THEN 'quote'
  WHEN {_says(layout.CODE)} THEN 'code'
  WHEN {_says(layout.FORMULA)} AND {_MARKS} >= 0.3 * len(trim(text)) THEN 'formula'
  WHEN (font = 'Helvetica-Bold' OR upper(trim(text)) = trim(text) AND {_says('[A-Z]{3}')}) AND {_SHORT} THEN 'title'
  ELSE 'paragraph' END AS type FROM placed p LEFT JOIN often o ON o.doc = p.doc AND o.same = p.same JOIN bodies b ON b.doc = p.doc),
typed AS (SELECT *, CASE WHEN type = 'title' THEN least(6, dense_rank() OVER (PARTITION BY doc, type ORDER BY size DESC)) END AS level FROM kinds)"""


@query(f"WITH {_LINES} SELECT doc, page_idx, band, type, CAST(level AS INTEGER) AS level FROM typed")
def q_layout_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every line of the web pages, a site's pages together."""
    return _typed(spark, d).select("doc", "page_idx", "band", "type", "level")


@query(f"""WITH {_LINES}, shown AS (SELECT doc, page_idx, band, text, CASE type WHEN 'title' THEN repeat('#', CAST(level AS BIGINT)) || ' ' || text WHEN 'list_item' THEN '- ' || text
  WHEN 'quote' THEN '> ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS md FROM typed WHERE type NOT IN ('header', 'footer', 'page_number'))
SELECT doc, page_idx, sha256(string_agg(md, chr(10) || chr(10) ORDER BY band)) AS markdown, sha256(string_agg(text, chr(10) ORDER BY band)) AS text FROM shown GROUP BY doc, page_idx""")
def q_layout_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as markdown and as plain text, what repeats at their edges left out; digests."""
    lines = _typed(spark, d).withColumns({"image_path": F.lit(None).cast("string"), "image_caption": F.lit(None).cast("string"), "site": F.col("doc")})
    page = F.to_json(F.struct("site", F.col("page_idx").alias("page")))
    out = blocks.rendered(lines.withColumn("doc", page), "band").withColumn("k", F.from_json("doc", "struct<site:string,page:long>"))
    return out.select("k.site", "k.page", F.sha2("markdown", 256).alias("markdown"), F.sha2("text", 256).alias("text")).withColumnsRenamed({"site": "doc", "page": "page_idx"})


_COLUMN = "l_linenumber % 2"


@query(f"""WITH b AS (SELECT l_suppkey AS doc, l_orderkey % 12 AS page_idx, l_orderkey, l_linenumber, {_COLUMN} AS col FROM lineitem)
SELECT doc, page_idx, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY doc, page_idx ORDER BY col, l_orderkey, l_linenumber) - 1 AS INTEGER) AS turn FROM b""")
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as blocks in two columns of a supplier's pages, read one column after the other."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 12).alias("page_idx"), "l_orderkey", "l_linenumber", F.expr(_COLUMN).alias("col")).repartition("doc", "page_idx")  # pages are dealt out once for all that follows
    down = F.row_number().over(Window.partitionBy("doc", "page_idx", "col").orderBy("l_orderkey", "l_linenumber"))
    placed = rows.select("doc", "page_idx", "l_orderkey", "l_linenumber", (50.0 + 300 * F.col("col")).alias("x"), (12.0 * down).alias("y"), F.lit(200.0).alias("w"), F.lit(10.0).alias("h"))
    return blocks.reading_order(placed).select("doc", "page_idx", "l_orderkey", "l_linenumber", "turn")
