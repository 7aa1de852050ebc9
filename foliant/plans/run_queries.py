"""Queries over whole pipelines and over files that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import extractors, gold, scoreboard
from foliant.operators.pages import PAGE_BREAK
from foliant.plans import duck
from foliant.plans.text_queries import long
from foliant.sources import results
from foliant.sources.keyed_table import KeyedTable
from foliant.sources.tables import table
from foliant.sources.workspace import new_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# Conversations as documents, turns as pages: each page holds one image of its own and one that all pages share; the
# OCR of an image is a passage of the benchmark, with confidences by place.
_TEXT_ONLY = ("pdf-parse", "pdfjs-dist", "unpdf", "pdf2json", "mupdf", "docling", "mineru")
_VARIANTS = {("standard", False): "b: ", ("best", False): "B: ", ("standard", True): "p: "}


def conversation_inputs(spark: SparkSession, d: str) -> extractors.Inputs:
    """All tables that the pipelines read, made of conversations and benchmark passages."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_idx"), F.coalesce("text", F.lit("")).alias("text"))
    n, passages = F.length("text"), table(spark, d, "benchmark")
    most = passages.count()
    vector = None
    for name in _TEXT_ONLY:
        part = pages.select(F.lit(name).alias("backend"), "doc", "page_idx", F.concat(F.col("text"), F.lit("" if name in ("unpdf", "mupdf") else f" {name}")).alias("text"))
        vector = part if vector is None else vector.unionByName(part)
    own = pages.select("doc", "page_idx", F.lit(0).alias("img_idx"), (300 + 25 * (n % 20)).cast("int").alias("width"), (200 + 40 * (F.col("page_idx") % 5)).cast("int").alias("height"), (n % most).cast("string").alias("hash"))
    shared = pages.select("doc", "page_idx", F.lit(1).alias("img_idx"), F.lit(600).alias("width"), F.lit(401).alias("height"), F.lit("back").alias("hash"))
    placements = own.unionByName(shared)
    passages = passages.select(F.col("item_id").cast("string").alias("hash"), "text")
    words = None
    for (model, prep), lead in _VARIANTS.items():
        for scale in (1.0, 2.0):
            text = F.concat(F.lit(lead), F.col("text")) if scale == 1 else F.concat(F.col("text"), F.lit(" twice"))
            part = passages.select("hash", F.lit(model).alias("model"), F.lit(prep).alias("prep"), F.lit(scale).alias("scale"), F.posexplode(F.split(text, " ")).alias("word_idx", "text"))
            words = part if words is None else words.unionByName(part)
    words = words.withColumn("confidence", ((F.col("word_idx") * 37) % 101).cast("double"))
    page_text = pages.filter("page_idx % 3 < 2").select(F.explode(F.array(F.lit("mupdf"), F.lit("unpdf"))).alias("renderer"), "doc", "page_idx", F.concat(F.lit("ocr "), F.col("text")).alias("text"))
    box_text = placements.select("doc", "page_idx", "img_idx", "width", "height", F.concat(F.lit(" box "), F.col("hash")).alias("text"))
    blocks = own.select("doc", "page_idx", F.lit("image").alias("type"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    counts = pages.groupBy("doc").agg((F.max("page_idx") + 1).alias("num_pages"))
    sizes = pages.select("doc", "page_idx", F.lit(800.0).alias("width"), F.lit(600.0).alias("height"))
    return extractors.Inputs(counts=counts, vector=vector, placements=placements, words=words, page_text=page_text, box_text=box_text, blocks=blocks, sizes=sizes)


_BASE = """pg AS (SELECT conv_id AS doc, turn AS page_idx, coalesce(text, '') AS text FROM conversations),
counts AS (SELECT doc, max(page_idx) + 1 AS num_pages FROM pg GROUP BY doc),
images AS (SELECT doc, page_idx, 0 AS img_idx, 300 + 25 * (len(text) % 20) AS width, 200 + 40 * (page_idx % 5) AS height, CAST(len(text) % (SELECT count(*) FROM benchmark) AS VARCHAR) AS hash FROM pg
  UNION ALL SELECT doc, page_idx, 1, 600, 401, 'back' FROM pg),
passages AS (SELECT CAST(item_id AS VARCHAR) AS hash, text FROM benchmark),
wide AS (SELECT * FROM images WHERE CAST(width AS BIGINT) * height >= 100000),
sz AS (SELECT doc, width, height, count(DISTINCT page_idx) AS pages, min(struct_pack(a := page_idx, b := img_idx)) AS first FROM images GROUP BY doc, width, height),
bg AS (SELECT doc, width, height FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pages DESC, first) AS r FROM sz) JOIN counts USING (doc) WHERE r = 1 AND CAST(pages AS DOUBLE) / num_pages >= 0.5),
bh AS (SELECT doc, hash FROM images JOIN counts USING (doc) GROUP BY doc, hash, num_pages HAVING count(DISTINCT page_idx) >= 0.5 * num_pages),
front AS (SELECT w.* FROM wide w WHERE NOT EXISTS (SELECT 1 FROM bg WHERE bg.doc = w.doc AND bg.width = w.width AND bg.height = w.height)),
fresh AS (SELECT w.* FROM wide w WHERE NOT EXISTS (SELECT 1 FROM bh WHERE bh.doc = w.doc AND bh.hash = w.hash))"""

#: From pages p (extractor, doc, page_idx, text) to documents.
_DOCS = "SELECT extractor, doc, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page_idx)) AS digest, count(*) AS num_pages FROM p GROUP BY extractor, doc"


def _behind(ocr: str) -> str:
    """The page's text with *ocr* (null: none) behind it."""
    return f"CASE WHEN {ocr} IS NULL THEN pg.text WHEN pg.text = '' THEN {ocr} ELSE pg.text || chr(10) || {ocr} END"


def _digests(spark: SparkSession, d: str, *names: str) -> DataFrame:
    out = extractors.extract(conversation_inputs(spark, d), list(names))
    return out.select("extractor", "doc", F.sha2("text", 256).alias("digest"), long(F.col("num_pages")).alias("num_pages"))


@query(f"""WITH {_BASE}, names AS (SELECT unnest({list(_TEXT_ONLY)}) AS extractor),
p AS (SELECT extractor, doc, page_idx, CASE WHEN extractor IN ('unpdf', 'mupdf') THEN text ELSE text || ' ' || extractor END AS text FROM pg CROSS JOIN names) {_DOCS}""")
def q_extract_own_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the pipelines that read a file's own text."""
    return _digests(spark, d, *_TEXT_ONLY)


@query(f"""WITH {_BASE}, p AS (SELECT extractor, doc, page_idx, CASE WHEN page_idx % 3 < 2 THEN 'ocr ' || text ELSE '' END AS text
FROM pg CROSS JOIN (SELECT unnest(['tesseract', 'tesseract-unpdf']) AS extractor)) {_DOCS}""")
def q_extract_whole_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents by OCR of whole pages; pages without any are empty."""
    return _digests(spark, d, "tesseract", "tesseract-unpdf")


@query(f"""WITH {_BASE}, p AS (SELECT 'hibrido' AS extractor, doc, page_idx, CASE WHEN len(text) < 100 AND page_idx % 3 < 2 THEN CASE WHEN text = '' THEN 'ocr ' ELSE text || chr(10) || 'ocr ' || text END ELSE text END AS text FROM pg) {_DOCS}""")
def q_extract_poor_pages(spark: SparkSession, d: str) -> DataFrame:
    """OCR behind pages of little text."""
    return _digests(spark, d, "hibrido")


@query(f"""WITH {_BASE}, p AS (SELECT 'hibrido2' AS extractor, pg.doc, pg.page_idx,
  CASE WHEN i.width * i.height / 480000.0 >= 0.3 AND len(pg.text) < 500 AND pg.page_idx % 3 < 2 THEN 'ocr ' || pg.text ELSE pg.text END AS text
  FROM pg JOIN images i ON i.doc = pg.doc AND i.page_idx = pg.page_idx AND i.img_idx = 0) {_DOCS}""")
def q_extract_filled_pages(spark: SparkSession, d: str) -> DataFrame:
    """OCR in place of the text of pages that images fill."""
    return _digests(spark, d, "hibrido2")


@query(f"""WITH {_BASE}, g AS (SELECT w.doc, w.page_idx, bool_or(bg.doc IS NULL) AS front FROM wide w LEFT JOIN bg ON bg.doc = w.doc AND bg.width = w.width AND bg.height = w.height GROUP BY w.doc, w.page_idx),
p AS (SELECT 'hibrido-unpdf' AS extractor, pg.doc, pg.page_idx, CASE WHEN g.doc IS NOT NULL AND (front OR len(pg.text) < 200) AND pg.page_idx % 3 < 2 THEN 'ocr ' || pg.text ELSE pg.text END AS text
  FROM pg LEFT JOIN g USING (doc, page_idx)) {_DOCS}""")
def q_extract_image_pages(spark: SparkSession, d: str) -> DataFrame:
    """OCR in place of the text of pages with large images in front of the background."""
    return _digests(spark, d, "hibrido-unpdf")


@query(f"""WITH {_BASE}, o AS (SELECT f.doc, f.page_idx, string_agg(trim('b: ' || s.text), chr(10) ORDER BY f.img_idx) AS ocr FROM front f JOIN passages s USING (hash) WHERE len(trim('b: ' || s.text)) >= 5 GROUP BY ALL),
p AS (SELECT 'hibrido-unpdf-img' AS extractor, pg.doc, pg.page_idx, {_behind("o.ocr")} AS text FROM pg LEFT JOIN o USING (doc, page_idx)) {_DOCS}""")
def q_extract_every_image(spark: SparkSession, d: str) -> DataFrame:
    """OCR of each large image behind its page's text."""
    return _digests(spark, d, "hibrido-unpdf-img")


@query(f"""WITH {_BASE}, o AS (SELECT doc, page_idx, string_agg(trim('box ' || hash), chr(10) ORDER BY img_idx) AS ocr FROM front WHERE len(trim('box ' || hash)) >= 5 GROUP BY ALL),
p AS (SELECT 'hibrido-unpdf-bbox' AS extractor, pg.doc, pg.page_idx, {_behind("o.ocr")} AS text FROM pg LEFT JOIN o USING (doc, page_idx)) {_DOCS}""")
def q_extract_boxes(spark: SparkSession, d: str) -> DataFrame:
    """OCR of each image's rectangle behind its page's text."""
    return _digests(spark, d, "hibrido-unpdf-bbox")


_KNOWN = f"list_distinct({duck.split(duck.fold('pg.text'), 2)})"
_SENTENCES = "list_filter(list_transform(string_split_regex(x.ocr, '[.!?\\n\\r]+'), lambda s: trim(s)), lambda s: len(s) > 0)"
_PARTS = duck.split(duck.fold("s"), 2)
_SURE = "trim(array_to_string(list_filter(string_split({0}, ' '), lambda v, i: ((i - 1) * 37) % 101 >= 60 AND len(v) > 0), ' '))"


def _hash_sql(ocr: dict[str, str], clean: bool) -> str:
    """Pages of the hybrids that read each image once, by pipeline the OCR text of a passage s.text."""
    kinds = " UNION ALL ".join(f"SELECT '{name}' AS extractor, s.hash, {text} AS ocr FROM passages s" for name, text in ocr.items())
    kept = f"list_filter({_SENTENCES}, lambda s: len({_PARTS}) > 0 AND CAST(len(list_filter({_PARTS}, lambda v: list_contains(known, v))) AS DOUBLE) / len({_PARTS}) < 0.6)"
    text = f"CASE WHEN len(known) = 0 THEN x.ocr ELSE array_to_string({kept}, ' ') END" if clean else "x.ocr"
    return f"""WITH {_BASE}, k AS ({kinds}),
x AS (SELECT k.extractor, f.doc, f.page_idx, f.img_idx, k.ocr, {_KNOWN} AS known FROM fresh f JOIN k USING (hash) JOIN pg ON pg.doc = f.doc AND pg.page_idx = f.page_idx WHERE len(k.ocr) >= 5),
y AS (SELECT extractor, doc, page_idx, {text} AS ocr FROM x),
p AS (SELECT n.extractor, pg.doc, pg.page_idx, {_behind("o.ocr")} AS text FROM pg CROSS JOIN (SELECT unnest({list(ocr)}) AS extractor) n
  LEFT JOIN (SELECT * FROM y WHERE len(ocr) >= 5) o ON o.extractor = n.extractor AND o.doc = pg.doc AND o.page_idx = pg.page_idx) {_DOCS}"""


_RAW = "trim(array_to_string(list_filter(string_split({0}, ' '), lambda v: len(v) > 0), ' '))"


def _plain(text: str) -> str:
    return _RAW.format(text)


@query(_hash_sql({"hibrido-unpdf-img-hash": _plain("'b: ' || s.text")}, clean=False))
def q_extract_each_image_once(spark: SparkSession, d: str) -> DataFrame:
    """OCR once for each image, on all its pages."""
    return _digests(spark, d, "hibrido-unpdf-img-hash")


_HYBRIDS = {
    "hibrido-unpdf-img-hash-clean": _plain("'b: ' || s.text"), "hibrido-clean-best": _plain("'B: ' || s.text"), "hibrido-clean-prep": _plain("'p: ' || s.text"),
    "hibrido-clean-conf": _SURE.format("'b: ' || s.text"), "hibrido-clean-prep-conf": _SURE.format("'p: ' || s.text"), "hibrido-clean-conf-best": _SURE.format("'B: ' || s.text"),
}


@query(_hash_sql(_HYBRIDS, clean=True))
def q_extract_hybrids(spark: SparkSession, d: str) -> DataFrame:
    """OCR once for each image without what the page says already: by models, preparation and confidence."""
    return _digests(spark, d, *_HYBRIDS)


def _merged(sure: bool) -> str:
    """Both scales of a passage as one text."""
    kind = _SURE if sure else _RAW
    a, b = kind.format("'b: ' || s.text"), kind.format("s.text || ' twice'")
    base, other = f"CASE WHEN len({b}) > len({a}) THEN {b} ELSE {a} END", f"CASE WHEN len({b}) > len({a}) THEN {a} ELSE {b} END"
    more = f"""(SELECT string_agg(w, ' ' ORDER BY pos) FROM (SELECT arg_min(w, pos) AS w, min(pos) AS pos, f FROM (
  SELECT unnest(string_split_regex(m.other, '\\s+')) AS w, unnest(range(len(string_split_regex(m.other, '\\s+')))) AS pos, {duck.fold("w")} AS f) WHERE len(f) >= 2 GROUP BY f)
  WHERE NOT list_contains({duck.split(duck.fold("m.base"), 2)}, f))"""
    return f"(SELECT concat_ws(' ', CASE WHEN len(m.base) > 0 THEN m.base END, {more}) FROM (SELECT {base} AS base, {other} AS other) m)"


@query(_hash_sql({"hibrido-clean-multi": _merged(False), "hibrido-clean-conf-multi": _merged(True)}, clean=True))
def q_extract_scales(spark: SparkSession, d: str) -> DataFrame:
    """OCR at two scales, merged into one text."""
    return _digests(spark, d, "hibrido-clean-multi", "hibrido-clean-conf-multi")


# Files that are written and read back.
_SCORES = ["o_totalprice / 1000.0", "o_totalprice / 700000.0", "o_totalprice / 600000.0", "o_totalprice / 500000.0", "o_totalprice / 400000.0", "o_totalprice / 300000.0"]
_RESULTS = f"""r AS (SELECT 'clerk, ' || o_custkey || ' "' || o_orderstatus || '"' AS pdf, o_orderpriority || ' ' || o_orderkey AS extrator, CAST(o_orderkey % 50 AS INTEGER) AS num_paginas, {duck.places(_SCORES[0], 3)} AS tempo_seg,
  CAST(o_custkey AS INTEGER) AS num_caracteres, {", ".join(f"{duck.places(s)} AS {m}" for m, s in zip(scoreboard.METRICS, _SCORES[1:], strict=True))},
  CASE WHEN o_orderstatus = 'F' THEN 'line one' || chr(10) || '"two", three' ELSE '' END AS erro FROM orders)"""


def _result_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    score = lambda s, n: F.expr(f"floor(({s}) * {10**n}.0D + 0.5D) / {10**n}.0D")
    double = [s.replace(".0", ".0D") for s in _SCORES]
    columns = {
        "pdf": F.concat(F.lit("clerk, "), F.col("o_custkey").cast("string"), F.lit(' "'), "o_orderstatus", F.lit('"')), "extrator": F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")),
        "num_paginas": F.col("o_orderkey") % 50, "tempo_seg": score(double[0], 3), "num_caracteres": F.col("o_custkey"),
        **{m: score(s, 4) for m, s in zip(scoreboard.METRICS, double[1:], strict=True)},
        "erro": F.when(F.col("o_orderstatus") == "F", 'line one\n"two", three').otherwise(""),
    }
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in scoreboard.RESULT.fields])


@query(f"WITH {_RESULTS} SELECT * FROM r")
def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Result rows written as CSV and read again, with quotes, commas and line feeds in fields."""
    path = f"{new_folder(spark)}/benchmark.csv"
    results.write_results(_result_rows(spark, d), path)
    return results.read_results(spark, path)


@query(f"""WITH {_RESULTS}, b AS (SELECT * REPLACE (split_part(extrator, ' ', 1) AS extrator) FROM r)
SELECT extrator, count(*) AS num_rows, count(*) FILTER (erro <> '') AS num_errors, {duck.places("coalesce(avg(tempo_seg) FILTER (erro = ''), 0)", 2)} AS seconds FROM b GROUP BY extrator""")
def q_averages_json(spark: SparkSession, d: str) -> DataFrame:
    """Averages by extractor, as the object of the JSON file, read again."""
    rows = _result_rows(spark, d).withColumn("extrator", F.split("extrator", " ")[0])
    value = results.averages_json(scoreboard.averages(rows, "extrator", ["tempo_seg"], "erro"), "extrator")
    path = f"{new_folder(spark)}/benchmark.json"
    results.write_value(spark, value.first()["value"], path)  # one object with a few entries
    entries = F.from_json("value", "struct<porExtrator:map<string,struct<num_rows:long,num_errors:long,mean_tempo_seg:double>>>")["porExtrator"]
    got = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("extrator", "v"))
    return got.select("extrator", "v.num_rows", "v.num_errors", (F.floor(F.col("v.mean_tempo_seg") * 100.0 + 0.5) / 100.0).alias("seconds"))


@query("SELECT n_name || ' ' || n_nationkey AS doc, 'text of ' || n_name || chr(10) || chr(10) || 'region ' || n_regionkey || chr(10) AS text FROM nation")
def q_gold_files(spark: SparkSession, d: str) -> DataFrame:
    """One text file for each document, read again with its name."""
    rows = table(spark, d, "nation").select(F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")).alias("doc"), F.concat(F.lit("text of "), "n_name", F.lit(PAGE_BREAK + "region "), F.col("n_regionkey").cast("string")).alias("text"))
    path = new_folder(spark)
    results.write_texts(rows, path)
    return results.scan_gold(spark, path)


@query(f"""SELECT c_name AS doc, CAST(c_nationkey + 1 AS INTEGER) AS pages, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 * c_custkey ELSE c_custkey END AS BIGINT) AS tokens_in,
{duck.places("(CASE WHEN c_custkey % 3 = 0 THEN 2 * c_custkey ELSE c_custkey END * 3.0 + c_nationkey * 15.0) / 1000000.0")} AS cost FROM customer""")
def q_gold_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Gold metadata saved, then saved again for a third of the documents, and read."""
    path = f"{new_folder(spark)}/metadata.json"
    rows = table(spark, d, "customer")
    for factor, some in ((1, rows), (2, rows.filter("c_custkey % 3 = 0"))):
        tokens = (F.col("c_custkey") * factor).cast("long")
        new = some.select(F.col("c_name").alias("doc"), (F.col("c_nationkey") + 1).cast("int").alias("numPaginas"), tokens.alias("tokensInput"), gold.cost(tokens.cast("double"), F.col("c_nationkey").cast("double")).alias("custoUsd"))
        results.save_gold_metadata(spark, new, path)
    got = results.gold_metadata(spark, path)
    return got.select("doc", F.col("numPaginas").alias("pages"), F.col("tokensInput").alias("tokens_in"), F.col("custoUsd").alias("cost"))


@query("SELECT s_name AS doc_name, 'aula' AS tipo, CAST(s_nationkey AS VARCHAR) AS area, s_acctbal > 0 AS with_images FROM supplier")
def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of documents, written as objects of bounded size and read as rows."""
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("doc_name"), F.lit("aula").alias("tipo"), F.col("s_nationkey").cast("string").alias("area"), (F.col("s_acctbal") > 0).alias("temImagens"))
    path = f"{new_folder(spark)}/manifest"
    results.write_manifest(rows, path)
    return results.read_manifest(spark, path, lines=True).select("doc_name", "tipo", "area", F.col("temImagens").alias("with_images"))


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END || ' ' || c_mktsegment AS pdf, c_nationkey FROM customer),
a AS (SELECT pdf, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS extrator, CASE WHEN c_nationkey < 5 THEN 'new' ELSE 'old' END AS origin FROM k)
SELECT pdf, extrator, origin, row_number() OVER (ORDER BY lower(pdf), extrator) AS place FROM a""")
def q_global_order(spark: SparkSession, d: str) -> DataFrame:
    """A filtered run merged into older rows, with the place of each row in the order of the report."""
    name = F.concat_ws(" ", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")), "c_mktsegment")
    rows = table(spark, d, "customer").select(name.alias("pdf"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("extrator"))
    old, new = rows.withColumn("origin", F.lit("old")), rows.filter("extrator < '05'").withColumn("origin", F.lit("new"))
    return scoreboard.in_places(scoreboard.upsert(old, new, scoreboard.KEY), scoreboard.collated(), f"{new_folder(spark)}/places")


@query("""WITH u AS (SELECT event_id, user_id, event_type, value, event_id % 3 AS batch FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch DESC, event_id DESC) AS turn FROM u)
SELECT user_id, event_type, event_id, value FROM r WHERE turn = 1""")
def q_incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of events put one after another into a table in buckets; the last event of each user and type."""
    kept = KeyedTable(spark, f"{new_folder(spark)}/upserts", ["user_id", "event_type"], 16)
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    for batch in range(3):
        kept.upsert(events.filter(F.col("event_id") % 3 == batch), "event_id")
        kept.vacuum()
    return kept.read()


@query("""WITH k AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS pdf, n_regionkey FROM nation),
a AS (SELECT pdf, CAST(n_regionkey AS VARCHAR) AS extrator, CASE WHEN n_regionkey < 2 THEN 'new' ELSE 'old' END AS origin FROM k)
SELECT pdf, extrator, origin, row_number() OVER (ORDER BY lower(pdf), extrator) AS place FROM a""")
def q_merged_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A filtered run merged into older rows; letters of either case stand together in the order of rows."""
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    rows = table(spark, d, "nation").select(name.alias("pdf"), F.col("n_regionkey").cast("string").alias("extrator"))
    old, new = rows.withColumn("origin", F.lit("old")), rows.filter("extrator < '2'").withColumn("origin", F.lit("new"))
    return scoreboard.in_places(scoreboard.merge_run(old, new, True), scoreboard.collated(), f"{new_folder(spark)}/places")
