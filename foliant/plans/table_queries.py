"""Queries over result rows, images, geometry and gold calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import textnorm as n
from foliant.operators import blocks, geometry, gold, images, pages, scoreboard
from foliant.plans import duck
from foliant.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') AND contains(lower(p_type), 'e')")
def q_substring_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(scoreboard.contains(F.col("p_name"), "AN") & scoreboard.contains(F.col("p_type"), "E")).select("p_partkey", "p_name")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q_gold_lookup(spark: SparkSession, d: str) -> DataFrame:
    return scoreboard.with_gold(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_without_gold(spark: SparkSession, d: str) -> DataFrame:
    return scoreboard.without_gold(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT user_id, event_type, -count(*) AS n FROM events WHERE event_type IN (SELECT min(event_type) FROM events) GROUP BY ALL)
SELECT * FROM w UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = o.user_id AND w.event_type = o.event_type)""")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Counts by user and type, those of the first type replaced by a new run."""
    events = table(spark, d, "events")
    old = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    first = events.agg(F.min("event_type").alias("event_type"))
    new = events.join(first, "event_type", "left_semi").groupBy("user_id", "event_type").agg((-F.count("*")).alias("n"))
    return scoreboard.upsert(old, new, ["user_id", "event_type"])


@query("""SELECT count(*) AS preserved FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE event_type <> (SELECT min(event_type) FROM events)""")
def q_preserved(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "events").select("user_id", "event_type").distinct()
    new = keys.join(keys.agg(F.min("event_type").alias("event_type")), "event_type", "left_semi")
    return scoreboard.preserved(keys, new, ["user_id", "event_type"])


_RESULTS = "r AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS cents, CASE WHEN value IS NULL OR value < 5 THEN 'low' ELSE '' END AS error FROM events)"
_AVERAGE = duck.places("CAST(sum(cents) FILTER (error = '') AS DOUBLE) / count(*) FILTER (error = '')")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Events as result rows: the type as extractor, low values as errors."""
    value = F.col("value")
    return table(spark, d, "events").select("event_type", F.floor(value * 100).alias("cents"), F.when(value.isNull() | (value < 5), "low").otherwise("").alias("error"))


@query(f"WITH {_RESULTS} SELECT event_type, count(*) AS num_rows, count(*) FILTER (error <> '') AS num_errors, coalesce({_AVERAGE}, 0.0) AS mean_cents FROM r GROUP BY event_type")
def q_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return scoreboard.averages(_results(spark, d), "event_type", ["cents"], "error")


@query(f"""WITH {_RESULTS}, a AS (SELECT event_type, count(*) AS num_rows, count(*) FILTER (error <> '') AS num_errors, {_AVERAGE} AS mean_cents FROM r GROUP BY event_type),
names AS (SELECT min(event_type) AS event_type FROM events UNION ALL SELECT 'never-run')
SELECT event_type, coalesce(num_rows, 0) AS num_rows, coalesce(num_errors, 0) AS num_errors, coalesce(mean_cents, 0.0) AS mean_cents FROM names LEFT JOIN a USING (event_type)""")
def q_scoreboard_registry(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d)
    registry = rows.agg(F.min("event_type").alias("event_type")).unionByName(spark.createDataFrame([("never-run",)], "event_type string"))
    return scoreboard.averages(rows, "event_type", ["cents"], "error", registry)


@query(f"""WITH {_RESULTS}, a AS (SELECT event_type, count(*) AS n, coalesce({_AVERAGE}, 0.0) AS m FROM r GROUP BY event_type)
SELECT event_type, rpad(event_type, 32, ' ') || lpad(printf('%.4f', m), 12, ' ') || ' ' || lpad(printf('%.3f', CAST(n AS DOUBLE)), 12, ' ') || 's' AS line FROM a""")
def q_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = scoreboard.averages(_results(spark, d), "event_type", ["cents"], "error")
    return rows.select("event_type", scoreboard.summary_line(F.col("event_type"), F.col("mean_cents"), F.col("num_rows").cast("double")).alias("line"))


def _placements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as image placements: the supplier as document, twelve pages each."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 12).alias("page_idx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("img_idx"),
        (100 + 25 * (F.col("l_quantity").cast("long") % 20)).cast("int").alias("width"), (200 + 40 * (F.col("l_partkey") % 5)).cast("int").alias("height"), (F.col("l_partkey") % 40).alias("hash"),
    )
    return rows, rows.select("doc").distinct().withColumn("num_pages", F.lit(12))


_BG_SIZE = f"""{duck.IMAGES}, sz AS (SELECT doc, width, height, count(DISTINCT page_idx) AS pages, min(struct_pack(a := page_idx, b := img_idx)) AS first FROM images GROUP BY doc, width, height),
bg AS (SELECT doc, width, height, pages FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pages DESC, first) AS r FROM sz) JOIN counts USING (doc) WHERE r = 1 AND CAST(pages AS DOUBLE) / num_pages >= 0.5)"""


@query(f"WITH {_BG_SIZE} SELECT doc, width, height, pages FROM bg")
def q_bg_size(spark: SparkSession, d: str) -> DataFrame:
    return images.background_by_size(*_placements(spark, d))


_BG_HASH = f"{duck.IMAGES}, bh AS (SELECT doc, hash, count(DISTINCT page_idx) AS pages FROM images JOIN counts USING (doc) GROUP BY doc, hash, num_pages HAVING count(DISTINCT page_idx) >= 0.5 * num_pages)"


@query(f"WITH {_BG_HASH} SELECT doc, hash, pages FROM bh")
def q_bg_hash(spark: SparkSession, d: str) -> DataFrame:
    return images.background_by_hash(*_placements(spark, d))


_TARGETS = f"""{_BG_HASH}, use AS (SELECT i.* FROM images i WHERE CAST(width AS BIGINT) * height >= 100000 AND NOT EXISTS (SELECT 1 FROM bh WHERE bh.doc = i.doc AND bh.hash = i.hash)),
tg AS (SELECT doc, hash, list(page_idx ORDER BY page_idx, img_idx) AS pages, min(struct_pack(a := page_idx, b := img_idx)) AS first FROM use GROUP BY doc, hash)"""


@query(f"WITH {_TARGETS} SELECT doc, hash, array_to_string(pages, ',') AS pages, first.a AS first_page, first.b AS first_image FROM tg")
def q_ocr_targets(spark: SparkSession, d: str) -> DataFrame:
    rows, counts = _placements(spark, d)
    found = images.targets(rows, images.background_by_hash(rows, counts))
    return found.select("doc", "hash", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.col("first.page_idx").alias("first_page"), F.col("first.img_idx").alias("first_image"))


@query(f"""WITH {_TARGETS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first) AS turn FROM tg),
x AS (SELECT doc, unnest(pages) AS page_idx, unnest(range(len(pages))) AS copy, turn, 'image ' || hash AS text FROM t),
j AS (SELECT doc, page_idx, string_agg(text, chr(10) ORDER BY turn, copy) AS parts FROM x GROUP BY doc, page_idx),
p AS (SELECT doc, unnest(range(12)) AS page_idx FROM counts)
SELECT doc, page_idx, sha256(CASE WHEN parts IS NULL THEN 'page ' || page_idx ELSE 'page ' || page_idx || chr(10) || parts END) AS digest FROM p LEFT JOIN j USING (doc, page_idx)""")
def q_ocr_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Each target's text on all its pages, behind the pages' own."""
    rows, counts = _placements(spark, d)
    found = images.targets(rows, images.background_by_hash(rows, counts))
    text = rows.select("hash").distinct().withColumn("text", F.concat(F.lit("image "), F.col("hash").cast("string")))
    own = pages.pad_pages(rows.select("doc", "page_idx", F.lit("").alias("text")).limit(0), counts).withColumn("text", F.concat(F.lit("page "), F.col("page_idx").cast("string")))
    return images.append(own, images.fan_out(found, text)).select("doc", "page_idx", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_BG_SIZE}, lg AS (SELECT i.doc, page_idx, bool_or(bg.doc IS NULL) AS front FROM images i LEFT JOIN bg ON i.doc = bg.doc AND i.width = bg.width AND i.height = bg.height
  WHERE CAST(i.width AS BIGINT) * i.height >= 100000 GROUP BY i.doc, page_idx),
p AS (SELECT doc, unnest(range(12)) AS page_idx FROM counts)
SELECT p.doc, p.page_idx FROM p JOIN lg USING (doc, page_idx) WHERE front OR (p.doc * 37 + p.page_idx * 11) % 400 < 200""")
def q_gate_size(spark: SparkSession, d: str) -> DataFrame:
    """Pages that need OCR for an image in front of the background, or for too little text."""
    rows, counts = _placements(spark, d)
    own = pages.pad_pages(rows.select("doc", "page_idx", F.lit("").alias("text")).limit(0), counts)
    own = own.withColumn("text", F.repeat(F.lit("x"), ((F.col("doc") * 37 + F.col("page_idx") * 11) % 400).cast("int")))
    return images.needs_ocr(own, rows, images.background_by_size(rows, counts)).select("doc", "page_idx")


@query(f"""WITH {duck.IMAGES}, a AS (SELECT doc, page_idx, sum(CAST(width AS BIGINT) * height) AS area FROM images GROUP BY doc, page_idx),
p AS (SELECT doc, unnest(range(12)) AS page_idx FROM counts), r AS (SELECT doc, page_idx, coalesce(area, 0) / 4000000.0 AS r, (doc * 37 + page_idx * 11) % 1000 AS n FROM p LEFT JOIN a USING (doc, page_idx))
SELECT doc, page_idx, {duck.places("CAST(r AS DOUBLE)")} AS area_ratio FROM r WHERE r >= 0.3 AND n < 500""")
def q_gate_area(spark: SparkSession, d: str) -> DataFrame:
    """Pages that images fill and that hold little text."""
    rows, counts = _placements(spark, d)
    sizes = counts.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("page_idx")).withColumns({"width": F.lit(2000.0), "height": F.lit(2000.0)})
    areas = geometry.area_ratio(rows.select("doc", "page_idx", F.lit("image").alias("type"), F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h")), sizes)
    text = F.repeat(F.lit("x"), ((F.col("doc") * 37 + F.col("page_idx") * 11) % 1000).cast("int"))
    return areas.withColumn("text", text).filter(pages.dense_area(F.col("text"), F.col("area_ratio"))).select("doc", "page_idx", n.places(F.col("area_ratio"), 4).alias("area_ratio"))


def _box(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_partkey").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (p % 300).alias("x"), (p % 700).alias("y"), q.alias("w"), (q * 2).alias("h"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, CAST(floor((l_partkey % 300 - 10) * 2 + 0.5) AS BIGINT) - 4) AS "left",
  greatest(0, CAST(floor((800 - l_partkey % 700 - 2 * l_quantity) * 2 + 0.5) AS BIGINT) - 4) AS top,
  CAST(floor(l_quantity * 2 + 0.5) AS BIGINT) + 8 AS width, CAST(floor(l_quantity * 4 + 0.5) AS BIGINT) + 8 AS height FROM lineitem""")
def q_rect_map(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in page space as pixel rectangles."""
    c = geometry.canvas_rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(10.0), F.lit(800.0))
    return _box(spark, d).select("l_orderkey", "l_linenumber", *[v.cast("long").alias(k) for k, v in c.items()])


_CTM = "a AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 300 AS DOUBLE) AS x, CAST(l_partkey % 700 AS DOUBLE) AS y, l_quantity AS w, 2 * l_quantity AS h FROM lineitem)"


@query(f"""WITH {_CTM} SELECT l_orderkey, l_linenumber, 2 * x + 3.0 AS x, 2 * y - 2 * h + 5.0 AS y, 2 * w AS w, 2 * h AS h, CAST(2 AS BIGINT) AS n_images, 0.0 AS last_x, 1.0 AS last_w FROM a""")
def q_ctm_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Two images of an operator list: one under two transforms that flip it, one after a restore too many."""
    zero, one, two = F.lit(0.0), F.lit(1.0), F.lit(2.0)
    nothing = F.lit(None).cast("array<double>")

    def op(kind, m=nothing):
        return F.struct(F.lit(kind).alias("op"), m.alias("m"), F.lit(7).alias("width"), F.lit(None).cast("int").alias("height"))

    ops = F.array(
        op("save"), op("transform", F.array(two, zero, zero, two, F.lit(3.0), F.lit(5.0))), op("transform", F.array(F.col("w"), zero, zero, -F.col("h"), F.col("x"), F.col("y"))),
        op("image"), op("restore"), op("transform", F.array(F.lit(9.0), one, one, F.lit(9.0), one, one)), op("restore"), op("inline_image"),
    )
    rows = _box(spark, d).select("l_orderkey", "l_linenumber", geometry.image_boxes(ops).alias("o"))
    first, last = F.col("o")[0], F.col("o")[1]
    return rows.select("l_orderkey", "l_linenumber", first["x"].alias("x"), first["y"].alias("y"), first["w"].alias("w"), first["h"].alias("h"), F.size("o").cast("long").alias("n_images"), last["x"].alias("last_x"), last["w"].alias("last_w"))


@query("""WITH i AS (SELECT l_suppkey AS doc, l_orderkey % 12 AS page_idx, l_orderkey * 10 + l_linenumber AS item_idx, 'w' || l_partkey AS s, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST((l_orderkey * 7) % 800 AS DOUBLE) AS y FROM lineitem),
l AS (SELECT *, CASE WHEN lag(y) OVER p - y > 2 THEN 1 ELSE 0 END AS new FROM i WINDOW p AS (PARTITION BY doc, page_idx ORDER BY y DESC, x, item_idx)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc, page_idx ORDER BY y DESC, x, item_idx ROWS UNBOUNDED PRECEDING) AS line FROM l),
t AS (SELECT doc, page_idx, line, string_agg(s, ' ' ORDER BY x, item_idx) AS t FROM n GROUP BY doc, page_idx, line)
SELECT doc, page_idx, sha256(string_agg(t, chr(10) ORDER BY line)) AS digest, count(*) AS num_lines FROM t GROUP BY doc, page_idx""")
def q_line_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Page text from positioned items."""
    items = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 12).alias("page_idx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_idx"),
        F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("str"), (F.col("l_partkey") % 500).cast("double").alias("x"), ((F.col("l_orderkey") * 7) % 800).cast("double").alias("y"),
    )
    return pages.lines_of_items(items).select("doc", "page_idx", F.sha2("text", 256).alias("digest"), "num_lines")


@query("""WITH b AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'title' WHEN 'view' THEN 'paragraph' ELSE event_type END AS type, event_id % 7 - 1 AS page_idx, user_id % 9 AS level, value AS seen FROM events)
SELECT event_id, array_to_string(list_filter([
  CASE WHEN type IS NULL OR type NOT IN ('title', 'paragraph') THEN 'type' END, CASE WHEN page_idx < 0 THEN 'page_idx' END,
  CASE WHEN level NOT BETWEEN 1 AND 6 THEN 'level' END, CASE WHEN seen IS NOT NULL AND NOT (seen BETWEEN 0 AND 100) THEN 'ocr_confidence' END], lambda x: x IS NOT NULL), ',') AS broken FROM b""")
def q_block_validation(spark: SparkSession, d: str) -> DataFrame:
    """Events as blocks, and the rules that they break."""
    kind = F.when(F.col("event_type") == "click", "title").when(F.col("event_type") == "view", "paragraph").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(
        "event_id", kind.alias("type"), F.lit("").alias("text"), (F.col("event_id") % 7 - 1).alias("page_idx"), (F.col("user_id") % 9).alias("level"),
        F.lit(None).cast("array<double>").alias("bbox"), F.col("value").alias("ocr_confidence"),
    )
    return rows.select("event_id", F.array_join(blocks.violations(["title", "paragraph"]), ",").alias("broken"))


@query("""WITH RECURSIVE t(doc, first, last, depth) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST(max(turn) + 1 AS BIGINT), 0 FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT doc, CASE k WHEN 0 THEN first ELSE first + (last - first) // 2 END, CASE k WHEN 0 THEN first + (last - first) // 2 ELSE last END, depth + 1
  FROM t, (SELECT unnest([0, 1]) AS k) WHERE last - first > 1 AND depth < 6)
SELECT doc, first, last, depth FROM t""")
def q_bisection_tree(spark: SparkSession, d: str) -> DataFrame:
    """All page ranges of conversations as documents, split down to single pages."""
    counts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg((F.max("turn") + 1).alias("num_pages"))
    return gold.bisection_trees(counts).select("doc", F.col("start").alias("first"), F.col("end").alias("last"), "depth")


_CALLS = """c AS (SELECT o_orderkey, o_custkey * 7 AS tokens_in, CAST(floor(o_totalprice / 300) AS BIGINT) AS tokens_out, CASE o_orderstatus WHEN 'O' THEN 'end_turn' WHEN 'F' THEN 'max_tokens' ELSE NULL END AS stop FROM orders)"""


@query(f"""WITH {_CALLS} SELECT o_orderkey, {duck.places("(tokens_in * 3.0 + tokens_out * 15.0) / 1e6")} AS cost_usd,
  coalesce(stop = 'end_turn' AND tokens_in >= 10000 AND tokens_out < 500, false) AS refused FROM c""")
def q_refusal_cost(spark: SparkSession, d: str) -> DataFrame:
    """Orders as model calls: cost and refusal."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 7).alias("i"), F.floor(F.col("o_totalprice") / 300).alias("o"), F.when(F.col("o_orderstatus") == "O", "end_turn").when(F.col("o_orderstatus") == "F", "max_tokens").alias("s"))
    return rows.select("o_orderkey", gold.cost(F.col("i"), F.col("o")).alias("cost_usd"), gold.refused(F.col("s"), F.col("i"), F.col("o")).alias("refused"))


@query("""SELECT custkey, calls, cost FROM (SELECT o_custkey AS custkey, count(*) AS calls, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS cost FROM orders
WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND (c_acctbal < 0 OR c_mktsegment = 'BUILDING')) GROUP BY o_custkey)""")
def q_run_cost(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the successful calls of documents that are still to do."""
    calls = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("doc"), F.floor("o_totalprice").alias("cost"))
    customers = table(spark, d, "customer")
    refused, texts = customers.select(F.col("c_custkey").alias("doc"), (F.col("c_acctbal") < 0).alias("refused")), customers.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc"))
    todo = gold.to_do(calls, texts, refused)
    return todo.groupBy(F.col("doc").alias("custkey")).agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


@query("""SELECT customer.c_custkey AS doc, sha256('{"segment":"' || c_mktsegment || '","orders":' || coalesce(n, 0) || '}') AS digest FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def q_json_objects(spark: SparkSession, d: str) -> DataFrame:
    """Keyed JSON objects as the metadata sink writes them."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("orders"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("segment")).join(counts, "doc", "left").fillna(0, ["orders"])
    return rows.select("doc", F.sha2(F.to_json(F.struct("segment", "orders")), 256).alias("digest"))


@query("""SELECT c_nationkey, c_name, c_custkey, row_number() OVER (ORDER BY c_nationkey, c_name, c_custkey) AS place FROM customer""")
def q_sorted_results(spark: SparkSession, d: str) -> DataFrame:
    """The two-key sort of the scoreboard; places by ranges of the first key, not in one partition."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_name", "c_custkey")
    from pyspark.sql.window import Window

    before = rows.groupBy("c_nationkey").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("c_nationkey")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey"))
    return rows.withColumn("_p", place).join(before.select("c_nationkey", "_before"), "c_nationkey").select("c_nationkey", "c_name", "c_custkey", (F.col("_p") + F.col("_before")).alias("place"))


@query("""SELECT event_type, count(*) AS n, date_trunc('hour', ts) AS start FROM events GROUP BY ALL""")
def q_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts, as the streaming form gives them once all rows are in."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", "n", F.col("w.start").alias("start"))
