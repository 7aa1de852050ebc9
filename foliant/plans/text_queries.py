"""Queries over texts: normalization, metrics, pages, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import metrics as m
from foliant.functions import textnorm as n
from foliant.operators import blocks, images, pages
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


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn (gold) with the assistant turn after it (extracted)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").withColumns({"extracted": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("gold"), "extracted")


def turn_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_idx"), "text")


def long(c) -> F.Column:
    return c.cast("long")


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {duck.words('text')} AS t FROM documents)")
def q_norm_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words and distinct words of every document."""
    rows = table(spark, d, "documents").select("doc_id", n.words(F.col("text")).alias("t"))
    return rows.select("doc_id", long(F.size("t")).alias("n_words"), long(F.size(F.array_distinct("t"))).alias("n_distinct"))


@query(f"SELECT doc_id, sha256({duck.norm('text')}) AS digest, CAST(len({duck.norm('text')}) AS BIGINT) AS n_chars FROM documents")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", n.normalize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("digest"), long(F.length("t")).alias("n_chars"))


@query(f"SELECT item_id, CAST(len({duck.bigrams('t')}) AS BIGINT) AS n_bigrams FROM (SELECT item_id, {duck.norm('text')} AS t FROM benchmark)")
def q_bigram_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", long(F.size(n.bigrams(n.normalize(F.col("text"))))).alias("n_bigrams"))


_SHARED = f"""
WITH d AS (SELECT doc_id, unnest(list_distinct({duck.words("text")})) AS w FROM documents),
b AS (SELECT item_id, list_distinct({duck.words("text")}) AS g FROM benchmark),
g AS (SELECT item_id, CAST(len(g) AS BIGINT) AS gold_words, unnest(g) AS w FROM b),
s AS (SELECT item_id, doc_id, count(*) AS shared, min(gold_words) AS gold_words FROM d JOIN g USING (w) GROUP BY ALL)
"""


@query(f"{_SHARED} SELECT item_id, doc_id, shared, gold_words, {duck.places('CAST(shared AS DOUBLE) / gold_words')} AS coverage FROM s")
def q_coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each passage by each document that shares a word with it."""
    pairs = m.shared_words(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    return pairs.withColumn("coverage", n.places(F.col("shared") / F.col("gold_words"), 4))


@query(f"""{_SHARED} SELECT item_id, doc_id, shared, gold_words, {duck.places("CAST(shared AS DOUBLE) / gold_words")} AS coverage
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS r FROM s) WHERE r = 1""")
def q_best_doc_per_item(spark: SparkSession, d: str) -> DataFrame:
    """For each passage, the document that covers it best; ties go to the smaller id."""
    pairs = m.shared_words(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    best = pairs.groupBy("item_id").agg(F.max(F.struct("shared", (-F.col("doc_id")).alias("d"), "gold_words")).alias("b"))
    return best.select("item_id", (-F.col("b.d")).alias("doc_id"), "b.shared", "b.gold_words", n.places(F.col("b.shared") / F.col("b.gold_words"), 4).alias("coverage"))


def _pair_query(column: str, expression: str):
    return f"WITH {duck.PAIRS}, t AS (SELECT conv_id, turn, extracted, gold, {duck.norm('extracted')} AS a, {duck.norm('gold')} AS b FROM pairs) SELECT conv_id, turn, {duck.places(expression)} AS {column} FROM t"


@query(_pair_query("sim_bi", duck.jaccard(f"({duck.bigrams('a')})", f"({duck.bigrams('b')})")))
def q_bigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = turn_pairs(spark, d).select("conv_id", "turn", n.bigrams(n.normalize(F.col("extracted"))).alias("a"), n.bigrams(n.normalize(F.col("gold"))).alias("b"))
    return rows.select("conv_id", "turn", n.places(m.jaccard(F.col("a"), F.col("b")), 4).alias("sim_bi"))


@query(_pair_query("sim_lev", duck.edit_similarity("a", "b")))
def q_edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = turn_pairs(spark, d).select("conv_id", "turn", n.normalize(F.col("extracted")).alias("a"), n.normalize(F.col("gold")).alias("b"))
    return rows.select("conv_id", "turn", n.places(m.edit_similarity(F.col("a"), F.col("b")), 4).alias("sim_lev"))


@query(_pair_query("rel_len", "CASE WHEN len(b) = 0 THEN 0.0 ELSE CAST(len(a) AS DOUBLE) / len(b) END"))
def q_relative_length(spark: SparkSession, d: str) -> DataFrame:
    rows = turn_pairs(spark, d)
    return rows.select("conv_id", "turn", n.places(m.relative_length(n.normalize(F.col("extracted")), n.normalize(F.col("gold"))), 4).alias("rel_len"))


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) > 0)) AS w FROM documents)
SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER ({duck.valid_word("w")}) AS BIGINT) AS n_valid FROM w GROUP BY doc_id""")
def q_word_validity(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document that look like words of a language."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(m.spelled_words(F.col("text"))).alias("w"))
    rows = rows.select("doc_id", "w", m.folded_word(F.col("w")).alias("f"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(m.valid_word(F.col("w"), F.col("f"))).alias("n_valid"))


_SURPLUS = f"""
e AS (SELECT conv_id, turn, gold, list_filter(string_split_regex(extracted, '[^\\p{{L}}\\p{{N}}]+'), lambda w: len(w) > 0) AS ws FROM pairs),
x AS (SELECT conv_id, turn, gold, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM e),
f AS (SELECT conv_id, turn, any_value(gold) AS gold, {duck.fold("w")} AS f, arg_min(w, pos) AS w FROM x GROUP BY conv_id, turn, f),
u AS (SELECT * FROM f WHERE len(f) > 0 AND NOT list_contains({duck.words("gold")}, f)),
q AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER ({duck.valid_word("w")}) AS v FROM u GROUP BY conv_id, turn),
s AS (SELECT p.conv_id, p.turn, coalesce(q.n, 0) AS n_surplus, {duck.places("CASE WHEN coalesce(q.n, 0) = 0 THEN 1.0 ELSE CAST(q.v AS DOUBLE) / q.n END")} AS excess_q FROM pairs p LEFT JOIN q USING (conv_id, turn))"""


@query(f"WITH {duck.PAIRS}, {_SURPLUS} SELECT conv_id, turn, CAST(n_surplus AS BIGINT) AS n_surplus, excess_q FROM s")
def q_surplus_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = turn_pairs(spark, d).select("conv_id", "turn", m.spelled_words(F.col("extracted")).alias("s"), n.distinct_words(F.col("gold")).alias("g"))
    rows = rows.select("conv_id", "turn", m.surplus_pairs(F.col("s"), F.col("g")).alias("u"))
    return rows.select("conv_id", "turn", long(F.size("u")).alias("n_surplus"), n.places(m.pairs_quality(F.col("u")), 4).alias("excess_q"))


@query(f"""WITH {duck.PAIRS}, {_SURPLUS},
t AS (SELECT conv_id, turn, {duck.norm("extracted")} AS a, {duck.norm("gold")} AS b, list_distinct({duck.words("extracted")}) AS wa, list_distinct({duck.words("gold")}) AS wb FROM pairs)
SELECT conv_id, turn, {duck.places(duck.edit_similarity("a", "b"))} AS sim_lev,
  {duck.places(f"CASE WHEN len(wb) = 0 THEN CASE WHEN len(wa) = 0 THEN 1.0 ELSE 0.0 END ELSE CAST({duck.common('wa', 'wb')} AS DOUBLE) / len(wb) END")} AS cov,
  {duck.places(duck.jaccard(f"({duck.bigrams('a')})", f"({duck.bigrams('b')})"))} AS sim_bi,
  {duck.places("CASE WHEN len(b) = 0 THEN 0.0 ELSE CAST(len(a) AS DOUBLE) / len(b) END")} AS rel_len, excess_q
FROM t JOIN s USING (conv_id, turn)""")
def q_metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All five metrics of each pair of turns."""
    names = ["sim_lev", "cov", "sim_bi", "rel_len", "excess_q"]
    return m.with_metrics(turn_pairs(spark, d), "extracted", "gold").select("conv_id", "turn", *[n.places(F.col(c), 4).alias(c) for c in names])


@query("SELECT conv_id AS doc, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS num_pages FROM conversations GROUP BY conv_id")
def q_page_join(spark: SparkSession, d: str) -> DataFrame:
    return pages.join_pages(turn_pages(spark, d)).select("doc", "text", "num_pages")


@query(f"""WITH {duck.PAGES}, c AS (SELECT doc, max(page_idx) + 2 AS num_pages FROM pages_ GROUP BY doc),
a AS (SELECT doc, unnest(range(num_pages)) AS page_idx FROM c)
SELECT a.doc, a.page_idx, coalesce(p.text, '') AS text FROM a LEFT JOIN pages_ p USING (doc, page_idx)""")
def q_page_pad(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every conversation, with a missing one at its end."""
    rows = turn_pages(spark, d)
    return pages.pad_pages(rows, rows.groupBy("doc").agg((F.max("page_idx") + 2).alias("num_pages")))


@query(r"SELECT doc_id, CAST(len(string_split_regex(text, '\f|\n{2,}')) AS BIGINT) AS n_pages FROM documents")
def q_form_feed_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", long(F.size(pages.split_form_feeds(F.col("text")))).alias("n_pages"))


@query(r"""WITH t AS (SELECT conv_id, string_agg(text || chr(10) || repeat('-', 16) || 'Page (' || turn || ') Break' || repeat('-', 16) || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, list_filter(string_split_regex(text, '-{16}Page \(\d+\) Break-{16}'), lambda p: len(trim(p)) > 0) AS p FROM t)
SELECT conv_id, CAST(len(p) AS BIGINT) AS n_pages, sha256(array_to_string(p, '|')) AS digest FROM s""")
def q_break_line_pages(spark: SparkSession, d: str) -> DataFrame:
    """Raw text with break lines between pages, split at them."""
    line = F.concat(F.col("text"), F.lit("\n" + "-" * 16 + "Page ("), F.col("page_idx").cast("string"), F.lit(") Break" + "-" * 16 + "\n"))
    rows = turn_pages(spark, d).groupBy("doc").agg(F.array_join(pages.ordered(line, F.col("page_idx")), "").alias("text"))
    rows = rows.select(F.col("doc").alias("conv_id"), pages.split_break_lines(F.col("text")).alias("p"))
    return rows.select("conv_id", long(F.size("p")).alias("n_pages"), F.sha2(F.array_join("p", "|"), 256).alias("digest"))


@query(f"WITH {duck.PAGES} SELECT doc, page_idx, CAST(len(text) AS BIGINT) AS n_chars FROM pages_ WHERE len(text) < 100")
def q_poor_pages(spark: SparkSession, d: str) -> DataFrame:
    return turn_pages(spark, d).filter(pages.poor(F.col("text"))).select("doc", "page_idx", long(F.length("text")).alias("n_chars"))


@query(f"""WITH {duck.PAGES}, g AS (SELECT conv_id AS doc, sum(len(text)) + 2 * (count(*) - 1) AS gold_chars FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT doc, count(*) AS num_pages, sum(len(text) + 2) AS chars, sum(len(text)) AS n, min(len(text)) AS lo, max(len(text)) AS hi,
      list_sort(list(page_idx + 1) FILTER (len(text) < 100)) AS few FROM pages_ GROUP BY doc)
SELECT doc, num_pages, CAST(chars AS BIGINT) AS chars, CAST(floor(CAST(n AS DOUBLE) / num_pages + 0.5) AS BIGINT) AS chars_mean, CAST(lo AS BIGINT) AS chars_min, CAST(hi AS BIGINT) AS chars_max,
  coalesce(array_to_string(few, ','), '') AS few_text_pages, CAST(gold_chars AS BIGINT) AS gold_chars,
  {duck.places("CAST(chars AS DOUBLE) / gold_chars")} AS gold_ratio, CASE WHEN gold_chars IS NOT NULL THEN {duck.places("least(1.0, greatest(0.0, 1 - CAST(chars AS DOUBLE) / gold_chars))")} END AS image_share
FROM p LEFT JOIN g USING (doc)""")
def q_xray(spark: SparkSession, d: str) -> DataFrame:
    """A profile of each conversation, its assistant turns as gold."""
    gold = pages.join_pages(table(spark, d, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_idx"), "text"))
    out = pages.profile(turn_pages(spark, d), gold=gold.select("doc", "text"))
    return out.select(
        "doc", "num_pages", long(F.col("chars")).alias("chars"), "chars_mean", "chars_min", "chars_max", F.array_join("few_text_pages", ",").alias("few_text_pages"),
        F.col("with_gold.gold_chars").alias("gold_chars"), F.col("with_gold.ratio").alias("gold_ratio"), F.col("with_gold.image_share").alias("image_share"),
    )


@query(f"""WITH {duck.PAIRS}, t AS (SELECT conv_id, turn, extracted, list_distinct({duck.split(duck.fold("gold"), 2)}) AS known,
  list_filter(list_transform(string_split_regex(extracted, '[.!?\\n\\r]+'), lambda s: trim(s)), lambda s: len(s) > 0) AS ss FROM pairs),
x AS (SELECT *, list_filter(ss, lambda s: len({duck.split(duck.fold("s"), 2)}) > 0 AND
  CAST(len(list_filter({duck.split(duck.fold("s"), 2)}, lambda v: list_contains(known, v))) AS DOUBLE) / len({duck.split(duck.fold("s"), 2)}) < 0.6) AS kept FROM t)
SELECT conv_id, turn, CASE WHEN len(known) = 0 THEN extracted ELSE array_to_string(kept, ' ') END AS cleaned FROM x""")
def q_overlap_clean(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns without sentences that the user turn holds."""
    return turn_pairs(spark, d).select("conv_id", "turn", images.clean_overlap(F.col("extracted"), F.col("gold")).alias("cleaned"))


@query(f"""WITH {duck.PAIRS}, t AS (SELECT conv_id, turn, CASE WHEN len(extracted) > len(gold) THEN extracted ELSE gold END AS base, CASE WHEN len(extracted) > len(gold) THEN gold ELSE extracted END AS other FROM pairs),
w AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, turn, string_split_regex(other, '\\s+') AS ws FROM t)),
f AS (SELECT conv_id, turn, {duck.fold("w")} AS f, arg_min(w, pos) AS w, min(pos) AS pos FROM w WHERE len({duck.fold("w")}) >= 2 GROUP BY ALL),
x AS (SELECT f.conv_id, f.turn, string_agg(w, ' ' ORDER BY pos) AS more FROM f JOIN t USING (conv_id, turn) WHERE NOT list_contains({duck.split(duck.fold("base"), 2)}, f) GROUP BY f.conv_id, f.turn)
SELECT conv_id, turn, CASE WHEN more IS NULL THEN base ELSE base || ' ' || more END AS merged FROM t LEFT JOIN x USING (conv_id, turn)""")
def q_multi_scale_merge(spark: SparkSession, d: str) -> DataFrame:
    """Both turns of a pair as one text at two scales."""
    rows = turn_pairs(spark, d).select(F.struct("conv_id", "turn").alias("key"), F.explode(F.array(F.struct(F.lit(1.0).alias("scale"), F.col("gold").alias("text")), F.struct(F.lit(2.0).alias("scale"), F.col("extracted").alias("text")))).alias("x"))
    return images.merge_scales(rows.select("key", "x.scale", "x.text")).select("key.conv_id", "key.turn", F.col("text").alias("merged"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)
SELECT doc_id, trim(array_to_string(list_filter(ws, lambda x, i: ((i - 1) * 37) % 101 >= 60 AND len(x) > 0), ' ')) AS text FROM w""")
def q_confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document with a confidence made of their place, the sure ones kept."""
    parts = F.split("text", " ")
    words = F.transform(parts, lambda w, i: F.struct(w.alias("text"), ((i * 37) % 101).cast("double").alias("confidence")))
    return table(spark, d, "documents").select("doc_id", images.confident(words).alias("text"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def q_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_dup_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("""WITH l AS (SELECT DISTINCT source AS doc, doc_id AS page_idx, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT source AS doc, count(*) AS num_pages FROM documents GROUP BY source)
SELECT doc, line, count(*) AS pages FROM l JOIN c USING (doc) WHERE line <> '' GROUP BY doc, line, num_pages HAVING count(*) >= 0.1 * num_pages""")
def q_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines on a tenth of a source's documents or more."""
    docs = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page_idx"), "text")
    lines = docs.select("doc", "page_idx", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).filter("line <> ''")
    return blocks.repeated_lines(lines, docs.groupBy("doc").agg(F.count("*").alias("num_pages")), 0.1)


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS text FROM pages""")
def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of web pages."""
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " "), "<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " ")).alias("text"))
