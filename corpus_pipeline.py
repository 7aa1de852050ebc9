"""A training corpus from the documents table, in five stages that each write what they keep.

Toxic documents go; boilerplate lines of a site are taken out; one document of each group of near copies stays
(5-word shingles, similarity of 0.8 or more); runs of 51 words and strings of 400 bytes that occur more than once are
cut out; what is left is packed into sequences of token ids. Every stage but the last returns the columns of its input.

Defined results: rows with a null id are scored, cleaned and packed like others and never count as copies; of
repeated rows of one id and text the third stage keeps one, and rows of one id with unlike texts are documents of
their own; a text of which nothing is left stays as an empty text; empty tables give empty tables; columns of any
other name, those of the operators' own results too, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.column_repeats import PASSAGE, without_repeats
from foliant.llm.differencing_pack import packed
from foliant.llm.near_copies import near_copies
from foliant.llm.scratch import Scratch
from foliant.llm.site_lines import FEW, RARE, drop_boilerplate
from foliant.llm.string_kernel import THRESHOLD, toxicity
from foliant.sources.tables import table

#: Most hashes that pairs of id and text may share; beyond that something is wrong with the hash.
SHARED = 10_000


def _counted(docs: DataFrame) -> DataFrame:
    """*docs* with ``n_chars`` as its text now has."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel's machine does not take for toxic."""
    return toxicity(docs, table(spark, sf_dir, "labels"), out="__foliant_score").filter(F.col("__foliant_score") < THRESHOLD).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than a tenth of their site's pages hold, or a twentieth of its many texts."""
    return _counted(drop_boilerplate(docs, ratio=FEW, rare=RARE))


def _row_ids(docs: DataFrame) -> Column:
    """A number for each pair of id and text: a 64-bit hash, or another one where two pairs have the same.

    Which hashes are shared is seen from a second hash of each pair; among 10**10 rows about three are, so they are few.
    """
    pair = ("doc_id", "text")
    first, second = F.xxhash64(*pair), F.xxhash64(F.lit(1), *pair)
    seen = docs.select(first.alias("h"), second.alias("g")).groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    shared = [r["h"] for r in seen.filter("low <> high").select("h").limit(SHARED + 1).collect()]
    if len(shared) > SHARED:
        raise ValueError(f"more than {SHARED} pairs of id and text share a hash")
    return F.when(first.isin(shared), F.xxhash64(F.lit(2), *pair)).otherwise(first) if shared else first


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Ids may repeat with other texts, so documents are told apart by a number for id and text.
    """
    rows = docs.filter("doc_id IS NOT NULL")
    rows = rows.withColumn("__foliant_row", _row_ids(rows))
    groups = near_copies(rows, doc_id="__foliant_row").select(F.col("doc_id").alias("__foliant_row"), F.col("component_id").alias("__foliant_group"))
    least = F.min(F.struct("doc_id", "__foliant_row"))
    chosen = groups.distinct().join(rows.select("doc_id", "__foliant_row"), "__foliant_row").groupBy("__foliant_group").agg(least.alias("__foliant_least")).select(F.col("__foliant_least.__foliant_row").alias("__foliant_kept"))
    with_id = rows.join(chosen, F.col("__foliant_row") == F.col("__foliant_kept"), "left_semi")
    first = F.row_number().over(Window.partitionBy("__foliant_row").orderBy("doc_id"))
    once = with_id.withColumn("__foliant_turn", first).filter("__foliant_turn = 1").select(*docs.columns)
    return once.unionByName(docs.filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, and strings of 400 bytes, that occur more than once."""
    return _counted(without_repeats(docs, words=PASSAGE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packed(docs)


STAGES = [
    ("toxicity", harmless),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can't express a string-kernel machine, MinHash signatures or the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    scratch = Scratch(spark)
    docs = before = None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.save(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
