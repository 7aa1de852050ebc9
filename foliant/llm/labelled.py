"""Bounded samples of labelled rows and scoring that passes all other columns through."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo *n*; null ids have none and so are never held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def sample(labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """``_id`` and ``_y`` of at most *most* usable rows of each class, those with the smallest hashes of their ids.

    Rows with a null id or label count as unlabelled; of repeated labels of a document the smallest holds.
    """
    rows = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    of = lambda y: rows.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return of(1).unionByName(of(0))


def sampled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``_id``, ``_y`` and UTF-8 ``_text`` of the documents chosen by ``sample``, whose size is bounded, so it is broadcast."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("_text"))
    return rows.join(F.broadcast(chosen), "_id")


def with_scores(docs: DataFrame, scorer: Callable[[], Callable[[pa.Array], pa.Array]], text: str = "text", out: str = "score") -> DataFrame:
    """*docs* with a column *out*; *scorer* is called in the worker and gives a function of a column of UTF-8 texts.

    Other columns pass through; one named *out* is replaced.
    """
    keep = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])
    raw = "_text"
    while raw in names:
        raw += "_"

    def run(batches):
        score = scorer()
        for batch in batches:
            values = score(batch.column(len(names)).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], values], names=[*names, out])

    return docs.select(*names, F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias(raw)).mapInArrow(run, schema)
