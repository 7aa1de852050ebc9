"""The table of results: filters, gold lookup, keyed upsert, averages by extractor.

Column names are the published ones of the result files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.functions.textnorm import places

METRICS = ["sim_levenshtein", "cobertura_palavras", "sim_bigramas", "tamanho_relativo", "qualidade_excesso"]
KEY = ["pdf", "extrator"]
RESULT = T.StructType([
    T.StructField("pdf", T.StringType()), T.StructField("extrator", T.StringType()), T.StructField("num_paginas", T.IntegerType()), T.StructField("tempo_seg", T.DoubleType()), T.StructField("num_caracteres", T.IntegerType()),
    *[T.StructField(m, T.DoubleType()) for m in METRICS], T.StructField("erro", T.StringType()),
])


def contains(column: Column, part: str | None) -> Column:
    """Case-insensitive substring filter; None keeps everything."""
    return F.lit(True) if part is None else F.lower(column).contains(part.lower())


def with_gold(docs: DataFrame, gold: DataFrame, on: str) -> DataFrame:
    """Documents that have a gold text, with it."""
    return docs.join(gold, on)


def without_gold(docs: DataFrame, gold: DataFrame, on: str) -> DataFrame:
    """Documents that have none."""
    return docs.join(gold.select(on), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and old ones whose key has no new row."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge_run(old: DataFrame, new: DataFrame, filtered: bool, key: list[str] = KEY) -> DataFrame:
    """A filtered run is merged into what is there and sorted; a full run takes its place."""
    return upsert(old, new, key).orderBy(*collated(key)) if filtered else new


def collated(key: list[str] = KEY) -> list[Column]:
    """The order of result rows: letters of either case stand together."""
    return [F.collate(F.col(k), "UNICODE") for k in key]


def in_places(rows: DataFrame, by: list[Column], folder: str, place: str = "place") -> DataFrame:
    """*rows* with their places in the order *by* from 1 on, without a task that holds them all.

    Rows are dealt into ranges of the order and numbered within them; a range's places start behind the sizes of those before
    it, of which there is one for each partition. The numbered rows are written below *folder*, so ranges are dealt once.
    """
    spark = rows.sparkSession
    keys = {f"_k{i}": c for i, c in enumerate(by)}
    dealt = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    dealt.withColumns({"_part": F.shiftright(number, 33), "_at": number.bitwiseAND(F.lit((1 << 33) - 1))}).drop(*keys).write.parquet(folder)
    numbered = spark.read.parquet(folder)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return numbered.join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def preserved(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """How many old rows a merge keeps."""
    return old.join(new.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("preserved"))


def averages(results: DataFrame, by: str, values: list[str], error: str, registry: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Counts of rows and of errors, and means over rows without error, by *by*.

    With a *registry* (one column *by*) its names and no others are listed, those without rows with zeros.
    """
    fine = F.coalesce(F.col(error), F.lit("")) == ""
    means = [places(F.avg(F.when(fine, F.col(v))), digits).alias(f"mean_{v}") for v in values]
    out = results.groupBy(by).agg(F.count("*").alias("num_rows"), F.count_if(~fine).alias("num_errors"), *means)
    if registry is not None:
        out = registry.join(out, by, "left")
    return out.fillna(0, ["num_rows", "num_errors", *[f"mean_{v}" for v in values]])


def summary_line(row: Column, mean: Column, seconds: Column) -> Column:
    """One printed line per extractor."""
    return F.concat(F.rpad(row, 32, " "), F.format_string("%12.4f %12.3fs", mean, seconds))
