"""Result tables as CSV, averages and profiles as JSON, the manifest and gold metadata.

Quoted fields may hold line feeds. Rows of the older form, without ``qualidade_excesso``, have ten fields: that
metric is 0 and the tenth is the error; rows of fewer fields are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.scoreboard import METRICS, RESULT
from foliant.sources.keyed_table import KeyedTable

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The result table at *path*; an empty one if nothing is there."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULT)
    names = [f.name for f in RESULT.fields]
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(raw).options(**_CSV | {"header": False}, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True).csv(path)
    rows = rows.filter(~F.coalesce((F.col("pdf") == "pdf") & (F.col("extrator") == "extrator"), F.lit(False)))
    # Rows of too few fields keep their raw line in _bad; its commas outside quotes tell how many there are.
    commas = F.regexp_count(F.regexp_replace("_bad", r'"([^"]|"")*"', ""), F.lit(","))
    rows = rows.filter(F.col("_bad").isNull() | (commas >= len(names) - 2))
    old = F.col("_bad").isNotNull() & (commas == len(names) - 2)
    fixed = rows.withColumn("erro", F.when(old, F.col("qualidade_excesso")).otherwise(F.col("erro"))).withColumn("qualidade_excesso", F.when(old, F.lit("0")).otherwise(F.col("qualidade_excesso")))
    return fixed.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.name == "erro" else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RESULT.fields])


def write_results(rows: DataFrame, path: str) -> None:
    """*rows* as CSV with fixed decimals, in a folder of as many files as there are partitions.

    Fields may hold line feeds, so a file is read by one task: many files are many tasks.
    """
    shown = rows.withColumns({"tempo_seg": F.format_string("%.3f", "tempo_seg")} | {m: F.format_string("%.4f", m) for m in METRICS} | {"erro": F.coalesce("erro", F.lit(""))})
    shown.select(*[f.name for f in RESULT.fields]).write.mode("overwrite").options(**_CSV, emptyValue='""', quoteAll=False).csv(path)


def replace_results(rows: DataFrame, path: str) -> None:
    """*rows*, which may have been read from *path*, as one CSV file there: a report, with a row for each run.

    It is written beside it and takes its place by one rename, so a run that dies leaves the old file.
    """
    spark, beside = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    write_results(rows.coalesce(1), beside)
    _take_place(spark, beside, path)


def _take_place(spark: SparkSession, folder: str, path: str) -> None:
    """Renames the only part file of *folder* to *path*, over what is there."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in system.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-"))
    to = system.makeQualified(hadoop.Path(path))
    if system.exists(to) and system.getFileStatus(to).isDirectory():  # as older versions left it
        system.delete(to, True)
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(part), to, over)
    system.delete(hadoop.Path(folder), True)


def write_value(spark: SparkSession, value: str, path: str) -> None:
    """One small text as a file of its own."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop.Path(path), True)
    try:
        out.write(bytearray(value.encode("utf-8")))
    finally:
        out.close()


def averages_json(rows: DataFrame, key: str) -> DataFrame:
    """One row: an object of the table's rows by *key*."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), rest.alias("v"))))
    return rows.agg(F.to_json(F.struct(F.map_from_entries(entries).alias("porExtrator"))).alias("value"))


def _one_file_each(spark: SparkSession, path: str, into: str, suffix: str) -> None:
    """Moves the only file of each folder ``name=value`` of *path* to *into*/value.suffix, over an older one.

    Only names pass the driver, a few bytes for each document; the files stay where they are.
    """
    hadoop, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    there = hadoop.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(into))
    for folder in system.listStatus(there):
        name = folder.getPath().getName()
        if "=" not in name:
            continue
        value = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.split("=", 1)[1])
        for part in system.listStatus(folder.getPath()):
            if part.getPath().getName().startswith("part-"):
                to = hadoop.Path(hadoop.Path(into), value.replace("/", "_") + suffix)
                system.delete(to, False)
                system.rename(part.getPath(), to)
    system.delete(there, True)


def _distinct_names(rows: DataFrame, by: str) -> None:
    """An error if two rows would be one file."""
    clash = rows.groupBy(F.regexp_replace(by, "/", "_").alias("name")).agg(F.count("*").alias("n")).filter("n > 1").first()
    if clash:
        raise ValueError(f"{clash['n']} rows for the file {clash['name']!r}")


def write_json(rows: DataFrame, path: str, by: str) -> None:
    """A file <document>.json for each row below *path*; files of other documents stay. Names that clash are an error."""
    _distinct_names(rows, by)
    part = f"{path.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    rows.write.partitionBy(by).json(part)
    _one_file_each(rows.sparkSession, part, path, ".json")


def write_texts(texts: DataFrame, path: str, by: str = "doc", text: str = "text") -> None:
    """A file <document>.txt for each row below *path*, which ``scan_gold`` reads back; files of other documents stay.

    Each file ends with a line feed. Names that clash are an error.
    """
    _distinct_names(texts, by)
    part = f"{path.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    texts.select(by, F.col(text).alias("value")).write.partitionBy(by).option("lineSep", "\n").text(part)
    _one_file_each(texts.sparkSession, part, path, ".txt")


ENTRY = "struct<tipo:string,area:string,fonte:string,temImagens:boolean,copyright:boolean,notas:string>"
GOLD = "struct<numPaginas:int,numCaracteres:int,tempoSegundos:double,tokensInput:long,tokensOutput:long,custoUsd:double,numChunks:int,chunks:array<struct<paginas:string,depth:int,stopReason:string,erro:string,foiDividido:boolean>>,erro:string,recusaDetectada:boolean>"


#: Most entries of an object of a manifest that Spark writes.
ENTRIES = 1000


def write_manifest(rows: DataFrame, path: str, most: int = ENTRIES) -> None:
    """A manifest of rows (doc_name and fields of ENTRY) as lines of one object each, of about *most* entries."""
    n = max(1, -(-rows.count() // most))
    fields = F.struct(*[c for c in rows.columns if c != "doc_name"])
    objects = rows.groupBy(F.pmod(F.xxhash64("doc_name"), F.lit(n))).agg(F.map_from_entries(F.collect_list(F.struct("doc_name", fields))).alias("pdfs"))
    objects.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "pdfs"))).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each document of the manifest: one object, or with *lines* one for each line."""
    whole = spark.read.text(path, wholetext=not lines)
    entries = F.from_json("value", f"struct<schemaVersion:int,pdfs:map<string,{ENTRY}>>")
    return whole.select(F.explode(entries["pdfs"]).alias("doc_name", "e")).select("doc_name", "e.*")


def read_gold_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the gold metadata, every column nullable."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{GOLD}>")).alias("doc", "m")).select("doc", "m.*")


def metadata_log(spark: SparkSession, path: str) -> KeyedTable:
    """The rows of gold metadata, one for each document, that the object at *path* shows."""
    return KeyedTable(spark, f"{path}.log", ["doc"])


def save_gold_metadata(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Puts *new* rows in place of those of the same documents in the log; rows of an object without a log go into one first."""
    log = metadata_log(spark, path)
    if not log.versions() and exists(spark, path):
        log.upsert(read_gold_metadata(spark, path))
    log.upsert(new)
    log.vacuum()


def gold_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the log, or of the object where there is no log; None without either."""
    rows = metadata_log(spark, path).read()
    return rows if rows is not None or not exists(spark, path) else read_gold_metadata(spark, path)


def export_gold_metadata(spark: SparkSession, path: str) -> None:
    """The log as one object at *path*, a line for each document, empty fields left out.

    One task writes it, a row at a time; it holds no more than a row.
    """
    rows = metadata_log(spark, path).read()
    if rows is None:
        return
    rest = F.to_json(F.struct(*[c for c in rows.columns if c != "doc"]))
    entry = F.concat(F.regexp_replace(F.to_json(F.array("doc")), r"^\[|\]$", ""), F.lit(":"), rest)
    ranked = rows.select("doc", entry.alias("e")).repartitionByRange("doc").sortWithinPartitions("doc").select("e")
    lines = ranked.coalesce(1).select(F.concat(F.when(F.monotonically_increasing_id() == 0, "{").otherwise(","), "e").alias("value"))
    beside = f"{path}.{uuid.uuid4().hex}"
    lines.unionByName(spark.createDataFrame([("}",)], "value string")).coalesce(1).write.text(beside)
    _take_place(spark, beside, path)


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """PDF files in the folder *path*: name without extension, size in bytes and MB, bytes; in no order, as tables are.

    ``orderBy("doc")`` gives the order of code units, the names' own.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    name = F.regexp_extract(F.url_decode("path"), r"([^/]+)\.[^./]+$", 1)
    return files.select(name.alias("doc"), "path", "length", F.round(F.col("length") / 1048576, 2).alias("mb"), "content")


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold texts: name without extension, whole text."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.[^./]+$", 1).alias("doc"), F.col("value").alias("text"))
