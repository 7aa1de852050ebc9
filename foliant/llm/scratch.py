"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file://{tempfile.gettempdir()}/foliant-checkpoints"


#: Rows that go to a Python worker at once. Texts are long: Spark's default of 10,000 makes batches of 30 MB and more.
ROWS_AT_ONCE = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_at_once(spark: SparkSession, most: int | None = ROWS_AT_ONCE) -> Iterator[None]:
    """Lowers the session's number of rows in an Arrow batch to *most* (None: leaves it) for what runs meanwhile."""
    before = spark.conf.get(_ROWS)
    if most and not 0 < int(before) <= most:
        spark.conf.set(_ROWS, str(most))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


class Scratch:
    """Written tables of one run; what is not dropped before goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/foliant-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, options: dict | None = None) -> DataFrame:
        """*df* written as Parquet and read again, so that a lost executor costs no more than one step."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        with rows_at_once(self.spark):
            df.write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            self._delete(t._scratch_path)

    def sweep(self) -> None:
        """Asks the driver for its garbage: shuffle files go only once nothing there refers to their plans."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        try:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone when the driver ends
            pass
