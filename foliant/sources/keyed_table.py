"""A table with one row for each key, kept in buckets: an upsert rewrites the buckets that it touches and no others.

Below the table's folder, data/v=<version>/_bucket=<n> holds a bucket as some version wrote it, and manifest/<version>.json says
for each bucket which version holds it now. A version counts once its manifest is there; it is put there by a rename, so
readers see the old table or the new one, and a run that dies leaves the old one. A version that is there already is not
written again, so a streaming batch may run twice. Manifests have an entry for each bucket, however many rows there are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64
#: Versions whose data ``vacuum`` keeps.
KEEP = 2


def latest(rows: DataFrame, key: list[str], by: str | None = None) -> DataFrame:
    """One row of each key: that with the largest *by*, of equals the one whose JSON is the largest."""
    order = [F.desc(by)] if by else []
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order, F.desc(F.to_json(F.struct(*rows.columns)))))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, folder = self._files(), self._at("manifest")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket, as of *version* (None: now)."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        stream = self._files().open(self._at("manifest", f"{known[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        kept = json.loads(text)
        if kept["buckets"] != self.buckets or kept["key"] != self.key:
            raise ValueError(f"{self.path} has {kept['buckets']} buckets by {kept['key']}")
        return {int(b): v for b, v in kept["held"].items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        """The rows of some buckets."""
        paths = [f"{self.path}/data/v={v}/_bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table now, or as of a version that is still kept; None before the first one."""
        return self._read(self.manifest(version))

    def upsert(self, rows: DataFrame, by: str | None = None, version: int | None = None) -> int:
        """Puts *rows* (``latest`` of each key) in place of those of their keys; the number of buckets that were rewritten.

        Columns that only one side has are null on the other. *version* names the write: one that is there is left as it is.
        """
        known = self.versions()
        version = (known[-1] + 1 if known else 1) if version is None else version
        if known and version <= known[-1]:
            return 0
        held = self.manifest()
        new = latest(rows, self.key, by).withColumn("_bucket", self.bucket())
        folder = f"{self.path}/data/.new-{uuid.uuid4().hex}"
        new.write.parquet(folder)  # worked out once: which buckets it touches is asked before it is merged
        new = self.spark.read.schema(new.schema).parquet(folder)
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # numbers of buckets
        old = self._read({b: held[b] for b in touched if b in held})
        merged = new if old is None else new.unionByName(old.join(new.select(*self.key), self.key, "left_anti").withColumn("_bucket", self.bucket()), allowMissingColumns=True)
        merged.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v={version}")
        self._commit(version, held | dict.fromkeys(touched, version))
        self._files().delete(self._at("data", folder.rsplit("/", 1)[1]), True)
        return len(touched)

    def _commit(self, version: int, held: dict[int, int]) -> None:
        files, beside, to = self._files(), self._at("manifest", f".{version}-{uuid.uuid4().hex}"), self._at("manifest", f"{version}.json")
        out = files.create(beside, True)
        try:
            out.write(bytearray(json.dumps({"buckets": self.buckets, "key": self.key, "held": held}).encode()))
        finally:
            out.close()
        if files.exists(to) or not files.rename(beside, to):
            files.delete(beside, False)
            raise RuntimeError(f"version {version} of {self.path} is there already")

    def vacuum(self, keep: int = KEEP) -> int:
        """Deletes buckets that none of the last *keep* versions holds, and older manifests; the number of deleted buckets."""
        versions, files = self.versions(), self._files()
        used = {(b, v) for n in versions[-keep:] for b, v in self.manifest(n).items()}
        gone = 0
        data = self._at("data")
        for folder in files.listStatus(data) if files.exists(data) else []:
            name = folder.getPath().getName()
            if not name.startswith("v="):
                continue
            v, inside = int(name[2:]), [s.getPath() for s in files.listStatus(folder.getPath()) if s.getPath().getName().startswith("_bucket=")]
            old = [p for p in inside if (int(p.getName()[8:]), v) not in used] if not versions or v <= versions[-1] else []
            gone += sum(bool(files.delete(p, True)) for p in old)
            if len(old) == len(inside) and versions and v <= versions[-1]:
                files.delete(folder.getPath(), True)
        for n in versions[:-keep]:
            files.delete(self._at("manifest", f"{n}.json"), False)
        return gone
