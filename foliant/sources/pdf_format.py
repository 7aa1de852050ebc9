"""``spark.read.format("foliant-pdf")``: the pages of PDF files as rows of ``pdf.PARSED``, and as a stream of arriving files.

    spark.dataSource.register(PdfFormat)
    spark.read.format("foliant-pdf").load("/data/pdfs").filter("page_idx < 10")

Small files share a partition, up to BYTES; a larger file is dealt into several, each of which reads a range of its pages. Filters
on doc and page_idx reach the reader (with spark.sql.python.filterPushdown.enabled), so other files are not opened and the
content of other pages is not read. A file is opened where its rows are made, through pyarrow's file systems. Where executors
reach the files by Spark's readers only, ``pdf.parsed`` over a ``binaryFile`` scan gives the same rows.

Defined results: a file that can't be read is one row with an error (page_idx null, so a filter on page_idx drops it); a file
without pages one row without a page; an empty or missing folder gives no rows; names that end in .pdf, in any case, count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.sources.pdf import PARSED, rows_of_file

BYTES = 32 << 20
#: Rows of a batch.
ROWS = 64


class Files(InputPartition):
    """Files of one partition (path, document), and which of *parts* ranges of their pages it reads."""

    def __init__(self, files: list[tuple[str, str]], part: int = 0, parts: int = 1):
        super().__init__(0)
        self.files, self.part, self.parts = files, part, parts


def listed(path: str) -> list[tuple[int, str, str, int]]:
    """Change time in nanoseconds, path, name without ending and size of the PDF files in a folder, in that order."""
    system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.lower().endswith(".pdf")]
    return sorted((f.mtime_ns or 0, f.path, os.path.splitext(f.base_name)[0], f.size) for f in found)


def dealt(files: list[tuple[int, str, str, int]], most: int) -> list[Files]:
    """Partitions of about *most* bytes each."""
    out, now, size = [], [], 0
    for _, path, doc, n in files:
        if n > most:
            parts = -(-n // most)
            out += [Files([(path, doc)], i, parts) for i in range(parts)]
            continue
        if now and size + n > most:
            out.append(Files(now))
            now, size = [], 0
        now.append((path, doc))
        size += n
    return out + [Files(now)] if now else out


def rows(root: str, partition: Files, tests: list, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of one partition; *tests* are filters on page_idx."""
    system = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()

    def wanted(i: int, n: int) -> bool:
        return i * partition.parts // n == partition.part and all(test(i) for test in tests)

    for path, doc in partition.files:
        with system.open_input_stream(path) as f:
            content = f.read()
        waiting = []
        for r in rows_of_file(doc, content, wanted=wanted):
            if r.get("page_idx") is None and partition.part:
                continue  # the first range tells of a file as a whole
            waiting.append(r)
            if len(waiting) == ROWS:
                yield pa.RecordBatch.from_pylist(waiting, schema=shape)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=shape)


class _Page:
    """A test of a page's number that can be sent to tasks."""

    def __init__(self, kind: str, value):
        self.kind, self.value = kind, value

    def __call__(self, i: int) -> bool:
        return {"=": lambda: i == self.value, "in": lambda: i in self.value, "<": lambda: i < self.value, "<=": lambda: i <= self.value, ">": lambda: i > self.value, ">=": lambda: i >= self.value}[self.kind]()


_KINDS = {EqualTo: "=", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}


class PdfReader(DataSourceReader):
    def __init__(self, path: str, most: int, schema: StructType):
        self.path, self.most, self.shape, self.docs, self.tests = path, most, to_arrow_schema(schema), None, []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Takes filters on doc by equality and on page_idx; gives back all others, for Spark to apply."""
        for f in filters:
            column, kind = getattr(f, "attribute", None), _KINDS.get(type(f))
            if column == ("page_idx",) and kind:
                self.tests.append(_Page(kind, f.value))
            elif column == ("doc",) and kind in ("=", "in"):
                chosen = {f.value} if kind == "=" else set(f.value)
                self.docs = chosen if self.docs is None else self.docs & chosen
            yield f  # rows without a page are for Spark to judge

    def partitions(self):
        return dealt([f for f in listed(self.path) if self.docs is None or f[2] in self.docs], self.most)

    def read(self, partition: Files):
        yield from rows(self.path, partition, self.tests, self.shape) if isinstance(partition, Files) else ()


class PdfStream(DataSourceStreamReader):
    """Files in the order of their change times; an offset is the last time that was read, and the files of that time."""

    def __init__(self, path: str, most: int, schema: StructType):
        self.path, self.most, self.shape = path, most, to_arrow_schema(schema)

    def initialOffset(self):  # noqa: N802
        return {"time": -1, "paths": []}

    def latestOffset(self):  # noqa: N802
        files = listed(self.path)
        last = files[-1][0] if files else -1
        return {"time": last, "paths": [f[1] for f in files if f[0] == last]}

    def partitions(self, start, end):
        files = [f for f in listed(self.path) if start["time"] <= f[0] <= end["time"]]
        new = [f for f in files if f[1] not in (start["paths"] if f[0] == start["time"] else []) and (f[0] < end["time"] or f[1] in end["paths"])]
        return dealt(new, self.most)

    def read(self, partition: Files):
        yield from rows(self.path, partition, [], self.shape)


class PdfFormat(DataSource):
    """Options: path, and bytes, how many a partition reads."""

    @classmethod
    def name(cls):
        return "foliant-pdf"

    def schema(self):
        return PARSED

    def reader(self, schema):
        return PdfReader(self.options["path"], int(self.options.get("bytes", BYTES)), schema)

    def streamReader(self, schema):  # noqa: N802
        return PdfStream(self.options["path"], int(self.options.get("bytes", BYTES)), schema)
