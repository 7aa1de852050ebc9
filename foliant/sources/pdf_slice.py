"""Page ranges of a PDF as files of their own, and page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.pdf import Document, Name, Ref, Stream


def dump(x, number) -> bytes:
    """A value as PDF source; *number* gives the new number of a referenced object."""
    if isinstance(x, Ref):
        return b"%d 0 R" % number(int(x))
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Name):
        return b"/" + b"".join(b"%c" % c if 33 <= c <= 126 and c not in b"#/()<>[]{}%" else b"#%02X" % c for c in x.encode("latin-1", "replace"))
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, dict):
        return b"<< " + b" ".join(dump(Name(k), number) + b" " + dump(v, number) for k, v in x.items()) + b" >>"
    if isinstance(x, list):
        return b"[ " + b" ".join(dump(v, number) for v in x) + b" ]"
    return b"null" if x is None else str(x).encode("latin-1")


def slice_pages(data: bytes, start: int, end: int) -> bytes:
    """Pages [start, end) with what they refer to; inherited attributes stand in each page."""
    document = Document(data)
    numbers: dict[int, int] = {}
    todo: list[int] = []

    def number(old: int) -> int:
        if old not in numbers:
            numbers[old] = len(numbers) + 3
            todo.append(old)
        return numbers[old]

    leaves = [{k: v for k, v in page.items() if k != "Parent"} for page in document.leaves()[start:end]]
    bodies = [dump(p, number)[:-2] + b"/Parent 2 0 R >>" for p in leaves]
    objects: dict[int, bytes] = {}
    while todo:
        old = todo.pop()
        value = document.objects.get(old)
        if isinstance(value, Stream):
            objects[numbers[old]] = dump({**value.info, "Length": len(value.raw)}, number) + b"\nstream\n" + value.raw + b"\nendstream"
        else:
            # A page that another object points to would bring the whole tree along.
            whole = isinstance(value, dict) and value.get("Type") in ("Page", "Pages", "Catalog")
            objects[numbers[old]] = b"null" if whole else dump(value, number)
    first = len(numbers) + 3
    objects |= {first + i: b for i, b in enumerate(bodies)}
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = b"<< /Type /Pages /Kids [ " + b" ".join(b"%d 0 R" % (first + i) for i in range(len(bodies))) + b" ] /Count %d >>" % len(bodies)
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n in sorted(objects):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n"
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(objects))
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)


def page_counts(files: DataFrame) -> DataFrame:
    """doc and num_pages of binary files (doc, content); 0 for those that can't be read."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            counts = []
            for content in batch["content"]:
                try:
                    counts.append(len(Document(bytes(content)).pages))
                except Exception:  # noqa: BLE001  any damage counts as no pages
                    counts.append(0)
            yield pd.DataFrame({"doc": batch["doc"], "num_pages": counts})

    return files.select("doc", "content").mapInPandas(run, "doc string, num_pages long")


def page_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """The slice of each range (doc, start, end), its bytes and their base64; null where the file can't be read."""

    @F.pandas_udf("binary")
    def cut(content, start, end):
        import pandas as pd

        out = []
        for c, a, b in zip(content, start, end, strict=True):
            try:
                out.append(slice_pages(bytes(c), int(a), int(b)))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    cuts = ranges.join(files.select("doc", "content"), "doc").withColumn("pdf", cut("content", "start", "end"))
    return cuts.select("doc", "start", "end", "pdf", F.base64("pdf").alias("pdf_base64"))
