"""A reader for a subset of PDF, with the standard library only.

Supported: classic files and object streams, the filters of ``pdf_filters`` with their predictors, page trees with
inherited boxes, one-byte fonts with WinAnsi-like codes or ToUnicode maps and their widths, text operators, image XObjects
(8 bits, grey or RGB, or JPEG as it is stored) and the graphics state that places them. Encrypted files, other filters, and
trees or references without an end raise; the table functions make error rows of it.

``parsed`` reads each file once into rows that hold everything a run needs; the other table functions are views of it.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.sources.pdf_filters import FILTERS

_SPACE, _DELIM = b" \t\r\n\f\0", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^ \t\r\n\f\0()<>\[\]{}/%]+")


#: Filters whose streams are image files of their own (fixed values).
JPEG = {"DCTDecode": "jpeg", "DCT": "jpeg", "JPXDecode": "jpx"}


class Name(str):
    """A PDF name."""


class Ref(int):
    """A reference to an object by its number."""


class Op(str):
    """An operator of a content stream."""


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self, all_but_last: bool = False) -> bytes:
        """The bytes unpacked; with *all_but_last* the last filter's own form is left as it is."""
        kinds, parms = self.info.get("Filter", []), self.info.get("DecodeParms", self.info.get("DP", []))
        out, kinds = self.raw, kinds if isinstance(kinds, list) else [kinds]
        parms = parms if isinstance(parms, list) else [parms]
        if any(isinstance(x, Ref) for x in (*kinds, *parms)):
            raise ValueError("filters by reference")
        for n, kind in enumerate(kinds[:-1] if all_but_last else kinds):
            if kind not in FILTERS:
                raise ValueError(f"filter {kind}")
            out = FILTERS[kind](out, parms[n] if n < len(parms) and isinstance(parms[n], dict) else {})
        return out


class Lexer:
    """Objects and operators from bytes, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def blank(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 37:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next object, or None at the end."""
        self.blank()
        d = self.data
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if c == b"/":
            self.at += 1
            m = _TOKEN.match(d, self.at)
            self.at = m.end() if m else self.at
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"").decode("latin-1"))
        if c == b"(":
            return self.literal()
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            items = self.until(b">>")
            return {items[i]: items[i + 1] for i in range(0, len(items) - 1, 2)}
        if c == b"<":
            end = d.index(b">", self.at)
            digits = re.sub(rb"\s", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self.until(b"]")
        m = _TOKEN.match(d, self.at)
        if not m:
            self.at += 1
            return Op(c.decode("latin-1"))
        self.at = m.end()
        word = m[0]
        if re.fullmatch(rb"[+-]?\d+", word):
            ref = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(d, self.at)
            if ref and word[0:1].isdigit():
                self.at = ref.end()
                return Ref(int(word))
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False}.get(word, Op(word.decode("latin-1")))

    def until(self, end: bytes) -> list:
        out = []
        while True:
            self.blank()
            if self.data.startswith(end, self.at):
                self.at += len(end)
                return out
            if self.at >= len(self.data):
                raise ValueError("unfinished object")
            x = self.next()
            out.append(None if x == "null" and isinstance(x, Op) else x)

    def literal(self) -> bytes:
        out, depth, d = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 92:
                e = d[self.at : self.at + 1]
                self.at += 1
                if e in b"01234567" and e:
                    m = re.compile(rb"[0-7]{1,3}").match(d, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == b"\r":
                    self.at += d[self.at : self.at + 1] == b"\n"
                elif e != b"\n":
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)


@dataclass
class Page:
    """What a page shows: text items (str, x, y, size, width, font), images, and the operators that place them."""

    width: float
    height: float
    items: list = field(default_factory=list)
    images: list = field(default_factory=list)
    ops: list = field(default_factory=list)

    def text(self) -> str:
        """Items in content order; a new line where the height changes."""
        out, last = [], None
        for s, _, y, *_ in self.items:
            if last is not None:
                out.append("\n" if abs(y - last) > 2 else " ")
            out.append(s)
            last = y
        return "".join(out)


class Document:
    """Objects are found by scanning for ``n g obj``, which also reads files with broken tables; later ones win."""

    def __init__(self, data: bytes, wanted: Callable[[int, int], bool] = lambda i, n: True):
        """*wanted* tells of each page's number and how many there are whether its content is read; others stay empty (None)."""
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF header")
        self.objects: dict[int, object] = {}
        root = None
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            lexer = Lexer(data, m.end())
            try:
                value = lexer.next()
            except (ValueError, IndexError):
                continue
            lexer.blank()
            if isinstance(value, dict) and data.startswith(b"stream", lexer.at):
                at = lexer.at + 6
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                size = value.get("Length")
                if isinstance(size, Ref) or not isinstance(size, int) or data[at + size : at + size + 20].lstrip()[:9] != b"endstream":
                    size = data.index(b"endstream", at) - at
                value = Stream(value, data[at : at + size])
            self.objects[int(m[1])] = value
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.info.get("Type") == "ObjStm":
                body, first = value.data(), value.info["First"]
                lexer = Lexer(body)
                pairs = [(lexer.next(), lexer.next()) for _ in range(value.info["N"])]
                for number, at in pairs:
                    self.objects.setdefault(number, Lexer(body, first + at).next())
        for value in self.objects.values():
            info = value.info if isinstance(value, Stream) else value
            if isinstance(info, dict) and "Encrypt" in info:
                raise ValueError("encrypted")
            if isinstance(info, dict) and info.get("Type") == "Catalog":
                root = info
        if re.search(rb"trailer[^%]*?/Encrypt", data):
            raise ValueError("encrypted")
        if root is None:
            raise ValueError("no catalog")
        self.root = root
        leaves = self.leaves()
        self.pages = [self._page(p) if wanted(i, len(leaves)) else None for i, p in enumerate(leaves)]

    def get(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        raise ValueError("references without an end")

    def leaves(self) -> list[dict]:
        """The dictionaries of the pages, with what they inherit."""
        return list(self._leaves(self.root.get("Pages"), {}))

    def _leaves(self, node, inherited: dict, depth: int = 0):
        node = self.get(node)
        if not isinstance(node, dict):
            return
        if depth > 64:
            raise ValueError("a page tree of more than 64 levels")
        own = inherited | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
        if "Kids" in node:
            for kid in self.get(node["Kids"]):
                yield from self._leaves(kid, own, depth + 1)
        else:
            yield own | node

    def _page(self, page: dict) -> Page:
        box = [float(self.get(x)) for x in self.get(page.get("MediaBox", [0, 0, 612, 792]))]
        out = Page(box[2] - box[0], box[3] - box[1])
        contents = self.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(s.data() for p in parts if isinstance(s := self.get(p), Stream))
        self._show(out, data, self.get(page.get("Resources")) or {})
        return out

    def _widths(self, fonts: dict, name: str):
        """The width of a code in this font, in thousandths of its size; half of it where the font doesn't say."""
        font = self.get(fonts.get(name)) or {}
        first, widths = self.get(font.get("FirstChar")) or 0, self.get(font.get("Widths"))
        known = dict(enumerate((float(self.get(w)) for w in widths), int(first))) if isinstance(widths, list) else {}
        return lambda code: known.get(code, 500.0), str(self.get(font.get("BaseFont")) or name)

    def _font(self, fonts: dict, name: str):
        """A decoder for strings in this font."""
        font = self.get(fonts.get(name)) or {}
        cmap = self.get(font.get("ToUnicode"))
        if not isinstance(cmap, Stream):
            return lambda b: b.decode("cp1252", "replace")
        table, text = {}, cmap.data().decode("latin-1")
        read = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
        width = 1
        for block in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
            for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                table[int(a, 16)], width = read(b), len(a) // 2
        for block in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
            for a, b, c in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                width = len(a) // 2
                for i in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                    start = read(c)
                    table[i] = start[:-1] + chr(ord(start[-1]) + i - int(a, 16))
        return lambda b: "".join(table.get(int.from_bytes(b[i : i + width], "big"), "") for i in range(0, len(b), width))

    def _show(self, page: Page, data: bytes, resources: dict) -> None:
        fonts, objects = self.get(resources.get("Font")) or {}, self.get(resources.get("XObject")) or {}
        lexer, stack, decode = Lexer(data), [], lambda b: b.decode("cp1252", "replace")
        line = matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        leading = between = words = 0.0
        size, stretch, width_of, font = 0.0, 1.0, lambda code: 500.0, ""

        def moved(m, x, y):
            return (*m[:4], m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])

        def length(raw):
            return sum((width_of(c) / 1000 * size + between + (words if c == 32 else 0.0)) * stretch for c in raw)

        def show(raw, reach=None):
            nonlocal matrix
            reach = length(raw) if reach is None else reach
            if text := decode(raw):
                page.items.append((text, matrix[4], matrix[5], size * (matrix[2] ** 2 + matrix[3] ** 2) ** 0.5, reach * (matrix[0] ** 2 + matrix[1] ** 2) ** 0.5, font))
            matrix = moved(matrix, reach, 0.0)

        while (x := lexer.next()) is not None:
            if not isinstance(x, Op):
                stack.append(x)
                continue
            if x == "q":
                page.ops.append(("save", None, 0, 0))
            elif x == "Q":
                page.ops.append(("restore", None, 0, 0))
            elif x == "cm":
                page.ops.append(("transform", [float(v) for v in stack[-6:]], 0, 0))
            elif x == "BT":
                line = matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif x == "Tf":
                decode, size = self._font(fonts, stack[-2]), float(stack[-1])
                width_of, font = self._widths(fonts, stack[-2])
            elif x == "Tc":
                between = float(stack[-1])
            elif x == "Tw":
                words = float(stack[-1])
            elif x == "Tz":
                stretch = float(stack[-1]) / 100
            elif x == "TL":
                leading = float(stack[-1])
            elif x in ("Td", "TD"):
                line = matrix = moved(line, float(stack[-2]), float(stack[-1]))
                leading = -float(stack[-1]) if x == "TD" else leading
            elif x == "Tm":
                line = matrix = tuple(float(v) for v in stack[-6:])
            elif x in ("T*", "'", '"'):
                line = matrix = moved(line, 0.0, -leading)
                if x != "T*":
                    show(stack[-1])
            elif x == "Tj":
                show(stack[-1])
            elif x == "TJ":
                reach = sum(length(v) if isinstance(v, bytes) else -v / 1000 * size * stretch for v in stack[-1])
                show(b"".join(b" " if isinstance(v, (int, float)) and v < -200 else v for v in stack[-1] if isinstance(v, bytes) or v < -200), reach)
            elif x == "Do":
                image = self.get(objects.get(stack[-1]))
                if isinstance(image, Stream) and image.info.get("Subtype") == "Image":
                    w, h = int(self.get(image.info.get("Width", 0))), int(self.get(image.info.get("Height", 0)))
                    page.ops.append(("image", None, w, h))
                    space = self.get(image.info.get("ColorSpace"))
                    page.images.append({"width": w, "height": h, "channels": {"DeviceGray": 1, "DeviceRGB": 3}.get(space, 0), "stream": image})
            elif x == "BI":
                end = re.compile(rb"\sEI(?=\s|$)").search(data, lexer.at)
                page.ops.append(("inline_image", None, 0, 0))
                lexer.at = end.end() if end else len(data)
            stack.clear()


def image_bytes(stream: Stream) -> tuple[str, bytes]:
    """An image's form and bytes: pixels ("raw"), or the whole file of a JPEG ("jpeg", "jpx") as it is stored."""
    last = stream.info.get("Filter", [])
    last = last[-1] if isinstance(last, list) and last else last
    form = JPEG.get(last if isinstance(last, str) else None, "raw")
    return form, stream.data(all_but_last=form != "raw")


PARSED = (
    "doc string, file string, page_idx int, num_pages int, error string, seconds double, width double, height double, text string, "
    "items array<struct<item_idx:int,str:string,x:double,y:double,size:double,width:double,font:string>>, ops array<struct<op_idx:int,op:string,m:array<double>,width:int,height:int>>, "
    "images array<struct<img_idx:int,width:int,height:int,channels:int,bytes:binary,format:string,hash:string,error:string>>"
)


def rows_of_file(doc: str, content: bytes, images: str = "first", wanted: Callable[[int, int], bool] = lambda i, n: True):
    """Rows of PARSED of one file, of the pages that *wanted* tells.

    *images*: their bytes stand where the rows "first" have them or "every" time; by "hash" they are unpacked and only their digests are kept, by "size" they aren't unpacked.
    """
    start, file = time.perf_counter(), hashlib.sha256(content).hexdigest()
    try:
        pages = Document(content, wanted).pages
    except Exception as e:  # noqa: BLE001  any damage is the row's error
        yield {"doc": doc, "file": file, "num_pages": 0, "error": f"{type(e).__name__}: {e}", "seconds": time.perf_counter() - start}
        return
    read: dict[int, tuple] = {}  # images by the stream's identity
    made, seen = [], set()
    for i, p in enumerate(pages):
        if p is None:
            continue
        shown = []
        for k, image in enumerate(p.images):
            if images == "size":
                read[id(image["stream"])] = None, None, None, None
            elif id(image["stream"]) not in read:
                try:
                    form, data = image_bytes(image["stream"])
                    read[id(image["stream"])] = form, None if images == "hash" else data, hashlib.sha256(data).hexdigest(), None
                except Exception as e:  # noqa: BLE001
                    read[id(image["stream"])] = None, None, None, f"{type(e).__name__}: {e}"
            form, data, digest, error = read[id(image["stream"])]
            here = images == "every" or digest not in seen
            seen.add(digest)
            shown.append({"img_idx": k, "width": image["width"], "height": image["height"], "channels": image["channels"], "bytes": data if here else None, "format": form, "hash": digest, "error": error})
        items = [dict(zip(("item_idx", "str", "x", "y", "size", "width", "font"), (n, *x), strict=True)) for n, x in enumerate(p.items)]
        ops = [dict(zip(("op_idx", "op", "m", "width", "height"), (n, *x), strict=True)) for n, x in enumerate(p.ops)]
        made.append({"doc": doc, "file": file, "page_idx": i, "num_pages": len(pages), "width": p.width, "height": p.height, "text": p.text(), "items": items, "ops": ops, "images": shown})
    seconds = time.perf_counter() - start
    yield from ({**r, "seconds": seconds} for r in (made if pages else [{"doc": doc, "file": file, "num_pages": 0}]))


def parsed(files: DataFrame) -> DataFrame:
    """One row for each page of binary files (doc, content), all of it from one reading of the file: text, positioned items,
    graphics operators and images; ``file`` is the content's digest, ``seconds`` what reading took.

    A file that can't be read, or has no pages, is one row without a page. An image that can't be unpacked has an error.
    A column ``images`` of *files* tells what is kept of a file's, as in ``rows_of_file`` ("first", if there is none); tables that are
    written or kept take "hash" or "size", since pixels are many times as large as files.
    """

    def run(batches):
        for batch in batches:
            waiting = []
            for doc, content, images in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for r in rows_of_file(doc, content.as_py() or b"", images):
                    waiting.append(r)
                    if len(waiting) == 64:
                        yield pa.RecordBatch.from_pylist(waiting, schema=shape)
                        waiting = []
                if waiting and images in ("first", "every"):  # pixels of one file at a time
                    yield pa.RecordBatch.from_pylist(waiting, schema=shape)
                    waiting = []
            if waiting:
                yield pa.RecordBatch.from_pylist(waiting, schema=shape)

    shape = to_arrow_schema(StructType.fromDDL(PARSED))  # the worker gets it ready made
    images = F.col("images") if "images" in files.columns else F.lit("first").alias("images")
    return files.select("doc", "content", images).mapInArrow(run, PARSED)


def pages_of(rows: DataFrame) -> DataFrame:
    """doc, page_idx, text, width, height, error, seconds of parsed rows; a file that can't be read is one row with an error."""
    return rows.filter("page_idx IS NOT NULL OR error IS NOT NULL").select("doc", "page_idx", "text", "width", "height", "error", "seconds")


def counts_of(rows: DataFrame) -> DataFrame:
    """doc and num_pages; 0 for files that can't be read."""
    return rows.groupBy("doc").agg(F.max("num_pages").cast("long").alias("num_pages"))


def items_of(rows: DataFrame) -> DataFrame:
    """Positioned text items: item_idx, str, x, y, size, width, font."""
    return rows.select("doc", "page_idx", F.inline("items"))


def images_of(rows: DataFrame) -> DataFrame:
    """Images on pages with their bytes' hash; those that can't be unpacked have none."""
    return rows.select("doc", "page_idx", F.inline("images"))


def operators_of(rows: DataFrame) -> DataFrame:
    """Graphics operators of each page, as ``geometry.image_boxes`` takes them."""
    return rows.select("doc", "page_idx", F.inline("ops"))


def read_pages(files: DataFrame) -> DataFrame:
    """``pages_of`` binary files (doc, content)."""
    return pages_of(parsed(files))


def read_items(files: DataFrame) -> DataFrame:
    """``items_of`` binary files."""
    return items_of(parsed(files))


def read_images(files: DataFrame) -> DataFrame:
    """``images_of`` binary files, those that can be unpacked, each with its bytes."""
    return images_of(parsed(files.withColumn("images", F.lit("every")))).filter("error IS NULL").drop("error")


def read_operators(files: DataFrame) -> DataFrame:
    """``operators_of`` binary files."""
    return operators_of(parsed(files))
