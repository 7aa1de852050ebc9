"""Removing byte strings of LENGTH that occur more than once, by column-wise construction of sorted suffixes.

A window is a string of LENGTH bytes at a place of a text. Two equal windows hold the same *anchor*, the leftmost
of their substrings of a fixed size with the least hash, at the same place. So texts are cut into segments, the
longest runs of windows with one anchor, and only segments with the same anchor are compared:

1. Anchors are hashed and counted; a segment whose anchor occurs once in the corpus is left out. Hashes do no more
   than that and send strings to their collections; what repeats is found by the construction alone. (One exception:
   a text that repeats itself, such as a run of one word, has a segment for every byte; segments of one piece of a
   text that are equal by two hashes are marked, and one of them goes on.)
2. A collection holds strings aligned at their anchors, up to BOUND of one anchor. Column by column, from the last to
   the first, one symbol of each string goes before its suffix: the symbols in the order of the suffixes behind them
   are the column of the Burrows-Wheeler transform; sorting by (anchor, symbol), stably, gives the order of the longer
   suffixes, and the common prefixes of neighbours follow from those of the column before by range minima. Each
   column of the transform and of the prefixes is appended to a file. Both files are then read once in the order of
   writing: the transform gives the order back, a window is repeated where a neighbour shares LENGTH bytes, and
   strings that are equal as a whole are found where they begin. One of them goes on, marked as one of several.
   Anchoring bounds the number of columns (below 2 * LENGTH) however long the texts are, which the construction
   over whole texts can't: it has one round for each byte of the longest text.
3. Collections are built first of what one task holds, so that groups of copies shrink before any string is shuffled,
   then of what all tasks hand on. An anchor with over BOUND strings is dealt out to several collections, round by
   round, until what is left of it fits into one; so copies shrink by up to BOUND times in a round. Where half of the
   strings or more are left they differ (a line or passage in very many documents): these are cut again by longer
   anchors, at last by the window itself, of which each collection leaves one.

Passages counted in words are found in the same way in texts that have a 64-bit hash of 8 bytes in place of each
word (what stands between blanks): a window of n words is one of 8n bytes there. Their segments run from word to word.
Segments that lie in strings already found repeated byte by byte count as marked, so that anchors of such segments
alone, those of whole copies, need no construction again.

Rows are told apart by id and a 64-bit hash of id and text. The files lie in Spark's own folder for shuffle files, have
no name, and live as long as their collection is worked on; a lost executor's are made again with its task.

Defined results: null texts are empty; texts shorter than LENGTH have no windows; a repeated row repeats all its
windows; null ids are rows like others; an empty table gives an empty one; very long texts are read in overlapping
pieces; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.byte_words import BASE, BLANK, BYTE, hashes, mix, pieces, powers
from foliant.llm.byte_words import spans as runs
from foliant.llm.scratch import Scratch
from foliant.llm.skew import with_counted
from foliant.llm.vocabularies import release_memos
from foliant.sources.tables import table

LENGTH = 400
#: Words of the shortest passage that no two places may share.
PASSAGE = 51
#: Numbers of anchors in a window, by level; 1 is the window itself.
LEVELS = (369, 33, 1)
#: Strings of one anchor that a collection may hold (on average, where an anchor's strings are dealt out).
BOUND = 256
#: Bytes of text that are hashed at once, and bytes of segments that are sorted at once.
PIECE, COLLECTION = 1 << 18, 1 << 21
_PLACE = 22  # bits of a place within a piece
_WORD = 8  # bytes of a word's hash

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        out = np.full(max(n, 2 * len(_inverses)), _INVERSE, np.uint64)
        out[0] = 1
        _inverses = np.multiply.accumulate(out)
    return _inverses[:n]


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchors: int) -> dict[str, np.ndarray]:
    """The segments of a run of texts: row, start, number of windows, place of the anchor in it, and both hashes.

    *data* holds bytes, or hashes of words.
    """
    n, size = len(data), length - anchors + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return dict.fromkeys(("row", "start", "windows", "place", "key", "content"), empty)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((BYTE[data] if data.dtype == np.uint8 else data) * powers(n))))
    back = _inverse_powers(n + 1)
    anchor = mix((total[size:] - total[:-size]) * back[: n - size + 1])
    low = np.uint64((1 << _PLACE) - 1)
    ranked = (anchor & ~low) | np.arange(len(anchor), dtype=np.uint64)
    wide = -(-len(ranked) // anchors) * anchors
    padded = np.full(wide, np.iinfo(np.uint64).max)
    padded[: len(ranked)] = ranked
    grid = padded.reshape(-1, anchors)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[anchors - 1 : anchors - 1 + starts])
    place = (least & low).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    fits = np.arange(starts) + length <= offsets[1:][rows[:starts]]
    if not fits.any():
        return dict.fromkeys(("row", "start", "windows", "place", "key", "content"), empty)
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (place[1:] != place[:-1]) | (rows[1:starts] != rows[: starts - 1])
    at = np.flatnonzero(first)
    windows = np.add.reduceat(fits, at, dtype=np.int64)
    end = at + windows - 1 + length
    content = mix((total[end] - total[at]) * back[at] + windows.astype(np.uint64))
    return {"row": rows[at], "start": at, "windows": windows, "place": place[at] - at, "key": mix(anchor[place[at]]).view(np.int64), "content": content.view(np.int64)}


_E = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "doc_id", "rk", "base", "pos")] + [T.StructField(c, T.IntegerType()) for c in ("windows", "place")] + [T.StructField("many", T.BooleanType())])


def _in_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """*batch*, in parts, with the hashes of their words for texts in its last column."""
    for at, end, data, offsets in pieces(batch.columns[-1]):
        starts, ends = word_spans(data, offsets)
        bounds = (np.searchsorted(starts, offsets) * _WORD).astype(np.int32)
        code = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(hashes(data, starts, ends, BYTE).tobytes())])
        yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[:-1]), code], names=batch.schema.names)


def _covered(known: pa.ListArray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether start..end lies in one of the spans of its row in *known*, where spans are merged."""
    bounds = known.offsets.to_numpy().astype(np.int64)
    s, e = (known.values.field(i).to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] for i in range(2))
    if not len(s):
        return np.zeros(len(row), bool)
    of = np.repeat(np.arange(len(known)), np.diff(bounds))
    at = np.searchsorted((of << 40) + s, (row << 40) + start, side="right") - 1
    return (at >= 0) & (of[at] == row) & (e[at] >= end)


def _evidence(strings: DataFrame, length: int, anchors: int, words: bool = False) -> DataFrame:
    """Rows with a key: segments, one of those that a piece of a text repeats. Rows without: the windows of these.

    The shorter the runs of windows, the more rows a byte gives, and the smaller the pieces. With *words* the hashes of
    words stand for texts, *length* and *anchors* count words, and segments in a row's spans ``known`` are marked.
    """
    unit = _WORD if words else 1
    most = max(512, PIECE * (anchors * unit + 24) // (LEVELS[0] + 24))

    def run(batches):
        release_memos()
        for batch in batches:
            ids, rk, base, many = (batch.column(i) for i in range(4))
            for at, end, data, offsets in pieces(batch.column(4), most):
                if words:
                    starts, ends = word_spans(data, offsets)
                    begin, data, offsets = offsets, hashes(data, starts, ends, BYTE), np.searchsorted(starts, offsets)
                # A text longer than a piece is cut into overlapping parts; each window is in one of them.
                step = most if end - at == 1 and len(data) > 2 * most else max(1, len(data))
                for low in range(0, max(1, len(data)), step):
                    part = data[low : low + step + length - 1] if step < len(data) else data
                    bounds = offsets if step >= len(data) else np.array([0, len(part)])
                    s = segments(part, bounds, length, anchors)
                    if not len(s["row"]):
                        continue
                    row, absolute = s["row"] + at, low + s["start"] - bounds[s["row"]]
                    own = many.take(pa.array(row)).to_numpy(zero_copy_only=False)
                    if words:
                        word = low + s["start"]
                        own = own | _covered(batch.column(5), row, starts[word] - begin[s["row"]], ends[word + s["windows"] + (length - 2)] - begin[s["row"]])
                    order = np.lexsort((absolute, s["content"], s["key"], row))
                    row, own, key, content = row[order], own[order], s["key"][order], s["content"][order]
                    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
                    group = np.cumsum(new) - 1
                    several = np.bincount(group)[group] > 1
                    absolute, windows, place = absolute[order] * unit, (s["windows"][order] - 1) * unit + 1, s["place"][order] * unit
                    marks = several & ~own
                    keep = np.concatenate((np.flatnonzero(new), np.flatnonzero(marks)))
                    is_mark = np.arange(len(keep)) >= new.sum()
                    flags = np.logical_or.reduceat(own, np.flatnonzero(new)) | (np.bincount(group) > 1)
                    take = pa.array(row[keep])
                    b = np.asarray(base.take(take))
                    columns = [
                        pa.array(key[keep], mask=is_mark), ids.take(take), rk.take(take), pa.array(b), pa.array(b + absolute[keep]),
                        pa.array(windows[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(np.where(is_mark, True, np.append(flags, np.zeros(marks.sum(), bool)))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=_E.fieldNames())

    return strings.select("doc_id", "rk", "base", "many", "text", *["known"] * words).mapInArrow(run, _E)


def _file():
    """A nameless file in the folder that Spark gives this worker."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def _turn(group: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The stable order by (group, symbol), as two passes of a radix sort."""
    first = np.argsort(symbol, kind="stable")
    return first[np.argsort(group[first], kind="stable")]


def _minima(common: np.ndarray, left: np.ndarray, right: np.ndarray, spread: int) -> np.ndarray:
    """The least of *common* in each range left..right, from minima over 2, 4, ... neighbours."""
    low = [common]
    for k in range(spread):
        step, before = 1 << k, low[-1]
        after = before.copy()
        after[:-step] = np.minimum(before[:-step], before[step:])
        low.append(after)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    stack = np.stack(low)
    return np.minimum(stack[level, left], stack[level, right - (1 << level) + 1])


def _build(texts: list[bytes], group: np.ndarray, lead: np.ndarray, size: np.ndarray, transform, prefixes) -> int:
    """Writes the columns of the transform and of the common prefixes, the last column first; their number."""
    m = len(texts)
    width = int((lead + size).max())
    grid = np.zeros((width, m), np.uint16)  # by column; 0 where a string has no symbol
    total = np.concatenate(([0], np.cumsum(size)))
    column = np.arange(total[-1], dtype=np.int32) + np.repeat((lead - total[:-1]).astype(np.int32), size)
    grid[column, np.repeat(np.arange(m, dtype=np.int32), size)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    order, common = np.arange(m), np.zeros(m, np.int32)  # common[i]: shared prefix of the suffixes at i-1 and i
    spread = max(1, int(np.bincount(group).max() - 1).bit_length())
    for column in range(width - 1, -1, -1):
        symbol = grid[column][order]
        transform.write(symbol.tobytes())
        of = group[order]
        turn = _turn(of, symbol)
        ranked, of = symbol[turn], of[turn]
        joined = (ranked[1:] == ranked[:-1]) & (of[1:] == of[:-1]) & (ranked[1:] > 0)
        new = np.zeros(m, np.int32)
        if joined.any():
            # Two neighbours share what all between their places in the last column share.
            new[1:][joined] = 1 + _minima(common, turn[:-1][joined] + 1, turn[1:][joined], spread)
        order, common = order[turn], new
        prefixes.write(common.tobytes())
    return width


def construct(texts: list[bytes], group: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What strings of a group share: runs of windows that another one has too (string, first start, last start), by
    string; whether a string is the first of those that equal it; whether there are several of these.

    *group* must be in order; *place* is where each string's anchor begins. Only windows at one distance from the
    anchor are compared.
    """
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    lead = place.max() - place
    group = group.astype(np.uint16 if group[-1] < 1 << 16 else np.uint32)
    begins = set(lead.tolist())
    first, several = np.zeros(m, bool), np.zeros(m, bool)
    with _file() as transform, _file() as prefixes:
        width = _build(texts, group, lead, size, transform, prefixes)
        transform.seek(0)
        prefixes.seek(0)
        found, order = np.zeros((width + 2, m), bool), np.arange(m)
        for column in range(width - 1, -1, -1):
            symbol = np.frombuffer(transform.read(2 * m), np.uint16)
            order = order[_turn(group[order], symbol)]
            common = np.frombuffer(prefixes.read(4 * m), np.int32)
            near = common >= length
            if near.any():
                near[:-1] |= near[1:]
                found[column + 1, order[near]] = True
            if column in begins:
                left = (lead + size - column)[order]
                same = np.zeros(m, bool)  # as a whole the string before, from this column on
                same[1:] = (common[1:] == left[1:]) & (left[1:] == left[:-1]) & (left[1:] > 0)
                here = np.flatnonzero(lead[order] == column)
                kind = np.cumsum(~same)[here]
                _, at, of, count = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
                first[order[here[at]]] = True
                several[order[here]] = count[of] > 1
    edge = found[1:] != found[:-1]
    string, turn = np.nonzero(edge.T)
    return string[::2], turn[::2] - lead[string[::2]], turn[1::2] - 1 - lead[string[::2]], first, several


_S = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "doc_id", "rk", "pos", "e")] + [T.StructField("place", T.IntegerType()), T.StructField("many", T.BooleanType()), T.StructField("text", T.BinaryType())])


def _collection(t: pa.Table, length: int, more_than: int) -> Iterator[pa.RecordBatch]:
    """Rows without a key: spans of windows found repeated. Rows with one: one string of those that are equal.

    Of anchors with up to *more_than* strings all are here, so that none of them goes on.
    """
    t = t.combine_chunks()
    key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
    order = np.lexsort((salt, key))
    key, salt = key[order], salt[order]
    new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    single, order = order[alone], order[~alone]
    many = t.column("many").to_numpy(zero_copy_only=False).copy()
    stay = single
    if len(order):
        group = np.unique(group[~alone], return_inverse=True)[1]
        texts = t.column("text").take(pa.array(order)).to_pylist()
        string, start, end, first, several = construct(texts, group, t.column("place").to_numpy()[order].astype(np.int64), length)
        wanted = ~many[order][string]
        string, start, end = order[string[wanted]], start[wanted], end[wanted]
        if len(string):
            pick, pos = pa.array(string), t.column("pos").to_numpy()[string]
            none = [pa.nulls(len(string), k) for k in (pa.int64(), pa.int32(), pa.bool_(), pa.binary())]
            yield pa.RecordBatch.from_arrays([none[0], none[0], *(t.column(c).take(pick).combine_chunks() for c in ("doc_id", "rk")), pa.array(pos + start), pa.array(pos + end + length), *none[1:]], names=_S.fieldNames())
        many[order] |= several
        stay = np.concatenate((single, order[first]))
    stay = np.sort(stay)
    stay = stay[t.column("n").to_numpy()[stay] > more_than]
    pick = pa.array(stay)
    out = {c: t.column(c).take(pick).combine_chunks() for c in ("key", "n", "doc_id", "rk", "pos", "place", "text")}
    out |= {"e": pa.nulls(len(stay), pa.int64()), "many": pa.array(many[stay])}
    yield from pa.Table.from_pydict({c: out[c] for c in _S.fieldNames()}).to_batches(max_chunksize=1000)


def _settled(rows: DataFrame, length: int, whole: bool) -> DataFrame:
    """Collections of *rows*; with *whole* rows come sorted by key and salt, and none of these is divided."""
    more_than = BOUND if whole else 0

    def run(batches):
        release_memos()
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("text")).nbytes
            if size <= COLLECTION:
                continue
            t = pa.Table.from_batches(held)
            if not whole:
                yield from _collection(t, length, more_than)
                held, size = [], 0
                continue
            total = np.cumsum([len(x.as_buffer()) for x in t.column("text")])
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            borders = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            at = 0
            while at < t.num_rows:
                done = total[at - 1] if at else 0
                fit = borders[(borders > at) & (total[borders - 1] - done <= COLLECTION)]
                cut = int(fit[-1]) if len(fit) else int(next(iter(borders[borders > at]), t.num_rows))
                if cut == t.num_rows or total[-1] - done <= COLLECTION:
                    break
                yield from _collection(t.slice(at, cut - at), length, more_than)
                at = cut
            rest = t.slice(at)
            held, size = rest.to_batches(), int(total[-1] - (total[at - 1] if at else 0))
        if held:
            yield from _collection(pa.Table.from_batches(held), length, more_than)

    return rows.select("key", "salt", "n", "doc_id", "rk", "pos", "place", "many", "text").mapInArrow(run, _S)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("rk"), raw.alias("text"))


def _word_texts(strings: DataFrame) -> DataFrame:
    """*strings* with the hashes of their words for texts."""

    def run(batches):
        release_memos()
        for batch in batches:
            yield from _in_words(batch)

    return strings.mapInArrow(run, strings.schema)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: what stands between blanks."""
    return runs(~BLANK[data], offsets)


def word_places(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of *raw* where the words are that *spans* cover whole in the text of their hashes."""
    starts, ends = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    whole = [(-(-s // _WORD), e // _WORD) for s, e in spans]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in whole]


def _shared(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """The segments whose anchor occurs more than once, with the number ``n`` of these; some of them are not marked yet."""
    rows = seen.filter("key IS NOT NULL")
    twice = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("many").alias("done")).filter("n >= 2 AND NOT done").drop("done"))
    return scratch.save(with_counted(rows, twice, "key", "n"))


def _rounds(found: DataFrame, length: int, last: bool, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Marks of the strings of each anchor, in collections, and the strings of anchors that no collection can hold."""
    marks, hot, number = [], None, 0
    while True:
        number += 1
        salt = F.pmod(F.xxhash64("doc_id", "rk", "pos", F.lit(number)), F.ceil(F.col("n") / BOUND))
        rows = found.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key", "salt")
        done = scratch.save(_settled(rows, length, whole=True))
        marks.append(scratch.save(done.filter("key IS NULL").select("doc_id", "rk", F.col("pos").alias("s"), "e")))
        left = done.filter("key IS NOT NULL")
        sizes = scratch.save(left.groupBy("key").agg(F.count("*").alias("m"), F.first("n").alias("before"), F.bool_and("many").alias("done")).filter("m >= 2 AND NOT done").drop("done"))
        if sizes.isEmpty():
            return marks, hot
        open_ = scratch.save(left.join(sizes, "key").withColumn("n", F.col("m")))
        scratch.drop(done)
        fewer = F.lit(last) | (F.col("m") <= BOUND) | (2 * F.col("m") <= F.col("before"))
        more = open_.filter(~fewer).select("doc_id", "rk", F.col("pos").alias("base"), "many", "text")
        hot = more if hot is None else hot.unionByName(more)
        found = open_.filter(fewer).select("key", "n", "doc_id", "rk", "pos", "place", "many", "text")
        if found.isEmpty():
            return marks, hot


def _spans_of(rows: DataFrame, doc_id: Column, rk: Column, spans: DataFrame) -> DataFrame:
    """*rows* with the other columns of *spans*, null where there are none."""
    spans = spans.withColumnsRenamed({"doc_id": "__foliant_d", "rk": "__foliant_k"})
    return rows.join(spans, doc_id.eqNullSafe(F.col("__foliant_d")) & (rk == F.col("__foliant_k")), "left").drop("__foliant_d", "__foliant_k")


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", words: bool = False, known: DataFrame | None = None) -> DataFrame:
    """doc_id, rk (hash of the row) and its spans of repeated windows, as an unmerged array of (s, e).

    With *words* the length is one in words, and the spans are places in the text of their hashes; what lies in the
    spans of bytes of *known*, a table of this kind with merged spans, may be left out.
    """
    scratch = Scratch(docs.sparkSession)
    plain = _keyed(docs, doc_id, text).select("doc_id", "rk", F.lit(0).cast("long").alias("base"), F.lit(False).alias("many"), "text")
    length = length * _WORD if words else length
    if words and known is None:
        plain = plain.withColumn("known", _none())
    elif words:
        plain = _spans_of(plain, F.col("doc_id"), F.col("rk"), known.withColumnRenamed("spans", "known")).withColumn("known", F.coalesce("known", _none()))
    strings, marks = plain, []
    for number, share in enumerate(LEVELS):
        coded = words and not number  # from the second level on strings are parts of the hashes of words
        # A third of a passage for an anchor: of the windows that a changed word divides fewer have one beside it.
        seen = scratch.save(_evidence(strings, length // _WORD, max(1, 2 * length // _WORD // 3), True) if coded else _evidence(strings, length, max(1, length * share // LENGTH)))
        marks.append(scratch.save(seen.filter("key IS NULL").select("doc_id", "rk", F.col("pos").alias("s"), (F.col("pos") + F.col("windows") + (length - 1)).alias("e"))))
        shared = _shared(seen, scratch)
        scratch.drop(seen)
        asked = shared.groupBy("doc_id", "rk", "base").agg(F.collect_set(F.struct("key", "many", "n", "pos", "windows", "place")).alias("r"))
        source = strings.select("doc_id", "rk", "base", "text")
        asked = asked.select(F.col("doc_id").alias("_d"), F.col("rk").alias("_k"), F.col("base").alias("_b"), "r")
        met = source.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rk") == F.col("_k")) & (F.col("base") == F.col("_b")))
        if coded:
            met = _word_texts(met.select("doc_id", "rk", "base", "r", "text"))
        piece = lambda r: F.col("text").substr((r["pos"] - F.col("base") + 1).cast("int"), r["windows"] + (length - 1))
        cut = F.transform("r", lambda r: F.struct(r["key"].alias("key"), r["many"].alias("many"), r["n"].alias("n"), r["pos"].alias("pos"), r["place"].alias("place"), piece(r).alias("text")))
        pieces_ = met.select("doc_id", "rk", F.explode(cut).alias("x")).select("doc_id", "rk", "x.*").withColumn("salt", F.lit(0).cast("long"))
        found = scratch.save(_settled(pieces_, length, whole=False))
        scratch.drop(shared)
        marks.append(scratch.save(found.filter("key IS NULL").select("doc_id", "rk", F.col("pos").alias("s"), "e")))
        more, hot = _rounds(found.filter("key IS NOT NULL"), length, number == len(LEVELS) - 1, scratch)
        scratch.drop(found)
        marks += more
        if hot is None or hot.isEmpty():
            break
        strings = hot
    scratch.sweep()
    union = marks[0]
    for m in marks[1:]:
        union = union.unionByName(m)
    return union.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones made one."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1])[: len(s)])
    return list(zip(s[new].tolist(), e[np.append(new[1:], len(s))[: len(new)] - 1].tolist(), strict=True))


def merged_rows(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """The merged spans of each row, read as arrays; a row may hold one for each of its windows."""
    bounds, values = column.offsets.to_numpy().tolist(), column.values  # of a slice only its own rows' offsets
    s, e = (values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield merged(s[a:b], e[a:b]) if b > a else []


def _merged_table(spans: DataFrame) -> DataFrame:
    """A table of ``repeated_spans`` with each row's spans merged."""

    def run(batches):
        for batch in batches:
            rows = list(merged_rows(batch.column(2)))
            flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(2)], names=["s", "e"])
            bounds = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(bounds, values)], names=batch.schema.names)

    return spans.mapInArrow(run, spans.schema)


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of *raw* without its spans."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b"".join(parts)


_SPANS, _WORD_SPANS = "__foliant_spans", "__foliant_word_spans"


def _none() -> Column:
    return F.array().cast("array<struct<s:bigint,e:bigint>>")


def _with_spans(docs: DataFrame, length: int, doc_id: str, text: str, words: int | None = None) -> DataFrame:
    """*docs* with the row's spans in one more column, and those of *words* words in another; none is an empty array."""
    found = repeated_spans(docs, length, doc_id, text)
    if words:
        found = Scratch(docs.sparkSession).save(_merged_table(found))
    spans = found.select("doc_id", "rk", F.col("spans").alias(_SPANS), _none().alias(_WORD_SPANS))
    if words:
        in_words = repeated_spans(docs, words, doc_id, text, words=True, known=found)
        spans = spans.unionByName(in_words.select("doc_id", "rk", _none().alias(_SPANS), F.col("spans").alias(_WORD_SPANS)))
        spans = spans.groupBy("doc_id", "rk").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in (_SPANS, _WORD_SPANS)])
    joined = _spans_of(docs.withColumn("__foliant_rk", F.xxhash64(F.col(doc_id), F.col(text))), F.col(doc_id).cast("long"), F.col("__foliant_rk"), spans)
    return joined.select(*docs.columns, *[F.coalesce(c, _none()).alias(c) for c in (_SPANS, _WORD_SPANS)])


def _both(raw: bytes, spans: list[tuple[int, int]], in_words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The merged spans of bytes of *raw* that its spans of bytes and of words cover."""
    if not in_words:
        return spans
    return merged(*np.array([*spans, *word_places(raw, in_words)], np.int64).T)


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """*docs* with repeated windows cut out of *text*; letters that a cut divides go whole.

    With *words* also what repeated runs of so many words cover, however short the words and whatever blanks part them.
    """
    place = docs.columns.index(text)

    def run(batches):
        release_memos()
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            columns = list(batch.columns[:-2])
            new = columns[place].to_pylist()
            for i, (spans, in_words) in enumerate(zip(*map(merged_rows, batch.columns[-2:]), strict=True)):
                if (spans or in_words) and new[i] is not None:
                    raw = new[i].encode()
                    new[i] = kept(raw, _both(raw, spans, in_words)).decode("utf-8", "ignore")
            columns[place] = pa.array(new, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    return _with_spans(docs, length, doc_id, text, words).mapInArrow(run, docs.schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PASSAGES = "n_repeated long, n_passages long"


def removal_digests(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """What ``without_repeats`` does to the bytes of each row, by strings of *length* bytes.

    With *words* also the bytes, and the number of their maximal runs, that such strings or repeated runs of so many
    words cover (``n_repeated``, ``n_passages``).
    """
    schema = T.StructType.fromDDL(DIGEST + (f", {PASSAGES}" if words else ""))
    names = schema.fieldNames()

    def run(batches):
        release_memos()
        for batch in batches:
            rows = []
            for raw, cuts, in_words in zip(batch.column(1), *map(merged_rows, batch.columns[2:]), strict=True):
                raw = raw.as_py() or b""
                both = _both(raw, cuts, in_words)
                rows.append((len(raw), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(kept(raw, cuts)).hexdigest(), sum(e - s for s, e in both), len(both)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string() if n == "kept_sha256" else pa.int64() for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    rows = _with_spans(docs.select("doc_id", "text"), length, "doc_id", "text", words)
    return rows.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8"), _SPANS, _WORD_SPANS).mapInArrow(run, schema)


def op5_column_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 400 bytes cover which occur elsewhere too.

    What passages of over 50 words cover, most of which are shorter than 400 bytes, is told in two further columns.
    """
    return removal_digests(table(spark, sf_dir, "documents"), words=PASSAGE)


QUERIES = {"op5_column_repeats": op5_column_repeats}
