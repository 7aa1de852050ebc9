"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; the rest is cut into pieces of at most PIECE ids, as even
as may be. Blocks of pieces are then partitioned into as many windows as their ids need: the two partial
partitions with the largest imbalance are merged again and again, the fullest part of one with the emptiest of
the other, which gives near-equal windows. Where a window would hold more than its capacity, the block is
partitioned anew into more windows.

Everything happens within a task, block by block, so it is one map-only pass whose memory does not depend on the
input. A window's id is made of the task's number and its own within the task, which a task that runs again
repeats.

Defined results: a null text is an empty one and still holds the closing id; repeated rows are packed once each, null ids
like others; an empty table gives an empty one; texts are read whole however long (a text's ids are in memory at once);
columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.byte_words import BASE, BYTE, distinct, hashes, mix, pieces, spans
from foliant.llm.prefix_bpe import byte_symbols
from foliant.llm.vocabularies import MEMO_ENTRIES, trim, vocabulary
from foliant.sources.tables import table

CAPACITY = 2048
#: Most ids in a piece of what is left after whole windows; smaller pieces balance better.
PIECE = 512
#: Pieces that are partitioned together.
BLOCK = 1024
CLOSING = 1


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """The part (0 to m-1) of each item in a multiway differencing partition into *m* parts."""
    n = len(sizes)
    if m <= 1:
        return np.zeros(n, np.int64)
    left, right = [-1] * n, [-1] * n  # a set is an item or a union of two sets
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, sa = heapq.heappop(heap)
        _, _, b, sb = heapq.heappop(heap)
        ka, kb = len(a), len(b)
        over = ka + kb - m
        if over <= 0:
            sums, sets = np.concatenate((a, b)), np.concatenate((sa, sb))
        else:  # a's smallest parts take b's largest in opposite order; the others stay alone
            low, high = ka - over, kb - over
            x, y = sa[low:], sb[high:][::-1]
            first = len(left)
            left.extend(x.tolist())
            right.extend(y.tolist())
            sums = np.concatenate((a[:low], a[low:] + b[high:][::-1], b[:high]))
            sets = np.concatenate((sa[:low], np.arange(first, first + over), sb[:high]))
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        if len(sums) == m:
            sums = sums - sums[-1]
        turn += 1
        heapq.heappush(heap, (-int(sums[0]), turn, sums, sets))
    out = np.zeros(n, np.int64)
    for part, top in enumerate(heap[0][3].tolist()):
        stack = [top]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = part
            else:
                stack += (left[x], right[x])
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, none over *capacity*; the number of windows rises until that holds."""
    total = int(sizes.sum())
    m = max(1, -(-total // capacity))
    while True:
        part = differencing(sizes, m)
        if np.bincount(part, sizes, minlength=1).max(initial=0) <= capacity:
            return part
        m += max(1, m // 250)


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of *n* ids."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest, at = n - whole * capacity, whole * capacity
    for k in range(parts := -(-rest // piece)):
        size = rest * (k + 1) // parts - rest * k // parts
        out.append((at, size))
        at += size
    return out


class UnitIds:
    """Ids of texts by the tokenizers library, which is asked once for each distinct unit.

    A unit is what stands between blanks (20, 09, 0A, 0D), cut once more before each comma or stop that follows an
    ASCII letter; no token of ``word_bpe_49k`` crosses such a place. Units are told apart by a 64-bit hash without
    regard to the case of A-Z, which the tokenizer drops as well; where a special token's string could stand ("<"),
    case counts.
    """

    def __init__(self, path: str, entries: int = 3 * MEMO_ENTRIES):
        from tokenizers import Tokenizer

        self.library, self.entries = Tokenizer.from_file(path), entries
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.symbols = self.library.model, byte_symbols()
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, keys: list[int], ids: np.ndarray, size: np.ndarray) -> None:
        n, first = len(keys), len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while first + n > len(self.size):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[first : first + n] = size
        self.start[first : first + n] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.place.update(zip(keys, range(first, first + n), strict=True))

    def _learn(self, keys: list[int], units: list[str]) -> None:
        flat, size = [], []
        for u in units:
            got = self._word(u) if u.isalpha() else self.library.encode(u, add_special_tokens=False).ids
            flat += got
            size.append(len(got))
        self._store(keys, np.array(flat, np.uint32), np.array(size, np.int64))

    def _word(self, unit: str) -> list[int]:
        """Ids of a unit of letters: the tokenizer's own steps, which make one pre-token of it, before its model."""
        if unit.isascii():
            return [t.id for t in self.model.tokenize(unit.lower())]
        low = "".join([c.lower() for c in unicodedata.normalize("NFC", unit)])
        if not low.isalpha():
            return self.library.encode(unit, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize("".join([self.symbols[b] for b in low.encode("utf-8")]))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts one after another, and n+1 offsets into them."""
        letter = self.letters[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = letter[:-1] & self.stops[data[1:]]
        starts, ends = spans(~self.blanks[data], offsets, cut)
        key = hashes(data, starts, ends)
        signs = data == 60
        if signs.any() and len(starts):
            odd = np.logical_or.reduceat(signs, starts)
            key = np.where(odd, mix(hashes(data, starts, ends, BYTE) + BASE), key)
        found, first, inverse = distinct(key)
        keys = found.tolist()
        if len(self.place) + len(keys) > self.entries:
            self.forget()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            raw, at = data.tobytes(), first[new]
            units = [raw[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn([keys[i] for i in new], units)
        entry = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[inverse]
        size = self.size[entry]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.arange(total[-1], dtype=np.int32) + np.repeat((self.start[entry] - total[:-1]).astype(np.int32), size)]
        return flat, total[np.searchsorted(starts, offsets)]

    blanks, letters, stops = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    blanks[[32, 9, 10, 13]] = True
    letters[[*range(65, 91), *range(97, 123)]] = True
    stops[[44, 46]] = True


@lru_cache(maxsize=2)
def unit_ids(path: str) -> UnitIds:
    return UnitIds(path)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, name: str = "word_bpe_49k.json", directory: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """One row for each piece of each document's ids; see the module's description."""

    def run(batches):
        import os

        from pyspark import TaskContext

        from foliant.llm.differencing_pack import unit_ids

        trim()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = unit_ids(vocabulary(name, directory))
        task = TaskContext.get().partitionId() << 32
        made = 0
        waiting: list[tuple] = []
        closing = np.array([CLOSING], "<u4").tobytes()

        def settle(rows):
            nonlocal made
            part = windows(np.array([r[2] for r in rows], np.int64), capacity)
            fill = {}
            out = []
            for r, p in sorted(zip(rows, part.tolist(), strict=True), key=lambda x: x[1]):
                at = fill.get(p, 0)
                fill[p] = at + r[2]
                out.append((*r, task + made + p, at))
            made += int(part.max(initial=-1)) + 1
            return out

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            done = []
            for at, end, data, offsets in pieces(batch.column(1), 1 << 20):
                flat, bounds = known.encode(data, offsets)
                raw, bounds = flat.astype("<u4").tobytes(), bounds.tolist()
                for k, doc in enumerate(batch.column(0).slice(at, end - at).to_pylist()):
                    ids = raw[4 * bounds[k] : 4 * bounds[k + 1]] + closing
                    n = len(ids) // 4
                    for start, size in cuts(n, capacity, piece):
                        row = (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n)
                        if size == capacity:
                            done.append((*row, task + made, 0))
                            made += 1
                        else:
                            waiting.append(row)
                while len(waiting) >= block:
                    done += settle(waiting[:block])
                    del waiting[:block]
            yield batch_of(done)
        if waiting:
            yield batch_of(settle(waiting))

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).mapInArrow(run, PACKED)


def op2_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_differencing_pack": op2_differencing_pack}
