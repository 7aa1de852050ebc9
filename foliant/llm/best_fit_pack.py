"""Packing documents into as few sequences as may be: best-fit decreasing, certified by lower bounds, repacked by exchange.

A document's ids are cut only where they are more than a sequence holds. Pieces of a task are packed in blocks by
best-fit decreasing: the longest first, each into the fullest sequence that has room for it. Dual feasible functions
(which never sum to more than 1 over what fits in a sequence) bound the number of sequences from below; a block
that needs no more is certified and gives away only sequences with large gaps, another one gives away all that have a
gap. What is given away is dealt into new blocks and packed anew, as long as that takes fewer sequences and blocks are not
certified as a whole.

The pass over the texts is map-only; what is exchanged are rows of a few numbers. A block holds BLOCK pieces, and only
sequences with gaps move.

Defined results: a null text is an empty one and still holds the closing id; rows with a null id are packed like
others, repeated rows once each; among pieces of one length the order is that of the input; an empty table gives an
empty one; texts are read whole however long (a text's ids are in memory at once); columns other than id and text are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.byte_words import pieces
from foliant.llm.differencing_pack import CLOSING, unit_ids
from foliant.llm.scratch import Scratch
from foliant.llm.vocabularies import trim, vocabulary
from foliant.sources.tables import table

CAPACITY = 4096
#: Pieces that are packed together.
BLOCK = 16384
#: A certified block's sequences move if their gap is this share of the capacity or more.
LARGE_GAP = 1 / 16
ROUNDS = 6


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, the longest items first, each in the fullest bin that has room for it."""
    out = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # rooms: bit r is set where a bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, made
            made += 1
        out[i] = bin_
        left = room - size
        by_room[left].append(bin_)
        rooms |= 1 << left
    return out


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the largest of the sums of dual feasible functions, in whole numbers.

    The functions: the size itself; sizes rounded to k-ths where k+1 times the size is not whole (k to 100); for each
    threshold, sizes that leave less than it count as a bin and smaller ones as nothing; for each threshold, sizes up to
    half count by how many of the threshold fit in a bin, larger ones as a bin less what fits beside them.
    """
    if not len(sizes):
        return 0
    w, n = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    best = -(-int((w * n).sum()) // capacity)
    for k in range(1, 101):
        whole = (k + 1) * w % capacity == 0
        value = np.where(whole, w * k, (k + 1) * w // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for t in w[w <= capacity // 2].tolist():
        value = np.where(w > capacity - t, capacity, np.where(w < t, 0, w))
        best = max(best, -(-int((value * n).sum()) // capacity))
        per = capacity // t
        value = np.where(2 * w > capacity, 2 * (per - (capacity - w) // t), np.where(2 * w == capacity, per, np.where(w >= t, 2, 0)))  # in units of 1 / (2 * per)
        best = max(best, -(-int((value * n).sum()) // (2 * per)))
    return best


def settled(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's pieces: bin, place in it, the bin's gap, and whether the bin is given away."""
    bins = best_fit(sizes, capacity)
    gap = capacity - np.bincount(bins, sizes, minlength=1).astype(np.int64)
    least = capacity * LARGE_GAP if len(gap) == lower_bound(sizes, capacity) else 1
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.searchsorted(bins[order], bins[order])
    offset = np.empty(len(sizes), np.int64)
    offset[order] = before - before[first] if len(sizes) else before
    return bins, offset, gap[bins], (gap >= least)[bins]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long, gap long, moves boolean"


def _placed(rows: list[np.ndarray], ids: pa.Array, first: int, capacity: int) -> tuple[list, int]:
    """Columns of _PLACED for a block, and the number of its bins."""
    bins, offset, gap, moves = settled(rows[2], capacity)
    return [ids, pa.array(rows[0].astype(np.int32)), *[pa.array(x) for x in (*rows[1:], first + bins, offset, gap, moves)]], int(bins.max(initial=-1)) + 1


def cut_and_packed(docs: DataFrame, name: str, directory: str | None, capacity: int, block: int) -> DataFrame:
    """Pieces of all documents, packed within their tasks."""

    def run(batches):
        from pyspark import TaskContext

        trim()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = unit_ids(vocabulary(name, directory))
        made = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        closing = np.array([CLOSING], "<u4").tobytes()
        names = [f.split()[0] for f in _PLACED.split(", ")]

        def settle(rows):
            nonlocal made
            cols = list(zip(*rows, strict=True))
            out, n = _placed([np.array(c, np.int64) for c in cols[1:]], pa.array(cols[0], pa.int64()), made, capacity)
            made += n
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            for at, end, data, offsets in pieces(batch.column(1), 1 << 20):
                flat, bounds = known.encode(data, offsets)
                raw, bounds = flat.astype("<u4").tobytes(), bounds.tolist()
                for k, doc in enumerate(batch.column(0).slice(at, end - at).to_pylist()):
                    ids = raw[4 * bounds[k] : 4 * bounds[k + 1]] + closing
                    for number, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        waiting.append((doc, number, start, len(part) // 4, zlib.crc32(part)))
            while len(waiting) >= block:
                yield settle(waiting[:block])
                del waiting[:block]
        if waiting:
            yield settle(waiting)

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).mapInArrow(run, _PLACED)


def exchanged(moving: DataFrame, turn: int, blocks: int, capacity: int) -> DataFrame:
    """What is given away, dealt into *blocks* new blocks by a hash of its place and packed there."""
    names = [f.split()[0] for f in _PLACED.split(", ")]

    def repack(key, t):
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        cols, _ = _placed([t.column(n).to_numpy().astype(np.int64) for n in names[1:5]], t.column(0).combine_chunks(), turn << 56 | key[0].as_py() << 24, capacity)
        return pa.table(cols, names=names)

    dealt = moving.withColumn("_to", F.pmod(F.xxhash64(F.col("sequence_id"), F.lit(turn)), F.lit(blocks)))
    return dealt.groupBy("_to").applyInArrow(repack, _PLACED)


def best_fit_packed(docs: DataFrame, name: str = "word_bpe_49k.json", directory: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """One row for each piece of each document's ids; see the module's description."""
    scratch = Scratch(docs.sparkSession)
    now = scratch.save(cut_and_packed(docs, name, directory, capacity, block))
    done = []
    for turn in range(1, rounds + 1):
        moving = now.filter("moves")
        told = moving.agg(F.count("*").alias("pieces"), F.count_if(F.col("offset") == 0).alias("bins"), F.sum("length").alias("ids")).first()
        if not told["pieces"] or told["bins"] <= -(-told["ids"] // capacity):
            break  # as few as their ids need
        packed = scratch.save(exchanged(moving, turn, -(-told["pieces"] // block), capacity))
        if packed.filter("offset = 0").count() >= told["bins"]:
            break
        done.append(now.filter("NOT moves"))
        now = packed
    out = now
    for d in done:
        out = out.unionByName(d)
    return out.drop("gap", "moves")


def op13_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into few sequences of at most 4096 ids."""
    return best_fit_packed(table(spark, sf_dir, "documents"))


QUERIES = {"op13_best_fit_pack": op13_best_fit_pack}
