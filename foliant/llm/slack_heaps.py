"""Compressing vectors to a code for each of their parts by Lloyd rounds over heaps of slack.

A vector of whole numbers is cut into parts; each position has a codebook of entries. A part's slack is the distance
to its second nearest entry less that to its nearest. When entries move, a part's nearest can change only once its
entry's move and the farthest other entry's move, summed over the rounds, have used the slack up. So each block of a
partition keeps, for each position and entry, a heap of its parts ordered by slack plus that sum at the time of the
scan: a round pops what the sum has reached, scans exactly those parts against all entries, and pushes them on their
entries' heaps. Heaps whose root still holds are not touched. Keys are rounded down and sums up, so that no part is
left out; the scan itself is in exact whole numbers.

A block is one row: ids, labels and vectors, codes, and the heaps as they stand in memory. Each round writes the
blocks anew and with them the sums and counts that moved between entries, which Spark adds up: what reaches the driver
is one row for each entry. A lost executor costs its part of one round.

Defined results: rows whose vector is null, empty, or holds null or non-finite components take no part, nor do those of
another length than the vector with the smallest id (nulls last); a length that PARTS does not divide is filled up with
zeros; fewer rows than entries make as many entries; rows with a null id are coded like others; repeated rows are coded
once each and count once each; rows with null labels form one label of their own; columns of other names are not read.
An empty table gives an empty one. A component beyond what keeps squared distances exact (2**23 at 32 components to a part)
is an error.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.scratch import Scratch, rows_at_once
from foliant.llm.skew import with_counted
from foliant.llm.whole_vectors import finite, floored, matrix, of_one_length
from foliant.sources.tables import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, as a power of two; a heap's item is a key and a row's place in its block.
BITS = 13
#: Units of a distance in keys.
UNIT = 1024
#: Blocks that go to a Python worker at once, and bytes of a row group of them.
BLOCKS_AT_ONCE, GROUP_BYTES = 8, 16 << 20
_STRIP = 4096


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each part's nearest entry (ties to the lower index), its squared distance, and that of the second nearest."""
    best, near, second = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    square = (book * book).sum(1)
    for at in range(0, len(x), _STRIP):
        part = x[at : at + _STRIP]
        d = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + square
        i, rows = d.argmin(1), np.arange(len(part))
        best[at : at + _STRIP], near[at : at + _STRIP] = i, d[rows, i]
        if d.shape[1] > 1:
            d[rows, i] = np.inf
            second[at : at + _STRIP] = d.min(1)
    return best, near, second


@dataclass
class Books:
    """The entries of each position, and how far each entry's parts may have lost slack since the start."""

    entries: np.ndarray  # position, entry, component
    lost: np.ndarray = field(default=None)  # position, entry

    def __post_init__(self):
        if self.lost is None:
            self.lost = np.zeros(self.entries.shape[:2])

    def moved(self, entries: np.ndarray) -> Books:
        """The books after a round: entries put in place of the old ones, their moves added to what is lost."""
        drift = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(2))
        ranked = np.sort(drift, axis=1)
        most, next_most = ranked[:, -1:], ranked[:, -2:-1] if drift.shape[1] > 1 else np.zeros((len(drift), 1))
        others = np.where(drift == most, np.where((ranked == most).sum(1, keepdims=True) > 1, most, next_most), most)
        return Books(entries, self.lost + drift + others)


class Block:
    """Rows of one block with their codes and heaps."""

    def __init__(self, vectors: np.ndarray, parts: int, codes: np.ndarray | None = None, heaps: list[list] | None = None):
        self.vectors, self.parts, self.n = vectors, parts, len(vectors)
        self.x = [p.astype(float) for p in np.split(vectors, parts, axis=1)]
        self.codes, self.heaps = codes, heaps  # heaps: by position and entry an array in heap order

    def assign(self, books: Books) -> list[tuple[int, int, int, list[int]]]:
        """Assigns every part to its nearest entry; position, entry, count and sums of what came to or left an entry."""
        first = self.codes is None
        if first:
            self.codes, self.heaps = np.zeros((self.parts, self.n), np.uint8), [[np.zeros(0, np.int64)] * books.entries.shape[1] for _ in range(self.parts)]
        changes = []
        for p in range(self.parts):
            limits = (np.ceil(books.lost[p] * UNIT).astype(np.int64) + 1) << BITS
            rows = np.arange(self.n) if first else self._popped(p, limits)
            if not len(rows):
                continue
            best, near, second = scan(self.x[p][rows], books.entries[p].astype(float))
            self._push(p, rows, best, np.sqrt(second) - np.sqrt(near) + books.lost[p][best])
            old = self.codes[p][rows]
            self.codes[p][rows] = best
            went = rows if first else rows[old != best]
            count, sums = np.zeros(len(limits), np.int64), np.zeros((len(limits), self.x[p].shape[1]), np.int64)
            values = self.vectors[went][:, p * sums.shape[1] : (p + 1) * sums.shape[1]].astype(np.int64)
            to = self.codes[p][went]
            np.add.at(count, to, 1)
            np.add.at(sums, to, values)
            if not first:
                away = old[old != best]
                np.subtract.at(count, away, 1)
                np.subtract.at(sums, away, values)
            changes += [(p, e, int(count[e]), sums[e].tolist()) for e in np.flatnonzero((count != 0) | (sums != 0).any(1)).tolist()]
        return changes

    def _popped(self, p: int, limits: np.ndarray) -> np.ndarray:
        out = []
        for e, heap in enumerate(self.heaps[p]):
            limit = int(limits[e])
            if not len(heap) or heap[0] >= limit:
                continue
            items = heap.tolist()
            while items and items[0] < limit:
                out.append(heapq.heappop(items) & ((1 << BITS) - 1))
            self.heaps[p][e] = np.array(items, np.int64)
        return np.array(sorted(out), np.int64)

    def _push(self, p: int, rows: np.ndarray, entries: np.ndarray, slack: np.ndarray) -> None:
        keys = np.floor(np.minimum(slack, 2.0**36) * UNIT).astype(np.int64) - 1
        items = keys << BITS | rows
        order = np.lexsort((items, entries))
        items, entries = items[order], entries[order]
        cut = np.flatnonzero(np.diff(entries)) + 1
        for new, e in zip(np.split(items, cut), entries[np.concatenate(([0], cut))].tolist(), strict=True):
            if len(self.heaps[p][e]):
                heap = self.heaps[p][e].tolist()
                for item in new.tolist():
                    heapq.heappush(heap, item)
                new = np.array(heap, np.int64)
            self.heaps[p][e] = new  # in order, so a heap

    def errors(self, books: Books) -> np.ndarray:
        """Squared distances of each row's parts from their entries, summed."""
        return sum(((x - books.entries[p][self.codes[p]]) ** 2).sum(1) for p, x in enumerate(self.x)).astype(np.int64)

    def columns(self) -> list[bytes]:
        heaps = [h for position in self.heaps for h in position]
        return [self.vectors.tobytes(), self.codes.tobytes(), np.array([len(h) for h in heaps], np.int32).tobytes(), np.concatenate(heaps).tobytes()]

    @classmethod
    def read(cls, n: int, parts: int, vectors: bytes, codes: bytes, sizes: bytes, items: bytes) -> Block:
        cut = np.split(np.frombuffer(items, np.int64), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])
        each = len(cut) // parts
        return cls(np.frombuffer(vectors, np.int32).reshape(n, -1), parts, np.frombuffer(codes, np.uint8).reshape(parts, n).copy(), [cut[p * each : (p + 1) * each] for p in range(parts)])


_STATE = [("vectors", T.BinaryType()), ("codes", T.BinaryType()), ("sizes", T.BinaryType()), ("items", T.BinaryType())]
_CHANGES = "array<struct<part:int,entry:int,n:bigint,sums:array<bigint>>>"
_CHANGED = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


@dataclass(frozen=True)
class Compressed:
    """Codes of all rows (vec_id, label, code, error), and the final entries by position, entry and component."""

    rows: DataFrame
    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, scratch: Scratch, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codebooks of at most *entries* (256) entries fitted to all rows in *rounds* rounds, and each row's codes under them."""
    usable = vectors.filter(finite(F.col(vector))).select(F.col(vec_id).cast("long").alias("_id"), F.col(label).alias("_l"), floored(F.col(vector), scale).alias("_v"))
    usable, dim = of_one_length(usable, "_id", "_v")
    labels, width = usable.schema["_l"].dataType, -(-dim // parts)
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", labels), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not dim:
        return Compressed(vectors.sparkSession.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64))
    start = np.array([r[0] for r in usable.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()])
    largest = int((2.0**53 / (8 * width)) ** 0.5)

    def filled(v: np.ndarray) -> np.ndarray:
        if np.abs(v).max(initial=0) > largest:
            raise OverflowError(f"a component of {np.abs(v).max():.0f} is over {largest}, beyond which distances are not exact")
        return np.pad(v, ((0, 0), (0, parts * width - dim))).astype(np.int32)

    books = Books(np.stack(np.split(filled(start).astype(np.int64), parts, axis=1)))

    def first_blocks(batches, books=books):
        waiting, rows = [], 0

        def settle(made: pa.Table) -> pa.RecordBatch:
            block = Block(filled(matrix(made.column("_v"))), parts)
            changes = block.assign(books)
            return as_row(made.column("_id").combine_chunks(), made.column("_l").combine_chunks(), block, changes)

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            while rows >= 1 << BITS:
                whole = pa.Table.from_batches(waiting)
                yield settle(whole.slice(0, 1 << BITS))
                waiting, rows = whole.slice(1 << BITS).to_batches(), rows - (1 << BITS)
        if rows:
            yield settle(pa.Table.from_batches(waiting))

    def as_row(ids: pa.Array, names: pa.Array, block: Block, changes: list) -> pa.RecordBatch:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks))
        cells = [pa.array([b], pa.binary()) for b in block.columns()]
        told = pa.array([[dict(zip(("part", "entry", "n", "sums"), c, strict=True)) for c in changes]], _CHANGED)
        return pa.RecordBatch.from_arrays([one(ids), one(names), *cells, told], names=["ids", "labels", *[n for n, _ in _STATE], "changes"])

    def blocks_of(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            ids, names = batch.column(0)[i].values, batch.column(1)[i].values
            yield ids, names, Block.read(len(ids), parts, *[batch.column(c)[i].as_py() for c in range(2, 6)])

    def a_round(books: Books):
        def run(batches):
            for batch in batches:
                for ids, names, block in blocks_of(batch):
                    changes = block.assign(books)
                    yield as_row(ids, names, block, changes)

        return run

    def last(books: Books):
        def run(batches):
            for batch in batches:
                for ids, names, block in blocks_of(batch):
                    block.assign(books)
                    raw = np.ascontiguousarray(block.codes.T).tobytes().hex()
                    codes = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
                    yield pa.RecordBatch.from_arrays([ids, names, pa.array(codes), pa.array(block.errors(books))], names=out.fieldNames())

        return run

    state = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(labels)), *[T.StructField(n, t) for n, t in _STATE], T.StructField("changes", T._parse_datatype_string(_CHANGES))])
    total, count = np.zeros(books.entries.shape, object), np.zeros(books.entries.shape[:2], object)
    blocks = None
    for _ in range(rounds):
        with rows_at_once(vectors.sparkSession, BLOCKS_AT_ONCE if blocks is not None else None):
            made = scratch.save(usable.mapInArrow(first_blocks, state) if blocks is None else blocks.mapInArrow(a_round(books), state), {"parquet.block.size": GROUP_BYTES})
        if blocks is not None:
            scratch.drop(blocks)
        blocks = made.select(*[f.name for f in state.fields if f.name != "changes"])
        blocks._scratch_path = made._scratch_path
        sums = made.select(F.explode("changes").alias("c")).groupBy("c.part", "c.entry").agg(F.sum("c.n").alias("n"), F.array(*[F.sum(F.col("c.sums")[i]) for i in range(width)]).alias("s"))
        for r in sums.collect():  # a row for each entry
            count[r["part"], r["entry"]] += r["n"]
            total[r["part"], r["entry"]] += np.array(r["s"], object)
        entries_now = books.entries.copy()
        for p, e in np.argwhere(count > 0).tolist():
            entries_now[p, e] = [s // int(count[p, e]) for s in total[p, e].tolist()]
        books = books.moved(entries_now)
    with rows_at_once(vectors.sparkSession, BLOCKS_AT_ONCE):
        rows = scratch.save(blocks.mapInArrow(last(books), out))
    scratch.drop(blocks)
    return Compressed(rows, books.entries[:, :, :width])


def with_label_errors(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """*rows* with the error summed over equal labels, nulls together, as ``label_error``."""
    keyed = rows.withColumn("_key", F.to_json(F.struct(F.col("label"))))
    sums = scratch.save(keyed.groupBy("_key").agg(F.count("*").alias("_rows"), F.sum("error").alias("label_error")))
    return with_counted(keyed, sums, "_key", "_rows").drop("_key", "_rows")


def op11_slack_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings under four codebooks of 256 entries."""
    scratch = Scratch(spark)
    done = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), scratch)
    return with_label_errors(done.rows, scratch).select("vec_id", "code", "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))


QUERIES = {"op11_slack_heaps": op11_slack_heaps}


def _sql() -> str:
    square = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        """v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, vec_id, label, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS x FROM v, range(4) t(part)),
b0 AS MATERIALIZED (
  SELECT part, entry, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, x) - 1 AS entry, x FROM p) WHERE entry < 256)""",
    ]
    for i in range(5):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p.part, min(struct_pack(d := {square}, entry := b.entry)) AS near FROM p JOIN b{i} b ON p.part = b.part GROUP BY ALL)")
        if i < 4:
            steps.append(f"""s{i} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
  FROM (SELECT a.part, a.near.entry AS entry, i, CAST(sum(p.x[i]) AS BIGINT) AS s, count(*) AS n
        FROM a{i} a JOIN p ON a.r = p.r AND a.part = p.part, unnest(range(1, len(p.x) + 1)) t(i) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN s{i} s ON b.part = s.part AND b.entry = s.entry)""")
    steps.append("""c AS (
  SELECT p.vec_id, p.label, string_agg(lower(printf('%02x', CAST(a.near.entry AS INTEGER))), '' ORDER BY p.part) AS code, CAST(sum(a.near.d) AS BIGINT) AS error
  FROM a4 a JOIN p ON a.r = p.r AND a.part = p.part GROUP BY p.r, p.vec_id, p.label)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256
FROM c
"""


#: The rounds as common table expressions, each part against every entry.
ORACLE = {"op11_slack_heaps": _sql()}
