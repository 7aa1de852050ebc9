"""Exact top-k search by inner product.

Vectors are dealt into shards and queries into blocks, both of bounded bytes; every pair of a block and a shard is a
tile: matrix products of strips of its queries, and of each strip a partial selection of each query's best rows of the
shard. The partial lists are merged in a tree, FAN shards at a level, until each query has one list. Tiles need no
key of the data: a row's shard comes from a hash of its place, so equal rows or ids don't pile up.

Work is queries x vectors, as an exact search over a stated query set is; a query block is sent to each shard
and a shard to each query block, so the shuffle is vectors x blocks + queries x shards. A shard, a strip of scores and its
selection take a few times TILE_BYTES, whatever the vectors' length.

Products are of integers: in float64 while their sums are exact in it (below 2**53), in Python integers
otherwise, where a score that doesn't fit a long is an error.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither do null
ids; a query meets vectors of its own length only; rows with the query's own id are no candidates; repeated
candidate rows count once each; fewer candidates than k give all of them; ties go to the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm.whole_vectors import best_of, finite, floored, matrix, rows_of, score_strips
from foliant.sources.tables import table

#: Most rows of a shard and of a block of queries; long vectors make smaller ones.
SHARD = 16384
BLOCK = 4096
FAN = 16

_FOUND = "query_id long, vec_id long, score long, shard int"


def tile_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[np.ndarray]:
    """Query id, candidate id and score of the *k* best rows of one tile for each query."""
    out = [np.zeros((3, 0), np.int64)]
    for at, scores in score_strips(q, v):
        mine = q_ids[at : at + len(scores)]
        rows, cols = best_of(scores, mine[:, None] != ids, ids, k)
        out.append(np.stack([mine[rows], ids[cols], scores[rows, cols]]))
    return list(np.concatenate(out, axis=1))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int | None = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's *k* best vectors; components become floor(scale * x)."""

    def usable(df: DataFrame) -> DataFrame:
        return df.filter(F.col(vec_id).isNotNull() & finite(F.col(vector))).select(F.col(vec_id).cast("long").alias("_id"), floored(F.col(vector), scale).alias("_v"))

    def place(n: int) -> Column:
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")

    data, asked = usable(vectors), usable(queries)
    size = data.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("_v")), F.lit(1)).alias("d")).first()
    shards, blocks = (max(1, -(-n // rows_of(size["d"], most))) for n, most in ((size["n"], shard), (asked.count(), block)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select("_id", "_v", F.size("_v").alias("_d"), place(shards).alias("shard")).withColumn("block", each(blocks))
    right = asked.select("_id", "_v", F.size("_v").alias("_d"), place(blocks).alias("block")).withColumn("shard", each(shards))

    def tile(key, rows: pa.Table, ask: pa.Table) -> pa.Table:
        if rows.num_rows and ask.num_rows:
            out = tile_best(ask.column("_id").to_numpy(), matrix(ask.column("_v")), rows.column("_id").to_numpy(), matrix(rows.column("_v")), k)
        else:
            out = [np.zeros(0, np.int64)] * 3
        return pa.table([*[pa.array(x) for x in out], pa.array(np.full(len(out[0]), key[0].as_py(), np.int32))], names=["query_id", "vec_id", "score", "shard"])

    keys = ["shard", "block", "_d"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, _FOUND)
    ranked = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))
    while shards > FAN:
        shards = -(-shards // FAN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).withColumn("rank", ranked("shard")).filter(F.col("rank") <= k).drop("rank")
    out = found.withColumn("rank", ranked().cast(T.IntegerType())).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every 50th vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


QUERIES = {"op4_exact_topk": op4_exact_topk}

ORACLE = {
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
""",
}
