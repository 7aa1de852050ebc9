"""Hard negatives by inner product from k-means inverted lists with stored radii.

Every row goes to the list of its nearest centroid, and each list keeps the largest distance of its rows from the
centroid. By Cauchy-Schwarz a row of the list scores between q.c - |q| R and q.c + |q| R against an anchor q. An anchor
visits lists by falling upper bound, in waves of 8, 64, 512 and so on; it skips those whose bounds lie outside every
window it searches, and none whose upper bound is strictly below the k-th score that a window has is visited after
a wave. Two searches run so: the best rows of the anchor's label (one window without bounds), then for each score
of those the best rows of other labels within its window.

Centroids are fitted to SAMPLE rows, those with the smallest hashes of id and vector; they decide what is skipped and never what is
found. Lists are dealt into blocks of bounded size, so that one of copies is many blocks, and anchors into blocks of
lists next to each other; a tile is one block of each. Scores are exact whole numbers.

Defined results: rows take no part whose id, label or vector is null, or whose vector is empty, holds null or
non-finite components, or has another length than the one with the smallest id; labels are whole numbers; rows with an
anchor's own id are never its partners; repeated rows count once each, as anchors too; fewer partners than asked for
give all; ties go to the smaller id. An empty table gives an empty one; columns of other names are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.scratch import Scratch
from foliant.llm.whole_vectors import best_of, finite, floored, matrix, of_one_length, rows_of, score_strips
from foliant.sources.tables import table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SAMPLE, ITERATIONS, MOST_LISTS, FIRST_WAVE = 8192, 8, 1024, 8
#: Most rows of a block of a list and of a block of anchors.
LIST_BLOCK, ANCHOR_BLOCK = 16384, 4096
_FAR = 2**62
_FOUND = "a long, anchor_id long, win long, vec_id long, score long"


def centroids(x: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """At most *k* centroids of the rows of *x*: spread starts, then Lloyd's rounds; empty ones keep their place."""
    starts = np.unique(x, axis=0)
    c = starts[np.linspace(0, len(starts) - 1, min(k, len(starts))).astype(int)]
    for _ in range(iterations):
        near = nearest(x, c)[0]
        count = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, column, len(c)) for column in x.T], axis=1)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its distance, the latter from differences so that it is never far too small."""
    near = np.concatenate([((c * c).sum(1) - 2 * (x[i : i + 2048] @ c.T)).argmin(1) for i in range(0, len(x), 2048)] or [np.zeros(0, int)])
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def visits(q: np.ndarray, wins: list[list[tuple[int, int, int]]], c: np.ndarray, radius: np.ndarray, first: int, end: int) -> list[list[int]]:
    """The lists that each anchor visits as the places *first* to *end* of its order; a window is (low, high, k-th score or low).

    Only lists that meet a window have a place; one whose upper bound is below what all windows that it meets need is skipped.
    """
    dot, reach = q @ c.T, np.sqrt((q * q).sum(1))[:, None] * radius
    slack = 1e-6 + 1e-9 * (np.abs(dot) + reach)  # more than the arithmetic's error
    upper, lower = dot + reach + slack, dot - reach - slack
    out = []
    for up, down, mine in zip(upper, lower, wins, strict=True):
        meets = np.zeros(len(c), bool)
        needed = np.zeros(len(c), bool)
        for low, high, kth in mine:
            here = (radius >= 0) & (up >= low) & (down <= high)
            meets |= here
            needed |= here & (up >= kth)
        order = np.argsort(-up, kind="stable")
        out.append([g for g in order[meets[order]][first:end].tolist() if needed[g]])
    return out


def _search(lists: DataFrame, anchors: DataFrame, scratch: Scratch, k: int, same_label: bool, index: tuple, low: int, high: int) -> DataFrame:
    """a, anchor_id, win, vec_id, score: the *k* best rows of each window of each anchor.

    anchors: a, id, label, v, block and ``wins``, the positive scores whose windows it searches (one without bounds for
    rows of the same label).
    """
    c, radius, first_block, n_blocks = index
    found, begin, size = None, 0, FIRST_WAVE

    def window(win: int) -> tuple[int, int]:
        """Smallest and largest score allowed."""
        return (-_FAR, _FAR) if same_label else (-(-low * win // 100), high * win // 100)

    def tile(key, rows: pa.Table, ask: pa.Table) -> pa.Table:
        out = [np.zeros((5, 0), np.int64)]
        if rows.num_rows and ask.num_rows:
            ids, labels, v = rows.column("id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v"))
            a, q_ids, q_labels = (ask.column(n).to_numpy() for n in ("a", "id", "label"))
            wins = ask.column("wins").to_pylist()
            for at, scores in score_strips(matrix(ask.column("v")), v):
                here = slice(at, at + len(scores))
                allowed = (q_ids[here, None] != ids) & ((q_labels[here, None] == labels) == same_label)
                for turn in range(max(map(len, wins[here]))):
                    rows_in = np.array([i for i, w in enumerate(wins[here]) if turn < len(w)])
                    mine = np.array([wins[at + i][turn] for i in rows_in], np.int64)
                    bounds = np.array([window(w) for w in mine.tolist()], np.int64)
                    part = scores[rows_in]
                    r, col = best_of(part, allowed[rows_in] & (part >= bounds[:, :1]) & (part <= bounds[:, 1:]), ids, k)
                    who = at + rows_in[r]
                    out.append(np.stack([a[who], q_ids[who], mine[r], ids[col], part[r, col]]))
        return pa.table([pa.array(x) for x in np.concatenate(out, axis=1)], names=["a", "anchor_id", "win", "vec_id", "score"])

    while begin < len(c):
        end = min(len(c), begin + size)

        def choose(batches, begin=begin, end=end):
            for batch in batches:
                kths = [{x["win"]: x["kth"] for x in row or []} for row in batch.column("kths").to_pylist()]
                wins = [[(*window(w), max(window(w)[0], known.get(w, -_FAR))) for w in row] for row, known in zip(batch.column("wins").to_pylist(), kths, strict=True)]
                lists_of = visits(matrix(batch.column("v")), wins, c, radius, begin, end)
                blocks = [[b for g in row for b in range(first_block[g], first_block[g] + n_blocks[g])] for row in lists_of]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("a", "id", "label", "v", "block", "wins")], pa.array(blocks, pa.list_(pa.int32()))], names=["a", "id", "label", "v", "block", "wins", "g"])

        if found is None:
            state = anchors.withColumn("kths", F.lit(None).cast("array<struct<win:bigint,kth:bigint>>"))
        else:
            full = found.groupBy("a", "win").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
            state = anchors.join(full.groupBy("a").agg(F.collect_list(F.struct("win", "kth")).alias("kths")), "a", "left")
        chosen = scratch.save(state.mapInArrow(choose, "a long, id long, label long, v array<double>, block int, wins array<long>, g array<int>"))
        right = chosen.withColumn("g", F.explode("g"))
        tiles = right.select(F.col("g").alias("list"), F.col("block").alias("with")).distinct()
        left = lists.join(tiles, lists["g"] == F.col("list")).drop("g")
        new = left.groupBy("list", "with").cogroup(right.groupBy("g", "block")).applyInArrow(tile, _FOUND)
        best = F.row_number().over(Window.partitionBy("a", "win").orderBy(F.desc("score"), "vec_id"))
        merged = scratch.save((new if found is None else found.unionByName(new)).withColumn("rank", best).filter(F.col("rank") <= k).drop("rank"))
        scratch.drop(chosen, *([found] if found is not None else []))
        found, begin, size = merged, end, 8 * size
    return found


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, n_lists: int | None = None, list_block: int = LIST_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; *anchor* tells which rows are anchors."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    fit = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite(F.col(vector)))
    fit, dim = of_one_length(fit.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), floored(F.col(vector), scale).alias("v"), anchor.alias("anchor")), "id", "v")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dim:
        return spark.createDataFrame([], result)
    n = fit.count()
    sampled = matrix(fit.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow().column(0))
    c = centroids(sampled, n_lists or int(min(MOST_LISTS, max(1, round(n**0.5 / 4)))))

    def place(batches):
        for batch in batches:
            near, away = nearest(matrix(batch.column("v")), c) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "c", "away"])

    placed = scratch.save(fit.mapInArrow(place, "id long, label long, v array<double>, anchor boolean, c int, away double").withColumn("a", F.monotonically_increasing_id()))
    radius, n_rows, n_anchors = np.full(len(c), -1.0), np.zeros(len(c), int), np.zeros(len(c), int)
    for r in placed.groupBy("c").agg(F.max("away").alias("r"), F.count("*").alias("n"), F.count_if("anchor").alias("asked")).collect():  # a row for each list
        radius[r["c"]], n_rows[r["c"]], n_anchors[r["c"]] = r["r"] * (1 + 1e-9), r["n"], r["asked"]
    n_blocks = -(-n_rows // rows_of(dim, list_block))
    first_block = np.cumsum(n_blocks) - n_blocks
    before = np.cumsum(n_anchors) - n_anchors

    def by_list(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("c") + 1)

    dealt = lambda most: F.pmod(F.xxhash64("a"), F.greatest(by_list(most), F.lit(1)))
    lists = placed.select("id", "label", "v", (by_list(first_block) + dealt(n_blocks)).cast("int").alias("g"))
    block = F.floor((by_list(before) + dealt(n_anchors)) / rows_of(dim, anchor_block)).cast("int")
    anchors = scratch.save(placed.filter("anchor").select("a", "id", "label", "v", block.alias("block")))
    index = (c, radius, first_block.tolist(), n_blocks.tolist())
    near = _search(lists, anchors.withColumn("wins", F.array(F.lit(0).cast("long"))), scratch, positives, True, index, low, high)
    wins = near.groupBy("a").agg(F.collect_set("score").alias("wins"))
    hard = _search(lists, anchors.join(wins, "a"), scratch, negatives, False, index, low, high)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("a", "win").orderBy(F.desc("score"), "vec_id")).cast("int"))
    pairs = near.select("a", F.col("vec_id").alias("positive_id"), F.col("score").alias("win"))
    return ranked.join(pairs, ["a", "win"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("win").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector; every 7th has its label moved by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLE = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS turn FROM s WHERE same) WHERE turn <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
