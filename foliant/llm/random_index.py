"""Quality by random-indexing word vectors and a small network.

A word's vector is the sum of its neighbours' index vectors over the whole corpus; an index vector is sparse and
ternary, drawn at random. Words are hashed into BUCKETS, so the table of vectors has a fixed size: each task sums
its own in memory, and the tasks' tables are added up by bucket in one aggregation. A text is the mean of its
words' vectors, of length one each, over all its words and once more over its distinct words, with the likeness of
neighbouring words' vectors and two counts. A network of two
layers in numpy, fitted by Adam on at most SAMPLE labelled documents of each class, gives a logit; a temperature,
chosen on a part of the sample that training has not seen, makes it a calibrated probability. The classes weigh as
in all usable labels.

Defined results: null and empty texts have no words and get the score of a text whose means are zero; equal texts get
equal scores, so repeated rows and ties too; rows with a null id are scored like others and never learnt from; texts are read
whole however long; an empty table gives an empty one; columns of other names pass through, one named like the score is
replaced; a sample without both classes gives score 1 or 0 by the only class, 0 without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.byte_words import pieces, words
from foliant.llm.labelled import remainder, sample, sampled, with_scores
from foliant.sources.tables import table

BUCKETS = 1 << 14
SIZE = 64
#: Components of an index vector that are not zero.
ONES = 4
HIDDEN = 32
SAMPLE = 4000
FOLD, HELD_OUT = 5, 0
THRESHOLD = 0.3

_G = np.random.Generator(np.random.PCG64(11))
_PLACE = _G.integers(0, SIZE, (BUCKETS, ONES))
_SIGN = _G.choice((-1.0, 1.0), (BUCKETS, ONES))
_SHIFT = np.uint64(64 - 14)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, row, h = words(data, offsets)
    return row, (h >> _SHIFT).astype(np.int64)


def add_contexts(total: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Adds the index vectors of each word's two neighbours to *total*, flat by bucket."""
    row, b = _buckets(data, offsets)
    same = row[1:] == row[:-1]
    left, right = b[:-1][same], b[1:][same]
    for word, other in ((left, right), (right, left)):
        for j in range(ONES):
            total += np.bincount(word * SIZE + _PLACE[other, j], _SIGN[other, j], len(total))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """One vector of length 1 (or 0, if never seen) for each bucket, from all documents."""
    names = [f"c{i}" for i in range(SIZE)]

    def run(batches):
        total = np.zeros(BUCKETS * SIZE)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                add_contexts(total, data, offsets)
        grid = total.reshape(BUCKETS, SIZE)
        seen = np.flatnonzero(grid.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *[pa.array(grid[seen, i].astype(np.int32)) for i in range(SIZE)]], names=["bucket", *names])

    texts = docs.select(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    parts = texts.mapInArrow(run, "bucket int, " + ", ".join(f"{c} int" for c in names))
    rows = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((BUCKETS, SIZE), np.float32)
    if len(rows):
        grid = rows[names].to_numpy(np.float64)
        out[rows["bucket"].to_numpy()] = grid / np.maximum(np.linalg.norm(grid, axis=1, keepdims=True), 1e-9)
    return out


#: Columns of a description: two means, mean likeness of neighbouring words, share of equal neighbours, logarithm
#: of the number of words, share of distinct words.
WIDTH = 2 * SIZE + 4


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The description of each text: vectors' means over words and over distinct words, and how neighbours relate."""
    n = len(offsets) - 1
    row, b = _buckets(data, offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(row):
        return out
    once = np.unique(row * BUCKETS + b)
    for part, (r, w) in enumerate(((row, b), (once // BUCKETS, once % BUCKETS))):
        starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        count = np.diff(np.append(starts, len(r)))
        v = vectors[w]
        out[r[starts], part * SIZE : (part + 1) * SIZE] = np.add.reduceat(v, starts) / count[:, None]
        if not part:
            inner = r[1:] == r[:-1]
            like = np.append(np.einsum("ij,ij->i", v[1:], v[:-1]) * inner, 0)
            equal = np.append((b[1:] == b[:-1]) & inner, False)
            out[r[starts], 2 * SIZE] = np.add.reduceat(like, starts) / np.maximum(1, count - 1)
            out[r[starts], 2 * SIZE + 1] = np.add.reduceat(equal, starts, dtype=np.float64) / np.maximum(1, count - 1)
            out[r[starts], 2 * SIZE + 2] = np.log1p(count)
        else:
            out[r[starts], 2 * SIZE + 3] = count / np.exp(out[r[starts], 2 * SIZE + 2])
    return out


class Network:
    """Two layers; ``fit`` is deterministic."""

    def __init__(self, mean, spread, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.spread, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, spread, w1, b1, w2, b2, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, step: float = 1e-3, decay: float = 1e-3) -> Network:
        g = np.random.Generator(np.random.PCG64(5))
        aside = np.arange(len(x)) % 5 == 0
        out = cls(x.mean(axis=0), x.std(axis=0) + 1e-6, g.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), g.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1))
        z, t, u = (x[~aside] - out.mean) / out.spread, y[~aside], weight[~aside]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (out.w1, out.b1, out.w2, out.b2)]
        turn = 0
        for _ in range(epochs):
            order = g.permutation(len(z))
            for at in range(0, len(z), 128):
                i = order[at : at + 128]
                h = np.maximum(z[i] @ out.w1 + out.b1, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ out.w2 + out.b2, -40, 40)))
                d = (p - t[i]) * u[i] / max(1e-9, u[i].sum())
                dh = d[:, None] * out.w2 * (h > 0)
                turn += 1
                for p_, grad, (m, v) in zip((out.w1, out.b1, out.w2, out.b2), (z[i].T @ dh + decay * out.w1, dh.sum(axis=0), h.T @ d + decay * out.w2, np.array([d.sum()])), state, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    p_ -= step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        logit, t, u = out.logit(x[aside]), y[aside], weight[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        loss = [(u * (np.logaddexp(0, logit / c) - t * logit / c)).sum() for c in grid]
        out.temperature = float(grid[int(np.argmin(loss))]) if len(t) else 1.0
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network | float]:
    """Word vectors of *docs* and a network from their labelled rows that are not held out."""
    usable = F.coalesce(remainder(F.col("doc_id"), FOLD) != HELD_OUT, F.lit(False))
    vectors = word_vectors(docs)

    def run(batches):
        for batch in batches:
            xs = [pooled(vectors, data, offsets) for _, _, data, offsets in pieces(batch.column(2), 1 << 19)]
            x = np.concatenate(xs) if xs else np.zeros((0, WIDTH), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "y", "x"])

    rows = sampled(docs, sample(labels, label, usable, most)).select(F.col("_id").cast("long"), "_y", "_text")
    got = rows.mapInArrow(run, "id long, y int, x array<float>").toPandas()
    shares = {r[0]: r[1] for r in labels.filter(usable & F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return vectors, float(y.max(initial=0))
    x = np.stack(got["x"].to_numpy()).astype(np.float64)
    order = np.lexsort((*x[:, :4].T, got["id"].to_numpy()))
    x, y = x[order], y[order].astype(np.float64)
    weight = np.where(y > 0, shares.get(1, 1) / max(1, (y > 0).sum()), shares.get(0, 1) / max(1, (y == 0).sum()))
    return vectors, Network.fit(x, y, weight / weight.mean())


class Scorer:
    def __init__(self, vectors: np.ndarray, network: Network | float):
        self.vectors, self.network = vectors, network

    def __call__(self, column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for at, end, data, offsets in pieces(column, 1 << 19):
            out[at:end] = self.network if isinstance(self.network, float) else self.network.probability(pooled(self.vectors, data, offsets).astype(np.float64))
        return pa.array(out, pa.float64())


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """*docs* with ``score``, the probability that label ``quality`` is 1."""
    vectors, network = fit(docs, labels)

    def scorer():
        from foliant.llm.random_index import Scorer

        return Scorer(vectors, network)

    return with_scores(docs, scorer)


def op3_random_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), FOLD) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_random_index": op3_random_index}
