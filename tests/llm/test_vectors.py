"""Vector operators against brute force: codes over heaps of slack, hard negatives, tiles of bounded memory."""

from __future__ import annotations

import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import exact_topk, hard_negatives, slack_heaps
from foliant.llm.scratch import Scratch

COLUMNS = "vec_id long, label int, embedding array<double>, code string, a long, v int, error long, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", 1, 2, 3, 4) for i, y, v in rows], COLUMNS)


def awkward_rows(n, dim, seed=1, labels=4):
    g = np.random.default_rng(seed)
    rows = [(i, int(g.integers(labels)), (g.normal(size=dim) * 0.3).tolist()) for i in range(n)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(40)]  # a group of copies
    rows += [(2000, None, rows[3][2]), (2001, 1, None), (2002, 1, []), (2003, 1, [float("nan")] * dim), (2004, 1, [None] * dim), (2005, 1, [float("-inf")] * dim), (2006, 1, [1.0] * (dim - 1)), (2050, 1, [0.0] * dim)]
    return [*rows, rows[5], rows[5], (None, 2, rows[4][2])]


def fit(v, dim):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)


def brute_codes(rows, dim, parts=4, entries=256, rounds=4, scale=1024):
    use = [(i, y, [int(np.floor(scale * x)) for x in v]) for i, y, v in rows if fit(v, dim)]
    width = -(-dim // parts)
    cut = lambda v: [(v + [0] * (parts * width - dim))[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(use, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in use:
                members[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(column) // len(members[e]) for column in zip(*members[e], strict=True)] if members[e] else c for e, c in enumerate(books[p])]
    done = [(i, y, [near(cut(v)[p], books[p]) for p in range(parts)]) for i, y, v in use]
    by_label = defaultdict(int)
    for _, y, found in done:
        by_label[y] += sum(d for d, _ in found)
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted(((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), by_label[y], hashlib.sha256(text.encode()).hexdigest()) for i, y, found in done), key=str)


@pytest.mark.parametrize(("dim", "entries", "bits"), [(8, 256, 13), (6, 20, 5)])
def test_codes_equal_brute_force(spark, monkeypatch, dim, entries, bits):
    monkeypatch.setattr(slack_heaps, "BITS", bits)
    rows, scratch = awkward_rows(300, dim), Scratch(spark)
    done = slack_heaps.compressed(vectors(spark, rows), scratch, entries=entries)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], done.digest()) for r in slack_heaps.with_label_errors(done.rows, scratch).collect()]
    assert sorted(got, key=str) == brute_codes(rows, dim, entries=entries)


def test_codes_of_few_or_no_rows(spark):
    scratch = Scratch(spark)
    assert slack_heaps.compressed(vectors(spark, []), scratch).rows.count() == 0
    assert slack_heaps.compressed(vectors(spark, [(1, 1, None)]), scratch).rows.count() == 0
    one = slack_heaps.compressed(vectors(spark, [(1, 1, [0.5, -0.5, 0.1, 0.2])]), scratch)
    assert [tuple(r) for r in one.rows.collect()] == [(1, 1, "00000000", 0)]
    with pytest.raises(Exception, match="distances are not exact"):
        slack_heaps.compressed(vectors(spark, [(1, 1, [1e9] * 4)]), scratch)


def test_rounds_scan_only_what_drift_has_reached():
    g = np.random.default_rng(2)
    middles = g.integers(-900, 900, (20, 4))
    x = (middles[g.integers(20, size=2000)] + g.integers(-40, 40, (2000, 4))).astype(np.int32)
    books = slack_heaps.Books(middles[None].astype(np.int64))
    block, scanned = slack_heaps.Block(x, 1), []
    popped = slack_heaps.Block._popped
    block._popped = lambda p, limits: scanned.append(got := popped(block, p, limits)) or got
    for _ in range(6):
        block.assign(books)
        near = slack_heaps.scan(x.astype(float), books.entries[0].astype(float))[0]
        assert (block.codes[0] == near).all()
        block = slack_heaps.Block.read(len(x), 1, *block.columns())
        block._popped = lambda p, limits, b=block: scanned.append(got := popped(b, p, limits)) or got
        books = books.moved((books.entries + g.integers(-2, 3, books.entries.shape)))
    assert len(scanned) == 5 and sum(map(len, scanned)) < 0.5 * 5 * len(x)


def brute_negatives(rows, dim):
    use = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if i is not None and y is not None and fit(v, dim)]
    out = []
    for a, ya, va in use:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(va, v, strict=True)), i, y) for i, y, v in use if i != a]
        for s, i, _ in sorted(r for r in scored if r[2] == ya)[:5]:
            fits = [(t, j) for t, j, y in sorted(scored) if y != ya and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"n_lists": 12, "list_block": 7, "anchor_block": 3}])
def test_negatives_equal_brute_force(spark, sizes):
    from pyspark.sql import functions as F

    rows = awkward_rows(330, 6)
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 6)
    assert hard_negatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    none = hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0])]), F.col("vec_id") % 50 == 0)
    assert none.count() == 0


def test_lists_out_of_reach_are_not_visited():
    g = np.random.default_rng(3)
    c = np.array([[100.0, 0], [0, 100.0], [-100.0, 0], [60.0, 60.0]])
    radius = np.array([5.0, 5.0, 5.0, -1.0])  # the last has no rows
    q = np.array([[10.0, 0.0]])
    every = (-(2**62), 2**62, -(2**62))
    assert hard_negatives.visits(q, [[every]], c, radius, 0, 8) == [[0, 1, 2]]
    assert hard_negatives.visits(q, [[(*every[:2], 900)]], c, radius, 0, 8) == [[0]]
    assert hard_negatives.visits(q, [[(-40, 40, -40)]], c, radius, 0, 8) == [[1]]
    assert hard_negatives.visits(q, [[(*every[:2], 1050)]], c, radius, 0, 1) == [[0]], "an equal score may still win by its id"
    assert hard_negatives.visits(q, [[every]], c, radius, 1, 8) == [[1, 2]]
    rows = c[[0, 1, 2]].repeat(50, axis=0) + g.normal(size=(150, 2))
    near, away = hard_negatives.nearest(rows, hard_negatives.centroids(rows, 3))
    assert len(set(near.tolist())) == 3 and away.max() < 6


def test_a_full_tile_takes_little_memory():
    g = np.random.default_rng(4)
    for dim in (64, 700):
        n, m = exact_topk.rows_of(dim, exact_topk.SHARD), exact_topk.rows_of(dim, exact_topk.BLOCK)
        v, q = g.integers(-256, 256, (n, dim)).astype(float), g.integers(-256, 256, (m, dim)).astype(float)
        tracemalloc.start()
        got = exact_topk.tile_best(np.arange(m), q, np.arange(n), v, 5)
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
        assert len(got[0]) == 5 * m
        mine = q[7] @ v.T
        mine[7] = -np.inf
        assert got[2][got[0] == 7].tolist() == np.sort(mine)[::-1][:5].tolist()
