"""Best-fit packing: bounds against exhaustive search, whole packings against the tokenizers library."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import best_fit_pack
from tests.llm.data import awkward, prose
from tests.llm.test_tokens import TEXTS, check_packing


def fewest(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_bounds_and_best_fit_against_exhaustive_search():
    g, certified, beyond_volume = random.Random(5), 0, 0
    for _ in range(300):
        capacity = g.choice((10, 12, 30))
        sizes = np.array([g.randint(1, capacity) for _ in range(g.randint(1, 9))])
        bins = best_fit_pack.best_fit(sizes, capacity)
        assert np.bincount(bins, sizes).max() <= capacity
        low, least = best_fit_pack.lower_bound(sizes, capacity), fewest(sizes.tolist(), capacity)
        assert low <= least <= bins.max() + 1
        certified += low == bins.max() + 1
        beyond_volume += low > -(-int(sizes.sum()) // capacity)
    assert certified > 200 and beyond_volume > 30
    assert best_fit_pack.lower_bound(np.zeros(0), 10) == 0 and len(best_fit_pack.best_fit(np.zeros(0, int), 10)) == 0
    assert best_fit_pack.best_fit(np.array([5, 6, 4, 5]), 10).tolist() == [1, 0, 0, 1]


def test_gaps_of_uncertified_blocks_move():
    sizes = np.array([6, 6, 6])  # no two fit: three bins are certified, their gaps are large
    assert best_fit_pack.settled(sizes, 10)[3].all()
    assert not best_fit_pack.settled(np.array([10, 7, 3]), 10)[3].any()
    bins, offset, gap, moves = best_fit_pack.settled(np.array([4000, 90, 4096]), 4096)
    assert bins.tolist() == [1, 1, 0] and offset.tolist() == [0, 4000, 0] and gap.tolist() == [6, 6, 0] and not moves.any(), "certified: a small gap stays"
    # 3, 3, 2, 2 and 2, 2, 2 of 7 and 7 would do; best fit makes 3
    bins, _, gap, moves = best_fit_pack.settled(np.array([3, 3, 2, 2, 2, 2]), 7)
    assert bins.max() == 2 and best_fit_pack.lower_bound(np.array([3, 3, 2, 2, 2, 2]), 7) == 2 and (moves == (gap > 0)).all()


@pytest.mark.parametrize("block", [16384, 40])
def test_packed_documents(spark, block):
    texts = TEXTS | {100 + i: prose(i, 30 + 37 * (i % 40)) for i in range(300)}
    rows = [r.asDict() for r in best_fit_pack.best_fit_packed(awkward(spark, [*texts.items()]).repartition(5), block=block).collect()]
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == 4096 for r in pieces[:-1]) and pieces[-1]["length"] <= 4096
    total = {d: sum(r["length"] for r in p) for d, p in by_doc.items()}
    count = check_packing([r | {"doc_tokens": total[r["doc_id"]]} for r in rows], texts, 4096)
    low = best_fit_pack.lower_bound(np.array([r["length"] for r in rows]))
    assert low <= count <= (low + 1 if block > 1000 else 1.05 * low)
    assert best_fit_pack.best_fit_packed(awkward(spark, {})).count() == 0
    twice = best_fit_pack.best_fit_packed(awkward(spark, [(4, TEXTS[4])] * 2)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 2 == len(twice)
