"""The two classifiers: held-out accuracy, kernels against brute force, awkward rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from foliant.llm import random_index, string_kernel
from foliant.llm.labelled import sample
from tests.llm.data import awkward, prose


def brute_kernel(s, t, order, decay):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return total


def test_subsequence_kernel():
    words = ["idiot", "i-d-iot", "moron", "abc", "ab", "aaaa", "iiddiioott"]
    got = string_kernel.subsequence_kernel(string_kernel.letters(words), string_kernel.letters(["idiot", "aaaaa"], 7), 3, 0.5)
    for i, w in enumerate(words):
        for j, t in enumerate(("idiot", "aaaaa")):
            assert got[i, j] == pytest.approx(brute_kernel(w, t, 3, 0.5), rel=1e-4, abs=1e-7)


def test_kernels_tolerate_gaps_and_insertions():
    k = string_kernel.Kernels(["idiot", "moron"]).rows(["idiot", "i-d-i-o-t", "idxiot", "table", "moron", "", "q" * 500, "x" * 100 + "idiot"])
    assert k[0, 0] == pytest.approx(1, abs=1e-4) and k[4, 1] == pytest.approx(1, abs=1e-4)
    assert k[1, 0] > 0.99 and k[2, 0] > 0.5 and k[3, 0] < 0.1 and k[5].max() == 0 and k[6].max() == 0 and k[7, 0] > 0


def test_kernels_of_masked_words():
    landmarks, words = ["pathetic", "idiot", "x" * 70], ["p*th*t*c", "1d10t", "id10t", "aidt", "tc", "patio", "xx", "toidi", "cite-path"]
    got = string_kernel.Kernels(landmarks).rows(words)
    full = {w: string_kernel.bounded(w) for w in [*words, *landmarks]}
    own = {w: brute_kernel(f, f, string_kernel.ORDER, string_kernel.DECAY) for w, f in full.items() if len(w) < 20}
    for i, w in enumerate(words):
        for j, t in enumerate(landmarks[:2]):
            forms = {full[w], string_kernel.bounded("".join(filter(str.isalnum, w)))}
            want = max(brute_kernel(f, full[t], string_kernel.ORDER, string_kernel.DECAY) / (brute_kernel(f, f, string_kernel.ORDER, string_kernel.DECAY) * own[t]) ** 0.5 for f in forms)
            assert got[i, j] == pytest.approx(want, rel=1e-3, abs=1e-7), (w, t)
    assert got[0, 0] > 0 and got[1, 1] > 0 and got[6, 2] > 0


def test_sentences_join_spelled_words():
    got = string_kernel.sentences(b"You i d i o t. Fine day! a b")
    assert ["you", "i", "d", "i", "o", "t"] in got and ["idiot"] in got and ["fine", "day"] in got
    assert string_kernel.sentences(b"") == [] == string_kernel.sentences(b" \n ")


def corpus(n=600):
    g, texts, toxic, quality = random.Random(4), {}, {}, {}
    for i in range(n):
        words = prose(i, g.randint(5, 80)).split(" ")
        toxic[i], quality[i] = int(i % 4 == 0), int(i % 3 != 0)
        if not quality[i]:
            words = [w + "###" for w in words] if i % 2 else [words[0]] * len(words)
        if toxic[i]:
            for _ in range(2):
                words.insert(g.randrange(len(words)), g.choice(("zpyxwort", "quvvex", "myrrfz")))
        texts[i] = " ".join(words)
    return texts, toxic, quality


@pytest.fixture(scope="module")
def scored(spark):
    texts, toxic, quality = corpus()
    extra = [(1000, None), (1001, ""), (1002, "quv-vex you"), (1003, prose(5, 20000)), (1004, "q u v v e x"), (None, "quvvex"), (4, texts[4])]
    docs = awkward(spark, [*texts.items(), *extra])
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in texts] + [(5, 1, 0), (2000, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, toxic, quality


def test_toxicity(scored):
    docs, labels, toxic, _ = scored
    out = string_kernel.toxicity(docs, labels)
    assert sorted(out.columns) == sorted(docs.columns)
    rows = out.select("doc_id", "text", "score").collect()
    assert len(rows) == 607
    got = {r["doc_id"]: r["score"] for r in rows}
    unseen = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == toxic[i] for i in unseen]) > 0.97
    assert got[1002] > 0.5 and got[1004] > 0.5 and got[1000] == got[1001] < 0.5 and got[None] > 0.7 and 0 <= got[1003] <= 1


def test_quality(scored):
    docs, labels, _, quality = scored
    got = {r["doc_id"]: r["score"] for r in random_index.quality(docs, labels).select("doc_id", "score").collect()}
    unseen = [i for i in quality if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == quality[i] for i in unseen]) > 0.9
    assert got[1000] == got[1001] and all(0 <= x <= 1 for x in got.values())


def test_one_class_or_none(spark):
    docs = awkward(spark, {i: prose(i, 9) for i in range(9)})
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in random_index.quality(docs, one).collect()} == {1.0}
    assert all(r["score"] < 1e-6 for r in string_kernel.toxicity(docs, one).collect())
    assert {r["score"] for r in random_index.quality(docs, one.limit(0)).collect()} == {0.0}
    assert all(r["score"] < 1e-6 for r in string_kernel.toxicity(docs, one.limit(0)).collect())
    assert string_kernel.toxicity(docs.limit(0), one).count() == 0 == random_index.quality(docs.limit(0), one).count()


def test_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (None, 1), (4, None)], "doc_id long, y int")
    rows = sample(labels, "y", F.lit(True), 10).collect()
    assert len(rows) == 20 and len({r["_id"] for r in rows}) == 20 and sum(r["_y"] for r in rows) == 10


def test_word_vectors_count_all_neighbours():
    import pyarrow as pa

    texts = ["a b c a b", "", "b a", "z"]
    total = np.zeros(random_index.BUCKETS * random_index.SIZE)
    for _, _, data, offsets in random_index.pieces(pa.array([t.encode() for t in texts], pa.binary())):
        random_index.add_contexts(total, data, offsets)
    assert total.any() and np.abs(total).sum() <= 2 * (4 + 1) * random_index.ONES
