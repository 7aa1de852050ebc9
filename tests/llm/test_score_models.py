"""The two classifiers recomputed step by step in plain Python."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import random_index, string_kernel
from foliant.llm.byte_words import words as hashed_words
from tests.llm.data import prose
from tests.llm.test_scores import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scored"))
    texts, toxic, quality = corpus(300)
    texts |= {900: None, 901: "", 902: "q u v v e x here", 903: "quv-vex", 904: prose(9, 3000), 905: "idiöt " + "x" * 90}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, quality[i], toxic[i]) for i in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def bucket(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hashed_words(data, np.array([0, len(data)]))[3][0] >> np.uint64(50))


def byte_words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def test_quality_step_by_step(spark, folder):
    path, texts = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    vectors, network = random_index.fit(docs, labels)
    size, buckets = random_index.SIZE, {}
    of = lambda w: buckets.setdefault(w, bucket(w))
    total = {}
    for text in texts.values():
        row = [of(w) for w in byte_words(text)]
        for i, b in enumerate(row):
            for j in (i - 1, i + 1):
                if 0 <= j < len(row):
                    v = total.setdefault(b, [0.0] * size)
                    for place, sign in zip(random_index._PLACE[row[j]], random_index._SIGN[row[j]], strict=True):
                        v[place] += sign
    unit = {b: [x / max(1e-9, math.sqrt(sum(y * y for y in v))) for x in v] for b, v in total.items()}
    for b, v in unit.items():
        assert vectors[b] == pytest.approx(v, abs=1e-5)
    zero = [0.0] * size
    scores = {r["doc_id"]: r["score"] for r in random_index.quality(docs, labels).collect()}
    for i in [*range(0, 300, 11), 900, 901, 902, 904]:
        row = [of(w) for w in byte_words(texts[i])]
        x = [0.0] * random_index.WIDTH
        if row:
            v, once = [unit.get(b, zero) for b in row], sorted(set(row))
            x[:size] = [sum(c) / len(row) for c in zip(*v, strict=True)]
            x[size : 2 * size] = [sum(c) / len(once) for c in zip(*(unit.get(b, zero) for b in once), strict=True)]
            pairs = max(1, len(row) - 1)
            x[2 * size] = sum(sum(p * q for p, q in zip(a, b, strict=True)) for a, b in zip(v, v[1:], strict=False)) / pairs
            x[2 * size + 1] = sum(a == b for a, b in zip(row, row[1:], strict=False)) / pairs
            x[2 * size + 2] = math.log1p(len(row))
            x[2 * size + 3] = len(once) / (1 + len(row))
        z = [(a - m) / s for a, m, s in zip(x, network.mean, network.spread, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, network.w1[:, k], strict=True)) + network.b1[k]) for k in range(random_index.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, network.w2, strict=True)) + network.b2[0]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-logit / network.temperature)), abs=1e-3), i


def test_temperature_has_the_least_loss():
    g = np.random.default_rng(0)
    x, y = g.normal(size=(400, 6)), (g.random(400) < 0.5).astype(float)
    x[:, 0] += y
    weight = np.ones(400)
    network = random_index.Network.fit(x, y, weight, epochs=20)
    aside = [i for i in range(400) if i % 5 == 0]

    def loss(t):
        return sum(math.log1p(math.exp(-(1 if y[i] else -1) * network.logit(x[i : i + 1])[0] / t)) for i in aside)

    assert all(loss(network.temperature) <= loss(network.temperature * f) + 1e-6 for f in (0.5, 0.9, 0.97, 1.03, 1.1, 2) if 0.25 <= network.temperature * f <= 8)


def plain_kernel(s, t, order, decay):
    """The kernel by the recursion over prefixes (Lodhi et al., 2002)."""
    inner = [[[1.0] * (len(t) + 1) for _ in range(len(s) + 1)]]
    for i in range(1, order):
        k = [[0.0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for a in range(i, len(s) + 1):
            run = 0.0
            for b in range(i, len(t) + 1):
                run = decay * run + (decay * decay * inner[i - 1][a - 1][b - 1] if s[a - 1] == t[b - 1] else 0.0)
                k[a][b] = decay * k[a - 1][b] + run
        inner.append(k)
    return sum(decay * decay * inner[order - 1][a - 1][b - 1] for a in range(1, len(s) + 1) for b in range(1, len(t) + 1) if s[a - 1] == t[b - 1])


def normalised(word, landmark):
    """The largest normalised kernel of the word's forms and windows with a landmark."""
    k = lambda a, b: plain_kernel(a, b, string_kernel.ORDER, string_kernel.DECAY)
    t, best, long = string_kernel.bounded(landmark), 0.0, string_kernel.LONG
    for form in {word, "".join(c for c in word if c.isalnum())}:
        s = string_kernel.bounded(form)
        for at in range(0, max(1, len(s) - long // 2), long // 2):
            part = s[at : at + long]
            best = max(best, k(part, t) / math.sqrt(max(1e-12, k(part, part)) * max(1e-12, k(t, t))))
    return best


def line(xs, ps, margin):
    """The line between the steps around a margin."""
    points = list(zip(xs, ps, strict=True))
    p = points[0][1] if margin <= points[0][0] else points[-1][1]
    for (a, pa_), (b, pb) in zip(points, points[1:], strict=False):
        if a <= margin <= b:
            p = pb if a == b else pa_ + (pb - pa_) * (margin - a) / (b - a)
    return p


def probability(model, first, third):
    return 0.999 * max(line(*s, m) for s, m in zip(model.shares, (first, third), strict=True)) + 0.001 / (1 + math.exp(-first))


def test_toxicity_step_by_step(spark, folder):
    path, texts = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = string_kernel.fit(docs, labels)
    assert model.landmarks
    scores = {r["doc_id"]: r["score"] for r in string_kernel.toxicity(docs, labels).collect()}
    margins: dict[str, float] = {}

    def margin(word):
        if word not in margins:
            kernels = [normalised(word, t) for t in model.landmarks]
            margins[word] = sum(w * k for w, k in zip(model.weights, kernels, strict=False)) * (max(kernels) >= string_kernel.LEAST) + model.weights[-1]
        return margins[word]

    for i in [*range(0, 300, 23), 900, 901, 902, 903, 905]:
        words = [w.decode("utf-8", "replace").lower().strip("#.,-") for w in re.findall(rb"[^\x20\x09-\x0D]+", (texts[i] or "").encode())]
        if i == 902:
            words.append("quvvex")
        low = model.weights[-1]
        ranked = sorted((max(low, margin(w)) for w in set(words)), reverse=True) + [low] * string_kernel.EVIDENCE
        near = [probability(model, ranked[0] + d, ranked[string_kernel.EVIDENCE - 1] + d) for d in (-1e-3, 0, 1e-3)]
        assert near[0] - 2e-3 <= scores[i] <= near[2] + 2e-3, i


def test_machine_is_optimal():
    g = np.random.default_rng(1)
    landmarks = ["idiot", "moron", "clown"]
    words = ["idiot", "id-iot", "moron", "table", "clown", "chair", "idxiot", "lamp", "moro", "door"] * 6
    k = string_kernel.Kernels(landmarks).rows(words).astype(np.float64) + g.random((60, 3)) * 0.05
    y = np.array([1, 1, 1, 0, 1, 0, 1, 0, 1, 0] * 6)
    k *= (k.max(axis=1) >= string_kernel.LEAST)[:, None]
    model = string_kernel.train(landmarks, [], np.stack((np.arange(60), y), axis=1), k, np.arange(60), np.arange(60), 0.2)  # one word a document: none to choose
    t = np.array([[normalised(a, b) for b in landmarks] for a in landmarks])
    value, vector = np.linalg.eigh(t + 1e-3 * np.eye(3))
    half = vector @ np.diag(value**-0.5) @ vector.T  # Nystrom: the inverse root of the landmarks' kernel matrix
    assert half @ half @ (t + 1e-3 * np.eye(3)) == pytest.approx(np.eye(3), abs=1e-6)
    w = np.append(np.linalg.solve(half, model.weights[:-1]), model.weights[-1])
    # the last row is a text without words, which is clean
    x, sign = np.column_stack((np.concatenate((k @ half, np.zeros((1, 3)))), np.ones(61))), np.append(np.where(y > 0, 1.0, -1.0), -1.0)
    weight = np.append(np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()), 1e-3)

    def loss(w):
        ridge = 1e-4 * weight.sum() * np.array([1, 1, 1, 1e-4])
        return (weight * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum() + (ridge * w * w).sum()

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in g.normal(0, 0.01, (200, 4)))
    assert model.margins(k) == pytest.approx(x[:60] @ w, abs=1e-6)


def test_hidden_insults_score_as_insults(spark):
    """Every insult of a sample, plain, spelled, masked and with letters put in, through the fitted scorer; clean words that are like them don't."""
    g, insults = np.random.default_rng(6), ["idiot", "pathetic", "worthless", "grumlofex", "clown"]
    like = ["patet", "worths", "clow"]
    texts, toxic = {}, {}
    for i in range(900):
        words = prose(i, int(g.integers(20, 90))).split(" ")
        toxic[i] = int(i % 5 == 0)
        for _ in range(3 if toxic[i] else 1):
            words.insert(int(g.integers(len(words))), str(g.choice(insults if toxic[i] else like)))
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = string_kernel.fit(docs, labels)
    assert set(insults) <= set(model.landmarks)
    scorer = string_kernel.Scorer(model)
    score = lambda forms: scorer(pa.array([f"You are {w} ok.".encode() for w in forms])).to_numpy()

    def put_in(word, n):
        for _ in range(n):
            at = int(g.integers(1, len(word)))
            word = word[:at] + chr(97 + int(g.integers(26))) + word[at:]
        return word

    for w in insults:
        assert (score([w, w.upper(), " ".join(w), "-".join(w)]) >= 0.7).all(), w
        assert (score([put_in(w, 1) for _ in range(40)]) >= 0.7).mean() >= 0.9, w
        assert (score([f"{w[:i]}*{w[i + 1 :]}" for i in range(1, len(w) - 1)]) >= 0.7).mean() >= 0.6, w
    assert (score([put_in(w, 2) for w in insults for _ in range(20)]) >= 0.7).mean() >= 0.5
    assert (score([*like, "table", "", "ok"]) < 0.7).all()
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    got = scorer(pa.array([texts[i].encode() for i in held])).to_numpy() >= 0.7
    assert np.mean(got == np.array([toxic[i] for i in held])) > 0.98


def test_steps_are_the_best_rising_shares():
    g = np.random.default_rng(2)
    margin, label, u = g.normal(size=60).round(1), (g.random(60) < 0.4).astype(float), g.random(60) + 0.1
    xs, ps = string_kernel.steps(margin, label, u, 0.25)
    assert all(np.diff(xs) >= 0) and all(np.diff(ps[::2]) > 0)
    for lo, hi, p in zip(xs[::2], xs[1::2], ps[::2], strict=True):
        here = (margin >= lo) & (margin <= hi)
        assert p == pytest.approx(((u * label)[here].sum() + 0.25) / (u[here].sum() + 1))
    assert sorted({m for lo, hi in zip(xs[::2], xs[1::2], strict=True) for m in margin if lo <= m <= hi}) == sorted(set(margin))
    assert len(string_kernel.steps(np.array([1.0, 2.0]), np.array([1.0, 0.0]), np.ones(2), 0.5)[0]) == 2


def test_queries_hold_out_and_predict(spark, folder):
    path, texts = folder
    for query, fold, kept, least in ((random_index.op3_random_index, 5, 0, 0.3), (string_kernel.op6_string_kernel, 3, 1, 0.7)):
        rows = query(spark, path).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == kept)
            assert r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1


def test_empty_column_has_no_scores():
    model = string_kernel.Model.constant(0.0)
    assert len(string_kernel.Scorer(model)(pa.array([], pa.binary()))) == 0
