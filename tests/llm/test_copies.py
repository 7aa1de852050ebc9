"""Near copies, repeated strings, lines and top-k against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import column_repeats, exact_topk, near_copies, site_lines
from foliant.llm.components import components
from foliant.llm.scratch import Scratch
from tests.llm.data import awkward, prose


def brute_components(texts, width, num, den):
    sets = {}
    for i, t in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(text, seed, n):
    g, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[g.randrange(len(words))] = f"w{g.randrange(10**6)}"
    return " ".join(words)


def copies_table():
    base, chain = prose(1, 200), prose(2, 120)
    texts = {1: base, 2: base.upper(), 3: None, 4: "", 5: "one two", 6: "ONE two", 7: "one  two\n", 8: "three", 9: " \t "}
    texts |= {20 + i: edited(base, i, 3) for i in range(40)}
    for i in range(12):  # each is close to the one before, not to those far off
        texts[100 + i] = chain
        chain = edited(chain, 50 + i, 3)
    texts |= {200 + i: prose(200 + i, 60) + " " + prose(7, 40) for i in range(30)}  # a shared passage, no copies
    texts[300] = prose(300, 9000)
    texts[301] = texts[300] + " end"
    return texts


@pytest.mark.parametrize("chunk", [1024, 3])
def test_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    texts = copies_table()
    rows = near_copies.near_copies(awkward(spark, [*texts.items(), (21, texts[21]), (None, texts[1])]), width=4).collect()
    want = brute_components(texts, 4, 80, 100)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_blocks_are_bounded(spark, monkeypatch):
    """Thousands of members of one posting list that no link joins: small blocks, and each pair with a probe meets once."""
    monkeypatch.setattr(near_copies, "CHUNK", 64)
    for m, p in ((1, 5000), (3000, 40), (20, 30)):
        rows = spark.range(m + p).select(F.lit(7).cast("long").alias("token"), "id", F.lit(m).cast("long").alias("m"), F.lit(p).cast("long").alias("p"), (F.col("id") >= m).alias("probe"))
        blocks = near_copies.in_blocks(rows).groupBy("block").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("h"), F.sum(F.col("probe").cast("int")).alias("q"), F.sum((F.col("home") & F.col("probe")).cast("int")).alias("b")).collect()
        assert max(r["n"] for r in blocks) <= 128
        assert sum(r["h"] * r["q"] - r["b"] * (r["b"] + 1) // 2 for r in blocks) == m * p + p * (p - 1) // 2


def test_templated_pages_are_never_linked_in_big_blocks(spark, monkeypatch):
    """Pages that share half of their words, and so posting lists, but are no near copies; a few are."""
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    shared = prose(1, 60)
    texts = {i: shared + " " + prose(1000 + i, 25) for i in range(80)} | {200 + i: edited(shared + " " + prose(1000 + i, 25), i, 1) for i in range(0, 80, 9)}
    want = brute_components(texts, 4, 80, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_copies.near_copies(awkward(spark, texts), width=4).collect()}
    assert got == want


def test_unlike_texts_of_one_id(spark):
    a, b = prose(1, 100), prose(2, 100)
    rows = [(5, a), (5, b), (3, a), (9, b), (9, b), (7, edited(b, 1, 1))]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_copies.near_copies(awkward(spark, rows), width=4).collect())
    assert got == sorted([(5, 3, False), (5, 5, True), (3, 3, True), (9, 5, False), (9, 5, False), (7, 5, False)])


def test_near_copies_of_nothing(spark):
    assert near_copies.near_copies(awkward(spark, {})).count() == 0
    assert [tuple(r) for r in near_copies.near_copies(awkward(spark, {1: ""})).collect()] == [(1, 0, 1, True)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for r in raw:
        for p in range(len(r) - length + 1):
            count[r[p : p + length]] = count.get(r[p : p + length], 0) + 1
    out = []
    for r in raw:
        cover = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(r), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(r, cover, strict=True) if not c)).hexdigest()))
    return out


def repeats_table():
    passage, short = prose(90, 60), prose(91, 7)
    assert len(passage) > 250 and 30 < len(short) < 60
    texts = {1: None, 2: "", 3: passage, 4: passage, 5: "ab" * 400, 6: "x" * 70, 7: "für " * 60, 8: prose(8, 3000)}
    texts |= {10 + i: prose(10 + i, 12) + " " + passage[i : 200 + i] + " " + prose(60 + i, 12) for i in range(20)}
    texts |= {40 + i: prose(40 + i, 20) + short + prose(140 + i, 20) for i in range(30)}  # common, but shorter than a window
    texts |= {80 + i: prose(8, 3000)[500 * i : 500 * i + 700] for i in range(4)}
    return texts


@pytest.mark.parametrize(("bound", "piece"), [(256, 1 << 20), (2, 1 << 20), (2, 1000)])
def test_repeats(spark, monkeypatch, bound, piece):
    monkeypatch.setattr(column_repeats, "BOUND", bound)
    monkeypatch.setattr(column_repeats, "PIECE", piece)
    texts = [*repeats_table().items(), (3, repeats_table()[3]), (None, prose(8, 300))]
    want = sorted(((i or -1), *w) for (i, _), w in zip(texts, brute_removed([t for _, t in texts], 60), strict=True))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in column_repeats.removal_digests(awkward(spark, texts).repartition(3), 60).collect())
    assert got == want
    assert any(w[2] for w in want)


def test_repeats_keep_columns_and_letters(spark):
    docs = awkward(spark, {1: "é" * 300, 2: "plain", 3: None, 4: ""})
    out = column_repeats.without_repeats(docs, 60)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "", 2: "plain", 3: None, 4: ""}
    assert column_repeats.without_repeats(awkward(spark, {})).count() == 0


def test_repeated_words(spark):
    tiny, texts = " ".join("abcdefghijklmnopqrstuvwxyz" * 2)[: 2 * 51 - 1], {}
    for n, passage in ((50, prose(50, 50)), (51, prose(51, 51)), (60, prose(60, 60)), (1, tiny), (2, "\u4e2d" * 140)):
        texts |= {100 * n + i: prose(9000 + 100 * n + i, 30) + ("  " if i else "\n") + (passage.replace(" ", "\n", 2) if i else passage) + " " + prose(9500 + 100 * n + i, 30) for i in range(2)}
    texts |= {7: tiny, 8: None, 9: ""}
    out = {r["doc_id"]: r["text"] for r in column_repeats.without_repeats(awkward(spark, texts), words=51).collect()}
    for n in (51, 60, 1, 2):
        assert [out[100 * n + i].split() for i in range(2)] == [(prose(9000 + 100 * n + i, 30) + " " + prose(9500 + 100 * n + i, 30)).split() for i in range(2)], n
    assert all(out[5000 + i] == texts[5000 + i] for i in range(2))
    assert out[7] == "" and out[8] is None and out[9] == ""


def brute_passages(texts, length, words):
    """Bytes, and their maximal runs, that repeated strings of *length* bytes or repeated runs of *words* words cover."""
    raw = [(t or "").encode() for t in texts]
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raw]
    count = collections.Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    runs = [[tuple(r[s:e] for s, e in f[k : k + words]) for k in range(len(f) - words + 1)] for r, f in zip(raw, found, strict=True)]
    total = collections.Counter(x for of in runs for x in of)
    out = []
    for r, f, of in zip(raw, found, runs, strict=True):
        cover = bytearray(len(r))
        for s, e in [(p, p + length) for p in range(len(r) - length + 1) if count[r[p : p + length]] > 1] + [(f[k][0], f[k + words - 1][1]) for k, x in enumerate(of) if total[x] > 1]:
            cover[s:e] = b"\1" * (e - s)
        out.append((sum(cover), sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))))
    return out


@pytest.mark.parametrize(("bound", "piece"), [(256, 1 << 20), (2, 1000)])
def test_passages_of_short_words(spark, monkeypatch, bound, piece):
    """Whole copies, passages of short words, and passages inside of copies that are found byte by byte already."""
    monkeypatch.setattr(column_repeats, "BOUND", bound)
    monkeypatch.setattr(column_repeats, "PIECE", piece)
    words = prose(70, 200).split()
    texts = {1: None, 2: "", 3: " \n", 4: "a " * 40, 5: "x" * 150, 6: "b c d e f " * 30, 7: prose(71, 2000)}
    texts |= {10 + i: prose(300, 120) for i in range(3)}  # copies
    texts |= {20 + i: prose(400 + i, 15) + " " + " ".join(prose(300, 120).split()[60 : 72 + i]) + " " + prose(450 + i, 15) for i in range(4)}  # 12 to 15 words of them
    texts |= {30 + i: prose(500 + i, 15) + ("\n" if i % 2 else " ") + ("  " if i % 3 else "\t").join(words[i : 13 + i]) + " " + prose(550 + i, 15) for i in range(12)}
    texts |= {60 + i: prose(600 + i, 9) + " " + " ".join(words[150:161]) + " " + prose(650 + i, 9) for i in range(9)}  # 11 words only
    texts |= {80: " ".join(prose(71, 2000).split()[1500:1512]), 81: texts[7][:200].replace(" ", "\n")}
    rows = [*texts.items(), (10, texts[10]), (None, texts[30])]
    got = sorted((r["doc_id"] or -1, r["n_repeated"], r["n_passages"]) for r in column_repeats.removal_digests(awkward(spark, rows).repartition(3), 150, words=12).collect())
    assert got == sorted(((i or -1), *w) for (i, _), w in zip(rows, brute_passages([t for _, t in rows], 150, 12), strict=True))
    plain = column_repeats.removal_digests(awkward(spark, rows), 150)
    both = column_repeats.removal_digests(awkward(spark, rows), 150, words=12).select(plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, both.collect()))


def test_query_tells_passages_below_400_bytes(spark, tmp_path):
    texts = {i: prose(700 + i, 30) + " " + " ".join(w[:5] for w in prose(790 + i // 2, 50 + i // 2).split()) + " " + prose(750 + i, 30) for i in range(8)}
    awkward(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in column_repeats.op5_column_repeats(spark, str(tmp_path)).collect()}
    assert all(r["n_removed"] == 0 for r in out.values())
    assert [out[i]["n_passages"] for i in range(8)] == [0, 0, 1, 1, 1, 1, 1, 1]  # 50 words, then 51 to 53


def test_columns_against_brute_force():
    g = random.Random(5)
    texts = [bytes(g.choices(b"ab", k=g.randint(0, 14))) + b"XYZ" + bytes(g.choices(b"ab", k=g.randint(0, 14))) for _ in range(57)] + [b"aXYZbb"] * 3
    group, place = np.repeat(np.arange(12), 5), np.array([t.index(b"XYZ") for t in texts])
    want = {
        (i, p)
        for i, t in enumerate(texts)
        for p in range(len(t) - 8)
        for j, u in enumerate(texts)
        if i != j and group[i] == group[j] and (q := p - place[i] + place[j]) >= 0 and len(u) >= q + 9 and t[p : p + 9] == u[q : q + 9]
    }
    string, start, end, first, several = column_repeats.construct(texts, group, place, 9)
    assert {(i, p) for i, a, b in zip(string.tolist(), start.tolist(), end.tolist(), strict=True) for p in range(a, b + 1)} == want and want
    like = [[j for j, u in enumerate(texts) if group[i] == group[j] and t == u and place[i] == place[j]] for i, t in enumerate(texts)]
    assert several.tolist() == [len(x) > 1 for x in like]
    assert all(sum(first[j] for j in x) == 1 for x in like)


def test_site_lines(spark):
    texts = [(i, f"Menu\n{prose(i, 5)}\nMenu \n\n{'rare' if i < 2 else 'x'}") for i in range(40)] + [(50, None), (51, ""), (52, "Menu"), (52, "Menu")]
    docs = awkward(spark, texts).unionByName(awkward(spark, [(60, "Menu"), (61, "Menu")], source=None)).unionByName(awkward(spark, [(70, "Menu\na")], source="t"))
    out = {r["doc_id"]: r for r in site_lines.drop_boilerplate(docs, counts=True).collect()}
    assert site_lines.drop_boilerplate(docs).columns == docs.columns
    assert out[0]["text"] == f"{prose(0, 5)}\n\nrare" and (out[0]["n_lines"], out[0]["n_dropped"]) == (5, 2)
    assert out[7]["text"] == f"{prose(7, 5)}\n"
    assert out[50]["text"] is None and out[50]["n_lines"] == 0 and out[51]["text"] == "" and out[52]["text"] == ""
    assert out[60]["text"] == "Menu" and out[70]["text"] == "Menu\na"  # fewer than three pages
    assert site_lines.drop_boilerplate(awkward(spark, {}), counts=True).count() == 0


def test_lines_of_a_twentieth_of_a_large_host(spark):
    """A line on 7 of 100 pages goes, one on 5 of 100 stays."""
    texts = [(i, f"{'menu line' if i < 7 else 'a'}{i if i >= 7 else ''}\n{'rare line' if i % 20 == 0 else f'b{i}'}") for i in range(100)]
    out = {r["doc_id"]: r["text"] for r in site_lines.drop_boilerplate(awkward(spark, texts)).collect()}
    assert out[3] == "b3" and out[0] == "rare line" and out[20] == "a20\nrare line"
    few = {r["doc_id"]: r["text"] for r in site_lines.drop_boilerplate(awkward(spark, texts), ratio=site_lines.FEW, rare=site_lines.RARE).collect()}
    assert few[3] == "menu line\nb3", "fewer than ten texts"


def brute_topk(rows, k):
    def fit(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and fit(v)]
    out = []
    for i, v in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in usable if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(16384, 4096), (7, 2)])
def test_top_k(spark, shard, block):
    g = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in g.normal(size=6)]) for i in range(301)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, rows[0][1]), (450, [1.0, 2.0]), (451, [0.5, 0.5]), (500, None), (501, []), (550, [float("nan")] * 6), (551, [None] * 6), (None, [1.0] * 6), (600, [float("inf")] * 6), (650, [1.0e6] * 6), (651, [1.0e6] * 6), (700, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 5, 6) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = exact_topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5)
    assert exact_topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
