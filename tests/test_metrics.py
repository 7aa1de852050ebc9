from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import metrics as m
from foliant.functions import textnorm as n

VECTORS = [
    ("", "", 1, 1, 1, 0, 1),
    ("", "abc", 0, 0, 0, 0, 1),
    ("abc", "", 0, 0, 0, 0, 1),
    ("Olá  Mundo", "ola mundo", 1, 1, 1, 1, 1),
    ("A casa azul", "a casa verde", 0.5833, 0.6667, 0.3571, 0.9167, 1),
    ("kitten", "sitting", 0.5714, 0, 0.2222, 0.8571, 1),
    ("STP e stp mmr", "o", 0, 0, 0, 13, 0.3333),
    ("stp STP", "o", 0, 0, 0, 7, 0),
]
VALID = ["STP", "5S", "OEE", "eca", "pttiige", "Introdução", "PDCAX", "PDCAXY", "ritmo"]
INVALID = ["2024", "mmr", "eea", "abc123", "bcdfgha", "É", "a" * 26]


def test_vectors(spark):
    df = spark.createDataFrame([(i, v[0], v[1]) for i, v in enumerate(VECTORS)], "i int, e string, g string")
    rows = m.with_metrics(df, "e", "g").orderBy("i").collect()
    for r, v in zip(rows, VECTORS, strict=True):
        assert [round(r[c], 4) for c in ("sim_lev", "cov", "sim_bi", "rel_len", "excess_q")] == list(v[2:]), v


def test_word_validity(spark):
    df = spark.createDataFrame([(w,) for w in VALID + INVALID], "w string").select("w", m.valid_word(F.col("w")).alias("v"))
    assert {r["w"] for r in df.collect() if r["v"]} == set(VALID)


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=80), st.text("abcé", max_size=80))
def test_bit_distance(a, b):
    assert m.bit_distance(a, b) == m.bit_distance(b, a) == table_distance(a, b)


def test_long_and_short_distances_agree(spark):
    g = random.Random(1)
    rows = [("".join(g.choices("abcd ", k=k)), "".join(g.choices("abcd ", k=k + 5))) for k in (3, 500, 600, 900)] + [(None, "x"), ("", "y" * 700)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", m.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r["d"] == (None if r["a"] is None else table_distance(r["a"], r["b"]))


def test_normalization(spark):
    rows = {" É\xa0﻿a\n b ": "e a b", "ﬁ Ŵß": "ﬁ wß", "éÅ": "ea", "": "", "ñandú": "nandu"}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", n.normalize(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == rows


def test_half_up(spark):
    got = spark.sql("SELECT -2.5D a, 2.5D b, 1.005D c").select(n.half_up(F.col("a")).alias("a"), n.half_up(F.col("b")).alias("b"), n.places(F.col("c"), 2).alias("c")).first()
    assert tuple(got) == (-2, 3, pytest.approx(1.0, abs=0.011))
