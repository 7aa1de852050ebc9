"""Bucketed upserts, the metadata log, places without one task, and files of results."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import scoreboard
from foliant.sources import results
from foliant.sources.keyed_table import KeyedTable

ROWS = "k string, v int, at int"


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path / "t"), ["k"], 8)
    assert kept.read() is None and kept.manifest() == {}
    assert kept.upsert(spark.createDataFrame([(f"k{i}", i, 1) for i in range(100)], ROWS)) == 8
    before = kept.manifest()
    assert kept.upsert(spark.createDataFrame([("k7", 700, 2)], ROWS)) == 1
    changed = {b for b, v in kept.manifest().items() if before[b] != v}
    assert len(changed) == 1 and sorted(p.name for p in (tmp_path / "t" / "data" / "v=2").glob("_bucket=*")) == [f"_bucket={b}" for b in changed]
    want = {f"k{i}": i for i in range(100)} | {"k7": 700}
    assert {r["k"]: r["v"] for r in kept.read().collect()} == want
    assert {r["k"]: r["v"] for r in kept.read(1).collect()} == {f"k{i}": i for i in range(100)}
    kept.upsert(spark.createDataFrame([("k7", 701, 2)], ROWS))
    assert kept.vacuum(1) == 2 and {r["k"]: r["v"] for r in kept.read().collect()} == want | {"k7": 701} and kept.versions() == [3]


def test_ties_versions_and_columns(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    rows = [("a", 1, 5), ("a", 3, 5), ("a", 9, 4), (None, 1, 1), (None, 2, 2)]
    for order in (rows, rows[::-1]):
        other = KeyedTable(spark, str(tmp_path / f"o{order[0][1]}"), ["k"], 4)
        other.upsert(spark.createDataFrame(order, ROWS), "at")
        assert sorted(map(str, other.read().select("k", "v").collect())) == ["Row(k='a', v=3)", "Row(k=None, v=2)"]
    kept.upsert(spark.createDataFrame(rows[:1], ROWS), version=4)
    assert kept.upsert(spark.createDataFrame([("a", 0, 0)], ROWS), version=4) == 0, "a version that is there stays"
    kept.upsert(spark.createDataFrame([("b", "new")], "k string, note string"))
    assert {(r["k"], r["v"], r["note"]) for r in kept.read().collect()} == {("a", 1, None), ("b", None, "new")}
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), ["k"], 5).read()
    kept.upsert(spark.createDataFrame([], ROWS))
    assert kept.read().count() == 2


def test_a_run_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    kept = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    kept.upsert(spark.createDataFrame([("a", 1, 1)], ROWS))
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.upsert(spark.createDataFrame([("a", 2, 2)], ROWS))
    monkeypatch.undo()
    assert kept.read().first()["v"] == 1 and kept.versions() == [1]
    kept.upsert(spark.createDataFrame([("a", 3, 3)], ROWS))
    assert kept.read().first()["v"] == 3


def test_metadata_log_and_its_object(spark, tmp_path):
    path = str(tmp_path / "meta.json")
    assert results.gold_metadata(spark, path) is None
    (tmp_path / "meta.json").write_text(json.dumps({"old": {"numPaginas": 2}, "b": {"numPaginas": 5}}))
    assert {r["doc"] for r in results.gold_metadata(spark, path).collect()} == {"old", "b"}
    results.save_gold_metadata(spark, spark.createDataFrame([("b", 7), ('q"uote', 1)], "doc string, numPaginas int"), path)
    results.export_gold_metadata(spark, path)
    assert {k: v.get("numPaginas") for k, v in json.loads((tmp_path / "meta.json").read_text()).items()} == {"old": 2, "b": 7, 'q"uote': 1}
    assert {r["doc"]: r["numPaginas"] for r in results.gold_metadata(spark, path).collect()} == {"old": 2, "b": 7, 'q"uote': 1}


def test_places_equal_a_sort(spark, tmp_path):
    g = random.Random(1)
    names = ["".join(g.choices("aAbBçÇ", k=3)) for _ in range(300)]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "pdf string, extrator int").repartition(7)
    order = [*scoreboard.collated(["pdf"]), F.col("extrator")]
    got = scoreboard.in_places(rows, order, str(tmp_path / "p")).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 301))
    assert [(r["pdf"], r["extrator"]) for r in got] == [tuple(r) for r in rows.orderBy(*order).collect()]
    assert scoreboard.in_places(rows.limit(0), order, str(tmp_path / "none")).count() == 0


def test_one_file_takes_the_old_ones_place(spark, tmp_path):
    path = tmp_path / "r.csv"
    row = ("a", "x", 1, 0.5, 2, 0.1, 0.2, 0.3, 0.4, 0.5, "two\nlines")
    for n in (1, 2):
        results.replace_results(spark.createDataFrame([row] * n, scoreboard.RESULT), str(path))
        assert path.is_file() and results.read_results(spark, str(path)).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.csv"]


def test_clashing_names_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "x"), ("a_b", "y")], "doc string, text string")
    with pytest.raises(ValueError, match="a_b"):
        results.write_texts(rows, str(tmp_path))
    with pytest.raises(ValueError, match="2 rows"):
        results.write_json(rows.unionByName(rows).filter("doc = 'a_b'"), str(tmp_path), "doc")
