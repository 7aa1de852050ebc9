"""Each pipeline stage on planted cases, and the whole chain."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import awkward, prose
from tests.llm.test_scores import corpus
from tests.llm.test_tokens import check_packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, a boilerplate line, near copies, and a long passage that documents share."""
    path = str(tmp_path_factory.mktemp("tables"))
    base, toxic, _ = corpus(400)
    texts = {i: t for i, t in base.items() if "###" not in t and len(set(t.split(" "))) > 1}
    passage, copy = prose(900, 120), prose(901, 150)
    texts |= {1000 + i: prose(1000 + i, 60) + "\nShared menu line\n" + prose(2000 + i, 60) for i in range(30)}
    texts |= {1100: copy, 1101: copy + " more", 1102: copy, 1103: None, 1104: "", 1105: prose(7, 6000)}
    texts |= {1200 + i: prose(1200 + i, 40) + " " + passage + " " + prose(1300 + i, 40) for i in range(3)}
    rows = [(i, t, "en", "s1" if i >= 1000 else "s2", None if t is None else len(t), 1) for i, t in texts.items()]
    rows += [(1100, copy, "en", "s1", len(copy), 1), (None, prose(77, 50), "en", "s1", 5, 1)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic[i]) for i in toxic if i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, {i: toxic[i] for i in toxic if i in texts}, passage


def test_stages(spark, folder, tmp_path):
    path, texts, toxic, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        kept[name, "n"] = docs.count()
    unseen = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1]
    gone = set(texts) - set(kept["toxicity"])
    assert gone <= {i for i in toxic if toxic[i]} | {1103, 1104} and sum(i in gone for i in unseen if toxic[i]) >= 0.95 * sum(toxic[i] for i in unseen)
    assert None in kept["toxicity"]
    lines = kept["line_dedup"]
    assert all("Shared menu" not in (r["text"] or "") for r in lines.values()) and lines[1000]["n_chars"] == len(lines[1000]["text"])
    assert len([i for i in (1100, 1101, 1102) if i in kept["near_dedup"]]) == 1 and 1100 in kept["near_dedup"] and None in kept["near_dedup"]
    assert kept["near_dedup", "n"] == kept["line_dedup", "n"] - 3
    for i in range(3):
        text = kept["suffix_dedup"][1200 + i]["text"]
        assert passage[:300] not in text and prose(1200 + i, 40)[:150] in text
    final = {i: r["text"] for i, r in kept["suffix_dedup"].items()}
    rows = corpus_pipeline.pack(spark, docs, path).collect()
    check_packing(rows, final, 2048)


def test_unlike_texts_of_one_id(spark):
    """Rows of one id whose texts are unlike are all kept; repeated rows, and copies of either text, are not."""
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    rows = [(5, a), (5, b), (5, b), (3, a + " end"), (7, b + " end"), (8, c), (8, c), (9, ""), (9, None), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1) for i, t in rows], COLUMNS)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(5, b), (3, a + " end"), (8, c), (9, ""), (9, None), (None, c)], key=str)


def test_rare_boilerplate(spark):
    """Lines on 6 to 10 % of a large host's pages go; those of copies, and of groups of copies on a small host, stay."""
    texts = {i: prose(i, 12) for i in range(400)}
    for line, pages in (("Six", range(24)), ("Ten", range(20, 60)), ("Five", range(60, 80)), ("Three", range(80, 100, 2))):
        texts |= {i: f"{line}\n{texts[i]}" for i in pages}
    copies = {i: "Copied\n" + prose(7777, 12) for i in range(400, 430)}
    small = {i: prose(i, 12) for i in range(500, 546)} | {i: f"Group\n{prose(8888, 12)}\n{i}" for i in range(546, 550)}
    rows = [(i, t, "en", "small" if i >= 500 else "large", 1, 1) for i, t in (texts | copies | small).items()]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_boilerplate(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert not any(w in out[i] for i in range(400) for w in ("Six", "Ten"))
    assert all(out[i] == texts[i] for i in range(60, 100))
    assert all(out[i] == t for i, t in (copies | small).items())


def test_short_passages(spark):
    """Passages of 51 to 60 words, which are shorter than 400 bytes, go; one of 50 words stays."""
    planted = {n: " ".join(x[:6] for x in prose(700 + n, n).split(" ")) for n in range(50, 61)}
    assert all(len(p) < 400 for p in planted.values())
    rows = [(10 * n + i, f"{prose(10 * n + i, 40)} {p} {prose(5000 + 10 * n + i, 40)}", "en", "s", 1, 1) for n, p in planted.items() for i in range(2)]
    out = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    for i, text, *_ in rows:
        assert (planted[i // 10] in out[i]["text"]) == (i // 10 == 50) and prose(i, 40) in out[i]["text"]
        assert out[i]["n_chars"] == len(out[i]["text"]) and (i // 10 == 50) == (out[i]["text"] == text)


def test_run_equals_the_stages(spark, folder, tmp_path):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    out = corpus_pipeline.run(spark, path)
    assert out.columns == docs.columns

    def pieces(rows):  # which sequence a piece is in depends on how rows are dealt out; the pieces don't
        return sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows.collect())

    assert pieces(out) == pieces(docs) and {r["doc_id"] for r in docs.collect()} >= {None, 1000, 1105}


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder[0])
        assert out.count() == 0
        if i < 4:
            docs = spark.createDataFrame([], out.schema)


def test_columns_named_like_results(spark, folder):
    """Columns named like the operators' results come out of each stage as they went in."""
    named = {"score": 7.0, "component_id": -3, "kept": False, "n_lines": 9, "spans": "s", "rk": 4, "n_shingles": 2}
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter("doc_id >= 1190 OR doc_id < 30")
    for name, value in named.items():
        docs = docs.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns, name
        assert out.select(*named).distinct().collect() == [tuple(named.values())], name


def test_rows_that_share_a_hash_get_another(spark, monkeypatch):
    real, texts = F.xxhash64, [(i, f"text {i}") for i in range(40)]
    docs = awkward(spark, [*texts, (3, "text 3"), (3, "other"), (4, None)])
    want = docs.select("doc_id", "text").distinct().count()
    plain = docs.withColumn("row", corpus_pipeline._row_ids(docs)).select("doc_id", "text", "row").distinct()
    assert plain.count() == want == plain.select("row").distinct().count()
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(30)) if len(c) == 2 else real(*c))
    ids = corpus_pipeline._row_ids(docs)
    monkeypatch.undo()
    rows = docs.withColumn("row", ids).select("doc_id", "text", "row").distinct()
    assert rows.count() == want == rows.select("row").distinct().count()
