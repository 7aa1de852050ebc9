"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long, _text string, n_lines long"


def prose(seed: int, words: int) -> str:
    g = random.Random(seed)
    parts = ("al", "be", "cor", "du", "en", "fi", "gan", "ho", "ir", "ju", "ka", "lom")
    return " ".join("".join(g.choices(parts, k=g.randint(1, 3))) + g.choice(("", "", "", ",", ".")) for _ in range(words))


def awkward(spark, texts: dict | list, source: str = "s"):
    """A documents table with more columns than needed, some named like results."""
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    rows = [(i, t, "en", source, None if t is None else len(t), 9.0, False, -1, "x", 7) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)
