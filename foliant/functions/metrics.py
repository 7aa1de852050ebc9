"""Similarity of an extracted text and its gold text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.textnorm import WORD_BREAK, bigrams, distinct_words, let, normalize, ratio, split_words, strip_marks

#: Longest text, in letters, for which the table-filling built-in distance is used.
SHORT = 512


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance with one bit per letter of *a* (Myers 1999, Hyyro 2003), in time len(b) * len(a) / 64."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
    return score


def _long_distance(a: Column, b: Column) -> Column:
    import pandas as pd

    def distance(a, b):
        return pd.Series([None if x is None or y is None else bit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return F.pandas_udf(distance, "int")(a, b)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points: the built-in for short texts, bit-parallel for long ones."""
    long_ = F.greatest(F.length(a), F.length(b)) > SHORT
    return F.when(long_, _long_distance(F.when(long_, a), F.when(long_, b))).otherwise(F.levenshtein(F.when(~long_, a), F.when(~long_, b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, of normalized texts; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - edit_distance(a, b) / longer)


def coverage(extracted: Column, gold: Column) -> Column:
    """Share of the gold words (distinct) that the extracted words hold; without gold 1 or 0, as nothing is extracted or something."""
    return F.when(F.size(gold) == 0, F.when(F.size(extracted) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(extracted, gold)) / F.size(gold))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of distinct arrays; 1 if both are empty."""
    return let(F.struct(a.alias("a"), b.alias("b"), F.size(F.array_intersect(a, b)).alias("n")), lambda x: ratio(x["n"], F.size(x["a"]) + F.size(x["b"]) - x["n"], 1.0))


def relative_length(extracted: Column, gold: Column) -> Column:
    """Length over gold length, both normalized; 0 without gold."""
    return ratio(F.length(extracted), F.length(gold), 0.0)


def valid_word(word: Column, plain: Column | None = None) -> Column:
    """Whether a word in its first spelling looks like one of a language; *plain* is the word in lower case without marks.

    2 to 25 letters; capitals of at most 5 with a Latin capital are an abbreviation; otherwise only a-z once marks are
    off, with a vowel, no five consonants in a row, and vowels between 15 and 85 in a hundred.
    """
    plain = folded_word(word) if plain is None else plain
    n, vowels = F.length(plain), F.length(F.regexp_replace(plain, "[^aeiouy]", ""))
    right = plain.rlike("^[a-z]+$") & ~plain.rlike("[bcdfghjklmnpqrstvwxz]{5}") & (vowels > 0) & (vowels / n >= 0.15) & (vowels / n <= 0.85)
    short = (F.length(word) <= 5) & (word == F.upper(word)) & word.rlike("[A-Z]")
    return F.length(word).between(2, 25) & (short | right)


def folded_word(word: Column) -> Column:
    """A word in lower case without marks."""
    return F.lower(strip_marks(word))


def spelled_words(text: Column) -> Column:
    """The words of a raw text as they stand there."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def surplus_pairs(spelled: Column, gold_words: Column) -> Column:
    """Folded words of *spelled* that the gold's distinct words lack, each (f) with the spelling (w) that comes first.

    The raw text is split first and words are folded after, so marks of decomposed letters break words.
    """

    def new(folded: Column) -> Column:
        more = F.array_except(F.array_remove(folded, ""), gold_words)
        return F.transform(more, lambda f: F.struct(f.alias("f"), F.element_at(spelled, F.array_position(folded, f).cast("int")).alias("w")))

    return let(F.transform(spelled, folded_word), new)


def surplus_words(extracted: Column, gold: Column) -> Column:
    """The words that the extracted text has beyond the gold's, each in the spelling that comes first."""
    return F.transform(surplus_pairs(spelled_words(extracted), distinct_words(gold)), lambda x: x["w"])


def pairs_quality(pairs: Column) -> Column:
    """Share of valid words among ``surplus_pairs``; 1 without any."""
    return ratio(F.size(F.filter(pairs, lambda x: valid_word(x["w"], x["f"]))), F.size(pairs), 1.0)


def surplus_quality(extracted: Column, gold: Column) -> Column:
    """Share of valid words among the surplus; 1 without surplus."""
    return let(surplus_pairs(spelled_words(extracted), distinct_words(gold)), pairs_quality)


def with_metrics(df: DataFrame, extracted: str, gold: str) -> DataFrame:
    """*df* with the five metrics as columns of their own, so that unused ones are pruned.

    What several metrics need is projected first: normalized texts, their distinct words, their bigrams, the surplus.
    """
    base = df.withColumns({"_a": normalize(F.col(extracted)), "_b": normalize(F.col(gold))})
    base = base.withColumns({"_wa": F.array_distinct(split_words(F.col("_a"))), "_wb": F.array_distinct(split_words(F.col("_b"))), "_ba": bigrams(F.col("_a")), "_bb": bigrams(F.col("_b")), "_s": spelled_words(F.col(extracted))})
    base = base.withColumns({"_u": surplus_pairs(F.col("_s"), F.col("_wb")), "_n": F.size(F.array_intersect("_ba", "_bb"))})
    return base.withColumns({
        "sim_lev": edit_similarity(F.col("_a"), F.col("_b")),
        "cov": coverage(F.col("_wa"), F.col("_wb")),
        "sim_bi": ratio(F.col("_n"), F.size("_ba") + F.size("_bb") - F.col("_n"), 1.0),
        "rel_len": relative_length(F.col("_a"), F.col("_b")),
        "excess_q": pairs_quality(F.col("_u")),
    }).drop("_a", "_b", "_wa", "_wb", "_ba", "_bb", "_s", "_u", "_n")


def shared_words(extracted: DataFrame, gold: DataFrame, extracted_id: str, gold_id: str, text: str = "text") -> DataFrame:
    """For each pair with a common word: how many words they share, and how many the gold text has.

    Words are joined as rows; counts are summed partially before the shuffle by pair.
    """
    left = extracted.select(extracted_id, F.explode(distinct_words(F.col(text))).alias("_w"))
    right = gold.select(gold_id, distinct_words(F.col(text)).alias("_g")).select(gold_id, F.size("_g").cast("long").alias("gold_words"), F.explode("_g").alias("_w"))
    return left.join(right, "_w").groupBy(gold_id, extracted_id).agg(F.count("*").alias("shared"), F.first("gold_words").alias("gold_words"))
