"""Building blocks of the DuckDB equivalents."""

from __future__ import annotations


def fold(c: str) -> str:
    return f"lower(strip_accents({c}))"


def norm(c: str) -> str:
    return f"trim(regexp_replace({fold(c)}, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g'))"


def split(folded: str, least: int = 1) -> str:
    return f"list_filter(string_split_regex({folded}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: len(w) >= {least})"


def words(c: str) -> str:
    return split(norm(c))


def bigrams(normalized: str) -> str:
    return f"CASE WHEN len({normalized}) >= 2 THEN list_distinct(list_transform(range(1, len({normalized})), lambda i: substring({normalized}, i, 2))) ELSE [] END"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def places(x: str, n: int = 4) -> str:
    return f"floor(({x}) * {10**n}.0 + 0.5) / {10**n}.0"


def jaccard(a: str, b: str) -> str:
    union = f"(len({a}) + len({b}) - {common(a, b)})"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE CAST({common(a, b)} AS DOUBLE) / {union} END"


def edit_similarity(a: str, b: str) -> str:
    # DuckDB counts bytes; the one letter that normalization leaves outside ASCII becomes a byte of its own first.
    one = lambda x: f"replace({x}, 'ß', chr(1))"
    return f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein({one(a)}, {one(b)}) AS DOUBLE) / greatest(len({a}), len({b})) END"


def valid_word(w: str) -> str:
    p = fold(w)
    vowels = f"len(regexp_replace({p}, '[^aeiouy]', '', 'g'))"
    fine = f"(regexp_matches({p}, '^[a-z]+$') AND {vowels} > 0 AND NOT regexp_matches({p}, '[bcdfghjklmnpqrstvwxz]{{5}}') AND CAST({vowels} AS DOUBLE) / len({p}) >= 0.15 AND CAST({vowels} AS DOUBLE) / len({p}) <= 0.85)"
    return f"(len({w}) BETWEEN 2 AND 25 AND ((len({w}) <= 5 AND {w} = upper({w}) AND regexp_matches({w}, '[A-Z]')) OR {fine}))"


#: Each user turn with the assistant turn after it: gold and extracted text.
PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS gold, extracted FROM (
    SELECT conv_id, turn, role, text, lead(text) OVER w AS extracted, lead(role) OVER w AS next_role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

#: Pages of conversations.
PAGES = "pages_ AS (SELECT conv_id AS doc, turn AS page_idx, text FROM conversations)"

#: Image placements derived from order lines: supplier as document.
IMAGES = """images AS (
  SELECT l_suppkey AS doc, l_orderkey % 12 AS page_idx, l_orderkey * 10 + l_linenumber AS img_idx,
         CAST(100 + 25 * (CAST(l_quantity AS BIGINT) % 20) AS INTEGER) AS width, CAST(200 + 40 * (l_partkey % 5) AS INTEGER) AS height, l_partkey % 40 AS hash
  FROM lineitem),
counts AS (SELECT doc, 12 AS num_pages FROM images GROUP BY doc)"""
