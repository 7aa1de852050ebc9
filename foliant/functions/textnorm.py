"""Text normalization as column expressions, all on the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is one blank after normalization; the byte order mark counts too.
BLANKS = r"(?U)[\s\x{FEFF}]+"
WORD_BREAK = r"[^\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Letters whose canonical decomposition has one base letter, and these letters."""
    source, base = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(code)) if unicodedata.decomposition(chr(code)) else ""
        letters = [c for c in parts if not unicodedata.category(c).startswith("M")]
        if len(parts) > 1 and len(letters) == 1 or len(parts) == 1 and parts != chr(code) and code < 0x10000:
            source.append(chr(code))
            base.append(letters[0] if letters else parts)
    return "".join(source), "".join(base)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of *value*, which is worked out once however often the body names it, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def strip_marks(text: Column) -> Column:
    """Canonical decomposition without its marks; ASCII texts are passed over."""
    source, base = _bases()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, source, base), r"\p{M}", "")).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case without marks; blanks stay as they are."""
    return F.lower(strip_marks(text))


def normalize(text: Column) -> Column:
    """``fold``, runs of blanks made one, none at the ends."""
    return F.trim(F.regexp_replace(fold(text), BLANKS, " "))


def split_words(folded: Column, least: int = 1) -> Column:
    """Words of a folded text, those of at least *least* letters."""
    parts = F.array_remove(F.split(folded, WORD_BREAK), "")
    return parts if least <= 1 else F.filter(parts, lambda w: F.length(w) >= least)


def words(text: Column) -> Column:
    """Words of the normalized text."""
    return split_words(normalize(text))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))


def bigrams(normalized: Column) -> Column:
    """Distinct pairs of neighbouring characters, blanks and marks included.

    One pass of a pattern that looks ahead; taking substrings by place would read the text anew for each of them.
    """
    return F.array_distinct(F.coalesce(F.regexp_extract_all(normalized, F.lit("(?s)(?=(..))"), 1), F.array().cast("array<string>")))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def places(x: Column, n: int) -> Column:
    """*x* at *n* decimal places, halves up; both engines agree on this form."""
    return F.floor(x * F.lit(10.0**n) + F.lit(0.5)) / F.lit(10.0**n)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or *empty* if the whole is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole)
