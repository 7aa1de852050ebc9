"""Joins of rows with a table of counted keys, some of which may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of all rows (so fewer than 1,000 of them) are told to all tasks.
SHARE = 1000


def with_counted(rows: DataFrame, keys: DataFrame, key: str, size: str) -> DataFrame:
    """*rows* joined with *keys*, a written table of distinct keys and their numbers of rows *size*.

    The keys of many rows, fewer than SHARE by their share, are broadcast, so that their rows stay where they are; the
    rows of all other keys meet them in a shuffle whose largest key has less than a thousandth of them.
    """
    total = keys.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    often = F.broadcast(keys.filter(F.col(size) * SHARE > total))
    rare = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(keys.filter(F.col(size) * SHARE <= total), key)
    return rows.join(often, key).unionByName(rare)
