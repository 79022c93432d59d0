"""Joins with a table of one row a key, where a few keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 100  # rows from which a key may be heavy
MOST = 10_000  # heavy keys at most: each has over a MOST-th of all rows


def heavy_from(total: int) -> int:
    return max(LEAST, -(-total // MOST))


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined (inner) with table, which has a row a key and says in `count` how many of the `total` rows have it. Keys are not null.

    Keys of more rows than heavy_from(total), of which there are MOST at most, are told to all tasks, so that their rows stay where they are;
    all other keys are shuffled.
    """
    over = heavy_from(total)
    heavy = F.broadcast(table.where(F.col(count) > over))
    light = table.where(F.col(count) <= over)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys))
