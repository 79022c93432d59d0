"""Integer codes of the binary formats as columns: zigzag, deltas, string codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1).cast("bigint"))))


def delta_encode(df: DataFrame, column: str, *, block: list[str], order: list[str], out: str) -> DataFrame:
    """Difference to the row before, from 0 at a block's start."""
    return df.withColumn(out, F.col(column) - F.lag(column, 1, 0).over(Window.partitionBy(*block).orderBy(*order)))


def delta_decode(df: DataFrame, column: str, *, block: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.sum(column).over(Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def string_codes(strings: DataFrame, *, block: list[str], text: str, order: str) -> DataFrame:
    """Each distinct string of a block with its code: 1 for the first seen, and so on (0 stands for the empty string)."""
    first = strings.groupBy(*block, text).agg(F.min(order).alias("_first"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy(*block).orderBy("_first", text))).drop("_first")
