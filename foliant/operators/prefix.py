"""Ordered operators that do not gather a group in one task.

A window over a key sorts all rows of the key in one task. Here rows are cut into blocks of the order column; blocks are summed up
first, the sums are accumulated over the (few) blocks, and windows run inside blocks only. A key with a third of all rows is then as
many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about, if the values of the order column lie evenly.
BLOCK = 50_000


def _blocks(df: DataFrame, order: str, block: int | None) -> DataFrame:
    """Rows with the number of their block. Its width follows from the range and count of the order column, so sparse values (ids of
    other tables, times) give as few blocks as dense ones."""
    if block is None:
        low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
        block = max(1, int((high - low + 1) * BLOCK / max(n, 1))) if n else BLOCK
    return df.withColumn("__block", F.floor(F.col(order) / block))


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int | None = None) -> DataFrame:
    """Adds the running sum of `value` over rows of a key in order; equal positions get the sum after all of them."""
    rows = _blocks(df.withColumn("__value", value), order, block)
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(
        Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.sum("__value").over(Window.partitionBy(*keys, "__block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__inside", inside).join(before, [*keys, "__block"])
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).drop("__block", "__value", "__inside", "__before")


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int | None = None) -> DataFrame:
    """Adds the last value that is not null at or before each row of a key."""
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    rows = _blocks(df, order, block)
    lasts = rows.where(F.col(value).isNotNull()).groupBy(*keys, "__block").agg(F.max_by(value, order).alias("__last"))
    have = rows.select(*keys, "__block").distinct().join(lasts, [*keys, "__block"], "left")
    before = have.withColumn("__before", F.last("__last", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__inside", inside).join(before, [*keys, "__block"])
    return joined.withColumn(out, F.coalesce("__inside", "__before")).drop("__block", "__inside", "__before", "__all")


def newest(df: DataFrame, keys: list[str], by: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The n first rows of each key in the given order, ranked; a limit inside blocks of a hash first keeps hot keys apart."""
    spread = Window.partitionBy(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(64))).orderBy(*by)
    few = df.withColumn("__r", F.row_number().over(spread)).where(F.col("__r") <= n).drop("__r")
    return few.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(out) <= n)
