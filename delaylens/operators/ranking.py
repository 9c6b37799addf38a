"""Ranks, shares and top rows without a global window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tally import running_totals


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """For each distinct value (of each key): ``rows``, ``below`` (rows with smaller values), ``total`` and the average ``rank``.

    Rows are counted by value first; without keys the values are summed in
    ranges, so no task holds them all.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rows"))
    out = running_totals(counted, value, ["rows"], keys).withColumnsRenamed({"rows_before": "below", "rows_total": "total"})
    return out.withColumn("rank", F.col("below") + (F.col("rows") + 1) / 2.0)


def load_percentile(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Average rank of ``value`` among its key's rows, divided by their number."""
    ranks = value_ranks(df, value, [key]).select(F.col(key).alias("_k"), F.col(value).alias("_v"), (F.col("rank") / F.col("total")).alias(name))
    return df.join(ranks, (F.col(key) == F.col("_k")) & (F.col(value) == F.col("_v")), "left").drop("_k", "_v")


def share_of(column: str, keys: Sequence[str] = ()) -> Column:
    """A row's part of its group's total."""
    return F.try_divide(F.col(column).cast("double"), F.sum(column).over(Window.partitionBy(*(keys or [F.lit(1)]))))


def group_total(column: str, keys: Sequence[str]) -> Column:
    return F.sum(column).over(Window.partitionBy(*keys))


def top_rows(df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, of each key if there are keys; ``order`` should end in a key to break ties."""
    if not keys:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def step_change(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``change`` of ``value`` from the row before."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order)))
