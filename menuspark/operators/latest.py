"""Latest row per key and top rows per group, by one window each.

Filters belong before the window. The rank filter stays next to it, so that Spark keeps only the top
rows of each key on both sides of the shuffle (WindowGroupLimit); every order ends in a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_col: str | None = None) -> DataFrame:
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", rank_col) if rank_col else ranked.drop("__rank")


def latest_per_key(df: DataFrame, keys: list[str], time_col: str, id_col: str) -> DataFrame:
    return top_per_key(df, keys, [F.desc(time_col), F.desc(id_col)])


def lateral_top(outer: DataFrame, inner: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each outer row with its best inner row, nulls where there is none."""
    return outer.join(top_per_key(inner, keys, order), keys, "left")


def representative(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order of several keys."""
    return top_per_key(df, keys, order)


def first_distinct(df: DataFrame, keys: list[str], value: str, order: list[Column], n: int, into: str) -> DataFrame:
    """The first ``n`` distinct values of each group in first-occurrence order, as an array.

    Occurrences shrink to one row per value before the rows of a group meet."""
    firsts = top_per_key(df, [*keys, value], order)
    some = top_per_key(firsts, keys, order, n, "__turn")
    return some.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__turn", value))), lambda s: s[value]).alias(into))
