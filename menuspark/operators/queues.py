"""Bounded work lists, samples and order restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuspark.storage import materialize


def bounded(limit: int, least: int = 1, most: int = 100) -> int:
    return max(least, min(most, int(limit)))


def due(sources: DataFrame, as_of: Column, id_col: str, limit: int = 25) -> DataFrame:
    """Enabled sources whose next check has come, earliest first."""
    return sources.filter(F.col("enabled") & (F.col("next_check_at") <= as_of)).orderBy("next_check_at", id_col).limit(bounded(limit))


def expiring(actions: DataFrame, as_of: Column, days: int = 7, limit: int = 100) -> DataFrame:
    """Enabled actions that expire within ``days`` or have expired, earliest first."""
    soon = F.col("expires_at") <= as_of + F.make_dt_interval(F.lit(days))
    return actions.filter(F.col("enabled") & soon).orderBy("expires_at", "restaurant_id", "action_type").limit(bounded(limit))


def evenly_spaced(df: DataFrame, order: list[str], k: int, groups: list[str] | None = None) -> DataFrame:
    """k rows spread evenly over each group's order: indices round(i * (n - 1) / (k - 1)).

    All rows if there are at most k; the first if k is 1. Without groups the order is that of the whole
    table: rows are sorted by range, and only the sizes of the ranges meet the driver."""
    if groups:
        spec = Window.partitionBy(*groups)
        at = df.withColumn("__i", F.row_number().over(spec.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(spec))
    else:
        ranged = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "spaced")
        sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
        starts, total = [], 0
        for part, n in sizes:
            starts.append((part, total))
            total += n
        offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
        turn = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
        at = ranged.withColumn("__turn", turn).join(F.broadcast(offsets), "__part").withColumn("__i", F.col("__start") + F.col("__turn") - 1).withColumn("__n", F.lit(total)).drop("__part", "__start", "__turn")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(1, k - 1)) + 0.5))
    return at.filter((F.col("__n") <= k) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")


def in_given_order(df: DataFrame, id_col: str, ids: list) -> DataFrame:
    """Rows whose id is listed, with their place in the list (from 1)."""
    listed = F.array(*map(F.lit, ids))
    return df.filter(F.col(id_col).isin(ids)).withColumn("place", F.array_position(listed, F.col(id_col)))


def values_relation(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def unnested(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays side by side as rows."""
    return df.select(*keys, F.inline(F.arrays_zip(*arrays)))
