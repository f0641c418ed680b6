"""Mutable state without MERGE: projections over append-only rows, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.operators.latest import top_per_key
from menuspark.sources.manifests import write_exclusive


class StaleWriteError(RuntimeError):
    """The snapshot that a write expected to follow is no longer the latest."""


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Insert or replace by key: of all rows with a key the last in ``version`` order stays."""
    return top_per_key(current.unionByName(changes), keys, version)


def insert_absent(current: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of ``incoming`` to append: the first of each key, of keys not stored yet."""
    return top_per_key(incoming, [key], order).join(current.select(key), key, "left_anti")


def changed_where(current: DataFrame, new_values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` differ (nulls compare equal), with the new values."""
    fresh = new_values.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    return current.join(fresh, keys).filter(differs).select(*keys, *[F.col(f"__new_{c}").alias(c) for c in columns])


def replace_set(current: DataFrame, replacement: DataFrame, owner: str) -> DataFrame:
    """Owners named in ``replacement`` get exactly its rows; others keep theirs."""
    return current.join(replacement.select(owner).distinct(), owner, "left_anti").unionByName(replacement)


def single_authority(sources: DataFrame, group: str, id_col: str, authority: DataFrame) -> DataFrame:
    """``enabled`` is true for the named id of each group and false for its other rows; groups without a
    named id keep their state."""
    named = authority.select(group, F.col(id_col).alias("__authority"))
    return sources.join(named, group, "left").withColumn("enabled", F.coalesce(F.col(id_col) == F.col("__authority"), F.col("enabled"))).drop("__authority")


def append_snapshot(path: str, stored: DataFrame, facts: dict[str, DataFrame], source_id: int, expected: int | None) -> None:
    """Append one observation's facts if ``expected`` is still the source's latest snapshot.

    The right to follow a snapshot is a file of its name, created exclusively, so of two writers that
    expect the same snapshot one fails. Facts are written before the snapshots table, which readers join
    to, so a reader never sees half an observation. ``stored`` holds (source_id, snapshot_id, fetched_at).
    """
    spark = stored.sparkSession
    latest = stored.filter(F.col("source_id") == source_id).agg(F.max(F.struct("fetched_at", "snapshot_id")).alias("l")).first()["l"]
    found = latest["snapshot_id"] if latest else None
    if found != expected:
        raise StaleWriteError(f"source {source_id}: expected {expected}, found {found}")
    if not write_exclusive(spark, f"{path}/_follows/{source_id}-{expected}", ""):
        raise StaleWriteError(f"source {source_id}: another writer follows {expected}")
    for name in [*[n for n in facts if n != "snapshots"], *[n for n in facts if n == "snapshots"]]:
        facts[name].write.mode("append").parquet(f"{path}/{name}")


def missing(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")


def merge_by_name(primary: DataFrame, supplement: DataFrame, keys: list[str]) -> DataFrame:
    """``primary`` and the rows of ``supplement`` whose keys it lacks."""
    return primary.unionByName(supplement.join(primary.select(*keys).distinct(), keys, "left_anti"))


def schema_gaps(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str | None]]:
    """Columns that are missing or of another type: (name, wanted, found)."""
    found = dict(df.dtypes)
    return [(c, t, found.get(c)) for c, t in expected.items() if found.get(c) != t]
