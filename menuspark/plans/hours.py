"""Opening-hours observations: gate outcomes along each source's history, and the verification log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from menuspark.operators.snapshots import hours_gate
from menuspark.sources.driver_tables import Domain


def observation_outcomes(d: Domain) -> DataFrame:
    """What each observation would have done, given the one before it."""
    order = Window.partitionBy("hours_source_id").orderBy("fetched_at", "hours_snapshot_id")
    seen = d.hours_snapshots.withColumn("previous", F.lag("interval_count").over(order)).withColumn("old_print", F.lag("fingerprint").over(order)).withColumn("old_version", F.lag("extractor").over(order))
    joined = seen.join(d.hours_sources.select("hours_source_id", "minimum_intervals"), "hours_source_id")
    outcome = hours_gate(F.col("previous"), F.col("interval_count"), F.col("minimum_intervals"), F.col("fingerprint").eqNullSafe(F.col("old_print")), F.col("extractor").eqNullSafe(F.col("old_version")))
    return joined.select("hours_snapshot_id", "hours_source_id", outcome.alias("outcome"))


def stale_observations(d: Domain) -> DataFrame:
    """(hours_snapshot_id) of observations that arrive after one fetched later and so are rejected. They
    arrive in the order of their ids."""
    before = Window.partitionBy("hours_source_id").orderBy("hours_snapshot_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = d.hours_snapshots.withColumn("checked", F.max("fetched_at").over(before))
    return seen.filter("fetched_at < checked").select("hours_snapshot_id", "hours_source_id")


#: Outcomes of an hours watch that count as failed.
FAILED = ("quarantined", "extraction_error", "fetch_error", "unexpected_error")


def watch_summary(results: DataFrame, due: int | None = None) -> DataFrame:
    """One row: due, failed, blocking and non-blocking failed watches. A failure of a source whose hours are
    provisional or unverified does not block, unless it was unexpected. ``results`` (outcome,
    verification_status or null)."""
    failed = F.col("outcome").isin(*FAILED)
    lenient = F.coalesce(F.col("verification_status").isin("provisional", "unverified"), F.lit(False)) & (F.col("outcome") != "unexpected_error")
    counted = F.count("*") if due is None else F.lit(due).cast("long")
    return results.agg(counted.alias("due"), F.count_if(failed).alias("failed"), F.count_if(failed & ~lenient).alias("blocking_failed"), F.count_if(failed & lenient).alias("non_blocking_failed"))


def verification_log(d: Domain) -> DataFrame:
    """Sources whose hours are not verified, by status and restaurant."""
    rows = d.hours_sources.filter("verification_status <> 'verified'")
    return rows.join(d.restaurants.select("restaurant_id", "slug"), "restaurant_id").select("slug", "verification_status", "last_checked_at").orderBy("verification_status", "slug")
