"""The current index: items of each fresh source's latest snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.clock import fresh_until, is_fresh
from menuspark.operators.latest import latest_per_key
from menuspark.sources.driver_tables import Domain


def published_sources(d: Domain, as_of: Column, fresh: bool = True) -> DataFrame:
    """Enabled sources of active restaurants, fresh ones unless told otherwise. Filters come before any
    window, so they reach the scan."""
    sources = d.menu_sources.filter("enabled").withColumnRenamed("url", "source_url")
    if fresh:
        sources = sources.filter(is_fresh(as_of, F.col("last_checked_at"), F.col("interval_minutes")))
    return sources.join(d.restaurants.filter("active"), "restaurant_id")


def latest_snapshots(d: Domain, as_of: Column, fresh: bool = True) -> DataFrame:
    """One snapshot per published source, with the source's and the restaurant's columns."""
    published = published_sources(d, as_of, fresh)
    latest = latest_per_key(d.snapshots.join(published.select("source_id"), "source_id", "left_semi"), ["source_id"], "fetched_at", "snapshot_id")
    return latest.join(published, "source_id").withColumn("fresh_until", fresh_until(F.col("last_checked_at"), F.col("interval_minutes")))


def current_items(d: Domain, as_of: Column, fresh: bool = True, city: str | None = None) -> DataFrame:
    latest = latest_snapshots(d, as_of, fresh)
    if city is not None:
        latest = latest.filter(F.lower("city") == city.lower())
    return d.items_of(latest.withColumnRenamed("name", "restaurant_name"))
