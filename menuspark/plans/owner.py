"""A restaurant's own dashboard: a 30-day funnel, top dishes, sources, actions and city gaps.

Each report is written for all restaurants at once; one restaurant's page is a filter on its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.clock import fresh_until, within_days
from menuspark.operators.latest import lateral_top, top_per_key
from menuspark.plans import demand
from menuspark.sources.driver_tables import CLICKS, Domain

PERIOD = 30
GAPS = 5
PRIVACY_LEAST = 3


def funnel(d: Domain, as_of: Column) -> DataFrame:
    """Impressions, clicks by kind, and the click-through rate: engaged impressions over impressions."""
    shown = d.impressions.filter(within_days(F.col("created_at"), as_of, PERIOD)).select("impression_id", "restaurant_id")
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in CLICKS]
    clicks = d.conversions.filter(within_days(F.col("occurred_at"), as_of, PERIOD)).groupBy("impression_id").agg(F.count("*").alias("clicks"), *kinds)
    zero = F.lit(0).cast("long")
    grouped = shown.join(clicks, "impression_id", "left").groupBy("restaurant_id").agg(
        F.count("*").alias("impressions"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("clicks", *CLICKS)],
        F.count("clicks").alias("engaged"),
    )
    return grouped.withColumn("ctr", F.round(F.when(F.col("impressions") > 0, F.col("engaged") / F.col("impressions")).otherwise(0.0), 6))


def top_dishes(d: Domain, as_of: Column, limit: int = 10) -> DataFrame:
    """The dishes shown most, by item. Clicks of the window count whatever the impression's age."""
    items = d.impressions.filter(F.col("part_id").isNotNull())
    shown = items.filter(within_days(F.col("created_at"), as_of, PERIOD)).groupBy("restaurant_id", "part_id").agg(F.count("*").alias("impressions"))
    clicked = d.conversions.filter(within_days(F.col("occurred_at"), as_of, PERIOD)).join(items.select("impression_id", "restaurant_id", "part_id"), "impression_id").groupBy("restaurant_id", "part_id").agg(F.count("*").alias("clicks"))
    joined = shown.join(clicked, ["restaurant_id", "part_id"], "left").join(d.impression_items.select("part_id", "name"), "part_id").withColumn("clicks", F.coalesce("clicks", F.lit(0).cast("long")))
    return top_per_key(joined, ["restaurant_id"], [F.desc("impressions"), F.desc("clicks"), F.asc("name"), F.asc("part_id")], limit, "place")


def menu_sources(d: Domain) -> DataFrame:
    """Every source with its latest run's outcome, null where it never ran."""
    runs = d.watch_runs.select("source_id", "outcome", "started_at", "run_id")
    joined = lateral_top(d.menu_sources, runs, ["source_id"], [F.desc("started_at"), F.desc("run_id")])
    return joined.select("restaurant_id", "source_id", "url", "enabled", "last_checked_at", fresh_until(F.col("last_checked_at"), F.col("interval_minutes")).alias("fresh_until"), "failures", F.col("outcome").alias("latest_outcome"))


def actions(d: Domain, as_of: Column) -> DataFrame:
    return d.actions.select("restaurant_id", "action_type", "enabled", "verified_at", "expires_at", (F.col("enabled") & (F.col("expires_at") > as_of)).alias("publishable"))


def city_gaps(d: Domain, event_as_of: Column, menu_as_of: Column, protect: bool = True) -> DataFrame:
    """The first five gaps of each city among the global queue, then those with enough searches to show."""
    queue = demand.queue(demand.signals(d, event_as_of, menu_as_of)).withColumn("place_city", F.lower("city"))
    gaps = top_per_key(queue, ["place_city"], demand.queue_order(), GAPS)
    shown = gaps.filter(F.col("searches") >= PRIVACY_LEAST) if protect else gaps
    return shown.select("place_city", "normalized_query", "searches", "signal")
