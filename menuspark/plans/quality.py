"""The quality dashboard: source health, zero results, matching and canonical coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.clock import action_status, fresh_until, source_health, within_days
from menuspark.operators.latest import latest_per_key
from menuspark.plans.demand import resolved
from menuspark.plans.index import current_items
from menuspark.sources.driver_tables import MATCH_TYPES, Domain


def latest_item_counts(d: Domain) -> DataFrame:
    """(source_id, item_count) of each source's latest snapshot, menus without items included."""
    latest = latest_per_key(d.snapshots, ["source_id"], "fetched_at", "snapshot_id")
    counts = d.items.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    return latest.join(counts, "snapshot_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("item_count"))


def latest_runs(d: Domain) -> DataFrame:
    return latest_per_key(d.watch_runs, ["source_id"], "started_at", "run_id").select("source_id", F.col("outcome").alias("last_outcome"), F.col("error_code").alias("last_error_code"))


def restaurant_demand(d: Domain, as_of: Column, days: int = 7) -> DataFrame:
    """Impressions and the conversions they led to, both within the window."""
    shown = d.impressions.filter(within_days(F.col("created_at"), as_of, days) & F.col("restaurant_id").isNotNull())
    clicks = d.conversions.filter(within_days(F.col("occurred_at"), as_of, days)).groupBy("impression_id").agg(F.count("*").alias("clicks"))
    return shown.join(clicks, "impression_id", "left").groupBy("restaurant_id").agg(F.count("*").alias("impressions_7d"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("conversions_7d"))


def sources(d: Domain, menu_as_of: Column, event_as_of: Column) -> DataFrame:
    """One row per restaurant and menu source; restaurants without a source do not appear."""
    hours = d.hours_sources.select("restaurant_id", "hours_source_id", F.col("enabled").alias("hours_enabled"), F.col("last_checked_at").alias("hours_checked_at"), F.col("interval_minutes").alias("hours_interval"), F.col("failures").alias("hours_failures"))
    schedules = latest_per_key(d.hours_snapshots, ["hours_source_id"], "fetched_at", "hours_snapshot_id").select("hours_source_id", "interval_count")
    joined = (
        d.restaurants.join(d.menu_sources, "restaurant_id")
        .join(latest_item_counts(d), "source_id", "left")
        .join(latest_runs(d), "source_id", "left")
        .join(hours, "restaurant_id", "left")
        .join(schedules, "hours_source_id", "left")
        .join(restaurant_demand(d, event_as_of), "restaurant_id", "left")
    )
    health = source_health(F.col("enabled"), menu_as_of, F.col("last_checked_at"), F.col("interval_minutes"), F.col("failures"), F.col("last_outcome"))
    hours_health = F.when(F.col("hours_source_id").isNotNull(), source_health(F.coalesce("hours_enabled", F.lit(False)), menu_as_of, F.col("hours_checked_at"), F.col("hours_interval"), F.col("hours_failures"), F.lit(None).cast("string"))).otherwise("unverified")
    zero = F.lit(0).cast("long")
    return joined.select(
        "restaurant_id",
        "source_id",
        "active",
        health.alias("health"),
        hours_health.alias("hours_health"),
        F.coalesce("item_count", zero).alias("item_count"),
        F.coalesce(F.col("interval_count").cast("long"), zero).alias("interval_count"),
        fresh_until(F.col("last_checked_at"), F.col("interval_minutes")).alias("fresh_until"),
        "last_outcome",
        "last_error_code",
        F.coalesce("impressions_7d", zero).alias("impressions_7d"),
        F.coalesce("conversions_7d", zero).alias("conversions_7d"),
    )


def report(d: Domain, menu_as_of: Column, event_as_of: Column) -> DataFrame:
    """The whole report as one row: the totals of all sections."""
    one = F.lit(1).alias("one")
    parts = (totals(d, menu_as_of, event_as_of), window_counts(d, event_as_of), unresolved_zero_total(d, event_as_of, menu_as_of), match_types(d, event_as_of), hours_totals(d, menu_as_of, event_as_of), action_totals(d, menu_as_of))
    whole = parts[0].select("*", one)
    for part in parts[1:]:
        whole = whole.join(part.select("*", one), "one")
    return whole.drop("one")


def hours_totals(d: Domain, menu_as_of: Column, event_as_of: Column) -> DataFrame:
    """One row: restaurants by the health of their hours, and the intervals that are published."""
    own = sources(d, menu_as_of, event_as_of).select("restaurant_id", "hours_health", "interval_count").distinct()
    return own.agg(*[F.count_if(F.col("hours_health") == h).alias(f"hours_{h}") for h in ("healthy", "degraded", "stale", "unverified", "disabled")], F.sum("interval_count").alias("intervals"))


def action_totals(d: Domain, as_of: Column) -> DataFrame:
    return action_report(d, as_of).agg(*[F.count_if(F.col("status") == s).alias(f"actions_{s}") for s in ("verified", "expiring", "expired", "disabled")])


def totals(d: Domain, menu_as_of: Column, event_as_of: Column) -> DataFrame:
    """One row. Every enabled source that is not healthy counts as degraded, stale ones too."""
    rows = sources(d, menu_as_of, event_as_of)
    health = F.col("health")
    return rows.agg(
        F.countDistinct(F.when(F.col("active"), F.col("restaurant_id"))).alias("active_restaurants"),
        F.countDistinct(F.when(~F.col("active"), F.col("restaurant_id"))).alias("candidate_restaurants"),
        F.count("*").alias("menu_sources"),
        F.count_if(health == "healthy").alias("healthy_sources"),
        F.count_if(~health.isin("healthy", "disabled")).alias("degraded_sources"),
        F.sum("item_count").alias("current_items"),
    )


def action_report(d: Domain, as_of: Column) -> DataFrame:
    return d.actions.select("restaurant_id", "action_type", "enabled", "expires_at", action_status(F.col("enabled"), F.col("expires_at"), as_of).alias("status"))


def zero_results(d: Domain, event_as_of: Column, menu_as_of: Column, limit: int = 40) -> DataFrame:
    """The most frequent zero-result queries, unresolved ones first."""
    history = d.searches.filter((F.col("result_count") == 0) & within_days(F.col("occurred_at"), event_as_of, 7)).groupBy("normalized_query", "city").agg(F.count("*").alias("count_7d"), F.max("occurred_at").alias("last_seen_at"))
    found = resolved(d, history, menu_as_of)
    return found.orderBy(F.desc(F.col("current_resolution").isNull()), F.desc("count_7d"), F.desc("last_seen_at"), "normalized_query", "city").limit(limit)


def unresolved_zero_total(d: Domain, event_as_of: Column, menu_as_of: Column) -> DataFrame:
    """Searches behind the unresolved queries of the 40 listed, as the report counts them."""
    return zero_results(d, event_as_of, menu_as_of).agg(F.coalesce(F.sum(F.when(F.col("current_resolution").isNull(), F.col("count_7d"))), F.lit(0)).alias("unresolved_zero_results"))


def window_counts(d: Domain, as_of: Column) -> DataFrame:
    zero = d.searches.filter((F.col("result_count") == 0) & within_days(F.col("occurred_at"), as_of, 7)).agg(F.count("*").alias("zero_result_searches"), F.lit(1).alias("one"))
    clicks = d.conversions.filter(within_days(F.col("occurred_at"), as_of, 7)).agg(F.count("*").alias("conversions"), F.lit(1).alias("one"))
    return zero.join(clicks, "one").drop("one")


def match_types(d: Domain, as_of: Column) -> DataFrame:
    """One row: impressions of the week by match type, absent types as zero."""
    rows = d.impressions.filter(within_days(F.col("created_at"), as_of, 7))
    return rows.agg(*[F.count_if(F.col("match_type") == m).alias(f"{m}_7d") for m in MATCH_TYPES], F.count("*").alias("impressions_7d"))


def canonical_hits(d: Domain, as_of: Column) -> DataFrame:
    """Canonical impressions of the week whose query and item are aliases of one active concept."""
    shown = d.impressions.filter((F.col("match_type") == "canonical") & within_days(F.col("created_at"), as_of, 7))
    named = shown.join(d.searches.select("search_id", "normalized_query"), "search_id").join(d.impression_items.select("part_id", "normalized_name"), "part_id")
    by_menu = named.join(d.menu_aliases, named["normalized_name"] == d.menu_aliases["menu_alias"])
    routes = d.query_aliases.select("concept_id", F.col("query_alias").alias("normalized_query"))
    return by_menu.join(routes, ["concept_id", "normalized_query"])


def concept_coverage(d: Domain, menu_as_of: Column, event_as_of: Column) -> DataFrame:
    """Aliases, current item matches and canonical impressions of every active concept. The coverage here
    does not ask for freshness."""
    items = current_items(d, menu_as_of, fresh=False).select("item_id", "normalized_name")
    matches = items.join(d.menu_aliases, items["normalized_name"] == d.menu_aliases["menu_alias"]).groupBy("concept_id").agg(F.countDistinct("item_id").alias("item_matches"))
    demand = canonical_hits(d, event_as_of).groupBy("concept_id").agg(F.count("*").alias("impressions_7d"))

    def listed(*scopes: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("scope").isin(*scopes), F.col("alias")))), ",")

    names = d.aliases.groupBy("concept_id").agg(listed("query", "both").alias("query_aliases"), listed("menu", "both").alias("menu_aliases"))
    joined = d.concepts.filter("concept_active").join(names, "concept_id", "left").join(matches, "concept_id", "left").join(demand, "concept_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("concept_slug", "canonical_name", F.coalesce("query_aliases", F.lit("")).alias("query_aliases"), F.coalesce("menu_aliases", F.lit("")).alias("menu_aliases"), F.coalesce("item_matches", zero).alias("item_matches"), F.coalesce("impressions_7d", zero).alias("impressions_7d"))


def canonical_queries(d: Domain, as_of: Column, limit: int = 20) -> DataFrame:
    active = d.concepts.filter("concept_active").select("concept_id", "concept_slug")
    hits = canonical_hits(d, as_of).join(active, "concept_id")
    grouped = hits.groupBy("normalized_query", "concept_slug").agg(F.countDistinct("search_id").alias("searches_7d"), F.count("*").alias("impressions_7d"), F.round(F.avg("match_score"), 6).alias("average_score"))
    return grouped.orderBy(F.desc("searches_7d"), F.desc("impressions_7d"), "normalized_query", "concept_slug").limit(limit)


def fuzzy_queries(d: Domain, event_as_of: Column, menu_as_of: Column, limit: int = 40) -> DataFrame:
    shown = d.impressions.filter((F.col("match_type") == "fuzzy") & within_days(F.col("created_at"), event_as_of, 7))
    named = shown.join(d.searches.select("search_id", "normalized_query", "city"), "search_id")
    history = named.groupBy("normalized_query", "city").agg(F.countDistinct("search_id").alias("searches_7d"), F.count("*").alias("impressions_7d"), F.round(F.avg("match_score"), 6).alias("average_score"), F.max("match_score").alias("best_score"))
    found = resolved(d, history, menu_as_of)
    return found.orderBy(F.desc(F.col("current_resolution").isNull()), F.desc("searches_7d"), F.desc("average_score"), "normalized_query", "city").limit(limit)
