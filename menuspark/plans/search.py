"""Dish search: fresh latest items, five-tier match, distance, opening state, ordered top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.clock import fresh_until, interval_open, is_fresh
from menuspark.functions.geo import geodesic, haversine
from menuspark.operators.latest import latest_per_key
from menuspark.operators.match import match_tiers
from menuspark.plans.index import current_items
from menuspark.sources.driver_tables import Domain


def check_request(query: str, limit: int, latitude: float | None, longitude: float | None, sort: str) -> None:
    """The request contract: a query of 2 to 80 characters, limit 1 to 50, coordinates together, and
    coordinates where the order is by distance."""
    if not 2 <= len(query.strip()) <= 80:
        raise ValueError("a query has 2 to 80 characters")
    if not 1 <= limit <= 50:
        raise ValueError("limit lies between 1 and 50")
    if (latitude is None) != (longitude is None):
        raise ValueError("latitude and longitude come together")
    if latitude is not None and not (-90 <= latitude <= 90 and -180 <= longitude <= 180):
        raise ValueError("coordinates out of range")
    if sort not in ("relevance", "distance") or sort == "distance" and latitude is None:
        raise ValueError("sort is relevance, or distance with coordinates")


def canonical_routes(d: Domain, query: str) -> DataFrame:
    """Menu aliases of the active concept that ``query`` is an alias of."""
    active = d.concepts.filter("concept_active")
    concept = d.query_aliases.filter(F.col("query_alias") == query).join(active, "concept_id").orderBy("alias_id").limit(1)
    return concept.join(d.menu_aliases, "concept_id").select("menu_alias", F.col("concept_id").alias("canonical_id"), "concept_slug", "canonical_name")


def opening_states(d: Domain, as_of: Column, shown: DataFrame | None = None) -> DataFrame:
    """(restaurant_id, opening_state) of restaurants with a fresh, verified kitchen schedule; all others
    are unknown. ``shown``: the restaurants asked for, a bounded list."""
    hours_sources = d.hours_sources if shown is None else d.hours_sources.join(F.broadcast(shown), "restaurant_id", "left_semi")
    fresh = hours_sources.filter(F.col("enabled") & (F.col("verification_status") == "verified") & is_fresh(as_of, F.col("last_checked_at"), F.col("interval_minutes")))
    latest = latest_per_key(d.hours_snapshots.join(fresh.select("hours_source_id", "restaurant_id", "time_zone", "last_checked_at", "interval_minutes"), "hours_source_id"), ["restaurant_id"], "fetched_at", "hours_snapshot_id")
    local = F.from_utc_timestamp(as_of, F.col("time_zone"))
    covers = interval_open(F.col("iso_weekday"), F.col("opens"), F.col("closes"), F.col("next_day"), local)
    state = F.when(F.max(F.coalesce(covers, F.lit(False))), "open").otherwise("closed")
    hours_until = F.max(fresh_until(F.col("last_checked_at"), F.col("interval_minutes")))
    return latest.join(d.hours_intervals, "hours_snapshot_id", "left").groupBy("restaurant_id").agg(state.alias("opening_state"), hours_until.alias("opening_fresh_until"))


def live_action(d: Domain, kind: str, as_of: Column) -> DataFrame:
    live = d.actions.filter(F.col("enabled") & (F.col("action_type") == kind) & (F.col("expires_at") > as_of))
    return live.select("restaurant_id", F.col("url").alias(f"{kind}_url"))


def search(d: Domain, query: str, city: str, as_of: Column, limit: int = 20, latitude: float | None = None, longitude: float | None = None, sort: str = "relevance", exact_distance: bool = False) -> DataFrame:
    """The best ``limit`` items for a normalised query in a city.

    Ties of the order end in the item id. ``exact_distance`` takes the spheroid instead of the sphere.
    """
    check_request(query, limit, latitude, longitude, sort)
    items = current_items(d, as_of, city=city)
    routes = canonical_routes(d, query)
    matched = match_tiers(items.join(F.broadcast(routes), items["normalized_name"] == routes["menu_alias"], "left"), query)
    if latitude is None:
        matched = matched.withColumn("distance", F.lit(None).cast("double"))
    else:
        metres = geodesic if exact_distance else haversine
        matched = matched.withColumn("distance", F.round(metres(F.col("lat"), F.col("lon"), F.lit(latitude), F.lit(longitude)), 3))
    near = [F.asc_nulls_last("distance")] if latitude is not None else []
    order = [*(near if sort == "distance" else []), F.desc("score"), *(near if sort == "relevance" else []), F.desc("confidence"), F.desc("fetched_at"), F.asc("restaurant_name"), F.asc("position"), F.asc("item_id")]
    best = matched.orderBy(*order).limit(limit).select("item_id", "restaurant_id", "name", "city", "price_minor", "match_type", "score", "concept_slug", "distance")
    top = d.spark.createDataFrame(best.collect(), best.schema)  # the page itself, at most 50 rows
    enriched = top.join(opening_states(d, as_of, top.select("restaurant_id").distinct()), "restaurant_id", "left").join(live_action(d, "booking", as_of), "restaurant_id", "left").join(live_action(d, "order", as_of), "restaurant_id", "left")
    return enriched.select("item_id", "restaurant_id", "name", "city", "price_minor", "match_type", "score", "concept_slug", "distance", F.coalesce("opening_state", F.lit("unknown")).alias("opening_state"), "booking_url", "order_url")


def split_results(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(primary, near): fuzzy matches are shown apart."""
    return found.filter("match_type <> 'fuzzy'"), found.filter("match_type = 'fuzzy'")
