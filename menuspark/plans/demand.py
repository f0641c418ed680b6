"""The demand loop: unmet searches of seven days, replayed against the current index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.clock import within_days
from menuspark.operators.match import replay
from menuspark.plans.index import current_items
from menuspark.sources.driver_tables import Domain

QUEUE = 20


def current_names(d: Domain, menu_as_of: Column) -> DataFrame:
    return current_items(d, menu_as_of).select("normalized_name", "city")


def active_routes(d: Domain) -> DataFrame:
    return d.query_aliases.join(d.concepts.filter("concept_active").select("concept_id"), "concept_id")


def resolved(d: Domain, history: DataFrame, menu_as_of: Column) -> DataFrame:
    return replay(history, current_names(d, menu_as_of), active_routes(d), d.menu_aliases)


def signals(d: Domain, as_of: Column, menu_as_of: Column) -> DataFrame:
    """One row per (query, city) with at least one zero-result or fuzzy search.

    A search with exact hits beside a fuzzy one is a fuzzy signal too. Impressions reduce to one row per
    search before the join, so the counts of searches are plain sums and nothing is counted distinct.
    """
    explicit = d.searches.filter((F.col("demand_source") == "explicit_search") & within_days(F.col("occurred_at"), as_of, 7))
    fuzzy = d.impressions.filter("match_type = 'fuzzy'").groupBy("search_id").agg(F.count("*").alias("fuzzy_n"), F.sum("match_score").alias("fuzzy_sum"), F.max("match_score").alias("fuzzy_best"))
    seen = explicit.join(fuzzy, "search_id", "left")
    zero, near = F.col("result_count") == 0, F.col("fuzzy_n").isNotNull()
    history = seen.filter(zero | near).groupBy("normalized_query", "city").agg(
        F.count("*").alias("searches"),
        F.count_if(zero).alias("zero_result_searches"),
        F.count_if(near).alias("fuzzy_searches"),
        F.coalesce(F.sum("fuzzy_n"), F.lit(0)).alias("fuzzy_impressions"),
        F.round(F.sum("fuzzy_sum") / F.sum("fuzzy_n"), 6).alias("average_fuzzy_score"),
        F.max("fuzzy_best").alias("best_fuzzy_score"),
        F.max("occurred_at").alias("last_seen_at"),
    )
    zeros, fuzzies = F.col("zero_result_searches") > 0, F.col("fuzzy_searches") > 0
    signal = F.when(zeros & fuzzies, "zero_and_fuzzy").when(zeros, "zero_result").otherwise("fuzzy_only")
    lane = F.when(zeros, "coverage_or_alias").otherwise("alias_or_parser")
    return resolved(d, history, menu_as_of).withColumn("signal", signal).withColumn("review_lane", lane)


def queue_order() -> list[Column]:
    return [F.desc("searches"), F.desc("zero_result_searches"), F.desc("fuzzy_searches"), F.desc("last_seen_at"), F.collate(F.col("normalized_query"), "nb").asc(), F.collate(F.col("city"), "nb").asc()]


def queue(found: DataFrame, unresolved: bool = True, limit: int = QUEUE) -> DataFrame:
    open_ = F.col("current_resolution").isNull()
    return found.filter(open_ if unresolved else ~open_).orderBy(*queue_order()).limit(limit)


def legacy_signals(d: Domain, as_of: Column) -> DataFrame:
    """Searches of unknown provenance with a signal."""
    fuzzy = d.impressions.filter("match_type = 'fuzzy'").select("search_id").distinct().withColumn("fuzzy", F.lit(True))
    legacy = d.searches.filter((F.col("demand_source") == "legacy_unclassified") & within_days(F.col("occurred_at"), as_of, 7))
    return legacy.join(fuzzy, "search_id", "left").filter((F.col("result_count") == 0) | F.col("fuzzy"))


def totals(d: Domain, as_of: Column, menu_as_of: Column) -> DataFrame:
    """One row: searches behind all, unresolved and resolved signals, the queue's size, legacy signals."""
    open_ = F.col("current_resolution").isNull()
    own = signals(d, as_of, menu_as_of).agg(
        F.coalesce(F.sum("searches"), F.lit(0)).alias("explicit_searches"),
        F.coalesce(F.sum(F.when(open_, F.col("searches"))), F.lit(0)).alias("unresolved_searches"),
        F.coalesce(F.sum(F.when(~open_, F.col("searches"))), F.lit(0)).alias("resolved_searches"),
        F.least(F.count_if(open_), F.lit(QUEUE)).alias("queue_size"),
        F.lit(1).alias("one"),
    )
    return own.join(legacy_signals(d, as_of).agg(F.count("*").alias("legacy_searches"), F.lit(1).alias("one")), "one").drop("one")
