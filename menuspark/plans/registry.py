"""Claims, grants, saved items, manifests and catalogue checks: analytic reads over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.operators.latest import lateral_top, top_per_key
from menuspark.sources.driver_tables import Domain


def claim_states(restaurants: DataFrame, grants: DataFrame, claims: DataFrame) -> DataFrame:
    """claimed with an active grant, under_review with a pending claim, else unclaimed."""
    owned = grants.filter("revoked_at IS NULL").select("restaurant_id").distinct().withColumn("owned", F.lit(True))
    asked = claims.filter("status = 'pending'").select("restaurant_id").distinct().withColumn("asked", F.lit(True))
    joined = restaurants.join(owned, "restaurant_id", "left").join(asked, "restaurant_id", "left")
    return joined.select("restaurant_id", F.when(F.col("owned"), "claimed").when(F.col("asked"), "under_review").otherwise("unclaimed").alias("claim_state"))


def pending_claims(claims: DataFrame, limit: int = 100) -> DataFrame:
    return claims.filter("status = 'pending'").orderBy("created_at", "claim_id").limit(limit)


def active_grants(grants: DataFrame, limit: int = 100) -> DataFrame:
    """Grants that have not been revoked, oldest first."""
    return grants.filter("revoked_at IS NULL").orderBy("granted_at", "grant_id").limit(limit)


def saved_snapshots(log: DataFrame, items: DataFrame) -> DataFrame:
    """The log's saves with the item as it was when it was saved: the last version not after the save."""
    versions = items.select("item_id", F.struct("version_at", "name", "price_minor").alias("v"))
    saves = log.filter("op = 'save'").join(versions, "item_id", "left").withColumn("v", F.when(F.col("v.version_at") <= F.col("logged_at"), F.col("v")))
    kept = [c for c in log.columns]
    best = saves.groupBy(*kept).agg(F.max("v").alias("v"))
    return best.select(*kept, F.col("v.name").alias("name"), F.col("v.price_minor").alias("price_minor"))


def hand_off(saved: DataFrame, most: int = 50) -> DataFrame:
    """(subject, items): a subject's saved items in order, the first ``most``, as one row to hand on."""
    top = saved.filter(F.col("place") <= most)
    return top.groupBy("subject").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "item_id"))), lambda s: s["item_id"]).alias("items"))


def saved_items(log: DataFrame, limit: int = 500) -> DataFrame:
    """A subject's saved items, newest first: the last log row of each (subject, item) decides, and a
    removal takes the item away."""
    last = top_per_key(log, ["subject", "item_id"], [F.desc("logged_at"), F.desc("log_id")])
    return top_per_key(last.filter("op = 'save'"), ["subject"], [F.desc("logged_at"), F.desc("log_id")], limit, "place")


def variant_label(name: Column, section: Column, price: Column, kind: Column, top: Column) -> Column:
    """How a report names a required variant: ``name [section] @ price kind..maximum``, as far as given."""
    parts = (name, F.concat(F.lit(" ["), section, F.lit("]")), F.concat(F.lit(" @ "), price.cast("string")), F.concat(F.lit(" "), kind), F.concat(F.lit(".."), top.cast("string")))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def missing_variants(variants: DataFrame, items: DataFrame) -> DataFrame:
    """(manifest_id, label) of the required variants that no item fits. A variant names a dish and, where
    given, its section, price, price kind and maximum; an item's null kind counts as exact.

    ``variants`` (manifest_id, label, normalized_name, normalized_section, price_minor, price_kind,
    price_max_minor), ``items`` (manifest_id, normalized_name, normalized_section, ...) alike."""
    wanted = variants.select("manifest_id", "label", "normalized_name", *[F.col(c).alias(f"want_{c}") for c in ("normalized_section", "price_minor", "price_kind", "price_max_minor")])
    own = items.select("manifest_id", "normalized_name", F.coalesce("normalized_section", F.lit("")).alias("normalized_section"), "price_minor", F.coalesce("price_kind", F.lit("exact")).alias("price_kind"), "price_max_minor").distinct()
    met = wanted.join(own, ["manifest_id", "normalized_name"])
    for c in ("normalized_section", "price_minor", "price_kind", "price_max_minor"):
        met = met.filter(F.col(f"want_{c}").isNull() | F.coalesce(F.col(f"want_{c}") == F.col(c), F.lit(False)))
    return wanted.select("manifest_id", "label").distinct().join(met.select("manifest_id", "label").distinct(), ["manifest_id", "label"], "left_anti")


def manifest_gate(expected: DataFrame, items: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Per manifest: required names and variants that are missing, forbidden names that are present, the
    count, and whether all is well. ``expected``: (manifest_id, minimum_items, kind, normalized_name) with
    kind required or forbidden; ``variants`` as in ``missing_variants``."""
    names = items.select("manifest_id", "normalized_name").distinct().withColumn("present", F.lit(True))
    checks = expected.join(names, ["manifest_id", "normalized_name"], "left")
    rules = checks.groupBy("manifest_id").agg(
        F.first("minimum_items").alias("minimum_items"),
        F.count_if((F.col("kind") == "required") & F.col("present").isNull()).alias("missing_required"),
        F.count_if((F.col("kind") == "forbidden") & F.col("present").isNotNull()).alias("forbidden_present"),
    )
    counts = items.groupBy("manifest_id").agg(F.count("*").alias("item_count"))
    joined = rules.join(counts, "manifest_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("long")))
    if variants is not None:
        absent = missing_variants(variants, items).groupBy("manifest_id").agg(F.count("*").alias("absent"))
        joined = joined.join(absent, "manifest_id", "left").withColumn("missing_required", F.col("missing_required") + F.coalesce("absent", F.lit(0))).drop("absent")
    return joined.withColumn("accepted", (F.col("missing_required") == 0) & (F.col("forbidden_present") == 0) & (F.col("item_count") >= F.col("minimum_items")))


# What the message of a failed validation says about its cause.
TRANSPORT = r"(?i)(?:http\s+(?:4\d\d|5\d\d)|fetch|network|socket|timeout|timed out|aborted due to timeout|econn|enotfound|dns|tls|certificate|redirect)"
EXTRACTION = r"(?i)(?:extract|no menu|empty menu|source declared|unsupported source)"
PASSING = r"(?i)(?:pdf source did not start with a pdf signature|unexpectedly returned http 304|temporary|temporarily unavailable|connection reset|aborted due to timeout)"
FAMILIES = ("manifest", "transport", "extraction", "menu_assertions", "hours", "action", "unknown")
ATTEMPTS = 3
# End of fixed values.


def failure_families(v: DataFrame) -> Column:
    """The families of a failed validation, as an array; none for an accepted one.

    ``v`` has accepted, menu_accepted, menu_checked (its assertions were reached), menu_error,
    hours_blocking, hours_accepted, hours_error, and failed_actions (a count). Nulls count as not
    blocking, no error, no failed action; a row without a validation (``accepted`` null) is a manifest
    failure."""

    def says(c: str, pattern: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).rlike(pattern)

    menu = F.when(F.col("menu_checked"), "menu_assertions").when(says("menu_error", TRANSPORT), "transport").when(says("menu_error", EXTRACTION), "extraction").otherwise("unknown")
    hours = F.when(says("hours_error", TRANSPORT), "transport").otherwise("hours")
    blocked = F.coalesce(F.col("hours_blocking") & ~F.col("hours_accepted"), F.lit(False))
    own = F.array_distinct(F.array_compact(F.array(F.when(~F.col("menu_accepted"), menu), F.when(blocked, hours), F.when(F.coalesce("failed_actions", F.lit(0)) > 0, "action"))))
    none = F.array().cast("array<string>")
    return F.when(F.col("accepted").isNull(), F.array(F.lit("manifest"))).when(F.col("accepted"), none).when(F.size(own) == 0, F.array(F.lit("unknown"))).otherwise(own)


def retryable(v: DataFrame, families: Column, attempt: Column) -> Column:
    """Whether to try a failed validation again: failures of transport and actions, and unknown ones whose
    message says that they pass; never one of content; at most three attempts in all."""

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(families, F.array(*map(F.lit, names)))

    errors = F.concat_ws(" | ", "menu_error", F.when(F.col("hours_blocking"), F.col("hours_error")), "action_errors")
    worth = any_of("transport", "action") | any_of("unknown") & errors.rlike(PASSING)
    return ~any_of("menu_assertions", "hours", "extraction") & worth & (attempt < ATTEMPTS)


def failure_rollup(v: DataFrame) -> DataFrame:
    """(family, failures, retryable) of every family, absent ones as zero. One row, one family at a time:
    a validation counts under each of its families."""
    tagged = v.withColumn("families", failure_families(v)).withColumn("again", retryable(v, F.col("families"), F.lit(1)))
    counted = tagged.select("again", F.explode("families").alias("family")).groupBy("family").agg(F.count("*").alias("failures"), F.count_if("again").alias("retryable"))
    every = v.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    zero = F.lit(0).cast("long")
    return every.join(counted, "family", "left").select("family", F.coalesce("failures", zero).alias("failures"), F.coalesce("retryable", zero).alias("retryable"))


def onboarding(watches: DataFrame, facts: DataFrame) -> DataFrame:
    """(restaurant_id, outcome, step) of a catalogue pass, as a projection over its watch runs.

    A restaurant is published when its first two watches are both accepted (changed, unchanged or not
    modified), its assertions hold, and its hours are accepted or do not block; one that was active
    before stays published through a failed refresh if its last snapshot is safe. ``watches``
    (restaurant_id, turn, outcome), ``facts`` (restaurant_id, active, assertions_hold, hours_blocking,
    hours_accepted, snapshot_safe). ``step`` names the first check that failed."""
    fine = F.col("outcome").isin("changed", "unchanged", "not_modified")
    first, second = (F.coalesce(F.max(F.when(F.col("turn") == n, fine)), F.lit(False)).alias(f"watch_{n}") for n in (1, 2))
    seen = facts.join(watches.groupBy("restaurant_id").agg(first, second), "restaurant_id", "left")
    step = (
        F.when(~F.coalesce("watch_1", F.lit(False)), "first_watch")
        .when(~F.coalesce("watch_2", F.lit(False)), "second_watch")
        .when(~F.coalesce("assertions_hold", F.lit(False)), "assertions")
        .when(F.coalesce(F.col("hours_blocking") & ~F.col("hours_accepted"), F.lit(False)), "hours")
    )
    outcome = F.when(F.col("step").isNull(), F.when(F.col("active"), "already_published").otherwise("published")).when(F.col("active") & F.col("snapshot_safe"), "restored").otherwise("failed")
    return seen.withColumn("step", step).select("restaurant_id", outcome.alias("outcome"), "step")


def catalogue_proof(d: Domain, item_counts: DataFrame) -> DataFrame:
    """Every restaurant with its latest snapshot, latest run and item count, and whether it is complete."""
    newest = lateral_top(d.menu_sources.select("restaurant_id", "source_id", "enabled", "minimum_items"), d.snapshots, ["source_id"], [F.desc("fetched_at"), F.desc("snapshot_id")])
    runs = lateral_top(newest, d.watch_runs.select("source_id", "outcome", "started_at", "run_id"), ["source_id"], [F.desc("started_at"), F.desc("run_id")])
    joined = d.restaurants.select("restaurant_id", "slug", "active").join(runs, "restaurant_id", "left").join(item_counts, "source_id", "left")
    complete = F.col("active") & F.col("enabled") & F.col("snapshot_id").isNotNull() & (F.coalesce("item_count", F.lit(0)) >= F.col("minimum_items"))
    return joined.select("slug", "snapshot_id", F.col("outcome").alias("latest_outcome"), F.coalesce("item_count", F.lit(0).cast("long")).alias("item_count"), F.coalesce(complete, F.lit(False)).alias("complete"))


def funnel_batch(results: DataFrame, search_columns: list[str], ranked_by: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(search rows, impression rows) to append: ranks follow the result order within each search."""
    impressions = top_per_key(results, ["search_id"], ranked_by, 50, "rank")
    searches = results.groupBy(*search_columns).agg(F.least(F.count("*"), F.lit(50)).alias("result_count"), F.lit("explicit_search").alias("demand_source"))
    return searches, impressions.select("search_id", "rank", "item_id", "match_type", "score")


def knowledge_lookup(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalogue entries whose name, query or one of whose aliases equals a wanted text."""
    keys = catalogue.select("entry_id", F.explode(F.array_distinct(F.concat(F.array("name", "query"), F.col("aliases")))).alias("key")).select("entry_id", F.lower("key").alias("key")).distinct()
    return wanted.select(F.lower("text").alias("key"), "text").join(keys, "key").select("text", "entry_id")


def duplicate_ids(catalogue: DataFrame, id_col: str) -> DataFrame:
    return catalogue.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")
