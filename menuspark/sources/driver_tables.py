"""The domain's tables as deterministic views over the star-schema and event tables.

Every view is a lazy DataFrame; ``Domain`` only holds the session and the folder. The same mapping is
written as SQL in ``menuspark.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menuspark.storage import table

#: The moment at which menu-side and event-side reports are taken.
MENU_NOW = "2001-08-02 15:30:00"
EVENT_NOW = "2024-01-31 00:00:00"

# The alias dimension and the queries of the adapter.
CONCEPTS = [(1, "ring", "Ring", "ring", True), (2, "widget", "Widget", "widget", True), (3, "anvil", "Anvil", "anvil", True), (4, "gizmo", "Gizmo", "gizmo", False)]
ALIASES = [
    (1, 1, "band", "query"), (2, 1, "blue ring", "menu"), (3, 1, "ring", "both"), (4, 1, "red ring", "menu"), (5, 2, "gadget", "query"), (6, 2, "small widget", "both"),
    (7, 2, "widget", "query"), (8, 3, "hammer block", "query"), (9, 3, "hot anvil", "menu"), (10, 4, "thing", "both"), (11, 4, "new gizmo", "menu"),
]
QUERIES = ["hot gear", "band", "small", "gear", "gadget", "unknown dish", "blue rng", "red plate", "olt", "hammer block", "new", "thing"]
MATCH_TYPES = ["exact", "canonical", "prefix", "contains", "fuzzy"]
CLICKS = ["menu_clicked", "restaurant_clicked", "directions_clicked", "booking_clicked", "order_clicked"]
ZONES = ["Europe/Oslo", "UTC", "America/New_York"]


def menu_now() -> Column:
    return F.lit(MENU_NOW).cast("timestamp")


def event_now() -> Column:
    return F.lit(EVENT_NOW).cast("timestamp")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def restaurants(self) -> DataFrame:
        c, n = self._table("customer"), self._table("nation")
        key = F.col("c_custkey")
        return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
            key.alias("restaurant_id"),
            F.concat(F.lit("r"), key).alias("slug"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("city"),
            F.concat(F.col("c_mktsegment"), F.lit(" "), key).alias("address"),
            (F.col("c_acctbal") >= 0).alias("active"),
            (F.lit(59.9) + (key % 200) / 1000.0).alias("lat"),
            (F.lit(10.7) + (key % 300) / 1000.0).alias("lon"),
        )

    @cached_property
    def menu_sources(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._table("customer").select(
            key.alias("source_id"),
            key.alias("restaurant_id"),
            F.concat(F.lit("https://example.org/menu/"), key).alias("url"),
            (key % 10 != 0).alias("enabled"),
            (60 + (key % 12) * 60).cast("int").alias("interval_minutes"),
            F.when(key % 17 != 0, menu_now() - days(key % 5)).alias("last_checked_at"),
            (menu_now() + days(key % 7 - 3)).alias("next_check_at"),
            (key % 4).cast("int").alias("failures"),
            (key % 9).cast("int").alias("minimum_items"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._table("orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("fetched_at"))

    @cached_property
    def items(self) -> DataFrame:
        """Items have no natural key: the id is a digest of the whole row."""
        return self._as_items(self._table("lineitem"))

    def items_of(self, snapshots: DataFrame) -> DataFrame:
        """``snapshots`` (snapshot_id, ...) joined with their items. The join comes before the items'
        columns are computed, so only rows that are wanted pay for them."""
        return self._as_items(self._table("lineitem").join(snapshots, F.col("l_orderkey") == F.col("snapshot_id")), snapshots.columns)

    def _as_items(self, li: DataFrame, carried: list[str] | None = None) -> DataFrame:
        p = self._table("part")

        def cents(c: str) -> Column:
            return F.round(F.col(c) * 100).cast("long")

        identity = F.sha2(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus"), 256)
        return li.join(p, li.l_partkey == p.p_partkey).select(
            identity.alias("item_id"),
            *([li[c] for c in carried] if carried else [F.col("l_orderkey").alias("snapshot_id")]),
            F.col("p_name").alias("name"),
            F.lower("p_name").alias("normalized_name"),
            F.col("p_brand").alias("description"),
            F.col("p_type").alias("section"),
            F.when(F.col("l_linenumber") != 7, cents("l_extendedprice")).alias("price_minor"),
            F.col("l_linenumber").alias("position"),
            F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        )

    @cached_property
    def watch_runs(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self._table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("source_id"),
            F.when(status == "F", "changed").when(status == "O", "unchanged").otherwise("fetch_error").alias("outcome"),
            F.when(status == "P", F.concat(F.lit("HTTP_"), F.col("o_orderkey") % 3 + 500)).alias("error_code"),
            F.col("o_orderdate").alias("started_at"),
        )

    @cached_property
    def concepts(self) -> DataFrame:
        return self.spark.createDataFrame(CONCEPTS, "concept_id int, concept_slug string, canonical_name string, concept_normalized string, concept_active boolean")

    @cached_property
    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame(ALIASES, "alias_id int, concept_id int, alias string, scope string")

    @cached_property
    def menu_aliases(self) -> DataFrame:
        return self.aliases.filter(F.col("scope").isin("menu", "both")).select("concept_id", F.col("alias").alias("menu_alias"))

    @cached_property
    def query_aliases(self) -> DataFrame:
        return self.aliases.filter(F.col("scope").isin("query", "both")).select("concept_id", F.col("alias").alias("query_alias"), "alias_id")

    @cached_property
    def searches(self) -> DataFrame:
        e, user = F.col("event_id"), F.col("user_id")
        city = F.concat(F.lit("NATION_"), user % 25)
        return self._table("events").filter(F.col("event_type").isin("signup", "error", "view")).select(
            e.alias("search_id"),
            pick(QUERIES, (user + e) % 12).alias("normalized_query"),
            F.when(e % 3 == 0, F.lower(city)).otherwise(city).alias("city"),
            F.when(F.col("event_type") == "error", 0).otherwise(1 + user % 5).cast("int").alias("result_count"),
            F.when(e % 10 == 0, "legacy_unclassified").otherwise("explicit_search").alias("demand_source"),
            F.col("ts").alias("occurred_at"),
        )

    @cached_property
    def impressions(self) -> DataFrame:
        views = self._table("events").filter("event_type = 'view'").withColumn("rank", F.explode(F.sequence(F.lit(1), (1 + F.col("user_id") % 3).cast("int"))))
        e, rank = F.col("event_id"), F.col("rank")
        kind = pick(MATCH_TYPES, (e + rank) % 5)
        return views.select(
            (e * 10 + rank).alias("impression_id"),
            e.alias("search_id"),
            (1 + (e * 3 + rank) % 200).alias("part_id"),
            (1 + (F.col("user_id") * 7 + rank) % 100).alias("restaurant_id"),
            rank,
            kind.alias("match_type"),
            F.when(kind == "fuzzy", F.round(0.3 + (e % 50) / 100.0, 2)).when(kind == "exact", 1.0).when(kind == "canonical", 0.98).when(kind == "prefix", 0.95).otherwise(0.9).alias("match_score"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def impression_items(self) -> DataFrame:
        """Names of what impressions showed."""
        return self._table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_name"))

    @cached_property
    def conversion_log(self) -> DataFrame:
        """Click reports as they arrive: a client repeats some of them under the same client event id."""
        e = F.col("event_id")
        return self._table("events").filter(F.col("event_type").isin("click", "purchase")).select(
            e.alias("conversion_id"),
            F.concat(F.lit("c"), F.floor(e / 3)).alias("client_event_id"),
            ((e - 1) * 10 + 1).alias("impression_id"),
            pick(CLICKS, e % 5).alias("event_type"),
            F.col("ts").alias("occurred_at"),
        )

    @cached_property
    def conversions(self) -> DataFrame:
        return self.conversion_log

    @cached_property
    def actions(self) -> DataFrame:
        key = F.col("c_custkey")
        expires = menu_now() + days(key % 20 - 5)
        return self._table("customer").withColumn("action_type", F.explode(F.array(F.lit("booking"), F.lit("order")))).select(
            key.alias("restaurant_id"),
            "action_type",
            F.concat(F.lit("https://example.org/"), F.col("action_type"), F.lit("/"), key).alias("url"),
            F.concat(F.lit("p"), key % 3).alias("provider"),
            (key % 4 != 0).alias("enabled"),
            (expires - days(F.lit(30))).alias("verified_at"),
            expires.alias("expires_at"),
        )

    @cached_property
    def hours_sources(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._table("customer").select(
            key.alias("hours_source_id"),
            key.alias("restaurant_id"),
            pick(ZONES, key % 3).alias("time_zone"),
            F.lit(1440).alias("interval_minutes"),
            F.when(key % 4 == 0, "provisional").otherwise("verified").alias("verification_status"),
            F.when(key % 13 != 0, menu_now() - days(key % 4)).alias("last_checked_at"),
            (key % 9 != 0).alias("enabled"),
            (key % 5).cast("int").alias("failures"),
            (key % 7).cast("int").alias("minimum_intervals"),
        )

    @cached_property
    def hours_snapshots(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self._table("orders").select(key.alias("hours_snapshot_id"), F.col("o_custkey").alias("hours_source_id"), F.col("o_orderdate").alias("fetched_at"), (key % 8).cast("int").alias("interval_count"), F.concat(F.lit("f"), key % 4).alias("fingerprint"), F.concat(F.lit("v"), key % 2).alias("extractor"))

    @cached_property
    def hours_intervals(self) -> DataFrame:
        key = F.col("hours_snapshot_id")
        opens = (key % 12) * 60 + 360
        closes = F.pmod(opens + (1 + key % 20) * 60, F.lit(1440))
        return self.hours_snapshots.filter("interval_count > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("interval_count").cast("int"))).alias("iso_weekday"), opens.cast("int").alias("opens"), closes.cast("int").alias("closes")).filter("iso_weekday <= 7").withColumn("next_day", F.col("closes") <= F.col("opens"))
