"""The browse catalogue: classification, identity groups, representatives and quality counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuspark.functions.text import canonical_identity, canonical_name, discovery_text, phrase_match
from menuspark.operators.latest import first_distinct, lateral_top, top_per_key
from menuspark.plans.index import current_items
from menuspark.sources.driver_tables import Domain

EXCLUSIONS = ("beverage", "sauce_or_side", "modifier", "allergen_or_information", "menu_heading", "invalid_fragment")

# The patterns of the seven classes, over discovery-normalised text.
FRAGMENT = r"^\d+\s*(stk|cl|ml|l|g|kg|biter|pieces?|bottles?)?$|^(n a|null|undefined|ukjent)$"
INFORMATION = r"^allergen|^inneholder\b|^kan inneholde\b|^informasjon\b|^les mer\b"
MODIFIER = r"^(velg|choose|valg|ekstra|extra|tilvalg|add on)\b|^per stk$|^chefs? spesialitet$"
DRINK_SECTION = r"\b(drikke|drinks?|beverage|vin|wine|ol|beer|cocktail|sprit|spirits?)\b"
DRINK_NAME = (
    r"\b(vann|water|cola|fanta|sprite|pepsi|solo|juice|limonade|lemonade|kaffe|coffee|espresso|cappuccino|latte|te|tea)\b"
    r"|\b(ol|beer|pils|ipa|lager|vin|wine|prosecco|champagne|cava|cocktail|gin|vodka|whisk(?:e)?y|cognac|akevitt|aperol spritz)\b"
    r"|^\d+[,.]?\d*\s*(cl|ml|liter|l)\b"
)
SIDE_SECTION = r"\b(saus|sauce|tilbehor|sides?|extras?)\b"
SIDE_NAME = r"^(aioli|majones|mayo|chimichurri|chiliolje|chili oil|tzatziki|dressing|saus|sauce|ris|rice|bulgur|pommes frites|fries|coleslaw|agurk|cucumber)$"
HEADING = r"^(forrett(?:er)?|starter(?:s)?|hovedrett(?:er)?|main courses?|dessert(?:er|s)?|meny|menu|smaretter|small plates)$"
# End of fixed values.


def classify(name: Column, section: Column, description: Column, price: Column, unicode: bool = True) -> Column:
    """The first class that applies, else ``dish``."""
    n, s, t = (discovery_text(c, unicode) for c in (name, section, description))
    return (
        F.when(~n.rlike("[a-z]") | n.rlike(FRAGMENT), "invalid_fragment")
        .when(n.rlike(INFORMATION) | t.rlike("^allergen"), "allergen_or_information")
        .when(n.rlike(MODIFIER), "modifier")
        .when(s.rlike(DRINK_SECTION) | n.rlike(DRINK_NAME), "beverage")
        .when(s.rlike(SIDE_SECTION) | n.rlike(SIDE_NAME), "sauce_or_side")
        .when(price.isNull() & n.rlike(HEADING), "menu_heading")
        .otherwise("dish")
    )


def browse_rows(d: Domain, city: str, as_of: Column, unicode: bool = True) -> DataFrame:
    """Items of a city with their class and identity; an empty identity counts as a fragment."""
    items = current_items(d, as_of, city=city)
    active = d.concepts.filter("concept_active")
    own = d.query_aliases.join(active, "concept_id")
    preferred = lateral_top(active, own.select("concept_id", "query_alias", (F.col("query_alias") == F.col("concept_normalized")).alias("same"), "alias_id"), ["concept_id"], [F.desc("same"), F.asc("alias_id")])
    dims = d.menu_aliases.join(preferred, "concept_id").select("menu_alias", "concept_slug", "canonical_name", F.coalesce("query_alias", "concept_normalized").alias("preferred_query"))
    rows = items.join(dims, items["normalized_name"] == dims["menu_alias"], "left").withColumn("class", classify(F.col("name"), F.col("section"), F.col("description"), F.col("price_minor"), unicode))
    identity = F.when(F.col("concept_slug").isNotNull(), F.concat(F.lit("concept:"), "concept_slug")).otherwise(F.concat(F.lit("menu:"), canonical_identity(F.col("name"), unicode)))
    rows = rows.withColumn("identity", identity)
    return rows.withColumn("class", F.when((F.col("class") == "dish") & (F.col("identity") == "menu:"), "invalid_fragment").otherwise(F.col("class")))


REPRESENTATIVE = [F.desc, "confidence"], [F.desc, "fetched_at"], [F.asc, "position"], [F.asc, "restaurant_name"], [F.asc, "name"], [F.asc, "item_id"]


def browse(d: Domain, city: str, as_of: Column, unicode: bool = True) -> DataFrame:
    """One row per dish: identity, name, query, number of restaurants, up to two example restaurants."""
    dishes = browse_rows(d, city, as_of, unicode).filter("class = 'dish'")
    order = [f(c) for f, c in REPRESENTATIVE]
    name = F.coalesce("canonical_name", canonical_name(F.col("name")))
    best = top_per_key(dishes, ["identity"], order).select("identity", name.alias("dish_name"), "preferred_query")
    counts = dishes.groupBy("identity").agg(F.countDistinct("restaurant_id").alias("restaurant_count"))
    examples = first_distinct(dishes, ["identity"], "restaurant_id", order, 2, "restaurant_examples")
    joined = best.join(counts, "identity").join(examples, "identity")
    return joined.select("identity", "dish_name", F.coalesce("preferred_query", canonical_identity(F.col("dish_name"), unicode)).alias("query"), "restaurant_count", "restaurant_examples")


def ordered(dishes: DataFrame) -> DataFrame:
    """The catalogue of a city in the order it is shown: by name as Norwegian sorts, then by identity."""
    return dishes.orderBy(F.collate("dish_name", "nb"), "identity")


def browse_quality(d: Domain, city: str, as_of: Column, unicode: bool = True) -> DataFrame:
    """One row of counters: raw, valid, excluded, deduplicated, and one column per exclusion class."""
    rows = browse_rows(d, city, as_of, unicode)
    valid = F.col("class") == "dish"
    return rows.agg(
        F.count("*").alias("raw_items"),
        F.count_if(valid).alias("valid_items"),
        F.count_if(~valid).alias("excluded_items"),
        (F.count_if(valid) - F.countDistinct(F.when(valid, F.col("identity")))).alias("deduplicated_items"),
        *[F.count_if(F.col("class") == e).alias(e) for e in EXCLUSIONS],
    )


def _covering(dishes: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, identity, restaurant_count, score): of each topic the dishes of its best score class, 3 for a
    term equal to a dish's query, 2 for one phrase within the other.

    Terms are an editorial list of fixed size; dishes stay where they are and meet them by words.
    """
    terms = F.broadcast(topics.select("topic_id", "term").distinct())
    exact = dishes.join(terms, dishes["query"] == terms["term"]).select("topic_id", "identity", "restaurant_count", F.lit(3).alias("score"))
    words = dishes.withColumn("word", F.explode(F.array_distinct(F.split("query", " "))))
    term_words = F.broadcast(topics.select("topic_id", "term", F.explode(F.array_distinct(F.split("term", " "))).alias("word")).distinct())
    meets = words.join(term_words, "word").filter(phrase_match(F.col("query"), F.col("term")) | phrase_match(F.col("term"), F.col("query")))
    found = exact.unionByName(meets.select("topic_id", "identity", "restaurant_count", F.lit(2).alias("score"))).groupBy("topic_id", "identity").agg(F.max("score").alias("score"), F.max("restaurant_count").alias("restaurant_count"))
    return found.withColumn("best", F.max("score").over(Window.partitionBy("topic_id"))).filter("score = best").drop("best")


def coverage(dishes: DataFrame, topics: DataFrame) -> DataFrame:
    """How well the catalogue covers topics (topic_id, term): the best score class and, of its dishes, the
    number and the largest restaurant count."""
    return _covering(dishes, topics).groupBy("topic_id").agg(F.max("score").alias("score"), F.max("restaurant_count").alias("restaurant_count"), F.count("*").alias("matched_dishes"))


def coverage_examples(dishes: DataFrame, topics: DataFrame, most: int = 2) -> DataFrame:
    """(topic_id, examples): the first distinct example restaurants of the dishes that cover a topic best,
    dishes in the order they are shown."""
    best = _covering(dishes, topics).select("topic_id", "identity").join(dishes.select("identity", "dish_name", "restaurant_examples"), "identity")
    named = best.select("topic_id", F.collate("dish_name", "nb").alias("shown"), "identity", F.posexplode("restaurant_examples").alias("at", "restaurant_id"))
    return first_distinct(named, ["topic_id"], "restaurant_id", [F.asc("shown"), F.asc("identity"), F.asc("at")], most, "examples")


def preview(ranked: DataFrame, areas: list[str], per_area: int = 8, shown: int = 4) -> DataFrame:
    """The preview of an explorer: of each area's first ``per_area`` topics those that no area before it has
    shown, the first ``shown`` of them."""
    place = F.array_position(F.array(*map(F.lit, areas)), F.col("area"))
    listed = ranked.filter((F.col("place") <= per_area) & F.col("area").isin(areas)).withColumn("area_place", place)
    unique = top_per_key(listed, ["topic_id"], [F.asc("area_place"), F.asc("place")])
    return top_per_key(unique, ["area"], [F.asc("place"), F.asc("topic_id")], shown, "shown").select("area", "topic_id", "label", "restaurant_count", "shown")


def ranked_topics(topics: DataFrame, covered: DataFrame) -> DataFrame:
    """Covered topics first, then by restaurants, priority and label."""
    joined = topics.select("topic_id", "label", "priority", "area").distinct().join(covered, "topic_id", "left").withColumn("restaurant_count", F.coalesce("restaurant_count", F.lit(0).cast("long")))
    order = Window.partitionBy("area").orderBy(F.desc(F.col("restaurant_count") > 0), F.desc("restaurant_count"), F.desc("priority"), "label", "topic_id")
    return joined.withColumn("place", F.row_number().over(order)).select("topic_id", "area", "label", "restaurant_count", "place")
