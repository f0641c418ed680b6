"""The five-tier match of a query against normalised names, and trigram candidates at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.text import TRIGRAM_THRESHOLD, trigram_list, trigram_overlap, trigrams
from menuspark.storage import materialize

FUZZY_MOST = 0.89


def literal_similarity(name: Column, query: str) -> Column:
    """Similarity to a literal: its trigrams are made once, on the driver."""
    grams = trigram_list(query)
    return trigram_overlap(trigrams(name), F.array(*map(F.lit, grams)) if grams else F.array().cast("array<string>"))


def match_tiers(df: DataFrame, query: str, name_col: str = "normalized_name", canonical_col: str = "canonical_id") -> DataFrame:
    """Rows that match ``query``, with match_type and score: exact 1, canonical 0.98, prefix 0.95,
    contains 0.9, fuzzy the trigram similarity up to 0.89."""
    name, canonical = F.col(name_col), F.col(canonical_col).isNotNull()
    scored = df.withColumn("similarity", F.round(literal_similarity(name, query), 6))
    ladder = F.when(name == query, "exact").when(canonical, "canonical").when(name.startswith(query), "prefix").when(name.contains(query), "contains").when(F.col("similarity") >= TRIGRAM_THRESHOLD, "fuzzy")
    found = scored.withColumn("match_type", ladder).filter(F.col("match_type").isNotNull())
    kind = F.col("match_type")
    score = F.when(kind == "exact", 1.0).when(kind == "canonical", 0.98).when(kind == "prefix", 0.95).when(kind == "contains", 0.9).otherwise(F.least(F.lit(FUZZY_MOST), F.col("similarity")))
    return found.withColumn("score", score).drop("similarity")


def trigram_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """(left_text, right_text, similarity) of all pairs of distinct texts at or above ``threshold``.

    Prefix filter: with grams in one global order (rare first), two texts that share at least a fraction
    t of all their grams must meet in the first n - ceil(t * n) + 1 grams of each. The equi-join on
    those carries numbers only: ids, sizes and places; a pair goes on if, from the place where it meets,
    enough grams are left for the overlap that it needs. Texts and grams join the distinct pairs.
    """

    def grams_of(df: DataFrame, col: str) -> DataFrame:
        texts = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("text")).distinct().withColumn("grams", trigrams(F.col("text"))).filter(F.size("grams") > 0)
        return materialize(texts.withColumn("id", F.monotonically_increasing_id()), "trigram-texts")

    a, b = grams_of(left, left_col), grams_of(right, right_col)
    counts = a.select("grams").unionByName(b.select("grams")).select(F.explode("grams").alias("gram")).groupBy("gram").count()

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ordered = df.select("id", F.explode("grams").alias("gram")).join(counts, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "gram"))).alias("grams"))
        size = F.size("grams")
        keep = F.greatest(F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
        return ordered.select(F.col("id").alias(name), size.alias(f"{name}_size"), F.posexplode(F.slice("grams", F.lit(1), keep)).alias(f"{name}_at", "g")).select(name, f"{name}_size", f"{name}_at", F.col("g.gram").alias("gram"))

    n, m = F.col("a_size"), F.col("b_size")
    needed = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    left_over = F.least(n - F.col("a_at"), m - F.col("b_at"))  # this gram and those behind it
    before = F.least("a_at", "b_at")
    pairs = prefixes(a, "a").join(prefixes(b, "b"), "gram").filter((n >= threshold * m - 1e-9) & (m >= threshold * n - 1e-9) & (left_over + before >= needed)).select("a", "b").distinct()
    score = F.round(trigram_overlap(F.col("a_grams"), F.col("b_grams")), 6)
    named = pairs.join(a.select(F.col("id").alias("a"), F.col("text").alias("left_text"), F.col("grams").alias("a_grams")), "a").join(b.select(F.col("id").alias("b"), F.col("text").alias("right_text"), F.col("grams").alias("b_grams")), "b")
    return named.select("left_text", "right_text", score.alias("similarity")).filter(F.col("similarity") >= threshold)


def _pieces(text: Column, n: Column) -> Column:
    """The substrings of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def replay(history: DataFrame, names: DataFrame, query_aliases: DataFrame, menu_aliases: DataFrame) -> DataFrame:
    """``history`` (normalized_query, city, ...) with ``current_resolution``: how the index answers it now.

    ``names`` (normalized_name, city) is reduced to distinct names per city first. Exact and canonical
    are equi-joins. For prefix and contains, each distinct query looks up the piece of up to three of its
    characters that fewest names of its city hold, in an equi-join on city and piece, and only those names
    are read. One aggregate then takes the best tier of each (query, city).
    """
    index = names.select(F.lower("city").alias("place"), "normalized_name").distinct()
    asked = history.select(F.lower("city").alias("place"), "normalized_query").distinct()
    exact = asked.join(index, (asked["place"] == index["place"]) & (asked["normalized_query"] == index["normalized_name"]), "left_semi").withColumn("tier", F.lit(1))
    routes = query_aliases.join(menu_aliases, "concept_id").select("query_alias", "menu_alias").distinct()
    routed = asked.join(routes, asked["normalized_query"] == routes["query_alias"])
    canonical = routed.join(index, (routed["place"] == index["place"]) & (routed["menu_alias"] == index["normalized_name"]), "left_semi").select("place", "normalized_query", F.lit(2).alias("tier"))

    name, q = F.col("normalized_name"), F.col("normalized_query")
    filed = index.select("place", "normalized_name", F.explode(F.array_distinct(F.concat(*[_pieces(name, F.lit(n)) for n in (1, 2, 3)]))).alias("piece"))
    held = filed.groupBy("place", "piece").agg(F.count("*").alias("n"))
    wanted = asked.filter(F.length(q) > 0).select("place", "normalized_query", F.explode(F.array_distinct(_pieces(q, F.least(F.lit(3), F.length(q))))).alias("piece"))
    rarest = wanted.join(held, ["place", "piece"], "left").groupBy("place", "normalized_query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece").alias("piece"))).alias("r")).filter("r.n > 0")
    met = rarest.select("place", "normalized_query", F.col("r.piece").alias("piece")).join(filed, ["place", "piece"]).filter(F.contains(name, q))
    inside = met.select("place", "normalized_query", F.when(F.startswith(name, q), 3).otherwise(4).alias("tier"))
    best = exact.unionByName(canonical).unionByName(inside).groupBy("place", "normalized_query").agg(F.min("tier").alias("tier"))
    named = best.select(F.col("place").alias("__place"), F.col("normalized_query").alias("__query"), F.element_at(F.array(*map(F.lit, ("exact", "canonical", "prefix", "contains"))), F.col("tier")).alias("current_resolution"))
    return history.join(named, (F.lower(history["city"]) == named["__place"]) & (history["normalized_query"] == named["__query"]), "left").drop("__place", "__query")
