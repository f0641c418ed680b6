"""Menu versions: price semantics, fingerprints, diffs, gates, and one observation per source key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.functions.text import dish_name, optional_text
from menuspark.operators.latest import top_per_key


def price_violation(kind: Column, minor: Column, top: Column) -> Column:
    """Null for a sound price, else what is wrong with it. A null kind counts as exact."""
    k = F.coalesce(kind, F.lit("exact"))
    return (
        F.when((minor < 0) | (top < 0), "negative")
        .when(~k.isin("exact", "from", "multiple"), "unknown_kind")
        .when((k == "exact") & top.isNotNull(), "exact_with_maximum")
        .when((k == "from") & minor.isNull(), "from_without_price")
        .when((k == "from") & top.isNotNull(), "from_with_maximum")
        .when((k == "multiple") & (minor.isNull() | top.isNull()), "multiple_without_range")
        .when((k == "multiple") & (top < minor), "maximum_below_price")
    )


def sound_prices(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with sound prices, quarantined rows with ``violation``)."""
    marked = items.withColumn("violation", price_violation(F.col("price_kind"), F.col("price_minor"), F.col("price_max_minor")))
    return marked.filter("violation IS NULL").drop("violation").withColumn("price_kind", F.coalesce("price_kind", F.lit("exact"))), marked.filter("violation IS NOT NULL")


#: How JSON writes what it cannot hold as it is.
_ESCAPES = {chr(c): f"\\u{c:04x}" for c in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def _json_text(c: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters are escaped, all else stays."""
    table = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])
    escaped = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(c), F.lit('"'))


def _json_or_null(c: Column) -> Column:
    return F.coalesce(_json_text(c), F.lit("null"))


def fingerprint(items: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """keys and ``fingerprint``: a digest of a menu's normalised items, whatever their order.

    ``items`` has name, description, section, price_minor, currency and, where there are such,
    price_kind and price_max_minor. Items sort by name and section (Norwegian collation), price and
    maximum; a kind other than exact and a maximum appear only where set.
    """
    kind = F.coalesce(F.col("price_kind"), F.lit("exact")) if "price_kind" in items.columns else F.lit("exact")
    top = F.col("price_max_minor") if "price_max_minor" in items.columns else F.lit(None).cast("long")
    name, section = dish_name(F.col("name"), unicode), optional_text(F.col("section"), unicode)
    number = F.coalesce(F.col("price_minor").cast("string"), F.lit("null"))
    written = F.concat(
        F.lit('{"name":'), _json_text(name), F.lit(',"description":'), _json_or_null(optional_text(F.col("description"), unicode)), F.lit(',"sectionName":'), _json_or_null(section),
        F.lit(',"priceMinor":'), number, F.lit(',"currency":'), _json_text(F.upper("currency")),
        F.when(kind != "exact", F.concat(F.lit(',"priceKind":'), _json_text(kind))).otherwise(F.lit("")),
        F.when(top.isNotNull(), F.concat(F.lit(',"priceMaxMinor":'), top.cast("string"))).otherwise(F.lit("")), F.lit("}"),
    )
    rows = items.select(*keys, F.struct(F.collate(name, "nb").alias("name"), F.collate(F.coalesce(section, F.lit("")), "nb").alias("section"), F.coalesce("price_minor", F.lit(-1)).alias("price"), F.coalesce(top, F.lit(-1)).alias("top"), written.alias("written")).alias("entry"))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return listed.select(*keys, F.sha2(F.concat(F.lit("["), F.array_join(F.transform("entries", lambda e: e["written"]), ","), F.lit("]")), 256).alias("fingerprint"))


def diff(previous: DataFrame, current: DataFrame, key: str = "source_key", unicode: bool = True) -> DataFrame:
    """(source_key, kind): added, removed, price_changed, content_changed. An item may have both changes.

    Blank and null descriptions and sections are equal. Keys are unique on either side.
    """
    def side(df: DataFrame) -> Column:
        kind = F.coalesce(F.col("price_kind"), F.lit("exact")).alias("price_kind") if "price_kind" in df.columns else F.lit("exact").alias("price_kind")
        top = F.col("price_max_minor") if "price_max_minor" in df.columns else F.lit(None).cast("long").alias("price_max_minor")
        return F.struct(
            F.struct("price_minor", "currency", kind, top).alias("price"),
            F.struct(F.col("name"), optional_text(F.col("description"), unicode).alias("description"), optional_text(F.col("section"), unicode).alias("section")).alias("content"),
        )

    before, after = previous.select(key, side(previous).alias("before")), current.select(key, side(current).alias("after"))
    joined = before.join(after, key, "full_outer")
    same = {part: F.col(f"before.{part}").eqNullSafe(F.col(f"after.{part}")) for part in ("price", "content")}
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    kinds = F.array_compact(F.array(F.when(F.col("before").isNull(), "added"), F.when(F.col("after").isNull(), "removed"), F.when(both & ~same["price"], "price_changed"), F.when(both & ~same["content"], "content_changed")))
    return joined.select(key, F.explode(kinds).alias("kind"))


def extraction_gate(previous: Column, current: Column, minimum: Column) -> Column:
    drop = (previous >= 8) & (current < F.ceil(previous * 0.5))
    return F.when(current < minimum, "below_minimum").when(drop, "suspicious_drop").otherwise("ok")


def hours_gate(previous: Column, current: Column, minimum: Column, same_fingerprint: Column, same_extractor: Column) -> Column:
    """quarantined below half of the previous intervals or the minimum; unchanged needs both the same
    schedule and the same extractor to write nothing (``unchanged``), else ``reextracted``."""
    required = F.greatest(minimum, F.coalesce(F.ceil(previous * 0.5), F.lit(0)).cast("int"))
    return F.when(current < required, "quarantined").when(same_fingerprint & same_extractor, "unchanged").when(same_fingerprint, "reextracted").otherwise("changed")


def one_per_source_key(items: DataFrame, keys: list[str], unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row per key, keys whose observations contradict each other).

    Observations agree in normalised name and section, price and currency, and in the description where
    both have one. Preferred are a description, confidence, a long excerpt, an early position.
    """
    described = optional_text(F.col("description"), unicode)
    marked = items.withColumn("__described", described).withColumn("__name", dish_name(F.col("name"), unicode)).withColumn("__section", dish_name(F.coalesce("section", F.lit("")), unicode))
    traits = {"names": F.col("__name"), "sections": F.col("__section"), "prices": F.struct(F.coalesce("price_minor", F.lit(-1)), F.upper("currency")), "descriptions": F.col("__described")}
    hashed = marked.select(*keys, *[F.when(c.isNotNull(), F.xxhash64(c)).alias(n) for n, c in traits.items()])
    spread = hashed.groupBy(*keys).agg(*[(F.min(n) < F.max(n)).alias(n) for n in traits])
    split = spread.select(*keys, F.coalesce(F.greatest(*[F.coalesce(n, F.lit(False)) for n in traits]), F.lit(False)).alias("split"))
    clashing = hashed.join(split.filter("split").select(*keys), keys, "left_semi").groupBy(*keys).agg(*[F.countDistinct(n).alias(n) for n in traits], F.count("*").alias("observations"))
    order = [F.col("__described").isNull(), F.desc("confidence"), F.desc(F.length(F.coalesce("excerpt", F.lit("")))), F.asc("position"), F.asc("item_id")]
    best = top_per_key(marked, keys, order).join(split.filter("NOT split").select(*keys), keys, "left_semi").drop("__described", "__name", "__section")
    return best, clashing


def needs_reextract(stored: Column, current: Column) -> Column:
    return ~stored.eqNullSafe(current)
