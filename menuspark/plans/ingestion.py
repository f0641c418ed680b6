"""Menu watch over landed pages: extract, canonicalise, gate, fingerprint, diff, and the rows to append.

Pages are landed by a fetcher outside this engine as (source_id, html, fetched_at, status, etag). Pages
that answered 304 or whose raw digest did not change never reach extraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menuspark.extract.menu import extract_items
from menuspark.operators.snapshots import diff, extraction_gate, fingerprint, one_per_source_key
from menuspark.storage import materialize, sized


@dataclass(frozen=True)
class Watch:
    """What one pass decided, and what it appends."""

    outcomes: DataFrame
    items: DataFrame
    changes: DataFrame


def watch(pages: DataFrame, sources: DataFrame, previous_items: DataFrame, extractor: str) -> Watch:
    """One pass over ``pages``.

    ``sources``: (source_id, minimum_items, last_raw_sha256, last_fingerprint, last_extractor);
    ``previous_items``: the items of each source's latest snapshot. Outcomes: not_modified, fetch_error,
    conflicting_keys, below_minimum, suspicious_drop, unchanged, changed. A source whose extractor
    version is new is extracted again even if its page is the same. Where the sources fit a broadcast,
    pages are not shuffled.
    """
    raw = F.sha2(F.coalesce("html", F.lit("")), 256)
    landed = pages.join(sized(sources, sources.count(), 256), "source_id").withColumn("raw_sha256", raw)
    same = (F.col("status") == 304) | (raw.eqNullSafe(F.col("last_raw_sha256")) & F.col("last_extractor").eqNullSafe(F.lit(extractor)))
    state = F.when(F.col("status") == 304, "not_modified").when(F.col("status") != 200, "fetch_error").when(same, "not_modified")
    landed = landed.withColumn("early", state)

    found = materialize(extract_items(landed.filter("early IS NULL"), "source_id", "html"), "watch-items")
    marked = found.withColumn("item_id", F.concat_ws(":", "source_key", "position"))
    unique, clashing = one_per_source_key(marked, ["source_id", "source_key"])
    counts = unique.groupBy("source_id").agg(F.count("*").alias("item_count"))
    before = previous_items.groupBy("source_id").agg(F.count("*").alias("previous_count"))
    prints = fingerprint(unique, ["source_id"])
    conflicted = clashing.select("source_id").distinct().withColumn("conflict", F.lit(True))

    joined = landed.join(counts, "source_id", "left").join(before, "source_id", "left").join(prints, "source_id", "left").join(conflicted, "source_id", "left")
    number = F.coalesce("item_count", F.lit(0).cast("long"))
    gate = extraction_gate(F.coalesce("previous_count", F.lit(0).cast("long")), number, F.col("minimum_items"))
    unchanged = F.col("fingerprint").eqNullSafe(F.col("last_fingerprint")) & F.col("last_extractor").eqNullSafe(F.lit(extractor))
    outcome = F.coalesce("early", F.when(F.col("conflict"), "conflicting_keys").when(gate != "ok", gate).when(unchanged, "unchanged").otherwise("changed"))
    outcomes = materialize(joined.select("source_id", "fetched_at", outcome.alias("outcome"), number.alias("item_count"), "raw_sha256", "fingerprint"), "watch-outcomes")

    changed = outcomes.filter("outcome = 'changed'").select("source_id")
    items = unique.join(changed, "source_id", "left_semi")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("source_key", F.concat_ws(":", "source_id", "source_key"))

    changes = diff(keyed(previous_items.join(changed, "source_id", "left_semi")), keyed(items))
    split = F.split("source_key", ":", 2)
    return Watch(outcomes, items, changes.select(split[0].cast("long").alias("source_id"), split[1].alias("source_key"), "kind"))
