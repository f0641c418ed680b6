"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. One narrow table (id, row, digest) of all rows is written. From its counts comes the number of salts
   of each digest: one for each begun ``1 / MOST_HOT`` of all rows (of ``SALT_ROWS`` rows at least).
   Digests with more than one salt, at most ``MOST_HOT`` of them, are the only broadcast here.
2. Local: rows combine map-side by (digest, salt, full text).
3. Salted: each (digest, salt, full text) is merged after one shuffle.
4. Global: the winners of several salts are combined by (digest, full text). A digest of one salt has no
   other winner to meet: step 3 held all its rows against each other, and its winners pass unchanged.
5. A digest that names two different texts is a collision. Its rows, if there ever are any, are grouped
   by their full text again and joined by it; with all others the digest stands for the text, which
   steps 2 to 4 have shown by comparing texts in full.
6. The narrow table gets the winners by a join on the digest, whose large partitions AQE splits.

The text of the corpus is shuffled once. The salts decide only where rows meet: any number of them
gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuspark.storage import materialize

SALT_ROWS = 1000
MOST_HOT = 10_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the byte-wise path of ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, salt_rows: int = SALT_ROWS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, row, keep_id, group_size, kept, digest) for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a
    group stays; of rows repeated with that id, one. Null ids lose against any other and stay only
    where a group has no other (``keep_id`` is null then). ``group_size`` counts rows. An empty table
    gives an empty result. Only the named columns are read, so others may have any name. A ``digest``
    that collides costs time and never merges different texts.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    source = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")).withColumn("digest", digest(F.col("norm")))

    count = docs.count()
    rows = materialize(source.select("id", "row", "digest"), "exact-rows", rows=count)
    each = max(salt_rows, -(-count // MOST_HOT))
    salted_more = rows.groupBy("digest").count().filter(F.col("count") > each).select("digest", F.ceil(F.col("count") / each).cast("int").alias("salts"))

    dealt = source.select("norm", "id", "digest").join(F.broadcast(salted_more), "digest", "left")
    dealt = dealt.select("id", "norm", "digest", "salts", F.when(F.col("salts").isNotNull(), F.pmod(F.spark_partition_id(), F.col("salts"))).otherwise(0).alias("salt"))
    salted = dealt.groupBy("digest", "salts", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    # content is kept only where the winners of several salts are still to meet
    merged = materialize(salted.select("digest", "salts", F.when(F.col("salts").isNotNull(), F.col("norm")).alias("content"), "keep_id", "n"), "exact-salted", rows=count)
    complete = merged.filter("salts IS NULL").select("digest", "keep_id", F.col("n").alias("group_size"))
    combined = merged.filter("salts IS NOT NULL").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = complete.unionByName(combined.drop("content")).withColumn("text_of", F.lit(0))
    collided = materialize(winners.groupBy("digest").count().filter("count > 1").select("digest"), "exact-collided", rows=1)

    found, group = rows, ["digest"]
    if not collided.isEmpty():
        own = materialize(source.join(collided, "digest", "left_semi"), "exact-collided-rows")
        texts = own.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        texts = texts.withColumn("text_of", F.row_number().over(Window.partitionBy("digest").orderBy("norm")))
        named = own.join(texts, ["digest", "norm"]).select("id", "row", "digest", "text_of")
        found = rows.join(collided, "digest", "left_anti").withColumn("text_of", F.lit(0)).unionByName(named)
        winners = winners.join(collided, "digest", "left_anti").unionByName(texts.select(*winners.columns))
        group = ["digest", "text_of"]
    # of rows repeated with the id that stays, the first
    first = found.join(winners, group).filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*group).agg(F.min("row").alias("keep_row"))
    whole = materialize(winners.join(first, group).select(*group, "keep_id", "group_size", "keep_row"), "exact-groups", rows=count)
    return found.join(whole, group).select("id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
