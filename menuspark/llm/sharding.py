"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts are placed together, each where the dot product of its share vector (bytes,
tokens and rows, as shares of a shard's capacity) with the shard's residual capacity is highest, the
largest group first. So that any number of groups can be placed that way:

* Groups of about the same vector form a class: bytes within a quarter of an octave, tokens and rows
  within half of one, which bounds the number of classes whatever the corpus holds. Groups that hold
  over ``1 / (shards * UNITS)`` of the bytes, tokens or rows, at most ``3 * shards * UNITS`` of them,
  are a class each.
* The driver packs class by class. ``allot`` gives the outcome of placing the class's groups one by
  one by the dot product, without a step for each.
* Packing takes two rounds. The first places the classes of large groups, seven eighths of all bytes;
  the second places the rest into what is really left, so differences inside a class even out.
* A group of more bytes than a shard's capacity has no place by any rule: it alone is dealt by hash
  into pieces that do fit, which are packed like groups.

The law that holds afterwards is ``bytes``. Ranks within a class, and slots within a shard, come from
counts by hash bucket and a rank within each bucket, so no task ranks a whole class or shard.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from menuspark.storage import materialize, sized

SHARDS = 16
UNITS = 256
#: Pieces that a group too large for any shard is cut into, for each shard that it could fill.
PIECES = 8
FIRST_ROUND = 7 / 8
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def _highest(scores: np.ndarray, step: float, caps: np.ndarray, m: int) -> np.ndarray:
    """How many picks each shard gets if ``m`` picks go one by one to the highest score (of equal ones the
    first), each lowering its shard's score by ``step``; no shard gets more than its cap."""
    caps = np.minimum(caps, m)
    if caps.sum() <= m:
        return caps

    def above(level: float) -> np.ndarray:
        return np.clip(np.ceil((scores - level) / step), 0, caps).astype(np.int64)

    low, high = float(scores.min() - step * (m + 1)), float(scores.max())
    for _ in range(100):
        middle = (low + high) / 2
        if above(middle).sum() > m:
            low = middle
        else:
            high = middle
    out = above(high)
    heap = [(-(scores[s] - step * out[s]), s) for s in range(len(scores)) if out[s] < caps[s]]
    heapq.heapify(heap)
    for _ in range(m - int(out.sum())):
        score, s = heapq.heappop(heap)
        out[s] += 1
        if out[s] < caps[s]:
            heapq.heappush(heap, (score + step, s))
    return out


def allot(vector: np.ndarray, m: int, residual: np.ndarray) -> np.ndarray:
    """How many of ``m`` equal units go to each shard; lowers ``residual`` by what they fill.

    A unit goes to the highest dot product among the shards that can hold it in every dimension, else
    among those that can hold its bytes, else to the one with most bytes left; ties to the first.
    """
    out = np.zeros(len(residual), dtype=np.int64)
    whole = np.full(len(residual), m, dtype=np.int64)
    for tier in range(3):
        left = m - int(out.sum())
        if not left:
            break
        now = residual - out[:, None] * vector
        dims = vector > 0 if tier == 0 else np.array([True] + [False] * (len(vector) - 1))
        fits = np.clip(np.floor((now[:, dims] / vector[dims]).min(axis=1) + 1e-9), 0, m).astype(np.int64) if tier < 2 else whole
        if tier < 2:
            out += _highest(now @ vector, float(vector @ vector), fits, left)
        else:
            out += _highest(now[:, 0], float(vector[0]), whole, left)
    residual -= out[:, None] * vector
    return out


def pack(vectors: np.ndarray, counts: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The units of each class (row of ``vectors``, ``counts`` of them) by shard, the largest class first."""
    out = np.zeros((len(vectors), len(residual)), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))) if len(vectors) else []:
        out[i] = allot(vectors[i], int(counts[i]), residual)
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """(id, row, size, text_crc32, law, shard, slot) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one, so empty and null texts, which are equal here, still
    count. ``slot`` numbers a shard's rows from 0 without gaps, by id within a hash bucket. Repeated
    rows are rows like any other; an empty table gives an empty result. Only the named columns are read,
    so others may have any name.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = docs.count()
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), text.alias("text")).select(
            "id",
            "row",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32("text").alias("text_crc32"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
        ),
        "shard-rows",
        rows=count,
    )
    totals = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    whole = np.array([max(1, x or 0) for x in totals], dtype=float)
    share = F.greatest(F.col("size") / float(whole[0]), F.col("tokens") / float(whole[1]), F.col("n") / float(whole[2]))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]

    groups = materialize(rows.groupBy("digest").agg(*sums).withColumn("share", share), "shard-groups", rows=count)
    filled = F.col("size") / float(whole[0]) * shards
    beyond = groups.filter(filled > 1).select("digest", F.ceil(filled * PIECES).cast("int").alias("pieces"))  # fewer than shards
    pieced = rows.join(F.broadcast(beyond), "digest", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id", "row"), F.col("pieces")), F.lit(0)).cast("int"))
    split = pieced.filter("pieces IS NOT NULL").groupBy("digest", "piece").agg(*sums).withColumn("share", share)
    single = groups.filter(filled <= 1).withColumn("piece", F.lit(0))

    about = F.concat_ws(":", *[F.floor(F.log2(F.col(c) + 1) * k).cast("string") for c, k in (("size", 4), ("tokens", 2), ("n", 2))])
    kind = F.when(F.col("share") > 1.0 / (shards * units), F.concat(F.hex("digest"), F.lit("/"), F.col("piece"))).otherwise(about)
    made = materialize(single.unionByName(split).select("digest", "piece", "size", "tokens", "n", kind.alias("kind"), F.pmod(F.xxhash64("digest", "piece"), F.lit(BUCKETS)).cast("int").alias("bucket")), "shard-units", rows=count)
    classes = sorted(tuple(r) for r in made.groupBy("kind").agg(F.count("*").alias("m"), F.sum("size"), F.sum("tokens"), F.sum("n")).collect())
    counts = np.array([c[1] for c in classes], dtype=np.int64)
    vectors = np.array([c[2:] for c in classes], dtype=float).reshape(-1, 3) / np.maximum(counts, 1)[:, None] * shards / whole

    before = F.sum("m").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = made.groupBy("kind", "bucket").agg(F.count("*").alias("m")).select("kind", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    turn = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("digest", "piece"))
    ranked = made.withColumn("turn", turn).join(starts, ["kind", "bucket"]).withColumn("rank", F.col("start") + F.col("turn") - 1)
    ranked = materialize(ranked.select("digest", "piece", "size", "tokens", "n", "kind", "rank"), "shard-ranked", rows=count)

    def placed(chosen: np.ndarray, taken: np.ndarray) -> DataFrame:
        """The units of the chosen classes with their shards."""
        upto = [(classes[i][0], [int(x) for x in np.cumsum(taken[i])]) for i in np.flatnonzero(chosen)]
        plan = spark.createDataFrame(upto, "kind string, upto array<long>")
        shard = F.size(F.filter("upto", lambda x: x <= F.col("rank"))).alias("shard")
        return ranked.join(F.broadcast(plan), "kind").select("digest", "piece", "size", "tokens", "n", shard)

    residual = np.ones((shards, 3))
    taken = np.zeros((len(classes), shards), dtype=np.int64)
    order = np.lexsort((np.arange(len(classes)), -vectors.max(axis=1))) if len(classes) else np.zeros(0, dtype=np.int64)
    mass = np.cumsum((vectors[:, 0] * counts)[order]) / shards
    first = np.zeros(len(classes), dtype=bool)
    first[order[np.concatenate(([0.0], mass[:-1])) < FIRST_ROUND] if len(order) else order] = True
    taken[first] = pack(vectors[first], counts[first], residual)
    if not first.all():
        residual = np.ones((shards, 3))
        for r in placed(first, taken).groupBy("shard").agg(*sums[:2], F.sum("n").alias("n")).collect():
            residual[r["shard"]] -= np.array([r["size"], r["tokens"], r["n"]], dtype=float) * shards / whole
        taken[~first] = pack(vectors[~first], counts[~first], residual)

    units_at = materialize(placed(np.ones(len(classes), dtype=bool), taken).select("digest", "piece", "shard"), "shard-plan", rows=count)
    dealt = pieced.select("id", "row", "size", "text_crc32", "digest", "piece").join(sized(units_at, int(counts.sum()), 160), ["digest", "piece"])
    bucketed = materialize(dealt.select("id", "row", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket")), "shard-placed", rows=count)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    turn = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "row"))
    slotted = bucketed.withColumn("turn", turn).join(F.broadcast(offsets), ["shard", "bucket"])
    return slotted.select("id", "row", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("turn") - 1).cast("long").alias("slot"))
