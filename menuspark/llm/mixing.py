"""Mixing sources to target weights by subset-sum budget fitting.

1. One narrow table (id, source, size) is written; sources' totals come from it.
2. Targets: a water-filling of the whole budget over the sources. Sources are numbered in code-point
   order by Spark, and each round of the filling is two sums over them, so their number is free.
3. Each source takes all its rows ``floor(target / size)`` times. What remains of its budget is fitted
   over the counts of rows by exact size, at every budget in the same way: every size gives its even
   share, by cumulative rounding from the longest size down, which leaves less than one longest row;
   rows longer than ``DP_WIDTH`` fill what they can of a gap wider than that; a bounded-knapsack
   dynamic programme over the rows left fits the rest. If it does not end exactly, rows already taken
   are opened again, shortest first, for up to ``DP_WIDTH`` words more.
4. Which rows of a size are taken follows from a seeded hash. Cells (source, size) are cut into hash
   buckets, so ranking a hot cell is spread over ``BUCKETS`` groups; buckets are taken whole in turn
   and one of them in part.

The programme's table has at most ``4 * DP_WIDTH`` sums, whatever the texts' lengths. The histogram of
a source, one row per distinct size, is fitted in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from menuspark.storage import materialize, sized

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 17
BUCKETS = 64
#: Words of the budget that the dynamic programme fits.
DP_WIDTH = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(plan: DataFrame, most: float = MOST_REPEATS) -> DataFrame:
    """``plan`` (source, source_size, weight) with a ``target``: the sum of all sizes shared by weight, none
    above ``most`` times its size; the excess of those that stop there is reshared by weight among the
    others. Each round raises the level, and with it the set of those that stop."""
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stops = F.col("weight") * F.lit(level) > F.col("source_size") * most
        open_weight, stopped = plan.agg(F.sum(F.when(~stops, F.col("weight"))), F.sum(F.when(stops, F.col("source_size")))).first()
        raised = (total - most * (stopped or 0)) / open_weight if open_weight else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return plan.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size").cast("double") * most))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with a ``number`` from 0 in the order of ``source``. Only counts by partition are collected."""
    ranged = materialize(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    starts, at = [], 0
    for part in sorted(counts):
        starts.append((part, at))
        at += counts[part]
    offsets = sources.sparkSession.createDataFrame(starts, "part int, start long")
    turn = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    return ranged.withColumn("turn", turn).join(F.broadcast(offsets), "part").withColumn("number", F.col("start") + F.col("turn") - 1).drop("part", "turn", "start")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, width: int = DP_WIDTH) -> np.ndarray:
    """How many rows of each size to take so that the taken sizes come nearest to ``budget``.

    ``sizes`` are distinct and positive. Exact where the budget, or what it leaves, fits into ``width``;
    beyond it the programme fits the last ``width`` words, which ends exactly but for few and long rows.
    """
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or not len(sizes):
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= whole:
        return counts.copy()
    if budget > whole - budget:  # choose what stays out
        return counts - fit(sizes, counts, whole - budget, width)
    order = np.argsort(-sizes, kind="stable")
    take, seen, shared = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for i in order.tolist():  # in Python's integers, as the products pass 64 bits
        seen += int(counts[i])
        take[i] = budget * seen // whole - shared
        shared += int(take[i])
    rest = budget - int((sizes * take).sum())  # from 0 to less than the longest size
    if rest > width:
        for i in order.tolist():
            more = min(int(counts[i] - take[i]), (rest - width // 2) // int(sizes[i]))
            if more > 0:
                take[i] += more
                rest -= more * int(sizes[i])
            if rest <= width:
                break
        else:  # every row that is left is longer than the gap, or nearly
            left = np.flatnonzero(take < counts)
            near = left[np.argmin(np.abs(sizes[left] - rest))] if len(left) else -1
            if near >= 0 and abs(int(sizes[near]) - rest) < rest:
                take[near] += 1
                rest -= int(sizes[near])
    best, opened = take.copy(), 0
    for more in (0, width // 16, width // 4, width):
        for i in order[::-1].tolist():
            missing = max(more - opened, -rest)
            if missing <= 0:
                break
            back = min(int(take[i]), -(-missing // int(sizes[i])))
            if back > 1 and rest + back * int(sizes[i]) > 2 * width:
                back = max(1, (2 * width - rest) // int(sizes[i]))
            if rest + back * int(sizes[i]) <= 2 * width:
                take[i] -= back
                opened += back * int(sizes[i])
                rest += back * int(sizes[i])
        if not 0 <= rest <= 2 * width:
            continue
        found = take + _programme(sizes, counts - take, rest)
        if abs(budget - int((sizes * found).sum())) < abs(budget - int((sizes * best).sum())):
            best = found
        if int((sizes * best).sum()) == budget:
            break
    return best


def _programme(sizes: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack, longest sizes first: the counts whose sum is nearest to ``rest`` (of two as near,
    the smaller)."""
    able = np.flatnonzero((left > 0) & (sizes <= 2 * rest))
    top = 2 * rest
    first = np.full(top + 1, -2, dtype=np.int64)  # the first size by which a sum is reached
    first[0] = -1
    for i in able[np.argsort(-sizes[able], kind="stable")]:
        if first[rest] > -2:
            break
        size, pieces, n = int(sizes[i]), 1, min(int(left[i]), top // int(sizes[i]))
        reach = first > -2
        while n > 0:
            step = min(pieces, n)
            shifted = np.zeros_like(reach)
            shifted[step * size :] = reach[: top + 1 - step * size]
            reach |= shifted
            n, pieces = n - step, pieces * 2
        first[reach & (first == -2)] = i
    sums = np.flatnonzero(first > -2)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    out = np.zeros(len(sizes), dtype=np.int64)
    while at > 0:
        i = first[at]
        while first[at] == i:  # back to the nearest sum that needs no row of this size
            at -= int(sizes[i])
            out[i] += 1
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(id, row, size, source_size, target, taken) for every row of ``docs``.

    ``size`` counts words, null texts have none. Sources in code-point order, null last, weigh
    ``weights`` in turn. ``taken`` is ``size`` times the number of times that the mix takes the row
    (0 to 3). Rows of size 0 are never taken; a source without words has target 0; an empty table
    gives an empty result. Equal rows are told apart by id and row, so reruns agree. Only the named
    columns are read, so others may have any name.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    count = docs.count()
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), key.alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-rows",
        rows=count,
    )
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    plan = materialize(sources.select("source", "source_size", weight.alias("weight")), "mix-plan")
    listed, width = plan.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("source")), F.lit(0.0))).first()
    plan = sized(water_fill(plan).drop("weight"), listed, int(width) + 48)

    cell = ["source", "size", "bucket"]
    mixed_hash = F.xxhash64(F.lit(seed), "id")
    dealt = rows.withColumn("hash", mixed_hash).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    ranked = dealt.withColumn("turn", F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "id", "row")))
    cells = materialize(dealt.groupBy(*cell).agg(F.count("*").alias("n")), "mix-cells", rows=count)
    sizes = cells.filter("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")).join(plan, "source")

    def fit_source(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        whole, goal = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        times = min(MOST_REPEATS, int((goal + 1e-6) // whole))
        extra = fit(group["size"].to_numpy(), group["n"].to_numpy(), round(goal - times * whole) if times < MOST_REPEATS else 0)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "times": times, "extra": extra})

    fitted = sizes.groupBy("source").applyInPandas(fit_source, "source string, size long, times long, extra long")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quotas = cells.join(fitted, ["source", "size"]).select(*cell, "times", F.greatest(F.lit(0), F.col("extra") - F.coalesce(before, F.lit(0))).alias("quota"))
    counted = ranked.join(quotas, cell, "left")
    times = F.coalesce(F.col("times") + (F.col("turn") <= F.col("quota")).cast("long"), F.lit(0))
    return counted.join(plan, "source").select("id", "row", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))
