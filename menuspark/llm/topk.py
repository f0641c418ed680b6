"""Exact top-k inner products by norm order, rotated partial sums and Cauchy-Schwarz bounds.

1. Vectors are quantised to integers with SQL functions and sorted by descending length into blocks.
2. A rotation comes from the singular vectors of a bounded sample (``ROTATION_SAMPLE`` rows). Any
   rotation is exact; a good one puts most of a product into the first ``HEAD_DIMS`` dimensions.
3. The longest vectors (``SEED_ROWS`` of them, at most ``SEED_BYTES``) are scored against each query
   first. The k-th best score found is a threshold that the query's final k-th score cannot fall below.
4. A block of queries meets only blocks whose longest vector can still reach a threshold; since
   blocks are in order of length, that is a prefix of them.
5. Within a pair of blocks the partial product over the leading dimensions plus the product of the
   residual lengths bounds each score from above; only pairs that reach the threshold are scored,
   in integers. Each pair of blocks gives at most k rows a query.

Blocks of queries meet blocks of vectors by an equi-join on the block number, so memory per task is
two blocks, and no number of queries or vectors is held by the driver. Only one number per block
(its greatest length) reaches it. Blocks travel in the narrowest integers that hold every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuspark.storage import materialize

SCALE = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 512
SEED_ROWS = 2048
SEED_BYTES = 16 << 20
ROTATION_SAMPLE = 4096
HEAD_DIMS = 16
#: Above this, sums of products leave the integers that doubles hold exactly.
_EXACT = float(1 << 52)


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(embedding.isNotNull() & fine, F.lit(False))


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``q`` and ``c``."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), dtype=np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < _EXACT:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def narrowest(most: float) -> np.dtype:
    """The smallest integer type for values up to ``most`` in size."""
    return np.dtype(next(t for t in ("i1", "i2", "i4", "i8") if most <= np.iinfo(t).max or t == "i8"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, shorter vectors filled up with zeros."""
    out = np.zeros((len(lists), dims), dtype=np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = values
    return out


def lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row with allowed columns: its index and its k best columns, ties to the smaller id, then
    to the smaller row number."""
    for i in np.flatnonzero(allowed.any(axis=1)):
        cols = np.flatnonzero(allowed[i])
        if len(cols) > k:
            cut = np.partition(scores[i, cols], len(cols) - k)[len(cols) - k]
            cols = cols[scores[i, cols] >= cut]
        yield int(i), cols[np.lexsort((rows[cols], ids[cols], -scores[i, cols]))[:k]]


def _blocks(batches: Iterator[pa.RecordBatch], most: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row numbers, vectors) of ``most`` rows at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return t.column("id").to_numpy().astype(np.int64), t.column("row").to_numpy().astype(np.int64), matrix(pa.concat_arrays(t.column("v").chunks), dims)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            held.append(part)
            count += part.num_rows
            while count >= most:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield block(whole.slice(0, most))
                held, count = whole.slice(most).to_batches(), count - most
    if count:
        yield block(pa.Table.from_batches(held).combine_chunks())


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which ``queries`` holds.

    Scores are inner products of floor(scale * x); ties go to the smaller id. Rows are told apart by a
    row number and not by id: a repeated row counts each time, other rows of a query's id are among its
    candidates, and each row of a repeated query id has a list of its own. Null vectors, and vectors
    with null or non-finite components, take no part; nor do rows without an id. Shorter vectors count
    as filled up with zeros. Fewer than k candidates give them all, an empty table none. Only the two
    named columns and those of ``queries`` are read.
    """
    spark = vectors.sparkSession
    rows = materialize(
        vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), quantised(F.col(vector_col), scale).alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
        .withColumn("row", F.monotonically_increasing_id()),
        "topk-rows",
    )
    widest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    facts = rows.agg(F.max(F.size("v")), F.count("*"), F.max(widest)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts[1]:
        return spark.createDataFrame([], schema)
    dims = max(1, facts[0])
    kept = narrowest(float(facts[2] or 0))

    def collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.select("row", "v").collect()
        m = np.zeros((len(got), dims), dtype=np.int64)
        for i, r in enumerate(got):
            m[i, : len(r["v"])] = r["v"]
        return np.array([r["row"] for r in got], dtype=np.int64), m

    _, sample = collected(rows.orderBy(F.xxhash64("id"), "id", "row").limit(max(64, min(ROTATION_SAMPLE, SEED_BYTES // (8 * dims)))))
    gram = sample.astype(float).T @ sample.astype(float)
    turn = np.linalg.eigh(gram)[1][:, ::-1].copy()
    lead = min(HEAD_DIMS, dims)
    seed_rows, seed = collected(rows.orderBy(F.desc("norm"), "id", "row").limit(max(4 * k, min(SEED_ROWS, SEED_BYTES // (8 * dims)))))

    def vector_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, (ids, own, m) in enumerate(_blocks(batches, BLOCK_ROWS, dims)):
            made = {"longest": [float(lengths(m).max())], "part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int32()), "ids": [ids.tobytes()], "own": [own.tobytes()], "m": [m.astype(kept).tobytes()]}
            yield pa.RecordBatch.from_pydict(made)

    parts = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts[1] // BLOCK_ROWS)))
    ranged = rows.repartitionByRange(parts, F.desc("norm"), "id", "row").sortWithinPartitions(F.desc("norm"), "id", "row").select("id", "row", "v")
    blocks = materialize(ranged.mapInArrow(vector_blocks, "longest double, part int, at int, ids binary, own binary, m binary"), "topk-blocks")
    order = sorted(((r["longest"], r["part"], r["at"]) for r in blocks.select("longest", "part", "at").collect()), key=lambda x: (-x[0], *x[1:]))
    descending = -np.array([x[0] for x in order])
    numbered = blocks.join(F.broadcast(spark.createDataFrame([(p, a, i) for i, (_, p, a) in enumerate(order)], "part int, at int, block int")), ["part", "at"])

    def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own, m in _blocks(batches, QUERY_ROWS, dims):
            floor = np.full(len(ids), np.iinfo(np.int64).min)
            if len(seed_rows) > k:
                scores = np.where(own[:, None] == seed_rows[None, :], np.iinfo(np.int64).min, inner(m, seed))
                floor = np.partition(scores, -k, axis=1)[:, -k]
            # blocks whose longest vector times the query's length can reach the threshold: a prefix
            needed = (floor.astype(float) - 1e-6) / (np.maximum(lengths(m), 1e-300) * (1 + 1e-6) + 1e-6)
            reach = np.searchsorted(descending, -needed, side="right")
            made = {"upto": pa.array([int(reach.max())], pa.int32()), "qids": [ids.tobytes()], "qown": [own.tobytes()], "q": [m.astype(kept).tobytes()], "floor": [floor.tobytes()]}
            yield pa.RecordBatch.from_pydict(made)

    asked = rows.filter("asks").select("id", "row", "v").mapInArrow(query_blocks, "upto int, qids binary, qown binary, q binary, floor binary")
    meets = asked.filter("upto > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("upto") - 1))).join(numbered, "block").select("qids", "qown", "floor", "ids", "own", "q", "m")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qids, qown, floor, ids, own = (np.frombuffer(batch.column(c)[r].as_py(), dtype=np.int64) for c in range(5))
                q, m = (np.frombuffer(batch.column(c)[r].as_py(), dtype=kept).reshape(-1, dims).astype(np.int64) for c in (5, 6))
                q_turned, m_turned = q @ turn, m @ turn
                q_rest, m_rest = lengths(q_turned[:, lead:]), lengths(m_turned[:, lead:])
                bound = q_turned[:, :lead] @ m_turned[:, :lead].T + np.outer(q_rest, m_rest)
                slack = 1e-6 * (1 + np.outer(lengths(q), lengths(m)))
                allowed = (bound + slack >= floor[:, None]) & (qown[:, None] != own[None, :])
                cols = np.flatnonzero(allowed.any(axis=0))
                if not len(cols):
                    continue
                allowed, scores = allowed[:, cols], inner(q, m[cols])
                allowed &= scores >= floor[:, None]
                out = [(np.full(len(at), qids[i]), np.full(len(at), qown[i]), ids[cols[at]], own[cols[at]], scores[i, at]) for i, at in best(scores, ids[cols], own[cols], allowed, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "query_row", "vec_id", "row", "score"])

    scored = meets.mapInArrow(score, "query_id long, query_row long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
