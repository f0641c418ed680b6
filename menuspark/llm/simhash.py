"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

Method
------
1. Each text becomes one 64-bit fingerprint (Python, one pass, no shuffle).
2. Equal fingerprints collapse, so a group of exact copies costs one row from here on.
3. A fingerprint is cut into ``max_bits + 2`` = 4 blocks of 16 bits. Two fingerprints that differ in
   at most two bits agree in at least two whole blocks, so they meet in at least one of the six
   (block, block) tables, whose keys have 32 bits.
4. Each bucket is verified by Hamming distance. A bucket yields a spanning forest of its true links
   (at most one link less than members) and never all pairs.
5. A bucket of more than ``bucket_cap`` fingerprints is handled exactly in another way: two
   fingerprints differ in at most two bits exactly when some key differs from each in at most one,
   so each member is filed under itself and its 64 one-bit neighbours. Such a group has at most 65
   members by construction, whatever the corpus holds.
6. Components by alternating large-star and small-star rounds over the links, each round written to
   the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menuspark.storage import materialize, release, sized

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
BUCKET_CAP = 256
#: Rows of whole texts that one Arrow batch holds.
ROWS_AT_ONCE = 1024
#: Shingles whose bits are unpacked at once: 64 bytes each.
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text.

    A-Z are lower-cased, words are runs of bytes other than space and \\t..\\r, a shingle is ``words``
    words joined by one space. Fewer words make one shingle of all; none (or null) gives zero. A bit
    is set if it is set in over half of the shingles' hashes, repeats included.
    """
    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, row, fp): a signed 64-bit ``fp`` for every row of ``docs``, nulls and repeats included."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "row", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, row long, fp long")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps`` (sorted, distinct, uint64)."""
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.bitwise_count(fps[left][:, None] ^ fps[frontier][None, :]) <= max_bits
            hit = near.any(axis=1)
            links += zip(left[hit].tolist(), frontier[near[hit].argmax(axis=1)].tolist(), strict=True)
            frontier, left = left[hit], left[~hit]
    return links


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b): links between distinct ``fp`` values whose components equal those of all links."""
    if max_bits != 2:
        raise ValueError("the block layout is built for a distance of two bits")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (F.shiftleft(block[i], 16) + block[j]).alias("key")) for t, (i, j) in enumerate(combinations(range(4), 2))])).alias("k"),
    ).select("fp", "k.t", "k.key")
    buckets = keys.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = buckets.filter((F.col("n") == 2) & close).select("a", "b")

    members = materialize(keys.join(buckets.filter("n > 2").select("t", "key", "n"), ["t", "key"]).select("t", "key", "n", "fp"), "simhash-members")
    lists = members.filter(F.col("n") <= bucket_cap).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for fps_of in batch.column(0):
                own = np.sort(np.array(fps_of.as_py(), dtype=np.int64))
                links = _forest(own.view(np.uint64), max_bits)
                if links:
                    out.append(own[np.array(links)])
            both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    verified = lists.mapInArrow(run, "a long, b long")

    crowded = members.filter(F.col("n") > bucket_cap).select("fp").distinct()
    neighbours = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
    stars = (
        crowded.select("fp", F.explode(neighbours).alias("mid"))
        .groupBy("mid")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
        .filter("a <> b")
        .select("a", "b")
    )
    return pairs.unionByName(verified).unionByName(stars).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node of its component.

    Alternates large-star and small-star until the links no longer change. Minima are taken with
    map-side combining, so a hub's links are never gathered in one task. ``rows``: about how many links
    there are.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", rows=rows)
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = edges.select(mark).first()[0]
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, edges = edges, materialize(small.filter("u <> v").distinct(), "cc", rows=before[0])
        after = edges.select(mark).first()[0]
        release(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def joined_components(roots: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) over ``links`` and the links that ``roots`` (node, root) came from. The rounds go through
    ``links`` alone, between the roots of their ends."""
    for end in "ab":
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("own")), end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    joined = connected_components(links.select("a", "b"), rows=rows)
    count = joined.count()
    if not count:
        return roots
    moved = sized(joined.select(F.col("node").alias("root"), F.col("root").alias("lesser")), count, 64)
    all_ = roots.join(moved, "root", "left").select("node", F.coalesce("lesser", "root").alias("root"))
    return materialize(all_.unionByName(joined.join(roots, "node", "left_anti")), "cc-joined", rows=rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = SHINGLE_WORDS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(id, row, fp, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most two differing bits. Of each
    component one row is ``kept``: that with the smallest id (null ids last), and of rows repeated
    with that id one. Null and blank texts have fingerprint zero and link like any other; an empty
    table gives an empty result.
    """
    count = docs.count()
    rows = materialize(fingerprints(docs, id_col, text_col, row_col, words), "simhash-rows", ROWS_AT_ONCE, count)
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-fps", rows=count, per_file=200_000)
    roots = connected_components(near_links(distinct.select("fp"), bucket_cap=bucket_cap), rows=count)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("winner"))
    labels = rooted.join(winners, "root").select("fp", F.col("winner.id").alias("component_id"), F.col("winner.row").alias("kept_row"))
    return rows.join(labels, "fp").select("id", "row", "fp", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
