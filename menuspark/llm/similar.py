"""SimHash near-duplicates at a shingle similarity: wide fingerprints, blocks, Hamming and exact checks.

``simhash.py`` links fingerprints of 64 bits at a distance of two. Texts whose five-word shingles are
0.8 alike differ in about 15 bits of 100, which so short a fingerprint cannot tell from chance. This
module runs the same method with longer fingerprints:

1. Each text becomes the set of its shingles, and that set one fingerprint of ``BLOCKS`` blocks of
   ``BLOCK_BITS`` bits (Python, one pass, no shuffle). Equal sets collapse to one row from here on.
2. Fingerprints that share a block meet in its bucket. By the pigeonhole principle all pairs that
   differ in fewer than ``BLOCKS`` bits do; of other pairs, one of bit agreement p is missed with
   probability ``(1 - p ** BLOCK_BITS) ** BLOCKS``: 0.07 at a similarity of exactly 0.8, 0.01 at
   0.85 and 10 ** -5 at 0.9.
3. A bucket of two is a pair. In the larger buckets of the first ``CENTRE_BLOCKS`` places one random
   member is the centre of the others. All these pairs are compared by Hamming distance. Of the pairs that are near enough, the nearest of each fingerprint, then the nearest of
   each two components, are checked by the exact similarity of their sets. This is linear, and joins
   all but a few members of a large family.
4. Buckets that still hold several components are compared in full: pairs of different components
   within the Hamming distance are checked exactly. The members of a bucket's largest component are
   never compared with one another; they are cut into parts of at most ``bucket_cap``, and the other
   members, which are few, meet every part.
5. Components by the star rounds of ``simhash.connected_components`` over the first links. The links found
   later join them by rounds over themselves alone (``simhash.joined_components``).

A bucket of chance holds rows / 2 ** BLOCK_BITS fingerprints, which is 3 at ten million texts; for
far more texts take longer and more blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuspark.llm.simhash import HASH_SEED, connected_components, joined_components
from menuspark.storage import materialize, sized

SHINGLE_WORDS = 5
LEAST = 0.8
BLOCKS = 96
BLOCK_BITS = 22
#: Pairs that differ in more bits are not compared exactly. At a similarity of 0.8 the distance is 320
#: on average, with a deviation of 16.5 at most.
MOST_BITS = 361
#: Before that, pairs that differ in more than ROUGH_BITS of the first ROUGH_WORDS words are left out; at a
#: similarity of 0.8 that distance is 39 on average, with a deviation of 5.7.
ROUGH_WORDS = 4
ROUGH_BITS = 64
CENTRE_BLOCKS = 24
BUCKET_CAP = 4096
#: Rows of whole texts or sets that one Arrow batch holds.
ROWS_AT_ONCE = 256
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

_U = np.uint64
_TURN = _U(0x9E3779B97F4A7C15)
_WORDS = -(-BLOCKS * BLOCK_BITS // 64)
_SEEDS = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, _WORDS, dtype=np.uint64) << _U(1) | _U(1)
_PLACES = 1 << np.arange(BLOCK_BITS)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _TURN
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles.

    A-Z are lower-cased, words are runs of bytes other than space and \\t..\\r, a shingle is ``words``
    words in order. Fewer words make one shingle of all; a text without words has none.
    """
    text, at, parts = text or b"", 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        own = text[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))
        at = end
    hashed = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(hashed):
        return hashed
    words = min(words, len(hashed))
    total = len(hashed) - words + 1
    out = np.zeros(total, np.uint64)
    for k in range(words):
        out = _mixed(out + hashed[k : k + total])
    return np.unique(out)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The bits of a set of hashes, one byte each: 1 where over half of the hashes have a 1."""
    total = np.zeros(64 * _WORDS, np.int64)
    for at in range(0, len(own), 255):  # sums of 255 bits fit into a byte
        each = _mixed(own[at : at + 255, None] * _SEEDS)
        total += np.add.reduce(np.unpackbits(each.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * total > len(own)).astype(np.uint8)


def block_keys(bits: np.ndarray) -> np.ndarray:
    """The keys of a fingerprint's blocks; blocks of different places never share a key."""
    return bits[: BLOCKS * BLOCK_BITS].reshape(BLOCKS, BLOCK_BITS) @ _PLACES + (np.arange(BLOCKS) << BLOCK_BITS)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _key(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED)).astype(np.int64))


def _listed(flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.reshape(-1)))


def _keyed(slim: DataFrame, words: int) -> DataFrame:
    """(id, row, key, blocks, rough, bits) for every row of ``slim`` (id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole = batch.num_rows, []
            keys, found, rough = np.zeros(n, np.int64), np.zeros((n, BLOCKS), np.int32), np.zeros((n, ROUGH_WORDS), np.int64)
            for i, t in enumerate(batch.column(2)):
                own = shingles(t.as_py(), words)
                bits = fingerprint(own)
                packed = np.packbits(bits)
                keys[i], found[i], rough[i] = _key(own), block_keys(bits), packed[: 8 * ROUGH_WORDS].view(np.int64)
                whole.append(packed.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), _listed(found), _listed(rough), pa.array(whole, pa.binary())], names=["id", "row", "key", "blocks", "rough", "bits"])

    return slim.mapInArrow(run, "id long, row long, key long, blocks array<int>, rough array<long>, bits binary")


def _sets(slim: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the texts in the rows of ``wanted`` (row, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), words) for t in batch.column(1)]
            if [_key(s) for s in own] != batch.column(0).to_pylist():
                raise RuntimeError("row numbers changed between two readings of the documents")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in own], pa.binary())], names=["key", "shingles"])

    return slim.join(sized(wanted, wanted.count(), 64), "row").select("key", "text").mapInArrow(run, "key long, shingles binary")


def _distance(a: str, b: str) -> Column:
    """Differing bits of two lists of words."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, ROUGH_WORDS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _verified(found: DataFrame, heads: DataFrame, slim: DataFrame, words: int, least: float, rows: int) -> DataFrame:
    """The pairs (a, b) of ``found`` whose sets are similar; only the texts that they name are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([jaccard(p, q) >= least for p, q in zip(x, y, strict=True)], pa.bool_()))

    pairs = materialize(found, "similar-pairs", ROWS_AT_ONCE, rows)
    if pairs.isEmpty():
        return pairs
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = materialize(heads.join(named, "key").select("row", "key"), "similar-wanted", rows=rows)
    sets = materialize(_sets(slim, wanted, words), "similar-sets", ROWS_AT_ONCE, wanted.count(), 10_000)
    size = sets.agg(F.count("*"), F.coalesce(F.avg(F.length("shingles")), F.lit(0.0))).first()
    sets = sized(sets, size[0], 4 * int(size[1]) + 64)  # a hash table of long values takes several times their size
    a, b = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "similar-links", ROWS_AT_ONCE, rows)


def _fingerprints(column: pa.Array) -> np.ndarray:
    """Packed fingerprints as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), _WORDS)


def _near(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b, bits): the pairs (a, b) within the Hamming distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.bitwise_count(_fingerprints(batch.column(2)) ^ _fingerprints(batch.column(3))).sum(axis=1).astype(np.int32)
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], names=["a", "b", "bits"])
            yield whole.filter(pa.array(bits <= MOST_BITS))

    def with_both(df: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            df = df.join(heads.select(F.col("key").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return df

    rough = with_both(pairs, "rough").filter(_distance("rough_a", "rough_b") <= ROUGH_BITS).select("a", "b")
    return with_both(rough, "bits").select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, bits int")


def _met(members: DataFrame, heads: DataFrame, bucket_cap: int, rows: int) -> DataFrame:
    """(a, b): pairs within a bucket of ``members`` (block, key, root) that lie within the Hamming distance
    and belong to different components. Buckets of one component go before the fingerprints join."""
    counts = members.groupBy("block", "root").agg(F.count("*").alias("n")).groupBy("block").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    # parts of the members of the largest component, and of the others
    parts = counts.select("block", F.col("top.root").alias("most"), F.ceil(F.col("top.n") / bucket_cap).cast("int").alias("majors"), F.ceil((F.col("n") - F.col("top.n")) / bucket_cap).cast("int").alias("minors")).filter("minors > 0")
    open_ = members.join(materialize(parts, "similar-parts", rows=rows), "block")
    placed = open_.join(heads.select("key", "bits"), "key").withColumn("minor", F.col("root") != F.col("most"))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")

    def every(count: str, at: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), at)

    across = every("majors", lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("own").alias("j")))
    among = every("minors", lambda j: F.struct(F.lit(1).alias("kind"), F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    majors = every("minors", lambda j: F.struct(F.lit(0).alias("kind"), F.col("own").alias("i"), j.alias("j")))
    filed = placed.withColumn("own", own).select("block", F.explode(F.when(F.col("minor"), F.concat(across, among)).otherwise(majors)).alias("at"), F.struct("key", "root", "minor", "bits").alias("m"))
    lists = filed.groupBy("block", "at").agg(F.collect_list("m").alias("ms")).filter(F.size("ms") > 1).select(F.col("at.kind").alias("kind"), "ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 2), np.int64)]
            for kind, ms in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = ms.values
                keys, roots, bits = own.field("key").to_numpy(), own.field("root").to_numpy(), _fingerprints(own.field("bits"))
                minor = own.field("minor").to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(minor):
                    others = ~minor if kind == 0 else np.arange(len(keys)) > i
                    at = np.flatnonzero(others & (roots != roots[i]))
                    at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= MOST_BITS]
                    if len(at):
                        out.append(np.stack([np.maximum(keys[at], keys[i]), np.minimum(keys[at], keys[i])], axis=1))
            both = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def similar_components(distinct: DataFrame, slim: DataFrame, words: int = SHINGLE_WORDS, least: float = LEAST, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(node, root) for the keys of ``distinct`` (row, key, blocks, rough, bits) that have a link: the
    components of all similar pairs that share a block."""
    rows = distinct.count()
    filed = distinct.filter(F.col("key") != _key(np.zeros(0, np.uint64))).select("key", F.explode("blocks").alias("block"))
    heads = distinct.select("row", "key", "rough", "bits")
    # the keys are hashes, so the least of key XOR a hash of the block names a random member
    turned, turn = F.col("key").bitwiseXOR(F.xxhash64("block")), F.xxhash64("block")
    buckets = filed.groupBy("block").agg(F.count("*").alias("n"), F.min(turned).alias("least"), F.max(turned).alias("most")).filter("n > 1")
    buckets = materialize(buckets.select("block", "n", F.col("least").bitwiseXOR(turn).alias("centre"), F.col("most").bitwiseXOR(turn).alias("other")), "similar-buckets", rows=rows)
    larger = buckets.filter("n > 2")
    members = materialize(filed.join(larger, "block", "left_semi"), "similar-members", rows=rows)
    first = members.filter(F.shiftright("block", BLOCK_BITS) < CENTRE_BLOCKS)
    around = first.join(larger.select("block", "centre"), "block").filter("key <> centre").select("key", "centre")
    met = buckets.filter("n = 2").select("centre", "other").union(around).select(F.greatest("centre", "other").alias("a"), F.least("centre", "other").alias("b")).distinct()
    near = materialize(_near(met, heads), "similar-near", 16 * ROWS_AT_ONCE, rows)

    def apart(roots: DataFrame) -> DataFrame:
        """The near pairs between different components."""
        both = near.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
        both = both.withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b"))
        return both.filter("root_a <> root_b")

    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.struct("bits", "a", "b").alias("p")), F.struct(F.col("b").alias("key"), F.struct("bits", "a", "b").alias("p")))).alias("e"))
    nearest = ends.groupBy("e.key").agg(F.min("e.p").alias("p")).select("p.a", "p.b").distinct()
    roots = materialize(connected_components(_verified(nearest, heads, slim, words, least, rows), rows=rows), "similar-roots", rows=rows)
    between = apart(roots).groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.min(F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b")
    roots = joined_components(roots, _verified(between, heads, slim, words, least, rows), rows)

    labelled = materialize(members.join(roots.toDF("key", "root"), "key", "left").select("block", "key", F.coalesce("root", "key").alias("root")), "similar-labelled", rows=rows)
    rest = _met(labelled, heads, bucket_cap, rows).unionByName(apart(roots).select("a", "b")).distinct()  # and the pairs of buckets of two
    return joined_components(roots, _verified(rest, heads, slim, words, least, rows), rows)


def similar_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = SHINGLE_WORDS, least: float = LEAST, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(id, row, key, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over pairs that share a block and whose shingle sets
    have a Jaccard similarity of at least ``least``. Of each component one row is ``kept``: that with
    the smallest id (null ids last), and of rows repeated with that id one. Null and blank texts are
    equal to one another; an empty table gives an empty result. Only the named columns are read, so
    others may have any name. ``row_col``, if given, must hold the same numbers in every reading.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    slim = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("binary").alias("text"))
    count = docs.count()
    rows = materialize(_keyed(slim, words), "similar-rows", ROWS_AT_ONCE, count, 50_000)
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    winners = materialize(rows.groupBy("key").agg(F.min(first).alias("first")), "similar-keys", rows=count)
    distinct = materialize(rows.join(winners.select("key", F.col("first.row").alias("row")), ["key", "row"], "left_semi").select("row", "key", "blocks", "rough", "bits"), "similar-distinct", rows=count, per_file=20_000)
    roots = similar_components(distinct, slim, words, least, bucket_cap)
    rooted = winners.join(roots, winners["key"] == roots["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("winner"))
    labels = rooted.join(best, "root").select("key", F.col("winner.id").alias("component_id"), F.col("winner.row").alias("kept_row"))
    return rows.select("id", "row", "key").join(labels, "key").select("id", "row", "key", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
