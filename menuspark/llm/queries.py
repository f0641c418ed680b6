"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuspark.llm import bpe, exact_dedup, html_extract, mixing, quality, rollups, sharding, simhash, topk, warc
from menuspark.storage import materialize, scratch_path, table

#: Rows of whole texts that one Arrow batch holds.
ROWS_AT_ONCE = 1024


def word_vocabulary() -> str:
    """The installed word-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text and that text's length."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its shard of 16 and its slot there. The law is ``bytes``."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the group's surviving doc_id, its size, and the digest of its text."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its source's target and the words that the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, as read back from the archives written of all pages."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its score and prediction; trained on rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.scores(docs, model, ["doc_id"])
    return scored.select("doc_id", (quality.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches, one of them replayed.

    Every document joins with its bytes as ``bytes-1`` and with a provisional count (its ``n_chars``)
    as ``words-1``; then each provisional count is revised to the number of words; then documents that
    ``labels`` marks as toxic leave both rollups.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        F.coalesce("n_chars", F.lit(0)).cast("long").alias("provisional"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("words"),
    )
    taken_down = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    words, size = docs.withColumn("tokenizer", F.lit("words-1")), docs.withColumn("tokenizer", F.lit("bytes-1"))
    store = rollups.RollupStore(spark, scratch_path(spark, "rollups"))
    revised = rollups.revisions(words, "provisional", "words")
    gone = docs.join(taken_down, "doc_id", "left_semi").select("source", "lang", F.explode(F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit("bytes-1").alias("tokenizer"), F.col("bytes").alias("tokens")))).alias("c"))
    store.commit("inserts-words", rollups.inserts(words.withColumnRenamed("provisional", "tokens")))
    store.commit("inserts-bytes", rollups.inserts(size.withColumnRenamed("bytes", "tokens")))
    store.commit("revisions", revised)
    store.commit("revisions", revised)
    store.commit("take-downs", rollups.deletes(gone.select("source", "lang", "c.tokenizer", "c.tokens")))
    return store.totals()


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: token count and digests of its ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents")
    coded = bpe.round_trip(docs, word_vocabulary())
    digests = coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return materialize(digests, "bpe-digests", ROWS_AT_ONCE, docs.count())


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id it is linked to, however far."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_html_extraction,
        op2_sharding,
        op3_exact_dedup,
        op4_mixing,
        op5_warc,
        op6_quality_classifier,
        op7_token_rollups,
        op8_exact_top_k,
        op9_bpe_encoding,
        op10_simhash_near_dedup,
    )
    return {f.__name__: f for f in named}
