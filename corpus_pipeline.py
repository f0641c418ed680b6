"""Corpus pipeline: five stages, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, whatever
those are, with the rows that the stage keeps; the last returns the encoded corpus. Rows are told
apart by their position in the table just read, so null and repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuspark.llm import bpe, exact_dedup, mixing, quality, queries, similar
from menuspark.storage import keep, materialize, release, scratch, sized, table

ROW = "__menuspark_row"
#: Rows of whole texts that one Arrow batch holds.
ROWS_AT_ONCE = 1024


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(docs: DataFrame, dropped: DataFrame, tag: str) -> DataFrame:
    """``docs`` (numbered) without the rows named by ``dropped``, in the columns that docs had. The
    dropped rows are broadcast only if their measured number is small."""
    dropped = materialize(dropped.select(F.col("row").alias(ROW)), tag, rows=docs.count())
    return docs.join(sized(dropped, dropped.count(), 64), ROW, "left_anti").drop(ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the compression classifier accepts. Null and empty texts are scored like any other."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = _numbered(docs)
    scored = quality.scores(rows, model, [ROW])
    return _without(rows, scored.filter(F.col("score") < quality.THRESHOLD).select(F.col(ROW).alias("row")), "pipeline-rejected")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case) keep the row with the largest id."""
    rows = _numbered(docs)
    found = exact_dedup.exact_duplicates(rows, row_col=ROW)
    return _without(rows, found.filter(~F.col("kept")), "pipeline-exact")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are at least 0.8 alike keep the row with the
    smallest id."""
    rows = _numbered(docs)
    found = similar.similar_duplicates(rows, row_col=ROW)
    return _without(rows, found.filter(~F.col("kept")), "pipeline-near")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row that the mix takes several times appears that many times, one that it does
    not take is gone."""
    rows = _numbered(docs)
    mixed = mixing.mix(rows, row_col=ROW).filter("taken > 0")
    taken = materialize(mixed.select(F.col("row").alias(ROW), F.expr("cast(taken div size as int)").alias("__menuspark_times")), "pipeline-mix", rows=docs.count())
    joined = rows.join(sized(taken, taken.count(), 64), ROW)
    return joined.withColumn("__menuspark_copy", F.explode(F.sequence(F.lit(1), F.col("__menuspark_times")))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids, with the number of tokens and the digest of what the ids decode to."""
    coded = bpe.round_trip(docs, queries.word_vocabulary())
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: The classifier, the fingerprints and the encoder are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's output is written and reread; what it wrote on the way,
    and its input, go before the next one begins."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        if at == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):
            done = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}", ROWS_AT_ONCE))
        release(docs)
        docs = done
