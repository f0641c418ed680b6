"""Token-count rollups maintained from signed deltas, with idempotent batch commits.

A delta row says that a document's count joined (+1) or left (-1) a rollup cell. A revised count is
both: the old one leaves, the new one joins. A batch is reduced to one additive row per cell, written
beside the others under its batch id, and published by one rename. A batch id that is already
published is skipped, so replays and retries change nothing; totals are the sum over batches.

``compact`` folds published batches into a base: their sums and their ids, published by the same kind of
rename. Totals are the latest base and the batches that it does not name.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menuspark.storage import hadoop_path

CELL = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """``counts`` (source, lang, tokenizer, tokens) as rows that join; a null count is zero tokens."""
    return _signed(counts, F.col("tokens"), 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.col("tokens"), -1)


def revisions(counts: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose count changes from column ``old`` to ``new``; one pass, no join. Rows whose count
    stays give nothing."""
    changed = counts.filter(~F.col(old).eqNullSafe(F.col(new)))
    signs = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col(old).alias("tokens")), F.struct(F.lit(1).alias("sign"), F.col(new).alias("tokens"))))
    pairs = changed.select(*CELL, signs.alias("d"))
    return pairs.select(*CELL, F.col("d.sign").cast("long").alias("documents"), (F.col("d.sign") * F.coalesce("d.tokens", F.lit(0))).cast("long").alias("tokens"))


def _signed(counts: DataFrame, tokens: Column, sign: int) -> DataFrame:
    return counts.select(*CELL, F.lit(sign).cast("long").alias("documents"), (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("tokens"))


class RollupStore:
    """Additive totals by source, language and tokenizer version under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return hadoop_path(self.spark, f"{self.path}/{name}")

    def committed(self, batch_id: str) -> bool:
        fs, at = self._at(f"batches/{self._name(batch_id)}")
        return bool(fs.exists(at)) or batch_id in self._base()[1]

    def _names(self, folder: str) -> list[str]:
        fs, root = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []

    def _base(self) -> tuple[str | None, set[str]]:
        """The latest base's folder and the batch ids that it holds."""
        bases = self._names("bases")
        if not bases:
            return None, set()
        at = f"{self.path}/bases/{bases[-1]}"
        return at, {r["id"] for r in self.spark.read.schema("id string").parquet(f"{at}/ids").collect()}

    @staticmethod
    def _name(batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return batch_id

    def commit(self, batch_id: str, deltas: DataFrame, verify: bool = False) -> bool:
        """Apply a batch of signed rows once. False if the batch had been committed before.

        The reduced batch is written aside and renamed; the rename fails where the name exists, so of
        two writers of one batch id one wins. Repeated rows count each time. Cells with null source or
        language are cells like any other; columns beyond those of a delta are not read. A batch without
        rows is recorded as committed. With ``verify``, a batch that was committed before and is still
        apart must hold the same sums, or a ``ValueError`` tells that two batches share an id.
        """
        done = self.committed(batch_id)
        if done and not verify:
            return False
        cells = deltas.groupBy(*CELL).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        if done:
            if batch_id in self._names("batches"):
                stored = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/batches/{batch_id}")
                if not (cells.exceptAll(stored).isEmpty() and stored.exceptAll(cells).isEmpty()):
                    raise ValueError(f"batch {batch_id} was committed with other content")
            return False
        aside = f"{self.path}/aside/{self._name(batch_id)}-{uuid.uuid4().hex}"
        cells.write.parquet(aside)
        return self._publish(aside, f"batches/{batch_id}")

    def _publish(self, aside: str, name: str) -> bool:
        fs, source = hadoop_path(self.spark, aside)
        _, target = self._at(name)
        fs.mkdirs(target.getParent())
        try:
            self._rename_new(source, target)
        except Py4JJavaError as e:
            fs.delete(source, True)
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def compact(self) -> bool:
        """Fold the batches published so far into a new base and delete their folders. False if there was
        nothing to fold, or another writer made that base first."""
        names, (_, held) = self._names("batches"), self._base()
        fresh = sorted(set(names) - held)
        if not fresh:
            return False
        turn = len(self._names("bases"))
        aside = f"{self.path}/aside/base-{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{aside}/cells")
        self.spark.createDataFrame([(i,) for i in sorted(held | set(fresh))], "id string").coalesce(1).write.parquet(f"{aside}/ids")
        if not self._publish(aside, f"bases/{turn:08d}"):
            return False
        for name in names:
            fs, at = self._at(f"batches/{name}")
            fs.delete(at, True)
        return True

    def _rename_new(self, source, target) -> None:
        """Rename that fails if ``target`` exists (``FileSystem.rename`` would move into it)."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(source, target, options)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches; cells that nothing
        is left of do not appear."""
        base, held = self._base()
        paths = [f"{self.path}/batches/{n}" for n in self._names("batches") if n not in held] + ([f"{base}/cells"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        summed = self.spark.read.schema(_SCHEMA).parquet(*paths).groupBy(*CELL).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 OR tokens <> 0")
