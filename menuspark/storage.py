"""Reading input tables and writing intermediate ones.

Everything goes through Spark's readers and writers, so a table may live in any store that Spark
can open. Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which driver and
executors share; they cut lineage, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many bytes (rows x row width, both measured) may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Narrow rows to a written file.
FILE_ROWS = 200_000
#: Bytes of an Arrow batch of whole texts; one longer text is a batch of its own.
BATCH_BYTES = 8 << 20

_own_root: str | None = None
#: Paths written inside each open ``scratch``, innermost last.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder. Where ``spark.checkpoint.dir`` is unset, a session on one machine gets
    a temporary folder; on a cluster that would be a folder that executors do not share, so it raises."""
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="menuspark-")
    return _own_root


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of ``path``, for renames and deletes in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/menuspark/{tag}-{uuid.uuid4().hex}"
    fs, jpath = hadoop_path(spark, path)
    fs.deleteOnExit(jpath)
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, tag: str, batch_rows: int | None = None, rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, short lineage. ``batch_rows``
    bounds the Arrow batches of Python functions in ``df``, for rows that hold whole texts. ``rows``, about
    how many narrow rows ``df`` has, deals them over files of ``per_file`` rows each, since a scan of many
    partitions would leave a tiny file for each."""
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(1, -(-rows // per_file)))
    path = scratch_path(spark, tag)
    with arrow_batches(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._menuspark_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing reads them any more."""
    for df in tables:
        path = df.__dict__.get("_menuspark_path")
        if path:
            fs, jpath = hadoop_path(df.sparkSession, path)
            fs.delete(jpath, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Hold Arrow batches to ``rows`` rows, and to ``BATCH_BYTES``, for what runs inside."""
    wanted = {} if rows is None else {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were written inside, at the end. Keep what outlives it with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            fs, jpath = hadoop_path(spark, path)
            fs.delete(jpath, True)


def keep(df: DataFrame) -> DataFrame:
    """Hand a written table on to the surrounding ``scratch``, if there is one."""
    path = df.__dict__.get("_menuspark_path")
    if _open and path in _open[-1]:
        _open[-1].remove(path)
        if len(_open) > 1:
            _open[-2].append(path)
    return df


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size is small; else leave the join to shuffle.
    ``row_bytes`` is what a row takes in a hash table, not in a file."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
