"""Line-by-line scans of texts as windows over (document, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) of the non-blank lines, positions counted over all lines."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line")).filter(F.trim("line") != "")


def section_state(lines: DataFrame, id_col: str, label: Column, start: str = "unknown") -> DataFrame:
    """Each line with the label of the nearest labelled line at or before it: a running state."""
    run = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(label, ignorenulls=True).over(run), F.lit(start)))


def nearest_before(lines: DataFrame, id_col: str, value: Column, within: int, into: str) -> DataFrame:
    """Each line with the nearest non-null ``value`` among the ``within`` lines before it."""
    back = Window.partitionBy(id_col).orderBy("pos").rowsBetween(-within, -1)
    return lines.withColumn(into, F.last(value, ignorenulls=True).over(back))
