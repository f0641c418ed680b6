"""Quality scores from compression with dictionaries of good and of bad labelled text.

Training, on a bounded sample of the labelled rows (``SAMPLE_ROWS`` a class in a seeded hash order,
and of those, texts of up to ``SAMPLE_TEXT_BYTES`` first, as many as fit ``SAMPLE_BYTES``, but one at
least): three of four sample rows build one zstandard
dictionary per class, the fourth calibrates. Lines that both classes hold say nothing about either
and build no dictionary. A text is compressed in blocks of ``BLOCK`` bytes with both dictionaries;

    x = (size with bad dictionary - size with good dictionary) / bytes

A logistic curve fitted to the calibration rows, at the class shares of all usable labels, turns x
into the score. Only the text is an input of a score; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuspark.storage import materialize

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 24 << 20
#: Longer texts build a model only where a class has no others.
SAMPLE_TEXT_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
BLOCK = 256
LEVEL = 3
SEED = 29
#: Rows of whole texts that one Arrow batch holds.
ROWS_AT_ONCE = 1024
FOLDS = 5
THRESHOLD = 0.3


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text. Rows of
    fold 0 are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: use the text itself
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **options)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), **options)


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    centre: float
    spread: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def difference(self, text: bytes | None) -> float:
        """The normalised size difference of a whole text; 0 for an empty one."""
        if not text:
            return 0.0
        if not hasattr(self, "_pair"):
            self._pair = _compressor(self.good), _compressor(self.bad)
        good, bad = self._pair
        total = 0
        for at in range(0, len(text), BLOCK):
            piece = text[at : at + BLOCK]
            total += len(bad.compress(piece)) - len(good.compress(piece))
        return total / len(text)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.clip((np.asarray(x, dtype=float) - self.centre) / self.spread, -3, 3) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return self.calibrated(np.array([self.difference(t) for t in texts]))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + ridge * a, (w * (p - y)).sum() + ridge * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(good: list[bytes], bad: list[bytes], good_share: float) -> Model:
    """A model from sample texts in a random order. Without both classes the score is the class share."""
    good, bad = list(dict.fromkeys(t for t in good if t)), list(dict.fromkeys(t for t in bad if t))
    share = min(max(good_share, 1e-3), 1 - 1e-3)
    offset = float(np.log(share / (1 - share)))
    if not good or not bad:
        return Model(b"", b"", 0.0, offset, 0.0, 1.0)
    build = [[t for i, t in enumerate(texts) if i % 4 or len(texts) < 4] for texts in (good, bad)]
    lines = [{line for t in texts for line in t.split(b"\n")} for texts in build]
    shared = lines[0] & lines[1]
    kept = [[t for t in (b"\n".join(x for x in t.split(b"\n") if x not in shared) for t in texts) if t] for texts in build]
    model = Model(_dictionary(kept[0] or build[0], DICTIONARY_BYTES), _dictionary(kept[1] or build[1], DICTIONARY_BYTES), 0.0, offset, 0.0, 1.0)
    held = [texts[::4] for texts in (good, bad)]
    x = np.array([model.difference(t) for texts in held for t in texts])
    y = np.concatenate([np.ones(len(held[0])), np.zeros(len(held[1]))])
    model.centre, model.spread = float(np.median(x)), float(np.subtract(*np.percentile(x, [90, 10]))) / 2 or 1.0
    weight = np.where(y == 1, share / len(held[0]), (1 - share) / len(held[1])) * len(y)
    z = np.clip((x - model.centre) / model.spread, -3, 3)
    model.slope, model.offset = _logistic(z, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows that are not held out. Null labels, labels other than 0 and 1 and ids with
    contradicting labels are not used; nor are null or empty texts. Rows that repeat a labelled id all
    belong to the sample; equal texts count once. Without a text of either class, or in an empty table,
    the score is the share of good labels."""
    usable = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull() & (fold(label_id_col) != 0))
        .groupBy(F.col(label_id_col).cast("long").alias("label_id"))
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
        .filter("label = other")
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return fit([], [], 0.5)
    turn = F.xxhash64(F.lit(SEED), "label_id")
    picks = [usable.filter(F.col("label") == k).orderBy(turn, "label_id").limit(sample_rows).select("label_id", "label") for k in (0, 1)]
    picked = picks[0].unionByName(picks[1])
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("binary").alias("text")).filter(F.octet_length("text") > 0)
    sample = materialize(texts.join(F.broadcast(picked), "label_id").select("label_id", "label", turn.alias("turn"), F.xxhash64("text").alias("tie"), "text"), "quality-sample", rows=2 * sample_rows, per_file=1000)
    long = F.octet_length("text") > min(SAMPLE_TEXT_BYTES, sample_bytes)
    order = Window.partitionBy("label").orderBy(long, F.when(long, F.octet_length("text")), "turn", "label_id", "tie")
    sums = sample.withColumn("place", F.row_number().over(order)).withColumn("running", F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bounded = sums.filter((F.col("running") <= sample_bytes) | (F.col("place") == 1))
    rows = [(r["label"], bytes(r["text"])) for r in sorted(bounded.collect(), key=lambda r: (r["turn"], r["label_id"], r["tie"]))]
    return fit([t for k, t in rows if k == 1], [t for k, t in rows if k == 0], counts.get(1, 0) / total)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for every row, null and empty texts included.

    The model (two dictionaries of fixed size) travels with the function. Rows stay where they are.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()))

    return docs.withColumn(out_col, run(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def scores(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``score`` of every row, written once: a narrow table made in small batches."""
    scored = score(docs.select(*keys, text_col), model, text_col, "score")
    return materialize(scored.select(*keys, "score"), "quality-scores", ROWS_AT_ONCE, docs.count())
