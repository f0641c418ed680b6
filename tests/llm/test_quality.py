from __future__ import annotations

import random

import numpy as np

from menuspark.llm import quality


def texts(kind, n, seed):
    rng = random.Random(seed)
    words = ["harbour", "supper", "kitchen", "the", "of", "window", "bread", "evening", "slowly", "served"]
    return [" ".join(rng.choice(words) if kind else rng.choice(words).upper() + "!!" for _ in range(rng.randrange(20, 200))) for _ in range(n)]


def test_held_out_accuracy_and_range():
    model = quality.fit([t.encode() for t in texts(1, 200, 1)], [t.encode() for t in texts(0, 200, 2)], 0.6)
    good, bad = model.scores([t.encode() for t in texts(1, 100, 3)]), model.scores([t.encode() for t in texts(0, 100, 4)])
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.97
    odd = model.scores([b"", None, b"x", "é".encode() * 100_000])
    assert ((odd >= 0) & (odd <= 1)).all()


def test_missing_classes_give_the_share():
    assert quality.fit([], [], 0.5).scores([b"a", None]).tolist() == [0.5, 0.5]
    assert np.allclose(quality.fit([b"abc"], [], 0.9).scores([b"a"]), 0.9)


def test_training_ignores_held_out_and_unusable_labels(spark, frame):
    rows = [(i, t, "s") for i, t in enumerate([*texts(1, 120, 5), *texts(0, 120, 6)])] + [(900, None, None), (901, "", "s")]
    docs = frame(rows)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (5, 0, 0), (900, 1, 0), (7, None, 1), (8, 9, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    held = docs.filter(quality.fold("doc_id") == 0).select("doc_id").collect()
    flipped = labels.withColumn("quality", (quality.fold("doc_id") == 0).cast("int") * (1 - labels.quality) + (quality.fold("doc_id") != 0).cast("int") * labels.quality)
    assert len(held) > 20 and quality.train(docs, flipped) == model
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    right = [(r.score >= 0.3) == (r.doc_id < 120) for r in scored if r.doc_id < 240]
    assert np.mean(right) > 0.95
    assert quality.score(frame([]), quality.train(frame([]), labels.limit(0))).count() == 0


def test_a_text_beyond_the_byte_bound_does_not_empty_its_class(spark):
    good, bad = texts(1, 60, 21), texts(0, 60, 22)
    rows = [(i, t, i < 60) for i, t in enumerate([*good, *bad])]
    longest = max(len(t.encode()) for _, t, _ in rows)
    huge = [(200 + i, (good[i] + " ") * 400, True) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + huge], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in rows + huge], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_bytes=30 * longest)
    assert model.slope > 0 and model.good and model.bad
    only = docs.filter("doc_id >= 60")  # all good texts are too long: the shortest of them stands for the class
    model = quality.train(only, labels.filter("doc_id >= 60"), sample_bytes=longest)
    assert model.good and model.bad
