from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from menuspark.llm import topk


def brute(rows, k):
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for other, (c, b) in enumerate(fine) if other != at)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, norm int, row string")
    return sorted(tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(20)) == 0, k=k).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, rng.choice([0.05, 0.2, 2.0]), 24)]) for i in range(500)]
    rows += [(500 + i, rows[40][1]) for i in range(60)]  # ties
    for k in (1, 20):
        assert run(spark, rows, k) == brute(rows, k)


def test_fewer_candidates_odd_vectors_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5]), (3, None), (4, [1.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 0.0]), (7, []), (8, [-1e-9, 0.0]), (9, [300000.0, -200000.0]), (None, [1.0, 1.0])]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [], 20) == []
    assert run(spark, [(1, None)], 20) == []


def test_repeated_ids_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "SEED_ROWS", 30)
    rng = np.random.default_rng(4)
    rows = [(7, [3.0] * 8)] * 50 + [(100 + i, [float(x) for x in rng.normal(2.9, 0.1, 8)]) for i in range(40)]
    rows += [(120, [float(x) for x in rng.normal(2.9, 0.1, 8)]) for _ in range(3)] + [(140, [3.0] * 8)] * 2
    for k in (5, 60, 200):
        assert run(spark, rows, k) == brute(rows, k)


def test_narrow_integers():
    assert [topk.narrowest(x).itemsize for x in (0, 127, 128, 2**15, 2.0**31, 2.0**80)] == [1, 1, 2, 4, 8, 8]
