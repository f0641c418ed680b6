from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from menuspark.llm import mixing


def brute_targets(sizes, weights, most=3):
    """Raise one level for all until the whole is shared out; found by bisection."""
    low, high = 0.0, 1.0 + most * max(sizes, default=0)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(w * mid, most * s) for s, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = mid
        else:
            high = mid
    return [min(w * high, most * s) for s, w in zip(sizes, weights, strict=True)]


def test_water_fill_shares_everything_and_caps(spark):
    rng = random.Random(7)
    for sizes in ([10, 1000, 1000, 5, 0], [0, 0], [7], [rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(300)]):
        sources = numbered_sources(spark, sizes)
        found = sorted((r["source"], r["target"]) for r in mixing.water_fill(sources).collect())
        want = brute_targets(sizes, [1 + i % 3 for i in range(len(sizes))])
        assert [t for _, t in found] == pytest.approx(want)
        assert sum(want) == pytest.approx(sum(sizes))


def numbered_sources(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:04}", n) for i, n in enumerate(sizes)], "source string, source_size long").repartition(5)
    out = mixing.numbered(rows)
    assert sorted((r["source"], r["number"]) for r in out.collect()) == [(f"s{i:04}", i) for i in range(len(sizes))]
    return out.withColumn("weight", out["number"] % 3 + 1.0)


def brute_nearest(sizes, counts, budget):
    sums = {sum(s * n for s, n in zip(sizes, take, strict=True)) for take in itertools.product(*(range(c + 1) for c in counts))}
    return min(abs(s - budget) for s in sums)


def test_fit_is_nearest():
    rng = random.Random(1)
    for _ in range(60):
        sizes = rng.sample(range(1, 40), rng.randrange(1, 5))
        counts = [rng.randrange(0, 4) for _ in sizes]
        budget = rng.randrange(0, 120)
        take = mixing.fit(np.array(sizes), np.array(counts), budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * sizes).sum()) - budget) == brute_nearest(sizes, counts, budget)


def test_fit_of_a_wide_budget_ends_exactly():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 3000, 500))
    counts = rng.integers(1, 500, len(sizes))
    for part in (0.1, 0.5, 0.93):
        budget = int((sizes * counts).sum() * part)
        take = mixing.fit(sizes, counts, budget, width=8192)
        assert ((take >= 0) & (take <= counts)).all() and int((take * sizes).sum()) == budget


def test_fit_at_the_edge_of_the_width():
    for sizes, counts, budget in (([6, 90_000], [3, 400], 13_320_006), ([90_000], [400], 130_000), ([90_000], [400], 140_000), ([70_000, 80_001, 3], [5, 5, 9], 230_004), ([1, 10**6], [10, 7], 3_000_004)):
        take = mixing.fit(np.array(sizes), np.array(counts), budget)
        want = min(abs(sum(s * n for s, n in zip(sizes, t, strict=True)) - budget) for t in itertools.product(*(range(c + 1) for c in counts)))
        assert abs(int((take * np.array(sizes)).sum()) - budget) == want
    rng = np.random.default_rng(5)
    misses = []
    for _ in range(20):  # few rows, and most of them longer than the width
        sizes = np.unique(rng.integers(1, 200_000, 300))
        counts = rng.integers(1, 3, len(sizes))
        for budget in (65_535, 65_536, 65_537, 131_073, int((sizes * counts).sum() * rng.random())):
            take = mixing.fit(sizes, counts, budget)
            assert ((take >= 0) & (take <= counts)).all()
            misses.append(abs(int((take * sizes).sum()) - budget))
    assert max(misses) <= 20 and np.mean(misses) < 1


def test_every_size_gives_its_even_share():
    sizes, counts = np.arange(1, 5001), np.ones(5000, dtype=np.int64)  # one row of each length
    for part in (0.02, 0.3, 0.9):
        budget = int(sizes.sum() * part)
        take = mixing.fit(sizes, counts, budget)
        assert int((take * sizes).sum()) == budget
        for at in range(0, 5000, 1000):
            assert abs(take[at : at + 1000].mean() - part) < 0.02


def test_mix_meets_targets_and_repeats(frame):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 7, 20, 51]))), rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(600)]
    rows += [(7, "x y z", "b"), (7, "x y z", "b"), (None, None, "a"), (None, "one two", None)]
    found = mixing.mix(frame(rows).repartition(5)).collect()
    assert len(found) == len(rows)
    size_of = defaultdict(int)
    for _, t, s in rows:
        size_of[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size_of if s is not None)) + [None]
    target = dict(zip(order, brute_targets([size_of[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    source_at = {n: s for s, n in size_of.items()}
    assert len(source_at) == len(size_of)
    for r in found:
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
        s = source_at[r.source_size]
        assert abs(r.target - target[s]) < 1e-6
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(frame(rows).repartition(2)).collect()
    assert sorted((str(r.id), r.size, r.target, r.taken) for r in again) == sorted((str(r.id), r.size, r.target, r.taken) for r in found)


def test_mix_of_empty_and_wordless_tables(frame):
    assert mixing.mix(frame([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(frame([(1, None, None), (2, " ", "s")])).collect()] == [(0, 0.0, 0)] * 2
