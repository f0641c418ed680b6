from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from menuspark.llm import sharding


def check(found, rows, together=True):
    assert len(found) == len(rows)
    by_shard, shards_of = defaultdict(list), defaultdict(set)
    text_of = {i: t or "" for i, t, _ in rows}
    for r in found:
        raw = text_of[r.id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        by_shard[r.shard].append(r)
        shards_of[raw].add(r.shard)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    if together:
        assert all(len(s) == 1 for s in shards_of.values())
    return by_shard


def test_balance_and_groups(frame):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))), "s") for i in range(3000)]
    rows += [(3000 + i, rows[i % 50][1], "s") for i in range(300)]
    by_shard = check(sharding.shard_documents(frame(rows).repartition(6)).collect(), rows)
    sizes = [sum(r.size for r in own) for own in by_shard.values()]
    assert len(sizes) == 16 and max(sizes) / min(sizes) < 1.03


def test_a_group_beyond_any_shard_is_dealt(frame):
    rows = [(i, "the same text" if i % 3 else f"own text {i}", "s") for i in range(3000)]
    by_shard = check(sharding.shard_documents(frame(rows)).collect(), rows, together=False)
    sizes = [sum(r.size for r in own) for own in by_shard.values()]
    assert len(sizes) == 16 and max(sizes) / min(sizes) < 1.1


def test_nulls_empty_long_and_empty_table(frame):
    rows = [(1, None, None), (2, "", "s"), (3, "x " * 200_000, "s"), (4, "ä", "s")]
    check(sharding.shard_documents(frame(rows)).collect(), rows)
    assert sharding.shard_documents(frame([])).count() == 0


def one_by_one(vector, m, residual):
    """Place equal units singly by the rule."""
    out = np.zeros(len(residual), dtype=np.int64)
    for _ in range(m):
        whole = ((residual + 1e-9 * vector >= vector) | (vector == 0)).all(axis=1)
        by_bytes = residual[:, 0] + 1e-9 * vector[0] >= vector[0]
        if whole.any() or by_bytes.any():
            score = np.where(whole if whole.any() else by_bytes, residual @ vector, -np.inf)
        else:
            score = residual[:, 0]
        best = int(np.argmax(score))
        out[best] += 1
        residual[best] = residual[best] - vector
    return out


def test_allotting_a_class_equals_placing_its_units_singly():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shards, m = int(rng.integers(1, 7)), int(rng.integers(0, 40))
        vector = rng.choice([0.0, 0.01, 0.03, 0.2, 1.3], 3) + np.array([1e-3, 0, 1e-4])
        residual = rng.uniform(-0.2, 1, (shards, 3))
        a, b = residual.copy(), residual.copy()
        got, want = sharding.allot(vector, m, a), one_by_one(vector, m, b)
        assert got.sum() == m and (got == want).all()
        assert np.allclose(a, b)


def test_pack_follows_the_dot_product():
    vectors = np.array([[0.6, 0.1, 0.1], [0.1, 0.6, 0.1], [0.5, 0.1, 0.1], [0.1, 0.5, 0.2]])
    taken = sharding.pack(vectors, np.ones(4, dtype=np.int64), np.ones((2, 3)))
    placed = taken.argmax(axis=1)
    assert placed[0] != placed[2]  # bytes of both do not fit together
    assert placed[1] != placed[3]  # nor do the tokens of these
    assert sharding.pack(np.zeros((0, 3)), np.zeros(0, dtype=np.int64), np.ones((4, 3))).shape == (0, 4)


def test_all_three_loads_are_balanced(frame):
    rng = random.Random(9)
    rows = [(i, rng.choice(["w " * 40, "x" * 80 + " y", "a b c " * 9])[: rng.randrange(20, 80)] + str(i), "s") for i in range(6000)]
    by_shard = check(sharding.shard_documents(frame(rows).repartition(6)).collect(), rows)
    words = {i: len(t.split()) for i, t, _ in rows}
    for load in ([sum(r.size for r in own) for own in by_shard.values()], [len(own) for own in by_shard.values()], [sum(words[r.id] for r in own) for own in by_shard.values()]):
        assert max(load) / min(load) < 1.02


def test_groups_below_a_shard_stay_whole_at_any_count(frame):
    for copies in (60, 63, 64, 65, 130):
        rows = [(i, "a text that repeats" if i < copies else f"another text, number {i}", "s") for i in range(3000)]
        check(sharding.shard_documents(frame(rows)).collect(), rows)
