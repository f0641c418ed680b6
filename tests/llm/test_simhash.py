from __future__ import annotations

import random
import re

import xxhash

from menuspark.llm import simhash


def brute_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(fps)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in ordered}


def unsigned(x):
    return x & (2**64 - 1)


def test_fingerprint_matches_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one two", "A b\x0bc\x85d e", "ä Ö é x y z"] + [" ".join(rng.choice(["the", "Of", "and", "é", "x1"]) for _ in range(rng.randrange(1, 60))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == want == brute_fingerprint(text)


def test_links_keep_components_with_small_and_crowded_buckets(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            fps.add(base)
            base ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 1 << rng.randrange(64) | 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) for i in range(64)} | {centre ^ (1 << i) ^ (1 << (i + 7) % 64) ^ (1 << (i + 20) % 64) for i in range(40)}
    signed = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    want = brute_components(fps)
    for cap in (256, 3):
        links = simhash.near_links(signed, bucket_cap=cap)
        found = links.collect()
        assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 2 for r in found)
        roots = {unsigned(r.node): unsigned(r.root) for r in simhash.connected_components(links).collect()}
        mine = {}
        for f, root in want.items():
            mine.setdefault(roots.get(f, f), set()).add(f)
        brute = {}
        for f, root in want.items():
            brute.setdefault(root, set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    assert roots == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_rows_nulls_repeats_and_empty_table(frame):
    rows = [(5, "a b c d e", "s"), (3, "A B C D E", "s"), (3, "a b c d e", None), (9, None, "s"), (8, "  ", "s"), (None, "", "s"), (1, "something else entirely here", "s")]
    found = simhash.near_duplicates(frame(rows)).collect()
    assert sorted((r.id is None, r.id or 0, r.component_id) for r in found) == sorted([(False, 5, 3), (False, 3, 3), (False, 3, 3), (False, 9, 8), (False, 8, 8), (True, 0, 8), (False, 1, 1)])
    assert sorted(r.id for r in found if r.kept) == [1, 3, 8]
    assert simhash.near_duplicates(frame([])).count() == 0
