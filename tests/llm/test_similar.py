from __future__ import annotations

import random

import numpy as np

import corpus_pipeline as pipeline
from menuspark.llm import simhash, similar
from menuspark.llm.simhash import MAX_BITS, fingerprint


def brute_set(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similar_pairs(rows, least=0.8):
    sets = {i: brute_set(t) for i, t in rows}
    return [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def brute_components(rows, pairs):
    root = {i: i for i, _ in rows}
    for i, j in pairs:
        a, b = root[i], root[j]
        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def bits_of(text):
    return similar.fingerprint(similar.shingles(text.encode()))


def edited(words, rng, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(8)
    texts = []
    for family in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [edited(base, rng, 1 + n % 6) for n in range(6 if family else 60)]
    shared = [f"s{i}" for i in range(100)]  # half alike: they meet in buckets but are not similar
    texts += [" ".join(shared + [f"w{rng.randrange(5000)}" for _ in range(50)]) for _ in range(40)]
    return list(enumerate(texts))


def test_components_equal_brute_force(frame):
    rows = corpus()
    pairs = similar_pairs(rows)
    blocks = {i: similar.block_keys(bits_of(t)) for i, t in rows}
    sharing = [(i, j) for i, j in pairs if (blocks[i] == blocks[j]).any()]
    assert len(sharing) >= 0.95 * len(pairs)  # recall of single pairs, from 0.8 on
    want = brute_components(rows, sharing)
    for cap in (512, 8):
        found = similar.similar_duplicates(frame([(i, t, "s") for i, t in rows]), bucket_cap=cap).collect()
        assert {r.id: r.component_id for r in found} == want
        assert sorted(r.id for r in found if r.kept) == sorted(set(want.values()))


def test_shingles_and_fingerprint_equal_brute_force(monkeypatch):
    rng = random.Random(4)
    texts = ["", " \t", "One", "a b\x0bC", "é É x " * 700] + [" ".join(rng.choice(["the", "Of", "and", "é", "x1"]) for _ in range(rng.randrange(1, 600))) for _ in range(20)]
    want = [len(brute_set("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for t in texts]
    assert [len(similar.shingles(t.encode())) for t in texts] == want
    for t in texts:
        own = similar.shingles(t.encode())
        spread = np.array([np.unpackbits(similar._mixed(np.array([x]) * similar._SEEDS).view(np.uint8)) for x in own]).reshape(len(own), 64 * similar._WORDS)
        assert (similar.fingerprint(own) == (2 * spread.sum(axis=0) > len(own))).all()
    whole = [similar.shingles(t.encode()) for t in texts]
    monkeypatch.setattr(similar, "PIECE", 7)
    assert all((similar.shingles(t.encode()) == w).all() for t, w in zip(texts, whole, strict=True))


def test_few_differing_bits_always_share_a_block():
    rng = np.random.default_rng(2)
    bits = bits_of("some text to begin with")
    for _ in range(50):
        other = bits.copy()
        other[rng.choice(similar.BLOCKS * similar.BLOCK_BITS, similar.BLOCKS - 1, replace=False)] ^= 1
        assert (similar.block_keys(bits) == similar.block_keys(other)).any()


def test_stage_drops_pairs_far_apart_in_bits(spark, frame):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    other = " ".join(base[:95] + ["changed", "two"] + base[97:])
    a, b = brute_set(" ".join(base)), brute_set(other)
    assert len(a & b) >= 0.8 * len(a | b)
    assert (fingerprint(" ".join(base).encode()) ^ fingerprint(other.encode())).bit_count() > MAX_BITS
    kept = pipeline.near_stage(spark, frame([(1, " ".join(base), "s"), (2, other, "s"), (3, "something else", "s")]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_rows_nulls_repeats_and_empty_table(frame):
    rows = [(5, "a b c d e f", "s"), (3, "A B C D E F", "s"), (3, "a b c d e f", None), (9, None, "s"), (8, "  ", "s"), (None, "", "s"), (1, "short", "s")]
    found = similar.similar_duplicates(frame(rows)).collect()
    assert sorted((r.id is None, r.id or 0, r.component_id) for r in found) == sorted([(False, 5, 3), (False, 3, 3), (False, 3, 3), (False, 9, 8), (False, 8, 8), (True, 0, 8), (False, 1, 1)])
    assert sorted(r.id for r in found if r.kept) == [1, 3, 8]
    assert similar.similar_duplicates(frame([])).count() == 0


def test_later_links_join_components_without_the_first_links(spark, frame, monkeypatch):
    links = [(i, i + 1) for i in range(0, 40, 2)] + [(50, 51), (51, 52), (60, 70)]
    later = [(1, 2), (3, 50), (80, 81), (61, 60), (70, 60)]
    make = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    whole = {r.node: r.root for r in simhash.connected_components(make(links + later)).collect()}
    roots = simhash.connected_components(make(links))
    joined = simhash.joined_components(roots, make(later)).collect()
    assert len(joined) == len(whole) and {r.node: r.root for r in joined} == whole
    assert simhash.joined_components(roots, make([(51, 50)])) is roots

    seen = []

    def counted(links, max_rounds=60, rows=None, rounds=simhash.connected_components):
        seen.append(links.filter("a <> b").count())
        return rounds(links, max_rounds, rows)

    for module in (simhash, similar):
        monkeypatch.setattr(module, "connected_components", counted)
    rows = corpus()
    similar.similar_duplicates(frame([(i, t, "s") for i, t in rows]))
    assert seen[0] > 0 and sum(seen[1:]) < seen[0]  # before, every call went through all links again
