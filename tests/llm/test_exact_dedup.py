from __future__ import annotations

import hashlib
import string
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from menuspark.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return {n: (max((i for i in ids if i is not None), default=None), len(ids)) for n, ids in groups.items()}


def check(found, rows):
    assert len(found) == len(rows)
    want = brute(rows)
    by_digest = {hashlib.sha256(n.encode()).digest(): v for n, v in want.items()}
    for r in found:
        assert (r.keep_id, r.group_size) == by_digest[bytes(r.digest)]
        assert not r.kept or r.id == r.keep_id
    kept = [bytes(r.digest) for r in found if r.kept]
    assert sorted(kept) == sorted(by_digest)


def test_case_nulls_empty_and_repeated_rows(frame):
    rows = [(1, "Ab", "s"), (2, "aB", "s"), (2, "aB", "s"), (3, None, "s"), (4, "", None), (5, "ÄB", "s"), (6, "äb", "s"), (None, "ab", "s"), (None, "z", None), (7, "x" * 300_000, "s"), (8, "X" * 300_000, "s")]
    check(exact_dedup.exact_duplicates(frame(rows)).collect(), rows)


def test_hot_group_goes_through_salts(frame):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}", "s") for i in range(900)]
    for each in (7, 20, 10**6):
        check(exact_dedup.exact_duplicates(frame(rows).repartition(7), salt_rows=each).collect(), rows)


def test_colliding_digests_never_merge_texts(frame):
    rows = [(i, f"{'xy'[i % 2]}{i % 5}" if i % 3 else "Hot", "s") for i in range(300)] + [(None, "x1", "s"), (3, None, "s")]
    want = brute(rows)
    for stub in (lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256)), lambda t: F.lit(b"same")):
        for each in (10, 10**6):
            found = exact_dedup.exact_duplicates(frame(rows).repartition(5), salt_rows=each, digest=stub).collect()
            texts = {i: (t or "").translate(LOWER) for i, t, _ in rows}
            assert len(found) == len(rows)
            assert all((r.keep_id, r.group_size) == want[texts[r.id]] for r in found if r.id not in (None, 3))
            assert sorted(texts[r.id] for r in found if r.kept and r.id != 3) == sorted(t for t in want if t)


def test_empty_table(frame):
    assert exact_dedup.exact_duplicates(frame([])).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.one_of(st.none(), st.text(alphabet="aAbBÄß \n", max_size=4)), st.just("s")), max_size=30))
def test_against_brute_force(frame, rows):
    check(exact_dedup.exact_duplicates(frame(rows)).collect(), rows)
