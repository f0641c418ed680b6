from __future__ import annotations

import random
import uuid
from collections import Counter

import pytest

from menuspark.llm import rollups

SCHEMA = "source string, lang string, tokenizer string, tokens long, new long"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in store.totals().collect()}


def test_deltas_replays_and_nulls(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([None, 0, 3, 11]), rng.choice([None, 3, 5])) for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    store = rollups.RollupStore(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("b1", rollups.inserts(df)) and not store.commit("b1", rollups.inserts(df))
    assert store.commit("b2", rollups.revisions(df, "tokens", "new"))
    gone = spark.createDataFrame(rows[:50], SCHEMA).drop("tokens").withColumnRenamed("new", "tokens")
    assert store.commit("b3", rollups.deletes(gone)) and not store.commit("b3", rollups.deletes(gone))
    assert store.commit("b4", rollups.inserts(df.limit(0)))
    docs, tokens = Counter(), Counter()
    for s, l, v, _, n in rows[50:]:
        docs[s, l, v] += 1
        tokens[s, l, v] += n or 0
    assert totals(store) == {k: (docs[k], tokens[k]) for k in docs}
    assert totals(rollups.RollupStore(spark, str(tmp_path / "r"))) == totals(store)


def test_a_cell_without_rest_disappears_and_names_are_checked(spark, tmp_path):
    df = spark.createDataFrame([("a", "en", "v", 4, 4)], SCHEMA)
    store = rollups.RollupStore(spark, str(tmp_path / uuid.uuid4().hex))
    store.commit("in", rollups.inserts(df))
    store.commit("out", rollups.deletes(df))
    assert totals(store) == {}
    with pytest.raises(ValueError):
        store.commit("../x", rollups.inserts(df))


def test_a_lost_race_leaves_one_batch(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "en", "v", 4, 4)], SCHEMA)
    store = rollups.RollupStore(spark, str(tmp_path / "race"))
    store.commit("in", rollups.inserts(df))
    monkeypatch.setattr(store, "committed", lambda _: False)  # as seen before the other writer's rename
    assert not store.commit("in", rollups.inserts(df))
    assert totals(store) == {("a", "en", "v"): (1, 4)}


def test_compaction_keeps_totals_and_ids(spark, tmp_path):
    rng = random.Random(3)
    store = rollups.RollupStore(spark, str(tmp_path / "c"))
    assert not store.compact()
    for turn in range(3):
        for n in range(3):
            rows = [(rng.choice(["a", None]), "en", "v", rng.randrange(9), 0) for _ in range(20)]
            assert store.commit(f"b{turn}-{n}", rollups.inserts(spark.createDataFrame(rows, SCHEMA)))
        before = totals(store)
        assert store.compact() and not store.compact()
        assert totals(store) == before and store._names("batches") == []
        assert not store.commit(f"b{turn}-1", rollups.inserts(spark.createDataFrame(rows, SCHEMA))) and totals(store) == before


def test_one_id_with_other_content_is_told(spark, tmp_path):
    df = spark.createDataFrame([("a", "en", "v", 4, 4, "x", 1)], SCHEMA + ", documents string, d int")  # extra columns may have any name
    store = rollups.RollupStore(spark, str(tmp_path / "v"))
    store.commit("in", rollups.inserts(df))
    assert not store.commit("in", rollups.inserts(df), verify=True)
    with pytest.raises(ValueError, match="other content"):
        store.commit("in", rollups.inserts(df.unionAll(df)), verify=True)
    assert totals(store) == {("a", "en", "v"): (1, 4)}
