"""Rules of validation, addresses, storage and plans on small inputs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from menuspark import storage
from menuspark.functions.text import json_kind, public_host
from menuspark.operators import match, queues, snapshots, state
from menuspark.plans import browse, hours, registry
from menuspark.sources import manifests

FACTS = "accepted boolean, menu_accepted boolean, menu_checked boolean, menu_error string, hours_blocking boolean, hours_accepted boolean, hours_error string, failed_actions int, action_errors string"


@pytest.mark.parametrize(
    ("row", "families", "again"),
    [
        ((True, True, True, None, None, None, None, 0, None), [], False),
        ((None,) * 9, ["manifest"], False),
        ((False, False, True, "HTTP 503", None, None, None, 0, None), ["menu_assertions"], False),
        ((False, False, False, "HTTP 503", None, None, None, 0, None), ["transport"], True),
        ((False, False, False, "No menu found", True, False, "TLS", 0, None), ["extraction", "transport"], False),
        ((False, True, True, None, True, False, "no intervals", 1, "x"), ["hours", "action"], False),
        ((False, False, False, "odd", False, False, "no intervals", 0, None), ["unknown"], False),
        ((False, False, False, "Temporarily unavailable", None, None, None, 0, None), ["unknown"], True),
        ((False, True, True, None, True, True, None, 0, None), ["unknown"], False),
    ],
)
def test_failure_families(spark, row, families, again):
    v = spark.createDataFrame([row], FACTS)
    found = v.withColumn("families", registry.failure_families(v))
    r = found.select("families", F.coalesce(registry.retryable(v, F.col("families"), F.lit(1)), F.lit(False)).alias("again"), F.coalesce(registry.retryable(v, F.col("families"), F.lit(3)), F.lit(False)).alias("late")).first()
    assert (r.families, r.again, r.late) == (families, again, False)


def test_missing_variants_name_section_price_kind_and_maximum(spark):
    items = spark.createDataFrame([(1, "pho", "soups", 15000, None, None), (1, "pho", "soups", 28500, "multiple", 30900)], "manifest_id int, normalized_name string, normalized_section string, price_minor long, price_kind string, price_max_minor long")
    asked = [("a", "pho", None, None, None, None), ("b", "pho", "soups", 15000, "exact", None), ("c", "pho", "mains", None, None, None), ("d", "pho", None, 28500, "exact", None), ("e", "pho", None, 28500, "multiple", 30900), ("f", "pho", None, 15000, None, 1), ("g", "bun", None, None, None, None)]
    variants = spark.createDataFrame([(1, *x) for x in asked], "manifest_id int, label string, normalized_name string, normalized_section string, price_minor long, price_kind string, price_max_minor long")
    assert sorted(r.label for r in registry.missing_variants(variants, items).collect()) == ["c", "d", "f", "g"]
    label = registry.variant_label(F.lit("Pho"), F.lit("Soups"), F.lit(150), F.lit("multiple"), F.lit(200))
    assert spark.range(1).select(label).first()[0] == "Pho [Soups] @ 150 multiple..200"


@pytest.mark.parametrize(
    ("host", "public"),
    [("[::1]", False), ("[fe80::1]", False), ("[2606:4700::1111]", True), ("[2001:db8::1]", False), ("[x]", False), ("2130706433", False), ("134744072", True), ("0x7f.1", False), ("010.0.0.1", True), ("198.18.0.1", False), ("8.8.8.8", True), ("1.2.3.4.5", False), ("256.1.1.1", False), ("localhost.", False), ("intranet", False), ("a.local", False), ("a.example.com", True), ("a..com", False)],
)
def test_public_hosts(host, public):
    assert public_host(host) is public


def test_json_texts_and_kinds(spark):
    texts = ["plain", 'q"b\\s', "".join(map(chr, range(1, 32))) + "æ€😀\x7f ", "\\u000B", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", snapshots._json_text(F.col("t")).alias("j")).collect()
    assert all(r.j == json.dumps(r.t, ensure_ascii=False) for r in rows)
    kinds = {'{"a": 1}': "object", "[]": "array", '"x"': "string", "1.5": "number", "3": "number", "true": "boolean", "null": "null", "{": None}
    found = spark.createDataFrame([(t,) for t in kinds], "t string").select("t", json_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in found} == kinds


def test_written_tables_go_when_their_scope_ends(spark):
    with storage.scratch(spark):
        first = storage.materialize(spark.range(10), "one")
        kept = storage.keep(storage.materialize(first, "two", rows=10))
        paths = [x._menuspark_path for x in (first, kept)]
    assert not os.path.exists(paths[0].removeprefix("file:")) and kept.count() == 10
    storage.release(kept)
    assert not os.path.exists(paths[1].removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(Session)


def test_exclusive_files_and_racing_snapshots(spark, tmp_path):
    assert manifests.write_exclusive(spark, str(tmp_path / "m.json"), "{}") and not manifests.write_exclusive(spark, str(tmp_path / "m.json"), "x")
    assert (tmp_path / "m.json").read_text() == "{}"
    schema = "source_id long, snapshot_id long, fetched_at timestamp"
    stored = spark.createDataFrame([], schema)
    facts = {"snapshots": spark.createDataFrame([(1, 7, None)], schema)}
    state.append_snapshot(str(tmp_path), stored, facts, 1, None)
    with pytest.raises(state.StaleWriteError):  # the second writer has read the same state
        state.append_snapshot(str(tmp_path), stored, facts, 1, None)
    assert spark.read.parquet(str(tmp_path / "snapshots")).count() == 1


def test_even_spacing_over_a_whole_table(spark):
    for n, k in ((1000, 5), (3, 5), (1, 1), (0, 4), (17, 4)):
        rows = spark.range(n).repartition(7)
        found = sorted(r.id for r in queues.evenly_spaced(rows, ["id"], k).collect())
        assert found == (list(range(n)) if n <= k else sorted({int(i * (n - 1) / max(1, k - 1) + 0.5) for i in range(k)}))


def test_replay_by_pieces(spark):
    names = ["red gear", "gear", "old red", "x", "blue ring"]
    history = [("gear", "exact"), ("red", "prefix"), ("ear", "contains"), ("e", "contains"), ("xx", None), ("zzz", None), ("ed g", "contains"), ("band", "canonical")]
    found = match.replay(
        spark.createDataFrame([(q, "Oslo") for q, _ in history], "normalized_query string, city string"),
        spark.createDataFrame([(n, "oslo") for n in names] + [("zzz", "bergen")], "normalized_name string, city string"),
        spark.createDataFrame([(1, "band")], "concept_id int, query_alias string"),
        spark.createDataFrame([(1, "blue ring")], "concept_id int, menu_alias string"),
    )
    assert {r.normalized_query: r.current_resolution for r in found.collect()} == dict(history)


def test_previews_show_a_topic_once(spark):
    ranked = spark.createDataFrame([(1, "north", 1), (2, "north", 2), (1, "south", 1), (3, "south", 2), (4, "south", 3)], "topic_id int, area string, place int").withColumn("label", F.lit("l")).withColumn("restaurant_count", F.lit(1))
    found = browse.preview(ranked, ["south", "north"], 2, 4).collect()
    assert sorted((r.area, r.topic_id, r.shown) for r in found) == [("north", 2, 1), ("south", 1, 1), ("south", 3, 2)]


def test_hours_watches_that_do_not_block(spark):
    rows = [("changed", None), ("fetch_error", "verified"), ("quarantined", "provisional"), ("unexpected_error", "provisional"), ("extraction_error", None)]
    r = hours.watch_summary(spark.createDataFrame(rows, "outcome string, verification_status string")).first()
    assert (r.due, r.failed, r.blocking_failed, r.non_blocking_failed) == (5, 4, 3, 1)
