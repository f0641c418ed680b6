from __future__ import annotations

from pyspark.sql import functions as F

from menuspark.operators import queues, snapshots, state
from menuspark.plans.browse import classify
from menuspark.plans.ingestion import watch

ITEM = "source_key string, name string, description string, section string, price_minor long, currency string, price_kind string, price_max_minor long"


def test_price_shapes(spark):
    rows = [("exact", 100, None), (None, None, None), ("exact", 100, 200), ("from", None, None), ("from", 1, 2), ("multiple", 2, 1), ("multiple", 1, None), ("multiple", 1, 1), ("exact", -1, None), ("odd", 1, None)]
    df = spark.createDataFrame(rows, "price_kind string, price_minor long, price_max_minor long")
    found = [r[0] for r in df.select(snapshots.price_violation(F.col("price_kind"), F.col("price_minor"), F.col("price_max_minor"))).collect()]
    assert found == [None, None, "exact_with_maximum", "from_without_price", "from_with_maximum", "maximum_below_price", "multiple_without_range", None, "negative", "unknown_kind"]
    sound, quarantined = snapshots.sound_prices(df)
    assert sound.count() == 3 and quarantined.count() == 7


def test_diff(spark):
    before = spark.createDataFrame([("a", "A", None, None, 22500, "NOK", "exact", None), ("b", "B", "x", None, 100, "NOK", None, None), ("c", "C", " ", "s", 1, "NOK", "multiple", 24900), ("gone", "G", None, None, 1, "NOK", None, None)], ITEM)
    after = spark.createDataFrame([("a", "A", None, None, 24500, "NOK", "exact", None), ("b", "B", "y", None, 100, "NOK", "from", None), ("c", "C", None, "s", 1, "NOK", "multiple", 25900), ("new", "N", None, None, 1, "NOK", None, None)], ITEM)
    found = sorted((r.source_key, r.kind) for r in snapshots.diff(before, after).collect())
    assert found == [("a", "price_changed"), ("b", "content_changed"), ("b", "price_changed"), ("c", "price_changed"), ("gone", "removed"), ("new", "added")]


def test_fingerprint_ignores_order_and_blank_text(spark):
    rows = [("Ærlig", "d", "s", 1, "nok"), ("Zeta", None, None, None, "NOK"), ('Quote "x"\n', "é", "s", 5, "NOK")]
    make = lambda rs: snapshots.fingerprint(spark.createDataFrame([(1, *r) for r in rs], "k int, name string, description string, section string, price_minor long, currency string"), ["k"]).first().fingerprint
    assert make(rows) == make(rows[::-1])
    assert make([("Ærlig", " d ", "s", 1, "NOK"), ("zeta", "  ", "", None, "NOK"), rows[2]]) == make(rows)
    assert make(rows[:2]) != make(rows)


def test_gates(spark):
    df = spark.createDataFrame([(20, 4, 1), (0, 2, 5), (7, 1, 1), (8, 4, 1)], "p int, c int, m int")
    assert [r[0] for r in df.select(snapshots.extraction_gate(F.col("p"), F.col("c"), F.col("m"))).collect()] == ["suspicious_drop", "below_minimum", "ok", "ok"]


def test_one_observation_per_key(spark):
    rows = [("k", "i1", "Ramen", None, "", 100, "NOK", 0.7, 3, "x"), ("k", "i2", "ramen", "broth", "", 100, "nok", 0.7, 4, "x"), ("c", "i3", "A", None, "", 1, "NOK", 0.7, 1, None), ("c", "i4", "A", None, "", 2, "NOK", 0.7, 2, None)]
    df = spark.createDataFrame(rows, "source_key string, item_id string, name string, description string, section string, price_minor long, currency string, confidence double, position int, excerpt string")
    best, clashing = snapshots.one_per_source_key(df, ["source_key"])
    assert [(r.source_key, r.item_id) for r in best.collect()] == [("k", "i2")]
    assert [r.source_key for r in clashing.collect()] == ["c"]


def test_classes(spark):
    rows = [("Ramen", None, 1), ("Aperol Spritz", None, 1), ("Chimichurri", None, 1), ("Velg styrke", None, 1), ("Allergener: melk", None, 1), ("Hovedretter", None, None), ("16 STK", None, 1), ("Hovedretter", None, 5), ("Ramen", "Drinks", 1)]
    df = spark.createDataFrame(rows, "n string, s string, p int")
    found = [r[0] for r in df.select(classify(F.col("n"), F.col("s"), F.lit(None).cast("string"), F.col("p"))).collect()]
    assert found == ["dish", "beverage", "sauce_or_side", "modifier", "allergen_or_information", "menu_heading", "invalid_fragment", "dish", "beverage"]


def test_state_projections(spark, tmp_path):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    changes = spark.createDataFrame([(1, "c", 2), (3, "d", 1)], "id int, v string, version int")
    assert sorted((r.id, r.v) for r in state.upsert(current, changes, ["id"], [F.desc("version")]).collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert [r.id for r in state.insert_absent(current, changes.unionByName(changes), "id", [F.asc("version")]).collect()] == [3]
    stored = spark.createDataFrame([(1, 10, "2026-01-01"), (1, 11, "2026-01-02")], "source_id int, snapshot_id int, fetched_at string")
    state.append_snapshot(str(tmp_path), stored, {"snapshots": stored, "items": current}, 1, 11)
    assert spark.read.parquet(f"{tmp_path}/items").count() == 2
    try:
        state.append_snapshot(str(tmp_path), stored, {"snapshots": stored}, 1, 10)
    except state.StaleWriteError:
        pass
    else:
        raise AssertionError("a stale write went through")
    assert state.schema_gaps(current, {"id": "int", "v": "int", "w": "string"}) == [("v", "int", "string"), ("w", "string", None)]


def test_even_sample(spark):
    df = spark.range(11).withColumnRenamed("id", "i")
    assert sorted(r.i for r in queues.evenly_spaced(df, ["i"], 5).collect()) == [0, 3, 5, 8, 10]
    assert queues.evenly_spaced(df, ["i"], 20).count() == 11
    assert [r.i for r in queues.evenly_spaced(df, ["i"], 1).collect()] == [0]


def test_watch_pass(spark):
    page = "<body>" + "".join(f"<p>Rett nummer {c} {100 + n},-</p>" for n, c in enumerate("abcdef")) + "</body>"
    pages = spark.createDataFrame([(1, page, "2026-01-01", 200), (2, page, "2026-01-01", 304), (3, "<p>none</p>", "2026-01-01", 200), (4, None, "2026-01-01", 500)], "source_id long, html string, fetched_at string, status int")
    sources = spark.createDataFrame([(i, 3, None, None, None) for i in range(1, 5)], "source_id long, minimum_items int, last_raw_sha256 string, last_fingerprint string, last_extractor string")
    empty = spark.createDataFrame([], "source_id long, " + ITEM)
    first = watch(pages, sources, empty, "v1")
    assert {r.source_id: r.outcome for r in first.outcomes.collect()} == {1: "changed", 2: "not_modified", 3: "below_minimum", 4: "fetch_error"}
    assert first.items.count() == 6 and {r.kind for r in first.changes.collect()} == {"added"}
    print_ = first.outcomes.filter("source_id = 1").first().fingerprint
    again = watch(pages.filter("source_id = 1"), sources.withColumn("last_fingerprint", F.lit(print_)).withColumn("last_extractor", F.lit("v1")), first.items, "v1")
    assert [r.outcome for r in again.outcomes.collect()] == ["unchanged"] and again.changes.count() == 0
