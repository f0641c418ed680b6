from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from menuspark.functions import clock, text
from menuspark.functions.geo import geodesic, haversine, vincenty_metres
from menuspark.operators.match import trigram_join


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (text.dish_name, {"  Biff-tartar   med Østers  ": "biff tartar med østers", "ﬁsk ½": "fisk 1 2", "": "", None: None}),
        (text.optional_text, {"  a \t b ": "a b", "  ": None, None: None}),
        (text.discovery_text, {"Øl & Tilbehør": "l tilbeh r", "Crème Brûlée": "creme brulee", None: ""}),
        (text.display_text, {"Øl & Tilbehør på Æ": "ol tilbehor pa ae"}),
        (text.scope_slug, {" Grønland / Bar ": "gr-nland-bar"}),
        (text.canonical_name, {"11. Margherita (H)": "Margherita", "Margherita 4 stk": "Margherita", "(A)": "(A)"}),
        (text.canonical_identity, {"Adamame": "edamame", "12. Margerita 200 g": "margherita"}),
        (text.price_minor, {"kr 225": 22500, "22,5": 2250, "NOK 95,-": 9500, "1 250": 125000, "abc": None, "12.345": None}),
        (text.price_notation, {"225/-": "225,-", "95-": "95,-"}),
        (text.public_url, {"https://a.no/x": True, "http://10.0.0.1/": False, "http://user@a.no/": False, "ftp://a.no": False, "http://localhost/": False, "http://172.20.1.1/": False, "http://8.8.8.8/": True, None: False}),
        (text.dominant_script, {"Ramen ラーメン屋さんのラ": "Latin", "Борщи soup": "Cyrillic", "12": None}),
        (clock.clock_minute, {"7": 420, "07:30": 450, "7.30 pm": 1170, "12 am": 0, "25": None, "x": None, "13 pm": None}),
    ],
)
def test_text_functions(spark, f, cases):
    assert one(spark, [(k,) for k in cases], "x string", f(F.col("x"))) == list(cases.values())


def test_similarity_and_literal_agree(spark):
    pairs = [("bif tartar", "biff tartar"), ("a", "b"), ("", ""), ("hot gear", "hot gear")]
    found = one(spark, pairs, "a string, b string", F.round(text.similarity(F.col("a"), F.col("b")), 4))
    assert found == [0.75, 0.0, 0.0, 1.0]
    assert sorted(text.trigram_list("Bif")) == sorted(["  b", " bi", "bif", "if "])


def test_trigram_join_finds_all_pairs(spark):
    words = ["hot gear", "hot bolt", "old gear", "small widget", "smal widget", "x", "", None, "hot gear"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    found = {(r.left_text, r.right_text) for r in trigram_join(df, df, "t", "t").collect()}

    def overlap(a, b):
        x, y = set(text.trigram_list(a)), set(text.trigram_list(b))
        return bool(x | y) and len(x & y) / len(x | y) >= 0.3

    assert found == {(a, b) for a in words for b in words if a is not None and b is not None and overlap(a, b)}


def test_distances(spark):
    near, far = vincenty_metres(59.9139, 10.7522, 59.914, 10.7522), vincenty_metres(59.9539, 10.7522, 59.914, 10.7522)
    assert near < 50 and far > 4000
    assert float(vincenty_metres(0, 0, 0, 1)) == pytest.approx(111_319.491, abs=0.01)
    assert float(vincenty_metres(10, 20, 10, 20)) == 0
    df = spark.createDataFrame([(59.9139, 10.7522, 59.9539, 10.7)], "a double, b double, c double, d double")
    row = df.select(haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h"), geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).first()
    assert row.h == pytest.approx(row.g, rel=0.006)


def test_weekdays_and_health(spark):
    assert one(spark, [(5, 1), (3, 3), (7, 2)], "a int, b int", clock.weekday_range(F.col("a"), F.col("b"))) == [[5, 6, 7, 1], [3], [7, 1, 2]]
    now = F.lit("2026-01-10 12:00:00").cast("timestamp")
    rows = [(True, "2026-01-09 12:00:00", 60, 0, "ok"), (True, "2026-01-09 11:59:59", 60, 0, "ok"), (False, None, 60, 0, None), (True, None, 60, 0, None), (True, "2026-01-10 11:00:00", 60, 1, None), (True, "2026-01-10 11:00:00", 60, 0, "quarantined"), (True, "2026-01-06 12:00:00", 2000, 0, None)]
    df = spark.createDataFrame(rows, "e boolean, t string, i int, f int, o string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r[0] for r in df.select(clock.source_health(F.col("e"), now, F.col("t"), F.col("i"), F.col("f"), F.col("o"))).collect()] == ["healthy", "stale", "disabled", "unverified", "degraded", "degraded", "healthy"]


def test_open_now_carries_over_midnight(spark):
    rows = [(6, 1080, 120, True, "2026-01-10 23:00:00"), (6, 1080, 120, True, "2026-01-11 01:59:00"), (6, 1080, 120, True, "2026-01-11 02:00:00"), (7, 0, 0, True, "2026-01-11 13:00:00"), (7, 600, 720, False, "2026-01-11 12:00:00"), (7, 1080, 60, True, "2026-01-12 00:30:00")]
    df = spark.createDataFrame(rows, "d int, o int, c int, n boolean, t string")
    found = df.select(clock.interval_open(F.col("d"), F.col("o"), F.col("c"), F.col("n"), F.col("t").cast("timestamp"))).collect()
    assert [r[0] for r in found] == [True, True, False, True, False, True]
