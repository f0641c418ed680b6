from __future__ import annotations

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from menuspark import oracle, queries
from menuspark.plans import demand, markdown, quality, search
from menuspark.sources import manifests
from menuspark.sources.driver_tables import event_now, menu_now
from menuspark.streaming import events

NAMES = ["search_exact", "search_distance_sort", "browse_dishes", "demand_signals", "quality_sources", "owner_funnel", "snapshot_diff", "menu_fingerprints", "opening_states", "hours_observation_outcomes", "saved_items", "failure_rollup"]


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{t}')")
    found = queries.queries()[name](spark, small)
    columns = sorted(found.columns)
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, found.select(*columns).collect())) == plain(sql)


def test_shared_prices_of_long_menus(spark, tmp_path):
    """Menus of 1, 2, 15, 16 and 40 dishes; 15 fill the 30 lines that the general reading looks through."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT n AS p_partkey, 'plate ' || chr((97 + n // 26)::INTEGER) || chr((97 + n % 26)::INTEGER) AS p_name FROM range(40) t(n)")
    con.execute("CREATE TABLE lineitem AS SELECT size AS l_orderkey, n AS l_partkey FROM (VALUES (1), (2), (15), (16), (40)) s(size), range(40) t(n) WHERE n < size")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = queries.queries()["extracted_shared"](spark, str(tmp_path))
    columns = sorted(found.columns)
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()['extracted_shared']})").fetchall()
    assert len(sql) == 2 + 15 + 16 + 40
    assert plain(map(tuple, found.select(*columns).collect())) == plain(sql)


def test_registry_is_consistent(spark):
    assert set(oracle.oracle_sql()) <= set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_pushdown_and_plan_shapes(domain):
    plan = lambda df: df._jdf.queryExecution().explainString(domain.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    latest = plan(queries.queries()["latest_snapshot_per_source"](domain.spark, domain.sf_dir))
    assert "WindowGroupLimit" in latest and "PushedFilters: [IsNotNull(c_acctbal), GreaterThanOrEqual(c_acctbal,0.0)" in latest
    assert "TakeOrderedAndProject" in plan(queries.queries()["due_sources"](domain.spark, domain.sf_dir))
    for name in ("demand_signals", "search_exact", "trigram_similarity_join", "concept_coverage"):
        assert "CartesianProduct" not in plan(queries.queries()[name](domain.spark, domain.sf_dir))


@pytest.mark.parametrize(("query", "limit", "lat", "lon", "sort"), [("x", 20, None, None, "relevance"), ("ab", 0, None, None, "relevance"), ("ab", 51, None, None, "relevance"), ("ab", 5, 1.0, None, "relevance"), ("ab", 5, None, None, "distance"), ("ab", 5, 91.0, 0.0, "distance"), ("ab", 5, None, None, "name")])
def test_search_requests_are_checked(query, limit, lat, lon, sort):
    with pytest.raises(ValueError):
        search.check_request(query, limit, lat, lon, sort)


def test_spheroid_search(domain):
    found = search.search(domain, "gear", "NATION_16", menu_now(), latitude=59.95, longitude=10.8, sort="distance", exact_distance=True).collect()
    assert [r.distance for r in found] == sorted(r.distance for r in found)


def test_reports(domain):
    text = markdown.quality_report(quality.totals(domain, menu_now(), event_now()), quality.zero_results(domain, event_now(), menu_now()), quality.fuzzy_queries(domain, event_now(), menu_now()), quality.match_types(domain, event_now()), "2024-01-31")
    assert "## Zero-result queries" in text and "- menu sources: 150" in text
    signals = demand.signals(domain, event_now(), menu_now())
    text = markdown.demand_report(demand.totals(domain, event_now(), menu_now()), demand.queue(signals), demand.queue(signals, unresolved=False), "2024-01-31")
    assert "## Review queue" in text
    assert markdown.percent(1, 0) == "0.0 %"


def test_manifests(spark, tmp_path):
    good = {"slug": "a-b", "latitude": 59.9, "longitude": 10.7, "menuSource": {"sourceType": "html", "fetchMode": "http", "checkIntervalMinutes": 60, "minimumExpectedItems": 2}, "requiredDishes": [{"name": "Ramen"}], "forbiddenDishes": ["Brus"]}
    bad = {"slug": "A b", "menuSource": {"sourceType": "pdf", "fetchMode": "browser", "checkIntervalMinutes": 1}}
    for name, value in (("2.json", bad), ("1.json", good)):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    rows = manifests.read_manifests(spark, str(tmp_path))
    assert [(r.manifest_file, r.broken_rules) for r in rows.collect()] == [("1.json", []), ("2.json", ["slug", "coordinates", "interval", "browser_needs_html", "minimum"])]
    assert sorted((r.kind, r["name"]) for r in manifests.expected_dishes(rows).collect()) == [("forbidden", "Brus"), ("required", "Ramen")]
    items = spark.createDataFrame([(1, n, f"d{n}") for n in range(9)], "k int, position int, name string")
    assert [(r.minimum_items, r.required) for r in manifests.generated(items, "k", 3).collect()] == [(9, ["d0", "d4", "d8"])]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "view", 1.0, "{}"), (1, "2024-01-01 00:00:00", 1, "view", 1.0, "{}"), (2, "2024-01-02 00:00:00", 1, "click", 2.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sink = events.append_once(str(tmp_path / "out"))
    stream = lambda: events.distinct_events(events.event_stream(spark, str(tmp_path / "in")))
    events.run_once(stream(), str(tmp_path / "ck"), sink)
    events.run_once(stream(), str(tmp_path / "ck"), sink)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    assert events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"))).columns == ["window", "event_type", "events", "value"]
