"""DuckDB SQL of every registered query that SQL can express, over the same tables.

The domain views are written once, as common table expressions in front of each statement.
"""

from __future__ import annotations

from menuspark.sources.driver_tables import ALIASES, CLICKS, CONCEPTS, EVENT_NOW, MATCH_TYPES, MENU_NOW, QUERIES, ZONES

NOW = f"TIMESTAMP '{MENU_NOW}'"
ENOW = f"TIMESTAMP '{EVENT_NOW}'"
CITY = "nation_16"
OTHER_CITY = "nation_11"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


def _grams(x: str) -> str:
    """The distinct trigrams of a text expression."""
    words = f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _overlap(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"round({shared} / (len({a}) + len({b}) - {shared})::DOUBLE, 6)"


def _health(enabled: str, checked: str, interval: str, failures: str, outcome: str) -> str:
    return f"""CASE WHEN NOT {enabled} THEN 'disabled' WHEN {checked} IS NULL OR {interval} IS NULL THEN 'unverified'
        WHEN {checked} + to_minutes(greatest({interval} * 3, 1440)) < {NOW} THEN 'stale'
        WHEN {failures} > 0 OR coalesce({outcome} IN ('quarantined', 'fetch_error', 'extraction_error', 'blocked_by_robots'), false) THEN 'degraded' ELSE 'healthy' END"""


def _name(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _source_key(name: str, section: str) -> str:
    return f"sha256({_name(section)} || chr(0) || {_name(name)})"


BASE = f"""
WITH restaurants AS (
    SELECT c_custkey AS restaurant_id, 'r' || c_custkey AS slug, c_name AS name, n_name AS city, c_mktsegment || ' ' || c_custkey AS address, c_acctbal >= 0 AS active,
        59.9 + (c_custkey % 200) / 1000.0::DOUBLE AS lat, 10.7 + (c_custkey % 300) / 1000.0::DOUBLE AS lon
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
menu_sources AS (
    SELECT c_custkey AS source_id, c_custkey AS restaurant_id, 'https://example.org/menu/' || c_custkey AS url, c_custkey % 10 <> 0 AS enabled,
        (60 + (c_custkey % 12) * 60)::INTEGER AS interval_minutes, CASE WHEN c_custkey % 17 <> 0 THEN {NOW} - to_days((c_custkey % 5)::INTEGER) END AS last_checked_at,
        {NOW} + to_days((c_custkey % 7 - 3)::INTEGER) AS next_check_at, (c_custkey % 4)::INTEGER AS failures, (c_custkey % 9)::INTEGER AS minimum_items
    FROM customer),
snapshots AS (SELECT o_orderkey AS snapshot_id, o_custkey AS source_id, o_orderdate AS fetched_at FROM orders),
items AS (
    SELECT sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT,
            round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus)) AS item_id,
        l_orderkey AS snapshot_id, p_name AS name, lower(p_name) AS normalized_name, p_brand AS description, p_type AS section,
        CASE WHEN l_linenumber <> 7 THEN round(l_extendedprice * 100)::BIGINT END AS price_minor, l_linenumber AS position, round(1 - l_discount, 2) AS confidence
    FROM lineitem JOIN part ON l_partkey = p_partkey),
watch_runs AS (
    SELECT o_orderkey AS run_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'changed' WHEN 'O' THEN 'unchanged' ELSE 'fetch_error' END AS outcome,
        CASE WHEN o_orderstatus = 'P' THEN 'HTTP_' || (o_orderkey % 3 + 500) END AS error_code, o_orderdate AS started_at
    FROM orders),
concepts(concept_id, concept_slug, canonical_name, concept_normalized, concept_active) AS (VALUES {_rows(CONCEPTS)}),
aliases(alias_id, concept_id, alias, scope) AS (VALUES {_rows(ALIASES)}),
menu_aliases AS (SELECT concept_id, alias AS menu_alias FROM aliases WHERE scope IN ('menu', 'both')),
query_aliases AS (SELECT concept_id, alias AS query_alias, alias_id FROM aliases WHERE scope IN ('query', 'both')),
searches AS (
    SELECT event_id AS search_id, {_list(QUERIES)}[(user_id + event_id) % 12 + 1] AS normalized_query,
        CASE WHEN event_id % 3 = 0 THEN 'nation_' || (user_id % 25) ELSE 'NATION_' || (user_id % 25) END AS city,
        (CASE WHEN event_type = 'error' THEN 0 ELSE 1 + user_id % 5 END)::INTEGER AS result_count,
        CASE WHEN event_id % 10 = 0 THEN 'legacy_unclassified' ELSE 'explicit_search' END AS demand_source, ts AS occurred_at
    FROM events WHERE event_type IN ('signup', 'error', 'view')),
shown AS (SELECT *, unnest(range(1, user_id % 3 + 2)) AS rank FROM events WHERE event_type = 'view'),
impressions AS (
    SELECT event_id * 10 + rank AS impression_id, event_id AS search_id, 1 + (event_id * 3 + rank) % 200 AS part_id, 1 + (user_id * 7 + rank) % 100 AS restaurant_id,
        rank::INTEGER AS rank, {_list(MATCH_TYPES)}[(event_id + rank) % 5 + 1] AS match_type,
        CASE (event_id + rank) % 5 WHEN 4 THEN round(0.3 + (event_id % 50) / 100.0::DOUBLE, 2) WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN 0.95 ELSE 0.9 END::DOUBLE AS match_score,
        ts AS created_at
    FROM shown),
impression_items AS (SELECT p_partkey AS part_id, p_name AS name, lower(p_name) AS normalized_name FROM part),
conversions AS (
    SELECT event_id AS conversion_id, 'c' || (event_id // 3) AS client_event_id, (event_id - 1) * 10 + 1 AS impression_id, {_list(CLICKS)}[event_id % 5 + 1] AS event_type, ts AS occurred_at
    FROM events WHERE event_type IN ('click', 'purchase')),
actions AS (
    SELECT c_custkey AS restaurant_id, action_type, 'https://example.org/' || action_type || '/' || c_custkey AS url, c_custkey % 4 <> 0 AS enabled,
        {NOW} + to_days((c_custkey % 20 - 5)::INTEGER) - to_days(30) AS verified_at, {NOW} + to_days((c_custkey % 20 - 5)::INTEGER) AS expires_at
    FROM customer, (VALUES ('booking'), ('order')) AS t(action_type)),
hours_sources AS (
    SELECT c_custkey AS hours_source_id, c_custkey AS restaurant_id, {_list(ZONES)}[c_custkey % 3 + 1] AS time_zone, 1440 AS interval_minutes,
        CASE WHEN c_custkey % 4 = 0 THEN 'provisional' ELSE 'verified' END AS verification_status,
        CASE WHEN c_custkey % 13 <> 0 THEN {NOW} - to_days((c_custkey % 4)::INTEGER) END AS last_checked_at, c_custkey % 9 <> 0 AS enabled,
        (c_custkey % 5)::INTEGER AS failures, (c_custkey % 7)::INTEGER AS minimum_intervals
    FROM customer),
hours_snapshots AS (
    SELECT o_orderkey AS hours_snapshot_id, o_custkey AS hours_source_id, o_orderdate AS fetched_at, (o_orderkey % 8)::INTEGER AS interval_count,
        'f' || (o_orderkey % 4) AS fingerprint, 'v' || (o_orderkey % 2) AS extractor
    FROM orders),
hours_intervals AS (
    SELECT hours_snapshot_id, iso_weekday::INTEGER AS iso_weekday, opens, closes, closes <= opens AS next_day FROM (
        SELECT hours_snapshot_id, unnest(range(1, interval_count + 1)) AS iso_weekday, ((hours_snapshot_id % 12) * 60 + 360)::INTEGER AS opens,
            (((hours_snapshot_id % 12) * 60 + 360 + (1 + hours_snapshot_id % 20) * 60) % 1440)::INTEGER AS closes
        FROM hours_snapshots) WHERE iso_weekday <= 7),
stale_latest AS (
    SELECT DISTINCT ON (source_id) s.snapshot_id, s.source_id, s.fetched_at, r.restaurant_id, r.name AS restaurant_name, r.city, r.lat, r.lon,
        m.last_checked_at, m.interval_minutes, m.last_checked_at + to_minutes(greatest(m.interval_minutes * 3, 1440)) AS fresh_until
    FROM snapshots s JOIN menu_sources m USING (source_id) JOIN restaurants r USING (restaurant_id)
    WHERE m.enabled AND r.active ORDER BY source_id, s.fetched_at DESC, s.snapshot_id DESC),
latest AS (SELECT * FROM stale_latest WHERE {NOW} <= fresh_until),
current_items AS (SELECT l.*, i.* EXCLUDE (snapshot_id) FROM latest l JOIN items i USING (snapshot_id)),
hours_latest AS (
    SELECT DISTINCT ON (h.restaurant_id) h.restaurant_id, s.hours_snapshot_id, timezone(h.time_zone, timezone('UTC', {NOW})) AS local_now,
        h.last_checked_at + to_minutes(greatest(h.interval_minutes * 3, 1440)) AS opening_fresh_until
    FROM hours_sources h JOIN hours_snapshots s USING (hours_source_id)
    WHERE h.enabled AND h.verification_status = 'verified' AND {NOW} <= h.last_checked_at + to_minutes(greatest(h.interval_minutes * 3, 1440))
    ORDER BY h.restaurant_id, s.fetched_at DESC, s.hours_snapshot_id DESC),
opening AS (
    SELECT l.restaurant_id, l.opening_fresh_until, CASE WHEN EXISTS (
        SELECT 1 FROM hours_intervals i WHERE i.hours_snapshot_id = l.hours_snapshot_id AND (
            (NOT next_day AND iso_weekday = isodow(local_now) AND hour(local_now) * 60 + minute(local_now) >= opens AND hour(local_now) * 60 + minute(local_now) < closes)
            OR (next_day AND ((iso_weekday = isodow(local_now) AND hour(local_now) * 60 + minute(local_now) >= opens)
                OR (iso_weekday = (CASE WHEN isodow(local_now) = 1 THEN 7 ELSE isodow(local_now) - 1 END) AND hour(local_now) * 60 + minute(local_now) < closes)))))
        THEN 'open' ELSE 'closed' END AS opening_state
    FROM hours_latest l),
index_names AS (SELECT DISTINCT lower(city) AS place, normalized_name FROM current_items),
routes AS (SELECT q.query_alias, m.menu_alias FROM query_aliases q JOIN concepts c USING (concept_id) JOIN menu_aliases m USING (concept_id) WHERE c.concept_active)
"""


def _resolution(q: str, city: str) -> str:
    here = f"place = lower({city})"
    return f"""CASE WHEN EXISTS (SELECT 1 FROM index_names WHERE {here} AND normalized_name = {q}) THEN 'exact'
        WHEN EXISTS (SELECT 1 FROM routes JOIN index_names ON normalized_name = menu_alias WHERE query_alias = {q} AND {here}) THEN 'canonical'
        WHEN EXISTS (SELECT 1 FROM index_names WHERE {here} AND starts_with(normalized_name, {q})) THEN 'prefix'
        WHEN EXISTS (SELECT 1 FROM index_names WHERE {here} AND contains(normalized_name, {q})) THEN 'contains' END AS current_resolution"""


def _search(q: str, limit: int, near: bool = False, sort: str = "relevance", city: str = CITY) -> str:
    metres = "round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(59.95 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(59.95)) * pow(sin(radians(10.8 - lon) / 2), 2)))), 3)"
    order = {"relevance": "score DESC, distance ASC NULLS LAST", "distance": "distance ASC NULLS LAST, score DESC"}[sort]
    return f""", wanted AS (
        SELECT c.concept_id, c.concept_slug, m.menu_alias FROM (SELECT concept_id FROM query_aliases JOIN concepts USING (concept_id) WHERE query_alias = '{q}' AND concept_active ORDER BY alias_id LIMIT 1)
        JOIN concepts c USING (concept_id) JOIN menu_aliases m USING (concept_id)),
    scored AS (
        SELECT i.*, w.concept_slug, {metres if near else 'NULL::DOUBLE'} AS distance, {_overlap(_grams('normalized_name'), _grams(f"'{q}'"))} AS sim,
            CASE WHEN normalized_name = '{q}' THEN 'exact' WHEN w.concept_id IS NOT NULL THEN 'canonical' WHEN starts_with(normalized_name, '{q}') THEN 'prefix' WHEN contains(normalized_name, '{q}') THEN 'contains' ELSE 'fuzzy' END AS match_type
        FROM current_items i LEFT JOIN wanted w ON w.menu_alias = i.normalized_name WHERE lower(city) = '{city}'),
    found AS (
        SELECT *, CASE match_type WHEN 'exact' THEN 1.0 WHEN 'canonical' THEN 0.98 WHEN 'prefix' THEN 0.95 WHEN 'contains' THEN 0.9 ELSE least(0.89, sim) END::DOUBLE AS score
        FROM scored WHERE match_type <> 'fuzzy' OR sim >= 0.3
        ORDER BY {order}, confidence DESC, fetched_at DESC, restaurant_name, position, item_id LIMIT {limit}),
    results AS (
        SELECT f.item_id, f.restaurant_id, f.name, f.city, coalesce(f.price_minor, -1) AS price_minor, f.match_type, f.score, f.concept_slug, f.distance, coalesce(o.opening_state, 'unknown') AS opening_state, b.url AS booking_url, d.url AS order_url
        FROM found f LEFT JOIN opening o USING (restaurant_id)
        LEFT JOIN actions b ON b.restaurant_id = f.restaurant_id AND b.action_type = 'booking' AND b.enabled AND b.expires_at > {NOW}
        LEFT JOIN actions d ON d.restaurant_id = f.restaurant_id AND d.action_type = 'order' AND d.enabled AND d.expires_at > {NOW})
    """


_PLAIN = "SELECT * EXCLUDE (distance) FROM results"

_DISC = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _class(name: str, section: str, description: str, price: str) -> str:
    from menuspark.plans import browse as b

    n, s, t = (_DISC.format(x=x) for x in (name, section, description))

    def like(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    return f"""CASE WHEN NOT {like(n, '[a-z]')} OR {like(n, b.FRAGMENT)} THEN 'invalid_fragment'
        WHEN {like(n, b.INFORMATION)} OR {like(t, '^allergen')} THEN 'allergen_or_information' WHEN {like(n, b.MODIFIER)} THEN 'modifier'
        WHEN {like(s, b.DRINK_SECTION)} OR {like(n, b.DRINK_NAME)} THEN 'beverage' WHEN {like(s, b.SIDE_SECTION)} OR {like(n, b.SIDE_NAME)} THEN 'sauce_or_side'
        WHEN {price} IS NULL AND {like(n, b.HEADING)} THEN 'menu_heading' ELSE 'dish' END"""


def _canonical(x: str) -> str:
    a = f"regexp_replace({x}, '^\\s*\\d+[.)-]\\s*', '')"
    b = f"regexp_replace({a}, '\\s*\\([A-ZÆØÅ](?:\\s*,\\s*[A-ZÆØÅ])*\\)\\s*$', '')"
    c = f"trim(regexp_replace(regexp_replace({b}, '(?i)\\s+\\d+\\s*(?:stk|biter|pieces?|g|gram)\\s*$', ''), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {c} <> '' THEN {c} ELSE trim({x}) END)"


def _identity(x: str) -> str:
    return f"regexp_replace(regexp_replace({_name(_canonical(x))}, '^adamame\\b', 'edamame'), '^marg?erita\\b', 'margherita')"


_BROWSE = f""", dims AS (
    SELECT m.menu_alias, c.concept_slug, c.canonical_name, coalesce((
        SELECT q.query_alias FROM query_aliases q WHERE q.concept_id = c.concept_id ORDER BY (q.query_alias = c.concept_normalized) DESC, q.alias_id LIMIT 1), c.concept_normalized) AS preferred_query
    FROM menu_aliases m JOIN concepts c USING (concept_id) WHERE c.concept_active),
classed AS (
    SELECT i.*, d.concept_slug, d.canonical_name, d.preferred_query, {_class('name', 'section', 'description', 'price_minor')} AS class0,
        CASE WHEN d.concept_slug IS NOT NULL THEN 'concept:' || d.concept_slug ELSE 'menu:' || {_identity('name')} END AS identity
    FROM current_items i LEFT JOIN dims d ON d.menu_alias = i.normalized_name WHERE lower(city) = '{CITY}'),
browse_rows AS (SELECT * REPLACE (CASE WHEN class0 = 'dish' AND identity = 'menu:' THEN 'invalid_fragment' ELSE class0 END AS class0) FROM classed),
dishes AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY confidence DESC, fetched_at DESC, position, restaurant_name, name, item_id) AS rn FROM browse_rows WHERE class0 = 'dish'),
firsts AS (SELECT identity, restaurant_id, min(rn) AS rn FROM dishes GROUP BY ALL),
browsed AS (
    SELECT d.identity, coalesce(d.canonical_name, {_canonical('d.name')}) AS dish_name, d.preferred_query,
        (SELECT count(*) FROM firsts f WHERE f.identity = d.identity) AS restaurant_count,
        (SELECT string_agg(restaurant_id::VARCHAR, ',' ORDER BY rn) FROM (SELECT * FROM firsts f WHERE f.identity = d.identity ORDER BY rn LIMIT 2)) AS restaurant_examples
    FROM dishes d WHERE rn = 1),
catalogue AS (SELECT identity, dish_name, coalesce(preferred_query, {_identity('dish_name')}) AS query, restaurant_count, restaurant_examples FROM browsed),
topics(topic_id, area, label, priority, term) AS (VALUES (0, 'north', 'All ring', 3, 'ring'), (1, 'north', 'Old old bolt', 2, 'old bolt'), (2, 'south', 'Any hot', 5, 'hot'), (3, 'south', 'No sushi', 9, 'sushi'), (4, 'east', 'Big large plate', 1, 'large plate'), (5, 'east', 'Gear gear', 4, 'gear')),
topic_hits AS (
    SELECT topic_id, identity, restaurant_count, CASE WHEN query = term THEN 3 ELSE 2 END AS score FROM catalogue JOIN topics
    ON query = term OR contains(' ' || query || ' ', ' ' || term || ' ') OR contains(' ' || term || ' ', ' ' || query || ' ')),
covered AS (
    SELECT topic_id, max(score) AS score, max(restaurant_count) AS restaurant_count, count(*) AS matched_dishes
    FROM topic_hits h WHERE score = (SELECT max(score) FROM topic_hits x WHERE x.topic_id = h.topic_id) GROUP BY topic_id)
"""

_SIGNALS = f""", history AS (
    SELECT s.normalized_query, s.city, count(DISTINCT s.search_id) AS searches,
        count(DISTINCT s.search_id) FILTER (WHERE result_count = 0) AS zero_result_searches,
        count(DISTINCT s.search_id) FILTER (WHERE match_type = 'fuzzy') AS fuzzy_searches,
        count(impression_id) FILTER (WHERE match_type = 'fuzzy') AS fuzzy_impressions,
        round(avg(match_score) FILTER (WHERE match_type = 'fuzzy'), 6) AS average_fuzzy_score,
        max(match_score) FILTER (WHERE match_type = 'fuzzy') AS best_fuzzy_score, max(occurred_at) AS last_seen_at
    FROM searches s LEFT JOIN impressions i USING (search_id)
    WHERE demand_source = 'explicit_search' AND occurred_at >= {ENOW} - INTERVAL 7 DAY AND (result_count = 0 OR match_type = 'fuzzy') GROUP BY ALL),
signals AS (
    SELECT h.*, {_resolution('h.normalized_query', 'h.city')},
        CASE WHEN zero_result_searches > 0 AND fuzzy_searches > 0 THEN 'zero_and_fuzzy' WHEN zero_result_searches > 0 THEN 'zero_result' ELSE 'fuzzy_only' END AS signal,
        CASE WHEN zero_result_searches > 0 THEN 'coverage_or_alias' ELSE 'alias_or_parser' END AS review_lane
    FROM history h),
legacy AS (
    SELECT search_id, normalized_query FROM searches s WHERE demand_source = 'legacy_unclassified' AND occurred_at >= {ENOW} - INTERVAL 7 DAY
    AND (result_count = 0 OR EXISTS (SELECT 1 FROM impressions i WHERE i.search_id = s.search_id AND match_type = 'fuzzy')))
"""
_QUEUE = "searches DESC, zero_result_searches DESC, fuzzy_searches DESC, last_seen_at DESC, normalized_query, lower(city)"

_ITEM_COUNTS = """, newest AS (SELECT DISTINCT ON (source_id) source_id, snapshot_id FROM snapshots ORDER BY source_id, fetched_at DESC, snapshot_id DESC),
item_counts AS (SELECT n.source_id, count(i.item_id) AS item_count FROM newest n LEFT JOIN items i USING (snapshot_id) GROUP BY n.source_id),
runs AS (SELECT DISTINCT ON (source_id) source_id, outcome AS last_outcome, error_code AS last_error_code FROM watch_runs ORDER BY source_id, started_at DESC, run_id DESC)
"""
_DEMAND = f""", restaurant_demand AS (
    SELECT restaurant_id, count(DISTINCT i.impression_id) AS impressions_7d, count(c.conversion_id) AS conversions_7d
    FROM impressions i LEFT JOIN conversions c ON c.impression_id = i.impression_id AND c.occurred_at >= {ENOW} - INTERVAL 7 DAY
    WHERE i.created_at >= {ENOW} - INTERVAL 7 DAY GROUP BY restaurant_id)
"""
_SOURCES = f"""{_ITEM_COUNTS}{_DEMAND}, schedules AS (SELECT DISTINCT ON (hours_source_id) hours_source_id, interval_count FROM hours_snapshots ORDER BY hours_source_id, fetched_at DESC, hours_snapshot_id DESC),
quality AS (
    SELECT r.restaurant_id, m.source_id, r.active, {_health('m.enabled', 'm.last_checked_at', 'm.interval_minutes', 'm.failures', 'runs.last_outcome')} AS health,
        {_health('h.enabled', 'h.last_checked_at', 'h.interval_minutes', 'h.failures', 'NULL')} AS hours_health,
        coalesce(n.item_count, 0) AS item_count, coalesce(s.interval_count, 0)::BIGINT AS interval_count, m.last_checked_at + to_minutes(greatest(m.interval_minutes * 3, 1440)) AS fresh_until,
        runs.last_outcome, runs.last_error_code, coalesce(d.impressions_7d, 0) AS impressions_7d, coalesce(d.conversions_7d, 0) AS conversions_7d
    FROM restaurants r JOIN menu_sources m USING (restaurant_id) LEFT JOIN item_counts n USING (source_id) LEFT JOIN runs USING (source_id)
    LEFT JOIN hours_sources h ON h.restaurant_id = r.restaurant_id LEFT JOIN schedules s USING (hours_source_id) LEFT JOIN restaurant_demand d ON d.restaurant_id = r.restaurant_id)
"""
_ZERO = f""", zero_history AS (
    SELECT normalized_query, city, count(*) AS count_7d, max(occurred_at) AS last_seen_at FROM searches WHERE result_count = 0 AND occurred_at >= {ENOW} - INTERVAL 7 DAY GROUP BY ALL),
zero_top AS (
    SELECT * FROM (SELECT h.*, {_resolution('h.normalized_query', 'h.city')} FROM zero_history h)
    ORDER BY current_resolution IS NULL DESC, count_7d DESC, last_seen_at DESC, normalized_query, city LIMIT 40)
"""
_HITS = f""", canonical_hits AS (
    SELECT m.concept_id, s.normalized_query, i.search_id, i.match_score FROM impressions i JOIN searches s USING (search_id) JOIN impression_items p USING (part_id)
    JOIN menu_aliases m ON m.menu_alias = p.normalized_name JOIN query_aliases q ON q.concept_id = m.concept_id AND q.query_alias = s.normalized_query
    WHERE i.match_type = 'canonical' AND i.created_at >= {ENOW} - INTERVAL 7 DAY)
"""
_MENUS = f""", turns AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, snapshot_id DESC) AS turn FROM snapshots),
menus AS (
    SELECT t.turn, t.source_id || ':' || {_source_key('i.name', 'i.section')} AS source_key, i.name, i.description, i.section, i.price_minor,
        row_number() OVER (PARTITION BY t.turn, t.source_id, {_source_key('i.name', 'i.section')} ORDER BY i.position, i.item_id) AS rn
    FROM items i JOIN turns t USING (snapshot_id) WHERE t.turn <= 2),
changes AS (
    SELECT coalesce(a.source_key, b.source_key) AS source_key, unnest(list_filter([CASE WHEN b.source_key IS NULL THEN 'added' END, CASE WHEN a.source_key IS NULL THEN 'removed' END,
        CASE WHEN a.source_key IS NOT NULL AND b.source_key IS NOT NULL AND a.price_minor IS DISTINCT FROM b.price_minor THEN 'price_changed' END,
        CASE WHEN a.source_key IS NOT NULL AND b.source_key IS NOT NULL AND (a.name, a.description, a.section) IS DISTINCT FROM (b.name, b.description, b.section) THEN 'content_changed' END], lambda k: k IS NOT NULL)) AS kind
    FROM (SELECT * FROM menus WHERE turn = 1 AND rn = 1) a FULL JOIN (SELECT * FROM menus WHERE turn = 2 AND rn = 1) b ON a.source_key = b.source_key)
"""
_CONFLICTS = f""", keyed AS (SELECT *, {_source_key('name', "''")} AS source_key FROM items),
facts AS (
    SELECT snapshot_id, source_key, count(DISTINCT {_name('name')}) AS names, count(DISTINCT {_name('section')}) AS sections, count(DISTINCT coalesce(price_minor, -1)) AS prices,
        count(DISTINCT description) AS descriptions, count(*) AS observations FROM keyed GROUP BY ALL)
"""
_WORDS = ["Ramen", "Aperol Spritz", "Chimichurri", "Velg styrke", "Allergener", "Hovedretter", "16 STK", "Fries", "Dessert", "12 cl", "Per stk", "Pommes frites", "11.", "Kaffe Latte"]
_CLOCK = "(o_orderkey % 26) || ['', ':30', '.15 pm', 'am', ' pm', ':7'][o_orderkey % 6 + 1]"
_PRICE = "['kr ', '', 'NOK', 'kr. '][p_partkey % 4 + 1] || p_size || [',-', '.5', ',25', ' kr', 'x'][p_partkey % 5 + 1]"
_COMPACT = f"regexp_replace(regexp_replace(regexp_replace({_PRICE}, '\\s+', '', 'g'), '(?i)NOK|kr\\.?', '', 'g'), ',-$', '')"
_ACCENTS = "strip_accents({x})"


def _with(*parts: str) -> str:
    return BASE + "".join(parts)


_SQL = {
    "search_exact": _with(_search("hot gear", 20), _PLAIN),
    "search_canonical": _with(_search("band", 50, city=OTHER_CITY), _PLAIN),
    "search_prefix": _with(_search("small", 30), _PLAIN),
    "search_contains": _with(_search("gear", 30), _PLAIN),
    "search_fuzzy": _with(_search("blue rng", 40), _PLAIN),
    "search_distance_sort": _with(_search("ring", 25, near=True, sort="distance"), "SELECT * FROM results"),
    "search_relevance_with_distance": _with(_search("ring", 25, near=True), "SELECT * FROM results"),
    "search_primary_results": _with(_search("red plate", 50, city=OTHER_CITY), "SELECT restaurant_id, item_id, match_type, score FROM (SELECT DISTINCT ON (restaurant_id) * FROM results WHERE match_type <> 'fuzzy' ORDER BY restaurant_id, score DESC, item_id) ORDER BY score DESC, item_id LIMIT 5"),
    "search_near_results": _with(_search("red plate", 50, city=OTHER_CITY), "SELECT item_id, score FROM results WHERE match_type = 'fuzzy'"),
    "latest_snapshot_per_source": _with("SELECT source_id, snapshot_id, fetched_at, fresh_until FROM latest"),
    "current_index_items": _with("SELECT item_id, restaurant_id, normalized_name, city, coalesce(price_minor, -1) AS price_minor FROM current_items"),
    "opening_states": _with("SELECT restaurant_id, opening_state, opening_fresh_until FROM opening"),
    "live_booking_actions": _with(f"SELECT restaurant_id, url AS booking_url FROM actions WHERE enabled AND action_type = 'booking' AND expires_at > {NOW}"),
    "restaurant_distances": _with("SELECT restaurant_id, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(59.95 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(59.95)) * pow(sin(radians(10.8 - lon) / 2), 2)))), 3) AS metres FROM restaurants"),
    "trigram_similarity_join": f"""WITH a AS (SELECT DISTINCT p_name AS t FROM part), b AS (SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || lower(p_type) AS t FROM part),
        ga AS (SELECT t, {_grams('t')} AS g FROM a), gb AS (SELECT t, {_grams('t')} AS g FROM b)
        SELECT * FROM (SELECT ga.t AS left_text, gb.t AS right_text, {_overlap('ga.g', 'gb.g')} AS similarity FROM ga, gb) WHERE similarity >= 0.3""",
    "browse_dishes": _with(_BROWSE, "SELECT * FROM catalogue"),
    "browse_quality": _with(_BROWSE, "SELECT count(*) AS raw_items, count(*) FILTER (WHERE class0 = 'dish') AS valid_items, count(*) FILTER (WHERE class0 <> 'dish') AS excluded_items, count(*) FILTER (WHERE class0 = 'dish') - count(DISTINCT identity) FILTER (WHERE class0 = 'dish') AS deduplicated_items, "
        + ", ".join(f"count(*) FILTER (WHERE class0 = '{c}') AS {c}" for c in ("beverage", "sauce_or_side", "modifier", "allergen_or_information", "menu_heading", "invalid_fragment")) + " FROM browse_rows"),
    "classify_items": f"""WITH n AS (SELECT p_partkey, {_list(_WORDS)}[p_partkey % 14 + 1] || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END AS name,
        CASE WHEN p_partkey % 11 = 0 THEN 'Drinks' WHEN p_partkey % 13 = 0 THEN 'Tilbehor' END AS section, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS price FROM part)
        SELECT p_partkey, name, {_class('name', 'section', "''", 'price')} AS class FROM n""",
    "canonical_dish_identity": f"""WITH n AS (SELECT p_partkey, ' ' || p_partkey || '. ' || CASE WHEN p_partkey % 5 = 0 THEN 'Margerita' ELSE p_name END || CASE WHEN p_partkey % 2 = 0 THEN ' (A, B)' ELSE ' 4 stk' END AS name FROM part)
        SELECT p_partkey, {_canonical('name')} AS canonical, {_identity('name')} AS identity FROM n""",
    "topic_coverage": _with(_BROWSE, "SELECT * FROM covered"),
    "topic_ranking": _with(_BROWSE, """SELECT topic_id, area, label, coalesce(restaurant_count, 0) AS restaurant_count,
        row_number() OVER (PARTITION BY area ORDER BY coalesce(restaurant_count, 0) > 0 DESC, coalesce(restaurant_count, 0) DESC, priority DESC, label, topic_id)::INTEGER AS place FROM topics LEFT JOIN covered USING (topic_id)"""),
    "knowledge_lookup": _with("SELECT DISTINCT i.normalized_name AS text, c.concept_slug AS entry_id FROM impression_items i JOIN concepts c ON i.normalized_name IN (lower(c.canonical_name), c.concept_normalized) OR EXISTS (SELECT 1 FROM aliases a WHERE a.concept_id = c.concept_id AND a.alias = i.normalized_name)"),
    "demand_signals": _with(_SIGNALS, "SELECT * FROM signals"),
    "demand_queue": _with(_SIGNALS, f"SELECT * FROM signals WHERE current_resolution IS NULL ORDER BY {_QUEUE} LIMIT 20"),
    "demand_resolved_queue": _with(_SIGNALS, f"SELECT * FROM signals WHERE current_resolution IS NOT NULL ORDER BY {_QUEUE} LIMIT 20"),
    "demand_totals": _with(_SIGNALS, """SELECT coalesce(sum(searches), 0)::BIGINT AS explicit_searches, coalesce(sum(searches) FILTER (WHERE current_resolution IS NULL), 0)::BIGINT AS unresolved_searches,
        coalesce(sum(searches) FILTER (WHERE current_resolution IS NOT NULL), 0)::BIGINT AS resolved_searches, least(count(*) FILTER (WHERE current_resolution IS NULL), 20) AS queue_size, (SELECT count(*) FROM legacy) AS legacy_searches FROM signals"""),
    "legacy_signal_searches": _with(_SIGNALS, "SELECT * FROM legacy"),
    "quality_sources": _with(_SOURCES, "SELECT * FROM quality"),
    "quality_totals": _with(_SOURCES, """SELECT count(DISTINCT restaurant_id) FILTER (WHERE active) AS active_restaurants, count(DISTINCT restaurant_id) FILTER (WHERE NOT active) AS candidate_restaurants, count(*) AS menu_sources,
        count(*) FILTER (WHERE health = 'healthy') AS healthy_sources, count(*) FILTER (WHERE health NOT IN ('healthy', 'disabled')) AS degraded_sources, sum(item_count)::BIGINT AS current_items FROM quality"""),
    "zero_result_queries": _with(_ZERO, "SELECT * FROM zero_top"),
    "unresolved_zero_results": _with(_ZERO, "SELECT coalesce(sum(count_7d) FILTER (WHERE current_resolution IS NULL), 0)::BIGINT AS unresolved_zero_results FROM zero_top"),
    "weekly_counts": _with(f"SELECT (SELECT count(*) FROM searches WHERE result_count = 0 AND occurred_at >= {ENOW} - INTERVAL 7 DAY) AS zero_result_searches, (SELECT count(*) FROM conversions WHERE occurred_at >= {ENOW} - INTERVAL 7 DAY) AS conversions"),
    "match_type_pivot": _with("SELECT " + ", ".join(f"count(*) FILTER (WHERE match_type = '{m}') AS {m}_7d" for m in MATCH_TYPES) + f", count(*) AS impressions_7d FROM impressions WHERE created_at >= {ENOW} - INTERVAL 7 DAY"),
    "concept_coverage": _with(_HITS, """SELECT concept_slug, canonical_name,
        coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM aliases a WHERE a.concept_id = c.concept_id AND scope IN ('query', 'both')), '') AS query_aliases,
        coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM aliases a WHERE a.concept_id = c.concept_id AND scope IN ('menu', 'both')), '') AS menu_aliases,
        (SELECT count(DISTINCT i.item_id) FROM stale_latest l JOIN items i USING (snapshot_id) JOIN menu_aliases m ON m.menu_alias = i.normalized_name WHERE m.concept_id = c.concept_id) AS item_matches,
        (SELECT count(*) FROM canonical_hits h WHERE h.concept_id = c.concept_id) AS impressions_7d FROM concepts c WHERE concept_active"""),
    "canonical_queries": _with(_HITS, "SELECT normalized_query, concept_slug, count(DISTINCT search_id) AS searches_7d, count(*) AS impressions_7d, round(avg(match_score), 6) AS average_score FROM canonical_hits JOIN concepts USING (concept_id) WHERE concept_active GROUP BY ALL ORDER BY searches_7d DESC, impressions_7d DESC, normalized_query, concept_slug LIMIT 20"),
    "fuzzy_queries": _with(f""", fuzzy_history AS (
        SELECT normalized_query, city, count(DISTINCT search_id) AS searches_7d, count(*) AS impressions_7d, round(avg(match_score), 6) AS average_score, max(match_score) AS best_score
        FROM impressions JOIN searches USING (search_id) WHERE match_type = 'fuzzy' AND created_at >= {ENOW} - INTERVAL 7 DAY GROUP BY ALL)
        SELECT * FROM (SELECT h.*, {_resolution('h.normalized_query', 'h.city')} FROM fuzzy_history h) ORDER BY current_resolution IS NULL DESC, searches_7d DESC, average_score DESC, normalized_query, city LIMIT 40"""),
    "latest_item_counts": _with(_ITEM_COUNTS, "SELECT * FROM item_counts"),
    "latest_watch_runs": _with(_ITEM_COUNTS, "SELECT * FROM runs"),
    "restaurant_demand": _with(_DEMAND, "SELECT * FROM restaurant_demand"),
    "action_statuses": _with(f"SELECT restaurant_id, action_type, enabled, expires_at, CASE WHEN NOT enabled THEN 'disabled' WHEN expires_at <= {NOW} THEN 'expired' WHEN expires_at <= {NOW} + INTERVAL 7 DAY THEN 'expiring' ELSE 'verified' END AS status FROM actions"),
    "owner_funnel": _with(f""", scope AS (SELECT impression_id, restaurant_id FROM impressions WHERE created_at >= {ENOW} - INTERVAL 30 DAY),
        own AS (SELECT s.restaurant_id, c.impression_id, c.event_type FROM conversions c JOIN scope s USING (impression_id) WHERE c.occurred_at >= {ENOW} - INTERVAL 30 DAY)
        SELECT r.restaurant_id, impressions, (SELECT count(*) FROM own o WHERE o.restaurant_id = r.restaurant_id) AS clicks, """
        + ", ".join(f"(SELECT count(*) FROM own o WHERE o.restaurant_id = r.restaurant_id AND event_type = '{k}') AS {k}" for k in CLICKS)
        + """, (SELECT count(DISTINCT impression_id) FROM own o WHERE o.restaurant_id = r.restaurant_id) AS engaged, round((SELECT count(DISTINCT impression_id) FROM own o WHERE o.restaurant_id = r.restaurant_id) / impressions::DOUBLE, 6) AS ctr
        FROM (SELECT restaurant_id, count(*) AS impressions FROM scope GROUP BY restaurant_id) r"""),
    "owner_top_dishes": _with(f""", a AS (SELECT restaurant_id, part_id, count(*) AS impressions FROM impressions WHERE created_at >= {ENOW} - INTERVAL 30 DAY GROUP BY ALL),
        b AS (SELECT restaurant_id, part_id, count(*) AS clicks FROM conversions c JOIN impressions i USING (impression_id) WHERE c.occurred_at >= {ENOW} - INTERVAL 30 DAY GROUP BY ALL),
        j AS (SELECT a.restaurant_id, part_id, p.name, impressions, coalesce(clicks, 0) AS clicks FROM a JOIN impression_items p USING (part_id) LEFT JOIN b USING (restaurant_id, part_id))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY impressions DESC, clicks DESC, name, part_id)::INTEGER AS place FROM j) WHERE place <= 10"""),
    "owner_menu_sources": _with("""SELECT m.restaurant_id, m.source_id, m.url, m.enabled, m.last_checked_at, m.last_checked_at + to_minutes(greatest(m.interval_minutes * 3, 1440)) AS fresh_until, m.failures,
        (SELECT outcome FROM watch_runs w WHERE w.source_id = m.source_id ORDER BY started_at DESC, run_id DESC LIMIT 1) AS latest_outcome FROM menu_sources m"""),
    "owner_actions": _with(f"SELECT restaurant_id, action_type, enabled, verified_at, expires_at, enabled AND expires_at > {NOW} AS publishable FROM actions"),
    "owner_city_gaps": _with(_SIGNALS, f""", queue AS (SELECT *, lower(city) AS place_city FROM signals WHERE current_resolution IS NULL ORDER BY {_QUEUE} LIMIT 20)
        SELECT place_city, normalized_query, searches, signal FROM (SELECT *, row_number() OVER (PARTITION BY place_city ORDER BY {_QUEUE}) AS rn FROM queue) WHERE rn <= 5 AND searches >= 3"""),
    "snapshot_diff": _with(_MENUS, "SELECT source_key, kind FROM changes"),
    "snapshot_diff_counts": _with(_MENUS, "SELECT kind, count(*) AS changes FROM changes GROUP BY kind"),
    "menu_fingerprints": _with(""", entries AS (
        SELECT snapshot_id, normalized_name AS n, section AS s, coalesce(price_minor, 100) AS p, '{"name":"' || normalized_name || '","description":"' || description || '","sectionName":"' || section || '","priceMinor":' || coalesce(price_minor, 100)
            || ',"currency":"NOK"' || CASE WHEN position = 7 THEN ',"priceKind":"from"' ELSE '' END || '}' AS w FROM items)
        SELECT snapshot_id, sha256('[' || string_agg(w, ',' ORDER BY n, lower(s), p, w) || ']') AS fingerprint FROM entries GROUP BY snapshot_id"""),
    "extraction_gate": _with(""", counts AS (SELECT s.source_id, s.snapshot_id, s.fetched_at, count(i.item_id) AS n FROM snapshots s LEFT JOIN items i USING (snapshot_id) GROUP BY ALL),
        seen AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY source_id ORDER BY fetched_at, snapshot_id), 0) AS previous FROM counts)
        SELECT snapshot_id, CASE WHEN n < minimum_items THEN 'below_minimum' WHEN previous >= 8 AND n < ceil(previous * 0.5) THEN 'suspicious_drop' ELSE 'ok' END AS code FROM seen JOIN menu_sources USING (source_id)"""),
    "price_violations": """WITH p AS (SELECT ['exact', 'from', 'multiple', 'other'][l_linenumber % 4 + 1] AS k, CASE WHEN l_suppkey % 5 <> 0 THEN round(l_extendedprice * 100)::BIGINT END AS a, CASE WHEN l_partkey % 3 = 0 THEN round(l_quantity * 100000)::BIGINT END AS b FROM lineitem)
        SELECT CASE WHEN k = 'other' THEN 'unknown_kind' WHEN k = 'exact' AND b IS NOT NULL THEN 'exact_with_maximum' WHEN k = 'from' AND a IS NULL THEN 'from_without_price' WHEN k = 'from' AND b IS NOT NULL THEN 'from_with_maximum'
            WHEN k = 'multiple' AND (a IS NULL OR b IS NULL) THEN 'multiple_without_range' WHEN k = 'multiple' AND b < a THEN 'maximum_below_price' END AS violation, count(*) AS rows FROM p GROUP BY 1""",
    "source_key_conflicts": _with(_CONFLICTS, "SELECT * FROM facts WHERE names > 1 OR sections > 1 OR prices > 1 OR descriptions > 1"),
    "source_key_winners": _with(_CONFLICTS, """SELECT snapshot_id, source_key, item_id FROM (
        SELECT k.*, row_number() OVER (PARTITION BY k.snapshot_id, k.source_key ORDER BY k.confidence DESC, length(k.name) DESC, k.position, k.item_id) AS rn
        FROM keyed k JOIN facts f USING (snapshot_id, source_key) WHERE names = 1 AND sections = 1 AND prices = 1 AND descriptions = 1) WHERE rn = 1"""),
    "due_sources": _with(f"SELECT source_id, next_check_at FROM menu_sources WHERE enabled AND next_check_at <= {NOW} ORDER BY next_check_at, source_id LIMIT 25"),
    "expiring_actions": _with(f"SELECT restaurant_id, action_type, expires_at FROM actions WHERE enabled AND expires_at <= {NOW} + INTERVAL 7 DAY ORDER BY expires_at, restaurant_id, action_type LIMIT 50"),
    "next_checks_after_failure": _with(f"SELECT source_id, {NOW} + to_minutes(least(1440, interval_minutes * 2)) AS menu_next, {NOW} + to_minutes(least(120, interval_minutes)) AS hours_next FROM menu_sources"),
    "upserted_orders": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "idempotent_conversions": _with("""SELECT DISTINCT ON (client_event_id) client_event_id, conversion_id, event_type FROM conversions c WHERE occurred_at >= TIMESTAMP '2024-01-05'
        AND NOT EXISTS (SELECT 1 FROM conversions s WHERE s.client_event_id = c.client_event_id AND s.occurred_at < TIMESTAMP '2024-01-10') ORDER BY client_event_id, conversion_id"""),
    "conditional_updates": _with(""", fresh AS (SELECT source_id, source_id % 3 <> 0 AS enabled, CASE WHEN source_id % 2 = 0 THEN last_checked_at END AS last_checked_at FROM menu_sources)
        SELECT f.source_id, f.enabled, f.last_checked_at FROM menu_sources m JOIN fresh f USING (source_id) WHERE m.enabled IS DISTINCT FROM f.enabled OR m.last_checked_at IS DISTINCT FROM f.last_checked_at"""),
    "authority_switch": """SELECT o_custkey AS restaurant_id, o_orderkey AS source_id FROM orders o WHERE CASE WHEN o_custkey % 2 = 0 THEN o_orderkey = (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey) ELSE o_orderstatus = 'F' END""",
    "replaced_sets": """WITH r AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS origin FROM orders), f AS (SELECT owner, 'replaced' AS origin FROM r WHERE owner % 3 = 0 AND origin = '1-URGENT')
        SELECT owner, origin FROM r WHERE owner NOT IN (SELECT owner FROM f) UNION ALL SELECT owner, origin FROM f""",
    "merged_by_name": _with("SELECT DISTINCT snapshot_id // 2 AS g, normalized_name FROM items"),
    "orders_without_items": _with("SELECT DISTINCT snapshot_id FROM snapshots WHERE snapshot_id NOT IN (SELECT snapshot_id FROM items)"),
    "sampled_items": _with(""", placed AS (SELECT snapshot_id, item_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY snapshot_id) AS n FROM items WINDOW w AS (PARTITION BY snapshot_id ORDER BY position, item_id))
        SELECT snapshot_id, item_id FROM placed WHERE n <= 5 OR i IN (SELECT floor(k * (n - 1) / 4.0 + 0.5)::BIGINT FROM range(5) AS t(k))"""),
    "explicit_order": _with("SELECT restaurant_id, name, list_position([9, 3, 77, 5, 1], restaurant_id)::BIGINT AS place FROM restaurants WHERE restaurant_id IN (9, 3, 77, 5, 1)"),
    "values_join": "SELECT meaning, count(*) AS orders FROM orders JOIN (VALUES ('F', 'done'), ('O', 'open'), ('X', 'never')) AS v(code, meaning) ON o_orderstatus = code GROUP BY meaning",
    "parallel_arrays": _with("SELECT search_id, rank, impression_id, match_type FROM impressions"),
    "forced_reextract": _with("SELECT hours_snapshot_id FROM hours_snapshots WHERE extractor IS DISTINCT FROM 'v1'"),
    "hours_observation_outcomes": _with(""", seen AS (SELECT *, lag(interval_count) OVER w AS previous, lag(fingerprint) OVER w AS old_print, lag(extractor) OVER w AS old_version FROM hours_snapshots WINDOW w AS (PARTITION BY hours_source_id ORDER BY fetched_at, hours_snapshot_id))
        SELECT hours_snapshot_id, hours_source_id, CASE WHEN interval_count < greatest(minimum_intervals, coalesce(ceil(previous * 0.5), 0)) THEN 'quarantined' WHEN fingerprint IS NOT DISTINCT FROM old_print AND extractor IS NOT DISTINCT FROM old_version THEN 'unchanged'
            WHEN fingerprint IS NOT DISTINCT FROM old_print THEN 'reextracted' ELSE 'changed' END AS outcome FROM seen JOIN hours_sources USING (hours_source_id)"""),
    "hours_verification_log": _with("SELECT slug, verification_status, last_checked_at FROM hours_sources JOIN restaurants USING (restaurant_id) WHERE verification_status <> 'verified'"),
    "claim_states": """SELECT c_custkey AS restaurant_id, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN 'claimed' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'under_review' ELSE 'unclaimed' END AS claim_state FROM customer""",
    "pending_claims": "SELECT o_orderkey AS claim_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100",
    "saved_items": """WITH l AS (SELECT DISTINCT ON (user_id, event_id % 40) user_id AS subject, event_id % 40 AS item_id, event_type, ts, event_id AS log_id FROM events ORDER BY user_id, event_id % 40, ts DESC, event_id DESC)
        SELECT subject, item_id, log_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, log_id DESC) AS place FROM l WHERE event_type <> 'error') WHERE place <= 50""",
    "catalogue_proof": _with(_ITEM_COUNTS, """SELECT r.slug, n.snapshot_id, runs.last_outcome AS latest_outcome, coalesce(c.item_count, 0) AS item_count, coalesce(r.active AND m.enabled AND n.snapshot_id IS NOT NULL AND coalesce(c.item_count, 0) >= m.minimum_items, false) AS complete
        FROM restaurants r LEFT JOIN menu_sources m USING (restaurant_id) LEFT JOIN newest n USING (source_id) LEFT JOIN runs USING (source_id) LEFT JOIN item_counts c USING (source_id)"""),
    "recorded_funnel": _with("SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY match_score DESC, impression_id)::INTEGER AS rank, part_id AS item_id, match_type, match_score AS score FROM impressions"),
    "duplicate_line_keys": "SELECT l_orderkey || '-' || l_linenumber AS line_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "normalised_documents": f"SELECT doc_id, {_name('text')} AS normalised FROM documents",
    "discovery_normalised_benchmark": "SELECT item_id, " + _DISC.format(x=_ACCENTS.format(x="text")) + " AS normalised FROM benchmark",
    "parsed_prices": f"""WITH p AS (SELECT p_partkey, {_PRICE} AS written, {_COMPACT} AS c FROM part),
        m AS (SELECT *, CASE WHEN regexp_full_match(c, '\\d{{1,5}}(?:[.,]\\d{{1,2}})?') THEN regexp_extract(c, '^(\\d+)', 1)::BIGINT * 100 + rpad(regexp_extract(c, '[.,](\\d+)$', 1), 2, '0')::BIGINT END AS minor FROM p)
        SELECT p_partkey, written, coalesce(minor, -1) AS minor, coalesce(minor BETWEEN 1000 AND 4000, false) AS plausible FROM m""",
    "split_names": "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS description FROM part",
    "description_parts": "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS parts FROM (SELECT p_partkey, list_filter([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_brand, p_type], lambda x: length(x) >= 2) AS list_distinct_ordered FROM part)",
    "price_labels": """WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 100 + CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 0 END END AS m FROM part),
        w AS (SELECT *, CASE WHEN m % 100 = 0 THEN (m // 100)::VARCHAR ELSE format('{:.2f}', m / 100.0) END AS a, CASE WHEN (m + 1000) % 100 = 0 THEN ((m + 1000) // 100)::VARCHAR ELSE format('{:.2f}', (m + 1000) / 100.0) END AS b FROM p)
        SELECT p_partkey, CASE WHEN m IS NULL THEN NULL WHEN k = 2 THEN 'kr ' || a || '-' || b WHEN k = 1 THEN 'fra kr ' || a ELSE 'kr ' || a END AS label FROM w""",
    "clock_minutes": f"""WITH w AS (SELECT DISTINCT {_CLOCK} AS written FROM orders), n AS (SELECT written, regexp_replace(replace(written, '.', ':'), '\\s+', '', 'g') AS c FROM w),
        p AS (SELECT written, regexp_full_match(c, '\\d{{1,2}}(:[0-5]\\d)?(am|pm)?') AS ok, regexp_extract(c, '^(\\d+)', 1)::INTEGER AS h, coalesce(try_cast(regexp_extract(c, ':(\\d\\d)', 1) AS INTEGER), 0) AS m, regexp_extract(c, '(am|pm)$', 1) AS half FROM n)
        SELECT written, coalesce(CASE WHEN NOT ok THEN NULL WHEN half = '' THEN CASE WHEN h <= 23 THEN h * 60 + m END WHEN h BETWEEN 1 AND 12 THEN (h % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END) * 60 + m END, -1) AS minute FROM p""",
    "weekday_ranges": """WITH d AS (SELECT DISTINCT (o_orderkey % 7 + 1)::INTEGER AS first, (o_custkey % 7 + 1)::INTEGER AS last FROM orders)
        SELECT first, last, array_to_string(list_transform(range(0, (last - first + 7) % 7 + 1), lambda i: (first - 1 + i) % 7 + 1), ',') AS days FROM d""",
    "kitchen_cutoffs": _with("SELECT hours_snapshot_id, iso_weekday, (closes - 30 + 1440) % 1440 AS kitchen_closes FROM hours_intervals"),
    "line_sections": """SELECT conv_id, turn AS pos, coalesce(last_value(CASE WHEN role = 'system' THEN 'system' WHEN length(text) > 200 THEN 'long' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS section FROM conversations""",
    "nearest_short_line": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        n AS (SELECT doc_id, last_value(CASE WHEN length(line) < 40 THEN length(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS short_length FROM l WHERE trim(line) <> '')
        SELECT doc_id, count(*) AS lines, coalesce(sum(short_length), 0)::BIGINT AS short_total FROM n GROUP BY doc_id""",
}

# What manifests ask of their items, and what is missing.
_VARIANTS = """, priced AS (
    SELECT snapshot_id AS manifest_id, normalized_name, lower(section) AS sec, price_minor, CASE position WHEN 2 THEN 'from' WHEN 3 THEN 'multiple' END AS kind, CASE WHEN position = 3 THEN price_minor + 100 END AS top, position FROM items),
asked AS (
    SELECT DISTINCT manifest_id, normalized_name, CASE WHEN manifest_id % 2 = 0 THEN sec END AS sec, price_minor + CASE WHEN manifest_id % 3 = 0 THEN 1 ELSE 0 END AS price_minor,
        CASE WHEN manifest_id % 5 = 0 THEN 'exact' ELSE kind END AS kind, top FROM priced WHERE position IN (2, 3)),
absent AS (
    SELECT manifest_id, normalized_name || coalesce(' [' || sec || ']', '') || coalesce(' @ ' || price_minor, '') || coalesce(' ' || kind, '') || coalesce('..' || top, '') AS label FROM asked a
    WHERE NOT EXISTS (SELECT 1 FROM priced p WHERE p.manifest_id = a.manifest_id AND p.normalized_name = a.normalized_name AND (a.sec IS NULL OR p.sec = a.sec) AND p.price_minor = a.price_minor
        AND coalesce(p.kind, 'exact') = a.kind AND (a.top IS NULL OR p.top = a.top)))
"""
# A failed validation belongs to the families of its menu, its blocking hours and its actions.
_WIRE = "(?i)http\\s+[45]\\d\\d|fetch|network|socket|timeout|timed out|econn|enotfound|dns|tls|certificate|redirect"
_READING = "(?i)extract|no menu|empty menu|source declared|unsupported source"
_PASSING = "(?i)pdf source did not start with a pdf signature|unexpectedly returned http 304|temporary|temporarily unavailable|connection reset|aborted due to timeout"
_VALIDATIONS = f"""WITH v AS (
    SELECT o_orderkey AS id, o_orderstatus = 'F' AS menu, o_orderkey % 7 = 0 AS checked, ['HTTP 503', 'No menu found', 'Temporarily unavailable', 'socket hang up', 'odd', NULL, 'Source declared json_ld', 'HTTP 304'][o_orderkey % 8 + 1] AS menu_error,
        o_orderkey % 3 = 0 AS blocking, o_orderkey % 4 <> 0 AS hours, ['TLS handshake', 'no intervals', NULL, 'DNS'][(o_orderkey // 7) % 4 + 1] AS hours_error, o_orderkey % 5 = 0 AS action, CASE WHEN o_orderkey % 10 = 0 THEN 'Connection reset' END AS action_error FROM orders),
f AS (
    SELECT *, CASE WHEN id % 97 = 0 THEN ['manifest'] WHEN menu AND hours AND NOT action THEN [] ELSE list_filter([
        CASE WHEN menu THEN NULL WHEN checked THEN 'menu_assertions' WHEN regexp_matches(coalesce(menu_error, ''), '{_WIRE}') THEN 'transport' WHEN regexp_matches(coalesce(menu_error, ''), '{_READING}') THEN 'extraction' ELSE 'unknown' END,
        CASE WHEN blocking AND NOT hours THEN CASE WHEN regexp_matches(coalesce(hours_error, ''), '{_WIRE}') THEN 'transport' ELSE 'hours' END END,
        CASE WHEN action THEN 'action' END], lambda x: x IS NOT NULL) END AS given FROM v),
tagged AS (
    SELECT id, CASE WHEN id % 97 <> 0 AND NOT (menu AND hours AND NOT action) AND len(given) = 0 THEN ['unknown'] WHEN len(given) > 1 AND given[1] = given[2] THEN given[2:] ELSE given END AS families,
        concat_ws(' | ', menu_error, CASE WHEN blocking THEN hours_error END, action_error) AS errors FROM f),
judged AS (
    SELECT *, NOT list_has_any(families, ['menu_assertions', 'hours', 'extraction']) AND (list_has_any(families, ['transport', 'action']) OR list_contains(families, 'unknown') AND regexp_matches(errors, '{_PASSING}')) AS again FROM tagged)
"""
# Blocks of addresses that are not public.
_BLOCKS = "('0.0.0.0', 8), ('10.0.0.0', 8), ('100.64.0.0', 10), ('127.0.0.0', 8), ('169.254.0.0', 16), ('172.16.0.0', 12), ('192.0.0.0', 24), ('192.0.2.0', 24), ('192.31.196.0', 24), ('192.52.193.0', 24), ('192.88.99.0', 24), ('192.168.0.0', 16), ('192.175.48.0', 24), ('198.18.0.0', 15), ('198.51.100.0', 24), ('203.0.113.0', 24), ('224.0.0.0', 4), ('240.0.0.0', 4)"
_PUBLIC = [5, 8, 9, 12, 16]  # of the listed spellings: a name, an address in three notations, a name in capitals
_HAND_OFF = "WITH saved AS (" + _SQL["saved_items"] + ") SELECT subject, string_agg(item_id::VARCHAR, ',' ORDER BY place) AS items FROM saved GROUP BY subject"
_SQL |= {
    "manifest_gate": _with(_VARIANTS, """, c AS (SELECT s.snapshot_id AS manifest_id, (s.snapshot_id % 6)::INTEGER AS minimum_items, 2 - count(DISTINCT normalized_name) FILTER (WHERE normalized_name IN ('hot gear', 'red rod')) AS names,
        count(DISTINCT normalized_name) FILTER (WHERE normalized_name = 'blue ring') AS forbidden_present, count(i.item_id) AS item_count FROM snapshots s LEFT JOIN items i USING (snapshot_id) GROUP BY ALL),
        m AS (SELECT c.* EXCLUDE (names), names + (SELECT count(*) FROM absent a WHERE a.manifest_id = c.manifest_id) AS missing_required FROM c)
        SELECT *, missing_required = 0 AND forbidden_present = 0 AND item_count >= minimum_items AS accepted FROM m"""),
    "missing_variants": _with(_VARIANTS, "SELECT manifest_id, label FROM absent"),
    "failure_families": _VALIDATIONS + "SELECT id AS validation_id, array_to_string(families, ',') AS families, again FROM judged",
    "failure_rollup": _VALIDATIONS + """, e AS (SELECT unnest(families) AS family, again FROM judged)
        SELECT n.family, count(e.family) AS failures, count(*) FILTER (WHERE e.again) AS retryable FROM (VALUES ('manifest'), ('transport'), ('extraction'), ('menu_assertions'), ('hours'), ('action'), ('unknown')) AS n(family) LEFT JOIN e USING (family) GROUP BY n.family""",
    "onboarding_outcomes": _with(""", w AS (SELECT source_id AS restaurant_id, outcome, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS turn FROM watch_runs),
        g AS (SELECT restaurant_id, coalesce(bool_or(outcome IN ('changed', 'unchanged', 'not_modified')) FILTER (WHERE turn = 1), false) AS a, coalesce(bool_or(outcome IN ('changed', 'unchanged', 'not_modified')) FILTER (WHERE turn = 2), false) AS b FROM w GROUP BY restaurant_id),
        s AS (SELECT r.restaurant_id, r.active, CASE WHEN NOT coalesce(a, false) THEN 'first_watch' WHEN NOT coalesce(b, false) THEN 'second_watch' WHEN r.restaurant_id % 6 = 0 THEN 'assertions' WHEN r.restaurant_id % 4 = 0 AND r.restaurant_id % 8 <> 0 THEN 'hours' END AS step FROM restaurants r LEFT JOIN g USING (restaurant_id))
        SELECT restaurant_id, CASE WHEN step IS NULL THEN CASE WHEN active THEN 'already_published' ELSE 'published' END WHEN active AND restaurant_id % 5 <> 0 THEN 'restored' ELSE 'failed' END AS outcome, step FROM s"""),
    "active_grants": "SELECT s_suppkey AS grant_id, make_timestamp(2000, s_nationkey % 12 + 1, 1, 0, 0, 0) AS granted_at FROM supplier WHERE s_acctbal >= 0 ORDER BY s_nationkey % 12, s_suppkey LIMIT 50",
    "saved_item_hand_off": _HAND_OFF,
    "stale_hours_observations": _with(", seen AS (SELECT *, max(fetched_at) OVER (PARTITION BY hours_source_id ORDER BY hours_snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS checked FROM hours_snapshots) SELECT hours_snapshot_id, hours_source_id FROM seen WHERE fetched_at < checked"),
    "hours_watch_summary": _with(""", r AS (SELECT ['changed', 'quarantined', 'unchanged', 'fetch_error', 'unexpected_error', 'extraction_error'][hours_source_id % 6 + 1] AS outcome, CASE WHEN hours_source_id % 11 <> 0 THEN verification_status END AS status FROM hours_sources),
        f AS (SELECT outcome NOT IN ('changed', 'unchanged') AS failed, status = 'provisional' AND outcome <> 'unexpected_error' AS lenient FROM r)
        SELECT count(*) AS due, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE failed AND NOT coalesce(lenient, false)) AS blocking_failed, count(*) FILTER (WHERE failed AND lenient) AS non_blocking_failed FROM f"""),
    "browse_order": _with(_BROWSE, "SELECT identity, dish_name FROM catalogue ORDER BY lower(dish_name), identity LIMIT 30"),
    "topic_examples": _with(_BROWSE, """, named AS (SELECT h.topic_id, c.dish_name, c.identity, unnest(string_split(c.restaurant_examples, ',')) AS restaurant, generate_subscripts(string_split(c.restaurant_examples, ','), 1) AS nth
            FROM topic_hits h JOIN catalogue c USING (identity) WHERE h.score = (SELECT max(score) FROM topic_hits x WHERE x.topic_id = h.topic_id)),
        turns AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY lower(dish_name), identity, nth) AS turn FROM named),
        listed AS (SELECT topic_id, restaurant, min(turn) AS turn FROM turns GROUP BY ALL), two AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY turn) AS place FROM listed)
        SELECT topic_id, string_agg(restaurant, ',' ORDER BY turn) AS examples FROM two WHERE place <= 2 GROUP BY topic_id"""),
    "topic_preview": "WITH ranked AS (" + _SQL["topic_ranking"] + """),
        listed AS (SELECT *, list_position(['south', 'east', 'north'], area) AS area_place FROM ranked WHERE place <= 2),
        own AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY area_place, place) AS turn FROM listed),
        counted AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY place, topic_id)::INTEGER AS shown FROM own WHERE turn = 1)
        SELECT area, topic_id, label, restaurant_count, shown FROM counted WHERE shown <= 1""",
    "quality_report": _with(_SOURCES, _ZERO, f""", own AS (SELECT DISTINCT restaurant_id, hours_health, interval_count FROM quality),
        t AS (SELECT count(DISTINCT restaurant_id) FILTER (WHERE active) AS active_restaurants, count(DISTINCT restaurant_id) FILTER (WHERE NOT active) AS candidate_restaurants, count(*) AS menu_sources,
            count(*) FILTER (WHERE health = 'healthy') AS healthy_sources, count(*) FILTER (WHERE health NOT IN ('healthy', 'disabled')) AS degraded_sources, sum(item_count)::BIGINT AS current_items FROM quality),
        w AS (SELECT (SELECT count(*) FROM searches WHERE result_count = 0 AND occurred_at >= {ENOW} - INTERVAL 7 DAY) AS zero_result_searches, (SELECT count(*) FROM conversions WHERE occurred_at >= {ENOW} - INTERVAL 7 DAY) AS conversions,
            (SELECT coalesce(sum(count_7d) FILTER (WHERE current_resolution IS NULL), 0)::BIGINT FROM zero_top) AS unresolved_zero_results),
        k AS (SELECT """ + ", ".join(f"count(*) FILTER (WHERE match_type = '{m}') AS {m}_7d" for m in MATCH_TYPES) + f""", count(*) AS impressions_7d FROM impressions WHERE created_at >= {ENOW} - INTERVAL 7 DAY),
        h AS (SELECT """ + ", ".join(f"count(*) FILTER (WHERE hours_health = '{x}') AS hours_{x}" for x in ("healthy", "degraded", "stale", "unverified", "disabled")) + """, sum(interval_count)::BIGINT AS intervals FROM own),
        s AS (SELECT """ + f"CASE WHEN NOT enabled THEN 'disabled' WHEN expires_at <= {NOW} THEN 'expired' WHEN expires_at <= {NOW} + INTERVAL 7 DAY THEN 'expiring' ELSE 'verified' END AS status FROM actions),"
        + " a AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS actions_{x}" for x in ("verified", "expiring", "expired", "disabled")) + " FROM s) SELECT * FROM t, w, k, h, a"),
    "public_addresses": f"""WITH o AS (SELECT p_partkey, (((p_partkey * 37 + p_size) % 256) * 16777216 + ((p_partkey * 101) % 256) * 65536 + ((p_partkey * 13) % 256) * 256 + p_partkey % 256)::BIGINT AS n FROM part),
        blocks(base, width) AS (VALUES {_BLOCKS}), b AS (SELECT (string_split(base, '.')[1]::BIGINT * 16777216 + string_split(base, '.')[2]::BIGINT * 65536 + string_split(base, '.')[3]::BIGINT * 256) AS low, 1::BIGINT << (32 - width) AS size FROM blocks)
        SELECT p_partkey, NOT EXISTS (SELECT 1 FROM b WHERE n >= low AND n < low + size) AS dotted, NOT EXISTS (SELECT 1 FROM b WHERE n >= low AND n < low + size) AS numeric FROM o""",
    "public_url_spellings": f"SELECT n::BIGINT AS n, n IN ({', '.join(map(str, _PUBLIC))}) AS public FROM range(18) AS t(n)",
    "json_kinds": """WITH j AS (SELECT event_id, props, ['[1, 2]', '"text"', '1.5', 'true', 'null', '{', '{}'][event_id % 7 + 1] AS odd FROM events)
        SELECT event_id, CASE WHEN json_valid(props) THEN lower(json_type(props)) END AS whole, CASE event_id % 7 WHEN 0 THEN 'array' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' WHEN 4 THEN 'null' WHEN 6 THEN 'object' END AS odd FROM j""",
}

# A "small plate" is a section label to the menu reader and never a dish.
_DISHES = """WITH dishes AS (SELECT l_orderkey AS snapshot_id, p_name AS name, 40 + max(l_partkey) % 900 AS kr FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
"""
_SCRIPTS = ["Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai"]
_SQL |= {
    "public_urls": r"""WITH h AS (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '^[a-z]+://(?:[^/?#]*@)?([^/:?#]+)', 1) AS host FROM pages)
        SELECT page_id, regexp_matches(u, '^https?://') AND NOT regexp_matches(u, '^[a-z]+://[^/?#]*@') AND host <> '' AND host <> 'localhost' AND NOT regexp_matches(host, '[.](localhost|local|internal)$')
            AND NOT regexp_matches(host, '^((0|10|127|22[4-9]|2[3-5][0-9])[.][0-9.]+|192[.]168[.][0-9.]+|169[.]254[.][0-9.]+|172[.](1[6-9]|2[0-9]|3[01])[.][0-9.]+|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.][0-9.]+)$') AS public FROM h""",
    "dominant_scripts": "WITH c AS (SELECT doc_id, [" + ", ".join(f"len(regexp_extract_all(text, '\\p{{{x}}}'))" for x in _SCRIPTS) + f"] AS n FROM documents) SELECT doc_id, CASE WHEN list_max(n) > 0 THEN {_list(_SCRIPTS)}[list_position(n, list_max(n))] END AS script FROM c",
    "extracted_line_menus": f"{_DISHES} SELECT snapshot_id, {_source_key('name', chr(39) * 2)} AS source_key, name, kr * 100 AS price_minor, 0.78::DOUBLE AS confidence FROM dishes WHERE name <> 'small plate'",
    "extracted_linked_data": f"{_DISHES} SELECT snapshot_id, name, kr * 100 AS price_minor, 'NOK' AS currency, 'json_ld' AS method FROM dishes",
    "extracted_printed_menus": f"{_DISHES} SELECT snapshot_id, name, 'MAIN DISHES' AS section, kr * 100 AS price_minor, 'multiple' AS price_kind, (kr + 20) * 100 AS price_max_minor FROM dishes",
    "extracted_hours": _with("SELECT hours_snapshot_id, iso_weekday, opens, closes, next_day FROM hours_intervals"),
    "menu_watch_outcomes": BASE + """, dishes AS (SELECT l_orderkey AS snapshot_id, count(DISTINCT p_name) FILTER (WHERE p_name <> 'small plate') AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        newest AS (SELECT DISTINCT ON (source_id) source_id, snapshot_id FROM snapshots ORDER BY source_id, fetched_at DESC, snapshot_id DESC)
        SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'not_modified' WHEN source_id % 11 = 0 THEN 'fetch_error' WHEN n < minimum_items THEN 'below_minimum' ELSE 'changed' END AS outcome,
            CASE WHEN source_id % 7 = 0 OR source_id % 11 = 0 THEN 0 ELSE n END AS item_count
        FROM newest JOIN dishes USING (snapshot_id) JOIN menu_sources USING (source_id)""",
}

# Pages that show each snapshot's dishes in the order of their names; n is how many there are.
_PLACED = _DISHES + """, placed AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY name) - 1 AS i, count(*) OVER (PARTITION BY snapshot_id) AS n FROM dishes),
fit AS (SELECT *, count(*) OVER (PARTITION BY snapshot_id) AS m FROM placed WHERE name <> 'small plate')
"""
_SQL |= {
    "extracted_embedded": f"{_PLACED} SELECT snapshot_id, name, ['Mains', 'Rice'][i % 3 + 1] AS section, kr * 100 AS price_minor, 'api' AS method FROM (SELECT *, count(*) OVER (PARTITION BY snapshot_id) AS food FROM placed WHERE i % 3 < 2) WHERE food >= 4",
    "extracted_cards": f"{_PLACED} SELECT snapshot_id, name, ['Mains', 'Rice'][i % 3 + 1] AS section, kr * 100 AS price_minor FROM (SELECT *, count(*) OVER (PARTITION BY snapshot_id) AS food FROM placed WHERE i % 3 < 2) WHERE food >= 4",
    "extracted_headings": f"{_PLACED}, food AS (SELECT *, count(*) OVER (PARTITION BY snapshot_id) AS f FROM placed WHERE i % 2 = 0 AND name <> 'small plate') SELECT snapshot_id, name, kr * 100 AS price_minor FROM food WHERE f >= 4",
    "extracted_wrapped": f"{_PLACED} SELECT snapshot_id, name, 'Served with rice and salad.' AS description, kr * 100 AS price_minor FROM fit WHERE m >= 3",
    "extracted_marked": f"{_PLACED} SELECT snapshot_id, name, kr * 100 AS price_minor, 0.97::DOUBLE AS confidence FROM fit WHERE m >= 3",
    "extracted_from": f"{_PLACED} SELECT snapshot_id, name, kr * 100 AS price_minor, 'from' AS price_kind FROM fit",
    "extracted_first_cards": f"{_PLACED} SELECT snapshot_id, name, kr * 100 AS price_minor FROM placed WHERE i < 3 AND name <> 'small plate'",
    "extracted_shared": f"{_PLACED} SELECT snapshot_id, upper(name) AS name, 'Platter of the house' AS section, 'with rice, salad and sauce' AS description, 25000 AS price_minor FROM placed WHERE n >= 2",
    "extracted_numbered": f"{_PLACED} SELECT snapshot_id, name, 'Served with rice.' AS description, kr * 100 AS price_minor FROM placed WHERE n >= 2",
    "extracted_trailing": f"{_PLACED} SELECT snapshot_id, name, kr * 100 AS price_minor, 0.95::DOUBLE AS confidence FROM fit WHERE m >= 4",
    "extracted_printed_rows": f"{_PLACED} SELECT snapshot_id, name, kr * 100 AS price_minor, 0.86::DOUBLE AS confidence FROM placed UNION ALL SELECT DISTINCT snapshot_id, 'House cake', 8500, 0.86 FROM placed",
    "extracted_kitchen_hours": _with(""", k AS (SELECT hours_snapshot_id AS id, (600 + (hours_snapshot_id % 4) * 60)::INTEGER AS o, (1200 + (hours_snapshot_id % 3) * 60)::INTEGER AS c, hours_snapshot_id % 4 AS way FROM hours_snapshots),
        w AS (SELECT k.*, d FROM k, (VALUES (1), (2), (3), (4), (6), (7)) AS t(d) WHERE way <> 3)
        SELECT id AS hours_snapshot_id, d::INTEGER AS iso_weekday, CASE WHEN d >= 6 THEN o + 60 ELSE o END AS opens, CASE way WHEN 0 THEN c - 30 WHEN 1 THEN least(c, 1170) ELSE c END AS closes, '' AS error FROM w
        UNION ALL SELECT id, 0, -1, -1, 'AMBIGUOUS_RELATIVE_KITCHEN_CUTOFF' FROM k WHERE way = 3"""),
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
