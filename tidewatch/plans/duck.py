"""The model views as DuckDB SQL, for the oracle side of each query."""

from __future__ import annotations

_ANCHOR = "CAST(({0} % 40) * 8 - 160 AS DOUBLE)", "CAST(({0} % 20) * 6 - 60 AS DOUBLE)"
J = 1704067200000000
DAY = 86400000000


def _lon(key: str) -> str:
    return _ANCHOR[0].format(key)


def _lat(key: str) -> str:
    return _ANCHOR[1].format(key)


VIEWS = {
    "obs": f"""
SELECT event_id AS obs_id, event_id + (event_id * 7919) % 400 AS arrival, user_id AS sender,
  'mmsi:' || CAST(200000000 + user_id AS VARCHAR) AS ref_id,
  epoch_us(ts) AS observed_us,
  CASE WHEN event_type = 'signup' AND k < 50 THEN NULL
       WHEN k = 99 THEN epoch_us(ts) + {DAY} WHEN k = 98 THEN 0 ELSE epoch_us(ts) END AS wire_us,
  epoch_us(ts) + ((event_id % 15) - 2) * 1000000 AS ingested_us,
  event_type,
  CASE event_type WHEN 'purchase' THEN 'measurement' WHEN 'signup' THEN 'status' ELSE 'position' END AS kind,
  CASE WHEN event_type <> 'signup' THEN {_lon('user_id')} + (event_id % 100) / 1000e0
    + (CASE WHEN event_type = 'error' AND k >= 50 THEN 20e0 ELSE 0e0 END) END AS lon,
  CASE WHEN event_type <> 'signup' THEN {_lat('user_id')} + (event_id % 89) / 1000e0 END AS lat,
  CASE WHEN event_type <> 'signup' THEN value % 60 END AS sog_kn,
  CASE WHEN event_type <> 'signup' THEN CAST((event_id * 7) % 360 AS DOUBLE) END AS cog_deg,
  CASE WHEN event_type = 'purchase' THEN 'purchase' END AS metric,
  value AS metric_value, k, 'src' || CAST(k % 20 AS VARCHAR) AS source_id
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "evt": f"""
SELECT o_orderkey AS event_id,
  'economic.' || lower(o_orderstatus) || '.p' || substr(o_orderpriority, 1, 1) AS type,
  epoch_us(o_orderdate) AS occurred_us, o_totalprice / 500000 AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'reported' ELSE 'rumored' END AS status,
  {_lon('c_nationkey')} + (c_custkey % 50) / 100e0 AS lon,
  {_lat('c_nationkey')} + (c_custkey % 30) / 100e0 AS lat,
  c_nationkey AS nation, o_custkey AS cust, lower(c_mktsegment) AS domain
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "evt_ent": """
SELECT o_orderkey AS event_id, 'cust:' || CAST(o_custkey AS VARCHAR) AS ref_id, 'affected' AS role FROM orders
UNION ALL
SELECT DISTINCT l_orderkey, 'supp:' || CAST(l_suppkey AS VARCHAR), 'actor' FROM lineitem""",
    "claims": """
SELECT l_orderkey AS event_id, 'src' || CAST(l_suppkey % 20 AS VARCHAR) AS source_id,
  'agency' || CAST(l_suppkey % 7 AS VARCHAR) AS agency, '/outcome' AS field_path,
  l_returnflag AS value, epoch_us(l_shipdate) + l_linenumber * 1000000 AS at_us
FROM lineitem""",
    "ent": """
SELECT 'cust:' || CAST(c_custkey AS VARCHAR) AS entity_id, 'person' AS type, c_name AS display_name,
  c_nationkey AS nation, c_acctbal AS balance, lower(c_mktsegment) AS segment FROM customer
UNION ALL
SELECT 'supp:' || CAST(s_suppkey AS VARCHAR), 'organization', s_name, s_nationkey, s_acctbal, NULL FROM supplier""",
    "aliases": f"""
SELECT 'mmsi' AS id_type, CAST(200000000 + c_custkey AS VARCHAR) AS id_value,
  'cust:' || CAST(c_custkey AS VARCHAR) AS entity_id, {J} + (c_custkey % 5) * {DAY} AS from_us,
  CAST(NULL AS BIGINT) AS to_us, 'mutable' AS stability FROM customer
UNION ALL
SELECT 'mmsi', CAST(200000000 + s_suppkey AS VARCHAR), 'supp:' || CAST(s_suppkey AS VARCHAR),
  {J + 9 * DAY}, {J + 19 * DAY}, 'mutable' FROM supplier
UNION ALL
SELECT 'imo', CAST(9000000 + s_suppkey * 11 AS VARCHAR), 'supp:' || CAST(s_suppkey AS VARCHAR),
  NULL, NULL, 'stable' FROM supplier
UNION ALL
SELECT 'name', lower(c_name), 'cust:' || CAST(c_custkey AS VARCHAR), NULL, NULL, 'ephemeral' FROM customer""",
    "listings": f"""
SELECT 'list-a' AS list_id, 'L' || CAST(s_suppkey AS VARCHAR) AS listing_id,
  CAST(9000000 + s_suppkey * 11 AS VARCHAR) AS imo, lower(s_name) AS name,
  CASE WHEN s_acctbal < 0 THEN {J} END AS delisted_us FROM supplier WHERE s_acctbal < 1000
UNION ALL
SELECT 'list-b', 'P' || CAST(c_custkey AS VARCHAR), NULL, lower(c_name), NULL FROM customer WHERE c_acctbal < -500""",
    "rel": f"""
SELECT l_orderkey * 1000 + l_linenumber AS line_id, 'supplies_to' AS relation_type,
  'supp:' || CAST(l_suppkey AS VARCHAR) AS from_ref, 'cust:' || CAST(o_custkey AS VARCHAR) AS to_ref,
  least(epoch_us(o_orderdate), epoch_us(l_shipdate)) AS from_us,
  greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) + {DAY} AS to_us,
  l_linestatus = 'F' AS directed, CASE WHEN l_returnflag = 'R' THEN epoch_us(l_shipdate) END AS retracted_us,
  l_quantity AS weight, l_discount AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "snap": """
SELECT l_orderkey AS object_id,
  epoch_us(l_shipdate) + l_linenumber * 1000000 + l_partkey % 1000000 AS changed_us,
  CASE l_returnflag WHEN 'R' THEN 'retracted' WHEN 'A' THEN 'confirmed' ELSE 'reported' END AS status,
  l_quantity / 50 AS severity, 1 - l_discount AS confidence,
  'part ' || CAST(l_partkey AS VARCHAR) AS summary FROM lineitem""",
    "src": f"""
SELECT source_id, substr('ABCDEF', n % 6 + 1, 1) AS reliability,
  CASE WHEN n % 5 <> 4 THEN CAST((n % 5) * 3 + 2 AS DOUBLE) END AS expected_latency_s,
  CASE WHEN n % 9 <> 8 THEN 'lic-' || CAST(n % 3 AS VARCHAR) END AS license_id,
  CASE WHEN n % 7 = 3 THEN {J + 10 * DAY} END AS license_expires_us,
  CASE n % 3 WHEN 0 THEN ['display','analysis','fulltext'] WHEN 1 THEN ['display','analysis'] ELSE ['analysis'] END AS allowed_uses,
  CASE WHEN n % 4 = 1 THEN 7 + n END AS retention_days,
  CASE WHEN n % 2 = 0 THEN 'Data: ' || source_id END AS attribution,
  CAST(n * 8 - 180 AS DOUBLE) AS west, CAST(n * 8 + 20 AS DOUBLE) AS east, n % 12 = 11 AS disabled
FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)""",
    "rep": f"""
SELECT doc_id AS report_id, text, lang, source AS source_id, n_chars,
  {J} + (doc_id * 7919) % 1000 * 3600000000 AS published_us, split_part(text, chr(10), 1) AS title
FROM documents""",
    "aoi": f"""
SELECT 'nation-' || CAST(n_nationkey AS VARCHAR) AS aoi_id, 'circle' AS kind,
  {_lon('n_nationkey')} + 0.05e0 AS lon, {_lat('n_nationkey')} + 0.04e0 AS lat,
  4000e0 + n_nationkey * 200 AS radius_m, CAST(NULL AS DOUBLE) AS west, CAST(NULL AS DOUBLE) AS south,
  20e0 + n_nationkey AS decay_km, 0.5e0 + (n_nationkey % 4) / 4e0 AS weight,
  CAST((n_nationkey % 5) * 15 AS DOUBLE) AS min_priority FROM nation
UNION ALL
SELECT 'region-' || CAST(r_regionkey AS VARCHAR), 'polygon', r_regionkey * 60 - 160.5003e0 + 20,
  r_regionkey * 18 - 60.50021e0 + 20, NULL, r_regionkey * 60 - 160.5003e0, r_regionkey * 18 - 60.50021e0, 100e0, 1e0, 30e0 FROM region""",
    "alerts": f"""
SELECT event_id AS alert_id, 'rule-' || CAST(k % 4 AS VARCHAR) AS rule_id,
  'user-' || CAST(user_id AS VARCHAR) AS dedupe_key, epoch_us(ts) AS seen_us,
  CASE k % 5 WHEN 0 THEN 'unspecified' WHEN 1 THEN 'watch' WHEN 2 THEN 'notify' WHEN 3 THEN 'alert' ELSE 'critical' END AS severity,
  CASE WHEN k % 7 = 0 THEN 'new' WHEN k % 7 = 1 THEN 'acked' WHEN k % 7 = 2 THEN 'investigating'
    WHEN k % 7 < 5 THEN 'resolved' WHEN k % 7 = 5 THEN 'false_positive' ELSE 'expired' END AS status,
  CASE WHEN k % 7 IN (3, 4) THEN CASE WHEN k % 3 = 0 THEN 'false_positive' ELSE 'true_positive' END
    WHEN k % 7 = 5 THEN 'false_positive' END AS disposition,
  'nation-' || CAST(user_id % 25 AS VARCHAR) AS aoi_id, {_lon('user_id')} AS lon, {_lat('user_id')} AS lat,
  value AS magnitude, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE event_type = 'error')""",
    "cases": """
SELECT c_custkey AS case_id, 'u' || CAST(c_custkey % 50 AS VARCHAR) AS owner_id,
  CASE c_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'team' WHEN 2 THEN 'org' ELSE 'public' END AS visibility,
  ['u' || CAST(c_custkey % 11 AS VARCHAR), 'team-' || lower(c_mktsegment)] AS shared_with,
  lower(c_mktsegment) AS segment, c_acctbal AS balance FROM customer""",
    "items": """
SELECT o_custkey AS case_id, 'event' AS object_kind, CAST(o_orderkey AS VARCHAR) AS object_id FROM orders
UNION ALL
SELECT DISTINCT o_custkey, 'entity', 'supp:' || CAST(o_orderkey % 150 AS VARCHAR) FROM orders""",
}


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * 6371008.8 * asin(sqrt(least(1e0, pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def with_views(names: str, body: str) -> str:
    """``WITH`` clause for the named views, followed by ``body``.

    ``body`` may open with further ``name AS (...),`` parts when it starts with
    a comma.
    """
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names.split())
    return f"WITH {parts}\n{body}"
