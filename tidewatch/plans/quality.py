"""Rule suites, uniqueness, retention and licences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.model import bindings as b
from tidewatch.operators import quality as op
from tidewatch.operators import track
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, with_views
from tidewatch.plans.metrics import NOW
from tidewatch.plans.tracks import TRACKS
from tidewatch.session import shared_folder
from tidewatch.sources import landing


def suite(rules: dict[str, str], source: str, id_col: str) -> str:
    """One row per rule: a predicate that is false counts, null does not."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE NOT coalesce({p}, true)) AS BIGINT) AS violations, "
        f"CAST(min({id_col}) FILTER (WHERE NOT coalesce({p}, true)) AS VARCHAR) AS first_id FROM {source}"
        for name, p in rules.items()
    )


@query(
    "q1_observation_rules",
    with_views(
        "obs",
        """, o AS (SELECT *, CASE WHEN wire_us IS NULL OR k = 13 THEN 'inferred_from_ingest' ELSE 'source_provided' END AS tq, k % 8 = 0 AS dr,
       CASE WHEN k % 16 = 0 THEN 100e0 END AS ur, CASE WHEN k = 21 THEN 'position' ELSE kind END AS kd, CASE WHEN k < 3 THEN cog_deg + 360 ELSE cog_deg END AS cd,
       CASE WHEN k = 5 THEN -1e0 END AS dm FROM obs) """
        + suite(
            {
                "time_quality_consistent": "tq <> 'inferred_from_ingest' OR observed_us = ingested_us",
                "dead_reckoned_needs_radius": "NOT dr OR ur IS NOT NULL",
                "measurement_complete": "kd <> 'measurement' OR (metric IS NOT NULL AND metric_value IS NOT NULL)",
                "position_has_geo": "kd <> 'position' OR lon IS NOT NULL",
                "cog_range": "cd >= 0 AND cd < 360",
                "heading_range": "cd >= 0 AND cd < 360",
                "draft_not_negative": "dm >= 0",
            },
            "o",
            "obs_id",
        ),
    ),
)
def q1(spark, d):
    k = F.col("k")
    cog = F.when(k < 3, F.col("cog_deg") + 360).otherwise(F.col("cog_deg"))
    obs = b.observations(spark, d).withColumns(
        {
            "time_quality": F.when(F.col("wire_us").isNull() | (k == 13), "inferred_from_ingest").otherwise("source_provided"),
            "is_dead_reckoned": k % 8 == 0,
            "uncertainty_radius_m": F.when(k % 16 == 0, 100.0),
            "kind": F.when(k == 21, "position").otherwise(F.col("kind")),
            "cog_deg": cog,
            "heading_deg": cog,
            "draft_m": F.when(k == 5, -1.0),
        }
    )
    return op.check_rules(obs, op.OBSERVATION_RULES(), "obs_id")


@query(
    "q2_event_rules",
    with_views(
        "evt",
        ", e AS (SELECT *, CASE WHEN cust % 9 = 0 THEN occurred_us - 1 WHEN cust % 9 = 1 THEN occurred_us END AS oe, nation % 5 AS n5 FROM evt) "
        + suite(
            {
                "time_order": "oe IS NULL OR oe >= occurred_us",
                "retraction_complete": "n5 <> 3 OR (n5 = 3 AND cust % 2 = 0)",
                "derived_point_marked": "n5 IN (0, 1) OR n5 = 2",
                "type_path": "regexp_matches(CASE WHEN cust % 13 = 0 THEN upper(type) ELSE type END, '^[a-z0-9]+(\\.[a-z0-9_]+)*$')",
                "severity_range": "severity * 1.2 BETWEEN 0 AND 1",
                "confidence_range": "(CASE WHEN n5 = 4 THEN NULL ELSE 0.5 END) BETWEEN 0 AND 1",
                "priority_range": "severity * 101 BETWEEN 0 AND 100",
                "country_code": "regexp_matches(CASE n5 WHEN 0 THEN 'de' WHEN 1 THEN NULL ELSE 'DE' END, '^[A-Z]{2}$')",
            },
            "e",
            "event_id",
        ),
    ),
)
def q2(spark, d):
    n5, cust = F.col("nation") % 5, F.col("cust")
    events = b.events(spark, d).withColumns(
        {
            "occurred_end_us": F.when(cust % 9 == 0, F.col("occurred_us") - 1).when(cust % 9 == 1, F.col("occurred_us")),
            "status": F.when(n5 == 3, "retracted").otherwise(F.col("status")),
            "retracted_us": F.when((n5 == 3) & (cust % 2 == 0), F.col("occurred_us")),
            "retraction_reason": F.when(n5 == 3, F.lit("wrong")),
            "geo_precision": F.when(n5 == 0, "exact").when(n5 == 1, "building").otherwise("city"),
            "point_is_derived": n5 == 2,
            "type": F.when(cust % 13 == 0, F.upper("type")).otherwise(F.col("type")),
            "priority": F.col("severity") * 101,
            "severity": F.col("severity") * 1.2,
            "confidence": F.when(n5 != 4, 0.5),
            "country": F.when(n5 == 0, "de").when(n5 > 1, "DE"),
        }
    )
    return op.check_rules(events, op.EVENT_RULES(), "event_id")


@query(
    "q3_report_rules",
    with_views(
        "rep",
        suite(
            {
                "withheld_has_no_text": "NOT (report_id % 7 = 0) OR report_id % 14 = 0",
                "retraction_needs_reason": "report_id % 5 <> 0 OR report_id % 10 = 0",
                "span_ordered": "n_chars - 300 >= 200",
                "sentiment_range": "(CASE WHEN lang = 'de' THEN NULL ELSE n_chars / 10000e0 END) BETWEEN -1 AND 1",
            },
            "rep",
            "report_id",
        ),
    ),
)
def q3(spark, d):
    r = F.col("report_id")
    reports = b.reports(spark, d).withColumns(
        {
            "body_withheld": r % 7 == 0,
            "body_text": F.when(r % 14 != 0, F.col("text")),
            "retracted_us": F.when(r % 5 == 0, F.col("published_us")),
            "retraction_reason": F.when(r % 10 == 0, F.lit("wrong")),
            "char_start": F.lit(200),
            "char_end": F.col("n_chars") - 300,
            "sentiment": F.when(F.col("lang") != "de", F.col("n_chars") / 10000),
        }
    )
    return op.check_rules(reports, op.REPORT_RULES(), "report_id")


@query(
    "q4_relation_rules",
    with_views(
        "rel",
        suite(
            {
                "other_needs_label": "weight <> 7 OR confidence > 0.05",
                "not_self": "weight <> 9",
                "evidence_is_array": "weight NOT IN (1, 2)",
                "confidence_range": "(CASE WHEN weight = 3 THEN 1.5 ELSE confidence END) BETWEEN 0 AND 1",
            },
            "rel",
            "line_id",
        ),
    ),
)
def q4(spark, d):
    w = F.col("weight")
    edges = b.relations(spark, d).withColumns(
        {
            "relation_type": F.when(w == 7, "other").otherwise(F.col("relation_type")),
            "type_label": F.when(F.col("confidence") > 0.05, F.lit("ships")),
            "to_ref": F.when(w == 9, F.col("from_ref")).otherwise(F.col("to_ref")),
            "evidence": F.when(w == 1, '{"a":1}').when(w == 2, '"x"').when(w > 40, None).otherwise("[1]"),
            "confidence": F.when(w == 3, 1.5).otherwise(F.col("confidence")),
        }
    )
    return op.check_rules(edges, op.RELATION_RULES(), "line_id")


@query(
    "q4_track_rules",
    with_views(
        "obs",
        TRACKS
        + f""", t AS (SELECT track_id, min(observed_us) AS a, max(observed_us) AS z, count(*) AS n, coalesce(sum(leg_m), 0) AS m FROM tracks GROUP BY track_id),
     h AS (SELECT *, ({NOW} - z) / 1e6 <= 43200 AS open, CASE WHEN ({NOW} - z) / 1e6 > 43200 THEN z END AS e FROM t) """
        + suite(
            {
                "time_order": "e IS NULL OR e >= a",
                "open_has_no_end": "NOT open OR e IS NULL",
                "point_count": "n >= 0",
                "distance": "m >= 0",
            },
            "h",
            "track_id",
        ),
    ),
)
def q4_tracks(spark, d):
    header = track.track_summary(track.assign_tracks(b.observations(spark, d), 43200.0), 43200.0, NOW)
    return op.check_rules(header, op.TRACK_RULES(), "track_id")


@query(
    "q4_event_link_rules",
    suite(
        {
            "not_self": "l_orderkey <> l_partkey",
            "hypothesis_needs_strength": "l_returnflag <> 'R' OR l_tax > 0",
        },
        "lineitem",
        "l_orderkey",
    ),
)
def q4_links(spark, d):
    links = b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("from_event"),
        F.col("l_partkey").alias("to_event"),
        F.when(F.col("l_returnflag") == "R", "caused_by_hypothesis").otherwise("follows").alias("link_type"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("strength"),
    )
    return op.check_rules(links, op.EVENT_LINK_RULES(), "from_event")


@query(
    "q5_alert_rules",
    with_views(
        "alerts",
        suite(
            {
                "resolved_needs_disposition": "status NOT IN ('resolved', 'false_positive') OR (k % 2 = 0 AND disposition IS NOT NULL)",
                "acked_complete": "(k % 7 <> 1) = (k % 14 <> 1)",
                "seen_order": "k <> 44",
                "occurrences": "k % 20 >= 1",
            },
            "alerts",
            "alert_id",
        ),
    ),
)
def q5_alerts(spark, d):
    k, t = F.col("k"), F.col("seen_us")
    alerts = b.alert_hits(spark, d).withColumns(
        {
            "resolved_us": F.when(k % 2 == 0, t),
            "acked_us": F.when(k % 7 == 1, t),
            "acked_by": F.when(k % 14 == 1, F.lit("u1")),
            "first_seen_us": t,
            "last_seen_us": F.when(k == 44, t - 1).otherwise(t),
            "occurrence_count": k % 20,
        }
    )
    return op.check_rules(alerts, op.ALERT_RULES(), "alert_id")


@query(
    "q5_assessment_rules",
    with_views(
        "evt",
        ", a AS (SELECT *, event_id % 4 AS a4, event_id % 6 AS a6, event_id % 5 AS a5 FROM evt) "
        + suite(
            {
                "model_provenance": "a4 <> 0 OR nation % 3 <> 0",
                "machine_needs_evidence": "a4 NOT IN (0, 1) OR cust % 2 = 0",
                "forecast_needs_validity": "a6 <> 0 OR nation % 2 = 0",
                "confidence_interval": "(a5 IN (0, 1)) OR (severity - 0.1 <= severity AND severity <= CASE WHEN a5 = 2 THEN NULL WHEN a5 = 3 THEN severity + 0.1 ELSE severity - 0.05 END)",
            },
            "a",
            "event_id",
        ),
    ),
)
def q5_assessments(spark, d):
    e, s = F.col("event_id"), F.col("severity")
    none = e % 5 < 2
    rows = b.events(spark, d).withColumns(
        {
            "author_type": F.when(e % 4 == 0, "model").when(e % 4 == 1, "detector").otherwise("human"),
            "model": F.when(F.col("nation") % 3 != 0, F.lit("m")),
            "model_version": F.lit("1"),
            "prompt_hash": F.lit("h"),
            "evidence": F.when(F.col("cust") % 2 == 0, F.array(F.lit("report"))).otherwise(F.array().cast("array<string>")),
            "kind": F.when(e % 6 == 0, "forecast").otherwise("judgement"),
            "valid_to_us": F.when(F.col("nation") % 2 == 0, F.col("occurred_us")),
            "confidence": s,
            "confidence_lower": F.when(~none, s - 0.1),
            "confidence_upper": F.when(e % 5 == 3, s + 0.1).when(e % 5 == 4, s - 0.05),
        }
    )
    return op.check_rules(rows, op.ASSESSMENT_RULES(), "event_id")


@query(
    "q5_area_watchlist_case_rules",
    "SELECT * FROM ("
    + suite(
        {
            "geometry_present": "c_nationkey % 5 = 4 OR c_custkey % 3 <> 0",
            "dynamic_has_anchor": "c_nationkey % 5 <> 4 OR c_custkey % 2 = 0",
            "named_zone_has_id": "c_nationkey % 5 <> 3 OR c_acctbal > 0",
            "decay_positive": "c_acctbal + 500 > 0",
            "target": "(c_custkey % 5 IN (0, 1) AND c_acctbal > 0) OR (c_custkey % 5 IN (2, 3) AND c_acctbal > 1000) OR (c_custkey % 5 = 4 AND c_acctbal > 2000)",
            "weight_range": "c_acctbal / 9000 BETWEEN 0 AND 1",
            "closed_needs_reason": "c_mktsegment <> 'MACHINERY' OR (c_acctbal > 100 AND c_nationkey > 3)",
        },
        "customer",
        "c_custkey",
    )
    + ")",
)
def q5_registers(spark, d):
    c, n, a = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    kinds = F.element_at(F.expr("array('polygon', 'circle', 'corridor', 'named_zone', 'dynamic')"), n % 5 + 1)
    modes = F.element_at(
        F.expr("array('exact_id', 'entity', 'pattern', 'fuzzy_name', 'attribute')"), (c % 5 + 1).cast("int")
    )
    rows = b.table(spark, d, "customer").withColumns(
        {
            "kind": kinds,
            "has_geometry": c % 3 != 0,
            "anchor_ref": F.when(c % 2 == 0, F.lit("x")),
            "anchor_radius_m": F.lit(1.0),
            "zone_id": F.when(a > 0, F.lit("z")),
            "decay_km": a + 500,
            "match_mode": modes,
            "ref_id": F.when(a > 0, F.lit("x")),
            "pattern": F.when(a > 1000, F.lit("x")),
            "attribute_path": F.when(a > 2000, F.lit("x")),
            "weight": a / 9000,
            "status": F.when(F.col("c_mktsegment") == "MACHINERY", "closed").otherwise("open"),
            "closed_us": F.when(a > 100, F.lit(1)),
            "closure_reason": F.when(n > 3, F.lit("done")),
        }
    )
    rules = {**op.AREA_RULES(), **op.WATCHLIST_RULES(), **op.CASE_RULES()}
    return op.check_rules(rows, rules, "c_custkey")


@query(
    "q6_register_rules",
    with_views(
        "ent aliases src listings",
        " UNION ALL ".join(
            [
                suite(
                    {
                        "personal_data_needs_basis": "type <> 'person' OR balance > 0",
                        "merge_not_self": "balance >= 200 OR balance < 100",
                    },
                    "ent",
                    "entity_id",
                ),
                suite(
                    {
                        "id_type_lowercase": "stability <> 'stable'",
                        "value_not_blank": "from_us IS NOT NULL OR stability <> 'ephemeral' OR id_value NOT LIKE '%7'",
                    },
                    "aliases",
                    "id_value",
                ),
                suite({"disabled_needs_reason": "NOT disabled", "licence_present": "license_id IS NOT NULL"}, "src", "source_id"),
                suite({"delisting_after_listing": f"delisted_us >= {J + DAY}"}, "listings", "listing_id"),
            ]
        ),
    ),
)
def q6(spark, d):
    entities = b.entities(spark, d).withColumns(
        {
            "contains_personal_data": F.col("type") == "person",
            "personal_data_basis": F.when(F.col("balance") > 0, F.lit("consent")),
            "merged_into": F.when(F.col("balance").between(100, 199.999999), F.col("entity_id")),
        }
    )
    aliases = b.aliases(spark, d).withColumns(
        {
            "id_type": F.when(F.col("stability") == "stable", F.upper("id_type")).otherwise(F.col("id_type")),
            "shown": F.col("id_value"),
            "id_value": F.when(
                F.col("from_us").isNull() & (F.col("stability") == "ephemeral") & F.col("id_value").endswith("7"), "  "
            ).otherwise(F.col("id_value")),
        }
    )
    sources = b.sources(spark, d).withColumn("disabled_reason", F.lit(None).cast("string"))
    listed = b.listings(spark, d).withColumn("listed_us", F.lit(J + DAY))
    return (
        op.check_rules(entities, op.ENTITY_RULES(), "entity_id")
        .unionByName(op.check_rules(aliases, op.ALIAS_RULES(), "shown"))
        .unionByName(op.check_rules(sources, op.SOURCE_RULES(), "source_id"))
        .unionByName(op.check_rules(listed, op.LISTING_RULES(), "listing_id"))
    )


@query(
    "q7_unique_aliases",
    with_views(
        "aliases",
        "SELECT id_type, id_value, count(*) AS holders FROM aliases GROUP BY ALL HAVING count(*) > 1",
    ),
)
def q7(spark, d):
    return op.check_unique(b.aliases(spark, d), ["id_type", "id_value"])


@query(
    "q7_unique_open_alerts",
    with_views(
        "alerts",
        "SELECT dedupe_key, count(*) AS holders FROM alerts WHERE status IN ('new', 'acked', 'investigating') GROUP BY ALL HAVING count(*) > 1",
    ),
)
def q7_alerts(spark, d):
    from tidewatch.model import labels

    return op.check_unique(b.alert_hits(spark, d), ["dedupe_key"], F.col("status").isin(*labels.OPEN_ALERT_STATUS))


TODAY = J + 45 * DAY


@query(
    "q8_retention",
    with_views(
        "obs src",
        f""", p AS (SELECT source_id, observed_us // {DAY} AS day, count(*) AS n FROM obs GROUP BY ALL)
     SELECT source_id, day, n, CAST(least(40, coalesce(retention_days, 40)) AS INTEGER) AS limit_days,
       day < {TODAY // DAY} - least(40, coalesce(retention_days, 40)) AS "drop" FROM p LEFT JOIN src USING (source_id)""",
    ),
)
def q8(spark, d):
    return op.retention_plan(b.observations(spark, d), b.sources(spark, d), TODAY, 40)


@query(
    "q8_retained_rows",
    with_views(
        "obs src",
        f"""SELECT source_id, count(*) AS n FROM obs LEFT JOIN src USING (source_id)
      WHERE observed_us // {DAY} >= {TODAY // DAY} - least(40, coalesce(retention_days, 40)) GROUP BY ALL""",
    ),
)
def q8_rows(spark, d):
    kept = op.apply_retention(b.observations(spark, d), b.sources(spark, d), TODAY, 40)
    return kept.groupBy("source_id").agg(F.count("*").alias("n"))


@query(
    "q8_drop_expired",
    with_views(
        "obs src",
        f"""SELECT source_id, count(*) AS n FROM obs LEFT JOIN src USING (source_id)
      WHERE observed_us // {DAY} >= {TODAY // DAY} - least(40, coalesce(retention_days, 40)) GROUP BY ALL""",
    ),
)
def q8_drop(spark, d):
    """Day folders go or are written again; what is left is counted."""
    path = shared_folder(spark)
    landing.write_observations(b.observations(spark, d).select("source_id", "ref_id", "obs_id", "observed_us"), path, "2024-01-03", "2024-01-25")
    op.drop_expired(spark, path, b.sources(spark, d), TODAY, 40)
    return spark.read.parquet(path).groupBy("source_id").agg(F.count("*").alias("n"))


@query(
    "q8_purge_due",
    f"""SELECT * FROM (SELECT entity_id, purge_us, CASE WHEN purge_us <= {TODAY} THEN 'purge' WHEN personal AND purge_us IS NULL THEN 'undated' END AS verdict
      FROM (SELECT 'cust:' || c_custkey AS entity_id, true AS personal, CASE WHEN c_nationkey % 5 <> 0 THEN {J} + CAST(c_nationkey AS BIGINT) * {4 * DAY} END AS purge_us FROM customer
        UNION ALL SELECT 'supp:' || s_suppkey, false, CASE WHEN s_nationkey % 5 <> 0 THEN {J} + CAST(s_nationkey AS BIGINT) * {4 * DAY} END FROM supplier)) WHERE verdict IS NOT NULL""",
)
def q8_purge(spark, d):
    dated = F.when(F.col("nation") % 5 != 0, J + F.col("nation").cast("long") * 4 * DAY)
    rows = b.entities(spark, d).filter("entity_id LIKE 'cust:%' OR entity_id LIKE 'supp:%'")
    rows = rows.withColumn("personal", F.col("type") == "person").withColumn("purge_us", dated)
    return op.purge_due(rows, TODAY, "entity_id")


@query(
    "q9_licence_gate",
    with_views(
        "rep src",
        f"""SELECT report_id, source_id, v AS licence_verdict, v <> 'allowed' AS body_withheld, CASE WHEN v = 'allowed' THEN length(text) END AS shown_chars, attribution
     FROM (SELECT *, CASE WHEN license_id IS NULL THEN 'no_licence' WHEN license_expires_us <= {J + 15 * DAY} THEN 'expired'
       WHEN NOT list_contains(allowed_uses, 'fulltext') THEN 'use_not_allowed' ELSE 'allowed' END AS v FROM rep LEFT JOIN src USING (source_id))""",
    ),
)
def q9(spark, d):
    gated = op.licence_gate(b.reports(spark, d), b.sources(spark, d), "fulltext", J + 15 * DAY)
    return gated.select(
        "report_id", "source_id", "licence_verdict", "body_withheld", F.length("text").cast("bigint").alias("shown_chars"), "attribution"
    )
