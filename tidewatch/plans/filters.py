"""Filters, and the two small lookups that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.geo import Box
from tidewatch.model import bindings as b
from tidewatch.operators import filters as op
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, haversine, with_views

T0 = J + 15 * DAY
T1998 = 898992000000000  # 1998-06-28


@query(
    "f1_viewport",
    with_views("obs", "SELECT obs_id, lon, lat FROM obs WHERE lat BETWEEN -60 AND 20 AND (lon >= 100 OR lon <= -120)"),
)
def f1(spark, d):
    return op.in_viewport(b.observations(spark, d), Box(100, -60, -120, 20)).select("obs_id", "lon", "lat")


@query(
    "f2_within_radius",
    with_views(
        "obs",
        f"SELECT obs_id, round({haversine('-80e0', '0e0', 'lon', 'lat')}, 2) AS distance_m FROM obs "
        f"WHERE {haversine('-80e0', '0e0', 'lon', 'lat')} <= 2000000",
    ),
)
def f2(spark, d):
    hit = op.within_radius(b.observations(spark, d), -80.0, 0.0, 2_000_000.0)
    return hit.select("obs_id", F.round("distance_m", 2).alias("distance_m"))


@query(
    "f3_entity_window",
    with_views(
        "obs",
        f"SELECT obs_id, ref_id, observed_us, lon, lat FROM obs WHERE ref_id = 'mmsi:200000008' "
        f"AND observed_us > {T0 - DAY} AND observed_us <= {T0} ORDER BY observed_us DESC, obs_id DESC",
    ),
)
def f3(spark, d):
    hit = op.entity_window(b.observations(spark, d), "mmsi:200000008", T0, 24)
    return hit.select("obs_id", "ref_id", "observed_us", "lon", "lat")


@query(
    "f4_taxonomy",
    with_views(
        "evt",
        "SELECT type, count(*) AS n, regexp_matches(type, '^[a-z0-9]+(\\.[a-z0-9_]+)*$') AS path_ok FROM evt "
        "WHERE type = 'economic.f' OR starts_with(type, 'economic.f.') GROUP BY type",
    ),
)
def f4(spark, d):
    hit = op.taxonomy_filter(b.events(spark, d), "economic.f")
    return hit.groupBy("type").agg(F.count("*").alias("n")).withColumn(
        "path_ok", op.valid_type_path(F.col("type"))
    )


@query(
    "f5_tags",
    with_views(
        "cases",
        "SELECT case_id, list_has_all(shared_with, ['u3', 'team-machinery']) AS has_all FROM cases "
        "WHERE list_has_any(shared_with, ['u3', 'team-machinery'])",
    ),
)
def f5(spark, d):
    cases = b.cases(spark, d)
    tags = ["u3", "team-machinery"]
    every = op.has_all_tags(cases, tags, "shared_with").select("case_id", F.lit(True).alias("has_all"))
    return (
        op.has_any_tag(cases, tags, "shared_with")
        .select("case_id")
        .join(every, "case_id", "left")
        .withColumn("has_all", F.coalesce("has_all", F.lit(False)))
    )


VISIBLE = (
    "owner_id = 'u7' OR visibility IN ('org', 'public') OR list_contains(shared_with, 'u7') "
    "OR (visibility = 'team' AND list_has_any(shared_with, ['team-machinery']))"
)


@query("f6_visible_to", with_views("cases", f"SELECT case_id, owner_id, visibility FROM cases WHERE {VISIBLE}"))
def f6(spark, d):
    return op.visible_to(b.cases(spark, d), "u7", ["team-machinery"]).select("case_id", "owner_id", "visibility")


@query(
    "f7_visible_children",
    with_views(
        "cases items",
        f"SELECT case_id, object_kind, object_id FROM items WHERE case_id IN (SELECT case_id FROM cases WHERE {VISIBLE})",
    ),
)
def f7(spark, d):
    seen = op.visible_to(b.cases(spark, d), "u7", ["team-machinery"])
    return op.visible_children(b.case_items(spark, d), seen, "case_id")


@query(
    "f8_valid_at",
    with_views(
        "rel",
        f"SELECT from_ref, to_ref, from_us, to_us, weight FROM rel WHERE from_us <= {T1998} AND {T1998} < to_us",
    ),
)
def f8(spark, d):
    return op.valid_at(b.relations(spark, d), T1998).select("from_ref", "to_ref", "from_us", "to_us", "weight")


@query(
    "f9_open_alerts",
    with_views(
        "alerts",
        "SELECT rule_id, status, count(*) AS n FROM alerts WHERE status IN ('new', 'acked', 'investigating') GROUP BY ALL",
    ),
)
def f9(spark, d):
    return op.open_alerts(b.alert_hits(spark, d)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query(
    "j2_source_enrichment",
    with_views(
        "rep src",
        "SELECT report_id, source_id, reliability, license_id, expected_latency_s FROM rep LEFT JOIN src USING (source_id)",
    ),
)
def j2(spark, d):
    return op.with_source(b.reports(spark, d), b.sources(spark, d)).select(
        "report_id", "source_id", "reliability", "license_id", "expected_latency_s"
    )


# Conversation turns stand in for translations: turn 0 is the French text,
# turn 1 the German one, and later ones are in languages that nobody asks for.
@query(
    "j17_in_language",
    with_views(
        "rep",
        """, tr AS (SELECT conv_id AS report_id, CASE turn WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'x' || CAST(turn AS VARCHAR) END AS lang,
           split_part(text, chr(10), 1) AS title, text FROM conversations)
        SELECT r.report_id, CASE WHEN t.report_id IS NULL THEN r.lang ELSE 'de' END AS shown_lang,
          t.report_id IS NOT NULL AS is_translated, coalesce(t.title, r.title) AS shown_title,
          length(coalesce(t.text, r.text)) AS shown_chars, length(r.text) AS original_chars
        FROM rep r LEFT JOIN tr t ON t.report_id = r.report_id AND t.lang = 'de'""",
    ),
)
def j17(spark, d):
    translations = b.table(spark, d, "conversations").select(
        F.col("conv_id").alias("report_id"),
        F.when(F.col("turn") == 0, "fr").when(F.col("turn") == 1, "de").otherwise(F.concat(F.lit("x"), F.col("turn"))).alias("lang"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
    )
    return op.in_language(b.reports(spark, d), translations, "de").select(
        "report_id",
        "shown_lang",
        "is_translated",
        "shown_title",
        F.length("shown_text").cast("bigint").alias("shown_chars"),
        F.length("text").cast("bigint").alias("original_chars"),
    )
