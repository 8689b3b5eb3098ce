"""Events, scores and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.model import bindings as b
from tidewatch.model import labels
from tidewatch.operators import alerts as al
from tidewatch.operators import areas, canonical, events, filters
from tidewatch.operators import score as sc
from tidewatch.plans.areas import INSIDE, PROX
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, haversine, with_views
from tidewatch.plans.metrics import HOUR

NOW = 996624000000000  # 2001-08-01, the last order date

CORR = """, back AS (SELECT event_id, agency, value, min(at_us) AS at_us FROM claims GROUP BY ALL),
  pv AS (SELECT event_id, value, count(*) AS n FROM back GROUP BY ALL),
  lead AS (SELECT event_id, arg_max(value, (n, value)) AS leading_value FROM pv GROUP BY event_id),
  side AS (SELECT event_id, leading_value, agency, bool_or(value = leading_value) AS agrees FROM back JOIN lead USING (event_id) GROUP BY ALL),
  corr AS (SELECT event_id, leading_value, count(*) AS independent_sources, CAST(count(*) FILTER (WHERE NOT agrees) AS BIGINT) AS contradicting_sources FROM side GROUP BY ALL),
  frst AS (SELECT event_id, arg_min(source_id, (at_us, source_id)) AS first_seen_source, min(at_us) AS first_seen_us FROM claims GROUP BY event_id)"""


@query("a6_corroborate", with_views("claims", CORR + " SELECT * FROM corr JOIN frst USING (event_id)"))
def a6(spark, d):
    return events.corroborate(b.claims(spark, d))


CONTRA = """, cv AS (SELECT event_id, field_path, value, count(*) AS n FROM claims GROUP BY ALL),
  contra AS (SELECT event_id, field_path, count(*) AS "values", CAST(sum(n) AS BIGINT) AS claims, max(n) / sum(n) AS support FROM cv GROUP BY ALL HAVING count(*) > 1)"""


@query("d8_contradictions", with_views("claims", CONTRA + ' SELECT event_id, field_path, "values", claims, support, \'disputed\' AS status FROM contra'))
def d8(spark, d):
    return events.contradictions(b.claims(spark, d))


@query(
    "d8_disputed_claims",
    with_views("claims", CONTRA + " SELECT event_id, field_path, value, source_id, at_us FROM claims WHERE event_id IN (SELECT event_id FROM contra)"),
)
def d8_claims(spark, d):
    return events.disputed_claims(b.claims(spark, d)).select("event_id", "field_path", "value", "source_id", "at_us")


@query(
    "d8_disputed_events",
    with_views(
        "evt claims",
        CONTRA
        + """ SELECT event_id, CASE WHEN support IS NOT NULL THEN 'disputed' ELSE evt.status END AS status, 0.9e0 * coalesce(support, 1) AS confidence FROM evt LEFT JOIN contra USING (event_id)""",
    ),
)
def d8_events(spark, d):
    rows = b.events(spark, d).withColumn("confidence", F.lit(0.9))
    return events.dispute_events(rows, events.contradictions(b.claims(spark, d))).select("event_id", "status", "confidence")


@query(
    "j9_link_reports",
    with_views(
        "rep",
        """, l AS (SELECT o_orderkey AS event_id, report_id, published_us FROM rep JOIN orders ON o_orderkey = n_chars // 10)
     SELECT event_id, report_id, published_us, row_number() OVER (PARTITION BY event_id ORDER BY published_us, report_id) = 1 AS is_first_report FROM l""",
    ),
)
def j9(spark, d):
    reports = b.reports(spark, d)
    about = reports.select(F.floor(F.col("n_chars") / 10).alias("event_id"), "report_id")
    links = about.join(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), "event_id")
    return events.link_reports(links, reports).select("event_id", "report_id", "published_us", "is_first_report")


@query(
    "j13_correlate_spacetime",
    with_views(
        "evt",
        f""", s AS (SELECT lon, lat, occurred_us, count(*) AS n, min(event_id) AS site FROM evt GROUP BY ALL),
     p AS (SELECT a.site AS site_a, b.site AS site_b, CASE WHEN a.site = b.site THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS event_pairs,
       (b.occurred_us - a.occurred_us) / 1e6 AS lag_s, {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m
       FROM s a JOIN s b ON a.site <= b.site AND abs(a.occurred_us - b.occurred_us) <= {2 * DAY} AND abs(a.lat - b.lat) < 1 WHERE {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 20000)
     SELECT site_a, site_b, event_pairs, lag_s, round(m, 2) AS distance_m, round((1 - abs(lag_s) * 1e6 / {2 * DAY}) * (1 - m / 20000), 6) AS strength FROM p WHERE event_pairs > 0""",
    ),
)
def j13(spark, d):
    p = events.correlate_spacetime(b.events(spark, d), 2 * DAY, 20.0)
    return p.withColumn("distance_m", F.round("distance_m", 2)).withColumn("strength", F.round("strength", 6))


@query(
    "j14_correlate_shared",
    with_views(
        "evt_ent",
        """, s AS (SELECT event_id, list_sort(list(DISTINCT ref_id)) AS items FROM evt_ent GROUP BY event_id),
     g AS (SELECT items, min(event_id) AS id, count(*) AS n FROM s GROUP BY items),
     x AS (SELECT id, n, len(items) AS sz, unnest(items) AS item FROM g),
     p AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) * any_value(b.n) AS event_pairs, count(*) AS shared, any_value(a.sz) + any_value(b.sz) - count(*) AS un
       FROM x a JOIN x b ON a.item = b.item AND a.id < b.id GROUP BY ALL)
     SELECT id_a, id_b, CAST(shared AS INTEGER) AS shared, shared / un AS similarity, event_pairs FROM p WHERE shared / un >= 0.7
     UNION ALL SELECT id, id, CAST(len(items) AS INTEGER), 1e0, n * (n - 1) // 2 FROM g WHERE n > 1""",
    ),
)
def j14(spark, d):
    return events.correlate_shared(b.event_entities(spark, d), 0.7)


@query(
    "j18_roll_up_links",
    with_views(
        "evt",
        """, up AS (SELECT event_id AS a, event_id // 4 AS b FROM evt WHERE status = 'rumored' AND event_id > 0
       UNION SELECT event_id, event_id // 9 FROM evt WHERE status = 'rumored' AND event_id > 0 AND event_id % 3 = 0),
     reach AS (SELECT event_id AS origin, event_id AS a FROM evt UNION SELECT origin, b FROM reach JOIN up USING (a)),
     roots AS (SELECT origin, a AS root FROM reach WHERE a NOT IN (SELECT a FROM up)),
     r AS (SELECT *, CASE WHEN ends_with(type, 'p1') THEN severity END AS hyp FROM evt)
     SELECT root, CAST(count(*) FILTER (WHERE origin <> root) AS BIGINT) AS children,
       CAST(count(*) FILTER (WHERE status = 'rumored' AND event_id > 0 AND domain = 'machinery') AS BIGINT) AS duplicates,
       max(severity) AS max_severity, min(occurred_us) AS first_us, max(occurred_us) AS last_us, max(hyp) AS strongest_hypothesis
     FROM roots JOIN r ON event_id = origin GROUP BY root""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def j18(spark, d):
    """A third of the linked events has a second parent."""
    rows = b.events(spark, d)
    linked = rows.filter("status = 'rumored' AND event_id > 0")
    up = linked.select(
        F.col("event_id").alias("from_event"),
        F.floor(F.col("event_id") / 4).alias("to_event"),
        F.when(F.col("domain") == "machinery", "duplicate_of").otherwise("part_of").alias("link_type"),
        F.lit(None).cast("double").alias("strength"),
    )
    second = linked.filter("event_id % 3 = 0").select(
        F.col("event_id").alias("from_event"),
        F.floor(F.col("event_id") / 9).alias("to_event"),
        F.lit("part_of").alias("link_type"),
        F.lit(None).cast("double").alias("strength"),
    )
    causes = rows.filter(F.col("type").endswith("p1")).select(
        F.col("event_id").alias("from_event"),
        (F.col("event_id") + 1).alias("to_event"),
        F.lit("caused_by_hypothesis").alias("link_type"),
        F.col("severity").alias("strength"),
    )
    return events.roll_up_links(rows, up.unionByName(second).unionByName(causes))


def scored(spark, d):
    """Flagship: proximity, corroboration, recency and reliability to a priority."""
    rows = areas.area_proximity(b.events(spark, d), b.areas(spark, d))
    support = events.corroborate(b.claims(spark, d)).select("event_id", "independent_sources", "first_seen_source")
    grades = F.create_map(*[F.lit(x) for kv in labels.RELIABILITY_SCORE.items() for x in kv])
    src = b.sources(spark, d).select(
        F.col("source_id").alias("first_seen_source"), F.element_at(grades, F.col("reliability")).alias("reliability")
    )
    inputs = (
        rows.join(support, "event_id", "left")
        .join(src, "first_seen_source", "left")
        .withColumn("recency", sc.recency((NOW - F.col("occurred_us")) / 1_000_000, 90 * 86400.0))
        .withColumn("corroboration", sc.corroboration(F.col("independent_sources")))
    )
    return sc.score(inputs)


SCORED = (
    CORR
    + PROX
    + f""", inp AS (SELECT prox.*, independent_sources / (independent_sources + 1) AS corroboration,
     CASE reliability WHEN 'A' THEN 1e0 WHEN 'B' THEN 0.8e0 WHEN 'C' THEN 0.6e0 WHEN 'D' THEN 0.4e0 WHEN 'E' THEN 0.2e0 WHEN 'F' THEN 0.5e0 END AS reliability,
     CASE WHEN {NOW} >= occurred_us THEN exp(-(({NOW} - occurred_us) / 1e6) / 7776000) ELSE 1e0 END AS recency
    FROM prox LEFT JOIN corr USING (event_id) LEFT JOIN frst USING (event_id) LEFT JOIN src ON src.source_id = first_seen_source),
  scored AS (SELECT *, 100 * greatest(0e0, least(1e0, area_weight * (severity * 0.3e0 + recency * 0.2e0 + coalesce(corroboration * 0.2e0, 0) + proximity * 0.2e0 + coalesce(reliability * 0.1e0, 0))
     / (0.7e0 + CASE WHEN corroboration IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN reliability IS NOT NULL THEN 0.1e0 ELSE 0e0 END))) AS priority FROM inp)"""
)
LEVEL = "CASE WHEN priority >= 90 THEN 'critical' WHEN priority >= 70 THEN 'alert' WHEN priority >= 45 THEN 'notify' WHEN priority >= 20 THEN 'watch' ELSE 'info' END"
SCORE_VIEWS = "evt aoi claims src"
FACTORS = ["severity", "recency", "corroboration", "proximity", "reliability"]


@query(
    "a7_score",
    with_views(
        SCORE_VIEWS,
        SCORED + f" SELECT event_id, round(priority, 4) AS priority, {LEVEL} AS level, round(recency, 5) AS recency, round(corroboration, 5) AS corroboration, 'w1' AS weights_version FROM scored",
    ),
)
def a7(spark, d):
    s = scored(spark, d)
    return s.select(
        "event_id",
        F.round("priority", 4).alias("priority"),
        canonical.priority_level(F.col("priority")).alias("level"),
        F.round("recency", 5).alias("recency"),
        F.round("corroboration", 5).alias("corroboration"),
        "weights_version",
    )


FACTOR_SQL = (
    SCORED
    + """, fac AS (SELECT event_id, factor, raw, raw * CASE factor WHEN 'severity' THEN 0.3e0 WHEN 'reliability' THEN 0.1e0 ELSE 0.2e0 END AS contribution
   FROM (SELECT event_id, severity, recency, corroboration, proximity, reliability FROM inp) UNPIVOT (raw FOR factor IN (severity, recency, corroboration, proximity, reliability)))"""
)


@query("a7_factors", with_views(SCORE_VIEWS, FACTOR_SQL + " SELECT event_id, factor, round(raw, 10) AS raw, round(contribution, 10) AS contribution FROM fac"))
def a7_factors(spark, d):
    f = sc.factor_rows(scored(spark, d))
    return f.select("event_id", "factor", F.round("raw", 10).alias("raw"), F.round("contribution", 10).alias("contribution"))


@query(
    "a8_dominant_factor",
    with_views(
        SCORE_VIEWS,
        FACTOR_SQL + """ SELECT factor, count(*) AS n, round(avg(c), 5) AS mean_contribution FROM (SELECT event_id, arg_max(factor, (contribution, factor)) AS factor, max(contribution) AS c FROM fac GROUP BY event_id) GROUP BY factor""",
    ),
)
def a8(spark, d):
    top = sc.dominant_factor(sc.factor_rows(scored(spark, d)))
    return top.groupBy("factor").agg(F.count("*").alias("n"), F.round(F.avg("contribution"), 5).alias("mean_contribution"))


@query(
    "k1_top_events",
    with_views(
        SCORE_VIEWS,
        SCORED + f""" SELECT event_id, type, round(priority, 4) AS priority, {LEVEL} AS level, occurred_us, aoi_id, round(severity, 10) AS severity, round(recency, 10) AS recency,
      round(corroboration, 10) AS corroboration, round(proximity, 10) AS proximity, reliability FROM scored ORDER BY scored.priority DESC NULLS LAST, occurred_us DESC, event_id LIMIT 20""",
    ),
)
def k1(spark, d):
    top = sc.top_events(scored(spark, d), 20)
    return top.select(
        "event_id", "type", F.round("priority", 4).alias("priority"), canonical.priority_level(F.col("priority")).alias("level"), "occurred_us", "aoi_id",
        *[F.round(c, 10).alias(c) for c in ("severity", "recency", "corroboration", "proximity")], "reliability",
    )


@query(
    "k3_top_per_area",
    with_views(
        SCORE_VIEWS,
        SCORED + f""", m AS (SELECT a.aoi_id, p.event_id, p.priority, a.min_priority FROM scored p JOIN aoi a ON {INSIDE}),
      r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY priority DESC, event_id) AS rn FROM m WHERE priority >= min_priority AND event_id IN (SELECT event_id FROM evt WHERE type = 'economic.f' OR starts_with(type, 'economic.f.')))
     SELECT aoi_id, event_id, round(priority, 4) AS priority, CAST(rn AS INTEGER) AS rank_no FROM r WHERE rn <= 5""",
    ),
)
def k3(spark, d):
    wanted = filters.taxonomy_filter(scored(spark, d).drop("aoi_id"), "economic.f")
    hits = areas.match_areas(wanted, b.areas(spark, d)).select(
        "event_id", "priority", "area.aoi_id", F.col("area.min_priority").alias("min_priority")
    )
    return sc.top_per_area(hits, 5).select("aoi_id", "event_id", F.round("priority", 4).alias("priority"), "rank_no")


@query(
    "w3_latest_score",
    with_views(
        SCORE_VIEWS,
        f"""SELECT 'event' AS object_kind, cust AS object_id, arg_max(severity, (occurred_us, event_id)) AS priority, max(occurred_us) AS computed_us FROM evt GROUP BY cust""",
    ),
)
def w3_scores(spark, d):
    # Each order of a customer is one more score of the same object.
    scores = b.events(spark, d).groupBy(
        F.lit("event").alias("object_kind"), F.col("cust").alias("object_id"), F.lit("").alias("profile_id"), F.col("occurred_us").alias("computed_us")
    ).agg(F.max_by("severity", "event_id").alias("priority"))
    return sc.latest_scores(scores).select("object_kind", "object_id", "priority", "computed_us")


@query(
    "w11_rank_priority",
    with_views(
        "evt",
        """, e AS (SELECT event_id, domain, floor(severity * 200) / 200 AS p FROM evt)
     SELECT event_id, domain, p AS priority, rank() OVER w AS rank_no, dense_rank() OVER w AS dense_rank_no, round(percent_rank() OVER w, 6) AS percent_rank,
       row_number() OVER v AS row_no, ntile(4) OVER v AS tile FROM e WINDOW w AS (PARTITION BY domain ORDER BY p DESC), v AS (PARTITION BY domain ORDER BY p DESC, event_id)""",
    ),
)
def w11(spark, d):
    rows = b.events(spark, d).select("event_id", "domain", (F.floor(F.col("severity") * 200) / 200).alias("priority"))
    r = sc.rank_priority(rows, "domain", "priority", "event_id")
    return r.select(
        "event_id", "domain", "priority", F.col("rank_no").cast("bigint").alias("rank_no"), F.col("dense_rank_no").cast("bigint").alias("dense_rank_no"),
        F.round("percent_rank", 6).alias("percent_rank"), F.col("row_no").cast("bigint").alias("row_no"), F.col("tile").cast("bigint").alias("tile"),
    )


ASSESS = f""", a AS (SELECT *, CASE WHEN nation % 3 = 0 THEN 'forecast' ELSE 'judgement' END AS kind, CASE status WHEN 'confirmed' THEN 'confirmed' WHEN 'rumored' THEN 'refuted' END AS verdict,
     occurred_us + {30 * DAY} AS valid_to_us, CASE WHEN status <> 'reported' THEN severity - 0.5 END AS err FROM evt)"""


def _assessments(spark, d):
    return b.events(spark, d).select(
        "event_id",
        F.when(F.col("nation") % 3 == 0, "forecast").otherwise("judgement").alias("kind"),
        F.when(F.col("status") == "confirmed", "confirmed").when(F.col("status") == "rumored", "refuted").alias("verdict"),
        (F.col("occurred_us") + 30 * DAY).alias("valid_to_us"),
        F.when(F.col("status") != "reported", F.col("severity") - 0.5).alias("outcome_error"),
        F.lit("model").alias("author_type"),
        F.col("domain").alias("author_id"),
    )


@query(
    "a15_assessment_outcomes",
    with_views(
        "evt",
        ASSESS
        + f""", j AS (SELECT *, CASE WHEN kind = 'forecast' AND verdict IS NULL AND valid_to_us < {NOW} THEN 'expired' ELSE verdict END AS v FROM a)
     SELECT 'model' AS author_type, domain AS author_id, count(*) AS assessments, CAST(count(*) FILTER (WHERE v = 'confirmed') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE v = 'refuted') AS BIGINT) AS refuted,
      CAST(count(*) FILTER (WHERE v = 'expired') AS BIGINT) AS expired, CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS pending, round(avg(err), 6) AS mean_error FROM j GROUP BY domain""",
    ),
)
def a15(spark, d):
    return sc.assessment_outcomes(_assessments(spark, d), NOW).withColumn("mean_error", F.round("mean_error", 6))


@query(
    "f9_open_forecasts",
    with_views("evt", ASSESS + " SELECT event_id, valid_to_us FROM a WHERE kind = 'forecast' AND verdict IS NULL"),
)
def f9_forecasts(spark, d):
    return filters.open_forecasts(_assessments(spark, d)).select("event_id", "valid_to_us")


@query(
    "f9_open_contradictions",
    with_views(
        "claims evt",
        CONTRA + " SELECT event_id, support FROM contra JOIN evt USING (event_id) WHERE evt.status <> 'confirmed'",
    ),
)
def f9_contradictions(spark, d):
    # A confirmed event has settled its contradictions.
    settled = b.events(spark, d).select(
        "event_id", F.when(F.col("status") == "confirmed", F.col("occurred_us")).alias("resolved_us")
    )
    rows = events.contradictions(b.claims(spark, d)).join(settled, "event_id")
    return filters.open_contradictions(rows).select("event_id", "support")


@query(
    "a9_throttle_alerts",
    with_views(
        "alerts",
        f""", p AS (SELECT *, k % 7 IN (3, 4, 5) AS closes, lag(seen_us) OVER w AS pt, lag(k % 7 IN (3, 4, 5)) OVER w AS pc FROM alerts WINDOW w AS (PARTITION BY dedupe_key ORDER BY seen_us, alert_id)),
     o AS (SELECT *, last_value(CASE WHEN pt IS NULL OR seen_us - pt > {5 * DAY} OR coalesce(pc, false) THEN alert_id END IGNORE NULLS) OVER (PARTITION BY dedupe_key ORDER BY seen_us, alert_id) AS open_alert_id FROM p)
     SELECT dedupe_key, open_alert_id, count(*) AS occurrence_count, min(seen_us) AS first_seen_us, max(seen_us) AS last_seen_us, bool_or(closes) AS closed FROM o GROUP BY ALL""",
    ),
)
def a9(spark, d):
    hits = b.alert_hits(spark, d).withColumn("closes", (F.col("k") % 7).isin(3, 4, 5))
    return al.throttle_alerts(hits, 5 * DAY)


RANK = "list_position(['unspecified', 'watch', 'notify', 'alert', 'critical'], severity)"


@query(
    "a10_aggregate_alerts",
    with_views(
        "alerts",
        f"""SELECT rule_id, aoi_id, seen_us // {5 * DAY} * {5 * DAY} AS window_us, count(*) AS children, min(alert_id) AS parent_alert_id, arg_max(severity, {RANK}) AS severity,
      count(DISTINCT dedupe_key) AS subjects FROM alerts GROUP BY ALL HAVING count(*) >= 3""",
    ),
)
def a10(spark, d):
    return al.aggregate_alerts(b.alert_hits(spark, d), 5 * DAY, 3)


@query(
    "a16_detector_precision",
    with_views(
        "alerts",
        """, g AS (SELECT rule_id, count(*) AS alerts, CAST(count(*) FILTER (WHERE disposition = 'true_positive') AS BIGINT) AS true_positives,
      CAST(count(*) FILTER (WHERE disposition = 'false_positive') AS BIGINT) AS false_positives FROM alerts GROUP BY rule_id)
     SELECT *, CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) END AS precision,
      true_positives + false_positives >= 50 AND coalesce(true_positives / (true_positives + false_positives) >= 0.45, false) AS may_promote FROM g""",
    ),
)
def a16(spark, d):
    return al.detector_precision(b.alert_hits(spark, d), 50, 0.45)


@query(
    "a18_notification_digest",
    with_views(
        "alerts",
        f""", n AS (SELECT alert_id, CASE k % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'push' ELSE 'chat' END AS channel, seen_us AS queued_us, CASE WHEN k % 4 > 0 THEN seen_us END AS sent_us,
       CASE WHEN k % 10 = 0 THEN 'timeout' END AS error, k % 5 AS attempts FROM alerts)
     SELECT channel, queued_us // {DAY} * {DAY} AS window_us, CAST(count(*) FILTER (WHERE sent_us IS NULL) AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS failures,
      CAST(sum(attempts) AS BIGINT) AS attempts, count(DISTINCT alert_id) AS alerts, min(queued_us) FILTER (WHERE sent_us IS NULL) AS oldest_pending_us FROM n GROUP BY ALL""",
    ),
)
def a18(spark, d):
    k = F.col("k")
    notes = b.alert_hits(spark, d).select(
        "alert_id",
        F.when(k % 3 == 0, "mail").when(k % 3 == 1, "push").otherwise("chat").alias("channel"),
        F.col("seen_us").alias("queued_us"),
        F.when(k % 4 > 0, F.col("seen_us")).alias("sent_us"),
        F.when(k % 10 == 0, F.lit("timeout")).alias("error"),
        (k % 5).alias("attempts"),
    )
    return al.notification_digest(notes, DAY)


@query(
    "k2_alert_queue",
    with_views(
        "alerts",
        f"""SELECT alert_id, status, severity, seen_us, CAST({RANK} AS BIGINT) AS severity_rank FROM alerts
      ORDER BY list_position(['new','acked','investigating','resolved','false_positive','suppressed','expired'], status), {RANK} DESC, seen_us DESC, alert_id""",
    ),
)
def k2(spark, d):
    return al.alert_queue(b.alert_hits(spark, d)).select("alert_id", "status", "severity", "seen_us", "severity_rank")
