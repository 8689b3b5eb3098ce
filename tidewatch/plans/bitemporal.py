"""Version chains, time travel and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.model import bindings as b
from tidewatch.operators import bitemporal as op
from tidewatch.operators.filters import valid_at
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, with_views

T1 = 915148800000000  # 1999-01-01
T2 = 962409600000000  # 2000-07-01
FIELDS = ["status", "severity", "confidence", "summary"]

VER = """, ver AS (SELECT object_id, row_number() OVER w AS version, changed_us AS from_us, lead(changed_us) OVER w AS to_us,
   status, severity, confidence, summary FROM snap WINDOW w AS (PARTITION BY object_id ORDER BY changed_us))"""


def _versions(spark, d):
    return op.build_versions(b.snapshots(spark, d), "object_id", "changed_us")


@query("w7_build_versions", with_views("snap", VER + " SELECT object_id, version, from_us, to_us, status, summary FROM ver"))
def w7(spark, d):
    return _versions(spark, d).select("object_id", "version", "from_us", "to_us", "status", "summary")


@query(
    "w8_audit_versions",
    with_views(
        "snap",
        VER
        + """, p AS (SELECT *, lag(to_us) OVER (PARTITION BY object_id ORDER BY from_us, version) AS pt, lag(version) OVER (PARTITION BY object_id ORDER BY from_us, version) AS pv FROM ver)
     SELECT object_id, count(*) AS versions, CAST(count(*) FILTER (WHERE pv IS NOT NULL AND pt < from_us) AS BIGINT) AS gaps,
      CAST(count(*) FILTER (WHERE pv IS NOT NULL AND (pt IS NULL OR pt > from_us)) AS BIGINT) AS overlaps,
      CAST(count(*) FILTER (WHERE to_us IS NULL) AS BIGINT) AS open_ends, CAST(count(*) FILTER (WHERE to_us <= from_us) AS BIGINT) AS empty FROM p GROUP BY object_id""",
    ),
)
def w8(spark, d):
    return op.audit_versions(_versions(spark, d), "object_id")


@query(
    "j6_as_of",
    with_views("snap", VER + f" SELECT object_id, version, status, summary, from_us FROM ver WHERE from_us <= {T1} AND (to_us IS NULL OR {T1} < to_us)"),
)
def j6(spark, d):
    current, history = op.split_current(_versions(spark, d))
    return op.as_of(current, history, T1).select("object_id", "version", "status", "summary", "from_us")


@query(
    "j6_as_of_many",
    with_views(
        "snap",
        VER
        + """ SELECT o_orderkey AS object_id, epoch_us(o_orderdate) AS at_us, version, status FROM orders JOIN ver ON ver.object_id = o_orderkey
     AND from_us <= epoch_us(o_orderdate) AND (to_us IS NULL OR epoch_us(o_orderdate) < to_us)""",
    ),
)
def j6_many(spark, d):
    asked = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), b.micros("o_orderdate").alias("at_us"))
    current, history = op.split_current(_versions(spark, d))
    return op.as_of_many(current, history, asked, "object_id").select("object_id", "at_us", "version", "status")


@query(
    "u1_current_and_history",
    with_views("snap", VER + " SELECT status, to_us IS NULL AS is_current, count(*) AS n FROM ver GROUP BY ALL"),
)
def u1(spark, d):
    current, history = op.split_current(_versions(spark, d))
    return (
        op.all_versions(current, history)
        .groupBy("status", F.col("to_us").isNull().alias("is_current"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "j7_bitemporal_slice",
    with_views(
        "rel",
        f"""SELECT line_id, from_ref, to_ref, weight FROM rel WHERE from_us <= {T1} AND {T1} < to_us
      AND from_us <= {T2} AND (retracted_us IS NULL OR {T2} < retracted_us)""",
    ),
)
def j7(spark, d):
    # An edge is known from its start, until it is retracted.
    edges = b.relations(spark, d).select(
        "line_id", "from_ref", "to_ref", "weight",
        F.col("from_us").alias("valid_from_us"), F.col("to_us").alias("valid_to_us"),
        "from_us", F.col("retracted_us").alias("to_us"),
    )
    return op.bitemporal_slice(edges, T1, T2).select("line_id", "from_ref", "to_ref", "weight")


@query(
    "u3_changed_fields",
    with_views(
        "snap",
        VER
        + """, p AS (SELECT *, lag(version) OVER w AS pv, lag(status) OVER w AS s0, lag(severity) OVER w AS v0, lag(confidence) OVER w AS c0, lag(summary) OVER w AS m0 FROM ver
       WINDOW w AS (PARTITION BY object_id ORDER BY from_us))
     SELECT object_id, version, CASE WHEN pv IS NULL THEN '' ELSE concat_ws(',', CASE WHEN status <> s0 THEN 'status' END, CASE WHEN severity <> v0 THEN 'severity' END,
      CASE WHEN confidence <> c0 THEN 'confidence' END, CASE WHEN summary <> m0 THEN 'summary' END) END AS changed FROM p""",
    ),
)
def u3(spark, d):
    diff = op.changed_fields(_versions(spark, d), "object_id", FIELDS)
    return diff.select("object_id", "version", F.array_join("changed", ",").alias("changed"))


@query(
    "d6_apply_changes",
    with_views(
        "snap",
        f""", base AS (SELECT * FROM snap WHERE changed_us < {T1}),
      b AS (SELECT object_id, changed_us AS from_us, lead(changed_us) OVER (PARTITION BY object_id ORDER BY changed_us) AS to_us, status FROM base),
      ch AS (SELECT object_id, changed_us AS at_us, CASE WHEN status = 'retracted' THEN 'delete' ELSE 'upsert' END AS op, status FROM snap WHERE changed_us >= {T1}),
      t AS (SELECT DISTINCT object_id FROM ch),
      s AS (SELECT object_id, from_us AS at_us, 'upsert' AS op, status FROM b WHERE to_us IS NULL AND object_id IN (SELECT object_id FROM t) UNION ALL SELECT * FROM ch),
      v AS (SELECT object_id, at_us AS from_us, lead(at_us) OVER (PARTITION BY object_id ORDER BY at_us) AS to_us, status, op FROM s)
     SELECT object_id, from_us, to_us, status, to_us IS NULL AS is_current FROM v WHERE op <> 'delete'
     UNION ALL SELECT object_id, from_us, to_us, status, to_us IS NULL FROM b WHERE to_us IS NOT NULL OR object_id NOT IN (SELECT object_id FROM t)""",
    ),
)
def d6(spark, d):
    snaps = b.snapshots(spark, d)
    before = op.build_versions(snaps.filter(F.col("changed_us") < T1), "object_id", "changed_us")
    current, history = op.split_current(before)
    changes = snaps.filter(F.col("changed_us") >= T1).select(
        "object_id",
        F.col("changed_us").alias("at_us"),
        F.when(F.col("status") == "retracted", "delete").otherwise("upsert").alias("op"),
        *FIELDS,
    )
    now, past = op.apply_changes(current, history, changes, "object_id", FIELDS)
    return op.all_versions(now, past).select(
        "object_id", "from_us", "to_us", "status", F.col("to_us").isNull().alias("is_current")
    )


@query(
    "d6_late_changes",
    with_views(
        "snap",
        """SELECT object_id, changed_us AS from_us, lead(changed_us) OVER (PARTITION BY object_id ORDER BY changed_us) AS to_us, status FROM snap""",
    ),
)
def d6_late(spark, d):
    """Half of the states come after the other half, at times in between: the
    versions are as if all had come in order."""
    snaps = b.snapshots(spark, d)
    first = F.col("changed_us") % 2 == 0
    current, history = op.split_current(op.build_versions(snaps.filter(first), "object_id", "changed_us"))
    late = snaps.filter(~first).select("object_id", F.col("changed_us").alias("at_us"), F.lit("upsert").alias("op"), *FIELDS)
    now, past = op.apply_changes(current, history, late, "object_id", FIELDS)
    return op.all_versions(now, past).select("object_id", "from_us", "to_us", "status")


@query(
    "d7_retract",
    with_views(
        "evt claims",
        """, r AS (SELECT event_id, min(at_us) AS at_us, arg_min(source_id, (at_us, source_id)) AS by_source, count(*) > 1 AS inferred FROM claims WHERE value = 'R' GROUP BY event_id)
     SELECT e.event_id, CASE WHEN r.event_id IS NULL THEN e.status ELSE 'retracted' END AS status, r.at_us AS retracted_us, r.by_source AS retracted_by,
       CASE WHEN r.event_id IS NOT NULL THEN 'returned' END AS retraction_reason, coalesce(r.inferred, false) AS retraction_inferred, e.severity FROM evt e LEFT JOIN r USING (event_id)""",
    ),
)
def d7(spark, d):
    taken_back = b.claims(spark, d).filter("value = 'R'")
    retractions = taken_back.groupBy("event_id").agg(
        F.min("at_us").alias("at_us"),
        F.min_by("source_id", F.struct("at_us", "source_id")).alias("by_source"),
        F.lit("returned").alias("reason"),
        (F.count("*") > 1).alias("inferred"),
        F.lit(None).cast("long").alias("successor"),
    )
    return op.retract(b.events(spark, d), retractions).select(
        "event_id", "status", "retracted_us", "retracted_by", "retraction_reason", "retraction_inferred", "severity"
    )


@query(
    "j5_asof_join",
    with_views(
        "obs",
        f""", l AS (SELECT obs_id, ref_id, observed_us FROM obs WHERE event_type = 'error'),
     r AS (SELECT ref_id, observed_us, max(sog_kn) AS sog_kn FROM obs WHERE event_type = 'view' GROUP BY ALL)
     SELECT l.obs_id, CASE WHEN l.observed_us - r.observed_us <= {2 * DAY} THEN r.observed_us END AS matched_us,
       CASE WHEN l.observed_us - r.observed_us <= {2 * DAY} THEN r.sog_kn END AS sog_kn
     FROM l ASOF LEFT JOIN r ON l.ref_id = r.ref_id AND l.observed_us >= r.observed_us""",
    ),
)
def j5(spark, d):
    obs = b.observations(spark, d)
    left = obs.filter("event_type = 'error'").select("obs_id", "ref_id", "observed_us")
    right = (
        obs.filter("event_type = 'view'")
        .groupBy("ref_id", F.col("observed_us").alias("seen_us"))
        .agg(F.max("sog_kn").alias("sog_kn"))
    )
    hit = op.asof_join(left, right, "ref_id", "observed_us", "seen_us", ["sog_kn"], 2 * DAY)
    return hit.select("obs_id", "matched_us", "sog_kn")


@query(
    "j15_orphans",
    "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)",
)
def j15(spark, d):
    pages = b.table(spark, d, "pages")
    return op.orphans(b.table(spark, d, "labels"), pages, "doc_id", "page_id").select("doc_id", "quality")


@query(
    "j15_delete_effects",
    with_views(
        "obs",
        """, gone AS (SELECT ref_id FROM obs GROUP BY ref_id HAVING max(metric_value) > 250)
     SELECT 'set_null' AS rule, count(*) AS n, CAST(count(*) FILTER (WHERE ref_id IN (SELECT ref_id FROM gone)) AS BIGINT) AS without_ref FROM obs
     UNION ALL SELECT 'cascade', count(*), CAST(0 AS BIGINT) FROM obs WHERE ref_id NOT IN (SELECT ref_id FROM gone)
     UNION ALL SELECT 'restrict', count(*), CAST(0 AS BIGINT) FROM obs WHERE ref_id IN (SELECT ref_id FROM gone)""",
    ),
)
def j15_delete(spark, d):
    obs = b.observations(spark, d)
    gone = obs.groupBy("ref_id").agg(F.max("metric_value").alias("top")).filter("top > 250")
    parts = [
        op.apply_delete(obs.select("ref_id", "obs_id"), gone, "ref_id", rule).agg(
            F.lit(rule).alias("rule"), F.count("*").alias("n"), F.count_if(F.col("ref_id").isNull()).alias("without_ref")
        )
        for rule in ("set_null", "cascade", "restrict")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "q10_reliability_audit",
    with_views(
        "obs",
        """, g AS (SELECT source_id, observed_us AS at_us, substr('ABCDEF', k % 6 + 1, 1) AS reliability FROM obs),
      p AS (SELECT *, lag(reliability) OVER (PARTITION BY source_id ORDER BY at_us) AS was FROM g)
     SELECT source_id, at_us, was AS from_value, reliability AS to_value FROM p WHERE was IS DISTINCT FROM reliability""",
    ),
)
def q10(spark, d):
    from tidewatch.operators.quality import reliability_changes

    return reliability_changes(_grades(spark, d))


def _grades(spark, d):
    return b.observations(spark, d).select(
        "source_id",
        F.col("observed_us").alias("at_us"),
        F.substr(F.lit("ABCDEF"), F.col("k") % 6 + 1, F.lit(1)).alias("reliability"),
    )


@query(
    "q10_reliability_at",
    with_views(
        "obs rep",
        """, g AS (SELECT source_id, observed_us AS at_us, substr('ABCDEF', k % 6 + 1, 1) AS reliability FROM obs)
     SELECT report_id, g.reliability FROM rep ASOF LEFT JOIN g ON rep.source_id = g.source_id AND rep.published_us >= g.at_us""",
    ),
)
def q10_at(spark, d):
    reports = b.reports(spark, d).select("report_id", "source_id", "published_us")
    from tidewatch.operators.quality import reliability_changes

    trail = reliability_changes(_grades(spark, d)).withColumnRenamed("to_value", "reliability")
    return op.asof_join(reports, trail, "source_id", "published_us", "at_us", ["reliability"]).select(
        "report_id", "reliability"
    )
