"""Sources, sinks and landing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import ids
from tidewatch.functions.geo import Box
from tidewatch.model import bindings as b
from tidewatch.model import labels
from tidewatch.operators import canonical, filters, quality
from tidewatch.plans.canonical import AIS, _parsed
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, with_views
from tidewatch.session import shared_folder
from tidewatch.sources import envelopes, landing


def _raw(spark, d):
    """Payloads by message kind. The archive was filled at 24 times the speed of
    the feed, so a day of messages lies in one archive hour."""
    return b.observations(spark, d).select(
        F.col("kind").alias("source_id"),
        (J + F.floor((F.col("ingested_us") - J) / 24)).alias("fetched_us"),
        F.to_json(F.struct("obs_id", "ref_id", "k")).alias("payload"),
    )


HOUR = 3_600_000_000
STORED_END = J + 6 * DAY
FETCHED = f"({J} + CAST(floor((ingested_us - {J}) / 24) AS BIGINT))"
PAYLOAD = "'{\"obs_id\":' || CAST(obs_id AS VARCHAR) || ',\"ref_id\":\"' || ref_id || '\",\"k\":' || CAST(k AS VARCHAR) || '}'"


@query(
    "s1_bronze_landing",
    with_views(
        "obs",
        f"""SELECT kind AS source, {FETCHED} // 3600000000 * 3600000000 AS hour_us, count(*) AS n,
     CAST(sum(length({PAYLOAD})) AS BIGINT) AS payload_chars FROM obs GROUP BY ALL""",
    ),
)
def s1(spark, d):
    path = shared_folder(spark)
    landing.land_bronze(_raw(spark, d), path)
    return (
        landing.read_bronze(spark, path)
        .groupBy("source", "hour_us")
        .agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("payload_chars"))
    )


@query(
    "s2_replay",
    with_views(
        "obs",
        f"""SELECT kind AS source, count(*) AS n, CAST(0 AS BIGINT) AS second_replay_adds FROM obs
     WHERE {FETCHED} >= {J + 5 * HOUR} AND {FETCHED} < {J + 9 * HOUR} GROUP BY ALL""",
    ),
)
def s2(spark, d):
    path = shared_folder(spark)
    landing.land_bronze(_raw(spark, d), path)

    def normalize(lines):
        record = F.from_json("value", "obs_id long, ref_id string, k int")
        rows = lines.select("source", "raw_ref", record.alias("r")).select("source", "raw_ref", "r.*")
        key, _ = ids.dedupe_key("feed", ["obs_id", "ref_id"])
        return rows.withColumn("dedupe_key", key)

    start, end = J + 5 * HOUR, J + 9 * HOUR
    first = landing.replay(spark, path, start, end, normalize)
    stored = shared_folder(spark)
    first.write.parquet(stored)
    silver = spark.read.parquet(stored)
    again = landing.replay(spark, path, start, end, normalize, silver)
    extra = again.groupBy("source").agg(F.count("*").alias("added"))
    return (
        silver.groupBy("source")
        .agg(F.count("*").alias("n"))
        .join(extra, "source", "left")
        .select("source", "n", F.coalesce("added", F.lit(0).cast("long")).alias("second_replay_adds"))
    )


@query(
    "s3_line_routing",
    """WITH e AS (SELECT (epoch_us(ts) // 86400000000) - 19723 AS day_no, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT day_no, CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_object' WHEN 2 THEN 'error' ELSE 'message' END AS line_kind,
  CASE WHEN k = 2 THEN 'throttled' END AS error_text, count(*) AS n FROM e GROUP BY ALL""",
)
def s3(spark, d):
    kinds = envelopes.classify_lines(b.raw_lines(spark, d))
    return kinds.groupBy("day_no", "line_kind", "error_text").agg(F.count("*").alias("n"))


@query(
    "s4_subscription",
    AIS
    + """SELECT message_type, count(*) AS n FROM pos WHERE message_type IN ('PositionReport', 'AidsToNavigationReport')
  AND ((lat BETWEEN -60 AND 0 AND lon BETWEEN -160 AND 10) OR (lat BETWEEN 0 AND 60 AND (lon >= 120 OR lon <= -100))) GROUP BY ALL""",
)
def s4(spark, d):
    m = F.col("envelope.Message")
    placed = _parsed(spark, d).filter("reject IS NULL")
    place = F.coalesce(*[F.when(F.col("message_type") == t, F.struct(m[t]["Longitude"].alias("lon"), m[t]["Latitude"].alias("lat")))
                         for t in ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport", "AidsToNavigationReport")])
    # Only real positions: the two "not available" spellings never match a box.
    rows = placed.select("message_type", "mmsi", place.alias("p")).select("message_type", "mmsi", "p.lon", "p.lat")
    rows = rows.filter("NOT (lon = 0 AND lat = 0)")
    hit = envelopes.subscribe(
        rows, [Box(-160, -60, 10, 0), Box(120, 0, -100, 60)], (), ["PositionReport", "AidsToNavigationReport"]
    )
    return hit.groupBy("message_type").agg(F.count("*").alias("n"))


@query(
    "s5_topic_split",
    AIS
    + """SELECT 'canon.observation.position' AS topic, count(*) AS n FROM usable WHERE m IN (0, 2, 3, 4)
 UNION ALL SELECT 'canon.entity.static', count(*) FROM usable WHERE m IN (1, 3, 4, 5)""",
)
def s5(spark, d):
    parsed = _parsed(spark, d)
    topics = envelopes.split_topics(canonical.ais_observations(parsed), canonical.ais_entities(parsed))
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(topic).alias("topic"), "n") for topic, df in topics.items()
    ]
    return parts[0].unionByName(parts[1])


def _records(spark, d):
    """Observation records as JSON; some lack a field, some spell one twice."""
    k = F.col("k")
    fields = F.struct(
        F.col("obs_id").cast("string").alias("obs_id"),
        F.when(k == 7, "again").alias("obsId"),
        F.when(k != 1, "1.0.0").alias("schema_version"),
        F.when(k % 10 != 3, F.col("ingested_us").cast("string")).alias("ingestedAt"),
        F.struct(F.col("source_id").alias("id")).alias("source"),
        F.struct(F.lit("vessel").alias("type"), F.col("ref_id").alias("id")).alias("entity_ref"),
        F.when(k >= 5, F.concat(F.lit("k:"), F.col("obs_id").cast("string"))).alias("dedupe_key"),
        F.when(k == 9, "x").alias("surprise"),
    )
    record = F.when(k == 99, "[]").otherwise(F.to_json(fields))
    return b.observations(spark, d).select("obs_id", record.alias("record"))


@query(
    "s6_contract_gate",
    with_views(
        "obs",
        """, j AS (SELECT CASE WHEN k = 99 THEN 'not_an_object' ELSE array_to_string(list_filter([
     CASE WHEN k = 7 THEN 'double:obs_id' END, CASE WHEN k = 1 THEN 'missing:schema_version' END,
     CASE WHEN k % 10 = 3 THEN 'missing:ingested_at' END, CASE WHEN k < 5 THEN 'missing:dedupe_key' END,
     CASE WHEN k = 9 THEN 'unknown:surprise' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM obs)
   SELECT reasons, reasons = '' AS accepted, count(*) AS n FROM j GROUP BY ALL""",
    ),
)
def s6(spark, d):
    fields = labels.REQUIRED_FIELDS["observation"]
    judged = envelopes.judge_contract(_records(spark, d), fields, "record", fields)
    return (
        judged.groupBy(F.array_join("reasons", ",").alias("reasons"))
        .agg(F.count("*").alias("n"))
        .withColumn("accepted", F.col("reasons") == "")
    )


@query(
    "s7_search_projection",
    with_views(
        "evt evt_ent",
        """SELECT event_id, type, occurred_us AS occurred_at_us, status, severity,
      (SELECT string_agg(ref_id, ',' ORDER BY ref_id) FROM (SELECT DISTINCT ref_id FROM evt_ent x WHERE x.event_id = e.event_id)) AS entity_ids,
      lon, lat FROM evt e""",
    ),
)
def s7(spark, d):
    docs = landing.project_search(b.events(spark, d), b.event_entities(spark, d))
    return docs.select(
        "event_id",
        "type",
        "occurred_at_us",
        "status",
        "severity",
        F.array_join("entity_ids", ",").alias("entity_ids"),
        F.col("geo_point.lon").alias("lon"),
        F.col("geo_point.lat").alias("lat"),
    )


@query(
    "s8_partitioned_write",
    with_views(
        "obs",
        """, p AS (SELECT CASE WHEN strftime(make_timestamp(coalesce(wire_us, ingested_us)), '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-01-31'
      THEN strftime(make_timestamp(coalesce(wire_us, ingested_us)), '%Y-%m-%d') ELSE 'stray' END AS obs_date, ref_id FROM obs)
     SELECT obs_date, count(*) AS n, count(DISTINCT ref_id) AS entities FROM p GROUP BY ALL""",
    ),
)
def s8(spark, d):
    path = shared_folder(spark)
    rows = canonical.effective_time(b.observations(spark, d))
    landing.write_observations(rows, path, "2024-01-01", "2024-01-31", at="effective_us")
    return (
        spark.read.parquet(path)
        .groupBy(F.col("obs_date").cast("string").alias("obs_date"))
        .agg(F.count("*").alias("n"), F.count_distinct("ref_id").alias("entities"))
    )


@query(
    "s8_stray_report",
    with_views(
        "obs",
        """SELECT source_id, count(*) AS stray_rows, min(wire_us) AS first_us, max(wire_us) AS last_us FROM obs
     WHERE wire_us IS NOT NULL AND NOT strftime(make_timestamp(wire_us), '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY ALL""",
    ),
)
def s8_stray(spark, d):
    rows = b.observations(spark, d).filter("wire_us IS NOT NULL")
    marked = landing.mark_partition(rows.withColumn("observed_us", F.col("wire_us")), "2024-01-01", "2024-01-31")
    return landing.stray_report(marked)


@query(
    "s9_bulk_load",
    with_views(
        "obs",
        """, g AS (SELECT *, (kind <> 'position' OR lon IS NOT NULL) AND (wire_us IS NOT NULL OR event_type <> 'signup') AS good FROM obs)
     SELECT count(*) AS input_rows, CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS rejected_rows, CAST(0 AS BIGINT) AS duplicate_rows,
       CAST(count(*) FILTER (WHERE good) AS BIGINT) AS loaded_rows FROM g""",
    ),
)
def s9(spark, d):
    rows = canonical.effective_time(b.observations(spark, d))
    key, _ = ids.dedupe_key("feed", ["obs_id", "effective_us"])
    rules = quality.OBSERVATION_LOAD_RULES()
    report = landing.bulk_load(
        rows.withColumn("dedupe_key", key), shared_folder(spark), "2024-01-01", "2024-01-31", rules, ["dedupe_key"], 90.0
    )
    return report.select("input_rows", "rejected_rows", "duplicate_rows", "loaded_rows")


@query(
    "s9_bulk_load_again",
    with_views(
        "obs",
        """, g AS (SELECT *, (kind <> 'position' OR lon IS NOT NULL) AND (wire_us IS NOT NULL OR event_type <> 'signup') AS good, event_type = 'view' AS before FROM obs)
     SELECT count(*) AS input_rows, CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS rejected_rows, CAST(count(*) FILTER (WHERE good AND before) AS BIGINT) AS duplicate_rows,
       CAST(count(*) FILTER (WHERE good AND NOT before) AS BIGINT) AS loaded_rows FROM g""",
    ),
)
def s9_again(spark, d):
    """A part is loaded, then all of it: what is stored is not loaded twice."""
    rows = canonical.effective_time(b.observations(spark, d))
    key, _ = ids.dedupe_key("feed", ["obs_id", "effective_us"])
    rows, path, rules = rows.withColumn("dedupe_key", key), shared_folder(spark), quality.OBSERVATION_LOAD_RULES()
    for part in (rows.filter("event_type = 'view'"), rows):
        report = landing.bulk_load(part, path, "2024-01-01", "2024-01-31", rules, ["dedupe_key"], 90.0)
    return report.select("input_rows", "rejected_rows", "duplicate_rows", "loaded_rows")


@query(
    "f3_entity_window_stored",
    with_views("obs", f"SELECT obs_id, observed_us FROM obs WHERE ref_id = 'mmsi:200000008' AND observed_us > {STORED_END - 5 * DAY} AND observed_us <= {STORED_END}"),
)
def f3_stored(spark, d):
    """From a table written by day, of which some days are strays."""
    path = shared_folder(spark)
    landing.write_observations(b.observations(spark, d), path, "2024-01-01", "2024-01-04")
    hit = filters.entity_window(spark.read.parquet(path), "mmsi:200000008", STORED_END, 5 * 24)
    return hit.select("obs_id", "observed_us")


@query(
    "u4_reconcile",
    with_views(
        "obs",
        """, raw AS (SELECT ref_id || '/' || CAST(observed_us // 86400000000 AS VARCHAR) AS key FROM obs),
     silver AS (SELECT key FROM (SELECT DISTINCT ref_id || '/' || CAST(observed_us // 86400000000 AS VARCHAR) AS key FROM obs WHERE k >= 10)
       UNION ALL SELECT ref_id || '/' || CAST(observed_us // 86400000000 AS VARCHAR) FROM obs WHERE k >= 60),
     l AS (SELECT key, count(*) AS a FROM raw GROUP BY key), r AS (SELECT key, count(*) AS b FROM silver GROUP BY key)
     SELECT CASE WHEN coalesce(b, 0) = 0 THEN 'missing' WHEN coalesce(a, 0) = 0 THEN 'unexplained' WHEN b > a THEN 'duplicated'
       WHEN b < a THEN 'collapsed' ELSE 'delivered' END AS verdict, count(*) AS n, CAST(sum(coalesce(a, 0)) AS BIGINT) AS raw_rows,
       CAST(sum(coalesce(b, 0)) AS BIGINT) AS silver_rows FROM l FULL JOIN r USING (key) GROUP BY ALL""",
    ),
)
def u4(spark, d):
    obs = b.observations(spark, d)
    key = F.concat_ws("/", "ref_id", F.floor(F.col("observed_us") / DAY).cast("string")).alias("key")
    silver = obs.filter("k >= 10").select(key).distinct().unionByName(obs.filter("k >= 60").select(key))
    return (
        landing.reconcile(obs.select(key), silver, "key")
        .groupBy("verdict")
        .agg(F.count("*").alias("n"), F.sum("raw_rows").alias("raw_rows"), F.sum("silver_rows").alias("silver_rows"))
    )
