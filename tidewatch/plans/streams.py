"""Streaming queries, run to completion in several restarts.

Each query feeds the whole table in time slices. After every slice the stream is
started again from its checkpoint, so each result also shows that a restart
neither loses nor repeats anything.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import ids
from tidewatch.model import bindings as b
from tidewatch.operators import metrics, track
from tidewatch.plans.bitemporal import FIELDS, VER
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, with_views
from tidewatch.plans.metrics import HOUR, _messages
from tidewatch.plans.tracks import JUMPS
from tidewatch.session import shared_folder
from tidewatch.sources.versions import VersionStore
from tidewatch.streaming import jobs, keyed


def feed(spark, df, slice_no, start, slices=2):
    """Append slice after slice to a folder; ``start(folder)`` runs the stream."""
    folder = shared_folder(spark)
    keyed = df.withColumn("__slice", slice_no.cast("int"))
    for i in range(slices):
        keyed.filter(F.col("__slice") == i).drop("__slice").write.mode("append").parquet(f"{folder}/in")
        start(jobs.open_stream(spark, f"{folder}/in", df.schema), folder)
    return folder


def quarter(us):
    """0 to 3: four weeks' worth of slices, so three restarts."""
    return F.least(F.floor((us - J) / (8 * DAY)), F.lit(3))


def half(us):
    """0 for the first fortnight, 1 for the rest."""
    return F.when(us < J + 15 * DAY, 0).otherwise(1)


def arrival_half(df):
    """Arrival order in two blocks that follow each other."""
    middle = df.agg((F.max("arrival") / 2).alias("middle")).first()["middle"]
    return F.when(F.col("arrival") <= middle, 0).otherwise(1)


@query(
    "x1_ingest",
    with_views(
        "obs",
        """SELECT 'silver' AS kind, count(*) AS n FROM obs WHERE k > 2 UNION ALL SELECT 'dead', count(*) FROM obs WHERE k <= 2""",
    ),
)
def x1(spark, d):
    def normalize(lines):
        key, _ = ids.dedupe_key("feed", ["id"])
        return lines.select("event_id", F.get_json_object("value", "$.id").cast("long").alias("id"), "value").withColumn("dedupe_key", key)

    lines = b.raw_lines(spark, d)
    # The second slice repeats the end of the first: a redelivery.
    again = lines.filter("day_no BETWEEN 13 AND 14").withColumn("day_no", F.lit(99).cast("long"))
    fed = lines.unionByName(again.filter("k > 2"))
    folder = feed(spark, fed, F.when(F.col("day_no") < 15, 0).otherwise(1), lambda s, f: jobs.ingest(s, f, normalize))
    silver = spark.read.parquet(f"{folder}/silver").agg(F.lit("silver").alias("kind"), F.count("*").alias("n"))
    dead = spark.read.parquet(f"{folder}/dead").agg(F.lit("dead").alias("kind"), F.count("*").alias("n"))
    return silver.unionByName(dead)


@query(
    "x1_ingest_by_block",
    with_views("obs", """SELECT obs_id // 500 AS block, count(*) AS n FROM obs WHERE k > 2 GROUP BY ALL"""),
)
def x1_by_block(spark, d):
    """Silver laid out by a column that a redelivery repeats, here blocks of ids."""

    def normalize(lines):
        key, _ = ids.dedupe_key("feed", ["id"])
        rows = lines.select(F.get_json_object("value", "$.id").cast("long").alias("id")).withColumn("dedupe_key", key)
        return rows.withColumn("block", F.floor(F.col("id") / 500))

    lines = b.raw_lines(spark, d)
    again = lines.filter("day_no BETWEEN 13 AND 14 AND k > 2").withColumn("day_no", F.lit(99).cast("long"))
    folder = feed(spark, lines.unionByName(again), F.when(F.col("day_no") < 15, 0).otherwise(1), lambda s, f: jobs.ingest(s, f, normalize, "block"))
    return spark.read.parquet(f"{folder}/silver").groupBy(F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"))


@query("x2_dedupe_window", with_views("obs", "SELECT source_id, count(*) AS n FROM obs GROUP BY ALL"))
def x2(spark, d):
    obs = b.observations(spark, d).select(
        "source_id", F.col("obs_id").cast("string").alias("dedupe_key"), F.timestamp_micros("observed_us").alias("at")
    )
    doubled = obs.unionByName(obs.filter(F.col("source_id") != "src1"))
    day = F.unix_micros("at")

    def start(stream, folder):
        jobs.write_append(jobs.dedupe_window(stream, "at"), folder)

    folder = feed(spark, doubled, half(day), start)
    return jobs.results(spark, folder).groupBy("source_id").agg(F.count("*").alias("n"))


#: A sender that is silent for longer is let go.
TTL = DAY


@query(
    "x3_jump_check",
    with_views(
        "obs",
        JUMPS.replace("lag(effective_us) OVER w AS pt", "lag(ingested_us) OVER w AS pi, lag(effective_us) OVER w AS pt")
        + f""" SELECT obs_id, CASE WHEN ingested_us - pi > {TTL} THEN NULL WHEN dt < 0 THEN 'out_of_order_timestamp' WHEN implied_kn > 100 THEN 'impossible_speed' END AS jump_flag FROM jumps""",
    ),
)
def x3(spark, d):
    """Against the last position within a day by the arrival clock; restarts in between."""
    obs = b.observations(spark, d).filter("lon IS NOT NULL").withColumn("effective_us", F.coalesce("wire_us", "ingested_us"))
    rows = obs.select(
        "obs_id", "ref_id", "arrival", "ingested_us", "effective_us", "lon", "lat", F.timestamp_micros("ingested_us").alias("at")
    )

    def start(stream, folder):
        # Arrival numbers and ingest times may disagree by days in the test tables.
        keyed.run_keyed(stream, "ref_id", "at", "15 days", keyed.PreviousPosition(TTL), folder)

    folder = feed(spark, rows, arrival_half(rows), start)
    flagged = track.judge_jumps(spark.read.parquet(f"{folder}/out"), "effective_us", "prev_us", "prev_lon", "prev_lat")
    return flagged.select("obs_id", "jump_flag")


@query(
    "x4_late_rows",
    with_views(
        "obs",
        f""", m AS (SELECT max(arrival) / 2 AS mid FROM obs), hi AS (SELECT max(observed_us) AS high FROM obs, m WHERE arrival <= mid)
     SELECT kind, arrival > mid AND observed_us < high - {HOUR} AS is_late, count(*) AS n FROM obs, m, hi GROUP BY ALL""",
    ),
)
def x4(spark, d):
    rows = b.observations(spark, d).select("obs_id", "arrival", "kind", "observed_us")

    def start(stream, folder):
        jobs.stateful_batches(stream, jobs.late_step("observed_us", HOUR), folder)

    folder = feed(spark, rows, arrival_half(rows), start)
    return jobs.results(spark, folder).groupBy("kind", "is_late").agg(F.count("*").alias("n"))


DELAY, MINUTE = 10 * 60_000_000, 60_000_000

# Rows of the first fortnight that come in with the second, and are late by then.
# Later, the clock stands at the newest row in time less the delay.
SPLIT_SQL = f""", m AS (SELECT *, observed_us < {J + 15 * DAY} AS early, observed_us < {J + 15 * DAY} AND obs_id % 97 = 0 AS moved FROM obs),
  h AS (SELECT max(observed_us) - {DELAY} AS first_mark FROM m WHERE early AND NOT moved),
  t AS (SELECT m.*, moved AND observed_us < first_mark AS is_late FROM m, h),
  ontime AS (SELECT * FROM t WHERE NOT is_late),
  wm AS (SELECT (max(observed_us) - {DELAY}) // 1000 * 1000 AS mark FROM ontime)"""


def _second_thoughts(rows, us):
    """Slice of a row: some of the first fortnight only come in later."""
    return F.when((us < J + 15 * DAY) & (F.col("obs_id") % 97 != 0), 0).otherwise(1)


def _split_feed(spark, d, run, *columns):
    """Rows in time go to ``run``; late ones to the side table."""
    rows = b.observations(spark, d).select("obs_id", "observed_us", F.timestamp_micros("observed_us").alias("at"), *columns)

    def start(stream, folder):
        ontime = jobs.split_late(stream, folder, "observed_us", DELAY)
        run(ontime, f"{folder}/windows")

    folder = feed(spark, rows, _second_thoughts(rows, F.col("observed_us")), start)
    return folder


@query(
    "x5_windowed_counts",
    with_views(
        "obs",
        SPLIT_SQL
        + f""" SELECT source_id, observed_us // {6 * HOUR} * {6 * HOUR} AS start_us, observed_us // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} AS end_us, count(*) AS n,
      CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM ontime, wm
      WHERE observed_us // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} <= mark GROUP BY ALL""",
    ),
)
def x5(spark, d):
    """Finished windows only, each given out once."""

    def run(stream, folder):
        jobs.write_append(jobs.windowed_counts(stream, "at", "6 hours"), folder)

    return jobs.results(spark, _split_feed(spark, d, run, "source_id", "event_type") + "/windows")


@query(
    "x5_late_rows",
    with_views("obs", SPLIT_SQL + " SELECT source_id, count(*) AS late, min(observed_us) AS oldest_us FROM t WHERE is_late GROUP BY source_id"),
)
def x5_late(spark, d):
    """The side table of rows that came too late for their window."""
    folder = _split_feed(spark, d, lambda stream, f: None, "source_id")
    return jobs.late_rows(spark, folder).groupBy("source_id").agg(F.count("*").alias("late"), F.min("observed_us").alias("oldest_us"))


@query(
    "x5_sliding_counts",
    with_views(
        "obs",
        SPLIT_SQL
        + f""" SELECT source_id, s AS start_us, s + {DAY} AS end_us, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors
      FROM (SELECT *, unnest([observed_us // {12 * HOUR} * {12 * HOUR}, observed_us // {12 * HOUR} * {12 * HOUR} - {12 * HOUR}]) AS s FROM ontime), wm
      WHERE s + {DAY} <= mark GROUP BY ALL""",
    ),
)
def x5_sliding(spark, d):
    def run(stream, folder):
        jobs.write_append(jobs.windowed_counts(stream, "at", "24 hours", "12 hours"), folder)

    return jobs.results(spark, _split_feed(spark, d, run, "source_id", "event_type") + "/windows")


@query(
    "x6_session_tracks",
    with_views(
        "obs",
        SPLIT_SQL
        + f""", q AS (SELECT *, lag(observed_us) OVER w AS pt FROM ontime WHERE lon IS NOT NULL WINDOW w AS (PARTITION BY ref_id ORDER BY observed_us, obs_id)),
      s AS (SELECT *, sum(CASE WHEN pt IS NULL OR observed_us - pt >= {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY observed_us, obs_id) AS no FROM q),
      g AS (SELECT ref_id, min(observed_us) AS time_start_us, max(observed_us) AS last_point_us, count(*) AS point_count FROM s GROUP BY ref_id, no),
      pwm AS (SELECT (max(observed_us) - {DELAY}) // 1000 * 1000 AS mark FROM ontime WHERE lon IS NOT NULL)
     SELECT ref_id, ref_id || '#' || time_start_us AS track_id, time_start_us, last_point_us, point_count FROM g, pwm WHERE last_point_us + {12 * HOUR} <= mark""",
    ),
)
def x6(spark, d):
    """Ended tracks only, each given out once."""

    def run(stream, folder):
        jobs.write_append(jobs.session_tracks(stream.filter("lon IS NOT NULL"), "at", "12 hours"), folder)

    return jobs.results(spark, _split_feed(spark, d, run, "ref_id", "lon") + "/windows")


@query(
    "x7_open_alerts",
    with_views(
        "alerts",
        f""", h AS (SELECT *, k % 7 IN (3, 4, 5) AS closes, CASE WHEN alert_id % 5 = 0 THEN seen_us + {3 * DAY} END AS expires_us,
       row_number() OVER (PARTITION BY dedupe_key ORDER BY seen_us, alert_id) AS rn FROM alerts),
     r AS (SELECT dedupe_key, rn, alert_id AS open_alert_id, 1 AS n, seen_us AS first_us, seen_us AS last_us, expires_us, closes FROM h WHERE rn = 1
       UNION ALL SELECT dedupe_key, rn, CASE WHEN fresh THEN alert_id ELSE open_alert_id END, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN seen_us ELSE first_us END,
         seen_us, CASE WHEN fresh THEN now_expires ELSE expires_us END, now_closes
       FROM (SELECT h.dedupe_key, h.rn, h.alert_id, h.seen_us, h.expires_us AS now_expires, h.closes AS now_closes, r.open_alert_id, r.n, r.first_us, r.expires_us,
         r.closes OR h.seen_us - r.last_us > {5 * DAY} OR coalesce(h.seen_us >= r.expires_us, false) AS fresh
         FROM r JOIN h ON h.dedupe_key = r.dedupe_key AND h.rn = r.rn + 1)),
     a AS (SELECT *, coalesce(expires_us <= last_us + {5 * DAY}, false) AS by_expiry, least(expires_us, last_us + {5 * DAY}) AS due FROM r
       QUALIFY row_number() OVER (PARTITION BY dedupe_key, open_alert_id ORDER BY rn DESC) = 1),
     e AS (SELECT *, max(rn) OVER (PARTITION BY dedupe_key) > rn AS followed, (SELECT max(seen_us) - {MINUTE} FROM alerts) // 1000 AS mark FROM a)
     SELECT dedupe_key, open_alert_id, CAST(n AS BIGINT) AS occurrence_count, first_us AS first_seen_us, last_us AS last_seen_us,
       CASE WHEN closes THEN last_us WHEN followed OR due // 1000 + 1 <= mark THEN due END AS closed_us,
       CASE WHEN closes THEN 'resolved' WHEN NOT (followed OR due // 1000 + 1 <= mark) THEN NULL WHEN by_expiry THEN 'expired' ELSE 'quiet' END AS close_reason FROM e""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def x7(spark, d):
    """Alerts that ended, and those that the state store still holds, after three restarts."""
    expires = F.when(F.col("alert_id") % 5 == 0, F.col("seen_us") + 3 * DAY)
    hits = b.alert_hits(spark, d).select(
        "alert_id", "dedupe_key", "seen_us", (F.col("k") % 7).isin(3, 4, 5).alias("closes"), expires.alias("expires_us"),
        F.timestamp_micros("seen_us").alias("at"),
    )

    def start(stream, folder):
        keyed.run_keyed(stream, "dedupe_key", "at", "1 minute", keyed.OpenAlerts(5 * DAY), folder)

    folder = feed(spark, hits, quarter(F.col("seen_us")), start, slices=4)
    open_ = keyed.stored(spark, f"{folder}/checkpoint", "alert").select(
        "dedupe_key", "open_alert_id", "occurrence_count", "first_seen_us", "last_seen_us",
        F.lit(None).cast("long").alias("closed_us"), F.lit(None).cast("string").alias("close_reason"),
    )
    return spark.read.parquet(f"{folder}/out").unionByName(open_)


@query(
    "x8_silence",
    with_views(
        "obs",
        f""", t AS (SELECT DISTINCT source_id, observed_us AS us FROM obs), n AS (SELECT source_id, us, lead(us) OVER (PARTITION BY source_id ORDER BY us) AS nxt FROM t),
     w AS (SELECT (max(observed_us) - {HOUR}) // 1000 * 1000 AS mark FROM obs)
     SELECT source_id, us AS gap_start_us, CASE WHEN nxt <= mark THEN nxt END AS gap_end_us FROM n, w
     WHERE (nxt - us > {6 * HOUR} OR nxt IS NULL) AND us + {6 * HOUR} < mark""",
    ),
)
def x8(spark, d):
    """Silences of over six hours; a source that is silent at the end has an open row."""
    rows = b.observations(spark, d).select("source_id", F.col("observed_us").alias("at_us"), F.timestamp_micros("observed_us").alias("at"))

    def start(stream, folder):
        keyed.run_keyed(stream, "source_id", "at", "1 hour", keyed.Silences(6 * HOUR), folder)

    folder = feed(spark, rows, quarter(F.col("at_us")), start, slices=4)
    # An open row and its later end are one gap.
    return spark.read.parquet(f"{folder}/out").groupBy("source_id", "gap_start_us").agg(F.max("gap_end_us").alias("gap_end_us"))


@query(
    "x9_overload",
    with_views(
        "obs",
        f"""SELECT ref_id, count(*) AS rows_in, max(observed_us) AS newest_us FROM obs GROUP BY ref_id""",
    ),
)
def x9(spark, d):
    rows = b.observations(spark, d).select("ref_id", "obs_id", "observed_us")

    def start(stream, folder):
        jobs.stateful_batches(stream, jobs.conflate_step("ref_id", ["observed_us", "obs_id"]), folder)

    folder = feed(spark, rows, half(F.col("observed_us")), start)
    # Kept plus counted losses is everything that came in.
    return jobs.results(spark, folder).groupBy("ref_id").agg(
        (F.count("*") + F.sum("dropped")).alias("rows_in"), F.max("observed_us").alias("newest_us")
    )


@query(
    "x10_drift",
    """WITH e AS (SELECT DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
 SELECT 'type_change' AS kind, 'k' AS path, 'int' AS was, 'string' AS now FROM e WHERE k = 3
 UNION ALL SELECT 'cardinality_change', 'k', 'int', 'array' FROM e WHERE k = 6
 UNION ALL SELECT 'new_field', 'k[]', NULL, 'int' FROM e WHERE k = 6
 UNION ALL SELECT 'new_field', 'extra', NULL, 'bool' FROM e WHERE k = 8
 UNION ALL SELECT 'missing_field', 'k', 'int', NULL FROM e WHERE k = 7""",
)
def x10(spark, d):
    from tidewatch.session import cut_lineage

    lines = _messages(spark, d).select("event_id", "day_no", "value", "k")
    shape = cut_lineage(metrics.learn_shape(lines.filter("k > 8")))

    def start(stream, folder):
        jobs.stateful_batches(stream, jobs.drift_step(shape), folder)

    folder = feed(spark, lines, F.when(F.col("day_no") < 15, 0).otherwise(1), start)
    return jobs.results(spark, folder).select("kind", "path", "was", "now")


SPLIT = 962409600000000


@query(
    "x11_version_feed",
    with_views("snap", VER + " SELECT object_id, from_us, to_us, status, summary FROM ver"),
)
def x11(spark, d):
    changes = b.snapshots(spark, d).select("object_id", F.col("changed_us").alias("at_us"), F.lit("upsert").alias("op"), *FIELDS)

    def store(folder):
        return VersionStore(f"{folder}/versions", "object_id", FIELDS, changes.schema, buckets=8)

    def start(stream, folder):
        jobs.version_feed(stream, store(folder), f"{folder}/checkpoint")

    folder = feed(spark, changes, F.when(F.col("at_us") < SPLIT, 0).otherwise(1), start)
    return store(folder).read(spark).select("object_id", "from_us", "to_us", "status", "summary")
