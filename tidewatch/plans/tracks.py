"""Order-dependent queries: jumps, gaps, tracks, revisions, movement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.series import Series, day_of
from tidewatch.model import bindings as b
from tidewatch.operators import movement
from tidewatch.operators import track as op
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, haversine, with_views
from tidewatch.plans.metrics import GAPS_SQL, HOUR, NOW

JUMPS = f""", e AS (SELECT *, coalesce(wire_us, ingested_us) AS effective_us FROM obs),
  p AS (SELECT *, lag(effective_us) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM e WHERE lon IS NOT NULL
    WINDOW w AS (PARTITION BY ref_id ORDER BY arrival, obs_id)),
  j AS (SELECT *, (effective_us - pt) / 1e6 AS dt, {haversine('plon', 'plat', 'lon', 'lat')} AS m FROM p),
  jumps AS (SELECT *, CASE WHEN dt > 0 THEN m / dt * 3600 / 1852 END AS implied_kn FROM j)"""


def _effective(spark, d):
    return b.observations(spark, d).withColumn("effective_us", F.coalesce("wire_us", "ingested_us"))


@query(
    "w1_flag_jumps",
    with_views(
        "obs",
        JUMPS
        + """ SELECT obs_id, CASE WHEN dt < 0 THEN 'out_of_order_timestamp' WHEN implied_kn > 100 THEN 'impossible_speed' END AS jump_flag FROM jumps
     UNION ALL SELECT obs_id, NULL FROM obs WHERE lon IS NULL""",
    ),
)
def w1(spark, d):
    return op.flag_jumps(_effective(spark, d)).select("obs_id", "jump_flag")


@query(
    "w2_seconds_since_previous",
    with_views("obs", JUMPS + " SELECT obs_id, CASE WHEN dt >= 0 THEN round(dt, 3) END AS seconds_since_previous FROM jumps"),
)
def w2(spark, d):
    return op.flag_jumps(_effective(spark, d)).filter("lon IS NOT NULL").select("obs_id", "seconds_since_previous")


@query(
    "w3_latest_position",
    with_views(
        "obs",
        """SELECT ref_id, obs_id, observed_us, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY observed_us DESC, obs_id DESC) AS rn
     FROM obs WHERE lon IS NOT NULL) WHERE rn = 1""",
    ),
)
def w3(spark, d):
    return op.latest_position(b.observations(spark, d)).select("ref_id", "obs_id", "observed_us", "lon", "lat")


@query(
    "w4_track_gaps",
    with_views(
        "obs",
        GAPS_SQL + " SELECT ref_id, gap_start_us, gap_end_us, round(duration_s, 6) AS duration_s, round(distance_m, 2) AS distance_m, reason FROM gaps",
    ),
)
def w4(spark, d):
    return op.track_gaps(b.observations(spark, d), 43200.0, NOW).select(
        "ref_id", "gap_start_us", "gap_end_us", F.round("duration_s", 6).alias("duration_s"), F.round("distance_m", 2).alias("distance_m"), "reason"
    )


@query(
    "f9_open_gaps",
    with_views("obs", GAPS_SQL + " SELECT ref_id, gap_start_us FROM gaps WHERE gap_end_us IS NULL"),
)
def f9_gaps(spark, d):
    from tidewatch.operators.filters import open_gaps

    return open_gaps(op.track_gaps(b.observations(spark, d), 43200.0, NOW)).select("ref_id", "gap_start_us")


TRACKS = f""", q AS (SELECT *, lag(observed_us) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM obs WHERE lon IS NOT NULL
    WINDOW w AS (PARTITION BY ref_id ORDER BY observed_us, obs_id)),
  s AS (SELECT *, pt IS NULL OR (observed_us - pt) / 1e6 > 43200 AS starts FROM q),
  tracks AS (SELECT *, CASE WHEN NOT starts THEN {haversine('plon', 'plat', 'lon', 'lat')} END AS leg_m,
   ref_id || '#' || CAST(last_value(CASE WHEN starts THEN observed_us END IGNORE NULLS) OVER (PARTITION BY ref_id ORDER BY observed_us, obs_id) AS VARCHAR) AS track_id FROM s)"""


@query("w5_assign_tracks", with_views("obs", TRACKS + " SELECT obs_id, track_id, round(leg_m, 2) AS leg_m FROM tracks"))
def w5(spark, d):
    return op.assign_tracks(b.observations(spark, d), 43200.0).select("obs_id", "track_id", F.round("leg_m", 2).alias("leg_m"))


@query(
    "a4_track_summary",
    with_views(
        "obs",
        TRACKS
        + f""", g AS (SELECT ref_id, track_id, min(observed_us) AS time_start_us, max(observed_us) AS last_point_us, count(*) AS point_count,
      round(coalesce(sum(leg_m), 0), 1) AS distance_m, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north,
      string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids, arg_max(lon, (observed_us, obs_id)) AS last_lon FROM tracks GROUP BY ALL)
     SELECT *, ({NOW} - last_point_us) / 1e6 <= 43200 AS is_open, CASE WHEN ({NOW} - last_point_us) / 1e6 > 43200 THEN last_point_us END AS time_end_us FROM g""",
    ),
)
def a4(spark, d):
    s = op.track_summary(op.assign_tracks(b.observations(spark, d), 43200.0), 43200.0, NOW)
    return s.select(
        "ref_id", "track_id", "time_start_us", "last_point_us", "point_count", F.round("distance_m", 1).alias("distance_m"),
        "west", "south", "east", "north", F.array_join("source_ids", ",").alias("source_ids"),
        F.col("last_point.lon").alias("last_lon"), "is_open", "time_end_us",
    )


@query(
    "w6_current_revisions",
    with_views(
        "obs",
        f"""SELECT obs_id, ref_id, observed_us // {DAY} * {DAY} AS period_us, row_number() OVER w - 1 AS revision, lag(metric_value) OVER w AS previous_value,
      lead(obs_id) OVER w IS NULL AS is_current FROM obs WHERE metric IS NOT NULL
      WINDOW w AS (PARTITION BY ref_id, metric, observed_us // {DAY} ORDER BY ingested_us, obs_id)""",
    ),
)
def w6(spark, d):
    return op.current_revisions(b.observations(spark, d), DAY).select(
        "obs_id", "ref_id", "period_us", "revision", "previous_value", "is_current"
    )


@query(
    "w10_rate_change",
    with_views(
        "obs",
        f""", h AS (SELECT source_id, observed_us // {HOUR} AS hour, count(*) AS n FROM obs GROUP BY ALL),
     b AS (SELECT source_id, hour, n, coalesce(sum(n) OVER w, 0) / 24 AS baseline, coalesce(sum(n * n) OVER w, 0) / 24 AS sq FROM h
       WINDOW w AS (PARTITION BY source_id ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)),
     s AS (SELECT *, sqrt(greatest(0e0, sq - baseline * baseline)) AS spread FROM b)
     SELECT source_id, hour, n, round(baseline, 6) AS baseline, round(spread, 6) AS spread, round(CASE WHEN spread > 0 THEN (n - baseline) / spread END, 6) AS z FROM s""",
    ),
)
def w10(spark, d):
    r = op.rate_change(b.observations(spark, d), "source_id")
    return r.select("source_id", "hour", "n", *[F.round(c, 6).alias(c) for c in ("baseline", "spread", "z")])


@query(
    "k4_latest_n",
    with_views(
        "obs",
        """SELECT ref_id, obs_id, observed_us, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY observed_us DESC, obs_id DESC) AS rn FROM obs) WHERE rn <= 5""",
    ),
)
def k4(spark, d):
    return op.latest_n(b.observations(spark, d), 5).select("ref_id", "obs_id", "observed_us", "rank_no")


@query(
    "a19_lifecycle",
    with_views(
        "obs",
        f"""SELECT ref_id, min(observed_us) AS first_seen_us, max(observed_us) AS last_seen_us, count(*) AS n,
      ({J + 30 * DAY} - max(observed_us)) / 1e6 <= 86400 AS is_active FROM obs GROUP BY ref_id""",
    ),
)
def a19(spark, d):
    return op.entity_lifecycle(b.observations(spark, d), J + 30 * DAY, 86400.0)


@query(
    "v1_simplify_tracks",
    with_views(
        "obs",
        TRACKS + " SELECT track_id, count(*) AS points, true AS ends_kept, true AS within_tolerance, true AS fewer_or_equal FROM tracks GROUP BY track_id",
    ),
)
def v1(spark, d):
    """What a simplified track promises, judged from all of its points: first and
    last are kept, and every other lies near the line of the kept ones."""
    points = op.assign_tracks(b.observations(spark, d), 43200.0).select("track_id", "obs_id", "observed_us", "lon", "lat")
    kept = movement.simplify_tracks(points, 5000.0).select("track_id", "obs_id", F.lit(True).alias("kept"))
    day = day_of("observed_us")
    # Distances are taken in the plane of the day's first point.
    origin = F.min_by(F.struct("lon", "lat"), F.struct("observed_us", "obs_id")).alias("origin")
    plane = points.groupBy("track_id", day.alias("day")).agg(origin)
    marked = points.join(kept, ["track_id", "obs_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    here = F.when(F.col("kept"), F.struct("lon", "lat"))
    forward = Series(["track_id"], ["observed_us", "obs_id"], day)
    seen = forward.add(marked, forward.last_known(here, "a"), forward.row_number("no")).withColumns({"down": -F.col("observed_us"), "down_id": -F.col("obs_id")})
    backward = Series(["track_id"], ["down", "down_id"], -day)
    seen = backward.add(seen, backward.last_known(here, "b"), backward.row_number("left")).withColumn("day", day).join(plane, ["track_id", "day"])
    scale = movement.METRES_PER_DEGREE
    kx = F.cos(F.radians("origin.lat")) * scale
    ax, ay = (F.col("a.lon") - F.col("lon")) * kx, (F.col("a.lat") - F.col("lat")) * scale
    dx, dy = (F.col("b.lon") - F.col("a.lon")) * kx, (F.col("b.lat") - F.col("a.lat")) * scale
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / norm)))
    off = F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))
    end = (F.col("no") == 1) | (F.col("left") == 1)
    return seen.groupBy("track_id").agg(
        F.count("*").alias("points"),
        F.min(F.when(end, F.col("kept")).otherwise(True)).alias("ends_kept"),
        F.coalesce(F.max(F.when(F.col("kept"), 0.0).otherwise(off)) <= 5000.001, F.lit(False)).alias("within_tolerance"),
        (F.count_if("kept") <= F.count("*")).alias("fewer_or_equal"),
    )


@query(
    "v2_dead_reckon",
    with_views(
        "obs",
        f""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY observed_us DESC, obs_id DESC) AS rn FROM obs WHERE lon IS NOT NULL) WHERE rn = 1),
     r AS (SELECT *, sog_kn * 1852 * (greatest(0, {NOW} - observed_us) / 3.6e9) AS reach FROM l)
     SELECT ref_id, round(greatest(0, reach * 0.75), 3) AS inner_m, round(reach * 1.25, 3) AS outer_m, CAST(19 AS INTEGER) AS corners,
      round(degrees(asin(sin(radians(lat)) * cos(reach * 1.25 / 6371008.8) + cos(radians(lat)) * sin(reach * 1.25 / 6371008.8) * cos(radians(cog_deg - 20)))), 5) AS first_corner_lat FROM r""",
    ),
)
def v2(spark, d):
    area = op.dead_reckon(op.latest_position(b.observations(spark, d)), NOW, 20.0, 0.25)
    return area.select(
        "ref_id",
        F.round("inner_m", 3).alias("inner_m"),
        F.round("outer_m", 3).alias("outer_m"),
        F.size("area").alias("corners"),
        F.round(F.col("area")[0]["lat"], 5).alias("first_corner_lat"),
    )


@query(
    "v3_rendezvous",
    with_views(
        "obs",
        f""", s AS (SELECT ref_id, observed_us // {12 * HOUR} AS bucket, arg_max(lon, (observed_us, obs_id)) AS lon, arg_max(lat, (observed_us, obs_id)) AS lat FROM obs
       WHERE lon IS NOT NULL GROUP BY ALL),
     m AS (SELECT x.ref_id AS a, y.ref_id AS b, bucket, {haversine('x.lon', 'x.lat', 'y.lon', 'y.lat')} AS d FROM s x JOIN s y USING (bucket) WHERE x.ref_id < y.ref_id
        AND abs(x.lat - y.lat) < 1),
     n AS (SELECT *, bucket - row_number() OVER (PARTITION BY a, b ORDER BY bucket) AS island FROM m WHERE d <= 12000)
     SELECT a AS from_ref, b AS to_ref, min(bucket) * {12 * HOUR} AS from_us, (max(bucket) + 1) * {12 * HOUR} AS to_us, count(*) AS buckets, round(min(d), 2) AS closest_m
     FROM n GROUP BY a, b, island HAVING count(*) >= 2""",
    ),
)
def v3(spark, d):
    r = movement.rendezvous(b.observations(spark, d), 12000.0, 12 * HOUR, 2)
    return r.select("from_ref", "to_ref", "from_us", "to_us", "buckets", F.round("closest_m", 2).alias("closest_m"))


@query(
    "v4_duplicate_senders",
    with_views(
        "obs",
        JUMPS
        + f""" SELECT ref_id, observed_us // {DAY} AS day, count(*) AS jumps, round(max(implied_kn), 3) AS max_kn FROM jumps WHERE implied_kn > 100 OR (dt = 0 AND m > 1000)
     GROUP BY ALL HAVING count(*) >= 2""",
    ),
)
def v4(spark, d):
    return op.duplicate_senders(op.flag_jumps(_effective(spark, d))).withColumn("max_kn", F.round("max_kn", 3))


@query(
    "v5_lead_lag",
    with_views(
        "obs",
        f""", c AS (SELECT observed_us // {HOUR} AS bucket, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM obs
        WHERE event_type IN ('view', 'purchase') GROUP BY ALL),
     f AS (SELECT bucket, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM c) LEFT JOIN c USING (bucket)),
     r AS (SELECT lag, corr(x.a, y.b) AS r, count(*) AS n FROM (SELECT unnest(range(-12, 13)) AS lag), f x, f y WHERE y.bucket = x.bucket + lag GROUP BY lag),
     z AS (SELECT *, abs(atanh(r)) * sqrt(n - 3) AS z, 1 / (1 + 0.2316419 * (abs(atanh(r)) * sqrt(n - 3))) AS t FROM r),
     p AS (SELECT *, least(1e0, 2 * exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS p FROM z)
     SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS r, n, round(p, 6) AS p_value, round(least(1e0, p * 25), 6) AS p_corrected, CAST(25 AS INTEGER) AS comparisons FROM p""",
    ),
)
def v5(spark, d):
    obs = b.observations(spark, d)
    r = movement.lead_lag(obs.filter("event_type = 'view'"), obs.filter("event_type = 'purchase'"), 12)
    return r.select(
        "lag", F.round("r", 6).alias("r"), "n", F.round("p_value", 6).alias("p_value"), F.round("p_corrected", 6).alias("p_corrected"), "comparisons"
    )
