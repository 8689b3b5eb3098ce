"""Counters, lag, health, density, roll-ups, record shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.model import bindings as b
from tidewatch.model import labels
from tidewatch.operators import metrics as op
from tidewatch.operators import track
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, haversine, with_views
from tidewatch.sources.envelopes import classify_lines

HOUR = 3_600_000_000
NOW = J + 31 * DAY


@query(
    "a1_pipeline_counts",
    with_views(
        "obs",
        """, w AS (SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE wire_us IS NOT NULL) AS normalized,
      count(*) FILTER (WHERE kind <> 'status') AS published, count(*) FILTER (WHERE k < 2) AS skipped_duplicate FROM obs GROUP BY source_id)
     SELECT source_id, stage, n FROM w UNPIVOT (n FOR stage IN (fetched, normalized, published, skipped_duplicate))""",
    ),
)
def a1(spark, d):
    stages = {
        "fetched": F.lit(True),
        "normalized": F.col("wire_us").isNotNull(),
        "published": F.col("kind") != "status",
        "skipped_duplicate": F.col("k") < 2,
    }
    assert list(stages) == labels.STAGES
    return op.pipeline_counts(b.observations(spark, d), ["source_id"], stages)


@query(
    "a1_flag_counts",
    with_views(
        "obs",
        """, f AS (SELECT kind, CASE WHEN wire_us IS NULL THEN 'no_source_timestamp' WHEN wire_us > ingested_us + 300000000 THEN 'future_timestamp'
       WHEN wire_us <= 0 THEN 'epoch_zero_timestamp' END AS flag FROM obs)
     SELECT kind, flag, n FROM (SELECT kind, count(*) FILTER (WHERE flag = 'no_source_timestamp') AS no_source_timestamp,
       count(*) FILTER (WHERE flag = 'future_timestamp') AS future_timestamp, count(*) FILTER (WHERE flag = 'epoch_zero_timestamp') AS epoch_zero_timestamp,
       CAST(0 AS BIGINT) AS null_island FROM f GROUP BY kind) UNPIVOT (n FOR flag IN (no_source_timestamp, future_timestamp, epoch_zero_timestamp, null_island))""",
    ),
)
def a1_flags(spark, d):
    from tidewatch.operators.canonical import time_quality

    rows = time_quality(b.observations(spark, d), F.col("ingested_us"), 300.0, "wire_us")
    rows = rows.withColumn("flags", F.array_compact(F.array("time_flag")))
    known = ["no_source_timestamp", "future_timestamp", "epoch_zero_timestamp", "null_island"]
    return op.flag_counts(rows, ["kind"], "flags", known)


def _lag():
    return (F.col("ingested_us") - F.col("wire_us")) / 1_000_000


@query(
    "a2_lag_histogram",
    with_views(
        "obs",
        ", l AS (SELECT source_id, (ingested_us - wire_us) / 1e6 AS lag FROM obs), w AS (SELECT source_id, "
        + ", ".join(f"count(*) FILTER (WHERE lag >= 0 AND lag <= {x}) AS \"{x}\"" for x in labels.LAG_BUCKETS_S)
        + ", count(*) FILTER (WHERE lag >= 0) AS inf FROM l GROUP BY source_id) SELECT source_id, le, n FROM w UNPIVOT (n FOR le IN ("
        + ", ".join(f'"{x}"' for x in labels.LAG_BUCKETS_S)
        + ", inf))",
    ),
)
def a2(spark, d):
    return op.lag_histogram(b.observations(spark, d), ["source_id"], _lag())


@query(
    "a2_lag_quantiles",
    with_views(
        "obs",
        """, l AS (SELECT source_id, CAST(round((ingested_us - wire_us) / 1e3) AS BIGINT) AS ms FROM obs WHERE wire_us IS NOT NULL)
     SELECT source_id, CAST(count(*) FILTER (WHERE ms >= 0) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE ms < 0) AS BIGINT) AS n_negative,
      round(quantile_cont(ms, 0.5) FILTER (WHERE ms >= 0) / 1000, 6) AS p50_s, round(quantile_cont(ms, 0.95) FILTER (WHERE ms >= 0) / 1000, 6) AS p95_s FROM l GROUP BY source_id""",
    ),
)
def a2_quantiles(spark, d):
    q = op.lag_quantiles(b.observations(spark, d), ["source_id"], _lag())
    return q.select("source_id", "n", "n_negative", F.round("p50_s", 6).alias("p50_s"), F.round("p95_s", 6).alias("p95_s"))


@query(
    "a3_source_health",
    with_views(
        "obs",
        f""", r AS (SELECT source_id, observed_us // {24 * HOUR} * {24 * HOUR} AS window_us, observed_us AS seen, event_type = 'error' AS failed, metric_value AS latency FROM obs),
     g AS (SELECT source_id, window_us, count(*) AS runs, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures, max(seen) FILTER (WHERE NOT failed) AS last_success_us,
       max(seen) FILTER (WHERE failed) AS last_failure_us, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95 FROM r GROUP BY ALL)
     SELECT g.source_id, g.window_us, g.runs, g.failures, g.last_success_us, g.last_failure_us, round(g.p50, 4) AS p50, round(g.p95, 4) AS p95,
       round(g.failures / g.runs, 6) AS error_rate, round(g.runs / 24, 6) AS per_hour, 24e0 AS expected_runs,
       (SELECT count(*) FROM r WHERE r.source_id = g.source_id AND r.window_us = g.window_us AND failed AND (g.last_success_us IS NULL OR r.seen > g.last_success_us)) AS trailing_failures FROM g""",
    ),
)
def a3(spark, d):
    h = op.source_health(
        b.observations(spark, d), 24, "observed_us", F.col("event_type") == "error", F.col("metric_value"), 1.0
    )
    return h.select(
        "source_id", "window_us", "runs", "failures", "last_success_us", "last_failure_us", "trailing_failures",
        F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("error_rate", 6).alias("error_rate"),
        F.round("per_hour", 6).alias("per_hour"), F.col("expected_runs").cast("double").alias("expected_runs"),
    )


def duck_cell(res: int, lon: str = "lon", lat: str = "lat") -> str:
    size = geo.CELL_DEGREES[res]
    cols = int(360 / size)
    return (
        f"(CAST(floor(({lat} + 90) / {size}) AS BIGINT) * {cols} + CAST(floor(({lon} + 180) / {size}) AS BIGINT) % {cols})"
    )


@query(
    "a5_density",
    with_views(
        "obs",
        " UNION ALL ".join(
            f"SELECT CAST({r} AS INTEGER) AS res, {duck_cell(r)} AS cell, count(*) AS n FROM obs WHERE lon IS NOT NULL GROUP BY ALL"
            for r in (5, 7, 9)
        ),
    ),
)
def a5(spark, d):
    return op.density(b.observations(spark, d).filter("lon IS NOT NULL"))


GAPS_SQL = f""", p AS (SELECT *, lead(observed_us) OVER w AS nt, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM obs WHERE lon IS NOT NULL
    WINDOW w AS (PARTITION BY ref_id ORDER BY observed_us, obs_id)),
   gaps AS (SELECT ref_id, source_id, observed_us AS gap_start_us, nt AS gap_end_us, (coalesce(nt, {NOW}) - observed_us) / 1e6 AS duration_s,
     {haversine('lon', 'lat', 'nlon', 'nlat')} AS distance_m, 'signal_loss' AS reason FROM p WHERE (coalesce(nt, {NOW}) - observed_us) / 1e6 > 43200)"""


@query(
    "a11_gap_stats",
    with_views(
        "obs",
        GAPS_SQL
        + """ SELECT source_id, reason, count(*) AS gaps, CAST(count(*) FILTER (WHERE gap_end_us IS NULL) AS BIGINT) AS open_gaps,
     round(sum(duration_s), 3) AS total_s, round(max(duration_s), 6) AS longest_s FROM gaps GROUP BY ALL""",
    ),
)
def a11(spark, d):
    gaps = track.track_gaps(b.observations(spark, d), 43200.0, NOW)
    s = op.gap_stats(gaps)
    return s.select("source_id", "reason", "gaps", "open_gaps", F.round("total_s", 3).alias("total_s"), F.round("longest_s", 6).alias("longest_s"))


def _messages(spark, d):
    return classify_lines(b.raw_lines(spark, d)).filter("line_kind = 'message'")


@query(
    "a12_learn_shape",
    """WITH e AS (SELECT (epoch_us(ts) // 86400000000) - 19723 AS day_no, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
 l AS (SELECT k FROM e WHERE day_no < 15 AND k > 2), t AS (SELECT count(*) AS samples FROM l),
 p AS (SELECT unnest(['id','kind','pos','pos.x','pos.tags','pos.tags[]']) AS path, unnest(['int','string','object','int','array','string']) AS type, samples AS n FROM t
  UNION ALL SELECT 'k', 'int', count(*) FROM l WHERE k <> 7
  UNION ALL SELECT 'k[]', 'int', count(*) FROM l WHERE k = 6 UNION ALL SELECT 'extra', 'bool', count(*) FROM l WHERE k = 8)
 SELECT path, type, n, round(n / samples, 6) AS ratio, n >= samples * 0.95 AS required FROM p, t WHERE n > 0""",
)
def a12(spark, d):
    s = op.learn_shape(_messages(spark, d).filter("day_no < 15"))
    return s.select("path", "type", "n", F.round("ratio", 6).alias("ratio"), "required")


# Lines with k in 3..8 deviate; the shape is learned from the first fortnight
# without the two newest spellings, then held against everything after it.
@query(
    "u2_detect_drift",
    """WITH e AS (SELECT (epoch_us(ts) // 86400000000) - 19723 AS day_no, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
 f AS (SELECT DISTINCT k FROM e WHERE day_no >= 15)
 SELECT 'type_change' AS kind, 'k' AS path, 'int' AS was, 'string' AS now FROM f WHERE k = 3
 UNION ALL SELECT 'cardinality_change', 'k', 'int', 'array' FROM f WHERE k = 6
 UNION ALL SELECT 'new_field', 'k[]', NULL, 'int' FROM f WHERE k = 6
 UNION ALL SELECT 'new_field', 'extra', NULL, 'bool' FROM f WHERE k = 8
 UNION ALL SELECT 'missing_field', 'k', 'int', NULL FROM f WHERE k = 7""",
)
def u2(spark, d):
    lines = _messages(spark, d)
    old_format = lines.filter("day_no < 15 AND (k < 3 OR k > 8)")
    return op.detect_drift(lines.filter("day_no >= 15"), op.learn_shape(old_format))


@query(
    "a13_downsample",
    with_views(
        "obs",
        f"""SELECT ref_id, {duck_cell(5)} AS cell_r5, observed_us // {HOUR} * {HOUR} AS hour_us, count(*) AS n, round(avg(sog_kn), 6) AS mean_sog_kn,
      min(observed_us) AS first_us, max(observed_us) AS last_us FROM obs WHERE observed_us < {J + 20 * DAY} AND lon IS NOT NULL GROUP BY ALL""",
    ),
)
def a13(spark, d):
    return op.downsample(b.observations(spark, d), J + 20 * DAY).withColumn("mean_sog_kn", F.round("mean_sog_kn", 6))


@query(
    "a14_gold_rollup",
    with_views(
        "evt",
        """, e AS (SELECT CAST(year(make_timestamp(occurred_us)) AS INTEGER) AS year, domain, type, severity FROM evt)
     SELECT year, domain, type, CAST(grouping(year, domain, type) AS BIGINT) AS level, count(*) AS n, round(sum(severity), 4) AS severity_sum,
      round(max(severity), 6) AS severity_max FROM e GROUP BY ROLLUP (year, domain, type)""",
    ),
)
def a14(spark, d):
    e = b.events(spark, d).withColumn("year", F.year(F.timestamp_micros("occurred_us")))
    return op.gold_rollup(
        e,
        ["year", "domain", "type"],
        {"n": F.count("*"), "severity_sum": F.round(F.sum("severity"), 4), "severity_max": F.round(F.max("severity"), 6)},
    )


@query(
    "a17_distinct_entities",
    with_views(
        "obs",
        """SELECT source_id, observed_us // 86400000000 AS day, count(DISTINCT ref_id) AS entities, true AS sketch_is_close FROM obs GROUP BY ALL""",
    ),
)
def a17(spark, d):
    obs = b.observations(spark, d).withColumn("day", F.floor(F.col("observed_us") / DAY))
    exact = obs.groupBy("source_id", "day").agg(F.count_distinct("ref_id").alias("entities"))
    sketch = op.distinct_entities(obs, ["source_id", "day"], "ref_id")
    close = F.abs(F.col("approx_entities") - F.col("entities")) <= 1 + 0.1 * F.col("entities")
    return exact.join(sketch, ["source_id", "day"]).select("source_id", "day", "entities", close.alias("sketch_is_close"))


@query(
    "u5_split_boxes",
    with_views(
        "obs",
        """, box AS (SELECT ref_id, max(lon) AS west, min(lat) AS south, min(lon) AS east, max(lat) AS north FROM obs WHERE lon IS NOT NULL GROUP BY ref_id)
     SELECT ref_id, CAST(1 AS INTEGER) AS part, west, south, CASE WHEN west > east THEN 180e0 ELSE east END AS east, north FROM box
     UNION ALL SELECT ref_id, 2, -180e0, south, east, north FROM box WHERE west > east""",
    ),
)
def u5(spark, d):
    # The complement of each entity's range of longitudes: it always wraps.
    boxes = (
        b.observations(spark, d)
        .filter("lon IS NOT NULL")
        .groupBy("ref_id")
        .agg(F.max("lon").alias("west"), F.min("lat").alias("south"), F.min("lon").alias("east"), F.max("lat").alias("north"))
    )
    return split_boxes(boxes)


def split_boxes(boxes):
    """One row per simple box; a box over the antimeridian becomes two."""
    wraps = F.col("west") > F.col("east")

    def part(no, west, east):
        return F.struct(F.lit(no).alias("part"), west.alias("west"), F.col("south").alias("south"), east.alias("east"), F.col("north").alias("north"))

    parts = F.when(
        wraps, F.array(part(1, F.col("west"), F.lit(180.0)), part(2, F.lit(-180.0), F.col("east")))
    ).otherwise(F.array(part(1, F.col("west"), F.col("east"))))
    rest = [c for c in boxes.columns if c not in ("west", "south", "east", "north")]
    return boxes.select(*rest, F.inline(parts))
