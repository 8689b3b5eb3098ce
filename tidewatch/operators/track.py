"""Order-dependent operators over the observations of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions.series import Series, day_of, latest_per, top_k_per

HOUR_US = 3_600_000_000


def _by_time(key: str = "ref_id", at: str = "observed_us") -> Series:
    return Series([key], [at, "obs_id"], day_of(at))


def flag_jumps(
    obs: DataFrame,
    key: str = "ref_id",
    at: str = "effective_us",
    arrival: str = "arrival",
    max_kn: float = 100.0,
    block: int = 4096,
) -> DataFrame:
    """Compare each position with the one that *arrived* before it.

    Adds ``seconds_since_previous``, ``jump_m``, ``implied_kn`` and ``jump_flag``. A time
    that runs backwards is flagged and still becomes the next comparison point.
    Rows without a position take no part.
    """
    placed = obs.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    series = Series([key], [arrival, "obs_id"], F.floor(F.col(arrival) / block).cast("long"))
    seen = series.with_previous(placed, [at, "lon", "lat"], "prev")
    judged = judge_jumps(seen, at, f"prev.{at}", "prev.lon", "prev.lat", max_kn).drop("prev")
    rest = obs.filter(F.col("lon").isNull() | F.col("lat").isNull())
    return judged.unionByName(rest, allowMissingColumns=True)


def judge_jumps(rows: DataFrame, at: str, prev_at: str, prev_lon: str, prev_lat: str, max_kn: float = 100.0) -> DataFrame:
    """The columns of ``flag_jumps`` for rows that already know their previous position."""
    dt = (F.col(at) - F.col(prev_at)) / 1_000_000
    metres = geo.haversine_m(F.col(prev_lon), F.col(prev_lat), F.col("lon"), F.col("lat"))
    return (
        rows.withColumn("seconds_since_previous", F.when(dt >= 0, F.round(dt, 3)))
        .withColumn("jump_m", metres)
        .withColumn("implied_kn", F.when(dt > 0, geo.implied_knots(metres, dt)))
        .withColumn(
            "jump_flag",
            F.when(dt < 0, "out_of_order_timestamp").when(F.col("implied_kn") > max_kn, "impossible_speed"),
        )
    )


def latest_position(obs: DataFrame, key: str = "ref_id", at: str = "observed_us") -> DataFrame:
    return latest_per(obs.filter(F.col("lon").isNotNull()), [key], [at, "obs_id"])


def latest_n(obs: DataFrame, n: int, key: str = "ref_id", at: str = "observed_us") -> DataFrame:
    return top_k_per(obs, [key], [F.desc(at), F.desc("obs_id")], n)


def track_gaps(obs: DataFrame, threshold_s: float, now_us: int) -> DataFrame:
    """A row per silence over the threshold; the last one may still be open."""
    placed = obs.filter(F.col("lon").isNotNull())
    seen = _by_time().with_next(placed, ["observed_us", "lon", "lat"], "nxt")
    end = F.coalesce(F.col("nxt.observed_us"), F.lit(now_us))
    duration = (end - F.col("observed_us")) / 1_000_000
    return seen.filter(duration > threshold_s).select(
        "ref_id",
        "source_id",
        F.col("observed_us").alias("gap_start_us"),
        F.col("nxt.observed_us").alias("gap_end_us"),
        duration.alias("duration_s"),
        geo.haversine_m(F.col("lon"), F.col("lat"), F.col("nxt.lon"), F.col("nxt.lat")).alias("distance_m"),
        F.lit("signal_loss").alias("reason"),
        F.lit(True).alias("is_flagged"),
    )


def assign_tracks(obs: DataFrame, gap_s: float) -> DataFrame:
    """Add ``track_id``: a new track starts after each gap.

    The id is made of the entity and the start time, so it does not change when
    later points arrive. ``leg_m`` is the distance from the point before within
    the track; it is null at a start, so sums leave gaps out.
    """
    placed = obs.filter(F.col("lon").isNotNull())
    series = _by_time()
    seen = series.with_previous(placed, ["observed_us", "lon", "lat"], "prev")
    silence = (F.col("observed_us") - F.col("prev.observed_us")) / 1_000_000
    marked = seen.withColumn("starts", F.col("prev").isNull() | (silence > gap_s)).withColumn(
        "leg_m",
        F.when(~F.col("starts"), geo.haversine_m(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat"))),
    )
    named = series.with_last_known(
        marked.drop("prev"), F.when(F.col("starts"), F.col("observed_us")), "track_start_us"
    )
    return named.withColumn(
        "track_id", F.concat_ws("#", "ref_id", F.col("track_start_us").cast("string"))
    ).drop("starts")


def track_summary(tracks: DataFrame, gap_s: float, now_us: int) -> DataFrame:
    """Header row per track. Points stay in the observation table."""
    last = F.max_by(F.struct("lon", "lat"), F.struct("observed_us", "obs_id"))
    header = tracks.groupBy("ref_id", "track_id").agg(
        F.min("observed_us").alias("time_start_us"),
        F.max("observed_us").alias("last_point_us"),
        F.count("*").alias("point_count"),
        F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("distance_m"),
        F.min("lon").alias("west"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
        F.max("lat").alias("north"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        last.alias("last_point"),
    )
    is_open = (F.lit(now_us) - F.col("last_point_us")) / 1_000_000 <= gap_s
    return header.withColumn("is_open", is_open).withColumn(
        "time_end_us", F.when(~F.col("is_open"), F.col("last_point_us"))
    )


def current_revisions(measurements: DataFrame, period_us: int) -> DataFrame:
    """Revisions of a value for the same entity, metric and period.

    Older rows stay; ``revision`` counts up in order of ingestion, the newest is
    current, and each row carries the value it replaced.
    """
    period = (F.floor(F.col("observed_us") / period_us) * period_us).alias("period_us")
    rows = measurements.filter(F.col("metric").isNotNull()).select("*", period)
    series = Series(["ref_id", "metric", "period_us"], ["ingested_us", "obs_id"], F.floor(F.col("ingested_us") / HOUR_US))
    seen = series.add(rows, series.row_number("__no"), series.previous(["metric_value"], "__prev"), series.next(["obs_id"], "__next"))
    return (
        seen.withColumn("revision", F.col("__no") - 1)
        .withColumn("previous_value", F.col("__prev.metric_value"))
        .withColumn("is_current", F.col("__next").isNull())
        .drop("__no", "__prev", "__next")
    )


def rate_change(df: DataFrame, key: str, at: str = "observed_us", baseline_hours: int = 24) -> DataFrame:
    """Rate of each hour against the trailing baseline of the hours before.

    Rows are counted per hour first; the window runs over those counts, at most
    one per key and hour. Hours without rows count as 0 in the baseline.
    """
    from pyspark.sql import Window

    hourly = df.groupBy(key, F.floor(F.col(at) / HOUR_US).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    trailing = Window.partitionBy(key).orderBy("hour").rangeBetween(-baseline_hours, -1)
    total = F.coalesce(F.sum("n").over(trailing), F.lit(0))
    squares = F.coalesce(F.sum(F.col("n") * F.col("n")).over(trailing), F.lit(0))
    mean = total / baseline_hours
    spread = F.sqrt(F.greatest(F.lit(0.0), squares / baseline_hours - mean * mean))
    return hourly.select(
        key,
        "hour",
        "n",
        mean.alias("baseline"),
        spread.alias("spread"),
        F.when(spread > 0, (F.col("n") - mean) / spread).alias("z"),
    )


def duplicate_senders(
    flagged: DataFrame, at: str = "observed_us", min_jumps: int = 2, max_kn: float = 100.0, apart_m: float = 1000.0
) -> DataFrame:
    """Senders that keep jumping between two far-apart places on one day.

    A jump is too fast for the time it took, or joins two places more than
    ``apart_m`` from each other at the same second, where there is no speed.
    """
    at_once = (F.col("seconds_since_previous") == 0) & (F.col("jump_m") > apart_m)
    jumps = flagged.filter((F.col("implied_kn") > max_kn) | at_once)
    return (
        jumps.groupBy("ref_id", day_of(at).alias("day"))
        .agg(F.count("*").alias("jumps"), F.max("implied_kn").alias("max_kn"))
        .filter(F.col("jumps") >= min_jumps)
    )


def entity_lifecycle(obs: DataFrame, now_us: int, idle_s: float) -> DataFrame:
    seen = obs.groupBy("ref_id").agg(
        F.min("observed_us").alias("first_seen_us"), F.max("observed_us").alias("last_seen_us"), F.count("*").alias("n")
    )
    return seen.withColumn("is_active", (F.lit(now_us) - F.col("last_seen_us")) / 1_000_000 <= idle_s)


def dead_reckon(
    last: DataFrame, as_of_us: Column | int, course_spread_deg: float, speed_spread: float, steps: int = 8
) -> DataFrame:
    """Where an entity may be after signal loss: a sector, never a point.

    Adds the inner and outer radius, the sector ring and the containment
    probability. Without speed and course nothing can be said and the ring
    stays null.
    """
    at = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    hours = F.greatest(F.lit(0.0), (at - F.col("observed_us")) / HOUR_US)
    reach = F.col("sog_kn") * geo.NAUTICAL_MILE_M * hours
    lon, lat = F.col("lon"), F.col("lat")
    outer, inner = F.col("outer_m"), F.col("inner_m")
    turn = [-course_spread_deg + i * 2 * course_spread_deg / steps for i in range(steps + 1)]
    arc_out = [geo.destination(lon, lat, F.col("cog_deg") + t, outer) for t in turn]
    arc_in = [geo.destination(lon, lat, F.col("cog_deg") + t, inner) for t in reversed(turn)]
    known = F.col("sog_kn").isNotNull() & F.col("cog_deg").isNotNull()
    return (
        last.withColumn("silent_s", hours * 3600)
        .withColumn("inner_m", F.greatest(F.lit(0.0), reach * (1 - speed_spread)))
        .withColumn("outer_m", reach * (1 + speed_spread))
        .withColumn("area", F.when(known, F.array(*arc_out, *arc_in, arc_out[0])))
        .withColumn("containment_probability", F.when(known, F.lit(0.9)))
    )
