"""Alert hygiene: throttling, roll-up, precision, queue, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.series import Series, day_of
from tidewatch.model import labels


def throttle_alerts(hits: DataFrame, quiet_us: int) -> DataFrame:
    """One alert per dedupe key and open period.

    A repeat while the alert is open raises its count and moves its last-seen
    time. An alert closes when nothing comes for ``quiet_us``, or when a hit
    carries ``closes`` = true; the next hit then opens a new one.
    """
    series = Series(["dedupe_key"], ["seen_us", "alert_id"], day_of("seen_us"))
    seen = series.with_previous(hits, ["seen_us", "closes"], "prev")
    opens = (
        F.col("prev").isNull()
        | (F.col("seen_us") - F.col("prev.seen_us") > quiet_us)
        | F.coalesce(F.col("prev.closes"), F.lit(False))
    )
    named = series.with_last_known(seen.withColumn("opens", opens), F.when(F.col("opens"), F.col("alert_id")), "open_alert_id")
    return named.groupBy("dedupe_key", "open_alert_id").agg(
        F.count("*").alias("occurrence_count"),
        F.min("seen_us").alias("first_seen_us"),
        F.max("seen_us").alias("last_seen_us"),
        F.max("closes").alias("closed"),
    )


def aggregate_alerts(alerts: DataFrame, window_us: int, flood: int) -> DataFrame:
    """Parent alert per rule, area and window with at least ``flood`` alerts."""
    rank = F.array_position(F.array(*[F.lit(s) for s in labels.ALERT_SEVERITY]), F.col("severity"))
    return (
        alerts.groupBy("rule_id", "aoi_id", (F.floor(F.col("seen_us") / window_us) * window_us).alias("window_us"))
        .agg(
            F.count("*").alias("children"),
            F.min("alert_id").alias("parent_alert_id"),
            F.max_by("severity", rank).alias("severity"),
            F.count_distinct("dedupe_key").alias("subjects"),
        )
        .filter(F.col("children") >= flood)
    )


def detector_precision(alerts: DataFrame, min_judged: int, min_precision: float) -> DataFrame:
    """Share of true positives per rule, and whether its severity may be raised."""
    judged = alerts.groupBy("rule_id").agg(
        F.count("*").alias("alerts"),
        F.count_if(F.col("disposition") == "true_positive").alias("true_positives"),
        F.count_if(F.col("disposition") == "false_positive").alias("false_positives"),
    )
    n = F.col("true_positives") + F.col("false_positives")
    precision = F.when(n > 0, F.col("true_positives") / n)
    return judged.withColumn("precision", precision).withColumn(
        "may_promote", (n >= min_judged) & F.coalesce(F.col("precision") >= min_precision, F.lit(False))
    )


def severity_rank(severity):
    return F.array_position(F.array(*[F.lit(s) for s in labels.ALERT_SEVERITY]), severity)


def alert_queue(alerts: DataFrame) -> DataFrame:
    """Work queue: status, then severity from the top, then latest first."""
    status = F.array_position(F.array(*[F.lit(s) for s in labels.ALERT_STATUS]), F.col("status"))
    return (
        alerts.withColumn("status_rank", status)
        .withColumn("severity_rank", severity_rank(F.col("severity")))
        .orderBy("status_rank", F.desc("severity_rank"), F.desc("seen_us"), "alert_id")
    )


def notification_digest(notifications: DataFrame, window_us: int) -> DataFrame:
    """Undelivered notifications per channel and window, with attempts."""
    window = (F.floor(F.col("queued_us") / window_us) * window_us).alias("window_us")
    return notifications.groupBy("channel", window).agg(
        F.count_if(F.col("sent_us").isNull()).alias("pending"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.sum("attempts").alias("attempts"),
        F.count_distinct("alert_id").alias("alerts"),
        F.min(F.when(F.col("sent_us").isNull(), F.col("queued_us"))).alias("oldest_pending_us"),
    )
