"""Raw archive, replay, partitioned observation tables and bulk load."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

HOUR_PARTS = ["source", "yyyy", "mm", "dd", "hh"]
STRAY = "stray"
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
EPOCH = datetime(1970, 1, 1)


def _utc_day(us: Column) -> Column:
    """The UTC day of epoch microseconds, by arithmetic."""
    return F.date_from_unix_date(F.floor(us / DAY_US).cast("int"))


def land_bronze(
    df: DataFrame,
    path: str,
    source_col: str = "source_id",
    fetched_us: str = "fetched_us",
    payload: str = "payload",
    max_records: int = 500_000,
    mode: str = "append",
) -> None:
    """Archive payloads unchanged as gzip lines under ``source/yyyy/mm/dd/hh``.

    An hour normally becomes one bundle. Hours above ``max_records`` are cut
    into as many bundles as they need, so that a busy source is written by many
    tasks, and a bundle never mixes two hours. A payload that is fetched again and
    again is spread by its times. The split is part of the contract: an hour has
    ``ceil(records / max_records)`` bundles or more. Hours are UTC, whatever the
    session's zone is.
    """
    day, hour = _utc_day(F.col(fetched_us)), F.pmod(F.floor(F.col(fetched_us) / HOUR_US), F.lit(24))
    parts = df.select(
        F.col(source_col).alias("source"),
        F.date_format(day, "yyyy").alias("yyyy"),
        F.date_format(day, "MM").alias("mm"),
        F.date_format(day, "dd").alias("dd"),
        F.lpad(hour.cast("string"), 2, "0").alias("hh"),
        F.col(payload).alias("value"),
        F.xxhash64(payload, fetched_us).alias("bundle"),
    )
    bundles = parts.groupBy(*HOUR_PARTS).agg(F.ceil(F.count("*") / max_records).alias("bundles"))
    (
        parts.join(bundles, HOUR_PARTS)
        .withColumn("bundle", F.pmod("bundle", "bundles"))
        .repartition(*HOUR_PARTS, "bundle")
        .drop("bundle", "bundles")
        .write.mode(mode)
        .partitionBy(*HOUR_PARTS)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max_records)
        .text(path)
    )


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Archived lines with their source, hour start and where they lie."""
    day = F.unix_date(F.make_date(F.col("yyyy").cast("int"), F.col("mm").cast("int"), F.col("dd").cast("int")))
    return (
        spark.read.schema("value string, source string, yyyy string, mm string, dd string, hh string")
        .text(path)
        .withColumn("hour_us", day.cast("long") * DAY_US + F.col("hh").cast("long") * HOUR_US)
        .withColumn("raw_ref", F.concat(F.col("_metadata.file_path"), F.lit("#"), F.sha2("value", 256)))
    )


def hour_between(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Hours of ``[start, end)``, said in partition columns so that files are pruned."""
    stamp = F.concat("yyyy", "mm", "dd", "hh")

    def text(us: int):
        return (EPOCH + timedelta(microseconds=us)).strftime("%Y%m%d%H")

    return df.filter((stamp >= text(start_us)) & (stamp <= text(end_us - 1)))


def replay(
    spark: SparkSession,
    path: str,
    start_us: int,
    end_us: int,
    normalize: Callable[[DataFrame], DataFrame],
    existing: DataFrame | None = None,
) -> DataFrame:
    """Silver rows for ``[start, end)`` from the archive.

    Ids come from content, so a second replay produces the same keys; rows that
    ``existing`` already holds are left out.
    """
    rows = normalize(hour_between(read_bronze(spark, path), start_us, end_us))
    rows = rows.dropDuplicates(["dedupe_key"])
    return rows if existing is None else rows.join(existing.select("dedupe_key"), "dedupe_key", "left_anti")


def mark_partition(df: DataFrame, first_day: str, last_day: str, at: str = "observed_us") -> DataFrame:
    """Add ``obs_date``: the UTC day, or ``stray`` outside the expected window."""
    day = _utc_day(F.col(at)).cast("string")
    return df.withColumn("obs_date", F.when(day.between(first_day, last_day), day).otherwise(STRAY))


def write_observations(
    df: DataFrame,
    path: str,
    first_day: str,
    last_day: str,
    at: str = "observed_us",
    cluster_by: Sequence[str] = ("ref_id",),
    max_records: int = 5_000_000,
    mode: str = "append",
) -> None:
    """Day partitions, each clustered by entity and time.

    Range partitioning over (day, entity, time) cuts a busy day, and a busy
    entity inside it, into as many tasks as their rows need; the sort gives
    narrow min/max ranges per row group for entity reads.
    """
    order = ["obs_date", *cluster_by, at]
    (
        mark_partition(df, first_day, last_day, at)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy("obs_date")
        .option("maxRecordsPerFile", max_records)
        .parquet(path)
    )


def stray_report(observations: DataFrame) -> DataFrame:
    """One row per source with strays; no row means no incident."""
    return (
        observations.filter(F.col("obs_date") == STRAY)
        .groupBy("source_id")
        .agg(F.count("*").alias("stray_rows"), F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"))
    )


def _stored_days(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame | None:
    """What is stored for the days of a load and for strays; None before the first load."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    day = F.col("obs_date").cast("string")
    return table.filter(day.between(first_day, last_day) | (day == STRAY))


def bulk_load(
    df: DataFrame,
    path: str,
    first_day: str,
    last_day: str,
    rules: dict,
    key: Sequence[str],
    budget_s: float,
) -> DataFrame:
    """Append a large set with row and key rules active; report the run.

    A key that is stored already, or comes twice, is a duplicate and not loaded
    again. Returns one row: input, rejected by rule, duplicate keys, loaded by this
    run, seconds, rows per second and whether the budget held.
    """
    spark = df.sparkSession
    started = time.monotonic()
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(True))
    judged = df.withColumn("__ok", ok)
    totals = judged.agg(F.count("*").alias("input"), F.count_if(~F.col("__ok")).alias("rejected")).first()
    good = judged.filter("__ok").drop("__ok").dropDuplicates(list(key))
    stored = _stored_days(spark, path, first_day, last_day)
    if stored is not None:
        # Written once: the rows to append must not change while they are appended.
        good = cut_lineage(good.join(stored.select(*key), list(key), "left_anti"))
        loaded = good.count()
    write_observations(good, path, first_day, last_day)
    if stored is None:
        loaded = spark.read.parquet(path).count()
    seconds = time.monotonic() - started
    return spark.createDataFrame(
        [
            (
                totals["input"],
                totals["rejected"],
                totals["input"] - totals["rejected"] - loaded,
                loaded,
                seconds,
                loaded / seconds if seconds else 0.0,
                seconds <= budget_s,
            )
        ],
        "input_rows long, rejected_rows long, duplicate_rows long, loaded_rows long, seconds double, "
        "rows_per_s double, within_budget boolean",
    )


def reconcile(raw: DataFrame, silver: DataFrame, key: str) -> DataFrame:
    """Raw against delivered: per key how often on each side, and the verdict.

    Both sides are counted map-side first, so a key that was delivered very
    often is one row by the time it is compared.
    """
    left = raw.groupBy(key).agg(F.count("*").alias("raw_rows"))
    right = silver.groupBy(key).agg(F.count("*").alias("silver_rows"))
    both = left.join(right, key, "full_outer").fillna(0, ["raw_rows", "silver_rows"])
    return both.withColumn(
        "verdict",
        F.when(F.col("silver_rows") == 0, "missing")
        .when(F.col("raw_rows") == 0, "unexplained")
        .when(F.col("silver_rows") > F.col("raw_rows"), "duplicated")
        .when(F.col("silver_rows") < F.col("raw_rows"), "collapsed")
        .otherwise("delivered"),
    )


def project_search(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Flat search document per event; the point is absent when unknown."""
    refs = entities.groupBy("event_id").agg(F.array_sort(F.collect_set("ref_id")).alias("entity_ids"))
    point = F.when(
        F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("lon", "lat")
    ).alias("geo_point")
    return events.join(refs, "event_id", "left").select(
        "event_id", "type", F.col("occurred_us").alias("occurred_at_us"), "status", "severity", "entity_ids", point
    )
