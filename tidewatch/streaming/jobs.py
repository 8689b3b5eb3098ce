"""Live forms of the batch operators, on Structured Streaming.

Ordered and stateful steps run per micro-batch with the same DataFrame operator
the batch form uses. Their state is a table per batch id: batch *n* reads the
state of *n - 1* and writes its own, so a batch that is repeated after a failure
overwrites what it had written and nothing is counted twice. Because the state
is joined instead of held per key in one task, a busy key stays spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.functions.series import latest_per
from tidewatch.operators import dedupe, metrics
from tidewatch.session import cut_lineage
from tidewatch.sources.envelopes import classify_lines
from tidewatch.sources.versions import VersionStore

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame | None]]


def open_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File source. ``files_per_batch`` is the load limit: files that do not fit
    wait for the next batch, none is dropped."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def stateful_batches(stream: DataFrame, step: Step, folder: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run ``step(batch, state) -> (output, new state)`` for every micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/state/batch={batch_id - 1}"
        state = spark.read.parquet(before) if batch_id > 0 and _exists(spark, before) else None
        output, new_state = step(batch, state)
        output.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        if new_state is not None:
            new_state.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    return run_available(stream, handle, f"{folder}/checkpoint")


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/out").drop("batch")


def last_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last finished batch."""
    states = spark.read.parquet(f"{folder}/state")
    newest = states.agg(F.max("batch").alias("batch"))
    return states.join(newest, "batch", "left_semi").drop("batch")


def ingest(stream: DataFrame, folder: str, normalize: Callable[[DataFrame], DataFrame], day: str | None = None) -> StreamingQuery:
    """Land raw, route bad lines, normalise, publish once.

    One bad record goes to the dead letters and never sinks its batch. ``day`` names
    a column of the normalised rows that a redelivery repeats; silver is then laid
    out by it, and a batch reads the stored keys of its own days only.
    """
    place = [] if day is None else [day]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        raw_path = f"{folder}/bronze/batch={batch_id}"
        batch.write.mode("overwrite").option("compression", "gzip").parquet(raw_path)
        kinds = classify_lines(spark.read.schema(batch.schema).parquet(raw_path))
        bad = kinds.filter(F.col("line_kind") != "message")
        bad.write.mode("overwrite").parquet(f"{folder}/dead/batch={batch_id}")
        good = normalize(kinds.filter(F.col("line_kind") == "message")).dropDuplicates(["dedupe_key"])
        if day is not None:
            good = cut_lineage(good)
        if batch_id > 0 and _exists(spark, f"{folder}/silver/batch={batch_id - 1}"):
            stored = spark.read.schema(StructType([*good.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/silver").filter(F.col("batch") < batch_id)
            if day is not None:
                # The batch's days prune the partitions that are read.
                days = [r[0] for r in good.select(day).distinct().collect()]
                stored = stored.filter(F.col(day).isin([v for v in days if v is not None]) | F.col(day).isNull())
            good = good.join(stored.select("dedupe_key"), "dedupe_key", "left_anti")
        if day is not None:
            # A day is written by as few tasks as its rows need: else each task has a file of every day.
            good = good.repartitionByRange(day, "dedupe_key")
        good.write.mode("overwrite").partitionBy(*place).parquet(f"{folder}/silver/batch={batch_id}")

    return run_available(stream, handle, f"{folder}/checkpoint")


def dedupe_window(stream: DataFrame, at: str, delay: str = "2 minutes", key: str = "dedupe_key") -> DataFrame:
    """Drop repeats of a key that come within the delay; the durable key does the rest."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def late_step(at: str, delay_us: int) -> Step:
    """Flag rows behind the watermark; they are kept, beside the others."""

    def step(batch: DataFrame, state: DataFrame | None):
        if state is None:
            flagged = batch.withColumn("is_late", F.lit(False))
            seen = batch.agg(F.max(at).alias("high_us"))
        else:
            flagged = batch.withColumn("is_late", F.col(at) < state.select("high_us").scalar() - delay_us)
            seen = batch.agg(F.max(at).alias("high_us")).unionByName(state).agg(F.max("high_us").alias("high_us"))
        return flagged, seen

    return step


def conflate_step(key: str, order: list[str]) -> Step:
    """Under overload keep the newest row per key; ``dropped`` counts the rest."""

    def step(batch: DataFrame, state: DataFrame | None):
        counted = batch.groupBy(key).agg(F.count("*").alias("__n"))
        kept = latest_per(batch, [key], order).join(counted, key)
        return kept.withColumn("dropped", F.col("__n") - 1).drop("__n"), None

    return step


def drift_step(shape: DataFrame, value: str = "value") -> Step:
    """Drift findings against a persisted shape, each reported once."""

    def step(batch: DataFrame, state: DataFrame | None):
        findings = metrics.detect_drift(batch, shape, value)
        if state is not None:
            fresh = findings.join(state.select("kind", "path"), ["kind", "path"], "left_anti").select(*findings.columns)
            return fresh, state.unionByName(fresh)
        return findings, findings

    return step


def version_feed(stream: DataFrame, store: VersionStore, checkpoint: str) -> StreamingQuery:
    """Change feed to a stored version table; a batch touches the buckets of its keys.

    A repeated batch leaves the same table.
    """
    return run_available(stream, lambda batch, batch_id: store.apply(batch), checkpoint)


def windowed_counts(stream: DataFrame, at: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows and failures per source and window. In append mode a window is given out
    once, when the clock has passed its end, and its state goes."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        stream.withWatermark(at, delay)
        .groupBy("source_id", window.alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select("source_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "errors")
    )


def session_tracks(stream: DataFrame, at: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Tracks as session windows: a track ends after ``gap`` without a point.

    Its id is made of the entity and the start, as in the batch form.
    """
    return (
        stream.withWatermark(at, delay)
        .groupBy("ref_id", F.session_window(at, gap).alias("w"))
        .agg(F.count("*").alias("point_count"), F.max(at).alias("last_at"))
        .select(
            "ref_id",
            F.concat_ws("#", "ref_id", F.unix_micros("w.start").cast("string")).alias("track_id"),
            F.unix_micros("w.start").alias("time_start_us"),
            F.unix_micros("last_at").alias("last_point_us"),
            "point_count",
        )
    )


def split_late(stream: DataFrame, folder: str, at: str, delay_us: int) -> DataFrame:
    """Part a stream into rows in time and late rows, before it is windowed.

    A row is late if it is older than the newest row of the earlier batches by more than
    the delay. Late rows go to ``folder/split/out`` with ``is_late`` and are never
    counted twice or lost; the returned stream has the others.
    """
    spark = stream.sparkSession
    stateful_batches(stream, late_step(at, delay_us), f"{folder}/split")
    schema = stream.schema.add("is_late", "boolean")
    return spark.readStream.schema(schema).parquet(f"{folder}/split/out/batch=*").filter(~F.col("is_late")).drop("is_late")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The side table of ``split_late``."""
    return results(spark, f"{folder}/split").filter("is_late").drop("is_late")


def write_append(stream: DataFrame, folder: str) -> StreamingQuery:
    """Append finished rows; a repeated batch overwrites its own part."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return run_available(stream, handle, f"{folder}/checkpoint")


append_once = dedupe.append_once
