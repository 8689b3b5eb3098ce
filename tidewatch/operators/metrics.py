"""Counters, lag, source health, density, roll-ups and record shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions.plan import computed_once
from tidewatch.functions.series import Series
from tidewatch.model import labels
from tidewatch.session import cut_lineage

HOUR_US = 3_600_000_000


def pipeline_counts(df: DataFrame, dims: Sequence[str], stages: Mapping[str, Column]) -> DataFrame:
    """Rows per stage. All stages are counted in one pass and then unpivoted,
    so a stage in which nothing happened is a row with 0, not a gap."""
    wide = df.groupBy(*dims).agg(*[F.count_if(cond).alias(name) for name, cond in stages.items()])
    return wide.unpivot([F.col(c) for c in dims], [F.col(f"`{s}`") for s in stages], "stage", "n")


def flag_counts(df: DataFrame, dims: Sequence[str], flags: str, known: Sequence[str]) -> DataFrame:
    """Rows per quality flag; known flags exist with 0."""
    return pipeline_counts(df, dims, {f: F.array_contains(flags, f) for f in known}).withColumnRenamed("stage", "flag")


def lag_histogram(df: DataFrame, dims: Sequence[str], lag_s: Column) -> DataFrame:
    """Cumulative counts per upper bound; negative lag is left out."""
    ok = lag_s >= 0
    bounds = {str(b): ok & (lag_s <= b) for b in labels.LAG_BUCKETS_S}
    bounds["inf"] = ok
    return pipeline_counts(df, dims, bounds).withColumnRenamed("stage", "le")


def counted_quantiles(counted: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], width: float) -> DataFrame:
    """Exact interpolated quantiles per key of a table ``keys, value, n``.

    No buffer holds a key's values: running counts over value bands of ``width``
    say which value a rank falls on, and the two around it are aggregates.
    """
    present = counted.filter(F.col(value).isNotNull())
    series = Series(list(keys), [value], F.floor(F.col(value) / width).cast("long"))
    summed = series.with_running_sum(present, F.col("n"), "__upto")
    totals = present.groupBy(*keys).agg(F.sum("n").alias("__total"))
    placed = summed.join(totals, list(keys))
    out = []
    for name, share in shares.items():
        rank = (F.col("__total") - 1) * share
        low = F.min(F.when(F.col("__upto") > F.floor(rank), F.col(value)))
        high = F.min(F.when(F.col("__upto") > F.ceil(rank), F.col(value)))
        between = F.first(rank - F.floor(rank))
        out.append((low + (high - low) * between).alias(name))
    return placed.groupBy(*keys).agg(*out)


def lag_quantiles(df: DataFrame, dims: Sequence[str], lag_s: Column) -> DataFrame:
    """Exact p50 and p95 over whole milliseconds, negatives counted apart.

    Equal lags are counted first; quantiles come from running counts.
    """
    ms = F.round(lag_s * 1000).cast("long")
    counted = df.filter(lag_s.isNotNull()).groupBy(*dims, ms.alias("ms")).agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    sums = counted.groupBy(*dims).agg(
        F.sum(F.when(F.col("ms") >= 0, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("ms") < 0, F.col("n")).otherwise(0)).alias("n_negative"),
    )
    quantiles = counted_quantiles(counted.filter("ms >= 0"), dims, "ms", {"p50": 0.5, "p95": 0.95}, 60_000)
    return sums.join(quantiles, list(dims), "left").select(
        *dims, "n", "n_negative", (F.col("p50") / 1000).alias("p50_s"), (F.col("p95") / 1000).alias("p95_s")
    )


def source_health(
    runs: DataFrame, window_hours: int, at: str, failed: Column, latency: Column, expected_per_hour: float
) -> DataFrame:
    """Error rate, latency, throughput, last success and failure, trailing failures."""
    width = window_hours * HOUR_US
    base = runs.select(
        "source_id",
        (F.floor(F.col(at) / width) * width).alias("window_us"),
        F.col(at).alias("at"),
        failed.alias("failed"),
        latency.alias("latency"),
    )
    keys = ["source_id", "window_us"]
    summary = base.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if("failed").alias("failures"),
        F.avg("latency").alias("mean_latency"),
        F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_success_us"),
        F.max(F.when(F.col("failed"), F.col("at"))).alias("last_failure_us"),
    )
    trailing = (
        base.filter("failed")
        .join(summary.select(*keys, "last_success_us"), keys)
        .filter(F.col("last_success_us").isNull() | (F.col("at") > F.col("last_success_us")))
        .groupBy(*keys)
        .agg(F.count("*").alias("trailing_failures"))
    )
    latency_counts = base.groupBy(*keys, "latency").agg(F.count("*").alias("n"))
    quantiles = counted_quantiles(latency_counts, keys, "latency", {"p50": 0.5, "p95": 0.95}, 1.0)
    return (
        summary.join(quantiles, keys, "left")
        .join(trailing, keys, "left")
        .withColumn("trailing_failures", F.coalesce("trailing_failures", F.lit(0).cast("long")))
        .withColumn("error_rate", F.col("failures") / F.col("runs"))
        .withColumn("per_hour", F.col("runs") / window_hours)
        .withColumn("expected_runs", F.lit(expected_per_hour * window_hours))
    )


def density(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows per cell at three resolutions. The data is counted once, at the
    finest; the coarser levels add up those counts."""
    fine = df.groupBy(*extra, geo.cell(F.col("lon"), F.col("lat"), 9).alias("cell")).agg(F.count("*").alias("n"))
    levels = fine.select(
        *extra,
        F.explode(
            F.array(
                F.struct(F.lit(9).alias("res"), F.col("cell").alias("cell")),
                F.struct(F.lit(7).alias("res"), geo.parent_cell(F.col("cell"), 9, 7).alias("cell")),
                F.struct(F.lit(5).alias("res"), geo.parent_cell(F.col("cell"), 9, 5).alias("cell")),
            )
        ).alias("level"),
        "n",
    )
    return levels.groupBy(*extra, "level.res", "level.cell").agg(F.sum("n").alias("n"))


def gap_stats(gaps: DataFrame, dims: Sequence[str] = ("source_id", "reason")) -> DataFrame:
    return gaps.groupBy(*dims).agg(
        F.count("*").alias("gaps"),
        F.count_if(F.col("gap_end_us").isNull()).alias("open_gaps"),
        F.sum("duration_s").alias("total_s"),
        F.max("duration_s").alias("longest_s"),
    )


def downsample(obs: DataFrame, cutoff_us: int) -> DataFrame:
    """Positions before the cutoff as one row per entity, cell and hour."""
    old = obs.filter((F.col("observed_us") < cutoff_us) & F.col("lon").isNotNull())
    return old.groupBy(
        "ref_id",
        geo.cell(F.col("lon"), F.col("lat"), 5).alias("cell_r5"),
        (F.floor(F.col("observed_us") / HOUR_US) * HOUR_US).alias("hour_us"),
    ).agg(
        F.count("*").alias("n"),
        F.avg("sog_kn").alias("mean_sog_kn"),
        F.min("observed_us").alias("first_us"),
        F.max("observed_us").alias("last_us"),
    )


def gold_rollup(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Roll-up with subtotals; ``level`` says which dimensions are summed over."""
    return df.rollup(*dims).agg(
        F.grouping_id().cast("long").alias("level"), *[m.alias(n) for n, m in measures.items()]
    )


def distinct_entities(df: DataFrame, dims: Sequence[str], entity: str, rsd: float = 0.02) -> DataFrame:
    """Distinct entities, sketched: one small sketch per group and task."""
    return df.groupBy(*dims).agg(F.approx_count_distinct(entity, rsd).alias("approx_entities"))


# --- shapes of JSON records ---------------------------------------------------

MAX_DEPTH = 6
REQUIRED_RATIO = 0.95


def _type_name(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .when(kind == "STRING", "string")
        .otherwise(F.lower(kind))
    )


def record_shapes(df: DataFrame, value: str) -> DataFrame:
    """``(shape_id, n, path, type)`` for the distinct shapes among JSON objects.

    Records are first counted per shape with one representative each, which is
    a map-side aggregate; only the few representatives are taken apart.
    """
    parsed = computed_once(df, "__json", F.try_parse_json(F.col(value)))
    objects = computed_once(parsed, "__shape", F.schema_of_variant("__json")).filter(
        F.col("__shape").startswith("OBJECT")
    )
    shape = F.regexp_replace("__shape", r"DECIMAL\(\d+,\d+\)", "DOUBLE")
    kinds = objects.groupBy(F.md5(shape).alias("shape_id")).agg(
        F.count("*").alias("n"), F.min(F.col(value)).alias("sample")
    )
    level = kinds.select("shape_id", "n", F.lit("").alias("path"), F.parse_json("sample").alias("v"))
    spark, out = df.sparkSession, None
    for _ in range(MAX_DEPTH):
        level = spark.sql(
            """
            SELECT shape_id, n,
                   CASE WHEN key IS NULL THEN concat(path, '[]')
                        WHEN path = '' THEN key ELSE concat(path, '.', key) END AS path,
                   value AS v
            FROM {level}, LATERAL variant_explode(v)
            WHERE key IS NOT NULL OR pos = 0
            """,
            level=level,
        )
        part = level.select("shape_id", "n", "path", _type_name(F.col("v")).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def learn_shape(df: DataFrame, value: str = "value") -> DataFrame:
    """Path, most frequent type, how often it occurs, and whether it is required."""
    shapes = record_shapes(df, value)
    samples = shapes.filter(~F.col("path").contains(".")).groupBy("shape_id").agg(F.max("n").alias("n"))
    total = samples.agg(F.sum("n").alias("samples"))
    by_type = shapes.groupBy("path", "type").agg(F.sum("n").alias("n"))
    typed = F.when(F.col("type") != "null", F.struct(F.col("n"), F.col("type")))
    per_path = by_type.groupBy("path").agg(
        F.sum("n").alias("n"), F.max(typed)["type"].alias("type")
    )
    return (
        per_path.withColumn("samples", total.scalar())
        .select(
            "path",
            F.coalesce("type", F.lit("null")).alias("type"),
            "n",
            (F.col("n") / F.col("samples")).alias("ratio"),
            (F.col("n") >= F.col("samples") * REQUIRED_RATIO).alias("required"),
        )
    )


def detect_drift(df: DataFrame, shape: DataFrame, value: str = "value") -> DataFrame:
    """Deviations from a learned shape, each once: ``kind, path, was, now``.

    A null never counts as a type change, and int against float does not
    either. A change from or to an array is a change of cardinality.
    """
    shapes = record_shapes(df, value)
    seen = shapes.select("path", F.col("type").alias("now")).distinct()
    known = shape.select("path", F.col("type").alias("was"))
    both = seen.join(known, "path", "left")
    numeric = F.col("was").isin("int", "float") & F.col("now").isin("int", "float")
    same = (F.col("was") == F.col("now")) | (F.col("was") == "null") | (F.col("now") == "null") | numeric
    array = (F.col("was") == "array") | (F.col("now") == "array")
    changed = both.filter(F.col("was").isNull() | ~same).select(
        F.when(F.col("was").isNull(), "new_field").when(array, "cardinality_change").otherwise("type_change").alias("kind"),
        "path",
        "was",
        "now",
    )
    # A reported deviation is reported once per kind and path.
    changed = changed.groupBy("kind", "path").agg(F.min("was").alias("was"), F.min("now").alias("now"))
    n_shapes = shapes.agg(F.count_distinct("shape_id").alias("all_shapes"))
    present = shapes.groupBy("path").agg(F.count_distinct("shape_id").alias("in_shapes"))
    missing = (
        shape.filter("required")
        .select("path", F.col("type").alias("was"))
        .join(present, "path", "left")
        .withColumn("all_shapes", n_shapes.scalar())
        .filter(F.coalesce("in_shapes", F.lit(0)) < F.col("all_shapes"))
        .select(F.lit("missing_field").alias("kind"), "path", "was", F.lit(None).cast("string").alias("now"))
    )
    return changed.unionByName(missing)
