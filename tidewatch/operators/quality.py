"""Rule suites, uniqueness, retention and licences as set-based jobs.

A rule is a predicate that must not be false. As in a SQL CHECK, a predicate
that is null because an operand is null counts as held.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.series import Series
from tidewatch.model import labels
from tidewatch.session import cut_lineage

DAY_US = 86_400_000_000


def violated(predicate: Column) -> Column:
    return ~F.coalesce(predicate, F.lit(True))


def check_rules(df: DataFrame, rules: Mapping[str, Column], id_col: str) -> DataFrame:
    """Violations per rule with the first offending id, in one pass.

    Rules without a violation are rows with 0.
    """
    aggs = []
    for name, predicate in rules.items():
        bad = violated(predicate)
        aggs.append(
            F.struct(
                F.count_if(bad).alias("violations"),
                F.min(F.when(bad, F.col(id_col))).cast("string").alias("first_id"),
            ).alias(name)
        )
    wide = df.agg(*aggs)
    return wide.unpivot([], list(rules), "rule", "found").select("rule", "found.violations", "found.first_id")


def rejected(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(violated(p), F.lit(n)) for n, p in rules.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def _c(name: str) -> Column:
    return F.col(name)


def OBSERVATION_RULES() -> dict[str, Column]:
    angle = lambda c: (_c(c) >= 0) & (_c(c) < 360)
    return {
        "time_quality_consistent": (_c("time_quality") != "inferred_from_ingest") | (_c("observed_us") == _c("ingested_us")),
        "dead_reckoned_needs_radius": ~_c("is_dead_reckoned") | _c("uncertainty_radius_m").isNotNull(),
        "measurement_complete": (_c("kind") != "measurement") | (_c("metric").isNotNull() & _c("metric_value").isNotNull()),
        "position_has_geo": (_c("kind") != "position") | (_c("lon").isNotNull() & _c("lat").isNotNull()),
        "cog_range": angle("cog_deg"),
        "heading_range": angle("heading_deg"),
        "draft_not_negative": _c("draft_m") >= 0,
    }


def OBSERVATION_LOAD_RULES() -> dict[str, Column]:
    """The part of the suite a bare load table can answer."""
    return {
        "position_has_geo": (_c("kind") != "position") | _c("lon").isNotNull(),
        "source_time_for_signups": _c("wire_us").isNotNull() | (_c("event_type") != "signup"),
        "cog_range": (_c("cog_deg") >= 0) & (_c("cog_deg") < 360),
    }


def EVENT_RULES() -> dict[str, Column]:
    return {
        "time_order": _c("occurred_end_us").isNull() | (_c("occurred_end_us") >= _c("occurred_us")),
        "retraction_complete": (_c("status") != "retracted")
        | (_c("retracted_us").isNotNull() & _c("retraction_reason").isNotNull()),
        "derived_point_marked": _c("lon").isNull()
        | _c("geo_precision").isin(*labels.GEO_PRECISION_POINT)
        | _c("point_is_derived"),
        "type_path": _c("type").rlike(labels.TYPE_PATH),
        "severity_range": _c("severity").between(0, 1),
        "confidence_range": _c("confidence").between(0, 1),
        "priority_range": _c("priority").between(0, 100),
        "country_code": _c("country").rlike(labels.COUNTRY_CODE),
    }


def REPORT_RULES() -> dict[str, Column]:
    return {
        "withheld_has_no_text": ~_c("body_withheld") | _c("body_text").isNull(),
        "retraction_needs_reason": _c("retracted_us").isNull() | _c("retraction_reason").isNotNull(),
        "span_ordered": _c("char_end").isNull() | _c("char_start").isNull() | (_c("char_end") >= _c("char_start")),
        "sentiment_range": _c("sentiment").between(-1, 1),
    }


def RELATION_RULES() -> dict[str, Column]:
    return {
        "other_needs_label": (_c("relation_type") != "other") | _c("type_label").isNotNull(),
        "not_self": (_c("from_ref") != _c("to_ref")) | (_c("relation_type") == "associated_with"),
        "evidence_is_array": F.schema_of_variant(F.try_parse_json("evidence")).startswith("ARRAY"),
        "confidence_range": _c("confidence").between(0, 1),
    }


def TRACK_RULES() -> dict[str, Column]:
    return {
        "time_order": _c("time_end_us").isNull() | (_c("time_end_us") >= _c("time_start_us")),
        "open_has_no_end": ~_c("is_open") | _c("time_end_us").isNull(),
        "point_count": _c("point_count") >= 0,
        "distance": _c("distance_m") >= 0,
    }


def EVENT_LINK_RULES() -> dict[str, Column]:
    return {
        "not_self": _c("from_event") != _c("to_event"),
        "hypothesis_needs_strength": (_c("link_type") != "caused_by_hypothesis") | _c("strength").isNotNull(),
    }


def ALERT_RULES() -> dict[str, Column]:
    return {
        "resolved_needs_disposition": ~_c("status").isin("resolved", "false_positive")
        | (_c("resolved_us").isNotNull() & _c("disposition").isNotNull()),
        "acked_complete": _c("acked_us").isNull() == _c("acked_by").isNull(),
        "seen_order": _c("last_seen_us") >= _c("first_seen_us"),
        "occurrences": _c("occurrence_count") >= 1,
    }


def ASSESSMENT_RULES() -> dict[str, Column]:
    machine = _c("author_type").isin("model", "detector")
    no_interval = _c("confidence_lower").isNull() & _c("confidence_upper").isNull()
    ordered = (_c("confidence_lower") <= _c("confidence")) & (_c("confidence") <= _c("confidence_upper"))
    return {
        "model_provenance": (_c("author_type") != "model")
        | (_c("model").isNotNull() & _c("model_version").isNotNull() & _c("prompt_hash").isNotNull()),
        "machine_needs_evidence": ~machine | (F.size("evidence") > 0),
        "forecast_needs_validity": (_c("kind") != "forecast") | _c("valid_to_us").isNotNull(),
        "confidence_interval": no_interval | ordered,
    }


def AREA_RULES() -> dict[str, Column]:
    return {
        "geometry_present": (_c("kind") == "dynamic") | _c("has_geometry"),
        "dynamic_has_anchor": (_c("kind") != "dynamic") | (_c("anchor_ref").isNotNull() & _c("anchor_radius_m").isNotNull()),
        "named_zone_has_id": (_c("kind") != "named_zone") | _c("zone_id").isNotNull(),
        "decay_positive": _c("decay_km") > 0,
    }


def WATCHLIST_RULES() -> dict[str, Column]:
    mode = _c("match_mode")
    return {
        "target": (mode.isin("exact_id", "entity") & _c("ref_id").isNotNull())
        | (mode.isin("pattern", "fuzzy_name") & _c("pattern").isNotNull())
        | ((mode == "attribute") & _c("attribute_path").isNotNull()),
        "weight_range": _c("weight").between(0, 1),
    }


def CASE_RULES() -> dict[str, Column]:
    return {
        "closed_needs_reason": (_c("status") != "closed") | (_c("closed_us").isNotNull() & _c("closure_reason").isNotNull())
    }


def ENTITY_RULES() -> dict[str, Column]:
    return {
        "personal_data_needs_basis": ~_c("contains_personal_data") | _c("personal_data_basis").isNotNull(),
        "merge_not_self": ~_c("merged_into").eqNullSafe(_c("entity_id")),
    }


def ALIAS_RULES() -> dict[str, Column]:
    return {
        "id_type_lowercase": _c("id_type") == F.lower("id_type"),
        "value_not_blank": F.length(F.trim("id_value")) > 0,
    }


def SOURCE_RULES() -> dict[str, Column]:
    return {
        "disabled_needs_reason": ~_c("disabled") | _c("disabled_reason").isNotNull(),
        "licence_present": _c("license_id").isNotNull(),
    }


def LISTING_RULES() -> dict[str, Column]:
    return {"delisting_after_listing": _c("delisted_us") >= _c("listed_us")}


def check_unique(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys held by more than one row, with how many."""
    scope = df if where is None else df.filter(where)
    return scope.groupBy(*keys).agg(F.count("*").alias("holders")).filter(F.col("holders") > 1)


def retention_plan(obs: DataFrame, sources: DataFrame, today_us: int, default_days: int = 90) -> DataFrame:
    """Keep or drop per day and source. The stricter limit wins."""
    days = obs.groupBy("source_id", F.floor(F.col("observed_us") / DAY_US).cast("long").alias("day")).agg(
        F.count("*").alias("n")
    )
    limit = F.least(F.lit(default_days), F.coalesce("retention_days", F.lit(default_days)))
    today = int(today_us // DAY_US)
    return (
        days.join(sources.select("source_id", "retention_days"), "source_id", "left")
        .withColumn("limit_days", limit)
        .withColumn("drop", F.col("day") < today - F.col("limit_days"))
        .drop("retention_days")
    )


def apply_retention(obs: DataFrame, sources: DataFrame, today_us: int, default_days: int = 90) -> DataFrame:
    limit = F.least(F.lit(default_days), F.coalesce("retention_days", F.lit(default_days)))
    day = F.floor(F.col("observed_us") / DAY_US)
    today = int(today_us // DAY_US)
    if "obs_date" in obs.columns:
        # Partitions past every limit are not read at all; strays may be of any day.
        first = F.date_from_unix_date(F.lit(today - default_days)).cast("string")
        obs = obs.filter((F.col("obs_date").cast("string") >= first) | (F.col("obs_date").cast("string") == "stray"))
    return (
        # Days past every limit go first, without a look at the source register.
        obs.filter(day >= today - default_days)
        .join(sources.select("source_id", "retention_days"), "source_id", "left")
        .filter(day >= today - limit)
        .drop("retention_days")
    )


def purge_due(rows: DataFrame, today_us: int, key: str, personal: str = "personal", purge_us: str = "purge_us") -> DataFrame:
    """Rows past their purge date, and personal data without any date, by ``verdict``.

    ``purge`` rows are to go now. ``undated`` ones hold personal data that nobody has
    given a date; they are reported and stay.
    """
    due = F.col(purge_us) <= today_us
    verdict = F.when(due, "purge").when(F.col(personal) & F.col(purge_us).isNull(), "undated")
    return rows.select(key, purge_us, verdict.alias("verdict")).filter(F.col("verdict").isNotNull())


def drop_expired(spark: SparkSession, path: str, sources: DataFrame, today_us: int, default_days: int = 90) -> DataFrame:
    """Enforce retention on stored day partitions; one row per partition touched.

    A day past every source's limit is dropped as a folder, unread. Of the days in
    between only those that hold rows of a stricter source are written again, each
    replaced as a whole; other files stay as they are. Strays have no day of their own and are judged
    row by row. ``obs_date, action, n`` with ``dropped`` or ``rewritten`` and, for the latter, the
    rows that went. A second run changes nothing.
    """
    table = spark.read.parquet(path)
    name = F.col("obs_date").cast("string")
    today = int(today_us // DAY_US)
    first = F.date_from_unix_date(F.lit(today - default_days)).cast("string")
    # Only partition names are needed, at most one row for each day there is.
    days = table.select(name.alias("obs_date")).distinct()
    old = [r[0] for r in days.filter((F.col("obs_date") < first) & (F.col("obs_date") != "stray")).collect()]
    for day in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/obs_date={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    held = spark.read.schema(table.schema).parquet(path)
    limit = F.least(F.lit(default_days), F.coalesce("__days", F.lit(default_days)))
    limits = sources.select("source_id", F.col("retention_days").alias("__days"))
    # A null time has no age and stays.
    past = F.coalesce(F.floor(F.col("observed_us") / DAY_US) < today - limit, F.lit(False))
    # Days within the strictest limit hold nothing to judge.
    strictest = sources.agg(F.min("retention_days")).first()[0]
    newest = F.date_from_unix_date(F.lit(today - min(default_days, default_days if strictest is None else strictest))).cast("string")
    judged = held.filter((name < newest) | (name == "stray")).join(limits, "source_id", "left").withColumn("__past", past).drop("__days")
    touched = cut_lineage(judged.filter("__past").groupBy(name.alias("obs_date")).agg(F.count("*").alias("n")))
    names = [r[0] for r in touched.select("obs_date").collect()]
    if names:
        # Written elsewhere first: a partition is never replaced while it is read.
        left = cut_lineage(judged.filter(name.isin(names) & ~F.col("__past")).drop("__past"))
        full = {r[0] for r in left.select(name).distinct().collect()}
        writer = left.repartitionByRange("obs_date", "observed_us").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("obs_date").parquet(path)
        for day in set(names) - full:  # nothing is left of it
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/obs_date={day}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        spark.catalog.refreshByPath(path)
    gone = spark.createDataFrame([(d,) for d in old], "obs_date string").select("obs_date", F.lit("dropped").alias("action"), F.lit(None).cast("long").alias("n"))
    return gone.unionByName(touched.select("obs_date", F.lit("rewritten").alias("action"), "n"))


def licence_gate(reports: DataFrame, sources: DataFrame, use: str, now_us: int, body: str = "text") -> DataFrame:
    """What may be shown for ``use``; text is withheld where it may not.

    The report stays, with the reason and the attribution it must carry.
    """
    lic = sources.select("source_id", "license_id", "license_expires_us", "allowed_uses", "attribution")
    verdict = (
        F.when(F.col("license_id").isNull(), "no_licence")
        .when(F.col("license_expires_us") <= now_us, "expired")
        .when(~F.array_contains("allowed_uses", use), "use_not_allowed")
        .otherwise("allowed")
    )
    gated = reports.join(lic, "source_id", "left").withColumn("licence_verdict", verdict)
    withheld = F.col("licence_verdict") != "allowed"
    return (
        gated.withColumn("body_withheld", withheld)
        .withColumn(body, F.when(~withheld, F.col(body)))
        .drop("license_expires_us", "allowed_uses")
    )


def reliability_changes(grades: DataFrame, at: str = "at_us") -> DataFrame:
    """Audit trail: a row only where the grade differs from the one before."""
    series = Series(["source_id"], [at], F.floor(F.col(at) / (30 * DAY_US)))
    seen = series.with_previous(grades, ["reliability"], "prev")
    changed = F.col("prev").isNull() | (F.col("prev.reliability") != F.col("reliability"))
    return seen.filter(changed).select(
        "source_id", at, F.col("prev.reliability").alias("from_value"), F.col("reliability").alias("to_value")
    )
