"""Predicates over the model: place, time, taxonomy, visibility, open items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo, times
from tidewatch.model import labels

DAY_US = 86_400_000_000
# Partition of rows outside the days a table was written for.
STRAY = "stray"


def in_viewport(df: DataFrame, box: geo.Box, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.filter(geo.in_box(F.col(lon), F.col(lat), box.checked()))


def within_radius(
    df: DataFrame, lon: float, lat: float, metres: float, x: str = "lon", y: str = "lat"
) -> DataFrame:
    """Great-circle radius; a latitude band first, because it can be pushed down."""
    reach = metres / geo.EARTH_RADIUS_M * 57.29577951308232 + 1e-9
    distance = geo.haversine_m(F.lit(lon), F.lit(lat), F.col(x), F.col(y))
    return (
        df.filter(F.col(y).between(lat - reach, lat + reach))
        .withColumn("distance_m", distance)
        .filter(F.col("distance_m") <= metres)
    )


def entity_window(
    df: DataFrame, ref_id: str, end_us: int, hours: int, at: str = "observed_us"
) -> DataFrame:
    """One entity's rows of the last ``hours``, newest first.

    A table written by day also gets the day predicate, so only one or two
    partitions, and that of the strays, are read.
    """
    start_us = end_us - hours * 3_600_000_000
    hit = df.filter((F.col("ref_id") == ref_id) & (F.col(at) > start_us) & (F.col(at) <= end_us))
    if "obs_date" in df.columns:
        # As strings, and with the strays: those may be of any day.
        first, last = (F.date_from_unix_date(F.lit(us // DAY_US)).cast("string") for us in (start_us, end_us))
        day = F.col("obs_date").cast("string")
        hit = hit.filter(day.between(first, last) | (day == STRAY))
    return hit.orderBy(F.desc(at), F.desc("obs_id"))


def taxonomy_filter(df: DataFrame, prefix: str, col: str = "type") -> DataFrame:
    """The type itself or anything below it; siblings with the same start are out."""
    return df.filter((F.col(col) == prefix) | F.col(col).startswith(prefix + "."))


def valid_type_path(col: Column) -> Column:
    return col.rlike(labels.TYPE_PATH)


def has_any_tag(df: DataFrame, tags: Sequence[str], col: str = "tags") -> DataFrame:
    return df.filter(F.arrays_overlap(F.col(col), F.array(*[F.lit(t) for t in tags])))


def has_all_tags(df: DataFrame, tags: Sequence[str], col: str = "tags") -> DataFrame:
    wanted = F.array(*[F.lit(t) for t in tags])
    return df.filter(F.size(F.array_except(wanted, F.col(col))) == 0)


def visible_to(
    df: DataFrame, user: str | None, teams: Sequence[str] = (), shareable: bool = True
) -> DataFrame:
    """Rows a user may read. No user, no rows.

    ``shareable=False`` is the stricter rule of assessments: owner, org, public.
    """
    if not user:
        return df.filter(F.lit(False))
    rule = (F.col("owner_id") == user) | F.col("visibility").isin("org", "public")
    if shareable:
        rule = rule | F.array_contains("shared_with", user)
        if teams:
            in_team = F.arrays_overlap("shared_with", F.array(*[F.lit(t) for t in teams]))
            rule = rule | ((F.col("visibility") == "team") & in_team)
    return df.filter(F.coalesce(rule, F.lit(False)))


def visible_children(children: DataFrame, visible_parents: DataFrame, key: str) -> DataFrame:
    """Items and notes are visible where their case is."""
    return children.join(visible_parents.select(key), key, "left_semi")


def valid_at(
    df: DataFrame, at_us: int | Column, start: str = "from_us", end: str = "to_us"
) -> DataFrame:
    at = F.lit(at_us) if isinstance(at_us, int) else at_us
    return df.filter(times.contains(F.col(start), F.col(end), at))


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status").isin(*labels.OPEN_ALERT_STATUS))


def open_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.filter(F.col("gap_end_us").isNull())


def open_forecasts(assessments: DataFrame) -> DataFrame:
    return assessments.filter((F.col("kind") == "forecast") & F.col("verdict").isNull())


def open_contradictions(contradictions: DataFrame) -> DataFrame:
    return contradictions.filter(F.col("resolved_us").isNull())


def resolution_queue(refs: DataFrame) -> DataFrame:
    """References that still wait for a decision."""
    return refs.filter(F.col("resolution_status").isin(*labels.UNRESOLVED))


def with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Reliability, licence and expected latency of each record's source."""
    return df.join(sources, "source_id", "left")


def in_language(reports: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Preferred translation where there is one; the original always stays."""
    wanted = translations.filter(F.col("lang") == lang).select(
        "report_id", F.col("title").alias("__title"), F.col("text").alias("__text")
    )
    translated = F.col("__title").isNotNull() | F.col("__text").isNotNull()
    return (
        reports.join(wanted, "report_id", "left")
        .withColumn("is_translated", translated)
        .withColumn("shown_title", F.coalesce("__title", "title"))
        .withColumn("shown_text", F.coalesce("__text", "text"))
        .withColumn("shown_lang", F.when(translated, F.lit(lang)).otherwise(F.col("lang")))
        .drop("__title", "__text")
    )
