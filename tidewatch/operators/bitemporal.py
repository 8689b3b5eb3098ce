"""Versions, time travel and corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.functions.series import Series, day_of
from tidewatch.session import cut_lineage

DAY_US = 86_400_000_000
MONTH_US = 30 * DAY_US


def _month(at: str) -> Column:
    return F.floor(F.col(at) / MONTH_US).cast("long")


def build_versions(snapshots: DataFrame, key: str, at: str) -> DataFrame:
    """Snapshots to ``[from, to)`` intervals; the last one stays open.

    Snapshots of one object at the same time are ordered by a hash of the whole
    row, so a version's number is the same in every run.
    """
    series = Series([key], [at, "__tie"], _month(at))
    tied = snapshots.withColumn("__tie", F.xxhash64(*sorted(f.name for f in snapshots.schema if "map<" not in f.dataType.simpleString())))
    chained = series.add(tied, series.row_number("version"), series.next([at], "__next"))
    return chained.withColumn("from_us", F.col(at)).withColumn("to_us", F.col(f"__next.{at}")).drop("__next", "__tie", at)


def split_current(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(current, history)``: open and closed versions."""
    return versions.filter(F.col("to_us").isNull()), versions.filter(F.col("to_us").isNotNull())


def audit_versions(versions: DataFrame, key: str) -> DataFrame:
    """Per object: gaps, overlaps, open ends and versions without length."""
    series = Series([key], ["from_us", "version"], _month("from_us"))
    seen = series.with_previous(versions, ["to_us"], "prev")
    gap = F.col("prev").isNotNull() & F.col("prev.to_us").isNotNull() & (F.col("prev.to_us") < F.col("from_us"))
    overlap = F.col("prev").isNotNull() & (F.col("prev.to_us").isNull() | (F.col("prev.to_us") > F.col("from_us")))
    return seen.groupBy(key).agg(
        F.count("*").alias("versions"),
        F.count_if(gap).alias("gaps"),
        F.count_if(overlap).alias("overlaps"),
        F.count_if(F.col("to_us").isNull()).alias("open_ends"),
        F.count_if(F.col("to_us") <= F.col("from_us")).alias("empty"),
    )


def all_versions(current: DataFrame, history: DataFrame) -> DataFrame:
    return current.unionByName(history)


def as_of(
    current: DataFrame, history: DataFrame, at_us: int, key: str | None = None, value=None
) -> DataFrame:
    """The version each object had at ``at_us``; nothing before it existed."""
    rows = all_versions(current, history)
    if key is not None:
        rows = rows.filter(F.col(key) == value)
    return rows.filter(times.contains(F.col("from_us"), F.col("to_us"), F.lit(at_us)))


def as_of_many(current: DataFrame, history: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Time travel for many ``(key, at_us)`` questions at once.

    Of an object's versions the latest that began by the asked time is the only
    one that can hold it, so this is an as-of join with a test of the end. No
    version is listed more than once, however long it holds.
    """
    versions = all_versions(current, history)
    columns = [c for c in versions.columns if c not in (key, "from_us")]
    found = asof_join(asked, versions, key, "at_us", "from_us", columns)
    held = found.withColumnRenamed("matched_us", "from_us").filter(F.col("from_us").isNotNull())
    return held.filter(times.contains(F.col("from_us"), F.col("to_us"), F.col("at_us")))


def bitemporal_slice(
    df: DataFrame,
    valid_us: int,
    known_us: int,
    valid: tuple[str, str] = ("valid_from_us", "valid_to_us"),
    known: tuple[str, str] = ("from_us", "to_us"),
) -> DataFrame:
    """Valid at one time as known at another."""
    return df.filter(
        times.contains(F.col(valid[0]), F.col(valid[1]), F.lit(valid_us))
        & times.contains(F.col(known[0]), F.col(known[1]), F.lit(known_us))
    )


def changed_fields(versions: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Which fields differ from the version before; the first has none."""
    series = Series([key], ["from_us"], _month("from_us"))
    seen = series.with_previous(versions, list(fields), "prev")
    differs = [
        F.when(F.col("prev").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"prev.{f}")), F.lit(f)) for f in fields
    ]
    return seen.withColumn("changed", F.array_compact(F.array(*differs))).drop("prev")


def apply_changes(
    current: DataFrame, history: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """SCD-2 step: ``(current, history)`` after a batch of changes.

    ``changes`` holds ``key``, ``at_us``, ``op`` ('upsert' or 'delete') and the
    fields. Several changes to one object each become their own version. A change
    may come late: all versions of a touched object are chained anew with it, so
    every time keeps exactly one version. At equal times a change replaces what is
    stored, and versions without length go. Other objects pass through.
    """
    touched = changes.select(key).distinct()
    stored = current.select(key, *fields, "from_us", "to_us").unionByName(history.select(key, *fields, "from_us", "to_us"))
    # What the batch does not touch is passed on, not written.
    kept, again = stored.join(touched, key, "left_anti"), stored.join(touched, key, "left_semi")
    # A stored version is its start and, where it ends, a deletion that the start
    # of a next version takes back.
    starts = again.select(key, F.col("from_us").alias("at_us"), F.lit(1).alias("rank"), F.lit("upsert").alias("op"), *fields)
    ends = again.filter(F.col("to_us").isNotNull()).select(
        key, F.col("to_us").alias("at_us"), F.lit(0).alias("rank"), F.lit("delete").alias("op"), *fields
    )
    told = changes.select(key, "at_us", F.lit(2).alias("rank"), "op", *fields)
    series = Series([key], ["at_us", "rank"], _month("at_us"))
    chained = series.with_next(starts.unionByName(ends).unionByName(told), ["at_us"], "__next")
    versions = cut_lineage(
        chained.filter((F.col("op") != "delete") & ~F.col("at_us").eqNullSafe(F.col("__next.at_us"))).select(
            key, *fields, F.col("at_us").alias("from_us"), F.col("__next.at_us").alias("to_us")
        )
    )
    now_open, now_closed = split_current(versions)
    kept_open, kept_closed = split_current(kept)
    columns = [key, *fields, "from_us", "to_us"]
    return (
        kept_open.select(*columns).unionByName(now_open.select(*columns)),
        kept_closed.select(*columns).unionByName(now_closed.select(*columns)),
    )


def retract(events: DataFrame, retractions: DataFrame) -> DataFrame:
    """Mark events as retracted. The content stays; reason and successor come in."""
    r = retractions.select(
        "event_id",
        F.col("at_us").alias("retracted_us"),
        F.col("by_source").alias("retracted_by"),
        F.col("reason").alias("retraction_reason"),
        F.col("inferred").alias("retraction_inferred"),
        F.col("successor").alias("superseded_by"),
    )
    joined = events.join(r, "event_id", "left")
    return joined.withColumn(
        "status", F.when(F.col("retracted_us").isNotNull(), "retracted").otherwise(F.col("status"))
    ).withColumn("retraction_inferred", F.coalesce("retraction_inferred", F.lit(False)))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_us: str,
    right_us: str,
    columns: Sequence[str],
    tolerance_us: int | None = None,
) -> DataFrame:
    """Latest right row at or before each left row, per key.

    Both sides become one series per key and day; reference rows carry their
    values, left rows pick up the last ones seen. A busy key is cut by day, and
    what was known at midnight crosses over as one row.
    """
    payload = F.struct(F.col(right_us).alias("matched_us"), *[F.col(c) for c in columns])
    refs = right.select(
        F.col(key), F.col(right_us).alias("__at"), F.lit(0).alias("__side"), payload.alias("__ref")
    )
    asked = left.withColumn("__at", F.col(left_us)).withColumn("__side", F.lit(1))
    series = Series([key], ["__at", "__side"], day_of("__at"))
    filled = series.with_last_known(
        asked.unionByName(refs, allowMissingColumns=True), F.col("__ref"), "__hit"
    ).filter(F.col("__side") == 1)
    hit = F.col("__hit")
    if tolerance_us is not None:
        hit = F.when(F.col("__at") - hit["matched_us"] <= tolerance_us, hit)
    out = filled.withColumn("__hit", hit)
    return out.select(
        *left.columns, F.col("__hit.matched_us").alias("matched_us"), *[F.col(f"__hit.{c}").alias(c) for c in columns]
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def apply_delete(child: DataFrame, deleted: DataFrame, key: str, rule: str) -> DataFrame:
    """Children after their parents were deleted.

    ``set_null`` keeps the row without the reference, ``cascade`` removes it,
    ``restrict`` returns the rows that forbid the deletion.
    """
    gone = deleted.select(key).distinct()
    if rule == "cascade":
        return child.join(gone, key, "left_anti")
    if rule == "restrict":
        return child.join(gone, key, "left_semi")
    if rule == "set_null":
        marked = child.join(gone.withColumn("__gone", F.lit(True)), key, "left")
        return marked.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")
    raise ValueError(f"unknown delete rule {rule}")
