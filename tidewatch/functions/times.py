"""Time parsing and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Timestamp from the spellings sources really use; null if unreadable.

    Takes ``2026-08-28 09:14:03.221 +0000 UTC``, ISO 8601 with or without a
    zone (none means UTC), and epoch seconds or milliseconds (over 1e11).
    """
    trimmed = F.trim(text)
    # Drop a trailing zone name and close up "+0000" to what ISO parsing takes.
    iso = F.regexp_replace(trimmed, r"\s+[A-Za-z]\w*$", "")
    iso = F.regexp_replace(iso, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    shaped = iso.rlike(
        r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:\d{2})?)?$"
    )
    number = F.when(
        trimmed.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), trimmed.try_cast("double")
    )
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.coalesce(
        F.when(shaped, F.try_to_timestamp(iso)),
        F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")),
    )


def contains(start: Column, end: Column, at: Column) -> Column:
    """Half-open interval test; a null bound is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def effective_time(observed: Column, ingested: Column) -> Column:
    return F.coalesce(observed, ingested)


def seconds_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / 1_000_000
