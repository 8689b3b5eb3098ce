"""Deterministic identifiers and dedupe keys, in built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base-32 digits of Spark's conv() and Crockford's alphabet.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
# Fixed value: largest time a 48-bit millisecond field can hold.
MAX_TIME_MS = (1 << 48) - 1


def _base32(hex_or_dec: Column, from_base: int, width: int) -> Column:
    return F.lpad(F.translate(F.conv(hex_or_dec, from_base, 32), CONV_DIGITS, CROCKFORD), width, "0")


def deterministic_ulid(at_us: Column, seed: Column) -> Column:
    """26 characters: 48 bits of milliseconds, then 80 bits of SHA-256(seed).

    ``at_us`` is epoch microseconds. Times outside the field are clamped, not
    wrapped, so a bad time still sorts at one end.
    """
    millis = F.greatest(F.lit(0), F.least(F.lit(MAX_TIME_MS), F.floor(at_us / 1000)))
    digest = F.sha2(seed, 256)
    return F.concat(
        _base32(millis.cast("long").cast("string"), 10, 10),
        _base32(F.substring(digest, 1, 10), 16, 8),
        _base32(F.substring(digest, 11, 10), 16, 8),
    )


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys; nulls stay visible, types stay distinct."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
        {"ignoreNullFields": "false"},
    )


def identity_seed(source_id: str, fields: dict[str, Column]) -> Column:
    return F.concat(F.lit(f"{source_id}|"), canonical_json(fields))


def dedupe_key(
    prefix: str, paths: Sequence[str], allow_missing: bool = False
) -> tuple[Column, Column]:
    """``(key, missing)`` for dotted column paths.

    The key is null when a field is missing, unless that is allowed; ``missing``
    lists the absent paths so that the rejected rows can be explained.
    """
    if not paths:
        raise ValueError("a dedupe key needs at least one field")
    missing = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in paths]))
    values = F.struct(*[F.col(p).alias(f"f{i:02d}") for i, p in enumerate(paths)])
    body = F.to_json(values, {"ignoreNullFields": "false"})
    key = F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(body, 256), 1, 32))
    return (key if allow_missing else F.when(F.size(missing) == 0, key)), missing
