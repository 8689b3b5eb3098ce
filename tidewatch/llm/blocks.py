"""Texts as byte blocks: what the numpy operators share.

A batch of texts is looked at as one byte array with document offsets. Hashes of
words, lines and windows come from running sums of ``value * base ** place``
modulo the prime 2**61 - 1, so no loop runs over words or bytes, and two different
pieces of n bytes share a hash with a chance of n / 2**61 whatever their pattern
is (modulo 2**64 some patterned texts of 1,024 letters do for every base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
ROWS_PER_BATCH = 1000
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at ASCII white space, and of words of letters and digits.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

#: Of the hashes: a prime, a base, and a value under 2**30 for each byte.
PRIME = np.uint64((1 << 61) - 1)
#: Places worked on at a time, so that they stay in the cache.
STEP = 1 << 14
PLACE_BASE = int(_rng.integers(1 << 40, (1 << 61) - 1))
PLACE_VALUES = np.random.default_rng(20240301).integers(1, 1 << 30, 256, dtype=np.uint64)

_powers = {}


def _folded(v: np.ndarray) -> np.ndarray:
    """``v`` modulo the prime."""
    v = (v & PRIME) + (v >> np.uint64(61))
    return np.minimum(v, v - PRIME)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo the prime, for values under it: halves of 31 bits, where
    2**61 counts as 1, so that no part passes 64 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    high = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _folded(((a1 * b1) << np.uint64(1)) + high + a0 * b0)


def _place_powers(n: int, base: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo the prime, at least; kept for the next block."""
    have = _powers.get(("place", base))
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) <= max(n, 1 << 16):
        step = np.uint64(pow(base, len(have), int(PRIME)))
        have = np.concatenate([have, _product(have, step)])
    _powers["place", base] = have
    return have


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``hashes`` takes the hash of any piece."""
    place = _place_powers(len(data), PLACE_BASE)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    for a in range(0, len(data), STEP):
        value = PLACE_VALUES[data[a : a + STEP]]
        power = place[a : a + len(value)]
        middle = value * (power >> half)
        terms = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + value * (power & low)
        terms = (terms & PRIME) + (terms >> np.uint64(61))
        # Halves are summed apart, so that no sum of a step passes 64 bits.
        high = np.cumsum(terms >> half)
        high = (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << half)
        out[a + 1 : a + 1 + len(value)] = _folded(high + np.cumsum(terms & low) + out[a])
    return out


def hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each piece ``[start, end)``; equal bytes give equal hashes."""
    inverse = _place_powers(len(running), pow(PLACE_BASE, -1, int(PRIME)))
    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), STEP):
        first = starts[a : a + STEP]
        out[a : a + STEP] = _product(_folded(running[ends[a : a + STEP]] + (PRIME - running[first])), inverse[first])
    return out


def powers(n: int, base: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2**64, kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def short_sums(data: np.ndarray) -> np.ndarray:
    """Running sums for ``short_hashes``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data), BASE)[: len(data)], out=out[1:])
    return out


def short_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes modulo 2**64, for buckets and filters: long patterned pieces may share one."""
    return (running[ends] - running[starts]) * powers(len(running), BASE_INVERSE)[starts]


class Words:
    """The words of a block: byte positions, and the range of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = kind[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offsets[1:-1]
        first[cut] = inside[cut]
        last = np.zeros(len(data) + 1, dtype=bool)
        last[1:] = inside[:-1] & (~inside[1:] | first[1:])
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last)
        #: Words of document d are those numbered bounds[d] .. bounds[d + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def grams(self, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words within one document."""
        count = len(values) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        out = values[at].copy()
        for k in range(1, n):
            out = out * np.uint64(BASE) + values[at + k]
        return at, mixed(out)


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of ``column`` and their offsets.

    A slice has about ``limit`` bytes; a longer text is a slice of its own, so
    memory follows the longest text and not the batch. A null text is empty.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column)
        if texts.null_count:
            texts = texts.fill_null("")
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, where, store = texts.buffers()
        offsets = np.frombuffer(where, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = np.frombuffer(store, dtype=np.uint8) if store is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            yield batch.slice(at, to - at), whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def lean(df: DataFrame) -> DataFrame:
    """Keeps the session's Arrow batches small: rows hold whole texts, and a batch
    of the usual 10,000 of them is tens of MB in the JVM and in the worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_PER_BATCH:
        conf.set(name, str(ROWS_PER_BATCH))
    return df


def counts_per(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of ``weights`` (or number of entries) per document."""
    if weights is None:
        return np.bincount(doc, minlength=n_docs)
    return np.bincount(doc, weights=weights, minlength=n_docs).astype(np.int64)


def copied(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in their document, and which an earlier one."""
    keys = mixed(values ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, earlier = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return any_, earlier


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``length`` from one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def documents(spark, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def row_key():
    """Tells rows apart by id and text; rows equal in both share their results."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
