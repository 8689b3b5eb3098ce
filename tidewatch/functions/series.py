"""Ordered-series kernels that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(t)`` puts all rows of one key into one
task, so a key that owns a third of the data would own a third of the job. It is
also the least there is to shuffle, so keys of up to ``busy`` rows get it. Busier
keys are found by a count, and their series is cut into consecutive *segments* (an hour, a day, a block
of arrival numbers): rows are shuffled by ``(key, segment)``, a window runs
inside each segment, and what has to cross a segment border is taken from one
summary row per segment. The summaries are aggregated map-side, so the only
per-key window runs over as many rows as the key has segments.

The segment column must never decrease along the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage, reads_written

_SEG = "__segment"
BUSY_ROWS = 100_000

US_PER_DAY = 86_400_000_000
US_PER_HOUR = 3_600_000_000


def day_of(us: str | Column) -> Column:
    """Day number of an epoch-microsecond column; the usual segment."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / US_PER_DAY).cast("long")


@dataclass(frozen=True)
class Part:
    """One column that :meth:`Series.add` adds.

    ``whole`` is its value in a window over all of the key. ``inside`` is its value
    as far as the row's own segment goes, ``edge`` what a
    segment hands on, ``carry`` what reaches a segment from those before or after
    it, and ``join`` puts the two together.
    """

    out: str
    whole: Column
    inside: Column
    edge: Column
    carry: Callable[[str], Column]
    join: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Series:
    """Rows of each ``key`` in the order of ``order``, cut at ``segment`` where a key
    has more than ``busy`` rows (``BUSY_ROWS`` if nothing else is said)."""

    key: Sequence[str]
    order: Sequence[str]
    segment: Column
    busy: int | None = None

    @property
    def _plain(self):
        return Window.partitionBy(*self.key).orderBy(*self.order)

    @property
    def _all_before(self):
        return self._plain.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def _inner(self):
        return Window.partitionBy(*self.key, _SEG).orderBy(*self.order)

    @property
    def _upto(self):
        return self._inner.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def _outer(self):
        return Window.partitionBy(*self.key).orderBy(_SEG)

    @property
    def _before(self):
        return self._outer.rowsBetween(Window.unboundedPreceding, -1)

    def _rank_struct(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def previous(self, cols: Sequence[str], out: str = "previous") -> Part:
        """Struct of ``cols`` of the row before, null at the start."""
        value = F.struct(*[F.col(c) for c in cols])
        edge = F.max_by(value, self._rank_struct())
        return Part(out, F.lag(value).over(self._plain), F.lag(value).over(self._inner), edge, lambda e: F.lag(e).over(self._outer), F.coalesce)

    def next(self, cols: Sequence[str], out: str = "next") -> Part:
        """Struct of ``cols`` of the row after, null at the end."""
        value = F.struct(*[F.col(c) for c in cols])
        edge = F.min_by(value, self._rank_struct())
        return Part(out, F.lead(value).over(self._plain), F.lead(value).over(self._inner), edge, lambda e: F.lead(e).over(self._outer), F.coalesce)

    def running_sum(self, value: Column, out: str) -> Part:
        """Sum of ``value`` over all rows up to and with this one."""
        before = lambda e: F.coalesce(F.sum(e).over(self._before), F.lit(0))
        return Part(out, F.sum(value).over(self._all_before), F.sum(value).over(self._upto), F.sum(value), before, lambda a, b: a + b)

    def row_number(self, out: str) -> Part:
        return self.running_sum(F.lit(1).cast("long"), out)

    def last_known(self, value: Column, out: str) -> Part:
        """Latest non-null ``value`` at or before this row."""
        edge = F.max_by(value, F.when(value.isNotNull(), self._rank_struct()))
        inside = F.last(value, ignorenulls=True).over(self._upto)
        whole = F.last(value, ignorenulls=True).over(self._all_before)
        return Part(out, whole, inside, edge, lambda e: F.last(e, ignorenulls=True).over(self._before), F.coalesce)

    def add(self, df: DataFrame, *parts: Part) -> DataFrame:
        """``df`` with all ``parts``.

        ``df`` is written first unless it comes from written tables alone, so nothing before
        it is computed a second time. The count of rows per key reads the columns of the key only.
        Steps that follow each other by the same key share one shuffle.
        """
        most = BUSY_ROWS if self.busy is None else self.busy
        if not reads_written(df):
            df = cut_lineage(df)
        busy = cut_lineage(df.groupBy(*self.key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).drop("__n"))
        if busy.isEmpty():
            return self._add_plain(df, parts)
        same = [F.col(f"__key{i}").eqNullSafe(F.col(c)) for i, c in enumerate(self.key)]
        marks = busy.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(self.key)])
        few = self._add_plain(df.join(marks, same, "left_anti"), parts)
        return few.unionByName(self._add_cut(df.join(marks, same, "left_semi"), parts))

    def _add_plain(self, df: DataFrame, parts: Sequence[Part]) -> DataFrame:
        return df.withColumns({p.out: p.whole for p in parts})

    def _add_cut(self, df: DataFrame, parts: Sequence[Part]) -> DataFrame:
        """The sorted table is written once. Both the segments' summaries and the
        result come from there."""
        own = {f"__in{i}": p.inside for i, p in enumerate(parts)}
        inside = cut_lineage(df.withColumn(_SEG, self.segment).withColumns(own))
        edges = inside.groupBy(*self.key, _SEG).agg(*[p.edge.alias(f"__edge{i}") for i, p in enumerate(parts)])
        carry = edges.select(*self.key, _SEG, *[p.carry(f"__edge{i}").alias(f"__carry{i}") for i, p in enumerate(parts)])
        joined = inside.join(carry, [*self.key, _SEG], "left")
        out = {p.out: p.join(F.col(f"__in{i}"), F.col(f"__carry{i}")) for i, p in enumerate(parts)}
        spare = [f"__{kind}{i}" for kind in ("in", "carry") for i in range(len(parts))]
        return joined.withColumns(out).drop(*spare, _SEG)

    def with_previous(self, df: DataFrame, cols: Sequence[str], out: str = "previous") -> DataFrame:
        return self.add(df, self.previous(cols, out))

    def with_next(self, df: DataFrame, cols: Sequence[str], out: str = "next") -> DataFrame:
        return self.add(df, self.next(cols, out))

    def with_running_sum(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        return self.add(df, self.running_sum(value, out))

    def with_row_number(self, df: DataFrame, out: str) -> DataFrame:
        return self.add(df, self.row_number(out))

    def with_last_known(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        return self.add(df, self.last_known(value, out))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, so each task pre-reduces."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(
            F.max_by(
                F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])
            ).alias("__row")
        )
        .select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])
            ).alias("__row")
        )
        .select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    )


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key under ``order``, with column ``rank_no``.

    Spark limits each input partition to ``k`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key moves at most k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(window)).filter(F.col("rank_no") <= k)
