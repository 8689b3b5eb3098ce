"""Small helpers that shape the plan, not the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expensive expression is evaluated once per row.

    A plain ``withColumn`` is substituted into every later filter that mentions
    the column, so a JSON parse would run once per mention. A one-element
    explode keeps the same rows and stops that substitution.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def large(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: it is shuffled, never broadcast.

    Before a query runs, Spark takes a file's size for the size in memory, which
    for numbered keys in columns is a hundredth of it, and the driver would have to
    hold the table.
    """
    return df.hint("merge")
