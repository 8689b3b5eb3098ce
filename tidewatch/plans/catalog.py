"""The catalogue of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``, with its equivalent DuckDB SQL."""

    def register(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Entry(name, build, sql)
        return build

    return register
