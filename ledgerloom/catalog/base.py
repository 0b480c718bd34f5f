"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def r6(name: str, c: Column | str | None = None) -> Column:
    """A double rounded to 6 places under a name; sums of doubles differ in the last bits between engines."""
    c = F.col(name) if c is None else F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6).alias(name)
