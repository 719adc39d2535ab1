"""Times: every "now" of an operator is an argument, compared in the column's own type."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(df: DataFrame, column: str, as_of: datetime) -> Column:
    """`as_of` as a literal of the type of `df[column]` (timestamp or timestamp_ntz)."""
    return F.lit(as_of.isoformat(sep=" ")).cast(df.schema[column].dataType)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6
