"""Predicates and filters over traceability tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_and_not(c: Column, default, sentinel=-999) -> Column:
    """Integer-valued, and neither the default nor the sentinel."""
    return (c % 1 == 0) & (c != default) & (c != sentinel)


def not_in(c: Column, values: Iterable, missing: str = "") -> Column:
    """Not in the list; a null counts as the ``missing`` text, so it passes unless that is listed."""
    return ~F.coalesce(c, F.lit(missing)).isin(*values)


def valid_limits(lower: Column, upper: Column, unit: Column, kind: Column) -> Column:
    """Both limits, and a unit or a type."""
    return lower.isNotNull() & upper.isNotNull() & (unit.isNotNull() | kind.isNotNull())


def within_span(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from start to end, both included; raises if the range does not lie within the data's own span."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.to_timestamp_ntz(F.lit(start)).alias("s"), F.to_timestamp_ntz(F.lit(end)).alias("e")).select((F.col("s") <= F.col("e")).alias("order"), ((F.col("s") >= F.col("a")) & (F.col("e") <= F.col("b"))).alias("inside")).first()
    if not (ends["order"] and ends["inside"]):
        raise ValueError(f"{start} to {end} is not within the span of {ts}")
    return df.where(F.col(ts).between(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))))


def on_days(ts: Column, days: Iterable[str]) -> Column:
    return F.to_date(ts).isin(*[F.to_date(F.lit(d)) for d in days])


def exclude_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed; Spark chooses whether the list is broadcast by its size."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")
