"""Aggregations: per-key counts, histograms, crosstabs, combination counts and reports in long form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceweft.operators.orderstats import quantiles


def key_counts(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Distinct and non-null counts of each column per key, as <column>_unique and <column>_total."""
    aggs = [g.alias(f"{c}_{k}") for c in columns for k, g in (("unique", F.count_distinct(c)), ("total", F.count(c)))]
    return df.groupBy(key).agg(*aggs)


def stacked_counts(df: DataFrame, keys: Iterable[str], column: str) -> DataFrame:
    """Distinct and row counts of a column under each key apart, stacked with the key's name as type."""
    out = None
    for k in keys:
        one = df.groupBy(F.col(k).alias("key")).agg(F.count_distinct(column).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("type"), F.col("key").cast("string").alias("key"), "n_distinct", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def value_histogram(df: DataFrame, key: str, value: str, total: bool = False, missing: str = "unlabeled") -> DataFrame:
    """Per key the text ``value:count;...`` in order of values, and optionally a TOTAL row over all keys."""
    base = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(value).cast("string"), F.lit(missing)).alias("value"))
    counts = base.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    if total:
        counts = counts.unionByName(counts.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit("TOTAL").alias("key"), "value", "n"))
    pairs = F.array_sort(F.collect_list(F.struct("value", "n")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["value"], F.lit(":"), p["n"].cast("string"))), ";")
    return counts.groupBy("key").agg(text.alias("histogram"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"))


def combinations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each combination of values and their percentage of all rows."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(*columns, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def distinct_tagged(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct combinations and distinct values of each column, tagged by what they are."""
    out = df.select(F.lit("combination").alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("value")).distinct()
    for c in columns:
        out = out.unionByName(df.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")).distinct())
    return out


def crosstab(df: DataFrame, key: str, state: str, states: list, prefix: str = "state_") -> DataFrame:
    """Rows per key and state, zero where there are none, with their total; one pass for all states."""
    return df.groupBy(key).agg(*[F.count_if(F.col(state) == s).alias(f"{prefix}{s}") for s in states], F.count(F.lit(1)).alias("total"))


def rates(df: DataFrame, key: str, state: str, states: list) -> DataFrame:
    """Share of each state per key."""
    return df.groupBy(key).agg(*[(F.count_if(F.col(state) == s) / F.count(F.lit(1))).alias(f"rate_{s}") for s in states])


def key_classes(df: DataFrame, key: str, state: str, marked: list, zero) -> DataFrame:
    """Per key whether it has any marked state and whether it only has the zero state."""
    return df.groupBy(key).agg(F.bool_or(F.coalesce(F.col(state).isin(*marked), F.lit(False))).alias("marked"), F.bool_and(F.coalesce(F.col(state) == zero, F.lit(False))).alias("zero_only"), F.count(F.lit(1)).alias("n_rows"))


def limit_groups(df: DataFrame, valid: Column, group: list[str], name: str, total_over: str = "n_rows") -> DataFrame:
    """Groups of valid rows by the given columns and one group of the rest by name: rows, share, commonest name, names.

    The commonest name of equals is the least.
    """
    tagged = df.withColumn("category", F.when(F.coalesce(valid, F.lit(False)), "combination").otherwise("missing_values"))
    keys = [F.when(F.col("category") == "combination", F.col(c).cast("string")).alias(c) for c in group]
    per_name = tagged.select("category", *keys, F.col(name).alias("name")).groupBy("category", *group, "name").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("name", F.struct(-F.col("n"), "name"))
    groups = per_name.groupBy("category", *group).agg(F.sum("n").alias(total_over), F.count("name").alias("n_names"), best.alias("mode_name"))
    total = groups.agg(F.sum(total_over).alias("all_rows"))
    return groups.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col(total_over) / F.col("all_rows")).drop("all_rows")


def first_and_last(df: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Per key the columns of its first and last row by time, ties by another column."""
    order = F.struct(ts, tie)
    row = F.struct(*columns)
    both = df.groupBy(key).agg(F.min_by(row, order).alias("f"), F.max_by(row, order).alias("l"))
    return both.select(key, *[F.col(f"f.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"l.{c}").alias(f"last_{c}") for c in columns])


def long_form(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One row of numbers as (metric, value)."""
    ids = ids or []
    numbers = [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(ids, numbers, "metric", "value")


def per_source_counts(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows, and rows beyond the first of equal ones, per key and source."""
    out = None
    for name, df in sources.items():
        cols = [c for c in df.columns if c != key]
        rows = df.groupBy(key, *cols).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), F.col(key).cast("string").alias("key"), "n")
        out = rows if out is None else out.unionByName(rows)
    names = list(sources)
    aggs = [a for s in names for a in (F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(f"{s}_rows"), F.sum(F.when(F.col("source") == s, F.col("n") - 1).otherwise(0)).alias(f"{s}_repeats"))]
    return out.groupBy("key").agg(*aggs)


def upper_outliers(df: DataFrame, column: str, times: float = 1.5) -> DataFrame:
    """Rows above Q3 + times * (Q3 - Q1) of a column, with the bound."""
    q = quantiles(df, {"q": F.col(column)}, [0.25, 0.75])
    bound = q.select((F.col("q")[1] + times * (F.col("q")[1] - F.col("q")[0])).alias("bound"))
    return df.join(F.broadcast(bound)).where(F.col(column) > F.col("bound"))


def exclusion_report(df: DataFrame, key: str, state: str, states: list, watched) -> DataFrame:
    """Metrics before and after the rows of upper outliers (by their count of the watched state) are excluded."""
    tab = crosstab(df, key, state, states)
    out = upper_outliers(tab, f"state_{watched}").select(key)
    marked = tab.join(out.withColumn("gone", F.lit(True)), key, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    measures = {"rows": "total", "keys": None} | {f"state_{s}": f"state_{s}" for s in states}
    aggs = []
    for name, c in measures.items():
        x = F.col(c) if c else F.lit(1)
        aggs += [F.sum(x).alias(f"before_{name}"), F.coalesce(F.sum(F.when(~F.col("gone"), x)), F.lit(0)).alias(f"after_{name}")]
    return long_form(marked.agg(*aggs))


def fill_forward(df: DataFrame, key: str, order: list[str], column: str) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
