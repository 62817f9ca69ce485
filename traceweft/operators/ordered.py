"""Ranks, bins, gaps between events and running figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_bins(order: list, bins: int, by: list[str] | None = None) -> Column:
    """Quantile bin 0..bins-1 of a row by its rank r of n: max(ceil(bins (r - 1) / (n - 1)), 1) - 1."""
    part = Window.partitionBy(*(by or []))
    r, n = F.row_number().over(part.orderBy(*order)), F.count(F.lit(1)).over(part)
    up = F.floor((bins * (r - 1) + n - 2) / F.greatest(n - 1, F.lit(1)))
    return (F.greatest(up, F.lit(1)) - 1).cast("int")


def average_rank(c: str) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2


def gaps(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Seconds since the event before, per key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("gap_s", (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 1e6)


def gap_statistics(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Per key: gaps, their median and mean, whether any is over three medians, and regularity (0 to 100)."""
    g = gaps(df, key, ts, tie).where("gap_s is not null")
    stats = g.groupBy(key).agg(F.count(F.lit(1)).alias("n_gaps"), F.percentile("gap_s", 0.5).alias("median_gap"), F.avg("gap_s").alias("mean_gap"), F.max("gap_s").alias("max_gap"), F.stddev_samp("gap_s").alias("sd"))
    regular = F.greatest(F.least(100 - 100 * F.coalesce("sd", F.lit(0.0)) / F.nullif("mean_gap", F.lit(0.0)), F.lit(100.0)), F.lit(0.0))
    return stats.select(key, "n_gaps", "median_gap", "mean_gap", (F.col("max_gap") > 3 * F.col("median_gap")).alias("has_gaps"), regular.alias("regularity"))


def frequency_class(seconds: Column) -> Column:
    """Name of a modal gap."""
    return F.when(seconds <= 1, "second").when(seconds <= 60, "minute").when(seconds <= 3600, "hour").when(seconds <= 86400, "day").when(seconds <= 7 * 86400, "week").when(seconds <= 31 * 86400, "month").otherwise("irregular")


def business_hours(df: DataFrame, ts: str) -> DataFrame:
    """Shares of events from 08 to 17 h and on weekdays, and whether both exceed 0.7."""
    hours = F.avg(F.hour(ts).between(8, 17).cast("int"))
    days = F.avg((F.weekday(ts) < 5).cast("int"))
    return df.agg(hours.alias("hour_share"), days.alias("weekday_share")).withColumn("business", (F.col("hour_share") > 0.7) & (F.col("weekday_share") > 0.7))


def running_share(value: str, name: str) -> Column:
    """Cumulative share of a score, largest first."""
    w = Window.orderBy(F.desc(value), name)
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy())
