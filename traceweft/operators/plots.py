"""Tables behind plots: what a chart would draw, small whatever the size of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweft.operators.orderstats import quantiles


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths from the least to the greatest value; the last bin holds its upper edge."""
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    edge = x.agg(F.min("x").alias("a"), F.max("x").alias("z"))
    wide = (F.col("z") - F.col("a")) / bins
    place = F.when(F.col("z") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / wide), F.lit(bins - 1))).otherwise(0)
    counts = x.join(F.broadcast(edge)).groupBy(place.cast("int").alias("bin"), "a", "z").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.col("a") + F.col("bin") * wide).alias("low"), (F.col("a") + (F.col("bin") + 1) * wide).alias("high"), "n")


def bars(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(value, n, share) of the commonest values."""
    c = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "value").limit(top)


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles and whiskers (the last values within 1.5 times the distance of the quartiles) of one column."""
    q = quantiles(df, {"q": F.col(column)}, [0.25, 0.5, 0.75])
    far = 1.5 * (F.col("q")[2] - F.col("q")[0])
    x = df.select(F.col(column).cast("double").alias("x")).join(F.broadcast(q))
    inside = F.when(F.col("x").between(F.col("q")[0] - far, F.col("q")[2] + far), F.col("x"))
    return x.groupBy(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.count_if(inside.isNull() & F.col("x").isNotNull()).alias("n_out"))
