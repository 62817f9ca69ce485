"""Key joins with accounting, and the interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweft.operators.columns import suffixed


def suffix_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_b", how: str = "inner") -> DataFrame:
    """Equi-join; the right side's other columns get the suffix."""
    return left.join(suffixed(right, on, suffix), on, how)


def join_summary(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Long form (metric, value): rows, keys, overlap and unmatched rows of both sides, from one aggregate of each."""
    l = left.groupBy(*on).agg(F.count(F.lit(1)).alias("l"))  # noqa: E741
    r = right.groupBy(*on).agg(F.count(F.lit(1)).alias("r"))
    both = l.join(r, on, "full").agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"),
        F.count("l").alias("left_keys"), F.count("r").alias("right_keys"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common_keys"),
        F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("l"))), F.lit(0)).alias("unmatched_left"),
        F.coalesce(F.sum(F.when(F.col("l").isNull(), F.col("r"))), F.lit(0)).alias("unmatched_right"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("joined_rows"),
    )
    return both.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in both.columns]).unpivot([], list(both.columns), "metric", "value")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, seconds: int, how: str = "left", bucketed: bool = False, extra: Column | None = None) -> DataFrame:
    """Equi-key join within a time distance, counted in whole-second boundaries.

    Plain, the distance is a residual condition of the key join. Where keys are few or hot, ``bucketed`` adds
    time buckets of that width to the key: only the right side is repeated, in three neighbouring buckets, so
    each pair meets in exactly one and left rows without a partner keep their single row.
    """
    far = F.abs(F.unix_timestamp(left[left_ts].cast("timestamp")) - F.unix_timestamp(right[right_ts].cast("timestamp"))) <= seconds
    same = [left[k] == right[k] for k in on]
    if not bucketed:
        condition = far if extra is None else far & extra
        for s in same:
            condition = s & condition
        return left.join(right, condition, how)
    bucket = lambda ts: F.floor(F.unix_timestamp(ts.cast("timestamp")) / max(1, seconds))
    a = left.withColumn("_bucket", bucket(left[left_ts]))
    b = right.withColumn("_near", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bucket(right[right_ts]) + k)))
    condition = (F.col("_bucket") == F.col("_near")) & far
    condition = condition if extra is None else condition & extra
    for s in same:
        condition = s & condition
    return a.join(b, condition, how).drop("_bucket", "_near")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """Dimension value per row, or the default."""
    out = df.join(dim.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the union, intersection and differences of two key sets, from one flag per key."""
    flags = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return flags.agg(
        F.count(F.lit(1)).alias("either"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
    )
