"""Distinct, duplicates and fuzzy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceweft.sources.scratch import scratch


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, key: list[str], ts: str, ties: list[str]) -> DataFrame:
    return keep_first(df, key, [F.desc(ts), *ties])


def repeated_rows(df: DataFrame) -> DataFrame:
    """Every distinct row that occurs more than once, with its count; counted before anything is sorted."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def repeats_per_key(df: DataFrame, key: str) -> DataFrame:
    """Rows that belong to a group of equal rows, counted per key."""
    return repeated_rows(df).groupBy(key).agg(F.sum("n_copies").alias("n_duplicate_rows"))


def duplicate_share(df: DataFrame) -> DataFrame:
    """Rows, rows beyond the first of equal ones, and their percentage."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates")).withColumn("pct", 100.0 * F.col("n_duplicates") / F.col("n_rows"))


def key_grams(key: Column) -> Column:
    """Distinct character n-grams of 2 to 4 of a key, padded by blanks on both sides."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(key)), F.lit(" "))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substr(padded, i, F.lit(n))) for n in (2, 3, 4)]  # noqa: B023
    return F.array_distinct(F.concat(*grams))


def _cut(df: DataFrame) -> DataFrame:
    """The same rows read from a table in the shared folder, which cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fuzzy_keys(df: DataFrame, key: str, similarity: float = 0.8) -> DataFrame:
    """(key, canonical): keys alike in their n-grams take one spelling, the commonest, of equals the least.

    Two distinct keys are alike from a Jaccard similarity of their n-grams on. Candidates share one of the
    rarest n-grams that the threshold leaves no way around (prefix filter), so no link is missed and pairs
    that share only common n-grams never meet. Groups are what chains of links connect. Hashed or numbered
    keys should not be merged this way.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    grams = counts.select("k", key_grams(F.col("k")).alias("g")).withColumn("size", F.size("g"))
    flat = grams.select("k", "size", F.explode("g").alias("gram"))
    rare = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("k").orderBy("df", "gram")
    prefix = flat.join(rare, "gram").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("size") - F.ceil(similarity * F.col("size")) + 1)
    a = prefix.select(F.col("k").alias("a"), "gram")
    b = prefix.select(F.col("k").alias("b"), "gram")
    pairs = a.join(b, "gram").where("a < b").select("a", "b").distinct()
    one, two = grams.select(F.col("k").alias("a"), F.col("g").alias("ga")), grams.select(F.col("k").alias("b"), F.col("g").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    links = pairs.join(one, "a").join(two, "b").where(both / (F.size("ga") + F.size("gb") - both) >= similarity).select("a", "b")
    links = _cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = counts.select("k", F.col("k").alias("label"))
    done = False
    while not done:
        near = links.join(label.select(F.col("k").alias("b"), "label"), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("m"))
        new = _cut(label.join(near, "k", "left").select("k", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")))
        done = new.where("moved").isEmpty()
        label = new.select("k", "label")
    best = Window.partitionBy("label").orderBy(F.desc("n"), "k")
    named = label.join(counts, "k").withColumn("canonical", F.first("k").over(best))
    return named.select(F.col("k").alias("key"), "canonical")
