"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step replaces edges by edges to a smaller neighbour; when nothing changes the edges are stars around
the least node of each component. Neither nodes nor edges are ever gathered on the driver, and each step is
cut off by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweft.llm.durable import Tables


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(t: Tables, edges: DataFrame, name: str) -> DataFrame:
    """(cls, label): the least node of its component for every node of the edges (a, b)."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    step, before = 0, None
    while True:
        step += 1
        now = t.keep(f"stars{name}-{step}", _small(_large(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if step > 1:
            t.drop(f"stars{name}-{step - 1}")
        if tuple(state) == before:
            break
        before = tuple(state)
    leaves = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("cls"), "label")
    roots = now.select(F.col("b").alias("cls")).distinct().withColumn("label", F.col("cls"))
    return leaves.unionByName(roots)
