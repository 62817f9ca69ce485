"""Bounded samples of labelled documents for the classifiers that are fitted on the driver."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweft.llm.durable import Tables

#: Defaults of the parameters that bound a training sample: rows, characters of one text, characters of all.
ROWS, LONGEST, CHARS = 4000, 200_000, 32_000_000


def some(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """All rows if there are at most ``rows``, else about ``rows`` of them, chosen by a hash of the key; never over twice as many."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * rows / n)).limit(2 * rows)


def bounded(drawn: DataFrame, chars: int) -> list:
    """Rows of a sample (k, text, ...) in order of k, as many as have ``chars`` characters together.

    Lengths come to the driver first, so that no more text does than is asked for.
    """
    t = Tables(drawn.sparkSession, "sample")
    drawn = t.keep("drawn", drawn)
    sizes = sorted(map(tuple, drawn.select("k", F.length("text")).collect()))
    upto = list(accumulate(size for _, size in sizes))
    fit = bisect_right(upto, chars)
    found = [] if not fit else drawn.where(F.col("k") <= sizes[fit - 1][0]).collect()
    t.drop("drawn")
    return sorted(found, key=lambda r: (r.k, r.text))


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int = ROWS, longest: int = LONGEST, chars: int = CHARS, text: str = "text", doc_id: str = "doc_id"
) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample of the rows of ``labels`` that are not held out.

    Both classes are drawn from apart, up to half of ``rows`` each, among ids that carry one label alone; texts
    of more than ``longest`` characters are passed over, and texts are taken in the order of a hash of their id
    while they have ``chars`` characters together. Of texts that share an id the least is taken. The sample of
    ids has a proven bound and is broadcast; documents never move but for those drawn.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y")
    drawn = [some(known.where(F.col("y") == y), F.col("id"), rows // 2) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") <= longest)
    met = base.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("k", F.xxhash64("id", F.lit(29)))
    found = bounded(met, chars)
    return [r.text for r in found], [r.y for r in found]
