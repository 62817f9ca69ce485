"""Exact order statistics and running sums that no task has to hold or sort whole.

Up to AT_ONCE rows one aggregation buffer, or one sorted window, is of proven size and is used as it is. Beyond,
quantiles come from rounds of counting: each round counts values in equal slices of the intervals that still hold
a wanted rank, and keeps the slices with it, until few values are left. Running sums go by slices of the value
range, sorted apart, each on top of the sums of the slices before it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one buffer or one sorted window may hold.
AT_ONCE = 1_000_000
#: Slices of an interval in each round, and values that may come to the driver.
SLICES, FEW = 4096, 20_000
_TOP = 1.7976931348623157e308


def quantiles(df: DataFrame, of: dict[str, Column], points: list[float]) -> DataFrame:
    """One row with an array for each name: the exact quantiles, interpolated, of a number's values that are neither null nor NaN."""
    clean = {name: F.when(~F.isnan(x.cast("double")), x.cast("double")) for name, x in of.items()}
    if df.count() <= AT_ONCE:
        return df.agg(*[F.percentile(x, F.array(*[F.lit(p) for p in points])).alias(name) for name, x in clean.items()])
    held = {name: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(_TOP)), F.lit(-_TOP))) for name, x in clean.items()}
    found = _refined(df.select(*[x.alias(name) for name, x in held.items()]), points)
    return df.sparkSession.createDataFrame([tuple(found[name] for name in of)], T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in of]))


def _refined(df: DataFrame, points: list[float]) -> dict[str, list[float | None]]:
    x = df.unpivot([], df.columns, "column", "x").where("x is not null")
    # intervals (column, low, high, values below, values in it) with the ranks that they hold
    todo, known = [], {c: {} for c in df.columns}
    sizes = {}
    for r in x.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        sizes[r["column"]] = r["n"]
        todo.append((r["column"], r["lo"], r["hi"], 0, r["n"], sorted({k for p in points for k in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1)))})))
    while todo:
        inside = lambda t: (F.col("column") == t[0]) & F.col("x").between(t[1], t[2])
        few = [t for t in todo if t[4] <= FEW or t[1] == t[2]]
        if few:
            at = F.coalesce(*[F.when(inside(t), F.lit(i)) for i, t in enumerate(few)])
            rows = sorted(x.select(at.alias("i"), "x").where("i is not null").groupBy("i", "x").count().collect())
            for i, t in enumerate(few):
                upto, ranks = t[3], list(t[5])
                for _, value, n in (r for r in rows if r[0] == i):
                    upto += n
                    while ranks and ranks[0] < upto:
                        known[t[0]][ranks.pop(0)] = value
        many = [t for t in todo if t not in few]
        todo = []
        if many:
            slice_of = lambda t: F.least(F.floor((F.col("x") / 2 - t[1] / 2) / (t[2] / 2 - t[1] / 2) * SLICES), F.lit(SLICES - 1))
            at = F.coalesce(*[F.when(inside(t), F.struct(F.lit(i).alias("i"), slice_of(t).alias("s"))) for i, t in enumerate(many)])
            rows = x.select(at.alias("at"), "x").where("at is not null").groupBy("at").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).select("at.i", "at.s", "n", "lo", "hi").collect()
            for i, t in enumerate(many):
                upto = t[3]
                for _, _, n, lo, hi in sorted(r for r in rows if r[0] == i):
                    if ranks := [k for k in t[5] if upto <= k < upto + n]:
                        todo.append((t[0], lo, hi, upto, n, ranks))
                    upto += n
    out: dict[str, list[float | None]] = {}
    for c in df.columns:
        n = sizes.get(c, 0)
        out[c] = [None] * len(points) if not n else []
        for p in points if n else []:
            place = p * (n - 1)
            lo, hi = (math.copysign(math.inf, v) if abs(v) == _TOP else v for v in (known[c][math.floor(place)], known[c][math.ceil(place)]))
            out[c].append(lo if lo == hi else (math.ceil(place) - place) * lo + (place - math.floor(place)) * hi)
    return out


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, slices: int = 1024) -> DataFrame:
    """Adds, for each name, the sum of a column over this row and all before it; ``order`` holds distinct, non-null values."""
    by = F.desc(order) if descending else F.asc(order)
    upto = lambda c, *part: F.sum(c).over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    if not isinstance(df.schema[order].dataType, T.NumericType) or df.count() <= AT_ONCE:
        return df.withColumns({name: upto(c) for name, c in sums.items()})
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [k / slices for k in range(1, slices)], 100 * slices)).first()[0]
    edges = [-math.inf, *sorted(set(cuts)), math.inf]
    cut = Bucketizer(splits=edges, inputCol="_x", outputCol="_slice", handleInvalid="keep").transform(df.withColumn("_x", F.col(order).cast("double"))).drop("_x")
    totals = cut.groupBy("_slice").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = Window.orderBy(F.desc("_slice") if descending else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    out = cut.join(F.broadcast(offsets), "_slice")
    return out.withColumns({name: upto(c, "_slice") + F.col(f"_{name}") for name, c in sums.items()}).drop("_slice", *[f"_{name}" for name in sums])
