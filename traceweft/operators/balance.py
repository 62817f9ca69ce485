"""Class balance: analysis, weights, resampling targets and synthetic minority rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from traceweft.operators.sampling import by_label, resample

#: About so many rows are in a block of SMOTE's search; every block of rows to start from meets every block of the class.
BLOCK_ROWS = 4096
#: Where fewer rows start, blocks of the class grow by so much at most; the pairs of a task don't.
WIDER = 16


def _nearest(features: list[str], k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("b")  # equal distances go to the lesser id
        columns = lambda t, side: [t.column(f"{side}_{c}").to_numpy().astype(float) for c in features]
        xs, ys = columns(left, "a"), columns(right, "b")
        ids, others, rows, cols, far = left.column("a").to_pylist(), right.column("b").to_pylist(), [], [], []
        if not ids or not others:
            return pa.Table.from_arrays([*left.drop_columns("i").drop_columns("j").slice(0, 0).columns, *right.drop_columns("i").drop_columns("j").slice(0, 0).columns, pa.array([], pa.float64())], names=[*[c for c in left.column_names if c not in "ij"], *[c for c in right.column_names if c not in "ij"], "far"])
        most = max(Counter(others).values())  # rows that share an id are no neighbours
        step = max(1, (1 << 20) // len(others))
        for lo in range(0, len(ids), step):
            d = np.zeros((len(ids[lo : lo + step]), len(others)))
            for x, y in zip(xs, ys):
                d += (x[lo : lo + step, None] - y) ** 2
            last = min(k + most, len(others)) - 1
            bound = np.partition(d, last, axis=1)[:, last]
            for i in range(len(d)):
                near = np.flatnonzero(~(d[i] > bound[i]))  # with all that are as far as the last
                near = near[np.argsort(d[i, near], kind="stable")]
                found = [j for j in near if others[j] != ids[lo + i]][:k]
                rows += [lo + i] * len(found)
                cols += found
                far += d[i, found].tolist()
        return pa.Table.from_arrays([*left.take(pa.array(rows, pa.int64())).drop_columns("i").drop_columns("j").columns, *right.take(pa.array(cols, pa.int64())).drop_columns("i").drop_columns("j").columns, pa.array(far, pa.float64())], names=[*[c for c in left.column_names if c not in "ij"], *[c for c in right.column_names if c not in "ij"], "far"])

    return run


def severity(ratio):
    return F.when(ratio < 3, "balanced").when(ratio < 10, "mild").when(ratio < 100, "moderate").when(ratio < 1000, "severe").otherwise("extreme")


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class, ratio of largest to smallest, severity."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    m = c.agg((F.max("n") / F.min("n")).alias("ratio"), F.sum("n").alias("total"))
    return c.join(F.broadcast(m)).select(label, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), "ratio", severity(F.col("ratio")).alias("severity"))


def recommend(counts: dict) -> str:
    """Method that suits the class counts."""
    ratio, least = max(counts.values()) / min(counts.values()), min(counts.values())
    if ratio < 3:
        return "none"
    if least < 6:
        return "class_weights"
    return "smote" if ratio < 100 and least >= 50 else "adaptive_oversampling" if ratio < 1000 else "stratified_undersampling"


def reduction_targets(counts: dict) -> dict:
    """Majority to min(100 times the smallest, 50000), classes between to 5 times the smallest."""
    least, most = min(counts.values()), max(counts.values())
    return {k: n if n == least else min(n, 100 * least, 50_000) if n == most else min(n, 5 * least) for k, n in counts.items()}


def oversampling_targets(counts: dict) -> dict:
    """Each smaller class grows to a share of the largest that falls with its ratio, but never over tenfold."""
    most = max(counts.values())
    share = lambda r: 0.5 if r < 10 else 0.2 if r < 100 else 0.1
    return {k: max(n, min(int(most * share(most / n)), 10 * n)) for k, n in counts.items()}


def undersampling_targets(counts: dict, times: float | None = None) -> dict:
    """All classes at most ``times`` the smallest, by default min(20, sqrt(ratio))."""
    least, most = min(counts.values()), max(counts.values())
    times = min(20.0, math.sqrt(most / least)) if times is None else times
    return {k: min(n, int(times * least)) for k, n in counts.items()}


def oversample(df: DataFrame, label: str, row_id: str, numeric: list[str], targets: dict, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """Copies beyond the rows themselves get multiplicative noise that depends on row and copy alone."""
    out = resample(df, label, row_id, targets, str(seed))
    u = lambda c, k: (F.pmod(F.xxhash64(row_id, "copy", F.lit(c), F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda c: F.sqrt(-2 * F.log(u(c, 0))) * F.cos(2 * math.pi * u(c, 1))
    return out.withColumns({c: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.col(c) * (1 + noise * normal(c))) for c in numeric})


def class_weights(df: DataFrame, label: str, boosts: dict | None = None, cap: float | None = None, out: str = "weight") -> DataFrame:
    """Weight n / (k n_c) of each row's class, times a boost, up to a cap."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    m = c.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = F.col("_t") / (F.col("_k") * F.col("_n"))
    w = w * by_label(label, boosts, 1.0) if boosts else w
    w = F.least(w, F.lit(cap)) if cap is not None else w
    return df.join(F.broadcast(c.join(F.broadcast(m)).select(label, w.alias(out))), label)


def before_after(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    n = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias(name))
    j = n(a, "n_before").join(n(b, "n_after"), label, "full")
    return j.select(label, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def _least(rows: DataFrame, order, by: str, most: int) -> DataFrame:
    """The rows of the ``most`` least hashes, equal ones by a column, with _place; rows equal in both stay together, some of them beyond ``most``.

    Rows are cut by the first bits of the hash, whose counts tell the parts that are needed; no task sorts them all.
    """
    cut = rows.withColumn("_h", order).withColumn("_part", F.shiftright("_h", 52))
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("_part", before.alias("_before")).where(F.col("_before") < most)  # 4,096 rows at most
    w = Window.partitionBy("_part").orderBy("_h", by)
    placed = cut.join(F.broadcast(parts), "_part").withColumn("_place", F.row_number().over(w) + F.col("_before")).withColumn("_first", F.rank().over(w) + F.col("_before"))
    return placed.where(F.col("_first") <= most).drop("_h", "_part", "_before", "_first")


def smote(minority: DataFrame, row_id: str, features: list[str], new_rows: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows between a row of the minority and one of its k nearest.

    Rows start in the order of a hash, all of them once before any starts again. Neighbours are exact within the
    whole class and looked for only from rows that start: hashed blocks of those meet blocks of the class, keep k a
    row and are merged. The work grows with the starting rows times the class, the memory of a task does not.
    """
    n = minority.count()
    k = min(5 if k is None else k, n - 1)
    if k < 1:
        raise ValueError("a class needs two rows to be interpolated")
    a = minority.select(F.col(row_id).alias("a"), *[F.col(c).cast("double").alias(f"a_{c}") for c in features])
    b = minority.select(F.col(row_id).alias("b"), *[F.col(c).cast("double").alias(f"b_{c}") for c in features])
    full, last = divmod(new_rows, n)  # so often all rows start, then so many once more
    once = _least(a, F.xxhash64("a", F.lit(seed)), "a", last)
    base = once.where(F.col("_place") <= last).select("a", F.lit(full).alias("copy"))
    if full:
        base = base.unionByName(a.select("a", F.explode(F.sequence(F.lit(0), F.lit(full - 1))).alias("copy")))
    start, starts = (a, n) if full else (once.drop("_place"), last)
    rows, others = max(1, math.ceil(starts / BLOCK_ROWS)), math.ceil(n / BLOCK_ROWS / min(WIDER, max(1, BLOCK_ROWS / max(1, starts))))
    block, every = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left, right = start.withColumn("i", block("a", rows)).withColumn("j", every(others)), b.withColumn("j", block("b", others)).withColumn("i", every(rows))
    kept = StructType([*a.schema.fields, *b.schema.fields, StructField("far", DoubleType())])
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_nearest(features, k), kept)
    near = met.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))).where(F.col("_r") <= k)
    pick = base.withColumn("_r", (F.pmod(F.xxhash64("a", "copy", F.lit(seed)), F.lit(k)) + 1).cast("int"))
    u = (F.pmod(F.xxhash64("copy", "a", F.lit(seed + 1)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return pick.join(near, ["a", "_r"]).withColumn("u", u).select(F.col("a").alias("base"), F.col("b").alias("neighbour"), "copy", "u", *[(F.col(f"a_{c}") + F.col("u") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in features])
