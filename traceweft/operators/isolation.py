"""Isolation forest of one column: trees of random cuts over samples of 256 values; odd values are cut off early.

The samples are the method's own bound. The path length of a value depends on the values between which it falls,
so each tree is a short list of cuts with the depth of every gap, and the forest a table of steps that rows look up.
"""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 256


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(values: list[float], depth: int, most: int, rng: random.Random, cuts: list[float], depths: list[float]) -> None:
    """Appends the cuts of a subtree from left to right, and the path length of the gap before each and after the last."""
    if depth >= most or len(values) < 2 or values[0] == values[-1]:
        depths.append(depth + _expected(len(values)))
        return
    cut = rng.uniform(values[0], values[-1])
    at = bisect.bisect_left(values, cut)
    _grow(values[:at], depth + 1, most, rng, cuts, depths)
    cuts.append(cut)
    _grow(values[at:], depth + 1, most, rng, cuts, depths)


def forest(sample: list[float], trees: int = 100, seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree its cuts and the path length of every gap between them."""
    rng, out = random.Random(seed), []
    for _ in range(trees if sample else 0):
        values = sorted(rng.sample(sample, min(SAMPLE, len(sample))))
        cuts: list[float] = []
        depths: list[float] = []
        _grow(values, 0, math.ceil(math.log2(max(2, len(values)))), rng, cuts, depths)
        out.append((np.array(cuts), np.array(depths)))
    return out


def isolation_scores(df: DataFrame, column: str, trees: int = 100, sample_rows: int = 25_600, seed: int = 42) -> DataFrame:
    """Adds isolation: 2 ** -(mean path length / its expectation), over 0.5 for odd values; null for null.

    Each tree draws 256 of about ``sample_rows`` rows, which go by a hash of the value.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = known.count()
    part = known.sample(min(1.0, sample_rows / max(1, n)), seed) if n > sample_rows else known
    sample = sorted(r.x for r in part.limit(2 * sample_rows).collect())
    grown, usual = forest(sample, trees, seed), _expected(min(SAMPLE, len(sample))) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        v, total = x.to_numpy(dtype=float), np.zeros(len(x))
        for cuts, depths in grown:
            total += depths[np.searchsorted(cuts, v, side="right")]
        return pd.Series(np.where(np.isnan(v), np.nan, 2.0 ** -(total / max(1, len(grown)) / usual))).where(~x.isna().to_numpy(), None)

    return df.withColumn("isolation", F.nanvl(score(F.col(column).cast("double")), F.lit(None).cast("double")))
