"""Composed plans: the three-stage exclusion, the configured pipeline and the exploratory report.

Nothing asks questions; every choice is an entry of the configuration.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceweft.operators import aggregates, associate, columns, dedup, encode, joins, ordered, profile, sampling, stats
from traceweft.operators.balance import class_weights, undersampling_targets
from traceweft.sources import readers, writers


@dataclass
class Run:
    """History of a run: a row for each step with its seconds."""

    steps: list[dict] = field(default_factory=list)
    folder: str | None = None

    @contextmanager
    def step(self, spark: SparkSession, name: str):
        """Times a step and tags its jobs, so that they can be cancelled together by that tag."""
        began = time.time()
        spark.sparkContext.addJobTag(name)  # the session's own tags make its models unserialisable
        try:
            yield
            state = "done"
        except BaseException:
            state = "failed"
            raise
        finally:
            spark.sparkContext.removeJobTag(name)
            self.steps.append({"step": name, "seconds": time.time() - began, "state": state})
            if self.folder:
                writers.write_report(spark, f"{self.folder}/run.json", {"steps": self.steps})


def exclusion(df: DataFrame, key: str, state: str, states: list, candidate, watched) -> dict[str, DataFrame]:
    """Candidates (keys with the candidate state), their summary, and the rows without keys of outlying counts, in one lazy plan."""
    candidates = df.where(F.col(state) == candidate).select(key).distinct()
    summary = aggregates.crosstab(df.join(candidates, key, "left_semi"), key, state, states)
    outliers = aggregates.upper_outliers(summary, f"state_{watched}")
    return {"candidates": candidates, "summary": summary, "outliers": outliers, "kept": df.join(outliers.select(key), key, "left_anti")}


def merged(bookings: DataFrame, materials: DataFrame, on: list[str], left_ts: str, right_ts: str, label: str, row_id: str, per_label: int, days: int = 70, seconds: int = 5, seed="") -> DataFrame:
    """Both sides from their common start for so many days, a sample of every label, and what was mounted within seconds of it."""
    bound = bookings.agg(F.min(left_ts).alias("a")).join(materials.agg(F.min(right_ts).alias("b"))).select(F.greatest("a", "b").alias("start"))
    upto = F.col("start") + F.expr(f"interval {days} days")
    a = bookings.join(F.broadcast(bound)).where(F.col(left_ts).between(F.col("start"), upto)).drop("start")
    b = materials.join(F.broadcast(bound)).where(F.col(right_ts).between(F.col("start"), upto)).drop("start")
    a = sampling.per_class(a.join(b.select(*on).distinct(), on, "left_semi"), label, row_id, per_label, seed)
    b = columns.suffixed(b.join(a.select(*on).distinct(), on, "left_semi"), on, "_m")
    right = b.select(*[F.col(k).alias(f"{k}_m") for k in on], *[c for c in b.columns if c not in on])
    condition = F.abs(F.unix_timestamp(F.col(left_ts).cast("timestamp")) - F.unix_timestamp(F.col(f"{right_ts}_m").cast("timestamp"))) <= seconds
    for k in on:
        condition = (F.col(k) == F.col(f"{k}_m")) & condition
    return a.join(right, condition, "left").orderBy(left_ts, row_id)


Step = Callable[[DataFrame, dict], DataFrame]

STEPS: dict[str, Step] = {
    "keep_columns": lambda df, c: columns.keep_containing(df, c["bases"]),
    "clean_names": lambda df, c: columns.with_clean_names(df, c.get("strategy", "standard")),
    "drop": lambda df, c: columns.drop_if_exists(df, *c["columns"]),
    "filter": lambda df, c: df.where(c["where"]),
    "latest": lambda df, c: dedup.keep_latest(df, c["key"], c["ts"], c["ties"]),
    "day_group": lambda df, c: sampling.day_groups(df, c["ts"], c["days"]).where(F.col("day_group") == c.get("group", 0)).drop("day", "day_group"),
    "balance_keys": lambda df, c: sampling.balance_by_key(df, c["key"], c["state"], c["marked"], c["zero"], c.get("ratio", 5)),
    "binary_target": lambda df, c: df.withColumn(c["out"], columns.binary_target(F.col(c["column"]), c.get("positive", (1, 2)))),
    "treat_missing": lambda df, c: encode.treat_missing(df, c["column"], c["method"]),
    "ordinal": lambda df, c: encode.ordinal(df, c["column"]),
    "target": lambda df, c: encode.smoothed_target(df, c["column"], c["target"], c.get("m", 100), c.get("least", 10)),
    "standard": lambda df, c: encode.standard_scaled(df, c["column"]),
    "robust": lambda df, c: encode.robust_scaled(df, c["column"]),
    "drop_correlated": lambda df, c: df.drop(*associate.correlated_drops(stats.correlation_pairs(df, c["columns"]), c["columns"], c.get("threshold", 0.95))),
    "undersample": lambda df, c: sampling.resample(df, c["label"], c["row_id"], undersampling_targets(sampling.class_counts(df, c["label"]), c.get("times"))).drop("copy"),
    "class_weights": lambda df, c: class_weights(df, c["label"]),
    "time_split": lambda df, c: sampling.class_time_split(df, c["label"], c["ts"], c.get("ratio", 0.1)),
    "random_split": lambda df, c: sampling.class_random_split(df, c["label"], c["row_id"], c.get("ratio", 0.2)),
    "lookup": lambda df, c: joins.lookup(df, c["dim"], c["key"], c["value"], c.get("default")),
}


def run_steps(df: DataFrame, steps: list[dict], run: Run | None = None) -> DataFrame:
    """Applies configured steps, each {"step": name, ...}; an unknown name or a failing step raises."""
    run = run or Run()
    for c in steps:
        with run.step(df.sparkSession, c["step"]):
            df = STEPS[c["step"]](df, c)
    return df


def run_file(spark: SparkSession, path: str, steps: list[dict], out: str | None = None, run: Run | None = None) -> DataFrame:
    df = run_steps(readers.read(spark, path), steps, run)
    if out:
        writers.save(df, out, "dataset", {"steps": [c["step"] for c in steps]})
    return df


def explore(df: DataFrame, numeric: list[str], ts: str | None = None) -> dict[str, DataFrame]:
    """Tables of an exploratory report."""
    prof = profile.profile(df)
    out = {"profile": prof, "nulls": profile.null_counts(df), "bands": profile.bands(prof), "moments": stats.moments(df, numeric), "correlations": stats.correlation_pairs(df, numeric), "missing_patterns": stats.missing_patterns(df)}
    if ts:
        out["business_hours"] = ordered.business_hours(df, ts)
    return out


def counts_add_up(df: DataFrame, counted: DataFrame, column: str = "n") -> bool:
    """Whether a table of counts covers every row."""
    return counted.agg(F.sum(column)).first()[0] == df.count()


def estimated_seconds(n_rows: int, n_columns: int) -> dict[str, int]:
    """Rough seconds of the usual steps by the size of a table; a guess for progress bars, not a plan."""
    return {
        "correlation_analysis": max(1, n_columns**2 // 1000), "feature_importance": max(5, n_rows * n_columns // 100_000),
        "encoding_operations": max(2, n_columns // 10), "balancing_operations": max(3, n_rows // 50_000),
    }
