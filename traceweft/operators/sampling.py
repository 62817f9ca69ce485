"""Reproducible sampling and splits. Choice goes by a hash of the key, so it is the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(c: Column, seed: int | str = "") -> Column:
    """Sort key of a reproducible shuffle: the md5 of the value as text, with a seed."""
    return F.md5(F.concat(F.lit(str(seed)), c.cast("string")))


def sample_keys(df: DataFrame, key: str, n: int, seed="", strict: bool = True) -> DataFrame:
    """n distinct keys; raises if there are fewer and ``strict``."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    if strict and keys.limit(n).count() < n:
        raise ValueError(f"fewer than {n} keys")
    return keys.orderBy(hash_order(F.col(key), seed), key).limit(n)


def at_most_keys(df: DataFrame, key: str, n: int, seed="") -> DataFrame:
    return df.join(sample_keys(df, key, n, seed, strict=False), key, "left_semi")


def hash_ranked(df: DataFrame, label: str, row_id: str, seed="") -> DataFrame:
    """Adds _rn, the rank of a row in the hash order of its class, and _n, the class's rows.

    Classes are cut by the first four digits of the hash, whose counts give the ranks that lie before each part;
    so no task sorts a whole class.
    """
    part = df.withColumn("_h", hash_order(F.col(row_id), seed)).withColumn("_part", F.substring("_h", 1, 4))
    counts = part.groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(label)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(label).alias("_l"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_c").over(whole).alias("_n"))
    ranked = part.withColumn("_rn", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", row_id)))
    met = ranked.join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("_rn", F.col("_rn") + F.col("_before")).drop("_h", "_part", "_l", "_p", "_before")


def per_class(df: DataFrame, label: str, row_id: str, quota: Column | int, seed="") -> DataFrame:
    """Up to ``quota`` rows of each class, in hash order; a quota may depend on the label."""
    return hash_ranked(df, label, row_id, seed).where(F.col("_rn") <= quota).drop("_rn", "_n")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows of each class; classes are few by nature."""
    return {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect() if r[0] is not None}


def by_label(label: str, values: dict, default=0) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(label) == F.lit(k), F.lit(v)).otherwise(out)
    return out


def resample(df: DataFrame, label: str, row_id: str, targets: dict, seed="", copy: str = "copy") -> DataFrame:
    """Exactly the target rows of each class: fewer by hash rank, more by whole copies and the rest by rank.

    Copies are told apart by ``copy`` (0: the row itself).
    """
    counts = class_counts(df, label)
    n, t = by_label(label, counts, 1), by_label(label, targets, 0)
    times = F.floor(t / n).cast("int") + F.when(F.col("_rn") <= t % n, 1).otherwise(0)
    out = hash_ranked(df.where(F.col(label).isin(list(targets))), label, row_id, seed).withColumn("_times", times).where("_times > 0")
    return out.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_rn", "_n", "_times")


def minority_preserving_targets(counts: dict, budget: int = 150_000, whole: int = 5_000, minorities: list | None = None) -> dict:
    """Classes of up to ``whole`` rows stay whole, the others share what is left of the budget by size.

    Where ``minorities`` are named, those stay whole instead, whatever their sizes, even beyond the budget.
    """
    small = {k: n for k, n in counts.items() if (n <= whole if minorities is None else k in minorities)}
    large = {k: n for k, n in counts.items() if k not in small}
    left, total = max(0, budget - sum(small.values())), sum(large.values())
    return small | {k: min(n, int(left * n / total)) for k, n in large.items()}


def ratio_targets(counts: dict, ratios: dict, size: int, least: int = 10) -> dict:
    """Given percentages of a sample's size, at least ten rows each."""
    return {k: max(least, int(size * ratios.get(k, 0) / 100)) for k in counts}


def minority_boost_targets(counts: dict, size: int) -> dict:
    """Minorities get max(2000, size / 3k) rows each, the majority max(size - those, twice those)."""
    major = max(counts, key=lambda k: (counts[k], str(k)))
    each = max(2000, size // (3 * len(counts)))
    minor = each * (len(counts) - 1)
    return {k: each for k in counts if k != major} | {major: max(size - minor, 2 * minor)}


def balanced_targets(counts: dict, size: int) -> dict:
    return {k: size // len(counts) for k in counts}


def proportional_targets(counts: dict, size: int) -> dict:
    """By share of all rows, but at least min(100, count) and at most 0.8 of the size."""
    total = sum(counts.values())
    return {k: int(min(max(size * n / total, min(100, n)), 0.8 * size, n)) for k, n in counts.items()}


def recommend_sampling(ratio: float) -> str:
    return "minority_boost" if ratio > 1000 else "balanced" if ratio > 100 else "proportional"


def balance_by_key(df: DataFrame, key: str, state: str, marked: list, zero, ratio: float = 5, seed="") -> DataFrame:
    """All rows of keys with a marked state, and of ratio times as many keys that only have the zero state."""
    from traceweft.operators.aggregates import key_classes

    classes = key_classes(df, key, state, marked, zero)
    n = classes.agg(F.count_if("marked").alias("m"))
    ranked = hash_ranked(classes.where("marked or zero_only"), "marked", key, seed).join(F.broadcast(n))
    keep = ranked.where(F.col("marked") | (F.col("_rn") <= F.floor(F.col("m") * ratio))).select(key)
    return df.join(keep, key, "left_semi")


def diverse_sample(df: DataFrame, columns: list[str], per_column: int = 1000) -> DataFrame:
    """First distinct values of each column in order, side by side by their rank."""
    out = None
    for c in columns:
        values = df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(per_column)
        one = values.select(F.row_number().over(Window.orderBy(c)).alias("place"), c)
        out = one if out is None else out.join(one, "place", "full")
    return out


def class_time_split(df: DataFrame, label: str, ts: str, ratio: float = 0.1) -> DataFrame:
    """Adds split: per class, rows from the time at rank n - int(n * ratio) on are test, earlier ones train.

    Ties at the cutoff go to test, classes too small for a test row to train, rows without a time to neither.
    The cutoff comes from counts per (class, time), so no class is ever sorted in one task row by row.
    """
    times = df.where(F.col(ts).isNotNull()).groupBy(label, ts).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label)
    run = times.withColumn("upto", F.sum("n").over(w.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    place = F.col("all") - F.floor(F.col("all") * ratio)
    cut = run.where((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place) & (F.floor(F.col("all") * ratio) > 0)).select(label, F.col(ts).alias("cutoff"))
    out = df.join(cut, label, "left")
    return out.withColumn("split", F.when(F.col(ts).isNull(), None).when(F.col(ts) >= F.col("cutoff"), "test").otherwise("train"))


def split_report(split: DataFrame, label: str, ts: str) -> DataFrame:
    """Rows and time range of each side and class, with the class's cutoff."""
    return split.where("split is not null").groupBy("split", label).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("cutoff").alias("cutoff"))


def class_random_split(df: DataFrame, label: str, row_id: str, ratio: float, seed="") -> DataFrame:
    """Adds split: int(n * ratio) rows of each class by hash rank are test."""
    return hash_ranked(df, label, row_id, seed).withColumn("split", F.when(F.col("_rn") <= F.floor(F.col("_n") * ratio), "test").otherwise("train")).drop("_rn", "_n")


def day_groups(df: DataFrame, ts: str, n: int) -> DataFrame:
    """Adds day_group: sorted distinct days in chunks of n; days of an incomplete last chunk are left out."""
    days = df.select(F.to_date(ts).alias("day")).where("day is not null").distinct()
    numbered = days.withColumn("day_group", F.floor((F.row_number().over(Window.orderBy("day")) - 1) / n).cast("int"))
    whole = numbered.groupBy("day_group").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") == n).select("day_group")
    return df.withColumn("day", F.to_date(ts)).join(numbered.join(whole, "day_group"), "day")
