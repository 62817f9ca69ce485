"""Encoding, imputation and scaling. What is learned from data comes from an aggregate that may be taken from a training part alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from traceweft.operators.orderstats import quantiles


def strategy(numeric: bool, temporal: bool, n_distinct: int) -> str:
    """Encoding by type and number of values."""
    if temporal:
        return "datetime_parts"
    if n_distinct <= 2:
        return "binary"
    if numeric:
        return "standard_scaling" if n_distinct > 100 else "numeric_preserve"
    return "ordinal" if n_distinct <= 10 else "target_smoothed" if n_distinct <= 100 else "target_cv" if n_distinct <= 1000 else "catboost"


def target_means(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(target).alias("n"), F.sum(F.col(target).cast("double")).alias("s"))


def _global(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.avg(F.col(target).cast("double")).alias("g"))


def smoothed_target(df: DataFrame, column: str, target: str, m: float = 100, least: int = 10, train: DataFrame | None = None) -> DataFrame:
    """Adds <column>_enc: (sum + m * mean) / (n + m); values of fewer rows than ``least``, unseen and null get the mean."""
    src = df if train is None else train
    means, g = target_means(src.where(F.col(column).isNotNull()), column, target), _global(src, target)
    enc = means.join(F.broadcast(g)).select(column, F.when(F.col("n") >= least, (F.col("s") + m * F.col("g")) / (F.col("n") + m)).otherwise(F.col("g")).alias("_e"))
    return df.join(enc, column, "left").join(F.broadcast(g)).withColumn(f"{column}_enc", F.coalesce("_e", "g")).drop("_e", "g")


def noisy_target(df: DataFrame, column: str, target: str, row_id: str, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Smoothed mean with m = 1 and, if asked, noise of that share of the mean, fixed by row."""
    out = smoothed_target(df, column, target, m=1, least=0)
    if not noise:
        return out
    u = (F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30) - 0.5
    return out.withColumn(f"{column}_enc", F.col(f"{column}_enc") * (1 + noise * u * 3.4641016151377544))


def kfold_target(df: DataFrame, column: str, target: str, fold: Column, folds: int) -> DataFrame:
    """Adds <column>_enc: the mean of a value over all other folds; a value that is only in its own fold gets the mean of all rows."""
    x = df.withColumn("_f", fold)
    per = x.groupBy(column, "_f").agg(F.count(target).alias("nf"), F.sum(F.col(target).cast("double")).alias("sf"))
    w = Window.partitionBy(column)
    out = per.select(column, "_f", F.try_divide(F.sum("sf").over(w) - F.col("sf"), F.sum("nf").over(w) - F.col("nf")).alias("_e"))
    joined = x.join(out.withColumnRenamed(column, "_c"), F.col(column).eqNullSafe(F.col("_c")) & (x["_f"] == out["_f"]), "left").drop(out["_f"])
    return joined.join(F.broadcast(_global(df, target))).withColumn(f"{column}_enc", F.coalesce("_e", "g")).drop("_e", "g", "_c", "_f")


def folds_for(n: int) -> int:
    """Folds that a table of n rows gets; under two the smoothed form applies."""
    return min(5, n // 1000)


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_enc: place of the value among all in order as text, -1 for null."""
    v = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = v.select(column, (F.row_number().over(Window.orderBy(F.col(column).cast("string"))) - 1).alias("_e"))
    return df.join(codes, column, "left").withColumn(f"{column}_enc", F.coalesce("_e", F.lit(-1))).drop("_e")


def binary_codes(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_enc: 0 for the least value, 1 for others, null stays."""
    low = df.agg(F.min(column).alias("_m"))
    return df.join(F.broadcast(low)).withColumn(f"{column}_enc", F.when(F.col(column).isNotNull(), (F.col(column) != F.col("_m")).cast("int"))).drop("_m")


def standard_scaled(df: DataFrame, column: str, population: bool = False) -> DataFrame:
    """Adds <column>_enc: (x - mean) / deviation, or only centred where the deviation vanishes; nulls count as the mean."""
    x = F.col(column).cast("double")
    a = df.agg(F.avg(x).alias("_m"), (F.stddev_pop if population else F.stddev_samp)(x).alias("_s"))
    z = F.coalesce(x, F.col("_m")) - F.col("_m")
    return df.join(F.broadcast(a)).withColumn(f"{column}_enc", F.when(F.col("_s") > 1e-10, z / F.col("_s")).otherwise(z)).drop("_m", "_s")


def robust_scaled(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_enc: (x - median) / IQR, or only centred where the IQR vanishes; nulls count as the median."""
    a = quantiles(df, {"_q": F.col(column)}, [0.25, 0.5, 0.75])
    iqr = F.col("_q")[2] - F.col("_q")[0]
    z = F.coalesce(F.col(column).cast("double"), F.col("_q")[1]) - F.col("_q")[1]
    return df.join(F.broadcast(a)).withColumn(f"{column}_enc", F.when(iqr > 1e-10, z / iqr).otherwise(z)).drop("_q")


def numeric_preserved(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("string").try_cast("double")
    return df.join(F.broadcast(quantiles(df, {"_m": x}, [0.5]))).withColumn(f"{column}_enc", F.coalesce(x, F.col("_m")[0])).drop("_m")


def missing_treatment(n_null: Column, null_pct: Column, numeric: Column) -> Column:
    """Treatment by number and share of nulls."""
    return (
        F.when(n_null == 0, "none").when(null_pct > 95, "drop_feature")
        .when((n_null > 1_000_000) | (null_pct > 50), F.when(numeric, "flag_and_median").otherwise("special_category"))
        .when((n_null > 100_000) | (null_pct > 20), F.when(numeric, "median").otherwise("special_category"))
        .when(n_null > 10_000, F.when(numeric, "median").otherwise("mode")).otherwise(F.when(numeric, "median").otherwise("mode"))
    )


def treat_missing(df: DataFrame, column: str, method: str, order: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Applies one treatment: none, median, mode, flag_and_median, special_category, ffill, drop_feature. An unknown one raises."""
    c = F.col(column)
    if method == "none":
        return df
    if method == "drop_feature":
        return df.drop(column)
    if method == "special_category":
        return df.withColumn(column, F.coalesce(c.cast("string"), F.lit("MISSING")))
    if method == "ffill":
        w = Window.partitionBy(*([key] if key else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(w))
    if method in ("median", "flag_and_median", "mode"):
        fill = df.agg(F.mode(column, True).alias("_v")) if method == "mode" else quantiles(df, {"_v": c}, [0.5]).select(F.col("_v")[0].alias("_v"))
        out = df.withColumn(f"{column}_missing", c.isNull().cast("int")) if method == "flag_and_median" else df
        return out.join(F.broadcast(fill)).withColumn(column, F.coalesce(c, F.col("_v"))).drop("_v")
    raise ValueError(f"unknown treatment {method}")


def preserves_values(df: DataFrame, column: str, encoded: str) -> DataFrame:
    """Whether an encoding kept all values apart."""
    return df.agg(F.count_distinct(column).alias("before"), F.count_distinct(F.when(F.col(column).isNotNull(), F.col(encoded))).alias("after")).withColumn("preserved", F.col("before") == F.col("after"))


def hashed_ngrams(c: Column, dims: int = 30) -> Column:
    """Min-hash encoding of a text: for each of ``dims`` hashes the least over its 3-grams, scaled to 0..1; null for null."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))
    one = lambda k: F.array_min(F.transform(grams, lambda g: F.pmod(F.xxhash64(g, F.lit(k)), F.lit(1 << 30)))) / float(1 << 30)
    return F.when(c.isNotNull(), F.array(*[one(k) for k in range(dims)]))


def vectorised(df: DataFrame, columns: list[str], n_distinct: dict[str, int], threshold: int = 100) -> DataFrame:
    """Low-cardinality texts by ordinal, others by min-hash, numbers as they are."""
    for c in columns:
        if isinstance(df.schema[c].dataType, T.NumericType):
            df = df.withColumn(f"{c}_enc", F.col(c).cast("double"))
        elif n_distinct[c] < threshold:
            df = ordinal(df, c)
        else:
            df = df.withColumn(f"{c}_enc", hashed_ngrams(F.col(c)))
    return df


def finite(c: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(F.abs(c.cast("double")) < float("inf"), c)


def clipped(df: DataFrame, column: str) -> DataFrame:
    """Infinities to null, then clipped to the 0.5 and 99.5 percentiles widened by 1.5 times their distance, then the median for nulls."""
    x = F.when(F.abs(F.col(column).cast("double")) < float("inf"), F.col(column).cast("double"))
    a = quantiles(df, {"_q": x}, [0.005, 0.5, 0.995])
    wide = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    return df.join(F.broadcast(a)).withColumn(f"{column}_enc", F.greatest(F.least(F.coalesce(x, F.col("_q")[1]), F.col("_q")[2] + wide), F.col("_q")[0] - wide)).drop("_q")


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def cyclical(c: Column, period: int, name: str) -> list[Column]:
    a = 2 * F.pi() * c / period
    return [F.sin(a).alias(f"{name}_sin"), F.cos(a).alias(f"{name}_cos")]


def examples(df: DataFrame, column: str, encoded: str) -> DataFrame:
    """Values with their code: all of up to five, else the three commonest and two by hash."""
    c = df.groupBy(column, encoded).agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("_top", F.row_number().over(Window.orderBy(F.desc("n"), column))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    rest = F.row_number().over(Window.partitionBy(F.col("_top") <= 3).orderBy(F.md5(F.col(column).cast("string")), column))
    return r.withColumn("_rest", rest).where("_all <= 5 or _top <= 3 or _rest <= 2").select(column, encoded, "n")
