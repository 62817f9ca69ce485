"""Projections, column operations and casts. Casts never throw: what does not parse becomes null."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Texts read as true and as false.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
#: Texts that stand for a missing value.
BLANKS = ("", " ", "null")


def keep_containing(df: DataFrame, bases: Iterable[str]) -> DataFrame:
    """Columns whose name contains any of the base names."""
    bases = list(bases)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if any(b in c for b in bases)])


def drop_if_exists(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def suffixed(df: DataFrame, keys: Iterable[str], suffix: str) -> DataFrame:
    """All columns but the keys get the suffix."""
    keys = set(keys)
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(c + suffix) for c in df.columns])


def clean_names(names: Iterable[str], strategy: str = "standard") -> list[str]:
    """Names by strategy: standard (lower, underscores), snake (also splits camel case), camel, minimal (trim only); repeats get _1, _2, ..."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for name in names:
        x = str(name).strip()
        if strategy == "snake":
            x = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", x)
        if strategy in ("standard", "snake"):
            x = re.sub(r"_+", "_", re.sub(r"\W+", "_", x.lower())).strip("_")
        elif strategy == "camel":
            head, *rest = [w for w in re.split(r"[\W_]+", x) if w] or [""]
            x = head.lower() + "".join(w[:1].upper() + w[1:].lower() for w in rest)
        elif strategy != "minimal":
            raise ValueError(f"unknown strategy {strategy}")
        n = seen.get(x, 0)
        seen[x] = n + 1
        out.append(f"{x}_{n}" if n else x)
    return out


def with_clean_names(df: DataFrame, strategy: str = "standard") -> DataFrame:
    return df.toDF(*clean_names(df.columns, strategy))


def column_or(df: DataFrame, name: str, default=None) -> Column:
    """The column, met without regard to case, or the default."""
    found = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
    return F.col(f"`{found[0]}`") if found else F.lit(default)


def to_utc(c: Column) -> Column:
    """ISO 8601 text as a timestamp; the session's time zone should be UTC."""
    return F.try_to_timestamp(c)


def to_flag(c: Column) -> Column:
    """1 for true, 1, yes, y in any case, else 0, nulls and unknown words included."""
    return F.when(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), 1).otherwise(0).cast("tinyint")


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def blank_to_null(c: Column) -> Column:
    return F.when(c.isin(*BLANKS), None).otherwise(c)


def fill_sentinels(df: DataFrame, text: str = "unlabeled", number: float = -999) -> DataFrame:
    """Nulls of text columns become one sentinel, those of numeric columns the other."""
    fills = {f.name: text if isinstance(f.dataType, T.StringType) else number for f in df.schema if isinstance(f.dataType, (T.StringType, T.NumericType))}
    return df.na.fill(fills)


def flags_to_text(df: DataFrame) -> DataFrame:
    """Boolean columns as the words True and False."""
    text = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False")
    return df.withColumns({f.name: text(f.name) for f in df.schema if isinstance(f.dataType, T.BooleanType)})


def downcast(df: DataFrame) -> DataFrame:
    """Integer columns in the narrowest type that holds all their values; one pass finds the ranges."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    if not whole:
        return df
    ends = df.agg(*[g(c).alias(f"{k}_{c}") for c in whole for k, g in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in whole:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if lo is not None and -(1 << bits) <= lo and hi < (1 << bits):
                out[c] = F.col(c).cast(kind)
                break
    return df.withColumns(out) if out else df


def binary_target(c: Column, positive: Iterable = (1, 2)) -> Column:
    return F.when(c.isin(*positive), 1).otherwise(0)


def dense_codes(df: DataFrame, c: str, out: str) -> DataFrame:
    """Codes 0..k-1 of the distinct values in order, -1 for null; the few values meet the rows in a join."""
    values = df.where(F.col(c).isNotNull()).select(c).distinct()
    codes = values.select(F.col(c), (F.row_number().over(Window.orderBy(c)) - 1).alias(out))
    return df.join(codes, c, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def equal_width_bins(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of right-closed intervals; the lowest value falls in bin 0."""
    width = (high - low) / bins
    return F.greatest(F.least(F.ceil((c - low) / F.nullif(width, F.lit(0.0))) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def text_megabytes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    total = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0))
    return df.agg((F.sum(total) / 1e6).alias("megabytes"))


def drop_null_columns(df: DataFrame, how: str = "all") -> DataFrame:
    """Without columns that are null in all rows, or in any row; one pass counts them."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if (counts[f"c{i}"] > 0 if how == "all" else counts[f"c{i}"] == counts["n"])]
    return df.select(*keep)


def target_first(df: DataFrame, target: str) -> DataFrame:
    return df.select(target, *sorted(c for c in df.columns if c != target))


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = [c for c in a.columns if c in set(b.columns)]
    return a.select(*both), b.select(*both)


def set_flags(columns: Iterable[str]) -> Column:
    """How many of the flag columns are set in a row."""
    return sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns), F.lit(0))
