"""Profiling and data quality. One unpivoted aggregation profiles all columns; rules work on its small result."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from traceweft.operators.orderstats import quantiles, running

#: Parts of a name that hint at an identifier.
ID_WORDS = ("id", "key", "number", "serial", "uuid")
#: Columns that rules never propose to drop.
PROTECTED = ("book_state", "serial_number_id", "booking_id")


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) with every value as text."""
    columns = columns or df.columns
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, distinct values and their share, commonest value, its count, constancy.

    Values are counted per (column, value) once; nothing expands the rows by the number of columns with distinct sets.
    """
    counts = unpivoted(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    some = F.when(F.col("value").isNotNull(), F.col("n"))
    p = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), "value"))).alias("top"), F.coalesce(F.max(some), F.lit(0)).alias("top_n"),
    )
    filled = F.col("n_rows") - F.col("n_null")
    return p.select("*", (100.0 * F.col("n_null") / F.col("n_rows")).alias("null_pct"), F.coalesce(F.try_divide(F.col("n_distinct"), filled), F.lit(0.0)).alias("uniqueness"), (F.col("n_distinct") <= 1).alias("constant"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, in one pass without a shuffle of rows."""
    n = F.count(F.lit(1))
    wide = df.agg(*[(n - F.count(F.col(c))).alias(c) for c in df.columns], n.alias("__n"))
    return wide.unpivot(["__n"], df.columns, "column", "n_null").select("column", "n_null", (100.0 * F.col("n_null") / F.col("__n")).alias("null_pct"))


def categories(df: DataFrame, named: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Semantic category per column: by exact name, then binary-like (two values at most), then by type."""
    named = named or {}
    by_name = {c: k for k, cols in named.items() for c in cols}
    few = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in df.columns]).first()
    out = {}
    for f in df.schema:
        if f.name in by_name:
            out[f.name] = by_name[f.name]
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "temporal"
        elif isinstance(f.dataType, T.BooleanType) or few[f.name] <= 2:
            out[f.name] = "binary"
        else:
            out[f.name] = "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
    return out


def mixed_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of texts that read as numbers; mixed if some do and some do not."""
    u = unpivoted(df, columns).where("value is not null")
    share = F.avg(F.col("value").try_cast("double").isNotNull().cast("int"))
    return u.groupBy("column").agg(share.alias("numeric_share")).withColumn("mixed", (F.col("numeric_share") > 0) & (F.col("numeric_share") < 1))


def looks_like_id(name: Column, uniqueness: Column) -> Column:
    hit = F.lit(False)
    for w in ID_WORDS:
        hit = hit | F.lower(name).contains(w)
    return hit & (uniqueness > 0.95)


def issues(prof: DataFrame, smallest_class: int, top: int = 8) -> DataFrame:
    """Quality issues (issue, column) of a profile: constant, all null, too few values for the smallest class, very many values."""
    filled = F.col("n_rows") - F.col("n_null")
    many = prof.where((F.col("n_distinct") > 1000) & ~F.lower("column").contains("measur")).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n_distinct"), "column"))).where(F.col("_r") <= top)
    tag = lambda d, name: d.select(F.lit(name).alias("issue"), "column")
    return tag(prof.where("n_distinct <= 1"), "constant").unionByName(tag(prof.where(filled == 0), "all_null")).unionByName(tag(prof.where((filled < smallest_class) & (filled > 0)), "high_missing")).unionByName(tag(many, "high_cardinality"))


def similar_groups(prof: DataFrame, least: float = 0.7) -> list[list[str]]:
    """Groups of columns with equal cardinality and nulls and like names; works on the rows of a profile."""
    rows = sorted((r["n_distinct"], r["n_null"], r["column"]) for r in prof.select("n_distinct", "n_null", "column").collect())
    out: list[list[str]] = []
    for distinct, null, name in rows:
        for g in out:
            if g[0] == (distinct, null) and any(difflib.SequenceMatcher(None, name, x).ratio() >= least for x in g[1]):
                g[1].append(name)
                break
        else:
            out.append([(distinct, null), [name]])
    return [g[1] for g in out if len(g[1]) > 1]


def drop_candidates(found: list[tuple[str, str]], protected: tuple[str, ...] = PROTECTED) -> list[str]:
    """Columns of the issues, first mention first, without protected ones."""
    return list(dict.fromkeys(c for _, c in found if c not in protected))


def encoding_issues(df: DataFrame, prof: DataFrame) -> DataFrame:
    """(column, issue): numeric text, date-like text, mixed text, identifiers, constants, over 80 % missing."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    rules = [("constant", F.col("n_distinct") <= 1), ("mostly_missing", F.col("null_pct") > 80), ("identifier", looks_like_id(F.col("column"), F.col("uniqueness")))]
    out = None
    for name, rule in rules:
        one = prof.where(rule).select("column", F.lit(name).alias("issue"))
        out = one if out is None else out.unionByName(one)
    if text:
        u = unpivoted(df, text).where("value is not null")
        s = u.groupBy("column").agg(F.avg(F.col("value").try_cast("double").isNotNull().cast("int")).alias("num"), F.avg(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}").cast("int")).alias("date"))
        for name, rule in (("numeric_text", F.col("num") == 1), ("mixed", (F.col("num") > 0) & (F.col("num") < 1)), ("date_like", F.col("date") > 0.8)):
            out = out.unionByName(s.where(rule).select("column", F.lit(name).alias("issue")))
    return out


def validate(df: DataFrame, min_rows: int = 1, min_cols: int = 1, required: list[str] | None = None) -> list[str]:
    """What is wrong with a frame; empty if nothing."""
    out = [f"missing column {c}" for c in required or [] if c not in df.columns]
    if len(df.columns) < min_cols:
        out.append(f"{len(df.columns)} columns, {min_cols} needed")
    if df.limit(min_rows).count() < min_rows:
        out.append(f"fewer than {min_rows} rows")
    return out


def bands(prof: DataFrame) -> DataFrame:
    """Columns by band of cardinality and of missing share."""
    n = F.col("n_distinct")
    card = F.when(n <= 2, "binary").when(n <= 10, "low").when(n <= 100, "medium").when(n <= 1000, "high").otherwise("very_high")
    miss = F.when(F.col("null_pct") == 0, "none").when(F.col("null_pct") <= 5, "low").when(F.col("null_pct") <= 20, "medium").otherwise("high")
    return prof.groupBy(card.alias("cardinality"), miss.alias("missing")).agg(F.count(F.lit(1)).alias("n_columns"))


def quality_score(df: DataFrame, prof: DataFrame) -> DataFrame:
    """Completeness and duplicate percentages and their issue flags, in one row."""
    from traceweft.operators.dedup import duplicate_share

    full = prof.agg((100 * (1 - F.sum("n_null") / F.sum("n_rows"))).alias("completeness"), F.count_if(F.col("null_pct") > 20).alias("n_sparse"))
    dup = duplicate_share(df).select(F.col("pct").alias("duplicate_pct"))
    return full.join(F.broadcast(dup)).withColumn("many_duplicates", F.col("duplicate_pct") > 5)


def readiness(n_rows: int, null_pct: float, n_kinds: int, n_correlated: int) -> dict:
    """Score of 0 to 100 from size, missing values, diversity of columns and correlated pairs."""
    parts = {
        "size": 25 if n_rows >= 10_000 else 15 if n_rows >= 1_000 else 5,
        "missing": 25 if null_pct < 5 else 15 if null_pct < 20 else 5,
        "diversity": 25 if n_kinds >= 3 else 15 if n_kinds == 2 else 5,
        "independence": 25 if n_correlated == 0 else 15 if n_correlated < 5 else 5,
    }
    return parts | {"score": sum(parts.values())}


def feature_hints(skews: dict[str, float], pairs: list[tuple[str, str, float]], cardinality: dict[str, int]) -> list[str]:
    out = [f"{c}: transform, skewness {s:.1f}" for c, s in skews.items() if s is not None and abs(s) > 2]
    out += [f"{a}, {b}: correlated, {r:.2f}" for a, b, r in pairs]
    return out + [f"{c}: encode by target, {n} values" for c, n in cardinality.items() if n > 100]


def recommendations(score: dict, found: list[tuple[str, str]]) -> list[str]:
    out = [f"drop or repair {c}: {i}" for i, c in found]
    if score["missing"] < 25:
        out.append("treat missing values before encoding")
    if score["independence"] < 25:
        out.append("drop one of each correlated pair")
    return out or ["ready for encoding"]


def problematic(prof: DataFrame, fixed: list[str], protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Listed columns, over 98 % missing, or at most one value; protected ones never."""
    return prof.where((F.col("column").isin(fixed) | (F.col("null_pct") > 98) | (F.col("n_distinct") <= 1)) & ~F.col("column").isin(*protected)).select("column")


def harmonised(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Common columns; numbers without infinities or nulls, filled by the median of both; texts filled by MISSING; target first."""
    cols = [c for c in train.columns if c in set(test.columns)]
    numeric = [c for c in cols if isinstance(train.schema[c].dataType, T.NumericType) and c != target]
    texts = [c for c in cols if isinstance(train.schema[c].dataType, T.StringType) and c != target]
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    both = train.select(*[finite(c).alias(c) for c in numeric]).unionByName(test.select(*[finite(c).alias(c) for c in numeric]))
    medians = quantiles(both, {f"_{c}": F.col(c) for c in numeric}, [0.5]) if numeric else both.agg(F.lit(1).alias("_"))
    order = [c for c in [target, *sorted(x for x in cols if x != target)] if c in cols]
    fix = lambda df: df.join(F.broadcast(medians)).withColumns({c: F.coalesce(finite(c), F.col(f"_{c}")[0]) for c in numeric} | {c: F.coalesce(c, F.lit("MISSING")) for c in texts}).select(*order)
    return fix(train), fix(test)


def compare_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Missing share of the columns that both tables have, and the difference."""
    cols = [c for c in a.columns if c in set(b.columns)]
    x, y = null_counts(a.select(*cols)), null_counts(b.select(*cols))
    j = x.select("column", F.col("null_pct").alias("a_pct")).join(y.select("column", F.col("null_pct").alias("b_pct")), "column")
    return j.withColumn("difference", F.abs(F.col("a_pct") - F.col("b_pct")))


def row_similarity(columns: list[str], left: str, right: str) -> Column:
    """Share of columns in which two rows agree, nulls agreeing with nulls."""
    same = sum((F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")).cast("int") for c in columns), F.lit(0))
    return same / len(columns)


def ks_distance(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Largest gap between the distribution functions of a column in two tables, with both sizes."""
    both = a.select(F.col(c).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(c).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x is not null")
    steps = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = steps.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = running(steps, "x", {"ra": "a", "rb": "b"}).select("ra", "rb").join(F.broadcast(sizes))
    return run.groupBy("na", "nb").agg(F.max(F.abs(F.col("ra") / F.col("na") - F.col("rb") / F.col("nb"))).alias("ks"))


def chi2_homogeneity(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom of a column's values against the two tables."""
    from traceweft.operators.associate import chi2

    both = a.select(F.col(c).alias("x"), F.lit("a").alias("y")).unionByName(b.select(F.col(c).alias("x"), F.lit("b").alias("y")))
    return chi2(both, "x", "y")


def sensor_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """Healthy, Stuck (hardly any variance or values) or Monitor per numeric column."""
    u = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    s = u.groupBy("column").agg(F.var_samp("value").alias("variance"), (F.count_distinct("value") / F.count("value")).alias("unique_ratio"))
    return s.withColumn("health", F.when((F.col("variance") < 1e-6) | (F.col("unique_ratio") < 1e-4), "Stuck").when(F.col("unique_ratio") > 0.01, "Healthy").otherwise("Monitor"))


def columns_like(df: DataFrame, patterns: list[str]) -> list[str]:
    return [c for c in df.columns if any(p in c.lower() for p in patterns)]


def temporal_columns(df: DataFrame, sample: int = 10, least: int = 6) -> list[str]:
    """Time columns, and text columns of whose first values at least six of ten parse as a time."""
    out = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            head = df.select(F.col(f.name).alias("x")).where("x is not null").limit(sample)
            if head.select(F.count_if(F.try_to_timestamp("x").isNotNull()).alias("k")).first()["k"] >= least:
                out.append(f.name)
    return out
