"""Descriptive statistics, outliers, missingness and series. Sums and percentiles are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceweft.operators.orderstats import quantiles, running
from traceweft.operators.profile import unpivoted


def long_quantiles(df: DataFrame, of: dict[str, Column], points: list[float]) -> DataFrame:
    """(column, q): the array of exact quantiles of each, one small row a column."""
    q = quantiles(df, of, points)
    return q.unpivot([], q.columns, "column", "q")


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) of all non-null numbers."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "x").where("x is not null")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side is constant. Rows with a null on either side are left out."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, bias-corrected skewness and excess kurtosis, zeros, negatives, CV, quartiles, IQR."""
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    s = numbers(df, columns).groupBy("column").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
        F.count_if(F.col("x") == 0).alias("n_zero"), F.count_if(F.col("x") < 0).alias("n_negative"),
    )
    q = long_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    return s.join(F.broadcast(q), "column").select(
        "column", "n", "mean", "sd", "n_zero", "n_negative",
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        F.try_divide("sd", F.col("mean")).alias("cv"), F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )


def deviations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median absolute deviation per column, about exact medians."""
    m = quantiles(df, {f"_{c}": F.col(c) for c in columns}, [0.5])
    far = {c: F.abs(F.col(c).cast("double") - F.col(f"_{c}")[0]) for c in columns}
    return long_quantiles(df.select(*columns).join(F.broadcast(m)), far, [0.5]).select("column", F.col("q")[0].alias("mad"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Entropy in bits of each column's values, and the share of the commonest."""
    c = unpivoted(df, columns).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("column").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return c.join(F.broadcast(total), "column").groupBy("column").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.max(p).alias("concentration"))


def percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    q = quantiles(df, {"q": F.col(column)}, points)
    return q.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("p"), F.col("q"))).alias("z")).select(F.col("z.p").alias("p"), F.col("z.q").alias("value"))


def trimmed_mean(df: DataFrame, column: str, cut: float = 0.1) -> DataFrame:
    """Mean without the lowest and highest int(cut * n) values; from counts per value, so nothing is sorted row by row."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    run = running(c, "x", {"upto": "n"})
    total = c.agg(F.sum("n").alias("t")).withColumn("k", F.floor(F.col("t") * cut))
    w = F.greatest(F.least("upto", F.col("t") - F.col("k")) - F.greatest(F.col("upto") - F.col("n"), F.col("k")), F.lit(0))
    return run.join(F.broadcast(total)).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("trimmed_mean"))


def jarque_bera(df: DataFrame, columns: list[str]) -> DataFrame:
    s = numbers(df, columns).groupBy("column").agg(F.count("x").alias("n"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    return s.select("column", (F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)).alias("jb")).withColumn("normal", F.col("jb") < 5.991)


def distribution_hint(skewness: Column, kurtosis: Column) -> Column:
    """Family that skewness and excess kurtosis suggest."""
    return F.when((F.abs(skewness) < 0.5) & (F.abs(kurtosis) < 1), "normal").when(skewness > 2, "exponential_or_lognormal").when(skewness > 0.5, "gamma_or_weibull").when(skewness < -0.5, "beta_left_skewed").when(kurtosis < -1, "uniform").otherwise("student_t_or_laplace")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("z")).select("z.*")


def ranked(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Average ranks of each column. Ranks come from running counts per value and meet the rows by value."""
    out = df.select(row_id, *columns)
    for c in columns:
        v = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        v = running(v, c, {"_upto": "_n"})
        out = out.join(v.select(c, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(f"_r_{c}")), c, "left")
    return out.select(row_id, *[F.col(f"_r_{c}").alias(c) for c in columns])


def spearman_pairs(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    return correlation_pairs(ranked(df, columns, row_id), columns)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, exact for any number of values.

    Two ranks of x first differ at one bit; at each bit, those with equal higher bits meet in a group, and counts
    below each value of y score them. Groups add up in blocks of ranks, so that no task holds a whole column.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    place = lambda c: running(cells.select(c).distinct().withColumn("one", F.lit(1)), c, {"r": "one"}).select(c, (F.col("r") - 1).cast("int").alias(f"r{c}"))
    px, py = place("x"), place("y")
    bits = max((px.agg(F.max("rx")).first()[0] or 0).bit_length(), 1)
    placed = cells.join(px, "x").join(py, "y").withColumn("bit", F.explode(F.array(*[F.lit(b) for b in range(bits)])))
    group = ["bit", "g"]
    side = F.expr("shiftright(rx, bit) & 1")
    sums = placed.groupBy("bit", F.expr("shiftright(rx, bit + 1)").alias("g"), "ry").agg(F.sum(F.when(side == 0, F.col("n")).otherwise(0.0)).alias("l"), F.sum(F.when(side == 1, F.col("n")).otherwise(0.0)).alias("r"))
    sums = sums.withColumn("block", F.shiftright("ry", 12))
    whole = Window.partitionBy(*group)
    blocks = sums.groupBy(*group, "block").agg(F.sum("l").alias("bl"))
    blocks = blocks.select(*group, "block", F.sum("bl").over(whole).alias("all"), (F.sum("bl").over(whole.orderBy("block")) - F.col("bl")).alias("before"))
    under = F.sum("l").over(Window.partitionBy(*group, "block").orderBy("ry")) - F.col("l")
    pairs = sums.withColumn("under", under).join(blocks, [*group, "block"])
    score = pairs.agg(F.sum(F.col("r") * (2 * (F.col("before") + F.col("under")) + F.col("l") - F.col("all"))).alias("s"))
    ties = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg((F.sum("m") * (F.sum("m") - 1) / 2 - F.sum(F.col("m") * (F.col("m") - 1) / 2)).alias(f"free_{c}"))
    return score.join(ties("x")).join(ties("y")).select((F.coalesce("s", F.lit(0.0)) / F.nullif(F.sqrt(F.col("free_x") * F.col("free_y")), F.lit(0.0))).alias("tau"))


def stability(pearson: Column, spearman: Column) -> Column:
    """1 less the population deviation of two coefficients."""
    return 1 - F.abs(pearson - spearman) / 2


def relationship(pearson: Column, spearman: Column) -> Column:
    return F.when((F.abs(pearson) > 0.7) & (F.abs(spearman) > 0.7), "linear").when(F.abs(spearman) - F.abs(pearson) > 0.1, "monotonic").when(F.abs(pearson) - F.abs(spearman) > 0.1, "outlier_driven").otherwise("weak")


def outlier_flags(df: DataFrame, column: str, row_id: str, trees: int = 100) -> DataFrame:
    """Per row the verdicts of five detectors and whether three agree.

    IQR, z-score, modified z-score, isolation forest, and the farthest tenth by robust distance (the elliptic
    envelope of one dimension); the last two take the tenth that is oddest.
    """
    from traceweft.operators.isolation import isolation_scores

    x = isolation_scores(df.select(row_id, F.col(column).cast("double").alias("x")), "x", trees)
    a = x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).join(quantiles(x, {"q": F.col("x"), "i": F.col("isolation")}, [0.25, 0.5, 0.75, 0.9]))
    dev = x.join(F.broadcast(a)).withColumn("dev", F.abs(F.col("x") - F.col("q")[1]))
    j = dev.join(F.broadcast(quantiles(dev, {"d": F.col("dev")}, [0.5, 0.9])))
    iqr = F.col("q")[2] - F.col("q")[0]
    flags = j.select(
        row_id,
        ((F.col("x") < F.col("q")[0] - 1.5 * iqr) | (F.col("x") > F.col("q")[2] + 1.5 * iqr)).alias("iqr"),
        (F.abs(F.col("x") - F.col("mean")) > 3 * F.col("sd")).alias("zscore"),
        (0.6745 * F.col("dev") > 3.5 * F.col("d")[0]).alias("modified_z"),
        (F.col("isolation") > F.col("i")[3]).alias("isolated"),
        (F.col("dev") > F.col("d")[1]).alias("farthest"),
    )
    votes = sum((F.col(c).cast("int") for c in ("iqr", "zscore", "modified_z", "isolated", "farthest")), F.lit(0))
    return flags.withColumn("consensus", votes >= 3)


def kolmogorov_smirnov(df: DataFrame, column: str) -> DataFrame:
    """One-sample distance to the normal law with the column's own mean and deviation, and whether it is under 1.36 / sqrt(n)."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    total = df.agg(F.count(column).cast("double").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    r = running(v, "x", {"upto": "m"}).join(F.broadcast(total))
    p = normal_cdf((F.col("x") - F.col("mean")) / F.col("sd"))
    gap = F.greatest(F.col("upto") / F.col("n") - p, p - (F.col("upto") - F.col("m")) / F.col("n"))
    return r.agg(F.max(gap).alias("ks"), F.max("n").alias("n")).select("ks", (F.col("ks") < 1.36 / F.sqrt("n")).alias("normal"))


def shapiro(df: DataFrame, column: str) -> dict | None:
    """Shapiro and Wilk's test; None for a column that has not 3 to 5,000 values, for which it is not made."""
    from traceweft.functions.special import shapiro_wilk

    x = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("double")).limit(5001).collect()]
    if not 3 <= len(x) <= 5000:
        return None
    w, p = shapiro_wilk(x)
    return {"w": w, "p": p, "normal": p > 0.05}


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal law, by a rational form of erf good to 1e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(z) / 1.4142135623730951)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z / 2)
    return 0.5 + 0.5 * F.signum(z) * erf


def missing_patterns(df: DataFrame, top: int = 10) -> DataFrame:
    """Commonest masks of null columns."""
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    return df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mask").limit(top)


def missing_flags(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).isNull().cast("int").alias(c) for c in df.columns])


def missing_mechanism(df: DataFrame, column: str, others: list[str]) -> DataFrame:
    """MCAR, MAR or MNAR by the strongest correlation of the column's nulls with other columns (0.1, 0.3)."""
    flag = F.col(column).isNull().cast("double")
    r = df.agg(F.greatest(F.lit(0.0), *[F.abs(correlation(flag, F.col(c))) for c in others]).alias("strongest"))
    return r.withColumn("mechanism", F.when(F.col("strongest") < 0.1, "MCAR").when(F.col("strongest") < 0.3, "MAR").otherwise("MNAR"))


def variance_ranking(df: DataFrame, columns: list[str]) -> DataFrame:
    s = numbers(df, columns).groupBy("column").agg(F.var_samp("x").alias("variance"), F.try_divide(F.stddev_samp("x"), F.abs(F.avg("x"))).alias("cv"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("variance"), "column")))


def trend(df: DataFrame, t: Column, value: str) -> DataFrame:
    x = df.select(t.cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return x.agg(F.regr_slope("v", "t").alias("slope"), F.regr_r2("v", "t").alias("r2"))


def autocorrelation(series: DataFrame, order: str, value: str, lags: list[int]) -> DataFrame:
    """Correlation of a regular, small series with itself at each lag."""
    w = Window.orderBy(order)
    one = series.select(value, *[F.lag(value, k).over(w).alias(f"l{k}") for k in lags]).agg(*[correlation(F.col(value), F.col(f"l{k}")).alias(f"r{k}") for k in lags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])).alias("z")).select("z.*")


def pca_components(df: DataFrame, columns: list[str]) -> DataFrame:
    """Explained and cumulative variance of the standardised columns' principal components."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    spark = df.sparkSession
    v = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    z = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(v).transform(v)
    share = [float(x) for x in PCA(k=len(columns), inputCol="z", outputCol="p").fit(z).explainedVariance]
    total = [sum(share[: i + 1]) for i in range(len(share))]
    return spark.createDataFrame([(i + 1, s, t, t >= 0.9, t >= 0.95) for i, (s, t) in enumerate(zip(share, total))], "component int, share double, cumulative double, enough_90 boolean, enough_95 boolean")


def dagostino(df: DataFrame, columns: list[str]) -> DataFrame:
    """D'Agostino and Pearson's K2 of each column (chi-square with two degrees of freedom if normal), from its moments."""
    s = numbers(df, columns).groupBy("column").agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 6 / (n + 1)) / F.sqrt(spread)
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / (beta * beta)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return s.select("column", (z1 * z1 + z2 * z2).alias("k2")).withColumn("normal", F.col("k2") < 5.991)


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """Anderson-Darling A2 against the normal law with the column's own mean and deviation, corrected for its size.

    The ranks come from running counts per distinct value.
    """
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    total = df.agg(F.count(column).cast("double").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    z = (F.col("x") - F.col("mean")) / F.col("sd")
    p = F.greatest(F.least(normal_cdf(z), F.lit(1 - 1e-12)), F.lit(1e-12))
    r = running(v, "x", {"upto": "m"}).join(F.broadcast(total)).withColumn("p", p)
    m, k, n = F.col("m"), F.col("upto"), F.col("n")
    low = m * (2 * k - m)  # sum of 2i - 1 over the m ranks that end at k
    high = m * (2 * (n - k) + m)
    s = r.agg(F.sum(low * F.log("p") + high * F.log(1 - F.col("p"))).alias("s"), F.max("n").alias("n"))
    return s.select(((-F.col("n") - F.col("s") / F.col("n")) * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))).alias("a2")).withColumn("normal", F.col("a2") < 0.752)


def dickey_fuller(series: DataFrame, order: str, value: str) -> DataFrame:
    """Dickey-Fuller statistic of a series with drift: t of the level in a regression of its change; under -2.86 it is stationary at 5 %."""
    w = Window.orderBy(order)
    x = series.select(F.lag(value).over(w).cast("double").alias("x"), (F.col(value) - F.lag(value).over(w)).cast("double").alias("d")).where("x is not null and d is not null")
    a = x.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("d", "x").alias("b"), F.regr_sxx("d", "x").alias("sxx"), F.regr_syy("d", "x").alias("syy"))
    rest = F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")
    t = F.col("b") / F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    return a.select(t.alias("statistic")).withColumn("stationary", F.col("statistic") < -2.86)
