"""Association between columns and feature selection, from tables of counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from traceweft.functions import special
from traceweft.operators import orderstats, stats


def contingency(df: DataFrame, x: str, y: str, missing: str | None = None) -> DataFrame:
    """(x, y, n) with margins nx, ny and total; pairs with a null are left out unless given a text."""
    a, b = F.col(x), F.col(y)
    if missing is not None:
        a, b = F.coalesce(a.cast("string"), F.lit(missing)), F.coalesce(b.cast("string"), F.lit(missing))
    c = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return c.select("x", "y", "n", F.sum("n").over(Window.partitionBy("x")).alias("nx"), F.sum("n").over(Window.partitionBy("y")).alias("ny")).join(F.broadcast(c.agg(F.sum("n").alias("total"))))


def chi2(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: chi2, dof, total, rows, columns; absent cells count through their expectation."""
    c = contingency(df, x, y)
    # sum of (n - e)^2 / e over all cells is sum of n^2 / e over present ones less the total
    s = c.agg((F.sum(F.col("n") * F.col("n") * F.col("total") / (F.col("nx") * F.col("ny"))) - F.max("total")).alias("chi2"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k"), F.max("total").alias("total"))
    return s.select("chi2", ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"), "total", "r", "k")


def chi2_yates(df: DataFrame, x: str, y: str) -> DataFrame:
    """Chi-square of a 2 x 2 table with continuity correction; null for other tables."""
    c = contingency(df, x, y)
    e = F.col("nx") * F.col("ny") / F.col("total")
    s = c.agg(F.sum(F.pow(F.greatest(F.abs(F.col("n") - e) - 0.5, F.lit(0.0)), 2) / e).alias("chi2"), F.count(F.lit(1)).alias("cells"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k"))
    return s.select(F.when((F.col("r") == 2) & (F.col("k") == 2) & (F.col("cells") == 4), F.col("chi2")).alias("chi2"))


def cramers_v(df: DataFrame, x: str, y: str, corrected: bool = False) -> DataFrame:
    """Cramer's V; ``corrected`` for bias."""
    s = chi2(df, x, y)
    phi, r, k, n = F.col("chi2") / F.col("total"), F.col("r"), F.col("k"), F.col("total")
    if corrected:
        phi = F.greatest(phi - (r - 1) * (k - 1) / (n - 1), F.lit(0.0))
        r, k = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    return s.select(F.sqrt(phi / F.nullif(F.least(r, k) - 1, F.lit(0))).alias("v"))


def information(df: DataFrame, x: str, y: str, missing: str | None = None) -> DataFrame:
    """Entropies of x and y and mutual information in bits, with what is derived: Theil's U of x given y, gain, gain ratio."""
    c = contingency(df, x, y, missing)
    p, px, py = F.col("n") / F.col("total"), F.col("nx") / F.col("total"), F.col("ny") / F.col("total")
    one = c.agg((-F.sum(p * F.log2(px))).alias("hx"), (-F.sum(p * F.log2(py))).alias("hy"), F.sum(p * F.log2(p / (px * py))).alias("mi"))
    ratio = lambda a: F.coalesce(F.col("mi") / F.nullif(F.col(a), F.lit(0.0)), F.lit(0.0))
    return one.select("hx", "hy", "mi", ratio("hx").alias("theils_u"), ratio("hy").alias("gain"), ratio("hx").alias("gain_ratio"))


def adjusted_mutual_information(df: DataFrame, x: str, y: str) -> float:
    """Mutual information in nats, adjusted for chance by the hypergeometric expectation, over the mean entropy.

    Of the margins the driver gets how often each count occurs; counts that differ add up to the rows, so there
    are at most sqrt(2 rows) of them.
    """
    c = contingency(df, x, y)
    margins = lambda v, m: [(int(r[0]), r[1]) for r in c.select(v, m).distinct().groupBy(m).count().orderBy(m).collect()]
    a, b = margins("x", "nx"), margins("y", "ny")
    s = information(df, x, y).first()
    n = sum(i * k for i, k in a)
    lg = math.lgamma
    expected = 0.0
    for i, ni in a:
        for j, nj in b:
            for k in range(max(1, i + j - n), min(i, j) + 1):
                lp = lg(i + 1) + lg(j + 1) + lg(n - i + 1) + lg(n - j + 1) - lg(n + 1) - lg(k + 1) - lg(i - k + 1) - lg(j - k + 1) - lg(n - i - j + k + 1)
                expected += ni * nj * k / n * math.log(n * k / (i * j)) * math.exp(lp)
    mean = (s["hx"] + s["hy"]) * math.log(2) / 2
    return (s["mi"] * math.log(2) - expected) / (mean - expected) if mean - expected else 1.0


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F statistic and its degrees of freedom, from sums by group."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"))
    return s.select(((F.col("between") / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("t") - F.col("k")), F.lit(0.0))).alias("f"), (F.col("k") - 1).alias("d1"), (F.col("t") - F.col("k")).alias("d2"))


def kruskal(df: DataFrame, value: str, group: str, row_id: str) -> DataFrame:
    """One row: Kruskal-Wallis H corrected for ties, and its degrees of freedom."""
    base = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(row_id, value, group)
    r = base.select(row_id, group).join(stats.ranked(base, [value], row_id), row_id)
    ties = base.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    g = r.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s"))
    s = g.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k")).join(F.broadcast(ties))
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    return s.select((h / F.nullif(1 - F.col("ties") / (F.pow("n", 3) - F.col("n")), F.lit(0.0))).alias("h"), (F.col("k") - 1).alias("dof"))


def correlated_drops(pairs: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Columns to drop: of each pair over the threshold the earlier one."""
    found = {r["a"] for r in pairs.where(F.abs("r") > threshold).collect()}
    return [c for c in columns if c in found]


#: Of a correlated pair, the column whose name hits an earlier entry stays.
NAME_RANKS = (("measure", "value"), ("process", "step"), ("desc", "name"), ("id", "number"))


def pair_loser(a: str, b: str, uniqueness: dict[str, float]) -> str:
    """Which of a correlated pair to drop: the worse by name, then the one of less uniqueness, then the later name."""
    rank = lambda c: next((i for i, words in enumerate(NAME_RANKS) if any(w in c.lower() for w in words)), len(NAME_RANKS))
    return max((a, b), key=lambda c: (rank(c), -uniqueness.get(c, 0.0), c))


def numeric_method(pearson: float, spearman: float, kendall: float) -> tuple[str, float]:
    """Kendall unless another is over 1.2 times it and over 0.1."""
    best, value = "kendall", abs(kendall)
    for name, x in (("pearson", abs(pearson)), ("spearman", abs(spearman))):
        if x > 1.2 * value and x > 0.1:
            best, value = name, x
    return best, value


def categorical_method(df: DataFrame, feature: str, target: str, many: int = 20) -> tuple[str, float]:
    """The strongest of Cramer's V and Theil's U, and of adjusted mutual information where the feature has over ``many`` values."""
    i = information(df, feature, target).first()
    found = {"cramers_v": cramers_v(df, feature, target).first()["v"] or 0.0, "theils_u": i["gain"]}
    if df.select(feature).distinct().limit(many + 1).count() > many:
        found["adjusted_mi"] = adjusted_mutual_information(df, feature, target)
    name = max(sorted(found), key=lambda k: found[k])
    return name, float(found[name])


def robust_pairs(df: DataFrame, columns: list[str], row_id: str, threshold: float = 0.85) -> DataFrame:
    """(a, b, r): of Kendall's and Spearman's coefficient of each pair the mean, where its size reaches the threshold."""
    rank = {(r["a"], r["b"]): r["r"] for r in stats.spearman_pairs(df, columns, row_id).collect()}
    rows = [(a, b, ((stats.kendall(df, a, b).first()["tau"] or 0.0) + (r or 0.0)) / 2) for (a, b), r in rank.items()]
    return df.sparkSession.createDataFrame([x for x in rows if abs(x[2]) >= threshold], "a string, b string, r double")


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 8) -> DataFrame:
    """(feature, mi, share of the greatest): mutual information in bits with a target, numbers by quantile bins on both sides."""
    if isinstance(df.schema[target].dataType, T.NumericType) and target_type(df, target) == "numeric":
        df = binned(df, target, bins)
    rows = [(f, float(gain_ratio(df, f, target, bins).first()["mi"] or 0.0)) for f in features]
    top = max([x for _, x in rows], default=0.0) or 1.0
    return df.sparkSession.createDataFrame([(f, x, x / top) for f, x in rows], "feature string, mi double, share double")


def is_categorical(n_distinct: Column, uniqueness: Column) -> Column:
    return (n_distinct <= 2) | ((n_distinct <= 20) & (uniqueness < 0.05)) | ((n_distinct <= 50) & (uniqueness < 0.01))


def target_type(df: DataFrame, target: str) -> str:
    """binary, multiclass (up to 20 values) or numeric."""
    n = df.select(target).distinct().limit(22).count()
    if n <= 2:
        return "binary"
    return "multiclass" if n <= 20 or not isinstance(df.schema[target].dataType, T.NumericType) else "numeric"


def association(df: DataFrame, feature: str, target: str, row_id: str) -> dict:
    """Test that suits the pair of types, with statistic, p and score min(1.2 * -log10 p, 15).

    A numeric target meets numbers by Spearman and texts by Kruskal-Wallis; a target of classes meets numbers by
    ANOVA, or Alexander and Govern's test where variances differ, and texts by chi-square, or Fisher's exact test
    in a 2 x 2 table with an expected count under 5.
    """
    numeric = isinstance(df.schema[feature].dataType, T.NumericType)
    if target_type(df, target) == "numeric":
        if numeric:
            r = stats.spearman_pairs(df, [feature, target], row_id).first()["r"] or 0.0
            n = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).count()
            name, stat = "spearman", r
            p = special.t_p(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2) if n > 2 else 1.0
        else:
            s = kruskal(df, target, feature, row_id).first()
            name, stat, p = "kruskal", s["h"] or 0.0, special.chi2_p(s["h"] or 0.0, s["dof"]) if s["dof"] else 1.0
    elif numeric:
        s = mean_test(df, feature, target)
        name, stat, p = s["test"], s["statistic"], s["p"]
    else:
        s = independence(df, feature, target)
        name, stat, p = s["test"], s["statistic"], s["p"]
    return {"feature": feature, "test": name, "statistic": stat, "p": p, "score": min(1.2 * -math.log10(max(p, 1e-300)), 15.0)}


def independence(df: DataFrame, x: str, y: str) -> dict:
    """Chi-square test; Fisher's exact one for a 2 x 2 table with an expected count under 5, whose statistic is the odds ratio."""
    c = contingency(df, x, y).orderBy("x", "y").limit(5).collect()
    rows, cols = sorted({r["nx"] for r in c}), sorted({r["ny"] for r in c})
    s = chi2(df, x, y).first()
    if s["r"] == s["k"] == 2 and rows[0] * cols[0] / s["total"] < 5:
        first = min((str(r["x"]), str(r["y"])) for r in c)
        n = {(str(r["x"]) == first[0], str(r["y"]) == first[1]): int(r["n"]) for r in c}
        table = [n.get(k, 0) for k in ((True, True), (True, False), (False, True), (False, False))]
        a, b, d, e = table
        return {"test": "fisher", "statistic": a * e / (b * d) if b * d else math.inf, "p": fisher_p(*table)}
    return {"test": "chi2", "statistic": s["chi2"] or 0.0, "p": special.chi2_p(s["chi2"] or 0.0, s["dof"]) if s["dof"] else 1.0}


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: what all tables of these margins that are no likelier have together."""
    lg = math.lgamma
    pick = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    row, col, n = a + b, a + c, a + b + c + d
    logp = lambda k: pick(row, k) + pick(n - row, col - k) - pick(n, col)
    own = logp(a)
    return min(1.0, math.fsum(math.exp(logp(k)) for k in range(max(0, col - (n - row)), min(row, col) + 1) if logp(k) <= own + 1e-7))


def binned(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """The column as the number of its quantile bin, at most ``bins`` of them; equal edges are one, nulls stay."""
    edges = sorted(set(orderstats.quantiles(df, {"q": F.col(column)}, [k / bins for k in range(1, bins)]).first()[0]) - {None})
    place = F.lit(0)
    for e in edges:
        place = place + F.when(F.col(column) > F.lit(e), 1).otherwise(0)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), place))


def gain_ratio(df: DataFrame, feature: str, target: str, bins: int = 8) -> DataFrame:
    """Information gain ratio of a feature, numbers by quantile bins; one row with mi and gain_ratio."""
    if isinstance(df.schema[feature].dataType, T.NumericType):
        df = binned(df.select(feature, target), feature, bins)
    return information(df, feature, target).select("mi", "gain_ratio")


#: Weights of the parts of the univariate score.
UNIVARIATE = {"mi": 0.4, "f": 0.35, "chi2": 0.25}


def univariate(df: DataFrame, features: list[str], target: str, bins: int = 8, rate: float = 0.05) -> DataFrame:
    """Per numeric feature: mutual information with the classes, F and chi-square over quantile bins, the F test's p, the
    weighted sum of what each is of its greatest, and whether p survives Benjamini and Hochberg's procedure."""
    rows = []
    for f in features:
        a, cut = anova(df, f, target).first(), binned(df.select(f, target), f, bins)
        rows.append((f, float(information(cut, f, target).first()["mi"] or 0.0), float(a["f"] or 0.0), float(chi2(cut, f, target).first()["chi2"] or 0.0), special.f_p(a["f"] or 0.0, a["d1"], a["d2"])))
    out = df.sparkSession.createDataFrame(rows, "feature string, mi double, f double, chi2 double, p double")
    top = out.agg(*[F.max(c).alias(f"_{c}") for c in UNIVARIATE])
    score = sum((w * F.coalesce(F.col(c) / F.nullif(f"_{c}", F.lit(0.0)), F.lit(0.0)) for c, w in UNIVARIATE.items()), F.lit(0.0))
    return false_discoveries(out.join(F.broadcast(top)).withColumn("score", score).drop(*[f"_{c}" for c in UNIVARIATE]), "p", rate)


def cutoff(base: float, mode: str = "default", association: bool = False) -> float:
    """Score below which features go: default, conservative, aggressive."""
    factors = {"default": 1.0, "conservative": 2.0 if association else 0.1, "aggressive": 0.5 if association else 0.001}
    return base * factors[mode]


def select_features(scores: dict[str, float], base: float, mode: str = "default", association: bool = False) -> list[str]:
    return sorted((k for k, v in scores.items() if v >= cutoff(base, mode, association)), key=lambda k: (-scores[k], k))


def false_discoveries(p: DataFrame, column: str = "p", rate: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: adds adjusted and rejected."""
    w = Window.orderBy(column, "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    raw = p.withColumn("_r", F.row_number().over(w)).withColumn("_a", F.col(column) * n / F.col("_r"))
    adjusted = F.least(F.min("_a").over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return raw.withColumn("adjusted", adjusted).withColumn("rejected", F.col("adjusted") <= rate).drop("_r", "_a")


def consensus(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(method, feature, score) to one score per feature: weighted sum of scores over each method's greatest, with its band."""
    top = scores.groupBy("method").agg(F.max("score").alias("top"))
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col("method") == name, x).otherwise(w)
    s = scores.join(F.broadcast(top), "method").groupBy("feature").agg(F.sum(w * F.coalesce(F.col("score") / F.nullif("top", F.lit(0.0)), F.lit(0.0))).alias("consensus"))
    return s.withColumn("band", importance_band(F.col("consensus")))


def importance_band(x: Column) -> Column:
    return F.when(x >= 0.7, "CRITICAL").when(x >= 0.5, "HIGH").when(x >= 0.3, "MEDIUM").when(x >= 0.1, "LOW").otherwise("MINIMAL")


def centrality(pairs: DataFrame, low: float = 0.2, high: float = 0.9) -> DataFrame:
    """Sum and number of a feature's correlations between the bounds."""
    ok = pairs.where((F.abs("r") > low) & (F.abs("r") < high))
    both = ok.select(F.col("a").alias("feature"), F.abs("r").alias("r")).unionByName(ok.select(F.col("b").alias("feature"), F.abs("r").alias("r")))
    return both.groupBy("feature").agg(F.sum("r").alias("strength"), F.count(F.lit(1)).alias("degree"))


def group_medians(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, _med): exact medians; groups are few by nature."""
    groups = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().collect()]
    q = orderstats.quantiles(df, {f"g{i}": F.when(F.col(group) == F.lit(g), F.col(value)) for i, g in enumerate(groups)}, [0.5]).first() if groups else []
    return df.sparkSession.createDataFrame([(g, m[0]) for g, m in zip(groups, q)], T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("_med", T.DoubleType())]))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """ANOVA of the distances from each group's median (Brown and Forsythe's form)."""
    med = group_medians(df, value, group)
    return anova(df.join(F.broadcast(med), group).withColumn("_dev", F.abs(F.col(value) - F.col("_med"))), "_dev", group)


def alexander_govern(df: DataFrame, value: str, group: str) -> dict:
    """Equality of means where variances differ: statistic and p, from one row per group."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 2 and v > 0").collect()
    se2 = [r.v / r.n for r in rows]
    total = sum(1 / s for s in se2)
    centre = sum(r.m / s for r, s in zip(rows, se2)) / total
    stat = 0.0
    for r, s in zip(rows, se2):
        t, nu = (r.m - centre) / math.sqrt(s), r.n - 1
        a = nu - 0.5
        b = 48 * a * a
        c = math.sqrt(a * math.log1p(t * t / nu))
        z = c + (c**3 + 3 * c) / b - (4 * c**7 + 33 * c**5 + 240 * c**3 + 855 * c) / (10 * b * b + 8 * b * c**4 + 1000 * b)
        stat += z * z
    return {"statistic": stat, "p": special.chi2_p(stat, len(rows) - 1)}


def mean_test(df: DataFrame, value: str, group: str) -> dict:
    """ANOVA, or Alexander and Govern's test where Levene's finds unequal variances (p under 0.01)."""
    s = levene(df, value, group).first()
    if special.f_p(s["f"] or 0.0, s["d1"], s["d2"]) < 0.01:
        return {"test": "alexander_govern"} | alexander_govern(df, value, group)
    a = anova(df, value, group).first()
    return {"test": "anova", "statistic": a["f"] or 0.0, "p": special.f_p(a["f"] or 0.0, a["d1"], a["d2"])}
