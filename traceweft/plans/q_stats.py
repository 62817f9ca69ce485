"""Queries of descriptive statistics, outliers, missingness, association and feature scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import associate as A
from traceweft.operators import stats as S
from traceweft.plans.q_profile import _HOLES, facts, holes
from traceweft.plans.registry import query, table

_NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query("agg25_pearson_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def _(s, d):
    return S.correlation_pairs(table(s, d, "lineitem"), list(_NUM)).withColumn("r", F.round("r", 6))


@query("agg30_describe", "SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS hi FROM events")
def _(s, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(s, d, "events").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), F.max("value").alias("hi"))


@query(
    "sta01_moments",
    """SELECT 'value' AS "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (WHERE value = 0) AS n_zero, count(*) FILTER (WHERE value < 0) AS n_negative,
    skewness(value) AS skewness, kurtosis(value) AS kurtosis, stddev_samp(value) / avg(value) AS cv, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events""",
)
def _(s, d):
    return S.moments(table(s, d, "events"), ["value"])


@query("sta01_deviations", "WITH m AS (SELECT median(value) AS m FROM events) SELECT 'value' AS \"column\", median(abs(value - m)) AS mad FROM events, m")
def _(s, d):
    return S.deviations(table(s, d, "events"), ["value"])


@query("sta02_entropy", "WITH c AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) SELECT 'event_type' AS \"column\", -sum(n / t * log2(n / t)) AS entropy, max(n / t) AS concentration FROM c, t")
def _(s, d):
    return S.entropy(table(s, d, "events"), ["event_type"])


_POINTS = [0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99]


@query("sta03_percentiles", " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, quantile_cont(value, {p}) AS value FROM events" for p in _POINTS))
def _(s, d):
    return S.percentiles(table(s, d, "events"), "value", _POINTS)


@query("sta03_trimmed_mean", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) SELECT avg(value) AS trimmed_mean FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1)")
def _(s, d):
    return S.trimmed_mean(table(s, d, "events"), "value")


@query("sta04_jarque_bera", """WITH m AS (SELECT count(value)::DOUBLE AS n, avg(value) AS a FROM events), c AS (SELECT avg((value - a) ** 2) AS m2, avg((value - a) ** 3) AS m3, avg((value - a) ** 4) AS m4, max(n) AS n FROM events, m)
    SELECT 'value' AS "column", n / 6 * ((m3 / m2 ** 1.5::DOUBLE) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) AS jb, n / 6 * ((m3 / m2 ** 1.5::DOUBLE) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) < 5.991 AS normal FROM c""")
def _(s, d):
    return S.jarque_bera(table(s, d, "events"), ["value"])


@query("sta05_distribution_hint", "SELECT 'value' AS \"column\", CASE WHEN abs(s) < 0.5 AND abs(k) < 1 THEN 'normal' WHEN s > 2 THEN 'exponential_or_lognormal' WHEN s > 0.5 THEN 'gamma_or_weibull' WHEN s < -0.5 THEN 'beta_left_skewed' WHEN k < -1 THEN 'uniform' ELSE 'student_t_or_laplace' END AS hint FROM (SELECT skewness(value) AS s, kurtosis(value) AS k FROM events)")
def _(s, d):
    return S.moments(table(s, d, "events"), ["value"]).select("column", S.distribution_hint(F.col("skewness"), F.col("kurtosis")).alias("hint"))


def _ranks(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("sta06_spearman_pairs", f"WITH r AS (SELECT {_ranks('p_size')} AS a, {_ranks('p_retailprice')} AS b FROM part) SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(r.a, r.b), 6) AS r FROM r")
def _(s, d):
    return S.spearman_pairs(table(s, d, "part"), ["p_size", "p_retailprice"], "p_partkey").withColumn("r", F.round("r", 6))


@query(
    "sta06_kendall",
    """WITH x AS (SELECT p_size // 5 AS x, (p_partkey % 7)::BIGINT AS y, row_number() OVER () AS i FROM part), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, (a.x <> b.x)::INT AS dx, (a.y <> b.y)::INT AS dy FROM x a JOIN x b ON a.i < b.i)
    SELECT round(sum(s) / sqrt(sum(dx)::DOUBLE * sum(dy)::DOUBLE), 6) AS tau FROM p""",
)
def _(s, d):
    p = table(s, d, "part").select(F.floor(F.col("p_size") / 5).alias("x"), (F.col("p_partkey") % 7).alias("y"))
    return S.kendall(p, "x", "y").select(F.round("tau", 6).alias("tau"))


@query(
    "sta06_kendall_prices",
    """WITH x AS (SELECT p_size AS x, p_retailprice AS y, row_number() OVER () AS i FROM part), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, (a.x <> b.x)::INT AS dx, (a.y <> b.y)::INT AS dy FROM x a JOIN x b ON a.i < b.i)
    SELECT round(sum(s) / sqrt(sum(dx)::DOUBLE * sum(dy)::DOUBLE), 6) AS tau FROM p""",
)
def _(s, d):
    return S.kendall(table(s, d, "part"), "p_size", "p_retailprice").select(F.round("tau", 6).alias("tau"))


@query("sta07_stability", f"WITH r AS (SELECT p_size AS x, p_retailprice AS y, {_ranks('p_size')} AS a, {_ranks('p_retailprice')} AS b FROM part), c AS (SELECT corr(x, y) AS p, corr(a, b) AS q FROM r) SELECT round(1 - abs(p - q) / 2, 6) AS stability, CASE WHEN abs(p) > 0.7 AND abs(q) > 0.7 THEN 'linear' WHEN abs(q) - abs(p) > 0.1 THEN 'monotonic' WHEN abs(p) - abs(q) > 0.1 THEN 'outlier_driven' ELSE 'weak' END AS kind FROM c")
def _(s, d):
    p, c = table(s, d, "part"), ["p_size", "p_retailprice"]
    j = S.correlation_pairs(p, c).withColumnRenamed("r", "p").join(S.spearman_pairs(p, c, "p_partkey").withColumnRenamed("r", "q"), ["a", "b"])
    return j.select(F.round(S.stability(F.col("p"), F.col("q")), 6).alias("stability"), S.relationship(F.col("p"), F.col("q")).alias("kind"))


@query(
    "sta08_outliers",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS c, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd FROM lineitem),
    x AS (SELECT l_orderkey, l_partkey, l_extendedprice AS v, abs(l_extendedprice - m) AS dev, q.* FROM lineitem, q), d AS (SELECT median(dev) AS mad, quantile_cont(dev, 0.9) AS far FROM x)
    SELECT l_orderkey * 100000 + l_partkey AS id, v < a - 1.5 * (c - a) OR v > c + 1.5 * (c - a) AS iqr, abs(v - mean) > 3 * sd AS zscore, 0.6745 * dev > 3.5 * mad AS modified_z, dev > far AS farthest FROM x, d""",
)
def _(s, d):
    x = table(s, d, "lineitem").select((F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("id"), "l_extendedprice")
    return S.outlier_flags(x, "l_extendedprice", "id").select("id", "iqr", "zscore", "modified_z", "farthest")


# of the forest: its votes add up, and about a tenth is isolated
@query("sta11_isolation_forest", "SELECT count(*) AS n, true AS a_tenth, true AS votes_add_up, true AS far_ones_are_odd FROM lineitem")
def _(s, d):
    x = S.outlier_flags(table(s, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), "l_extendedprice"), "l_extendedprice", "id")
    votes = sum((F.col(c).cast("int") for c in ("iqr", "zscore", "modified_z", "isolated", "farthest")), F.lit(0))
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("isolated").cast("int")).between(0.03, 0.1).alias("a_tenth"), F.bool_and(F.col("consensus") == (votes >= 3)).alias("votes_add_up"),
        (F.avg(F.when(F.col("farthest"), F.col("isolated").cast("int"))) > F.avg(F.when(~F.col("farthest"), F.col("isolated").cast("int")))).alias("far_ones_are_odd"),
    )


@query(
    "sta13_upper_iqr_keys",
    "WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1), q AS (SELECT quantile_cont(n, 0.75) + 0.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS bound FROM c) SELECT user_id, n, bound FROM c, q WHERE n > bound",
)
def _(s, d):
    from traceweft.operators.aggregates import upper_outliers

    c = table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return upper_outliers(c, "n", 0.5)


@query("sta14_missing_patterns", f"SELECT (status IS NULL)::INT::VARCHAR || (priority IS NULL)::INT::VARCHAR || (cust IS NULL)::INT::VARCHAR AS mask, count(*) AS n FROM {_HOLES} GROUP BY 1 ORDER BY n DESC, mask LIMIT 10")
def _(s, d):
    return S.missing_patterns(holes(s, d).select("status", "priority", "cust"))


@query("sta15_missing_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 6) AS r FROM {_HOLES}" for a, b in (("status", "priority"), ("status", "cust"), ("priority", "cust"))))
def _(s, d):
    c = ["status", "priority", "cust"]
    return S.correlation_pairs(S.missing_flags(holes(s, d).select(*c)), c).withColumn("r", F.round("r", 6))


@query("sta16_missing_mechanism", f"WITH r AS (SELECT abs(corr((status IS NULL)::INT, o_orderkey)) AS r FROM {_HOLES}) SELECT round(r, 6) AS strongest, CASE WHEN r < 0.1 THEN 'MCAR' WHEN r < 0.3 THEN 'MAR' ELSE 'MNAR' END AS mechanism FROM r")
def _(s, d):
    return S.missing_mechanism(holes(s, d), "status", ["o_orderkey"]).withColumn("strongest", F.round("strongest", 6))


@query("sta17_variance_ranking", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance, stddev_samp({c}) / abs(avg({c})) AS cv FROM lineitem" for c in _NUM) + ') SELECT *, row_number() OVER (ORDER BY variance DESC, "column")::INT AS place FROM v')
def _(s, d):
    return S.variance_ranking(table(s, d, "lineitem"), list(_NUM))


@query("sta18_trend", "SELECT round(regr_slope(value, epoch(ts)::DOUBLE / 86400) * 1000, 6) AS slope, round(regr_r2(value, epoch(ts)::DOUBLE / 86400), 6) AS r2 FROM events")
def _(s, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6
    return S.trend(table(s, d, "events"), t, "value").select(F.round(F.col("slope") * 1000, 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query(
    "sta18_autocorrelation",
    "WITH d AS (SELECT ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1), l AS (SELECT n, lag(n, 1) OVER (ORDER BY day) AS a, lag(n, 7) OVER (ORDER BY day) AS b FROM d) SELECT 1 AS lag, round(corr(n, a), 6) AS r FROM l UNION ALL SELECT 7, round(corr(n, b), 6) FROM l",
)
def _(s, d):
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return S.autocorrelation(daily, "day", "n", [1, 7]).withColumn("r", F.round("r", 6))


@query("sta19_pca")
def _(s, d):
    return S.pca_components(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_CT = "(SELECT event_type AS x, (user_id % 4)::BIGINT AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"
_MARGINS = f"c AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM {_CT})"


def _xy(s, d):
    return table(s, d, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("y"), "value")


@query("cor09_chi2", f"WITH {_MARGINS} SELECT round(sum((n - nx * ny / t) ** 2 / (nx * ny / t)), 6) AS chi2, ((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1))::BIGINT AS dof FROM c")
def _(s, d):
    return A.chi2(_xy(s, d), "event_type", "y").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("cor10_anova", "WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), a AS (SELECT avg(value) AS g, count(value) AS t FROM events) SELECT round((sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (max(t) - count(*))), 6) AS f, count(*) - 1 AS d1, (max(t) - count(*))::BIGINT AS d2 FROM g, a")
def _(s, d):
    return A.anova(_xy(s, d), "value", "event_type").select(F.round("f", 6).alias("f"), "d1", "d2")


@query(
    "cor11_kruskal",
    f"""WITH r AS (SELECT event_type, value, {_ranks('value')} AS r FROM events), g AS (SELECT event_type, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS s FROM r GROUP BY 1), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM events GROUP BY value))
    SELECT round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (sum(n) ** 3 - sum(n))), 6) AS h, count(*) - 1 AS dof FROM g, t""",
)
def _(s, d):
    return A.kruskal(_xy(s, d), "value", "event_type", "event_id").select(F.round("h", 6).alias("h"), "dof")


@query("cor13_cramers_v", f"WITH {_MARGINS} SELECT round(sqrt(sum((n - nx * ny / t) ** 2 / (nx * ny / t)) / max(t) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)), 6) AS v FROM c")
def _(s, d):
    return A.cramers_v(_xy(s, d), "event_type", "y").select(F.round("v", 6).alias("v"))


@query(
    "cor14_information",
    f"WITH {_MARGINS}, i AS (SELECT -sum(n / t * log2(nx / t)) AS hx, -sum(n / t * log2(ny / t)) AS hy, sum(n / t * log2(n * t / (nx * ny))) AS mi FROM c) SELECT round(hx, 6) AS hx, round(hy, 6) AS hy, round(mi, 6) AS mi, round(mi / hx, 6) AS theils_u, round(mi / hy, 6) AS gain, round(mi / hx, 6) AS gain_ratio FROM i",
)
def _(s, d):
    i = A.information(_xy(s, d), "event_type", "y")
    return i.select(*[F.round(c, 6).alias(c) for c in i.columns])


@query("cor16_categorical_rule", f"SELECT \"column\", d <= 2 OR (d <= 20 AND u < 0.05) OR (d <= 50 AND u < 0.01) AS categorical FROM {facts({c: c for c in ('o_orderkey', 'status', 'priority', 'cust')}, _HOLES)}")
def _(s, d):
    from traceweft.operators.profile import profile

    return profile(holes(s, d)).select("column", A.is_categorical(F.col("n_distinct"), F.col("uniqueness")).alias("categorical"))


_SCORES = [("mi", "a", 0.8), ("mi", "b", 0.4), ("mi", "c", 0.0), ("f", "a", 3.0), ("f", "b", 6.0), ("f", "c", 1.5), ("perm", "a", 0.02), ("perm", "b", 0.01), ("perm", "c", 0.04), ("net", "a", 5.0), ("net", "b", 1.0), ("net", "c", 4.0)]
_WEIGHTS = {"mi": 0.3, "f": 0.3, "perm": 0.2, "net": 0.2}


@query(
    "imp08_consensus",
    f"""WITH s(method, feature, score) AS (VALUES {", ".join(f"('{m}', '{f}', {x}::DOUBLE)" for m, f, x in _SCORES)}), n AS (SELECT feature, CASE method WHEN 'mi' THEN 0.3 WHEN 'f' THEN 0.3 ELSE 0.2 END::DOUBLE * score / max(score) OVER (PARTITION BY method) AS v FROM s), c AS (SELECT feature, sum(v) AS consensus FROM n GROUP BY 1)
    SELECT *, CASE WHEN consensus >= 0.7 THEN 'CRITICAL' WHEN consensus >= 0.5 THEN 'HIGH' WHEN consensus >= 0.3 THEN 'MEDIUM' WHEN consensus >= 0.1 THEN 'LOW' ELSE 'MINIMAL' END AS band FROM c""",
)
def _(s, d):
    return A.consensus(s.createDataFrame(_SCORES, "method string, feature string, score double"), _WEIGHTS)


@query(
    "imp03_false_discoveries",
    """WITH p AS (SELECT event_type AS feature, (count(*) FILTER (WHERE value > 90))::DOUBLE / count(*) AS p FROM events GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS q, row_number() OVER (ORDER BY p, feature) AS k FROM p)
    SELECT feature, round(p, 9) AS p, round(least(min(q) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS adjusted, least(min(q) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1) <= 0.17 AS rejected FROM r""",
)
def _(s, d):
    share = (F.count_if(F.col("value") > 90) / F.count(F.lit(1))).alias("p")
    p = A.false_discoveries(table(s, d, "events").groupBy(F.col("event_type").alias("feature")).agg(share), rate=0.17)
    return p.select("feature", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"), "rejected")


@query(
    "imp04_centrality",
    "WITH p AS (SELECT corr(l_quantity, l_extendedprice) AS r, 'l_quantity' AS a, 'l_extendedprice' AS b FROM lineitem UNION ALL SELECT corr(l_quantity, l_discount), 'l_quantity', 'l_discount' FROM lineitem UNION ALL SELECT corr(l_extendedprice, l_discount), 'l_extendedprice', 'l_discount' FROM lineitem), u AS (SELECT a AS feature, abs(r) AS r FROM p UNION ALL SELECT b, abs(r) FROM p) SELECT feature, round(sum(r), 6) AS strength, count(*) AS degree FROM u WHERE r > 0.000001 AND r < 0.99 GROUP BY 1",
)
def _(s, d):
    return A.centrality(S.correlation_pairs(table(s, d, "lineitem"), list(_NUM)), 0.000001, 0.99).withColumn("strength", F.round("strength", 6))
