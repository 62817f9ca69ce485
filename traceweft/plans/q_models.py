"""Queries of models, evaluation, importance and composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import models as M
from traceweft.plans import pipeline as R
from traceweft.plans.registry import query, table

#: Lines with a label and two deterministic pseudo-probabilities.
_SCORED = "(SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey % 3)::INTEGER AS y, ((l_orderkey % 3 = 1)::INT * 0.35 + (l_partkey % 50) / 100.0)::DOUBLE AS p1, ((l_orderkey % 3 = 2)::INT * 0.5 + (l_suppkey % 50) / 100.0)::DOUBLE AS p2 FROM lineitem)"


def scored(s, d):
    o = F.col("l_orderkey") % 3
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", o.cast("int").alias("y"),
        F.round((o == 1).cast("int") * 0.35 + (F.col("l_partkey") % 50) / 100, 2).alias("p1"), F.round((o == 2).cast("int") * 0.5 + (F.col("l_suppkey") % 50) / 100, 2).alias("p2"),
    )


_D = f"(SELECT *, CASE WHEN p2 > 0.6 THEN 2 WHEN p1 > 0.4 THEN 1 ELSE 0 END AS d FROM (SELECT * REPLACE (round(p1, 2) AS p1, round(p2, 2) AS p2) FROM {_SCORED}))"


def decided(s, d):
    return scored(s, d).withColumn("d", M.threshold_decision(F.col("p1"), F.col("p2"), 0.4, 0.6))


@query("mdl08_threshold_decision", f"SELECT l_orderkey, l_partkey, d FROM {_D}")
def _(s, d):
    return decided(s, d).select("l_orderkey", "l_partkey", "d")


_GRID = [0.15, 0.35, 0.55, 0.75]


@query(
    "mdl09_threshold_search",
    f"""WITH x AS (SELECT y, t1, t2, CASE WHEN p2 > t2 THEN 2 WHEN p1 > t1 THEN 1 ELSE 0 END AS d FROM {_D}, (SELECT unnest([0.15, 0.35, 0.55, 0.75]::DOUBLE[]) AS t1), (SELECT unnest([0.15, 0.35, 0.55, 0.75]::DOUBLE[]) AS t2))
    SELECT t1, t2, coalesce(count(*) FILTER (WHERE y = 1 AND d = 1)::DOUBLE / nullif(count(*) FILTER (WHERE y = 1), 0), 0) AS recall_1, coalesce(count(*) FILTER (WHERE y = 1 AND d = 1)::DOUBLE / nullif(count(*) FILTER (WHERE d = 1), 0), 0) AS precision_1,
    coalesce(count(*) FILTER (WHERE y = 2 AND d = 2)::DOUBLE / nullif(count(*) FILTER (WHERE y = 2), 0), 0) AS recall_2, coalesce(count(*) FILTER (WHERE y = 2 AND d = 2)::DOUBLE / nullif(count(*) FILTER (WHERE d = 2), 0), 0) AS precision_2 FROM x GROUP BY 1, 2""",
)
def _(s, d):
    return M.threshold_search(scored(s, d), "y", "p1", "p2", _GRID)


@query("mdl12_confusion", f"SELECT y, d, count(*) AS n FROM {_D} GROUP BY 1, 2")
def _(s, d):
    return M.confusion(decided(s, d), "y", "d")


_REPORT = f"""WITH c AS (SELECT k AS class, count(*) FILTER (WHERE y = k AND d = k)::DOUBLE AS hits, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE d = k) AS claimed FROM {_D}, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
    r AS (SELECT class, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, support FROM c), f AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM r)"""


@query("mdl12_class_report", f"{_REPORT} SELECT * FROM f")
def _(s, d):
    return M.class_report(decided(s, d), "y", "d")


@query("mdl12_overall", f"{_REPORT} SELECT sum(recall * support) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM f")
def _(s, d):
    return M.overall(M.class_report(decided(s, d), "y", "d"))


@query(
    "mdl13_roc_auc",
    f"WITH r AS (SELECT (y = 2)::INT AS y, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS r FROM {_D}), n AS (SELECT sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS q, sum(r) FILTER (WHERE y = 1)::DOUBLE AS s FROM r) SELECT (s - p * (p + 1) / 2) / (p * q) AS auc FROM n",
)
def _(s, d):
    return M.roc_auc(scored(s, d).withColumn("y", (F.col("y") == 2).cast("int")), "y", "p2")


@query(
    "mdl13_roc_curve",
    f"WITH c AS (SELECT p2 AS threshold, count(*) FILTER (WHERE y = 2) AS p, count(*) FILTER (WHERE y <> 2) AS q FROM {_D} GROUP BY 1) SELECT threshold, sum(q) OVER w / sum(q) OVER ()::DOUBLE AS fpr, sum(p) OVER w / sum(p) OVER ()::DOUBLE AS tpr FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)",
)
def _(s, d):
    return M.roc_curve(scored(s, d).withColumn("y", (F.col("y") == 2).cast("int")), "y", "p2")


def training(s, d):
    """Lines with a label that quantity and discount explain in part."""
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table(s, d, "lineitem").select(key.alias("id"), "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", ((F.col("l_quantity") * (1 + 4 * F.col("l_discount")) + F.col("l_partkey") % 7) > 35).cast("double").alias("label"))
    return x.where("l_orderkey % 5 <> 0"), x.where("l_orderkey % 5 = 0")


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("mdl05_random_forest")
def _(s, d):
    train, test = training(s, d)
    model = M.random_forest(_FEATURES, "label", trees=20, depth=5).fit(train)
    return M.overall(M.class_report(model.transform(test), "label", "prediction"))


@query("mdl10_boosted_trees")
def _(s, d):
    train, test = training(s, d)
    return M.overall(M.class_report(M.boosted_trees(_FEATURES, "label", rounds=10, depth=4).fit(train).transform(test), "label", "prediction"))


@query("mdl03_logistic_importance")
def _(s, d):
    train, _test = training(s, d)
    model = M.logistic(_FEATURES, "label").fit(train)
    return s.createDataFrame(M.coefficients(model, _FEATURES), "feature string, weight double")


@query("mdl01_lasso")
def _(s, d):
    train, _test = training(s, d)
    model = M.lasso_cv(train, _FEATURES, "label", [0.001, 0.01, 0.1], folds=2)
    return s.createDataFrame(M.coefficients(model, _FEATURES), "feature string, weight double")


@query("mdl17_regularisation_path")
def _(s, d):
    return M.regularisation_path(training(s, d)[0], _FEATURES, "label", [0.001, 0.01, 0.1])


@query("mdl11_leaderboard")
def _(s, d):
    train, test = training(s, d)
    models = {"GLM_ridge": M.logistic(_FEATURES, "label"), "RF_20": M.random_forest(_FEATURES, "label", trees=20, depth=5), "GBM_10": M.boosted_trees(_FEATURES, "label", rounds=10, depth=4)}
    return M.leaderboard(train, test, models, "label")


@query("imp01_permutation_importance")
def _(s, d):
    train, test = training(s, d)
    return M.permutation_importance(M.random_forest(_FEATURES, "label", trees=10, depth=5).fit(train), test, _FEATURES, "label", "id", repeats=2)


@query(
    "orc01_exclusion_plan",
    """WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 20), t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events WHERE user_id IN (SELECT user_id FROM c) GROUP BY 1),
    q AS (SELECT quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS b FROM t) SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM t, q WHERE n > b)""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("state", F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), "candidate").otherwise(F.col("event_type")))
    x = R.exclusion(e, "user_id", "state", ["error", "candidate"], "candidate", "error")
    return x["kept"].select("event_id")


@query(
    "orc02_configured_pipeline",
    """WITH f AS (SELECT * FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM f),
    c AS (SELECT event_type, min(ts) AS cutoff FROM r WHERE r = n - floor(n * 0.1::DOUBLE)::BIGINT GROUP BY 1)
    SELECT event_id, dense_rank() OVER (ORDER BY f.event_type) - 1 AS code, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS scaled, CASE WHEN ts >= cutoff THEN 'test' ELSE 'train' END AS split FROM f LEFT JOIN c USING (event_type)""",
)
def _(s, d):
    steps = [{"step": "filter", "where": "value is not null"}, {"step": "ordinal", "column": "event_type"}, {"step": "standard", "column": "value"}, {"step": "time_split", "label": "event_type", "ts": "ts"}]
    out = R.run_steps(table(s, d, "events"), steps)
    return out.select("event_id", F.col("event_type_enc").cast("long").alias("code"), F.col("value_enc").alias("scaled"), "split")


@query(
    "orc06_counts_add_up",
    "SELECT 'all' AS counted, (SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))::BIGINT AS n, (SELECT count(*) FROM events) AS n_rows, true AS complete UNION ALL SELECT 'late', (SELECT count(*) FROM events WHERE value > 50), (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE value > 50) = (SELECT count(*) FROM events)",
)
def _(s, d):
    e = table(s, d, "events")
    rows = []
    for name, part in (("all", e), ("late", e.where("value > 50"))):
        counted = part.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        rows.append((name, counted.agg(F.sum("n")).first()[0] or 0, e.count(), R.counts_add_up(e, counted)))
    return s.createDataFrame(rows, "counted string, n long, n_rows long, complete boolean")


@query(
    "merge_within_seconds",
    """WITH b AS (SELECT greatest(min(l_shipdate), (SELECT min(o_orderdate) FROM orders)) AS start FROM lineitem), o AS (SELECT * FROM orders, b WHERE o_orderdate BETWEEN start AND start + INTERVAL 700 DAY), l AS (SELECT * FROM lineitem, b WHERE l_shipdate BETWEEN start AND start + INTERVAL 700 DAY),
    x AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS r FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM l))
    SELECT o_orderkey AS k, o_orderstatus, l_linenumber AS l_linenumber_m, l_partkey AS l_partkey_m FROM x LEFT JOIN l ON l_orderkey = o_orderkey AND abs(date_diff('seconds', o_orderdate, l_shipdate)) <= 864000 WHERE r <= 100""",
)
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderkey", "k")
    x = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    out = R.merged(o, x, ["k"], "o_orderdate", "l_shipdate", "o_orderstatus", "k", 100, days=700, seconds=864_000)
    return out.select("k", "o_orderstatus", "l_linenumber_m", "l_partkey_m")
