"""Queries of sampling, splits and class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import balance as B
from traceweft.operators import sampling as P
from traceweft.plans.registry import query, table

def rare(s, d):
    """One row per order with its id and a label that has one rare and one very rare class, as test tables are balanced."""
    key = F.col("o_orderkey")
    return table(s, d, "orders").select(key.alias("id"), F.when(key % 101 == 0, 2).when(key % 17 == 0, 1).otherwise(0).alias("label"))


_RARE = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 = 0 THEN 2 WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS label FROM orders)"
_RANK = f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM {_RARE})"


@query("smp01_sample_keys", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(user_id::VARCHAR), user_id LIMIT 8")
def _(s, d):
    return P.sample_keys(table(s, d, "events"), "user_id", 8)


@query("smp02_per_label", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 40")
def _(s, d):
    return P.per_class(table(s, d, "events"), "event_type", "event_id", 40).select("event_id", "event_type")


@query(
    "smp03_balance_by_key",
    """WITH e AS (SELECT *, CASE WHEN event_type = 'error' AND value > 220 THEN 'bad' ELSE 'good' END AS state FROM events), k AS (SELECT user_id, bool_or(state = 'bad') AS marked FROM e GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY marked ORDER BY md5(user_id::VARCHAR), user_id) AS r, (SELECT count(*) FROM k WHERE marked) AS m FROM k)
    SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM r WHERE marked OR r <= m * 1)""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("state", F.when((F.col("event_type") == "error") & (F.col("value") > 220), "bad").otherwise("good"))
    return P.balance_by_key(e, "user_id", "state", ["bad"], "good", 1).select("event_id", "user_id")


@query("smp05_at_most_keys", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(user_id::VARCHAR), user_id LIMIT 12)")
def _(s, d):
    return P.at_most_keys(table(s, d, "events"), "user_id", 12).select("event_id")


@query(
    "smp06_diverse_sample",
    """WITH a AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 8)),
    b AS (SELECT p_size, row_number() OVER (ORDER BY p_size) AS place FROM (SELECT DISTINCT p_size FROM part ORDER BY 1 LIMIT 8)) SELECT place::INTEGER AS place, p_brand, p_size FROM a FULL JOIN b USING (place)""",
)
def _(s, d):
    return P.diverse_sample(table(s, d, "part"), ["p_brand", "p_size"], 8)


def _resampled(targets):
    def run(s, d):
        df = rare(s, d).select("id", "label")
        return P.resample(df, "label", "id", targets(P.class_counts(df, "label")))

    return run


def _resampled_sql(target):
    return f"WITH t AS (SELECT *, {target} AS t FROM {_RANK}) SELECT id, label, c::INTEGER AS copy FROM t, LATERAL (SELECT unnest(range(0, t // n + CASE WHEN r <= t % n THEN 1 ELSE 0 END)) AS c)"


query("smp07_minority_preserving", _resampled_sql("CASE WHEN label > 0 THEN n ELSE least(n, floor((3000 - (SELECT count(*) FROM " + _RARE + " WHERE label > 0)))) END::BIGINT"))(_resampled(lambda c: P.minority_preserving_targets(c, 3000, minorities=[k for k in c if k > 0])))
query("smp08_custom_ratios", _resampled_sql("CASE label WHEN 0 THEN 600 WHEN 1 THEN 250 ELSE 150 END"))(_resampled(lambda c: P.ratio_targets(c, {0: 60, 1: 25, 2: 15}, 1000)))
query("smp09_minority_boost", _resampled_sql("CASE label WHEN 0 THEN 8000 ELSE 2000 END"))(_resampled(lambda c: P.minority_boost_targets(c, 9000)))
query("smp10_balanced", _resampled_sql("300"))(_resampled(lambda c: P.balanced_targets(c, 900)))
query("smp11_proportional", _resampled_sql("floor(least(greatest(1000.0::DOUBLE * n / (SELECT count(*) FROM " + _RARE + "), least(100, n)), 800, n))::BIGINT"))(_resampled(lambda c: P.proportional_targets(c, 1000)))


_SPLIT = """WITH r AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    c AS (SELECT event_type, min(ts) AS cutoff FROM r WHERE r = n - floor(n * 0.1::DOUBLE)::BIGINT GROUP BY 1), x AS (SELECT event_id, events.event_type, ts, cutoff, CASE WHEN ts >= cutoff THEN 'test' ELSE 'train' END AS split FROM events LEFT JOIN c USING (event_type))"""


@query("spl01_class_time_split", f"{_SPLIT} SELECT event_id, split FROM x")
def _(s, d):
    return P.class_time_split(table(s, d, "events"), "event_type", "ts").select("event_id", "split")


@query("spl02_split_report", f"{_SPLIT} SELECT split, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, max(cutoff) AS cutoff FROM x GROUP BY 1, 2")
def _(s, d):
    return P.split_report(P.class_time_split(table(s, d, "events"), "event_type", "ts"), "event_type", "ts")


@query(
    "spl03_class_random_split",
    "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r",
)
def _(s, d):
    return P.class_random_split(table(s, d, "events"), "event_type", "event_id", 0.2).select("event_id", "split")


@query(
    "spl05_day_groups",
    """WITH d AS (SELECT day, ((row_number() OVER (ORDER BY day) - 1) // 7)::INTEGER AS g FROM (SELECT DISTINCT ts::DATE AS day FROM events)), w AS (SELECT g FROM d GROUP BY 1 HAVING count(*) = 7)
    SELECT event_id, d.day, g AS day_group FROM events JOIN d ON ts::DATE = d.day WHERE g IN (SELECT g FROM w)""",
)
def _(s, d):
    return P.day_groups(table(s, d, "events"), "ts", 7).select("event_id", "day", "day_group")


@query(
    "bal01_imbalance",
    f"""WITH c AS (SELECT label, count(*) AS n FROM {_RARE} GROUP BY 1), m AS (SELECT max(n)::DOUBLE / min(n) AS ratio, sum(n) AS total FROM c)
    SELECT label, n, 100.0::DOUBLE * n / total AS pct, ratio, CASE WHEN ratio < 3 THEN 'balanced' WHEN ratio < 10 THEN 'mild' WHEN ratio < 100 THEN 'moderate' WHEN ratio < 1000 THEN 'severe' ELSE 'extreme' END AS severity FROM c, m""",
)
def _(s, d):
    return B.imbalance(rare(s, d), "label")


query("bal03_pre_reduction", _resampled_sql("CASE label WHEN 2 THEN n WHEN 0 THEN least(n, 100 * (SELECT count(*) FROM " + _RARE + " WHERE label = 2), 50000) ELSE least(n, 5 * (SELECT count(*) FROM " + _RARE + " WHERE label = 2)) END"))(_resampled(B.reduction_targets))
query("bal05_undersampling", _resampled_sql("least(n, 5 * (SELECT count(*) FROM " + _RARE + " WHERE label = 2))"))(_resampled(lambda c: B.undersampling_targets(c, 5)))


@query("bal04_adaptive_oversampling")
def _(s, d):
    df = rare(s, d).withColumn("x", F.col("id").cast("double"))
    return B.oversample(df, "label", "id", ["x"], B.oversampling_targets(P.class_counts(df, "label")))


@query("bal06_smote")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"))
    return B.smote(o, "o_orderkey", ["x", "y"], 400)


@query(
    "bal07_class_weights",
    f"WITH c AS (SELECT label, count(*) AS n FROM {_RARE} GROUP BY 1) SELECT id, r.label, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM {_RARE} r JOIN c ON c.label = r.label",
)
def _(s, d):
    return B.class_weights(rare(s, d).select("id", "label"), "label")


@query(
    "bal08_before_after",
    f"WITH c AS (SELECT label, count(*) AS n FROM {_RARE} GROUP BY 1) SELECT label, n AS n_before, least(n, 5 * (SELECT min(n) FROM c)) AS n_after FROM c",
)
def _(s, d):
    df = rare(s, d).select("id", "label")
    return B.before_after(df, P.resample(df, "label", "id", B.undersampling_targets(P.class_counts(df, "label"), 5)), "label")


@query(
    "bal09_boosted_weights",
    f"WITH c AS (SELECT label, count(*) AS n FROM {_RARE} GROUP BY 1) SELECT label, least((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) * CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 3.0 END, 100) AS weight FROM c",
)
def _(s, d):
    w = B.class_weights(rare(s, d).select("id", "label"), "label", boosts={0: 1.0, 1: 1.5, 2: 3.0}, cap=100.0)
    return w.select("label", "weight").distinct()
