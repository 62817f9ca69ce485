"""Queries of profiling, data quality, encoding and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import encode as N
from traceweft.operators import profile as P
from traceweft.operators.columns import suffixed
from traceweft.plans.registry import query, table

#: Orders with nulls put in, as Spark columns and as SQL.
_HOLES = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '1-URGENT') AS priority, nullif(o_custkey % 50, 7) AS cust FROM orders)"


def holes(s, d):
    return table(s, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("cust"))


_COLS = ("status", "priority", "cust")


@query("agg22_null_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_pct FROM {_HOLES}" for c in _COLS))
def _(s, d):
    return P.null_counts(holes(s, d).select(*_COLS))


@query("agg23_cardinality", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM {_HOLES}" for c in _COLS))
def _(s, d):
    return P.profile(holes(s, d), list(_COLS)).select("column", "n_distinct")


@query("agg26_sparsity", f"SELECT round(100.0::DOUBLE * sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) / count(*), 2) AS status_sparsity FROM {_HOLES}")
def _(s, d):
    return holes(s, d).agg(F.round(100.0 * F.count_if(F.col("status").isNull()) / F.count(F.lit(1)), 2).alias("status_sparsity"))


@query(
    "prf02_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS n_null, count(v) AS n_distinct, arg_min(v, (-n, v)) FILTER (WHERE v IS NOT NULL) AS top, coalesce(max(n) FILTER (WHERE v IS NOT NULL), 0) AS top_n,
    100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE v IS NULL), 0) / sum(n) AS null_pct, count(v)::DOUBLE / sum(n) FILTER (WHERE v IS NOT NULL) AS uniqueness, count(v) <= 1 AS constant FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {_HOLES} GROUP BY 1)"""
        for c in _COLS
    ),
)
def _(s, d):
    return P.profile(holes(s, d), list(_COLS))


@query("prf03_mixed_types", "SELECT 'text' AS \"column\", avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS numeric_share, true AS mixed FROM events")
def _(s, d):
    e = table(s, d, "events").select(F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("text"))
    return P.mixed_types(e, ["text"])


def facts(columns: dict[str, str], source: str) -> str:
    """SQL of one row for each column: rows, nulls, distinct values, null percentage, uniqueness."""
    one = lambda name, x: f"SELECT '{name}' AS \"column\", count(*) AS n, count(*) - count({x}) AS n_null, count(DISTINCT {x}) AS d FROM {source}"
    return f"(SELECT *, 100.0::DOUBLE * n_null / n AS pct, coalesce(d::DOUBLE / nullif(n - n_null, 0), 0) AS u FROM ({' UNION ALL '.join(one(*c) for c in columns.items())}))"


_ODD = facts({"o_orderkey": "o_orderkey", "status": "status", "one": "1", "none": "NULL::INTEGER"}, _HOLES)


@query(
    "prf05_quality_issues",
    f"""WITH f AS (SELECT * FROM {_ODD}) SELECT 'constant' AS issue, "column" FROM f WHERE d <= 1 UNION ALL SELECT 'all_null', "column" FROM f WHERE n = n_null
    UNION ALL SELECT 'high_missing', "column" FROM f WHERE n - n_null BETWEEN 1 AND 9999 UNION ALL SELECT 'high_cardinality', "column" FROM f WHERE d > 1000""",
)
def _(s, d):
    h = holes(s, d).select("o_orderkey", "status", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"))
    return P.issues(P.profile(h), 10_000)


_TEXTS = {"order_id": "o_orderkey::VARCHAR", "day": "strftime(o_orderdate, '%Y-%m-%d')", "num": "(o_custkey % 9)::VARCHAR", "one": "'x'"}


@query(
    "prf11_encoding_issues",
    f"""WITH f AS (SELECT * FROM {facts(_TEXTS, 'orders')}), t AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, avg((TRY_CAST({x} AS DOUBLE) IS NOT NULL)::INT) AS num, avg(regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')::INT) AS dated FROM orders" for c, x in _TEXTS.items())})
    SELECT "column", 'constant' AS issue FROM f WHERE d <= 1 UNION ALL SELECT "column", 'mostly_missing' FROM f WHERE pct > 80 UNION ALL SELECT "column", 'identifier' FROM f WHERE regexp_matches("column", 'id|key|number|serial|uuid') AND u > 0.95
    UNION ALL SELECT c, 'numeric_text' FROM t WHERE num = 1 UNION ALL SELECT c, 'mixed' FROM t WHERE num > 0 AND num < 1 UNION ALL SELECT c, 'date_like' FROM t WHERE dated > 0.8""",
)
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_custkey") % 9).cast("string").alias("num"), F.lit("x").alias("one"))
    return P.encoding_issues(o, P.profile(o))


@query(
    "prf13_bands",
    f"""SELECT CASE WHEN d <= 2 THEN 'binary' WHEN d <= 10 THEN 'low' WHEN d <= 100 THEN 'medium' WHEN d <= 1000 THEN 'high' ELSE 'very_high' END AS cardinality,
    CASE WHEN pct = 0 THEN 'none' WHEN pct <= 5 THEN 'low' WHEN pct <= 20 THEN 'medium' ELSE 'high' END AS missing, count(*) AS n_columns FROM {facts({c: c for c in _COLS}, _HOLES)} GROUP BY 1, 2""",
)
def _(s, d):
    return P.bands(P.profile(holes(s, d), list(_COLS)))


@query(
    "prf14_quality_score",
    f"""WITH h AS (SELECT status, priority FROM {_HOLES}), g AS (SELECT *, count(*) AS n FROM h GROUP BY ALL)
    SELECT 100 * (1 - ((count(*) - count(status)) + (count(*) - count(priority)))::DOUBLE / (2 * count(*))) AS completeness,
    ((count(*) - count(status)) * 100.0 / count(*) > 20)::INT::BIGINT + ((count(*) - count(priority)) * 100.0 / count(*) > 20)::INT::BIGINT AS n_sparse,
    (SELECT 100.0::DOUBLE * sum(n - 1) / sum(n) FROM g) AS duplicate_pct, (SELECT 100.0::DOUBLE * sum(n - 1) / sum(n) FROM g) > 5 AS many_duplicates FROM h""",
)
def _(s, d):
    h = holes(s, d).select("status", "priority")
    return P.quality_score(h, P.profile(h))


_PROBLEMS = facts({"o_orderkey": "o_orderkey", "status": "status", "one": "1", "none": "NULL::INTEGER", "cust": "cust", "book_state": "0"}, _HOLES)


@query("prf18_problematic", f"SELECT \"column\" FROM {_PROBLEMS} WHERE (\"column\" = 'cust' OR pct > 98 OR d <= 1) AND \"column\" <> 'book_state'")
def _(s, d):
    h = holes(s, d).select("o_orderkey", "status", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"), "cust", F.lit(0).alias("book_state"))
    return P.problematic(P.profile(h), ["cust"])


@query(
    "prf19_harmonised",
    f"""WITH m AS (SELECT median(cust) AS med FROM {_HOLES}) SELECT o_orderkey, coalesce(cust::DOUBLE, med) AS cust, coalesce(priority, 'MISSING') AS priority FROM {_HOLES}, m WHERE o_orderkey % 2 = 0""",
)
def _(s, d):
    h = holes(s, d)
    train, _test = P.harmonised(h.where("o_orderkey % 2 = 0").drop("status"), h.where("o_orderkey % 2 = 1"), "o_orderkey")
    return train


@query(
    "prf20_compare_missing",
    f"""SELECT 'status' AS "column", a AS a_pct, b AS b_pct, abs(a - b) AS difference FROM (SELECT 100.0::DOUBLE * (count(*) - count(status)) / count(*) AS a FROM {_HOLES} WHERE o_orderkey % 2 = 0), (SELECT 100.0::DOUBLE * (count(*) - count(status)) / count(*) AS b FROM {_HOLES} WHERE o_orderkey % 2 = 1)""",
)
def _(s, d):
    h = holes(s, d)
    return P.compare_missing(h.where("o_orderkey % 2 = 0").select("status", "cust"), h.where("o_orderkey % 2 = 1").select("status"))


@query(
    "prf21_row_similarity",
    f"SELECT a.o_orderkey, ((a.status IS NOT DISTINCT FROM b.status)::INT + (a.priority IS NOT DISTINCT FROM b.priority)::INT + (a.cust IS NOT DISTINCT FROM b.cust)::INT) / 3.0::DOUBLE AS similarity FROM {_HOLES} a JOIN {_HOLES} b ON b.o_orderkey = a.o_orderkey + 1",
)
def _(s, d):
    h = holes(s, d)
    j = h.alias("a").join(h.alias("b"), F.col("b.o_orderkey") == F.col("a.o_orderkey") + 1)
    return j.select(F.col("a.o_orderkey"), P.row_similarity(list(_COLS), "a", "b").alias("similarity"))


@query(
    "prf22_ks_distance",
    """WITH u AS (SELECT o_totalprice AS x, (o_orderkey % 2 = 0)::INT AS a, (o_orderkey % 2 = 1)::INT AS b FROM orders), st AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1), z AS (SELECT sum(a) AS na, sum(b) AS nb FROM u),
    r AS (SELECT sum(a) OVER (ORDER BY x) AS ra, sum(b) OVER (ORDER BY x) AS rb FROM st) SELECT na::BIGINT AS na, nb::BIGINT AS nb, max(abs(ra::DOUBLE / na - rb::DOUBLE / nb)) AS ks FROM r, z GROUP BY 1, 2""",
)
def _(s, d):
    o = table(s, d, "orders")
    return P.ks_distance(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_totalprice")


@query("prf23_sensor_health", "SELECT 'value' AS \"column\", var_samp(value) AS variance, count(DISTINCT value)::DOUBLE / count(value) AS unique_ratio, CASE WHEN var_samp(value) < 1e-6 OR count(DISTINCT value)::DOUBLE / count(value) < 1e-4 THEN 'Stuck' WHEN count(DISTINCT value)::DOUBLE / count(value) > 0.01 THEN 'Healthy' ELSE 'Monitor' END AS health FROM events UNION ALL SELECT 'flat', 0, 1.0::DOUBLE / count(*), 'Stuck' FROM events")
def _(s, d):
    return P.sensor_health(table(s, d, "events").select("value", F.lit(3.0).alias("flat")), ["value", "flat"])


@query("enc02_kfold_target", """WITH x AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS t, o_orderkey % 5 AS f FROM orders), p AS (SELECT c, f, count(t) AS n, sum(t) AS s FROM x GROUP BY 1, 2), a AS (SELECT c, sum(n) AS n, sum(s) AS s FROM p GROUP BY 1)
    SELECT o_orderkey, (a.s - p.s) / (a.n - p.n) AS enc FROM x JOIN p USING (c, f) JOIN a USING (c)""")
def _(s, d):
    o = table(s, d, "orders")
    return N.kfold_target(o, "o_orderpriority", "o_totalprice", F.col("o_orderkey") % 5, 5).select("o_orderkey", F.col("o_orderpriority_enc").alias("enc"))


@query("enc03_catboost_like", "WITH g AS (SELECT avg(o_totalprice) AS g FROM orders), m AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderkey, (s + g) / (n + 1) AS enc FROM orders JOIN m USING (o_custkey), g")
def _(s, d):
    return N.noisy_target(table(s, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_orderkey", F.col("o_custkey_enc").alias("enc"))


@query("enc04_smoothed_target", "WITH g AS (SELECT avg(o_totalprice) AS g FROM orders), m AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN n >= 10 THEN (s + 100 * g) / (n + 100) ELSE g END AS enc FROM orders JOIN m USING (o_custkey), g")
def _(s, d):
    return N.smoothed_target(table(s, d, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", F.col("o_custkey_enc").alias("enc"))


@query("enc05_ordinal", f"SELECT o_orderkey, CASE WHEN priority IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY priority NULLS LAST) - 1 END AS enc FROM {_HOLES}")
def _(s, d):
    return N.ordinal(holes(s, d), "priority").select("o_orderkey", F.col("priority_enc").cast("long").alias("enc"))


@query("enc06_binary", f"SELECT o_orderkey, (status <> (SELECT min(status) FROM {_HOLES}))::INT AS enc FROM {_HOLES}")
def _(s, d):
    return N.binary_codes(holes(s, d), "status").select("o_orderkey", F.col("status_enc").alias("enc"))


@query("enc07_standard_scaling", "SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS enc FROM orders")
def _(s, d):
    return N.standard_scaled(table(s, d, "orders"), "o_totalprice").select("o_orderkey", F.col("o_totalprice_enc").alias("enc"))


@query("enc08_robust_scaling", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, median(o_totalprice) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, (o_totalprice - b) / (c - a) AS enc FROM orders, q")
def _(s, d):
    return N.robust_scaled(table(s, d, "orders"), "o_totalprice").select("o_orderkey", F.col("o_totalprice_enc").alias("enc"))


@query("enc09_numeric_preserve", f"SELECT o_orderkey, coalesce(cust::DOUBLE, (SELECT median(cust) FROM {_HOLES})) AS enc FROM {_HOLES}")
def _(s, d):
    return N.numeric_preserved(holes(s, d), "cust").select("o_orderkey", F.col("cust_enc").alias("enc"))


@query(
    "enc10_missing_treatment",
    """SELECT n::BIGINT AS n, pct, num, CASE WHEN n = 0 THEN 'none' WHEN pct > 95 THEN 'drop_feature' WHEN n > 1000000 OR pct > 50 THEN (CASE WHEN num THEN 'flag_and_median' ELSE 'special_category' END)
    WHEN n > 100000 OR pct > 20 THEN (CASE WHEN num THEN 'median' ELSE 'special_category' END) ELSE (CASE WHEN num THEN 'median' ELSE 'mode' END) END AS treatment
    FROM (SELECT unnest([0, 50, 20000, 200000, 2000000]) AS n), (SELECT unnest([1.0::DOUBLE, 30.0, 60.0, 96.0]) AS pct), (SELECT unnest([true, false]) AS num)""",
)
def _(s, d):
    one = s.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 50, 20_000, 200_000, 2_000_000)])).alias("n"))
    grid = one.select("n", F.explode(F.array(*[F.lit(x) for x in (1.0, 30.0, 60.0, 96.0)])).alias("pct")).select("n", "pct", F.explode(F.array(F.lit(True), F.lit(False))).alias("num"))
    return grid.withColumn("treatment", N.missing_treatment(F.col("n"), F.col("pct"), F.col("num")))


@query("enc11_treat_missing", f"SELECT o_orderkey, coalesce(priority, (SELECT arg_min(p, (-n, p)) FROM (SELECT priority AS p, count(*) AS n FROM {_HOLES} WHERE priority IS NOT NULL GROUP BY 1))) AS priority, coalesce(cust::DOUBLE, (SELECT median(cust) FROM {_HOLES})) AS cust, (cust IS NULL)::INT AS cust_missing, coalesce(status, 'MISSING') AS status FROM {_HOLES}")
def _(s, d):
    out = N.treat_missing(holes(s, d), "priority", "mode")
    out = N.treat_missing(out, "cust", "flag_and_median")
    return N.treat_missing(out, "status", "special_category").select("o_orderkey", "priority", "cust", "cust_missing", "status")


@query("enc12_preserves_values", "SELECT count(DISTINCT o_orderpriority) AS before, count(DISTINCT o_orderpriority) AS after, true AS preserved FROM orders")
def _(s, d):
    return N.preserves_values(N.ordinal(table(s, d, "orders"), "o_orderpriority"), "o_orderpriority", "o_orderpriority_enc")


@query("enc13_hashed_ngrams")
def _(s, d):
    return table(s, d, "part").select("p_partkey", N.hashed_ngrams(F.col("p_name"), 8).alias("enc"))


@query(
    "enc16_clipped",
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.005) AS a, median(l_extendedprice) AS b, quantile_cont(l_extendedprice, 0.995) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, greatest(least(l_extendedprice, c + 1.5 * (c - a)), a - 1.5 * (c - a)) AS enc FROM lineitem, q",
)
def _(s, d):
    return N.clipped(table(s, d, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice_enc").alias("enc"))


@query("enc16_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O FROM orders")
def _(s, d):
    return N.one_hot(table(s, d, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O")


@query("enc18_cyclical", "SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", *N.cyclical(F.hour("ts"), 24, "hour"))


@query(
    "enc19_examples",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS t, count(*) OVER () AS k FROM c),
    x AS (SELECT *, row_number() OVER (PARTITION BY t <= 3 ORDER BY md5(p_brand), p_brand) AS z FROM r) SELECT p_brand, n FROM x WHERE k <= 5 OR t <= 3 OR z <= 2""",
)
def _(s, d):
    return N.examples(N.ordinal(table(s, d, "part"), "p_brand"), "p_brand", "p_brand_enc").select("p_brand", "n")


@query("ljoin_profile_difference", f"SELECT '{_COLS[0]}' AS \"column\", count(DISTINCT status) AS n_distinct, count(DISTINCT o_orderstatus) AS n_distinct_b FROM {_HOLES} JOIN orders USING (o_orderkey)")
def _(s, d):
    a = P.profile(holes(s, d), ["status"]).select("column", "n_distinct")
    b = P.profile(table(s, d, "orders").select(F.col("o_orderstatus").alias("status"))).select("column", "n_distinct")
    return a.join(suffixed(b, ["column"], "_b"), "column")
