"""Queries of aggregations, reports and ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceweft.operators import aggregates as A
from traceweft.operators import filters as L
from traceweft.operators import ordered as O
from traceweft.plans.registry import query, table

STATES = ["click", "view", "error", "purchase"]


@query("agg01_count_by_label", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg02_key_counts",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS l_partkey_unique, count(l_partkey) AS l_partkey_total, count(DISTINCT l_returnflag) AS l_returnflag_unique, count(l_returnflag) AS l_returnflag_total FROM lineitem GROUP BY 1",
)
def _(s, d):
    return A.key_counts(table(s, d, "lineitem"), "l_suppkey", ["l_partkey", "l_returnflag"])


@query("agg03_distinct_ids", "SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_linenumber) AS lines, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey")
    return g.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"), F.count_distinct("l_linenumber").alias("lines"), F.count(F.lit(1)).alias("n"))


@query(
    "agg04_stacked_counts",
    """SELECT 'l_orderkey' AS type, l_orderkey::VARCHAR AS key, count(DISTINCT l_partkey) AS n_distinct, count(*) AS n_rows FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR, count(DISTINCT l_partkey), count(*) FROM lineitem GROUP BY 2""",
)
def _(s, d):
    return A.stacked_counts(table(s, d, "lineitem"), ["l_orderkey", "l_suppkey"], "l_partkey")


_HIST = "SELECT key, string_agg(value || ':' || n, ';' ORDER BY value) AS histogram, sum(n)::BIGINT AS n_rows, count(*) AS n_values FROM {} GROUP BY key"


@query("agg05_value_histogram", _HIST.format("(SELECT user_id::VARCHAR AS key, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2)"))
def _(s, d):
    return A.value_histogram(table(s, d, "events"), "user_id", "event_type")


@query(
    "agg06_histogram_with_total",
    _HIST.format("(SELECT user_id::VARCHAR AS key, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT 'TOTAL', event_type, count(*) FROM events GROUP BY 2)"),
)
def _(s, d):
    return A.value_histogram(table(s, d, "events"), "user_id", "event_type", total=True)


@query("agg07_combinations", "SELECT l_returnflag, l_linestatus, l_discount, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM lineitem GROUP BY 1, 2, 3")
def _(s, d):
    return A.combinations(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_discount"])


@query(
    "agg08_distinct_tagged",
    """SELECT DISTINCT 'combination' AS kind, p_brand || '|' || p_type AS value FROM part UNION ALL SELECT DISTINCT 'p_brand', p_brand FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part""",
)
def _(s, d):
    return A.distinct_tagged(table(s, d, "part"), ["p_brand", "p_type"])


_PARTS = "(SELECT p_name, nullif(p_size, 7) AS lo, nullif(p_size + 5, 20) AS hi, nullif(p_brand, 'Brand#1') AS unit, nullif(p_type, 'PROMO') AS kind FROM part)"


def _limits(s, d):
    p = table(s, d, "part").select("p_name", F.nullif("p_size", F.lit(7)).alias("lo"), F.nullif(F.col("p_size") + 5, F.lit(20)).alias("hi"), F.nullif("p_brand", F.lit("Brand#1")).alias("unit"), F.nullif("p_type", F.lit("PROMO")).alias("kind"))
    return p, L.valid_limits(F.col("lo"), F.col("hi"), F.col("unit"), F.col("kind"))


@query(
    "agg09_limit_groups",
    f"""WITH t AS (SELECT CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND (unit IS NOT NULL OR kind IS NOT NULL) THEN 'combination' ELSE 'missing_values' END AS category, * FROM {_PARTS}),
    u AS (SELECT category, CASE WHEN category = 'combination' THEN lo::VARCHAR END AS lo, CASE WHEN category = 'combination' THEN unit END AS unit, p_name AS name, count(*) AS n FROM t GROUP BY 1, 2, 3, 4)
    SELECT category, lo, unit, sum(n)::BIGINT AS n_rows, count(name) AS n_names, arg_min(name, (-n, name)) AS mode_name, 100.0::DOUBLE * sum(n) / sum(sum(n)) OVER () AS pct FROM u GROUP BY 1, 2, 3""",
)
def _(s, d):
    p, valid = _limits(s, d)
    return A.limit_groups(p, valid, ["lo", "unit"], "p_name")


@query("agg10_name_frequency", "SELECT p_type, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM part GROUP BY 1")
def _(s, d):
    return A.combinations(table(s, d, "part"), ["p_type"])


@query("agg11_ambiguous_names", "SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes")).where("types > 1")


@query("agg12_group_names", f"SELECT p_name, coalesce(lo::VARCHAR, '-') || '_' || coalesce(hi::VARCHAR, '-') || '_' || coalesce(unit, '-') AS group_name FROM {_PARTS}")
def _(s, d):
    p, _valid = _limits(s, d)
    name = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("lo", "hi", "unit")])
    return p.select("p_name", name.alias("group_name")).orderBy("group_name", "p_name")


@query(
    "agg13_station_metrics",
    "SELECT l_suppkey, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_returnflag)) AS n_distinct, count(*) FILTER (WHERE l_returnflag = 'R') AS labelled FROM lineitem GROUP BY 1",
)
def _(s, d):
    rows = table(s, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("n"))), F.lit(0)).alias("labelled"))


@query(
    "agg14_first_and_last",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_min(event_type, (ts, event_id)) AS first_event_type,
    arg_max(event_id, (ts, event_id)) AS last_event_id, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY 1""",
)
def _(s, d):
    return A.first_and_last(table(s, d, "events"), "user_id", "ts", "event_id", ["event_id", "event_type"])


@query("agg15_unique_ids", "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1")
def _(s, d):
    return table(s, d, "lineitem").select("l_suppkey").distinct().orderBy("l_suppkey")


@query(
    "agg16_crosstab",
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS state_click, count(*) FILTER (WHERE event_type = 'view') AS state_view, count(*) FILTER (WHERE event_type = 'error') AS state_error, count(*) FILTER (WHERE event_type = 'purchase') AS state_purchase, count(*) AS total FROM events GROUP BY 1",
)
def _(s, d):
    return A.crosstab(table(s, d, "events"), "user_id", "event_type", STATES)


@query("agg17_rates", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*) AS \"rate_R\", count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE / count(*) AS \"rate_A\" FROM lineitem GROUP BY 1")
def _(s, d):
    return A.rates(table(s, d, "lineitem"), "l_suppkey", "l_returnflag", ["R", "A"])


@query("agg18_mean_label", "SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS mean_label FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("mean_label")).orderBy(F.desc("mean_label"), "l_suppkey")


@query(
    "agg19_key_classes",
    "WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 220 THEN 'bad' WHEN event_type = 'view' THEN 'seen' ELSE 'good' END AS state FROM events) SELECT user_id, bool_or(state = 'bad') AS marked, bool_and(state = 'good') AS zero_only, count(*) AS n_rows FROM e GROUP BY 1",
)
def _(s, d):
    state = F.when((F.col("event_type") == "error") & (F.col("value") > 220), "bad").when(F.col("event_type") == "view", "seen").otherwise("good")
    return A.key_classes(table(s, d, "events").withColumn("state", state), "user_id", "state", ["bad"], "good")


@query("agg20_state_keys", "SELECT event_type, count(DISTINCT user_id) AS n_keys, count(*) AS n_rows FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_keys"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "agg21_filtered_aggregates",
    "SELECT count(*) FILTER (WHERE l_quantity > 25) AS many, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_discount) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem",
)
def _(s, d):
    return table(s, d, "lineitem").agg(F.count_if(F.col("l_quantity") > 25).alias("many"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.avg("l_discount").alias("mean"), F.stddev_samp("l_quantity").alias("sd"))


@query(
    "agg24_median_block",
    "SELECT median(l_extendedprice) AS med, stddev_pop(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mean FROM lineitem",
)
def _(s, d):
    x = "l_extendedprice"
    return table(s, d, "lineitem").agg(F.median(x).alias("med"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"))


@query("agg27_date_span", "SELECT min(ts) AS first, max(ts) AS last, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n_days, count(DISTINCT ts::DATE) AS n_distinct_days FROM events")
def _(s, d):
    e = table(s, d, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct(F.to_date("ts")).alias("n_distinct_days"))
    return e.select("first", "last", (F.date_diff(F.to_date("last"), F.to_date("first")) + 1).cast("long").alias("n_days"), "n_distinct_days")


_TAB = "SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS s_{x}" for x in STATES) + " FROM events GROUP BY 1"


@query(
    "agg28_exclusion_report",
    f"""WITH tab AS ({_TAB}), q AS (SELECT quantile_cont(s_error, 0.75) + 1.5 * (quantile_cont(s_error, 0.75) - quantile_cont(s_error, 0.25)) AS bound FROM tab),
    m AS (SELECT tab.*, s_error > bound AS gone FROM tab, q),
    r AS (SELECT sum(total) AS before_rows, coalesce(sum(total) FILTER (WHERE NOT gone), 0) AS after_rows, count(*) AS before_keys, count(*) FILTER (WHERE NOT gone) AS after_keys, {", ".join(f"sum(s_{x}) AS before_state_{x}, coalesce(sum(s_{x}) FILTER (WHERE NOT gone), 0) AS after_state_{x}" for x in STATES)} FROM m),
    f AS (SELECT COLUMNS(*)::DOUBLE FROM r)
    SELECT metric, value FROM f UNPIVOT (value FOR metric IN (*))""",
)
def _(s, d):
    return A.exclusion_report(table(s, d, "events"), "user_id", "event_type", STATES, "error")


@query("agg31_missing_flags", "SELECT sum((l_discount = 0)::INT)::BIGINT AS discount_nan, sum((l_tax = 0)::INT)::BIGINT AS tax_nan, count(*) FILTER (WHERE (l_discount = 0)::INT + (l_tax = 0)::INT > 1) AS rows_over FROM lineitem")
def _(s, d):
    f = table(s, d, "lineitem").select((F.col("l_discount") == 0).cast("int").alias("a"), (F.col("l_tax") == 0).cast("int").alias("b"))
    return f.agg(F.sum("a").alias("discount_nan"), F.sum("b").alias("tax_nan"), F.count_if(F.col("a") + F.col("b") > 1).alias("rows_over"))


@query("agg32_known_keys", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON s_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    n = table(s, d, "supplier").where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(s, d, "nation").select("n_nationkey").join(n, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "agg33_per_source_counts",
    """WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS x, count(*) AS n FROM customer GROUP BY 1, 2), b AS (SELECT s_nationkey AS k, s_name AS x, count(*) AS n FROM supplier GROUP BY 1, 2),
    u AS (SELECT 'customers' AS source, * FROM a UNION ALL SELECT 'suppliers', * FROM b)
    SELECT k::VARCHAR AS key, coalesce(sum(n) FILTER (WHERE source = 'customers'), 0)::BIGINT AS customers_rows, coalesce(sum(n - 1) FILTER (WHERE source = 'customers'), 0)::BIGINT AS customers_repeats,
    coalesce(sum(n) FILTER (WHERE source = 'suppliers'), 0)::BIGINT AS suppliers_rows, coalesce(sum(n - 1) FILTER (WHERE source = 'suppliers'), 0)::BIGINT AS suppliers_repeats FROM u GROUP BY 1""",
)
def _(s, d):
    a = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment")
    b = table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    return A.per_source_counts({"customers": a, "suppliers": b}, "k")


@query(
    "win01_rank_bins",
    "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS r, count(*) OVER () AS n FROM events) SELECT event_id, (greatest((10 * (r - 1) + n - 2) // greatest(n - 1, 1), 1) - 1)::INTEGER AS bin FROM r",
)
def _(s, d):
    return table(s, d, "events").select("event_id", O.rank_bins(["value", "event_id"], 10).alias("bin"))


@query("win02_gaps", "SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap_s FROM events")
def _(s, d):
    return O.gaps(table(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "gap_s")


@query(
    "win03_frequency_class",
    """WITH g AS (SELECT user_id, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS gap FROM events),
    c AS (SELECT user_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), m AS (SELECT user_id, arg_min(gap, (-n, gap)) AS gap FROM c GROUP BY 1)
    SELECT user_id, CASE WHEN gap <= 1 THEN 'second' WHEN gap <= 60 THEN 'minute' WHEN gap <= 3600 THEN 'hour' WHEN gap <= 86400 THEN 'day' WHEN gap <= 604800 THEN 'week' WHEN gap <= 2678400 THEN 'month' ELSE 'irregular' END AS frequency FROM m""",
)
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    g = table(s, d, "events").withColumn("sec", seconds).withColumn("gap", F.col("sec") - F.lag("sec").over(w)).where("gap is not null")
    return g.groupBy("user_id").agg(F.mode("gap", True).alias("gap")).select("user_id", O.frequency_class(F.col("gap")).alias("frequency"))


@query(
    "win05_gap_statistics",
    """WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
    SELECT user_id, count(*) AS n_gaps, median(gap) AS median_gap, avg(gap) AS mean_gap, max(gap) > 3 * median(gap) AS has_gaps, greatest(least(100 - 100 * coalesce(stddev_samp(gap), 0) / nullif(avg(gap), 0), 100), 0) AS regularity
    FROM g WHERE gap IS NOT NULL GROUP BY 1""",
)
def _(s, d):
    return O.gap_statistics(table(s, d, "events"), "user_id", "ts", "event_id")


@query("win06_fill_forward", "SELECT event_id, last_value(nullif(event_type, 'error') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def _(s, d):
    e = table(s, d, "events").withColumn("t", F.nullif("event_type", F.lit("error")))
    return e.select("event_id", A.fill_forward(e, "user_id", ["ts", "event_id"], "t").alias("filled"))


@query("win07_business_hours", "WITH a AS (SELECT avg((hour(ts) BETWEEN 8 AND 17)::INT) AS hour_share, avg((isodow(ts) < 6)::INT) AS weekday_share FROM events) SELECT *, hour_share > 0.7 AND weekday_share > 0.7 AS business FROM a")
def _(s, d):
    return O.business_hours(table(s, d, "events"), "ts")


@query("win08_fraction_of_total", "SELECT p_brand, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM part GROUP BY 1")
def _(s, d):
    return A.combinations(table(s, d, "part"), ["p_brand"]).select("p_brand", "pct")


@query("win09_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS avg_rank FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", O.average_rank("p_size").alias("avg_rank"))


@query(
    "win10_running_share",
    "WITH c AS (SELECT p_type, sum(p_retailprice) AS v FROM part GROUP BY 1) SELECT p_type, sum(v) OVER (ORDER BY v DESC, p_type ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS share FROM c",
)
def _(s, d):
    c = table(s, d, "part").groupBy("p_type").agg(F.sum("p_retailprice").alias("v"))
    return c.select("p_type", O.running_share("v", "p_type").alias("share"))
