"""Queries of projections, column operations, casts and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import columns as C
from traceweft.operators import filters as L
from traceweft.plans.registry import query, table


@query("prj01_columns_containing", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders")
def _(s, d):
    return C.keep_containing(table(s, d, "orders"), ["key", "order"]).drop("o_totalprice")


@query("prj02_drop_if_exists", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(s, d):
    return C.drop_if_exists(table(s, d, "orders"), "o_orderpriority", "no_such_column").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("prj03_suffix", "SELECT o_orderkey, o_custkey AS o_custkey_b, o_orderstatus AS o_orderstatus_b FROM orders")
def _(s, d):
    return C.suffixed(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], "_b")


@query("prj04_clean_names", 'SELECT r_regionkey AS region_key, r_name AS region_key_1, r_regionkey AS "50_share" FROM region')
def _(s, d):
    r = table(s, d, "region")
    return C.with_clean_names(r.select(F.col("r_regionkey").alias(" Region Key"), F.col("r_name").alias("region-key"), F.col("r_regionkey").alias("50% share")))


@query("prj05_safe_access", "SELECT c_custkey, c_acctbal AS balance, 'none' AS grade FROM customer")
def _(s, d):
    c = table(s, d, "customer")
    return c.select("c_custkey", C.column_or(c, "C_ACCTBAL").alias("balance"), C.column_or(c, "grade", "none").alias("grade"))


@query(
    "prj06_parsing",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE ts END AS parsed, CASE WHEN user_id % 4 < 2 THEN 1 ELSE 0 END::TINYINT AS flag,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id::DOUBLE END AS number, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS text FROM events""",
)
def _(s, d):
    u = F.col("user_id")
    e = table(s, d, "events").select(
        "event_id",
        F.when(u % 3 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("stamp"),
        F.element_at(F.array(*[F.lit(x) for x in ("Yes", " TRUE ", "no", "maybe")]), (u % 4 + 1).cast("int")).alias("flag"),
        F.when(u % 5 == 0, F.lit("n/a")).otherwise(u.cast("string")).alias("number"),
        F.when(u % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in C.BLANKS]), (u % 9 / 3 + 1).cast("int"))).otherwise(F.col("event_type")).alias("text"),
    )
    return e.select("event_id", C.to_utc(F.col("stamp")).cast("timestamp_ntz").alias("parsed"), C.to_flag(F.col("flag")).alias("flag"), C.to_number(F.col("number")).alias("number"), C.blank_to_null(F.col("text")).alias("text"))


@query("prj10_sentinels", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'unlabeled') AS event_type, coalesce(nullif(user_id, 3), -999) AS user_id FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.nullif("user_id", F.lit(3)).alias("user_id"))
    return C.fill_sentinels(e)


@query("prj11_flags_to_text", "SELECT event_id, CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS high FROM events")
def _(s, d):
    return C.flags_to_text(table(s, d, "events").select("event_id", (F.col("value") > 10).alias("high")))


@query("prj12_downcast", "SELECT p_partkey::SMALLINT AS p_partkey, p_size::TINYINT AS p_size FROM part")
def _(s, d):
    return C.downcast(table(s, d, "part").select("p_partkey", "p_size"))


@query("prj13_binary_target", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 IN (1, 2) THEN 1 ELSE 0 END AS target FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", C.binary_target(F.col("o_orderkey") % 3).alias("target"))


@query("prj14_dense_codes", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END NULLS LAST) - 1 END AS code FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("p"))
    return C.dense_codes(o, "p", "code").select("o_orderkey", F.col("code").cast("long").alias("code"))


@query(
    "prj15_equal_width_bins",
    "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, greatest(least(ceil((o_totalprice - lo) / ((hi - lo) / 10)) - 1, 9), 0)::INTEGER AS bin FROM orders, b",
)
def _(s, d):
    o = table(s, d, "orders")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return o.join(F.broadcast(ends)).select("o_orderkey", C.equal_width_bins(F.col("o_totalprice"), F.col("lo"), F.col("hi"), 10).alias("bin"))


@query(
    "prj16_time_between",
    "SELECT l_orderkey, l_linenumber, l_quantity, (epoch(l_shipdate) - epoch(o_orderdate))::DOUBLE AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_quantity", C.seconds_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))


@query("prj17_text_megabytes", "SELECT sum(length(p_name) + length(p_brand) + length(p_type)) / 1e6 AS megabytes FROM part")
def _(s, d):
    return C.text_megabytes(table(s, d, "part"), ["p_name", "p_brand", "p_type"])


@query("prj18_drop_null_columns", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    return C.drop_null_columns(table(s, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("int").alias("empty")))


@query("prj19_target_first", "SELECT s_name, s_acctbal, s_nationkey, s_suppkey FROM supplier")
def _(s, d):
    return C.target_first(table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_name")


@query("prj20_common_columns", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(s, d):
    a = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), "n_regionkey")
    b = table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    x, y = C.common_columns(a, b)
    return x.unionByName(y)


@query("prj21_set_flags", "SELECT event_id, (event_type = 'error')::INT + (value > 10)::INT + (user_id % 2 = 0)::INT AS flags FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_type") == "error").alias("a"), (F.col("value") > 10).alias("b"), (F.col("user_id") % 2 == 0).alias("c"))
    return e.select("event_id", C.set_flags(["a", "b", "c"]).alias("flags"))


@query("flt01_label", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def _(s, d):
    return table(s, d, "events").where(F.col("event_type") == "error").select("event_id", "user_id")


@query("flt02_between", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def _(s, d):
    return table(s, d, "events").where("ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-09'").select("event_id")


@query("flt03_not_in", "SELECT event_id FROM events WHERE coalesce(nullif(event_type, 'view'), '') NOT IN ('click', 'error')")
def _(s, d):
    return table(s, d, "events").where(L.not_in(F.nullif("event_type", F.lit("view")), ["click", "error"])).select("event_id")


@query("flt04_semi_join", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(s, d):
    keys = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return L.only_keys(table(s, d, "lineitem"), keys, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt05_is_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def _(s, d):
    return table(s, d, "orders").where(F.nullif("o_orderstatus", F.lit("P")).isNull()).select("o_orderkey")


@query("flt06_whole_and_not", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity % 1 = 0 AND l_quantity <> 1 AND l_quantity <> -999")
def _(s, d):
    return table(s, d, "lineitem").where(L.whole_and_not(F.col("l_quantity"), 1)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt07_quality_counts", "SELECT count(*) FILTER (WHERE value % 1 <> 0) AS fractions, count(*) FILTER (WHERE nullif(event_type, 'error') IS NULL) AS missing FROM events")
def _(s, d):
    return table(s, d, "events").agg(F.count_if(F.col("value") % 1 != 0).alias("fractions"), F.count_if(F.nullif("event_type", F.lit("error")).isNull()).alias("missing"))


@query("flt08_checked_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def _(s, d):
    return L.within_span(table(s, d, "events"), "ts", "2024-01-10", "2024-01-20").select("event_id")


@query("flt09_days", "SELECT event_id FROM events WHERE cast(ts AS DATE) IN (DATE '2024-01-02', DATE '2024-01-11')")
def _(s, d):
    return table(s, d, "events").where(L.on_days(F.col("ts"), ["2024-01-02", "2024-01-11"])).select("event_id")


_LIMITS = "SELECT p_partkey, nullif(p_size, 7) AS lo, nullif(p_size + 5, 20) AS hi, nullif(p_brand, 'Brand#1') AS unit, nullif(p_type, 'PROMO') AS kind FROM part"


@query("flt10_valid_limits", f"SELECT p_partkey FROM ({_LIMITS}) WHERE lo IS NOT NULL AND hi IS NOT NULL AND (unit IS NOT NULL OR kind IS NOT NULL)")
def _(s, d):
    p = table(s, d, "part")
    return p.where(L.valid_limits(F.nullif("p_size", F.lit(7)), F.nullif(F.col("p_size") + 5, F.lit(20)), F.nullif("p_brand", F.lit("Brand#1")), F.nullif("p_type", F.lit("PROMO")))).select("p_partkey")


@query("flt11_valid_target", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(s, d):
    return table(s, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("flt12_drop_any_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND nullif(o_custkey % 7, 0) IS NOT NULL")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("b"))
    return o.na.drop("any").select("o_orderkey")


@query("flt13_exclude_keys", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def _(s, d):
    e = table(s, d, "events")
    return L.exclude_keys(e, e.where("event_type = 'error' and value > 50"), ["user_id"]).select("event_id")
