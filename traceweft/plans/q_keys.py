"""Queries of joins, de-duplication, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import dedup as D
from traceweft.operators import joins as J
from traceweft.plans.registry import query, table


def _pairs(s, d):
    """Lines and orders on one key name; some orders and some lines are left out so that both sides have strays."""
    lines = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "k").where("k % 11 <> 0")
    orders = table(s, d, "orders").withColumnRenamed("o_orderkey", "k").where("k % 13 <> 0")
    return lines, orders


_L = "(SELECT l_orderkey AS k, * FROM lineitem WHERE l_orderkey % 11 <> 0)"
_O = "(SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 13 <> 0)"


@query("jon01_suffix_join", f"SELECT l.k, l_linenumber, l_quantity, o_orderstatus AS o_orderstatus_b, o_orderdate AS o_orderdate_b FROM {_L} l JOIN {_O} o ON l.k = o.k")
def _(s, d):
    lines, orders = _pairs(s, d)
    return J.suffix_join(lines.select("k", "l_linenumber", "l_quantity"), orders.select("k", "o_orderstatus", "o_orderdate"), ["k"])


@query("jon02_unmatched_left", f"SELECT k, l_linenumber, l_quantity FROM {_L} WHERE k NOT IN (SELECT k FROM {_O})")
def _(s, d):
    lines, orders = _pairs(s, d)
    return lines.join(orders, "k", "left_anti").select("k", "l_linenumber", "l_quantity")


@query("jon03_unmatched_right", f"SELECT k, o_orderstatus FROM {_O} WHERE k NOT IN (SELECT k FROM {_L})")
def _(s, d):
    lines, orders = _pairs(s, d)
    return orders.join(lines, "k", "left_anti").select("k", "o_orderstatus")


@query("jon04_matched_timestamps", f"SELECT l.k, l_linenumber, l_shipdate, o_orderdate FROM {_L} l JOIN {_O} o ON l.k = o.k")
def _(s, d):
    lines, orders = _pairs(s, d)
    return lines.join(orders, "k").select("k", "l_linenumber", "l_shipdate", "o_orderdate")


@query(
    "jon05_balanced_merge",
    """WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1)
    SELECT o_orderkey AS k, o_orderstatus, l_partkey, l_quantity FROM orders JOIN m ON l_orderkey = o_orderkey""",
)
def _(s, d):
    m = D.keep_latest(table(s, d, "lineitem"), ["l_orderkey"], "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return table(s, d, "orders").withColumnRenamed("o_orderkey", "k").join(m.withColumnRenamed("l_orderkey", "k"), "k").select("k", "o_orderstatus", "l_partkey", "l_quantity")


@query("jon06_pruned_join", "SELECT l_orderkey, l_linenumber, l_quantity, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (1, 2, 3)")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "supplier").where("s_nationkey in (1, 2, 3)"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_quantity", "s_name")


@query(
    "jon07_star_join",
    f"""SELECT o.k, count(l.k) AS n_lines, count(c_custkey) AS n_customers FROM {_O} o LEFT JOIN {_L} l ON l.k = o.k
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey GROUP BY o.k""",
)
def _(s, d):
    lines, orders = _pairs(s, d)
    n = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n_lines"))
    c = table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("has"))
    per = orders.join(n, "k", "left").join(c, "o_custkey", "left")
    lines_of = F.coalesce("n_lines", F.lit(0))
    return per.groupBy("k").agg(F.sum(lines_of).alias("n_lines"), F.sum(F.coalesce("has", F.lit(0)) * F.greatest(lines_of, F.lit(1))).alias("n_customers"))


_NEAR = "SELECT a.event_id, b.event_id AS other_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(date_diff('seconds', a.ts, b.ts)) <= 300"


def _near(s, d, bucketed):
    a = table(s, d, "events").select("event_id", "user_id", "ts")
    b = a.select(F.col("event_id").alias("other_id"), F.col("user_id").alias("other_user"), F.col("ts").alias("other_ts"))
    b = b.withColumn("user_id", F.col("other_user"))
    out = J.interval_join(a, b, ["user_id"], "ts", "other_ts", 300, bucketed=bucketed, extra=F.col("event_id") != F.col("other_id"))
    return out.select("event_id", "other_id")


@query("jon08_interval_join", _NEAR)
def _(s, d):
    return _near(s, d, False)


@query("jon08_interval_join_bucketed", _NEAR)
def _(s, d):
    return _near(s, d, True)


@query("jon10_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def _(s, d):
    dim = table(s, d, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup(table(s, d, "customer"), dim, "c_nationkey", "n_name", "unknown").select("c_custkey", "n_name")


@query(
    "jon11_key_sets",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 20), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 30)
    SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS "both",
    (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b""",
)
def _(s, d):
    e = table(s, d, "events")
    return J.key_sets(e.where("event_type = 'error' and value > 20"), e.where("event_type = 'click' and value > 30"), "user_id")


@query(
    "agg29_join_summary",
    f"""WITH l AS (SELECT k, count(*) AS n FROM {_L} GROUP BY k), o AS (SELECT k, count(*) AS n FROM {_O} GROUP BY k), f AS (SELECT l.n AS l, o.n AS r FROM l FULL JOIN o USING (k))
    SELECT metric, value FROM (SELECT sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(l) AS left_keys, count(r) AS right_keys, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common_keys,
    coalesce(sum(l) FILTER (WHERE r IS NULL), 0)::BIGINT AS unmatched_left, coalesce(sum(r) FILTER (WHERE l IS NULL), 0)::BIGINT AS unmatched_right, sum(l * r)::BIGINT AS joined_rows FROM f)
    UNPIVOT (value FOR metric IN (left_rows, right_rows, left_keys, right_keys, common_keys, unmatched_left, unmatched_right, joined_rows))""",
)
def _(s, d):
    return J.join_summary(*_pairs(s, d), ["k"])


@query("dup01_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def _(s, d):
    return D.keep_first(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("dup02_keep_latest", "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey) AS r FROM lineitem) WHERE r = 1")
def _(s, d):
    return D.keep_latest(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_shipdate")


@query(
    "dup03_fuzzy_keys",
    """WITH RECURSIVE k AS (SELECT regexp_replace(host, '^(www|m|blog)[.]', '') AS k, count(*) AS n FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY 1),
    p AS (SELECT k, n, ' ' || lower(trim(k)) || ' ' AS t FROM k),
    g AS (SELECT DISTINCT k, substr(t, i, m) AS gram FROM p, range(2, 5) AS a(m), range(1, 200) AS b(i) WHERE i <= greatest(length(t) - m + 1, 1)),
    z AS (SELECT k, count(*) AS z FROM g GROUP BY k),
    link AS (SELECT x.k AS a, y.k AS b FROM g x JOIN g y USING (gram) JOIN z zx ON zx.k = x.k JOIN z zy ON zy.k = y.k WHERE x.k <> y.k GROUP BY x.k, y.k, zx.z, zy.z HAVING count(*) >= 0.8 * (zx.z + zy.z - count(*))),
    reach AS (SELECT k AS a, k AS b FROM k UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
    SELECT a AS key, arg_min(b, (-n, b)) AS canonical FROM reach JOIN k ON k.k = b GROUP BY a""",
)
def _(s, d):
    host = F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "^(www|m|blog)[.]", "")
    return D.fuzzy_keys(table(s, d, "pages").select(host.alias("host")), "host")


@query("dup04_distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").dropDuplicates()


@query("dup05_repeats_per_key", "SELECT l_orderkey, sum(n)::BIGINT AS n_duplicate_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def _(s, d):
    return D.repeats_per_key(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("dup06_duplicate_share", "SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates, 100.0::DOUBLE * sum(n - 1) / sum(n) AS pct FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(s, d):
    return D.duplicate_share(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("srt01_by_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def _(s, d):
    return table(s, d, "events").select("event_id", "ts").orderBy("ts", "event_id")


@query("srt02_by_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query("srt03_top10", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("srt04_top_k_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(20)


@query("srt05_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@query("set01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name")))


@query("set02_ragged_union", "SELECT n_name AS name, n_regionkey AS region, NULL::BIGINT AS balance FROM nation UNION ALL SELECT s_name, NULL, s_suppkey FROM supplier")
def _(s, d):
    a = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("balance")), allowMissingColumns=True)


@query("set03_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(s, d):
    x = table(s, d, "lineitem")
    return x.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(x.where("l_quantity > 45").select("l_partkey"))


@query("set04_difference", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(s, d):
    x = table(s, d, "lineitem")
    return x.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct().join(x.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), "k", "left_anti")
