"""Queries of the readers and writers, and of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import sampling
from traceweft.plans.registry import query, table
from traceweft.sources import readers, writers


@query("src01_parquet_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(s, d):
    return readers.read(s, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderstatus"])


@query("src05_direct_file_sql", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def _(s, d):
    return readers.from_file(s, f"{d}/lineitem.parquet", "l_orderkey, l_quantity", "l_quantity >= 49")


@query("src06_scan_isin", "SELECT event_id, user_id FROM events WHERE user_id IN (1, 5, 9)")
def _(s, d):
    return readers.only(table(s, d, "events").select("event_id", "user_id"), "user_id", [1, 5, 9])


@query("src14_bounded_load", "SELECT event_id, value FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 500")
def _(s, d):
    return readers.bounded(table(s, d, "events"), 500, "event_id").select("event_id", "value")


@query("src15_row_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def _(s, d):
    one = lambda t: table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
    return one("orders").unionByName(one("events"))


@query("src16_peek", "SELECT * FROM part ORDER BY p_partkey LIMIT 20")
def _(s, d):
    return readers.peek(table(s, d, "part"), ["p_partkey"])


@query("src17_row_at", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 137")
def _(s, d):
    return readers.row_at(table(s, d, "orders"), ["o_orderkey"], 137)


@query("src19_catalogue", "SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name AS \"column\" FROM (DESCRIBE SELECT * FROM customer)")
def _(s, d):
    return readers.schema_of(table(s, d, "customer")).select("position", "column")


@query("snk07_joined_lines", "SELECT n_nationkey || '|' || n_name AS value FROM nation")
def _(s, d):
    return writers.lines(table(s, d, "nation"), ["n_nationkey", "n_name"])


@query(
    "fn_scalars",
    """SELECT event_id, abs(date_diff('seconds', ts, TIMESTAMP '2024-01-15 00:00:00')) AS seconds, floor(epoch(ts))::BIGINT AS epoch_s, round(value, 2) AS rounded,
    length(event_type) AS n, upper(event_type) AS up, contains(event_type, 'r') AS has_r, regexp_replace(event_type, '[aeiou]', '', 'g') AS bare,
    cast(ts AS DATE) AS day, hour(ts) AS h, (isodow(ts) - 1) AS wd, CASE WHEN value > 0 THEN log2(value) END AS lg2, CASE WHEN value > 0 THEN log10(value) END AS lg10,
    sqrt(abs(value)) AS root, least(greatest(value, 1), 5) AS clipped, (value % 1 = 0) AS whole, split_part(event_type, '_', 1) AS head FROM events""",
)
def _(s, d):
    e, v = table(s, d, "events"), F.col("value")
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.abs(sec - F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))).alias("seconds"), F.floor(sec).alias("epoch_s"), F.round(v, 2).alias("rounded"),
        F.length("event_type").cast("long").alias("n"), F.upper("event_type").alias("up"), F.contains("event_type", F.lit("r")).alias("has_r"), F.regexp_replace("event_type", "[aeiou]", "").alias("bare"),
        F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("h"), F.weekday("ts").cast("long").alias("wd"), F.when(v > 0, F.log2(v)).alias("lg2"), F.when(v > 0, F.log10(v)).alias("lg10"),
        F.sqrt(F.abs(v)).alias("root"), F.least(F.greatest(v, F.lit(1.0)), F.lit(5.0)).alias("clipped"), (v % 1 == 0).alias("whole"), F.split_part("event_type", F.lit("_"), F.lit(1)).alias("head"),
    )


@query("smp12_sample_rows", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
def _(s, d):
    return table(s, d, "events").orderBy(sampling.hash_order(F.col("event_id")), "event_id").limit(100).select("event_id")
