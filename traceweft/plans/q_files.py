"""Queries that write files and read them back: readers, sinks, versions, reports, plot tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from traceweft.operators import plots
from traceweft.plans.registry import query, table
from traceweft.sources import readers, writers
from traceweft.sources.scratch import scratch

_NATION = "n_nationkey int, n_name string, n_regionkey int"
_ALL_NATIONS = "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation"


def nations(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("src02_column_list", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(s, d):
    return readers.read(s, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_quantity"])


@query("src03_row_groups", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def _(s, d):
    return readers.read(s, f"{d}/lineitem.parquet", columns=["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("src04_folder_of_parts", "SELECT event_id, user_id, value FROM events")
def _(s, d):
    path = scratch(s, "events")
    writers.write_parquet(table(s, d, "events").select("event_id", "user_id", "value").repartition(3, "event_id"), path)
    return readers.read(s, path)


@query("src07_any_reader", "SELECT p_partkey, p_brand FROM part")
def _(s, d):
    return readers.read(s, f"{d}/part.parquet", format="parquet", columns=["p_partkey", "p_brand"])


@query("src08_typed_csv", _ALL_NATIONS)
def _(s, d):
    path = scratch(s, "nation.csv")
    writers.write_csv(nations(s, d), path)
    return readers.read(s, path, schema=_NATION)


@query("src09_latin_csv", "SELECT c_custkey, 'é ' || c_name AS name FROM customer")
def _(s, d):
    path = scratch(s, "customer.csv")
    table(s, d, "customer").select("c_custkey", F.concat(F.lit("é "), "c_name").alias("name")).coalesce(1).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read(s, path, schema="c_custkey long, name string")


@query("src11_json_index", "SELECT n_name AS name, n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS region FROM nation")
def _(s, d):
    path = scratch(s, "nation.json")
    record = F.struct(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    table(s, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", record)))).alias("value")).coalesce(1).write.text(path)
    out = readers.read_json_index(s, path)
    return out.select(F.col("index").alias("name"), F.col("record.k").cast("long").alias("k"), F.col("record.region").cast("long").alias("region"))


@query("src12_dispatch", " UNION ALL ".join(f"SELECT '{kind}' AS kind, n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation" for kind in ("parquet", "csv", "jsonl", "orc", "tsv")))
def _(s, d):
    out = None
    for kind in ("parquet", "csv", "jsonl", "orc", "tsv"):
        path, w = scratch(s, f"nation.{kind}"), nations(s, d).write
        {"parquet": w.parquet, "orc": w.orc, "jsonl": w.json, "csv": lambda p, w=w: w.option("header", True).csv(p), "tsv": lambda p, w=w: w.option("header", True).option("sep", "\t").csv(p)}[kind](path)
        one = readers.read(s, path, schema=_NATION).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey")
        out = one if out is None else out.unionByName(one)
    return out


@query("src13_auto_format", "SELECT r_regionkey::INTEGER AS r_regionkey, r_name, 'refused' AS pickle FROM region")
def _(s, d):
    path = scratch(s, "region.orc")
    table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name").write.orc(path)
    try:
        readers.read(s, path.replace(".orc", ".pkl"))
        said = "read"
    except ValueError:
        said = "refused"
    return readers.read(s, path).withColumn("pickle", F.lit(said))


@query("src18_newest", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def _(s, d):
    folder = scratch(s, "nations")
    for k in (0, 1, 2):
        writers.write_parquet(table(s, d, "nation").where(F.col("n_regionkey") == k).select("n_name"), f"{folder}/nation_{k}.parquet")
        writers.write_parquet(table(s, d, "region").select("r_name"), f"{folder}/other_{k}.parquet")
    return readers.read(s, readers.newest(s, folder, "nation_", ".parquet"))


@query("src20_last_run", "SELECT 'json' AS kind, count(*) AS orders FROM orders UNION ALL SELECT 'yaml', count(*) FROM orders")
def _(s, d):
    folder, n, rows = scratch(s, "runs"), table(s, d, "orders").count(), []
    for kind in ("json", "yaml"):
        writers.save_last_run(s, f"{folder}/last.{kind}", input="orders", orders=n)
        found = readers.last_run(s, f"{folder}/last.{kind}")
        rows.append((kind, found.get("last_run", found)["orders"]))
    return s.createDataFrame(rows, "kind string, orders long")


def _codec(name, codec, sql):
    @query(name, sql)
    def _(s, d):
        path = scratch(s, "orders.parquet")
        writers.write_parquet(table(s, d, "orders").select("o_orderkey", "o_totalprice"), path, codec)
        file = readers.read(s, path).select(F.input_file_name().alias("f")).first()["f"]
        return readers.read(s, path).withColumn("codec", F.lit(file.split(".")[-2]))


_codec("snk01_snappy", "snappy", "SELECT o_orderkey, o_totalprice, 'snappy' AS codec FROM orders")
_codec("snk02_zstd", "zstd", "SELECT o_orderkey, o_totalprice, 'zstd' AS codec FROM orders")


@query("snk03_fixed_schema", "SELECT o_custkey::INTEGER AS customer, o_totalprice::VARCHAR IS NOT NULL AS priced, o_orderkey FROM orders")
def _(s, d):
    from pyspark.sql import types as T

    wide = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_totalprice").isNotNull().alias("priced"), "o_orderstatus")
    schema = T._parse_datatype_string("customer int, priced boolean, o_orderkey long")
    path = scratch(s, "orders")
    for k in (0, 1):
        writers.write_parquet(writers.conform(wide.where(F.col("o_orderkey") % 2 == k), schema), path, mode="append")
    return readers.read(s, path)


@query("snk04_all_or_nothing", "SELECT n_nationkey, n_name, 'refused' AS second FROM nation")
def _(s, d):
    from pyspark.errors import AnalysisException

    path, n = scratch(s, "nation"), table(s, d, "nation").select("n_nationkey", "n_name")
    writers.write_parquet(n, path)
    try:
        writers.write_parquet(n.limit(1), path)
        said = "written"
    except AnalysisException:
        said = "refused"
    return readers.read(s, path).withColumn("second", F.lit(said))


@query("snk05_csv_with_preamble", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey, '# ' || (SELECT count(*) FROM nation) || ' rows' AS preamble FROM nation")
def _(s, d):
    path = scratch(s, "nation.csv")
    writers.write_csv(nations(s, d), path, [f"{nations(s, d).count()} rows"])
    said = s.read.text(f"{path}.preamble.txt").first()[0]
    return readers.read(s, path, schema=_NATION).withColumn("preamble", F.lit(said))


@query("snk06_two_level_header", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customer_unique, count(o_custkey) AS customer_total, count(DISTINCT o_orderpriority) AS priority_unique, count(o_orderpriority) AS priority_total FROM orders GROUP BY 1")
def _(s, d):
    pair = lambda c, name: F.struct(F.count_distinct(c).alias("unique"), F.count(c).alias("total")).alias(name)
    wide = table(s, d, "orders").groupBy("o_orderstatus").agg(pair("o_custkey", "customer"), pair("o_orderpriority", "priority"))
    path = scratch(s, "counts.csv")
    writers.write_csv(writers.flat_header(wide, {"customer": ["unique", "total"], "priority": ["unique", "total"]}), path)
    return readers.read(s, path, schema="o_orderstatus string, customer_unique long, customer_total long, priority_unique long, priority_total long")


@query("snk08_versions", "SELECT 1 AS version, count(*) AS n FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 2, count(*) FROM nation")
def _(s, d):
    folder, n = scratch(s, "sets"), table(s, d, "nation")
    for part in (n.where("n_regionkey < 2"), n):
        writers.save(part, folder, "nation")
    return s.createDataFrame([(i + 1, s.read.parquet(p).count()) for i, p in enumerate(writers.versions(s, folder, "nation"))], "version int, n long")


@query("snk09_metadata", "SELECT 'rows' AS k, count(*)::VARCHAR AS v FROM orders UNION ALL SELECT 'name', 'orders' UNION ALL SELECT 'note', 'backup' UNION ALL SELECT 'type of o_orderkey', 'bigint'")
def _(s, d):
    path = writers.save(table(s, d, "orders"), scratch(s, "sets"), "orders", {"note": "backup"})
    m = json.loads(s.read.text(f"{path}.json", wholetext=True).first()[0])
    rows = [("rows", str(m["rows"])), ("name", m["name"]), ("note", m["note"]), ("type of o_orderkey", m["columns"]["o_orderkey"])]
    return s.createDataFrame(rows, "k string, v string")


@query("snk10_registry", "SELECT 'nation' AS name, 2::BIGINT AS versions, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', 1, (SELECT count(*) FROM region)")
def _(s, d):
    folder = scratch(s, "registry")
    for name in ("nation", "region", "nation"):
        writers.save(table(s, d, name), folder, name)
    found = {name: writers.versions(s, folder, name) for name in ("nation", "region")}
    return s.createDataFrame([(name, len(v), s.read.parquet(v[-1]).count()) for name, v in found.items()], "name string, versions long, n long")


@query("snk11_report", "SELECT 'json' AS kind, count(*) AS orders FROM orders UNION ALL SELECT 'html', count(*) FROM orders")
def _(s, d):
    folder, report, rows = scratch(s, "reports"), {"orders": table(s, d, "orders").count()}, []
    writers.write_report(s, f"{folder}/r.json", report)
    writers.write_report(s, f"{folder}/r.html", report, html=True)
    rows.append(("json", json.loads(s.read.text(f"{folder}/r.json", wholetext=True).first()[0])["orders"]))
    rows.append(("html", int(s.read.text(f"{folder}/r.html", wholetext=True).first()[0].split("<td>orders</td><td>")[1].split("<")[0])))
    return s.createDataFrame(rows, "kind string, orders long")


@query("snk12_dated_name", "SELECT event_id, 'events_' || min(ts::DATE) OVER () || '_to_' || max(ts::DATE) OVER () || '.parquet' AS name FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", "ts")
    path = writers.dated_path(e, "ts", scratch(s, "events.parquet"))
    writers.write_parquet(e, path)
    return readers.read(s, path).select("event_id").withColumn("name", F.lit(path.rsplit("/", 1)[1]))


@query("snk13_env_beside_yaml", "SELECT 'PATHS_YAML' AS k, count(*) AS rows FROM region")
def _(s, d):
    path = scratch(s, "paths.yaml")
    writers.save_last_run(s, path, rows=table(s, d, "region").count())
    key, _, at = readers.text_of(s, f"{path.rsplit('/', 1)[0]}/.env").strip().partition("=")
    return s.createDataFrame([(key, readers.last_run(s, at)["last_run"]["rows"])], "k string, rows long")


@query(
    "snk14_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem), b AS (SELECT least(floor((l_extendedprice - a) / ((z - a) / 10)), 9)::INTEGER AS bin, a, z FROM lineitem, e)
    SELECT bin, a + bin * ((z - a) / 10) AS low, a + (bin + 1) * ((z - a) / 10) AS high, count(*) AS n FROM b GROUP BY bin, a, z""",
)
def _(s, d):
    return plots.histogram(table(s, d, "lineitem"), "l_extendedprice", 10)


@query("snk14_bars", "SELECT event_type AS value, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _(s, d):
    return plots.bars(table(s, d, "events"), "event_type", 3)


@query(
    "snk14_box",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events), x AS (SELECT value AS v, q.*, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events, q)
    SELECT q1, median, q3, min(v) FILTER (WHERE inside) AS low, max(v) FILTER (WHERE inside) AS high, count(*) FILTER (WHERE NOT inside) AS n_out FROM x GROUP BY 1, 2, 3""",
)
def _(s, d):
    return plots.box(table(s, d, "events"), "value")
