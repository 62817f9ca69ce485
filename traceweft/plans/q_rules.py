"""Queries of rules that work on small summaries, of feature selection, and of what must hold for fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweft.operators import associate as A
from traceweft.operators import balance as B
from traceweft.operators import encode as N
from traceweft.operators import models as M
from traceweft.operators import profile as P
from traceweft.operators import sampling as S
from traceweft.operators import stats
from traceweft.plans import pipeline as R
from traceweft.plans.q_models import _FEATURES, training
from traceweft.plans.q_profile import _HOLES, holes
from traceweft.plans.q_sampling import _RARE, rare
from traceweft.plans.q_stats import _MARGINS, _ranks, _xy
from traceweft.plans.registry import query, table


@query("smp04_zero_keys", "WITH z AS (SELECT user_id FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'error' AND value > 220)) SELECT user_id FROM z ORDER BY md5(user_id::VARCHAR), user_id LIMIT 5")
def _(s, d):
    bad = (F.col("event_type") == "error") & (F.col("value") > 220)
    zero = table(s, d, "events").groupBy("user_id").agg(F.bool_or(bad).alias("bad")).where("not bad")
    return S.sample_keys(zero, "user_id", 5, strict=False)


@query("smp13_recommendation", f"WITH c AS (SELECT label, count(*) AS n FROM {_RARE} GROUP BY 1), r AS (SELECT 'rare' AS name, max(n)::DOUBLE / min(n) AS ratio FROM c UNION ALL SELECT 'status', max(n)::DOUBLE / min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) SELECT name, CASE WHEN ratio > 1000 THEN 'minority_boost' WHEN ratio > 100 THEN 'balanced' ELSE 'proportional' END AS method FROM r")
def _(s, d):
    rows = []
    for name, counts in (("rare", S.class_counts(rare(s, d), "label")), ("status", S.class_counts(table(s, d, "orders"), "o_orderstatus"))):
        rows.append((name, S.recommend_sampling(max(counts.values()) / min(counts.values()))))
    return s.createDataFrame(rows, "name string, method string")


@query("spl04_tenth_of_each_class", f"WITH r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM {_RARE}) SELECT id, label, CASE WHEN r <= floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r")
def _(s, d):
    return S.class_random_split(rare(s, d), "label", "id", 0.1)


@query("fn06_dates_in_text", "SELECT event_id, regexp_matches(ts::VARCHAR || event_type, '^\\d{4}-\\d{2}-\\d{2}') AS dated, regexp_extract(ts::VARCHAR, '\\d{4}-\\d{2}-\\d{2}') AS day FROM events")
def _(s, d):
    text = F.col("ts").cast("string")
    return table(s, d, "events").select("event_id", F.concat(text, "event_type").rlike(r"^\d{4}-\d{2}-\d{2}").alias("dated"), F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1).alias("day"))


@query("fn07_joined_per_group", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(s, d):
    return table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("fn11_finite", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS v FROM part")
def _(s, d):
    odd = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.lit(float("inf")) * F.when(F.col("p_size") % 20 == 0, 1).otherwise(-1)).otherwise(F.col("p_retailprice")).alias("v"))
    return odd.withColumn("v", N.finite(F.col("v")))


_KIND = lambda c, kind: f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' ELSE '{kind}' END AS kind FROM events"


@query("prf01_categories", " UNION ALL ".join(["SELECT 'event_id' AS \"column\", 'key' AS kind", _KIND("user_id", "numeric"), "SELECT 'ts', 'temporal'", _KIND("event_type", "categorical"), _KIND("props", "categorical"), _KIND("value", "numeric")]))
def _(s, d):
    return s.createDataFrame(list(P.categories(table(s, d, "events"), {"key": ["event_id"]}).items()), "column string, kind string")


def _copies(s, d):
    """Orders with a column that is another's copy under a like name."""
    return table(s, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("o_totalprice_b"), "o_custkey")


@query("prf09_similar_columns", "SELECT 0 AS g, unnest(['o_totalprice', 'o_totalprice_b']) AS \"column\" WHERE (SELECT count(DISTINCT o_totalprice) FROM orders) > 0")
def _(s, d):
    groups = [g for g in P.similar_groups(P.profile(_copies(s, d))) if "o_totalprice" in g]
    return s.createDataFrame([(i, c) for i, g in enumerate(groups) for c in g if c.startswith("o_total")], "g int, column string")


@query("prf10_drop_candidates", f"SELECT row_number() OVER () - 1 AS place, c AS \"column\" FROM (SELECT 'none' AS c UNION ALL SELECT 'one' UNION ALL SELECT 'o_orderkey' WHERE (SELECT count(DISTINCT o_orderkey) FROM orders) > 1000)")
def _(s, d):
    h = holes(s, d).select("o_orderkey", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"), F.lit("a").alias("book_state"))
    order = ["constant", "all_null", "high_missing", "high_cardinality"]
    found = sorted((order.index(r["issue"]), r["column"], r["issue"]) for r in P.issues(P.profile(h), 10).collect())
    return s.createDataFrame([(i, c) for i, c in enumerate(P.drop_candidates([(i, c) for _, c, i in found]))], "place long, column string")


@query("prf12_validation", "SELECT 'missing column nope' AS problem UNION ALL SELECT '6 columns, 9 needed' UNION ALL SELECT 'fewer than ' || (count(*) + 1) || ' rows' FROM events")
def _(s, d):
    e = table(s, d, "events")
    return s.createDataFrame([(p,) for p in P.validate(e, e.count() + 1, 9, ["ts", "nope"])], "problem string")


_READY = f"""WITH h AS (SELECT count(*) AS n, 100.0 * ((count(*) - count(status)) + (count(*) - count(priority)) + (count(*) - count(cust))) / (4 * count(*)) AS pct FROM {_HOLES}),
    p AS (SELECT CASE WHEN n >= 10000 THEN 25 WHEN n >= 1000 THEN 15 ELSE 5 END AS size, CASE WHEN pct < 5 THEN 25 WHEN pct < 20 THEN 15 ELSE 5 END AS missing, 25 AS diversity, 25 AS independence FROM h)"""


def _ready(s, d):
    h = holes(s, d)
    p = P.profile(h)
    pct = p.agg(F.avg("null_pct")).first()[0]
    kinds = len(set(P.categories(h.withColumn("flag", F.col("o_orderkey") % 2)).values()))  # numbers, texts and a flag
    return P.readiness(h.count(), pct, kinds, 0)


@query("prf15_readiness", f"{_READY} SELECT unnest(['size', 'missing', 'diversity', 'independence', 'score']) AS part, unnest([size, missing, diversity, independence, size + missing + diversity + independence])::INTEGER AS points FROM p")
def _(s, d):
    return s.createDataFrame(list(_ready(s, d).items()), "part string, points int")


@query("prf16_hints", "SELECT 'squared: transform, skewness ' || printf('%.1f', skewness(value ** 3)) AS hint FROM events WHERE true HAVING abs(skewness(value ** 3)) > 2 UNION ALL SELECT 'user_id: encode by target, ' || count(DISTINCT user_id) || ' values' FROM events HAVING count(DISTINCT user_id) > 100")
def _(s, d):
    e = table(s, d, "events").select((F.col("value") ** 3).alias("squared"))
    skew = stats.moments(e, ["squared"]).first()["skewness"]
    users = table(s, d, "events").select("user_id").distinct().count()
    return s.createDataFrame([(h,) for h in P.feature_hints({"squared": skew}, [], {"user_id": users})], "hint string")


@query("prf17_recommendations", f"{_READY}, x AS (SELECT 1 AS k, 'drop or repair one: constant' AS advice UNION ALL SELECT 2, 'treat missing values before encoding' FROM p WHERE missing < 25) SELECT advice FROM x")
def _(s, d):
    found = [(r["issue"], r["column"]) for r in P.issues(P.profile(holes(s, d).select("status", F.lit(1).alias("one"))), 1).collect()]
    return s.createDataFrame([(a,) for a in P.recommendations(_ready(s, d), found)], "advice string")


@query("prf24_columns_like", "SELECT column_name AS \"column\" FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_name LIKE '%key%' OR column_name LIKE '%price%'")
def _(s, d):
    return s.createDataFrame([(c,) for c in P.columns_like(table(s, d, "lineitem"), ["key", "price"])], "column string")


@query("prf25_temporal_columns", "SELECT 'ts' AS \"column\" UNION ALL SELECT 'day' WHERE (SELECT count(ts) FROM events) >= 6")
def _(s, d):
    e = table(s, d, "events").select("event_id", "ts", F.col("ts").cast("string").alias("day"), "event_type")
    return s.createDataFrame([(c,) for c in P.temporal_columns(e)], "column string")


def _twins(s, d):
    """A column, its monotone image, its linear image, and an unrelated one."""
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("id"), q.alias("a"), (q * q * q).alias("b"), (2 * q + 1).alias("c"), F.col("l_tax").alias("t"))


def _twins_sql(r):
    pairs = [("a", "b"), ("a", "c"), ("a", "t"), ("b", "c"), ("b", "t"), ("c", "t")]
    return "WITH x AS (SELECT l_quantity AS a, l_quantity ** 3 AS b, 2 * l_quantity + 1 AS c, l_tax AS t FROM lineitem)" + r + " SELECT DISTINCT a AS \"column\" FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS a, corr({p}, {q}) AS r FROM y" for p, q in pairs) + ") WHERE abs(r) > 0.95"


@query("cor01_spearman_drops", _twins_sql(f", y AS (SELECT {_ranks('a')} AS a, {_ranks('b')} AS b, {_ranks('c')} AS c, {_ranks('t')} AS t FROM x)"))
def _(s, d):
    c = ["a", "b", "c", "t"]
    return s.createDataFrame([(x,) for x in A.correlated_drops(stats.spearman_pairs(_twins(s, d), c, "id"), c)], "column string")


@query("cor02_pearson_drops", _twins_sql(", y AS (SELECT * FROM x)"))
def _(s, d):
    c = ["a", "b", "c", "t"]
    return s.createDataFrame([(x,) for x in A.correlated_drops(stats.correlation_pairs(_twins(s, d), c), c)], "column string")


_TAU = "(SELECT sum(s) / sqrt(sum(dx)::DOUBLE * sum(dy)::DOUBLE) FROM (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, (a.x <> b.x)::INT AS dx, (a.y <> b.y)::INT AS dy FROM z a JOIN z b ON a.i < b.i))"


@query(
    "cor03_numeric_target",
    f"""WITH z AS (SELECT p_size AS x, p_retailprice + 40 * p_size AS y, p_partkey AS i FROM part), r AS (SELECT {_ranks('x')} AS a, {_ranks('y')} AS b FROM z), v AS (SELECT abs((SELECT corr(x, y) FROM z)) AS p, abs((SELECT corr(a, b) FROM r)) AS q, abs({_TAU}) AS k)
    SELECT CASE WHEN q > 1.2 * greatest(k, CASE WHEN p > 1.2 * k AND p > 0.1 THEN p ELSE k END) AND q > 0.1 THEN 'spearman' WHEN p > 1.2 * k AND p > 0.1 THEN 'pearson' ELSE 'kendall' END AS method,
    round(CASE WHEN q > 1.2 * greatest(k, CASE WHEN p > 1.2 * k AND p > 0.1 THEN p ELSE k END) AND q > 0.1 THEN q WHEN p > 1.2 * k AND p > 0.1 THEN p ELSE k END, 6) AS strength FROM v""",
)
def _(s, d):
    z = table(s, d, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_retailprice") + 40 * F.col("p_size")).alias("y"))
    p, q = stats.correlation_pairs(z, ["x", "y"]).first()["r"], stats.spearman_pairs(z, ["x", "y"], "p_partkey").first()["r"]
    name, value = A.numeric_method(p, q, stats.kendall(z, "x", "y").first()["tau"])
    return s.createDataFrame([(name, round(value, 6))], "method string, strength double")


@query(
    "cor04_categorical_target",
    f"""WITH {_MARGINS}, i AS (SELECT -sum(n / t * log2(ny / t)) AS hy, sum(n / t * log2(n * t / (nx * ny))) AS mi, sqrt(sum((n - nx * ny / t) ** 2 / (nx * ny / t)) / max(t) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)) AS v FROM c)
    SELECT CASE WHEN mi / hy > v THEN 'theils_u' ELSE 'cramers_v' END AS method, round(greatest(v, mi / hy), 6) AS strength FROM i""",
)
def _(s, d):
    name, value = A.categorical_method(_xy(s, d), "event_type", "y")
    return s.createDataFrame([(name, round(value, 6))], "method string, strength double")


@query(
    "cor05_robust_pairs",
    f"WITH z AS (SELECT p_size AS x, p_size * p_size AS y, p_partkey AS i FROM part), r AS (SELECT {_ranks('x')} AS a, {_ranks('y')} AS b FROM z), v AS (SELECT ((SELECT corr(a, b) FROM r) + {_TAU}) / 2 AS r) SELECT 'x' AS a, 'y' AS b, round(r, 6) AS r FROM v WHERE abs(r) >= 0.85",
)
def _(s, d):
    z = table(s, d, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_size") * F.col("p_size")).alias("y"), F.col("p_retailprice").alias("w"))
    return A.robust_pairs(z, ["x", "y", "w"], "p_partkey").withColumn("r", F.round("r", 6))


@query("cor06_pair_losers", "SELECT 'l_quantity' AS kept, 'l_orderkey' AS lost, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n UNION ALL SELECT 'measure_value', 'step_name', 0 UNION ALL SELECT 'l_tax', 'l_zeta', 0")
def _(s, d):
    keys, rows = table(s, d, "lineitem").select("l_orderkey").distinct().count(), []
    for a, b, unique, n in (("l_orderkey", "l_quantity", {"l_orderkey": 0.2, "l_quantity": 0.9}, keys), ("measure_value", "step_name", {}, 0), ("l_tax", "l_zeta", {}, 0)):
        lost = A.pair_loser(a, b, unique)
        rows.append((a if lost == b else b, lost, n))
    return s.createDataFrame(rows, "kept string, lost string, n long")


def _binned_sql(columns, target):
    """y and, for each column, the number of its quantile bin."""
    q = ", ".join(f"[{', '.join(f'quantile_cont({c}, {k / 8})' for k in range(1, 8))}] AS e_{c}" for c in columns)
    b = ", ".join(f"len(list_filter(list_distinct(e_{c}), lambda e: {c} > e)) AS {c}" for c in columns)
    return f"q AS (SELECT {q} FROM lineitem), b AS (SELECT {target} AS y, {b} FROM lineitem, q)"


_LABEL = "((l_quantity * (1 + 4 * l_discount) + l_partkey % 7) > 35)::INT"
_COLS = ["l_quantity", "l_discount", "l_tax"]


def _mi_sql(c):
    return f"(SELECT sum(n / t * log2(n * t / (nx * ny))) AS mi, -sum(n / t * log2(nx / t)) AS hx, sum(n * n * t / (nx * ny)) - max(t) AS chi2 FROM (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM (SELECT {c} AS x, y, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2)))"


def _labelled(s, d):
    y = ((F.col("l_quantity") * (1 + 4 * F.col("l_discount")) + F.col("l_partkey") % 7) > 35).cast("int")
    return table(s, d, "lineitem").select(*_COLS, y.alias("y"))


@query("cor07_mutual_information", f"WITH {_binned_sql(_COLS, _LABEL)}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, mi FROM {_mi_sql(c)}" for c in _COLS) + ") SELECT feature, round(mi, 6) AS mi, round(mi / max(mi) OVER (), 6) AS share FROM m")
def _(s, d):
    return A.mutual_information(_labelled(s, d), _COLS, "y").select("feature", F.round("mi", 6).alias("mi"), F.round("share", 6).alias("share"))


@query("imp06_gain_ratio", f"WITH {_binned_sql(_COLS, _LABEL)} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(mi / hx, 6) AS gain_ratio FROM {_mi_sql(c)}" for c in _COLS))
def _(s, d):
    x = _labelled(s, d)
    return s.createDataFrame([(c, round(A.gain_ratio(x, c, "y").first()["gain_ratio"], 6)) for c in _COLS], "feature string, gain_ratio double")


def _f_sql(c):
    return f"(SELECT (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (max(t) - count(*))) FROM (SELECT {_LABEL} AS y, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1), (SELECT avg({c}) AS g, count({c}) AS t FROM lineitem))"


@query(
    "imp03_univariate",
    f"WITH {_binned_sql(_COLS, _LABEL)}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, mi, {_f_sql(c)} AS f, chi2 FROM {_mi_sql(c)}" for c in _COLS) + ") SELECT feature, round(0.4::DOUBLE * mi / max(mi) OVER () + 0.35 * f / max(f) OVER () + 0.25 * chi2 / max(chi2) OVER (), 6) AS score, rank() OVER (ORDER BY f DESC)::INT AS place FROM m",
)
def _(s, d):
    from pyspark.sql.window import Window

    u = A.univariate(_labelled(s, d), _COLS, "y")
    return u.select("feature", F.round("score", 6).alias("score"), F.rank().over(Window.orderBy(F.desc("f"))).alias("place"))


@query(
    "cor08_test_dispatch",
    f"""WITH r AS (SELECT event_type, value, {_ranks('value')} AS r FROM events), g AS (SELECT event_type, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS s FROM r GROUP BY 1), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM events GROUP BY value)),
    k AS (SELECT (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (sum(n) ** 3 - sum(n))) AS h FROM g, t), {_MARGINS}, p AS (SELECT {_ranks('user_id')} AS a, {_ranks('value')} AS b FROM events)
    SELECT 'event_type' AS feature, 'value' AS target, 'kruskal' AS test, round(h, 5) AS statistic FROM k UNION ALL SELECT 'event_type', 'y', 'chi2', round(sum((n - nx * ny / t) ** 2 / (nx * ny / t)), 5) FROM c UNION ALL SELECT 'user_id', 'value', 'spearman', round(corr(a, b), 5) FROM p""",
)
def _(s, d):
    e = table(s, d, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("y"), "user_id", "value")
    rows = []
    for feature, target in (("event_type", "value"), ("event_type", "y"), ("user_id", "value")):
        a = A.association(e, feature, target, "event_id")
        rows.append((feature, target, a["test"], round(a["statistic"], 5)))
    return s.createDataFrame(rows, "feature string, target string, test string, statistic double")


@query("cor09_fisher", "SELECT 'fisher' AS test, a * e / (b * c)::DOUBLE AS odds FROM (SELECT count(*) FILTER (WHERE r AND q) AS a, count(*) FILTER (WHERE r AND NOT q) AS b, count(*) FILTER (WHERE NOT r AND q) AS c, count(*) FILTER (WHERE NOT r AND NOT q) AS e FROM (SELECT n_regionkey < 2 AS r, n_nationkey % 3 = 0 AS q FROM nation))")
def _(s, d):
    n = table(s, d, "nation").select((F.col("n_regionkey") >= 2).cast("string").alias("r"), (F.col("n_nationkey") % 3 != 0).cast("string").alias("q"))
    found = A.independence(n, "r", "q")
    return s.createDataFrame([(found["test"], found["statistic"])], "test string, odds double")


@query("cor17_target_types", "WITH c AS (SELECT count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_totalprice) AS b, 2 AS e FROM orders) SELECT unnest(['status', 'price', 'flag']) AS target, unnest([CASE WHEN a <= 2 THEN 'binary' ELSE 'multiclass' END, CASE WHEN b <= 2 THEN 'binary' WHEN b <= 20 THEN 'multiclass' ELSE 'numeric' END, 'binary']) AS kind FROM c")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 2).alias("flag"))
    return s.createDataFrame([(c, A.target_type(o, c)) for c in o.columns], "target string, kind string")


@query("cor18_cutoffs", f"WITH i AS (SELECT event_type, abs(avg(value) - (SELECT avg(value) FROM events)) AS x FROM events GROUP BY 1), m AS (SELECT * FROM (VALUES ('default', false, 1.0), ('conservative', false, 0.1), ('conservative', true, 2.0), ('aggressive', false, 0.001), ('aggressive', true, 0.5)) AS t(mode, association, factor)) SELECT mode, association, count(*) FILTER (WHERE x >= 0.5 * factor) AS n FROM i, m GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events")
    mean = e.agg(F.avg("value")).first()[0]
    scores = {r[0]: abs(r[1] - mean) for r in e.groupBy("event_type").agg(F.avg("value")).collect()}
    modes = [("default", False), ("conservative", False), ("conservative", True), ("aggressive", False), ("aggressive", True)]
    return s.createDataFrame([(m, a, len(A.select_features(scores, 0.5, m, a))) for m, a in modes], "mode string, association boolean, n long")


@query("imp09_bands", "WITH r AS (SELECT event_type AS feature, count(*)::DOUBLE / max(count(*)) OVER () * (CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.6 ELSE 0.2 END) AS x FROM events GROUP BY 1) SELECT feature, CASE WHEN x >= 0.7 THEN 'CRITICAL' WHEN x >= 0.5 THEN 'HIGH' WHEN x >= 0.3 THEN 'MEDIUM' WHEN x >= 0.1 THEN 'LOW' ELSE 'MINIMAL' END AS band FROM r")
def _(s, d):
    c = table(s, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("feature") == "view", 1.0).when(F.col("feature") == "click", 0.6).otherwise(0.2)
    top = c.agg(F.max("n").alias("top"))
    return c.join(F.broadcast(top)).select("feature", A.importance_band(F.col("n") / F.col("top") * weight).alias("band"))


@query("imp08_consensus_of_tables", "WITH s AS (SELECT event_type AS feature, 'mi' AS method, count(*)::DOUBLE AS score FROM events GROUP BY 1 UNION ALL SELECT event_type, 'f', sum(value) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'perm', count(DISTINCT user_id)::DOUBLE FROM events GROUP BY 1), n AS (SELECT feature, CASE method WHEN 'perm' THEN 0.2 ELSE 0.3 END::DOUBLE * score / max(score) OVER (PARTITION BY method) AS v FROM s) SELECT feature, round(sum(v), 6) AS consensus FROM n GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("mi"), F.sum("value").alias("f"), F.count_distinct("user_id").cast("double").alias("perm"))
    scores = e.unpivot(["feature"], ["mi", "f", "perm"], "method", "score")
    return A.consensus(scores, {"mi": 0.3, "f": 0.3, "perm": 0.2}).select("feature", F.round("consensus", 6).alias("consensus"))


@query("enc01_strategies", "WITH c AS (SELECT count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_totalprice) AS b, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_custkey::VARCHAR) AS k FROM orders), t AS (SELECT unnest(['status', 'priority', 'customer']) AS \"column\", unnest([a, p, k]) AS n FROM c) SELECT \"column\", CASE WHEN n <= 2 THEN 'binary' WHEN n <= 10 THEN 'ordinal' WHEN n <= 100 THEN 'target_smoothed' WHEN n <= 1000 THEN 'target_cv' ELSE 'catboost' END AS strategy FROM t UNION ALL SELECT 'price', CASE WHEN b > 100 THEN 'standard_scaling' ELSE 'numeric_preserve' END FROM c UNION ALL SELECT 'day', 'datetime_parts'")
def _(s, d):
    o = table(s, d, "orders").agg(F.count_distinct("o_orderstatus").alias("status"), F.count_distinct("o_orderpriority").alias("priority"), F.count_distinct("o_custkey").alias("customer"), F.count_distinct("o_totalprice").alias("price"), F.count_distinct("o_orderdate").alias("day")).first().asDict()
    return s.createDataFrame([(c, N.strategy(c == "price", c == "day", n)) for c, n in o.items()], "column string, strategy string")


@query("enc14_population_scaling", "SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS enc FROM orders")
def _(s, d):
    return N.standard_scaled(table(s, d, "orders"), "o_totalprice", population=True).select("o_orderkey", F.col("o_totalprice_enc").alias("enc"))


@query(
    "enc15_preprocess",
    "WITH u AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(user_id::VARCHAR), user_id LIMIT 12), e AS (SELECT * FROM events WHERE user_id IN (SELECT user_id FROM u)) SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS kind, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS scaled FROM e",
)
def _(s, d):
    kept = S.at_most_keys(table(s, d, "events"), "user_id", 12)
    out = R.run_steps(kept, [{"step": "ordinal", "column": "event_type"}, {"step": "standard", "column": "value"}])
    return out.select("event_id", F.col("event_type_enc").cast("long").alias("kind"), F.col("value_enc").alias("scaled"))


@query("bal02_recommendation", f"WITH c AS (SELECT count(*) AS n FROM {_RARE} GROUP BY label), m AS (SELECT max(n)::DOUBLE / min(n) AS ratio, min(n) AS least FROM c) SELECT CASE WHEN ratio < 3 THEN 'none' WHEN least < 6 THEN 'class_weights' WHEN ratio < 100 AND least >= 50 THEN 'smote' WHEN ratio < 1000 THEN 'adaptive_oversampling' ELSE 'stratified_undersampling' END AS method FROM m")
def _(s, d):
    return s.createDataFrame([(B.recommend(S.class_counts(rare(s, d), "label")),)], "method string")


@query("bal04_oversampled_counts", f"SELECT count(*) AS n_kept, true AS minorities_grew, true AS copies_near FROM {_RARE}")
def _(s, d):
    df = rare(s, d).withColumn("x", F.col("id").cast("double"))
    counts = S.class_counts(df, "label")
    out = B.oversample(df, "label", "id", ["x"], B.oversampling_targets(counts))
    far = F.abs(F.col("x") - F.col("id")) <= 0.1 * F.abs(F.col("id")) + 1e-9
    small = F.count_if(F.col("label") == 2)
    return out.agg(F.count_if(F.col("copy") == 0).alias("n_kept"), (small > counts[2]).alias("minorities_grew"), F.bool_and(far).alias("copies_near"))


@query("bal06_smote_between", "SELECT 400::BIGINT AS n, true AS inside FROM orders LIMIT 1")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"))
    made = B.smote(o, "o_orderkey", ["x", "y"], 400)
    edge = o.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    return made.join(F.broadcast(edge)).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x").between(F.col("a"), F.col("b")) & F.col("y").between(F.col("c"), F.col("d"))).alias("inside"))


def _holds(name, fit, sql="SELECT count(*) AS n_test, true AS beats_majority FROM lineitem WHERE l_orderkey % 5 = 0"):
    """A fitted model's predictions cover the test part and are right more often than its commonest label."""

    @query(name, sql)
    def _(s, d):
        train, test = training(s, d)
        said = fit(train).transform(test)
        share = test.agg(F.avg("label")).first()[0]
        return said.agg(F.count(F.lit(1)).alias("n_test"), (F.avg((F.col("prediction") == F.col("label")).cast("int")) > max(share, 1 - share)).alias("beats_majority"))


_holds("mdl02_ridge_classifier", lambda t: M.ridge_cv(t, _FEATURES, "label", [0.01, 0.1], folds=2))
_holds("mdl03_logistic_l1", lambda t: M.logistic_cv(t, _FEATURES, "label", [0.001, 0.01], folds=2))
_holds("mdl04_logistic_grid", lambda t: M.logistic_cv(t, _FEATURES, "label", [0.01, 0.1], (0.0, 1.0), 2, (20,), metric="f1"))
_holds("mdl05_forest_beats_majority", lambda t: M.random_forest(_FEATURES, "label", trees=10, depth=5).fit(t))
_holds("mdl07_boosting_grid", lambda t: M.trees_cv(t, _FEATURES, "label", [3], [4, 6], folds=2))
_holds("mdl10_boosting_beats_majority", lambda t: M.boosted_trees(_FEATURES, "label", rounds=6, depth=4).fit(t))


@query("mdl06_three_classes", "SELECT count(*) AS n_test, true AS beats_majority FROM lineitem WHERE l_orderkey % 5 = 0")
def _(s, d):
    train, test = (x.withColumn("label", F.col("label") + (F.col("l_quantity") < 10).cast("int") * 2 * (1 - F.col("label"))) for x in training(s, d))
    said = M.boosted_trees(_FEATURES, "label", classes=3, rounds=4, depth=3).fit(train).transform(test)
    top = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    return said.agg(F.count(F.lit(1)).alias("n_test"), (F.avg((F.col("prediction") == F.col("label")).cast("int")) > top).alias("beats_majority"))


@query("mdl01_lasso_keeps_signal", "SELECT 4::BIGINT AS n_features, true AS quantity_counts, true AS tax_does_not FROM lineitem LIMIT 1")
def _(s, d):
    x = training(s, d)[0].withColumn("l_quantity", F.col("l_quantity") / 50)
    c = dict(M.coefficients(M.lasso_cv(x, _FEATURES, "label", [0.001, 0.01], folds=2), _FEATURES))
    return s.createDataFrame([(len(c), c["l_quantity"] > 0.1, abs(c["l_tax"]) < c["l_quantity"])], "n_features long, quantity_counts boolean, tax_does_not boolean")


@query("mdl14_ranked_coefficients", "SELECT 4::BIGINT AS n, true AS in_order FROM lineitem LIMIT 1")
def _(s, d):
    c = M.coefficients(M.logistic(_FEATURES, "label").fit(training(s, d)[0]), _FEATURES)
    return s.createDataFrame([(len(c), all(abs(a[1]) >= abs(b[1]) for a, b in zip(c, c[1:])))], "n long, in_order boolean")


@query("imp02_boosting_importance", "SELECT 1.0::DOUBLE AS total, 'l_quantity' AS first FROM lineitem LIMIT 1")
def _(s, d):
    c = M.coefficients(M.boosted_trees(_FEATURES, "label", rounds=4, depth=4).fit(training(s, d)[0]), _FEATURES)
    return s.createDataFrame([(round(sum(x for _, x in c), 6), c[0][0])], "total double, first string")


@query("imp05_elastic_net", "SELECT 4::BIGINT AS n, true AS discount_counts FROM lineitem LIMIT 1")
def _(s, d):
    c = dict(M.coefficients(M.logistic_cv(training(s, d)[0], _FEATURES, "label", [0.01], (0.5,), folds=2), _FEATURES))
    return s.createDataFrame([(len(c), c["l_discount"] > 0)], "n long, discount_counts boolean")


@query("mdl16_summary", "SELECT count(*) AS rows, 'report' AS kind FROM lineitem WHERE l_orderkey % 5 <> 0")
def _(s, d):
    import json

    from traceweft.sources import writers
    from traceweft.sources.scratch import scratch

    path, n = scratch(s, "summary.json"), training(s, d)[0].count()
    writers.write_report(s, path, {"rows": n, "kind": "report"})
    found = json.loads(s.read.text(path, wholetext=True).first()[0])
    return s.createDataFrame([(found["rows"], found["kind"])], "rows long, kind string")


@query("orc03_explore", f"SELECT 'status' AS \"column\", count(*) - count(status) AS n_null, count(DISTINCT status) AS n_distinct FROM {_HOLES} UNION ALL SELECT 'cust', count(*) - count(cust), count(DISTINCT cust) FROM {_HOLES}")
def _(s, d):
    x = R.explore(holes(s, d).select("status", "cust", "o_orderkey"), ["cust", "o_orderkey"])
    return x["nulls"].select("column", "n_null").join(x["profile"].select("column", "n_distinct"), "column").where("column <> 'o_orderkey'")


@query("orc04_run_history", "SELECT unnest(['filter', 'binary_target']) AS step, 'done' AS state FROM region LIMIT 2")
def _(s, d):
    from traceweft.sources.scratch import scratch

    run = R.Run(folder=scratch(s, "history"))
    R.run_steps(table(s, d, "events"), [{"step": "filter", "where": "value > 1"}, {"step": "binary_target", "column": "user_id", "out": "y"}], run)
    return s.createDataFrame([(x["step"], x["state"]) for x in run.steps], "step string, state string")


@query("orc05_failed_step_is_recorded", "SELECT 'nope' AS step, 'failed' AS state FROM region LIMIT 1")
def _(s, d):
    run = R.Run()
    try:
        with run.step(s, "nope"):
            table(s, d, "region").select("no_such_column")
    except Exception:
        pass
    return s.createDataFrame([(x["step"], x["state"]) for x in run.steps], "step string, state string")


@query("orc07_time_estimates", "SELECT unnest(['correlation_analysis', 'feature_importance', 'encoding_operations', 'balancing_operations']) AS step, unnest([greatest(1, 11 * 11 // 1000), greatest(5, count(*) * 11 // 100000), greatest(2, 11 // 10), greatest(3, count(*) // 50000)]) AS seconds FROM lineitem")
def _(s, d):
    x = table(s, d, "lineitem")
    return s.createDataFrame(list(R.estimated_seconds(x.count(), len(x.columns)).items()), "step string, seconds long")


@query("sta04_kolmogorov_smirnov", "SELECT count(*) AS n, false AS normal FROM events")
def _(s, d):
    e = table(s, d, "events")
    return stats.kolmogorov_smirnov(e, "value").join(e.agg(F.count(F.lit(1)).alias("n"))).select("n", "normal")


@query("sta19_pca_shares", "SELECT 4::BIGINT AS components, true AS ordered, 1.0::DOUBLE AS total FROM lineitem LIMIT 1")
def _(s, d):
    p = stats.pca_components(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).orderBy("component").collect()
    return s.createDataFrame([(len(p), all(a["share"] >= b["share"] for a, b in zip(p, p[1:])), round(p[-1]["cumulative"], 6))], "components long, ordered boolean, total double")


@query("enc13_hash_range", "SELECT p_partkey, 8 AS dims, true AS in_range FROM part")
def _(s, d):
    e = table(s, d, "part").select("p_partkey", N.hashed_ngrams(F.col("p_name"), 8).alias("e"))
    return e.select("p_partkey", F.size("e").alias("dims"), F.forall("e", lambda x: (x >= 0) & (x < 1)).alias("in_range"))


@query("sta04_shapiro", "SELECT count(*) AS n, true AS in_range FROM supplier")
def _(s, d):
    x = table(s, d, "supplier")
    found = stats.shapiro(x, "s_acctbal")
    return s.createDataFrame([(x.count(), found is None or (0 < found["w"] <= 1 and 0 <= found["p"] <= 1))], "n long, in_range boolean")


# base and values of every row add up to the forest's probability; quantity matters most
@query("mdl15_shapley", "SELECT count(*) AS n, true AS adds_up, 'l_quantity' AS strongest FROM lineitem WHERE l_orderkey % 5 = 0")
def _(s, d):
    from traceweft.operators import shapley

    train, test = training(s, d)
    model = M.random_forest(_FEATURES, "label", trees=5, depth=4).fit(train)
    test = test.withColumn("row", F.monotonically_increasing_id())
    values = shapley.shapley_values(model, test, _FEATURES, "row")
    said = model.transform(test).select("row", M.class_probability(1).alias("p"))
    sums = values.groupBy("row").agg(F.sum("value").alias("total")).join(said, "row")
    top = shapley.global_importance(values).orderBy(F.desc("importance")).first()["feature"]
    return sums.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("total") - F.col("p"))) < 1e-9).alias("adds_up")).withColumn("strongest", F.lit(top))
