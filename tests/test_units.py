"""Readers, writers, rules and invariants on small tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceweft.functions import special
from traceweft.operators import aggregates, associate, balance, columns, dedup, encode, filters, joins, models, profile, sampling, stats
from traceweft.plans import pipeline
from traceweft.sources import readers, writers


@pytest.fixture(scope="module")
def units(spark):
    """About 500 units: an all-null, a constant and a binary column, rare labels, text limits with blanks, tied times."""
    rows = []
    for i in range(500):
        label = 2 if i % 250 == 7 else 1 if i % 100 == 3 else 0
        rows.append((i, f"SN{i % 60:03d}", label, None, "x", i % 2, ["", "null", f"{i / 7:.3f}", "oops"][i % 4], f"2024-01-{1 + i // 40:02d} 08:00:00", float(i % 97)))
    rows += rows[:5]
    return spark.createDataFrame(rows, "id long, serial string, label int, nothing string, constant string, two int, limit string, stamp string, value double").withColumn("ts", F.to_timestamp_ntz("stamp")).cache()


def test_read_dispatch_and_round_trips(spark, units, tmp_path):
    base = str(tmp_path)
    writers.write_parquet(units, f"{base}/a.parquet", "zstd", files=1)
    writers.write_csv(units.select("id", "serial"), f"{base}/b.csv", ["made by a test"])
    units.select("id").write.json(f"{base}/c.jsonl")
    assert readers.read(spark, f"{base}/a.parquet", columns=["id"]).count() == 505
    assert readers.read(spark, f"{base}/b.csv", schema="id long, serial string").where("id = 7").first().serial == "SN007"
    assert readers.read(spark, f"{base}/c.jsonl").count() == 505
    assert (tmp_path / "b.csv.preamble.txt").read_text() == "# made by a test\n"
    assert readers.sniff_encoding(spark, f"{base}/b.csv") == "utf-8"
    (tmp_path / "latin.csv").write_bytes("a\nMünchen\n".encode("latin-1"))
    assert readers.read(spark, f"{base}/latin.csv").first().a == "München"
    for bad in ("x.pkl", "x.feather", "x.h5", "x.xlsx"):
        with pytest.raises(ValueError):
            readers.format_of(bad)
    footer = readers.parquet_footer(next(str(p) for p in (tmp_path / "a.parquet").glob("*.parquet")))
    assert footer["rows"] == 505 and footer["codecs"] == ["ZSTD"] and "id" in footer["columns"]
    (tmp_path / "i.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    assert {r["index"]: r.record["a"] for r in readers.read_json_index(spark, f"{base}/i.json").collect()} == {"k1": 1, "k2": 2}


def test_versions_reports_and_settings(spark, units, tmp_path):
    base = str(tmp_path)
    first = writers.save(units.limit(3), base, "set", {"note": "n"})
    second = writers.save(units.limit(4), base, "set")
    assert [v.rsplit("/", 1)[1] for v in writers.versions(spark, base, "set")] == [first.rsplit("/", 1)[1], second.rsplit("/", 1)[1]]
    writers.save_last_run(spark, f"{base}/last.json", input="a")
    assert readers.last_run(spark, f"{base}/last.json")["input"] == "a"
    (tmp_path / "last.yaml").write_text("input: b\n")
    assert readers.last_run(spark, f"{base}/last.yaml") == {"input": "b"}
    writers.write_report(spark, f"{base}/r.html", {"rows": 3}, html=True)
    assert "<td>rows</td><td>3</td>" in (tmp_path / "r.html").read_text()
    assert readers.newest(spark, base, "las", ".json").endswith("last.json")
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, base, "zzz")
    writers.write_lines(units.select("id", "nothing").limit(1), f"{base}/lines", ["id", "nothing"])
    assert spark.read.text(f"{base}/lines").first().value.endswith("|")
    flat = writers.flat_header(units.select(F.struct(F.lit(1).alias("unique"), F.lit(2).alias("total")).alias("serial")).limit(1), {"serial": ["unique", "total"]})
    assert flat.columns == ["serial_unique", "serial_total"]
    assert writers.conform(units.limit(1), spark.createDataFrame([], "two long, id string").schema).dtypes == [("two", "bigint"), ("id", "string")]


def test_names():
    assert columns.clean_names(["A b", "a-B", "", "x%"]) == ["a_b", "a_b_1", "", "x"]
    assert columns.clean_names(["serialNumber Id"], "snake") == ["serial_number_id"]
    assert columns.clean_names(["serial number-id"], "camel") == ["serialNumberId"]
    with pytest.raises(ValueError):
        columns.clean_names(["a"], "other")


def test_iqr_exclusion_of_a_lone_key(spark):
    """118 keys, quartiles 0 and 1: the bound is 2.5 and one key of 955 exceeds it."""
    counts = [0] * 60 + [1] * 50 + [2] * 7 + [955]
    df = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(counts)], "k string, n int")
    out = aggregates.upper_outliers(df, "n").collect()
    assert [(r.k, r.bound) for r in out] == [("k117", 2.5)]


def test_ties_at_the_cutoff_go_to_test(spark):
    df = spark.createDataFrame([(i, "a", min(i, 17)) for i in range(20)] + [(100 + i, "b", i) for i in range(5)] + [(200, "a", None)], "id long, label string, ts int")
    out = {r.id: r.split for r in sampling.class_time_split(df, "label", "ts", 0.1).collect()}
    assert [i for i in range(20) if out[i] == "test"] == [17, 18, 19]
    assert all(out[100 + i] == "train" for i in range(5)) and out[200] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=40), st.integers(1, 7))
def test_splits_cover_and_do_not_depend_on_partitions(spark, rows, parts):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, label int, ts int")
    one = sorted(map(tuple, sampling.class_random_split(df.coalesce(1), "label", "id", 0.3).select("id", "split").collect()))
    two = sorted(map(tuple, sampling.class_random_split(df.repartition(parts), "label", "id", 0.3).select("id", "split").collect()))
    assert one == two and len(one) == len(rows)
    keys = df.where("ts < 5").select("label")
    assert filters.only_keys(df, keys, ["label"]).count() + filters.exclude_keys(df, keys, ["label"]).count() == len(rows)
    assert sum(r.n for r in aggregates.combinations(df, ["label", "ts"]).collect()) == len(rows)


def test_sample_of_too_few_keys_raises(units):
    with pytest.raises(ValueError):
        sampling.sample_keys(units, "serial", 61)
    assert sampling.sample_keys(units, "serial", 60).count() == 60
    with pytest.raises(ValueError):
        filters.within_span(units, "ts", "2020-01-01", "2024-01-02")


def test_resampling_targets():
    counts = {0: 100_000, 1: 900, 2: 100}
    assert sampling.minority_preserving_targets(counts, 10_000, 5_000) == {1: 900, 2: 100, 0: 9_000}
    assert sampling.ratio_targets(counts, {0: 50, 1: 30}, 100) == {0: 50, 1: 30, 2: 10}
    assert sampling.minority_boost_targets(counts, 30_000) == {1: 3333, 2: 3333, 0: 23_334}
    assert [sampling.recommend_sampling(x) for x in (2, 500, 5000)] == ["proportional", "balanced", "minority_boost"]
    assert balance.reduction_targets(counts) == {0: 10_000, 1: 500, 2: 100}
    assert balance.undersampling_targets({0: 900, 1: 100}) == {0: 300, 1: 100}
    assert balance.recommend({0: 10, 1: 9}) == "none" and balance.recommend({0: 1000, 1: 100}) == "smote"


def test_smote_stays_between_its_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(20)], "id long, x double, y double")
    src = {r.id: (r.x, r.y) for r in df.collect()}
    out = balance.smote(df, "id", ["x", "y"], 33).collect()
    assert len(out) == 33
    for r in out:
        a, b = src[r.base], src[r.neighbour]
        assert r.base != r.neighbour and 0 < r.u < 1
        assert math.isclose(r.x, a[0] + r.u * (b[0] - a[0]), abs_tol=1e-9) and math.isclose(r.y, a[1] + r.u * (b[1] - a[1]), abs_tol=1e-9)
    with pytest.raises(ValueError):
        balance.smote(df.limit(1), "id", ["x"], 2)


def test_profile_rules(units):
    prof = profile.profile(units.drop("ts", "stamp"))
    rows = {r["column"]: r for r in prof.collect()}
    assert rows["nothing"].n_null == 505 and rows["constant"].constant and rows["id"].n_distinct == 500
    found = [(r.issue, r["column"]) for r in profile.issues(prof, 2).collect()]
    assert ("all_null", "nothing") in found and ("constant", "constant") in found
    assert profile.drop_candidates([("a", "x"), ("b", "book_state"), ("c", "x")]) == ["x"]
    assert profile.validate(units, required=["id", "gone"]) == ["missing column gone"]
    assert profile.categories(units)["ts"] == "temporal" and profile.categories(units)["two"] == "binary"
    assert "stamp" in profile.temporal_columns(units) and "serial" not in profile.temporal_columns(units)
    assert profile.similar_groups(units.sparkSession.createDataFrame([("temp_a", 5, 0), ("temp_b", 5, 0), ("other", 5, 1)], "column string, n_distinct long, n_null long")) == [["temp_a", "temp_b"]]
    score = profile.readiness(20_000, 1.0, 3, 0)
    assert score["score"] == 100 and profile.recommendations(score, []) == ["ready for encoding"]
    assert profile.feature_hints({"v": 3.0}, [("a", "b", 0.95)], {"c": 500}) == ["v: transform, skewness 3.0", "a, b: correlated, 0.95", "c: encode by target, 500 values"]
    assert profile.columns_like(units, ["limit"]) == ["limit"]
    chi = profile.chi2_homogeneity(units.where("two = 0"), units.where("two = 1"), "constant").first()
    assert chi.dof == 0


def test_encoding_rules(units):
    assert encode.strategy(False, False, 5) == "ordinal" and encode.strategy(True, False, 500) == "standard_scaling" and encode.folds_for(3_500) == 3
    filled = encode.treat_missing(units.withColumn("n", F.when(F.col("id") % 3 == 0, F.col("value"))), "n", "ffill", ["id"], "serial")
    assert filled.where("n is null and id % 60 = 0 and id % 3 = 0").count() == 0
    with pytest.raises(ValueError):
        encode.treat_missing(units, "value", "none needed")
    out = encode.vectorised(units.select("id", "serial", "value"), ["serial", "value"], {"serial": 60, "value": 97})
    assert out.where("serial_enc = 0").select("serial").distinct().count() == 1
    noisy = encode.noisy_target(units, "serial", "value", "id", noise=0.01)
    assert noisy.where("serial_enc is null").count() == 0
    unseen = encode.smoothed_target(units, "serial", "value", train=units.where("serial <> 'SN001'"))
    g = units.where("serial <> 'SN001'").agg(F.avg("value")).first()[0]
    assert all(math.isclose(r.serial_enc, g) for r in unseen.where("serial = 'SN001'").collect())


def test_associations(spark, units):
    assert associate.adjusted_mutual_information(units, "serial", "serial") > 0.999
    assert abs(associate.adjusted_mutual_information(units.where("id < 480"), "two", "label")) < 0.2
    assert associate.pair_loser("measure_value", "station_desc", {}) == "station_desc"
    assert associate.numeric_method(0.5, 0.45, 0.3) == ("pearson", 0.5) and associate.numeric_method(0.31, 0.3, 0.3)[0] == "kendall"
    assert associate.select_features({"a": 0.5, "b": 0.05}, 0.1) == ["a"] and associate.cutoff(1.0, "conservative", True) == 2.0
    assert associate.target_type(units, "two") == "binary" and associate.target_type(units, "value") == "numeric"
    got = associate.association(units.where("id < 500"), "value", "two", "id")
    assert got["test"] == "anova" and 0 <= got["p"] <= 1
    assert associate.association(units.limit(400), "serial", "two", "id")["test"] == "chi2"
    y = associate.chi2_yates(spark.createDataFrame([("a", 0)] * 10 + [("a", 1)] * 5 + [("b", 0)] * 4 + [("b", 1)] * 11, "x string, y int"), "x", "y").first().chi2
    assert math.isclose(y, 3.348214, rel_tol=1e-5)


def test_tail_probabilities():
    assert math.isclose(special.chi2_p(3.841459, 1), 0.05, rel_tol=1e-5) and math.isclose(special.chi2_p(18.307038, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(special.f_p(4.102821, 2, 10), 0.05, rel_tol=1e-5) and math.isclose(special.t_p(2.228139, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(special.ks_p(1.3581 * math.sqrt(2 / 1000), 1000, 1000), 0.05, rel_tol=1e-2)


def test_fuzzy_keys_merge_spellings(spark):
    names = ["Station Alpha 01"] * 5 + ["station alpha 01 "] * 2 + ["Station Alpha O1"] + ["Reflow Oven"] * 3 + [None]
    got = {r.key: r.canonical for r in dedup.fuzzy_keys(spark.createDataFrame([(n,) for n in names], "k string"), "k", 0.6).collect()}
    assert got["station alpha 01 "] == got["Station Alpha O1"] == "Station Alpha 01" and got["Reflow Oven"] == "Reflow Oven"
    again = dedup.fuzzy_keys(spark.createDataFrame([(v,) for v in got.values()], "k string"), "k", 0.6)
    assert all(r.key == r.canonical for r in again.collect())


def test_both_interval_joins_agree(spark):
    a = spark.range(60).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 37 % 200).alias("t"))
    b = spark.range(50).select(F.col("id").alias("j"), (F.col("id") % 4).alias("k"), F.timestamp_seconds(F.col("id") * 53 % 200).alias("u"))
    for how in ("left", "inner"):
        x, y = (sorted(map(str, joins.interval_join(a, b, ["k"], "t", "u", 5, how, bucketed=z).select("i", "j").collect())) for z in (False, True))
        assert x == y and (how != "left" or len(x) >= 60)


def test_configured_pipeline_and_exclusion(spark, units, tmp_path):
    run = pipeline.Run(folder=str(tmp_path))
    out = pipeline.run_steps(units, [{"step": "drop", "columns": ["nothing"]}, {"step": "binary_target", "column": "label", "out": "y"}, {"step": "undersample", "label": "y", "row_id": "id", "times": 3}, {"step": "class_weights", "label": "y"}], run)
    counts = {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == 3 * counts[1] and [s["state"] for s in run.steps] == ["done"] * 4
    with pytest.raises(KeyError):
        pipeline.run_steps(units, [{"step": "nothing like it"}], run)
    parts = pipeline.exclusion(units, "serial", "label", [0, 1, 2], 2, 1)
    assert parts["kept"].count() + units.join(parts["outliers"].select("serial"), "serial", "left_semi").count() == units.count()
    tables = pipeline.explore(units.select("id", "value", "two", "ts"), ["id", "value", "two"], "ts")
    assert set(tables) >= {"profile", "correlations", "business_hours"} and tables["moments"].count() == 3
    assert pipeline.counts_add_up(units, units.groupBy("label").agg(F.count("*").alias("n")))


def test_thresholds(spark):
    df = spark.createDataFrame([(0, 0.1, 0.1), (1, 0.7, 0.1), (2, 0.2, 0.9), (2, 0.1, 0.5)], "y int, p1 double, p2 double")
    best = models.best_thresholds(models.threshold_search(df, "y", "p1", "p2", [0.3, 0.6])).first()
    assert (best.t1, best.t2, best.recall_2) == (0.3, 0.3, 1.0)


def test_streams_equal_batch(spark, tmp_path):
    from traceweft.streaming import windows

    rows = [(i, i % 3, f"2024-01-01 0{i % 9}:00:00") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, user long, at string").withColumn("ts", F.to_timestamp_ntz("at")).drop("at")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = windows.windowed_counts(windows.stream(spark, f"{tmp_path}/in", df.schema), "ts", "user", late="0 seconds")
    windows.to_parquet(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = {(r.start, r.user): r.n for r in windows.windowed_counts(df, "ts", "user").collect()}
    got = {(r.start, r.user): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 3


def test_normality_and_unit_roots(spark):
    import numpy as np

    from traceweft.operators import stats

    rng = np.random.default_rng(4)
    normal, skewed, walk = rng.standard_normal(800), rng.exponential(size=800), np.cumsum(rng.standard_normal(800))
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(normal, skewed, walk))], "i int, normal double, skewed double, walk double")
    assert {r["column"]: r.normal for r in stats.dagostino(df, ["normal", "skewed"]).collect()} == {"normal": True, "skewed": False}
    assert stats.anderson_darling(df, "normal").first().normal and not stats.anderson_darling(df, "skewed").first().normal
    assert stats.dickey_fuller(df, "i", "normal").first().stationary and not stats.dickey_fuller(df, "i", "walk").first().stationary
    x, d = walk[:-1], np.diff(walk)
    a = np.stack([np.ones_like(x), x], axis=1)
    beta, res, *_ = np.linalg.lstsq(a, d, rcond=None)
    t = beta[1] / math.sqrt(res[0] / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
    assert math.isclose(stats.dickey_fuller(df, "i", "walk").first().statistic, t, rel_tol=1e-6)


def test_tests_of_means(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 80)] + [("b", float(x)) for x in rng.normal(0, 9, 80)] + [("c", float(x)) for x in rng.normal(8, 1, 80)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = associate.mean_test(df, "v", "g")
    assert got["test"] == "alexander_govern" and got["p"] < 1e-9
    same = spark.createDataFrame([(g, float(x)) for g in "ab" for x in rng.normal(0, 1, 90)], "g string, v double")
    assert associate.mean_test(same, "v", "g")["test"] == "anova"


def test_kendall_of_many_values(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1500, 5000)
    y = x * 2 + rng.integers(0, 6000, 5000)
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())
    df = spark.createDataFrame([(int(i), float(j)) for i, j in zip(x, y)] + [(None, 1.0)], "x long, y double")
    assert math.isclose(stats.kendall(df, "x", "y").first().tau, want, rel_tol=1e-9)


def test_smote_of_a_large_class(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 3000, (10_050, 2)).astype(float)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "id long, x double, y double")
    out = balance.smote(df, "id", ["x", "y"], 10_050).collect()
    assert len(out) == 10_050
    for r in out[:300]:
        d = ((x - x[r.base]) ** 2).sum(axis=1)
        d[r.base] = np.inf
        assert r.neighbour in np.argsort(d, kind="stable")[:5]


def test_smote_searches_from_starting_rows_only(spark, monkeypatch):
    """A few new rows of a large class cost a few rows times the class; blocks of any size give the same rows."""
    import numpy as np

    x = np.random.default_rng(6).integers(0, 300, (4000, 2)).astype(float)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "id long, x double, y double")
    met, search = spark.sparkContext.accumulator(0), balance._nearest

    def counted(features, k):
        run = search(features, k)

        def count(left, right):
            met.add(left.num_rows * right.num_rows)
            return run(left, right)

        return count

    want = {n: sorted(map(tuple, balance.smote(df, "id", ["x", "y"], n).collect())) for n in (10, 4010)}
    monkeypatch.setattr(balance, "BLOCK_ROWS", 250)
    monkeypatch.setattr(balance, "_nearest", counted)
    for n, pairs in ((10, 10 * 4000), (4010, 4000 * 4000)):
        met.value = 0
        got = sorted(map(tuple, balance.smote(df, "id", ["x", "y"], n).collect()))
        assert got == want[n] and len(got) == n and met.value == pairs
    for base, neighbour, *_ in want[10]:
        d = ((x - x[base]) ** 2).sum(axis=1)
        d[base] = np.inf
        assert neighbour in np.argsort(d, kind="stable")[:5]
    assert balance.smote(df, "id", ["x", "y"], 0).count() == 0


def test_exact_quantiles_beyond_one_buffer(spark, monkeypatch):
    """The rounds of counting give what one buffer gives, with ties, nulls, infinities and few values."""
    import numpy as np

    from traceweft.operators import orderstats

    rng = np.random.default_rng(3)
    rows = [(float(x), float(round(y, 1)), None if i % 3 else float(i % 2), float("inf") if i % 50 == 0 else -float(x) ** 3, None) for i, (x, y) in enumerate(zip(rng.lognormal(0, 3, 3000), rng.normal(0, 1, 3000)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    of, points = {c: F.col(c) for c in df.columns}, [0.0, 0.005, 0.25, 0.5, 0.9, 0.999, 1.0]
    want = orderstats.quantiles(df, of, points).first()
    monkeypatch.setattr(orderstats, "AT_ONCE", 10)
    monkeypatch.setattr(orderstats, "FEW", 20)
    monkeypatch.setattr(orderstats, "SLICES", 16)
    got = orderstats.quantiles(df, of, points).first()
    for c in "abcd":
        assert got[c] == pytest.approx(want[c], rel=1e-12), c
    assert want["e"] is None and got["e"] == [None] * len(points)


def test_running_sums_in_slices(spark, monkeypatch):
    from traceweft.operators import orderstats

    df = spark.createDataFrame([(float(i * i % 997), i % 7) for i in range(997) if (i * i % 997, i)], "x double, n long").groupBy("x").agg(F.sum("n").alias("n"))
    for down in (False, True):
        want = {r.x: r.upto for r in orderstats.running(df, "x", {"upto": "n"}, down).collect()}
        monkeypatch.setattr(orderstats, "AT_ONCE", 10)
        got = {r.x: r.upto for r in orderstats.running(df, "x", {"upto": "n"}, down, slices=8).collect()}
        monkeypatch.undo()
        assert got == want and len(got) > 400
    assert orderstats.running(df.limit(0), "x", {"upto": "n"}).collect() == []


def test_class_ranks_need_no_whole_class(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    got = sampling.hash_ranked(df, "k", "id").collect()
    for k in range(3):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r._rn)
        assert [r._rn for r in mine] == list(range(1, len(mine) + 1)) and all(r._n == len(mine) for r in mine)
        import hashlib

        assert [r.id for r in mine] == sorted((r.id for r in mine), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))


def test_fisher_and_dispatch(spark):
    assert associate.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert associate.fisher_p(8, 2, 1, 5) == pytest.approx(0.0349650350)
    rows = [(i, "ab"[i % 2], float(i % 2 * 30 + i % 23), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, cls int")
    a = associate.association(df, "kind", "x", "id")
    assert a["test"] == "kruskal" and a["p"] < 1e-6 and a["score"] > 5
    assert associate.association(df, "x", "cls", "id")["test"] in ("anova", "alexander_govern")
    few = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "x")] + [("b", "y")] * 3, "f string, t string")
    found = associate.independence(few, "f", "t")
    assert found["test"] == "fisher" and found["p"] == pytest.approx(0.4857142857) and found["statistic"] == 9.0


def test_isolated_values(spark):
    from traceweft.operators.isolation import isolation_scores

    df = spark.createDataFrame([(float(i % 50),) for i in range(2000)] + [(900.0,), (-700.0,), (None,)], "x double")
    got = {r.x: r.isolation for r in isolation_scores(df, "x").distinct().collect()}
    assert got[None] is None and min(got[900.0], got[-700.0]) > max(got[float(i)] for i in range(50))
    flags = stats.outlier_flags(df.withColumn("id", F.monotonically_increasing_id()), "x", "id")
    assert flags.where("consensus").count() == 2


def test_folder_of_a_cluster_is_asked_for():
    from types import SimpleNamespace

    from traceweft.sources import scratch

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        scratch.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_shapiro_wilk():
    w, p = special.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=2e-4) and p == pytest.approx(0.0067, abs=3e-4)
    assert special.shapiro_wilk([1.0, 1.0, 1.0]) == (1.0, 1.0)
    with pytest.raises(ValueError):
        special.shapiro_wilk([1.0, 2.0])


def test_shapley_values_by_definition(spark):
    """Additive, zero for a feature no tree uses, and right for one stump."""
    from traceweft.operators import models, shapley

    rows = [(i, float(i % 10), float(i % 3), 7.0, float(i % 10 > 6)) for i in range(300)] + [(999, None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    for pipe in (models.random_forest(["a", "b", "c"], "label", trees=4, depth=3), models.boosted_trees(["a", "b", "c"], "label", rounds=3, depth=2)):
        model = pipe.fit(df)
        values = shapley.shapley_values(model, df, ["a", "b", "c"], "id")
        by: dict = {}
        for r in values.collect():
            by.setdefault(r.id, {})[r.feature] = r.value
        assert set(by) == set(range(300)) and all(abs(v["c"]) < 1e-12 for v in by.values())
        assert by[9]["a"] > 0 > by[1]["a"] and max(abs(v["b"]) for v in by.values()) < by[9]["a"]
        scores = {r.id: r.rawPrediction[1] if hasattr(model.stages[-1], "treeWeights") and type(model.stages[-1]).__name__.startswith("GBT") else r.probability[1] for r in model.transform(df).collect()}
        assert all(sum(by[i].values()) == pytest.approx(scores[i], abs=1e-9) for i in by)
    with pytest.raises(ValueError):
        shapley.shapley_values(model, df, [f"f{i}" for i in range(13)], "id")
