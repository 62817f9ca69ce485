"""Models by pyspark.ml, and evaluation as aggregations over (label, prediction)."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceweft.operators.orderstats import running


#: Rows in one bucket of a permutation.
PERMUTED = 100_000


def assembled(features: list[str], impute: bool = False) -> list:
    """Stages that make the column ``features``; with ``impute`` nulls become means, else such rows are skipped."""
    if not impute:
        return [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")]
    filled = [f"{c}__filled" for c in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="skip")]


def _weight(weight: str | None) -> dict:
    return {"weightCol": weight} if weight else {}


def random_forest(features: list[str], label: str, weight: str | None = None, trees: int = 100, depth: int = 8, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[*assembled(features), RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, **_weight(weight))])


def boosted_trees(features: list[str], label: str, classes: int = 2, rounds: int = 50, depth: int = 5, rate: float = 0.1, weight: str | None = None, seed: int = 42) -> Pipeline:
    """Binary boosting; more classes by one model against the rest each."""
    gbt = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **_weight(weight))
    return Pipeline(stages=[*assembled(features), gbt if classes == 2 else OneVsRest(classifier=gbt, labelCol=label, **_weight(weight))])


def logistic(features: list[str], label: str, penalty: float = 0.01, l1: float = 0.0, weight: str | None = None, iterations: int = 100) -> Pipeline:
    return Pipeline(stages=[*assembled(features, True), LogisticRegression(labelCol=label, regParam=penalty, elasticNetParam=l1, maxIter=iterations, **_weight(weight))])


def lasso_cv(train: DataFrame, features: list[str], label: str, penalties: Iterable[float], folds: int = 5, seed: int = 42):
    lr = LinearRegression(labelCol=label, elasticNetParam=1.0)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed, parallelism=4)
    return Pipeline(stages=[*assembled(features), cv]).fit(train)


def ridge_cv(train: DataFrame, features: list[str], label: str, penalties: Iterable[float], folds: int = 3, weight: str | None = None, seed: int = 42):
    """Ridge penalty of a logistic classifier (another loss than a ridge classifier's), by cross-validation."""
    return logistic_cv(train, features, label, penalties, (0.0,), folds, weight=weight, seed=seed)


def logistic_cv(train: DataFrame, features: list[str], label: str, penalties: Iterable[float], l1: Iterable[float] = (1.0,), folds: int = 5, iterations: Iterable[int] = (100,), weight: str | None = None, metric: str = "f1", seed: int = 42):
    lr = LogisticRegression(labelCol=label, **_weight(weight))
    grid = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).addGrid(lr.elasticNetParam, list(l1)).addGrid(lr.maxIter, list(iterations)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName=metric), numFolds=folds, seed=seed, parallelism=4)
    return Pipeline(stages=[*assembled(features, True), cv]).fit(train)


def trees_cv(train: DataFrame, features: list[str], label: str, depths: Iterable[int], rounds: Iterable[int], folds: int = 3, seed: int = 42):
    """Grid of binary boosted trees by macro recall (that of unweighted classes)."""
    gbt = GBTClassifier(labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.maxIter, list(rounds)).build()
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="weightedRecall"), numFolds=folds, seed=seed)
    return Pipeline(stages=[*assembled(features), cv]).fit(train)


def regularisation_path(train: DataFrame, features: list[str], label: str, penalties: Iterable[float], l1: float = 1.0) -> DataFrame:
    """(penalty, feature, coefficient) for each penalty."""
    rows = []
    for p in penalties:
        m = Pipeline(stages=[*assembled(features), LinearRegression(labelCol=label, elasticNetParam=l1, regParam=p)]).fit(train)
        rows += [(float(p), f, float(c)) for f, c in zip(features, m.stages[-1].coefficients)]
    return train.sparkSession.createDataFrame(rows, "penalty double, feature string, coefficient double")


def coefficients(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by size of their coefficient, or of their importance in trees."""
    last = model.stages[-1]
    last = getattr(last, "bestModel", last)
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).max(axis=0)
    else:
        values = last.coefficients.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-abs(x[1]), x[0]))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, row_id: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Loss of balanced accuracy when a feature's values are dealt to other rows by hashes of their ids, bucket by bucket."""

    def balanced(scored: DataFrame) -> float:
        per = scored.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("r"))
        return per.agg(F.avg("r")).first()[0]

    base = balanced(model.transform(df))
    # rows are numbered inside buckets of a hash, on top of the buckets before; so no task sorts the table
    size, rows = max(1, -(-df.count() // PERMUTED)), []

    def numbered(x: DataFrame, k: int) -> DataFrame:
        x = x.withColumns({"_b": F.pmod(F.xxhash64(row_id, F.lit(k)), F.lit(size)), "_o": F.xxhash64(row_id, F.lit(k), F.lit(1))})
        counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
        before = counts.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_b").orderBy("_o", row_id)) + F.col("_before")
        return x.join(F.broadcast(before), "_b").withColumn("_p", place).drop("_b", "_o", "_before")

    own = numbered(df, seed)
    for f in features:
        drops = []
        for k in range(repeats):
            dealt = numbered(df.select(row_id, F.col(f).alias("_v")), seed + k + 1).select("_p", "_v")
            drops.append(base - balanced(model.transform(own.join(dealt, "_p").withColumn(f, F.col("_v")).drop("_v", "_p"))))
        mean = sum(drops) / repeats
        spread = (sum((x - mean) ** 2 for x in drops) / repeats) ** 0.5
        rows.append((f, mean, spread, mean > 2 * spread))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, spread double, stable boolean")


def leaderboard(train: DataFrame, test: DataFrame, candidates: dict[str, Pipeline], label: str, seconds: float = 1800) -> DataFrame:
    """Fits candidates until the time is up and ranks them on a test part that none of them has seen."""
    began, rows = time.time(), []
    for name, pipeline in candidates.items():
        if time.time() - began > seconds:
            break
        t = time.time()
        model = pipeline.fit(train)
        fit = time.time() - t
        m = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
        rows.append((name, name.split("_", 1)[0], float(m.evaluate(model.transform(test))), fit))
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[2]), "model string, algorithm string, f1 double, fit_s double")


def class_probability(k: int) -> Column:
    return vector_to_array("probability")[k]


def threshold_decision(p1: Column, p2: Column, t1, t2) -> Column:
    """2 where its probability is over t2, else 1 where its is over t1, else 0."""
    return F.when(p2 > t2, 2).when(p1 > t1, 1).otherwise(0)


def threshold_search(scored: DataFrame, label: str, p1: str, p2: str, grid: list[float]) -> DataFrame:
    """For each pair of thresholds recall and precision of the classes 1 and 2; the bounded grid meets each row once."""
    cells = F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a in grid for b in grid])
    x = scored.select(label, p1, p2, F.explode(cells).alias("t")).select(label, "t.t1", "t.t2", threshold_decision(F.col(p1), F.col(p2), F.col("t.t1"), F.col("t.t2")).alias("d"))
    rate = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(of)), F.lit(0.0))
    y, d = F.col(label), F.col("d")
    return x.groupBy("t1", "t2").agg(*[e for k in (1, 2) for e in (rate((y == k) & (d == k), y == k).alias(f"recall_{k}"), rate((y == k) & (d == k), d == k).alias(f"precision_{k}"))])


def best_thresholds(search: DataFrame) -> DataFrame:
    """Of the pairs that miss no row of class 2, the one with the greatest sum of precisions."""
    return search.where("recall_2 = 1").orderBy(F.desc(F.col("precision_1") + F.col("precision_2")), "t1", "t2").limit(1)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side."""
    c = confusion(df, label, prediction)
    y = c.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)).alias("hits"))
    p = c.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("claimed"))
    j = y.join(p, "class", "full").na.fill(0)
    precision, recall = F.coalesce(F.try_divide("hits", F.col("claimed")), F.lit(0.0)), F.coalesce(F.try_divide("hits", F.col("support")), F.lit(0.0))
    return j.select("class", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "support")


def overall(report: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 of a class report."""
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return report.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), w("precision"), w("recall"), w("f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of a 0/1 label by average ranks, from counts per score."""
    c = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) == 0).cast("double").alias("q"))
    x = running(c, "s", {"upto": "q"}).select("p", "q", (F.col("upto") - F.col("q")).alias("b"))
    return x.agg((F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    c = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    total = c.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    run = running(c, "threshold", {"up": "p", "uq": "q"}, descending=True).join(F.broadcast(total))
    return run.select("threshold", (F.col("uq") / F.col("tq")).alias("fpr"), (F.col("up") / F.col("tp")).alias("tpr"))
