"""Exact Shapley values of tree models: what each feature adds to a prediction, on average over all orders.

The value of a set of known features is the tree's expectation when unknown ones follow the training rows that passed
each node. All sets of the few features are walked, every walk over a whole batch of rows at once.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most features that all sets are walked of.
MOST = 12


def _tree(node, share: bool) -> tuple:
    """(feature, threshold, weight of the left, left, right) or a leaf's value, from a node of the JVM's model."""
    if node.numDescendants() == 0:
        if not share:
            return (float(node.prediction()),)
        stats = list(node.impurityStats().stats())
        return (stats[1] / max(sum(stats), 1e-300) if len(stats) > 1 else 0.0,)
    split = node.split()
    if not hasattr(split, "threshold"):
        raise ValueError("splits over categories are not supported")
    left, right = node.leftChild(), node.rightChild()
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (split.featureIndex(), split.threshold(), a / max(a + b, 1e-300), _tree(left, share), _tree(right, share))


def _expected(tree: tuple, x: np.ndarray, known: frozenset, weight: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return weight * tree[0]
    f, threshold, left, a, b = tree
    go = (x[:, f] <= threshold).astype(float) if f in known else np.full(len(x), left)
    return _expected(a, x, known, weight * go) + _expected(b, x, known, weight * (1 - go))


def shapley_values(model: PipelineModel, df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row_id, feature, value) and for each row the feature ``(base)``: base and values add up to the model's score.

    The score is the probability of class 1 of a forest (the mean of its trees' leaf shares), or the raw margin of
    boosted trees. Rows with a null feature are left out, as the model does. At most MOST features.
    """
    if len(features) > MOST:
        raise ValueError(f"{len(features)} features; all sets of at most {MOST} are walked")
    last = model.stages[-1]
    boosted = type(last).__name__.startswith("GBT")
    weights = list(last.treeWeights) if boosted else [1.0 / len(last.trees)] * len(last.trees)
    trees = [(w, _tree(t._java_obj.rootNode(), not boosted)) for w, t in zip(weights, last.trees)]
    sets = [frozenset(s) for k in range(len(features) + 1) for s in combinations(range(len(features)), k)]
    n = len(features)
    part = [math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) for k in range(n)]
    kind = df.schema[row_id].dataType.simpleString()

    def explain(batches):
        for b in batches:
            x, one = b[features].to_numpy(dtype=float), np.ones(len(b))
            value = {s: sum(w * _expected(t, x, s, one) for w, t in trees) for s in sets}
            out = {"(base)": value[frozenset()]}
            for j, f in enumerate(features):
                out[f] = sum(part[len(s)] * (value[s | {j}] - value[s]) for s in sets if j not in s)
            for f, v in out.items():
                yield pd.DataFrame({row_id: b[row_id], "feature": f, "value": v})

    return df.select(row_id, *[F.col(f).cast("double").alias(f) for f in features]).na.drop(subset=features).mapInPandas(explain, f"`{row_id}` {kind}, feature string, value double")


def global_importance(values: DataFrame) -> DataFrame:
    """(feature, importance): mean size of each feature's values."""
    return values.where("feature <> '(base)'").groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
