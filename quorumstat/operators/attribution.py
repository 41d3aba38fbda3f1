"""Exact attributions of tree ensembles (M24): how much each feature moves each prediction.

A coalition of features has the value that the trees give when the other features are unknown:
at their splits a row goes both ways, by the share of a background table that went there. A
leaf's part in that is a product over the features on its path, of 1 or 0 (does the row stay
on the path there) or of the background's share. Its coalition weights are therefore the
coefficients of a polynomial product, worked out per leaf for whole Arrow batches. The node
tables are of model size; rows are never multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf: its value and, for each feature on its path, the interval (low, high] and the background's share."""

    value: float
    bounds: dict[int, tuple[float, float]]
    steps: list[tuple[int, int]]  # (feature, node reached) along the path
    share: dict[int, float] = field(default_factory=dict)

    def holds(self, x: np.ndarray, f: int) -> np.ndarray:
        low, high = self.bounds[f]
        return (x[:, f] > low) & (x[:, f] <= high)


def leaves(model) -> list[list[Leaf]]:
    """Leaves of every tree of a fitted tree regressor (last stage of a pipeline), values weighted as the ensemble does."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    trees = last.trees if hasattr(last, "trees") else [last]
    mean = hasattr(last, "trees") and "Forest" in type(last).__name__
    weights = [1.0 / len(trees)] * len(trees) if mean else list(getattr(last, "treeWeights", [1.0]))
    out = []
    for tree, weight in zip(trees, weights, strict=True):
        found: list[Leaf] = []
        number = 0
        stack = [(tree._java_obj.rootNode(), {}, [])]
        while stack:
            node, bounds, steps = stack.pop()
            if "LeafNode" in node.getClass().getName():
                found.append(Leaf(weight * node.prediction(), bounds, steps))
                continue
            split = node.split()
            f = split.featureIndex()
            if "Continuous" not in split.getClass().getName():
                raise ValueError("splits of categories have no interval")
            low, high = bounds.get(f, (-np.inf, np.inf))
            at = split.threshold()
            for child, own in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
                number += 1
                stack.append((child, bounds | {f: own}, [*steps, (f, number)]))
        out.append(found)
    return out


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.vstack(pdf["_v"].to_numpy()).astype(float)


def with_shares(trees: list[list[Leaf]], background: DataFrame, vec: str) -> tuple[list[list[Leaf]], int]:
    """Trees with the share of the background that goes each way, and the background's rows; one pass counts all leaves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(t), np.int64) for t in trees]
        for pdf in batches:
            x = _matrix(pdf)
            for own, t in zip(total, trees, strict=True):
                own += [int(np.logical_and.reduce([np.ones(len(x), bool), *(leaf.holds(x, f) for f in leaf.bounds)]).sum()) for leaf in t]
        yield pd.DataFrame([(i, j, int(n)) for i, own in enumerate(total) for j, n in enumerate(own)], columns=["tree", "leaf", "n"])

    rows = background.select(F.col(vec).alias("_v")).filter("_v is not null")
    counted = rows.mapInPandas(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    n = {(r["tree"], r["leaf"]): r["n"] for r in counted}
    size = 0
    for i, t in enumerate(trees):
        reached: dict[int, int] = {0: sum(n.get((i, j), 0) for j in range(len(t)))}
        size = reached[0]
        for j, leaf in enumerate(t):
            for _, node in leaf.steps:
                reached[node] = reached.get(node, 0) + n.get((i, j), 0)
        for leaf in t:
            leaf.share, before = {}, 0
            for f, node in leaf.steps:
                # Where no row of the background came, both ways count alike.
                step = reached[node] / reached[before] if reached[before] else 0.5
                leaf.share[f] = leaf.share.get(f, 1.0) * step
                before = node
    return trees, size


def leaf_effects(leaf: Leaf, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(feature, effect on each row) of one leaf."""
    features = list(leaf.bounds)
    d = len(features)
    on = {f: leaf.holds(x, f).astype(float) for f in features}
    weight = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
    for i in features:
        product = np.ones((1, len(x)))  # coefficient of t^s: coalitions of s features
        for j in features:
            if j != i:
                longer = np.zeros((len(product) + 1, len(x)))
                longer[:-1] += leaf.share[j] * product
                longer[1:] += on[j] * product
                product = longer
        yield i, leaf.value * (on[i] - leaf.share[i]) * np.tensordot(weight, product, axes=1)


def tree_attributions(model, df: DataFrame, background: DataFrame, vec: str, dim: int, out: str = "attributions") -> DataFrame:
    """Df with an array of one effect per feature, and ``base``: they add up to the prediction.

    The base is the mean prediction over the background (unless a way had no row of it). Rows with a NULL vector are left out.
    """
    trees, _ = with_shares(leaves(model), background, vec)
    base = sum(leaf.value * float(np.prod(list(leaf.share.values()))) for t in trees for leaf in t)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.vstack(pdf[vec].to_numpy()).astype(float) if len(pdf) else np.zeros((0, dim))
            effect = np.zeros((dim, len(x)))
            for t in trees:
                for leaf in t:
                    for f, e in leaf_effects(leaf, x):
                        effect[f] += e
            yield pdf.assign(**{out: list(effect.T), "base": base})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.filter(F.col(vec).isNotNull()).mapInPandas(explain, f"{kinds}, `{out}` array<double>, base double")


def attribution_summary(attributed: DataFrame, out: str = "attributions") -> DataFrame:
    """(feature, importance, mean_effect, n): mean absolute and mean effect over the rows."""
    e = attributed.select(F.posexplode(out).alias("feature", "e"))
    return e.groupBy("feature").agg(F.avg(F.abs("e")).alias("importance"), F.avg("e").alias("mean_effect"), F.count(F.lit(1)).alias("n"))
