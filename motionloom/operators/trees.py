"""Boosted trees over window features: training on a bounded sample, model files, scores of all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.operators.learning import TIERS, cap_per_class

# Rows from which a tier holds; depth, rate, least rows of a leaf, share of features and of rows, rounds.
SETTINGS = (
    (100_000, (11, 0.04, 100, 0.8, 0.8, 1000)), (20_000, (9, 0.06, 50, 0.85, 0.8, 600)),
    (5_000, (7, 0.08, 30, 0.9, 0.8, 400)), (0, (5, 0.1, 10, 0.9, 1.0, 200)),
)
BINS = 64


@dataclass
class Tree:
    """Nodes by number, the first the root. A node with feature -1 is a leaf; rows with a value up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            live = np.flatnonzero(f >= 0)
            if len(live) == 0:
                return self.value[at]
            here = at[live]
            low = np.nan_to_num(x[live, f[live]]) <= self.threshold[here]
            at[live] = np.where(low, self.left[here], self.right[here])


@dataclass
class TreeModel:
    """Trees of all classes in turn (round by round), with the scaling of their input."""

    labels: list[str]
    trees: list[Tree] = field(default_factory=list)
    base: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.mean is not None:
            x = (x - self.mean) / self.scale
        out = np.zeros((len(x), len(self.labels))) + (0 if self.base is None else self.base)
        for n, tree in enumerate(self.trees):
            out[:, n % len(self.labels)] += tree.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) to (rows, classes): probabilities that add up to one."""
        e = self.raw(x)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def read_tree_text(text: str, labels: Sequence[str], mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> TreeModel:
    """A model from the plain-text form in which gradient-boosting libraries save multiclass trees with numeric splits.

    Blocks begin with ``Tree=``; children below 0 are leaves (-1 the first). Trees with categorical splits raise.
    """
    model = TreeModel(list(labels), mean=mean, scale=scale)
    for block in text.split("\nTree=")[1:]:
        part = dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
        leaves = np.array(part["leaf_value"].split(), dtype=float)
        if int(part.get("num_cat", "0")):
            raise ValueError("trees with categorical splits aren't read")
        n = len(leaves) - 1
        if n == 0:
            model.trees.append(Tree(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), leaves))
            continue
        feature, left, right = (np.array(part[k].split(), dtype=int) for k in ("split_feature", "left_child", "right_child"))
        place = lambda c: np.where(c < 0, n - 1 - c, c)
        none = np.zeros(n + 1, dtype=int)
        model.trees.append(
            Tree(
                np.r_[feature, none - 1],
                np.r_[np.array(part["threshold"].split(), dtype=float), none],
                np.r_[place(left), none],
                np.r_[place(right), none],
                np.r_[np.zeros(n), leaves],
            )
        )
    return model


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, leaves: int, least: int, rate: float, l1: float, l2: float) -> Tree:
    """One tree, best split first, from gradients ``g`` and curvatures ``h`` of the ``rows``."""
    wide = np.arange(len(features)) * BINS
    nodes: list[list] = []

    def weight(gs: float, hs: float) -> float:
        return -np.sign(gs) * max(abs(gs) - l1, 0.0) / (hs + l2)

    def best(at: np.ndarray) -> tuple | None:
        if len(at) < 2 * least:
            return None
        place = (bins[np.ix_(at, features)] + wide).ravel()
        sums = [np.bincount(place, None if w is None else np.repeat(w[at], len(features)), len(features) * BINS).reshape(-1, BINS).cumsum(axis=1) for w in (None, g, h)]
        n, gl, hl = sums
        gt, ht = g[at].sum(), h[at].sum()
        score = lambda a, b: np.maximum(np.abs(a) - l1, 0.0) ** 2 / (b + l2)
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
        gain[(n < least) | (len(at) - n < least)] = 0.0
        f, b = divmod(int(np.argmax(gain)), BINS)
        return (gain[f, b], features[f], b) if gain[f, b] > 1e-9 else None

    def add(at: np.ndarray, level: int) -> int:
        nodes.append([-1, 0.0, 0, 0, rate * weight(g[at].sum(), h[at].sum())])
        split = best(at) if level < depth else None
        if split:
            open_.append((split, len(nodes) - 1, at, level))
        return len(nodes) - 1

    open_: list[tuple] = []
    add(rows, 0)
    count = 1
    while open_ and count < leaves:
        k = max(range(len(open_)), key=lambda i: open_[i][0][0])
        (_, f, b), node, at, level = open_.pop(k)
        low = bins[at, f] <= b
        nodes[node][:2] = [f, edges[f][b] if b < len(edges[f]) else np.inf]
        nodes[node][2], nodes[node][3] = add(at[low], level + 1), add(at[~low], level + 1)
        count += 1
    return Tree(*(np.array(c) for c in zip(*nodes)))


def train_trees(x: np.ndarray, y: np.ndarray, labels: Sequence[str], seed: int = 42, rounds: int | None = None, l1: float = 0.1, l2: float = 0.1) -> TreeModel:
    """Multiclass boosting by the softmax loss, with the settings of the tier that the number of rows is in.

    Input is scaled to mean 0 and deviation 1; rows of rare classes weigh more where the largest class has
    over three times the rows of the smallest. The same input gives the same trees.
    """
    depth, rate, least, share, bag, number = next(s for at, s in SETTINGS if len(x) >= at)
    leaves = next(n for at, n in TIERS if len(x) >= at)
    scale = x.std(axis=0)
    model = TreeModel(list(labels), mean=x.mean(axis=0), scale=np.where(scale == 0, 1.0, scale))
    z = (x - model.mean) / model.scale
    edges = [np.unique(np.quantile(z[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(z.shape[1])]
    bins = np.stack([np.searchsorted(e, z[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    size = np.bincount(y, minlength=len(labels))
    weight = np.ones(len(x))
    if size.min() and size.max() / size.min() > 3:
        weight = (len(x) / len(labels) / size)[y]
    model.base = np.log(np.maximum(np.bincount(y, weight, len(labels)), 1e-9) / weight.sum())
    score = np.tile(model.base, (len(x), 1))
    rng = np.random.default_rng(seed)
    for _ in range(rounds or number):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        rows = np.sort(rng.choice(len(x), max(1, int(len(x) * bag)), replace=False)) if bag < 1 else np.arange(len(x))
        features = np.sort(rng.choice(z.shape[1], max(1, int(z.shape[1] * share)), replace=False))
        for c in range(len(labels)):
            g, h = (p[:, c] - (y == c)) * weight, np.maximum(p[:, c] * (1 - p[:, c]) * weight, 1e-9)
            tree = _grow(bins, edges, g, h, rows, features, depth, leaves, least, rate, l1, l2)
            model.trees.append(tree)
            score[:, c] += tree.predict(z)
    return model


def fit_trees(df: DataFrame, vector: str, label: str, key: Sequence[str], most_per_class: int = 20_000, **settings: object) -> TreeModel:
    """``train_trees`` on at most ``most_per_class`` rows of each class, chosen by hash order of ``key``: a bounded sample for the fit only."""
    known = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label, vector, *[k for k in key if k != label])
    rows = cap_per_class(known, label, key, most_per_class).orderBy(*key).toPandas()
    labels = sorted(rows[label].unique())
    if not labels:
        raise ValueError("no labelled rows to train on")
    x = np.stack(rows[vector].map(lambda v: np.asarray(v, dtype=float)).to_list())
    return train_trees(x, rows[label].map({n: k for k, n in enumerate(labels)}).to_numpy(), labels, **settings)


def score_rows(df: DataFrame, vector: str, model: TreeModel, name: str = "p") -> DataFrame:
    """``df`` with ``name``, the class probabilities of each row as an array in the order of the model's labels; the model is broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(shared.value.predict(np.stack(s.map(lambda v: np.asarray(v, dtype=float)).to_list())))) if len(s) else pd.Series([], dtype=object)

    return df.withColumn(name, score(F.col(vector)))


def best_label(p: Column, labels: Sequence[str]) -> Column:
    """The label of highest probability, the first at a tie."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))
