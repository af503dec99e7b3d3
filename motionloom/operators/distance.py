"""Distances between gesture series, neighbours and the two-dimensional map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionloom.runtime import cut


def shape_descriptors(x: np.ndarray, width: int = 4) -> np.ndarray:
    """Raw subsequence around every frame, the ends repeated."""
    half = width // 2
    padded = np.concatenate([np.repeat(x[:1], half, axis=0), x, np.repeat(x[-1:], width - half - 1 if width > half else 0, axis=0)])
    return np.concatenate([padded[k : k + len(x)] for k in range(width)], axis=1)


def warping_distance(a: np.ndarray, b: np.ndarray, width: int = 4) -> tuple[float, float]:
    """Shape time warping of two multivariate series: (normalised, raw) distance.

    The path minimises the distance of subsequence descriptors with steps down, right and
    diagonal; the distance is that of the plain series along the path, the normalised one by
    the sum of both lengths. The published method leaves the divisor open; this choice is recorded here.
    """
    if len(a) == 0 or len(b) == 0:
        return float("nan"), float("nan")
    da, db = shape_descriptors(a, width), shape_descriptors(b, width)
    cost = np.sqrt(np.maximum(((da**2).sum(1)[:, None] + (db**2).sum(1)[None] - 2 * da @ db.T), 0))
    n, m = cost.shape
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0.0
    # Cells of one anti-diagonal depend on the two before it only.
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        acc[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(acc[i - 1, j], acc[i, j - 1]), acc[i - 1, j - 1])
    raw, i, j = 0.0, n, m
    while i and j:
        raw += float(np.linalg.norm(a[i - 1] - b[j - 1]))
        k = int(np.argmin([acc[i - 1, j - 1], acc[i - 1, j], acc[i, j - 1]]))
        i, j = (i - 1, j - 1) if k == 0 else (i - 1, j) if k == 1 else (i, j - 1)
    return raw / (n + m), raw


def gesture_series(frames: DataFrame, by: str, columns: list[str], index: str = "frame_idx", centred: list[str] | None = None) -> DataFrame:
    """One row per gesture: its frames in order as an array of vectors. A gesture is a clip of seconds.

    ``centred``: columns that follow ``columns``, each less its mean over the gesture's frames.
    """
    value = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    centred = centred or []
    step = F.struct(F.col(index).alias("i"), F.array(*[value(c) for c in (*columns, *centred)]).alias("v"))
    means = F.array(*[F.lit(0.0) for _ in columns], *[F.avg(value(c)) for c in centred])
    out = frames.groupBy(F.col(by).alias("gesture")).agg(F.array_sort(F.collect_list(step)).alias("steps"), means.alias("means"))
    return out.select("gesture", F.transform("steps", lambda x: F.zip_with(x["v"], "means", lambda a, m: a - m)).alias("series"))


def pairwise_distances(series: DataFrame, blocks: int | None = None, width: int = 4) -> DataFrame:
    """gesture_i, gesture_j, distance of all pairs, mirrored, with a zero diagonal.

    The matrix is the feature. Gestures are cut into blocks; each pair of blocks is a join key,
    so pairs arise by an equality join, each computed once in the upper triangle, and work
    spreads over blocks**2 keys; by default there are 64 gestures to a block and 16 blocks at least. A failed pair gives NaN.
    """
    blocks = blocks or max(16, -(-series.count() // 64))
    own = series.withColumn("block", F.pmod(F.xxhash64("gesture"), F.lit(blocks)).cast("int"))
    left = own.select(F.col("gesture").alias("gi"), F.col("series").alias("si"), F.col("block").alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bj"))
    right = own.select(F.col("gesture").alias("gj"), F.col("series").alias("sj"), F.col("block").alias("bj"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bi"))
    pairs = left.join(right, ["bi", "bj"]).where("gi < gj")

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = [warping_distance(np.stack([np.asarray(f) for f in x]), np.stack([np.asarray(f) for f in y]), width)[0] for x, y in zip(a, b)]
            yield pd.Series(out, dtype=float)

    upper = pairs.select("gi", "gj", distance("si", "sj").alias("d"))
    both = F.explode(F.array(*[F.struct(F.col(a).alias("gesture_i"), F.col(b).alias("gesture_j"), F.col("d").alias("distance")) for a, b in (("gi", "gj"), ("gj", "gi"))]))
    zero = series.select(F.col("gesture").alias("gesture_i"), F.col("gesture").alias("gesture_j"), F.lit(0.0).alias("distance"))
    return upper.select(both.alias("p")).select("p.*").unionByName(zero)


def nearest(distances: DataFrame, k: int = 15) -> DataFrame:
    """The k nearest other gestures of each, ties by name."""
    w = Window.partitionBy("gesture_i").orderBy("distance", "gesture_j")
    return distances.where("gesture_i <> gesture_j").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def planar_map(distances: DataFrame, most: int = 2000) -> DataFrame:
    """x, y, gesture by classical scaling of the distance matrix.

    A deterministic stand-in for an unseeded neighbour embedding. Up to ``most`` gestures are scaled together in one
    task. Of more, ``most`` landmarks in hash order are, and every other gesture is placed by its distances to
    them, which gives the same map wherever distances are those of points in a plane. A distance that is NaN counts as 0.
    """
    names = distances.select(F.col("gesture_i").alias("gesture")).distinct()
    kind = dict(names.dtypes)["gesture"]
    pairs = distances.select("gesture_i", "gesture_j", F.nanvl(F.col("distance"), F.lit(0.0)).alias("distance"))
    if names.count() <= most:
        return pairs.repartition(1).mapInPandas(_scaled, f"gesture {kind}, x double, y double, mx double, my double, mean double").select("x", "y", "gesture")
    marks = cut(names.orderBy(F.xxhash64("gesture"), "gesture").limit(most))
    i, j = (F.broadcast(marks.withColumnRenamed("gesture", f"gesture_{k}")) for k in "ij")
    fixed = cut(pairs.join(i, "gesture_i").join(j, "gesture_j").repartition(1).mapInPandas(_scaled, f"gesture {kind}, x double, y double, mx double, my double, mean double"))
    rest = pairs.join(i, "gesture_i", "left_anti").join(F.broadcast(fixed.withColumnRenamed("gesture", "gesture_j")), "gesture_j")
    off = F.col("distance") ** 2 - F.col("mean")
    placed = rest.groupBy(F.col("gesture_i").alias("gesture")).agg(*[F.sum(-0.5 * off * F.col(m)).alias(a) for a, m in (("x", "mx"), ("y", "my"))])
    return fixed.select("x", "y", "gesture").unionByName(placed.select("x", "y", "gesture"))


def _scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the gestures of a whole distance matrix, with what places another gesture among them."""
    parts = list(batches)
    if not parts:
        return
    m = pd.concat(parts).pivot(index="gesture_i", columns="gesture_j", values="distance").sort_index().sort_index(axis=1)
    if m.empty:
        return
    d = np.nan_to_num(m.to_numpy(dtype=float)) ** 2
    c = np.eye(len(d)) - 1 / len(d)
    values, vectors = np.linalg.eigh(-0.5 * c @ d @ c)
    values, vectors = np.maximum(values[::-1][:2], 0), vectors[:, ::-1][:, :2]
    values, vectors = np.pad(values, (0, 2 - len(values))), np.pad(vectors, ((0, 0), (0, 2 - vectors.shape[1])))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(2)] < 0, -1, 1)
    place = vectors * np.sqrt(values)
    weight = vectors / np.sqrt(np.where(values > 1e-12, values, np.inf))
    yield pd.DataFrame({"gesture": m.index, "x": place[:, 0], "y": place[:, 1], "mx": weight[:, 0], "my": weight[:, 1], "mean": d.mean(axis=1)})
