"""Feature scaling, sampling, folds, evaluation and scoring for gesture models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.operators.sliced import SLICE, running_sum
from motionloom.runtime import finite


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1. The one-row statistics are joined, not collected."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    out = df.crossJoin(F.broadcast(stats))  # one row by construction
    return out.withColumns(
        {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in columns}
    ).drop(*stats.columns)


def encode_labels(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """0.. in order of the sorted distinct labels; the distinct labels are few by nature and joined back."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = codes.withColumn(name, F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(codes, label, "left")


def _shuffled(*cols: str) -> Column:
    """A fixed pseudo-random order that both engines and every run agree on."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols]))


def cap_per_class(df: DataFrame, label: str, key: Sequence[str], cap: int, lanes: int = 64) -> DataFrame:
    """At most ``cap`` rows of each class, chosen by hash order; classes within the cap stay whole.

    Each lane of a class gives its own first ``cap`` rows before the class is ranked, so no task sorts a whole class.
    """
    order = _shuffled(*key)
    lane = Window.partitionBy(label, "_lane").orderBy("_o", *key)
    some = df.withColumn("_o", order).withColumn("_lane", F.pmod(F.crc32(F.col("_o")), F.lit(lanes)))
    some = some.withColumn("_k", F.row_number().over(lane)).where(F.col("_k") <= cap)
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_o", *key))).where(F.col("_k") <= cap)
    return some.drop("_o", "_lane", "_k")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5) -> DataFrame:
    """fold 0..k-1, each with an equal part of every class up to one row per lane, in hash order.

    Rows are numbered within 256 hash lanes of a class and the lanes begin at different folds, so no task numbers a whole class.
    """
    lane = F.pmod(F.crc32(F.col("_o")), F.lit(256))
    w = Window.partitionBy(label, "_lane").orderBy("_o", *key)
    out = df.withColumn("_o", _shuffled(*key)).withColumn("_lane", lane)
    return out.withColumn("fold", F.pmod(F.row_number().over(w) + F.col("_lane"), F.lit(k)).cast("int")).drop("_o", "_lane")


def window_counts(df: DataFrame, label: str, width: int = 5) -> DataFrame:
    """Frames per label and how many windows of stride 1 and 2 they could give."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("frames"))
    return n.withColumns(
        {
            "windows_stride1": F.greatest(F.lit(0), F.col("frames") - width + 1),
            "windows_stride2": F.greatest(F.lit(0), F.floor((F.col("frames") - width) / 2) + 1),
        }
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Smallest, largest and mean class size, their ratio and the advice it calls for."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"), (F.max("n") / F.min("n")).alias("ratio")
    )
    return c.withColumn("advice", F.when(F.col("ratio") > 5, "severe").when(F.col("ratio") > 2, "moderate").otherwise("balanced")).withColumn(
        "size_advice", F.when(F.col("smallest") < 500, "few").when(F.col("largest") > 100000, "many").otherwise("enough")
    )


def label_shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") * 100.0 / F.col("total")).alias("share"))


# Rows from which a tier holds, and its leaves.
TIERS = ((100_000, 255), (20_000, 127), (5_000, 63), (0, 31))


def leaves_for(rows: Column) -> Column:
    out = F.lit(TIERS[-1][1])
    for at, leaves in reversed(TIERS[:-1]):
        out = F.when(rows >= at, F.lit(leaves)).otherwise(out)
    return out


def accuracy(df: DataFrame, label: str, predicted: str, fold: str) -> DataFrame:
    """Accuracy per fold."""
    return df.groupBy(fold).agg(F.avg(F.when(F.col(label) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"))


def confusion(df: DataFrame, label: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    return df.groupBy(label).pivot(predicted, list(classes)).count().na.fill(0, list(classes))


def motion_accuracy(true: Sequence[Column], given: Sequence[Column]) -> Column:
    """Whether motion and class agree after zeroing rows without motion and binarising: motion at 0.5, classes at 0.9."""
    def code(motion: Column, gesture: Column, move: Column) -> Column:
        on = motion >= 0.5
        return F.when(on & (gesture >= 0.9), 0).when(on & (move >= 0.9), 1).otherwise(0)

    return (code(*true) == code(*given)).cast("int")


def motion_loss(motion: Column, gesture: Column, move: Column, p_motion: Column, p_gesture: Column, p_move: Column, smoothing: float = 0.05) -> Column:
    """Half the sum of the binary cross entropy of motion and the smoothed class cross entropy, the latter only where there is motion."""
    eps = 1e-7
    clip = lambda p: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    smooth = lambda y: y * (1 - smoothing) + smoothing / 2
    binary = -(motion * F.ln(clip(p_motion)) + (1 - motion) * F.ln(1 - clip(p_motion)))
    total = p_gesture + p_move
    classes = -(smooth(gesture) * F.ln(clip(p_gesture / total)) + smooth(move) * F.ln(clip(p_move / total)))
    return (binary + motion * classes) * 0.5


def z_scored(v: Column) -> Column:
    """A vector less its mean, by its population deviation plus 1e-8."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    return F.transform(v, lambda x: (x - mean) / (F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-8))


def expand_channels(x: np.ndarray) -> np.ndarray:
    """(windows, frames, channels) to six times the channels: centred, two differences, and the deviations of all three over time; then each frame z-scored."""
    d1 = np.diff(x, axis=1, prepend=x[:, :1])
    d2 = np.diff(d1, axis=1, prepend=d1[:, :1])
    flat = [np.broadcast_to(v.std(axis=1, keepdims=True), x.shape) for v in (x, d1, d2)]
    out = np.concatenate([x - x.mean(axis=1, keepdims=True), d1, d2, *flat], axis=2)
    return (out - out.mean(axis=2, keepdims=True)) / (out.std(axis=2, keepdims=True) + 1e-8)


def synthetic_network(channels: int, frames: int = 25, filters: Sequence[int] = (48, 96, 192), hidden: int = 256, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights of the published shape, as no trained ones are at hand."""
    rng = np.random.default_rng(seed)
    out, c = {}, 6 * channels  # the forward pass expands each channel sixfold
    for n, f in enumerate(filters):
        out[f"conv{n}"] = rng.normal(0, (2 / (3 * c)) ** 0.5, (3, c, f)).astype(np.float32)
        out[f"bias{n}"] = np.zeros(f, dtype=np.float32)
        out[f"gamma{n}"], out[f"var{n}"] = rng.uniform(0.8, 1.2, (2, f)).astype(np.float32)
        out[f"beta{n}"], out[f"mean{n}"] = rng.normal(0, 0.1, (2, f)).astype(np.float32)
        c = f
    out["dense"] = rng.normal(0, (2 / (frames * c)) ** 0.5, (frames * c, hidden)).astype(np.float32)
    out["motion"] = rng.normal(0, 0.06, (hidden, 1)).astype(np.float32)
    out["gesture"] = rng.normal(0, 0.06, (hidden, 2)).astype(np.float32)
    return out


def network_forward(x: np.ndarray, w: Mapping[str, np.ndarray]) -> np.ndarray:
    """(windows, frames, channels) to has_motion, p_gesture, p_move: convolutions of three frames, each with batch normalisation
    and pooling of two at stride 1, a dense layer, two heads.

    ``w``: conv, bias, gamma, beta, mean and var of each convolution (``conv0``, ...), and of the layers dense,
    motion and gesture the weights and, as ``dense_bias`` and so on, the biases, which count as 0 where they are absent.
    """
    h = expand_channels(x).astype(np.float32)
    for n in range(len([k for k in w if k.startswith("conv")])):
        padded = np.pad(h, ((0, 0), (1, 1), (0, 0)))
        frames = h.shape[1]
        h = np.maximum(sum(padded[:, k : k + frames] @ w[f"conv{n}"][k] for k in range(3)) + w[f"bias{n}"], 0)
        h = (h - w[f"mean{n}"]) * (w[f"gamma{n}"] / np.sqrt(w[f"var{n}"] + 1e-3)) + w[f"beta{n}"]
        h = np.maximum(h, np.concatenate([h[:, 1:], h[:, -1:]], axis=1))
    z = np.maximum(h.reshape(len(h), -1) @ w["dense"] + w.get("dense_bias", 0), 0)
    motion = 1 / (1 + np.exp(-(z @ w["motion"] + w.get("motion_bias", 0))))
    g = z @ w["gesture"] + w.get("gesture_bias", 0)
    e = np.exp(g - g.max(axis=1, keepdims=True))
    return np.concatenate([motion, e / e.sum(axis=1, keepdims=True)], axis=1)


def score_windows(df: DataFrame, window: str, weights: Mapping[str, np.ndarray]) -> DataFrame:
    """``df`` with has_motion, p_gesture, p_move of each window; the weights, fixed in size by the network's shape, are broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(dict(weights))

    @F.pandas_udf("has_motion double, p_gesture double, p_move double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            if len(s) == 0:
                yield pd.DataFrame({"has_motion": [], "p_gesture": [], "p_move": []}, dtype=float)
                continue
            # Some windows at a time, as each takes far more room within the network than in the batch.
            out = []
            for at in range(0, len(s), 512):
                x = np.stack([np.stack([np.asarray(f, dtype=float) for f in v]) for v in s.iloc[at : at + 512]])
                out.append(network_forward(x, shared.value).astype(float))
            yield pd.DataFrame(np.concatenate(out), columns=["has_motion", "p_gesture", "p_move"])

    return df.withColumn("_s", score(F.col(window))).select(*df.columns, "_s.*")


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only, not on partitions or runs: 48 bits of their MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number that depends on the parts only."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *parts))) * F.cos(2 * math.pi * uniform(seed + 1, *parts))


def balanced_starts(df: DataFrame, label: str, draws: int, length: int, seed: int = 42) -> DataFrame:
    """draw, label, start: ``draws`` times a class, each as likely, and a start of ``length`` rows within it, each as likely.

    ``df`` has one row per frame. Draws are made from hashes of their numbers; a class with ``length`` rows or fewer has no start.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > length)
    # Classes are few by nature.
    classes = sizes.withColumn("_k", F.row_number().over(Window.orderBy(label)) - 1)
    number = sizes.agg(F.count(F.lit(1)).alias("_classes"))
    n = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(number))  # one row by construction
    n = n.withColumn("_k", F.floor(uniform(seed, F.col("draw")) * F.col("_classes")).cast("int"))
    return n.join(F.broadcast(classes), "_k").select("draw", label, F.floor(uniform(seed + 1, F.col("draw")) * (F.col("_rows") - length)).alias("start"))


def chosen_for_augmentation(df: DataFrame, label: str, key: Sequence[str], share: int = 3, cap: int = 5000) -> DataFrame:
    """Of each class the rows of a ``share``-th of it, ``cap`` at most, by hash order of ``key``."""
    sizes = df.groupBy(label).agg(F.least(F.floor(F.count(F.lit(1)) / share), F.lit(cap)).alias("_most"))
    order = [_shuffled(*key), *[F.col(k) for k in key]]
    some = cap_per_class(df, label, key, cap).withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    return some.join(F.broadcast(sizes), label).where(F.col("_k") <= F.col("_most")).drop("_k", "_most")  # one row a class


def augmented_windows(df: DataFrame, window: str, key: Sequence[str], seed: int = 42, noise: float = 0.008, low: float = 0.97, high: float = 1.03) -> DataFrame:
    """kind and window of three copies of each window (an array of frames): noise, scale, jitter.

    noise: a normal number for each value; scale: one factor from ``low`` to ``high``; jitter: one frame that is neither
    first nor last is dropped and one of the rest doubled, for windows of four frames or more. Numbers are hashes of
    ``key``, so every run and engine makes the same copies.
    """
    k = [F.col(c) for c in key]
    w = F.col(window)
    n = F.size(w)
    noisy = F.transform(w, lambda f, i: F.transform(f, lambda x, j: x + noise * normal(seed, *k, i, j)))
    scaled = F.transform(w, lambda f: F.transform(f, lambda x: x * (low + (high - low) * uniform(seed + 2, *k))))
    drop = F.floor(uniform(seed + 3, *k) * (n - 2)).cast("int") + 1
    left = F.filter(w, lambda f, i: i != drop)
    twice = F.floor(uniform(seed + 4, *k) * (n - 1)).cast("int")
    jitter = F.when(n >= 4, F.flatten(F.transform(left, lambda f, i: F.when(i == twice, F.array(f, f)).otherwise(F.array(f)))))
    copies = F.array(*[F.struct(F.lit(name).alias("kind"), v.alias(window)) for name, v in (("noise", noisy), ("scale", scaled), ("jitter", jitter))])
    out = df.withColumn("_c", F.explode(copies)).where(F.col(f"_c.{window}").isNotNull())
    return out.select(*[c for c in df.columns if c != window], "_c.kind", f"_c.{window}")


def disturbed_windows(df: DataFrame, window: str, key: Sequence[str], seed: int = 42, jitter: float = 0.005, drop: float = 0.03, noise: float = 0.01, low: float = 0.98, high: float = 1.02, mask: int = 2) -> DataFrame:
    """``df`` with the network's training disturbances in ``window``: jitter, lost frames, noise, a factor, a masked stretch.

    Lost and masked frames are zeros; the stretch has at least one and less than ``mask`` frames. Stretching of
    time does nothing in the published network and does nothing here. Numbers are hashes of ``key``.
    """
    k = [F.col(c) for c in key]
    w = F.col(window)
    factor = low + (high - low) * uniform(seed + 7, *k)
    size = F.lit(1) + F.floor(uniform(seed + 5, *k) * (mask - 1)).cast("int")
    start = F.floor(uniform(seed + 6, *k) * (F.size(w) - size)).cast("int")

    def frame(f: Column, i: Column) -> Column:
        lost = uniform(seed + 4, *k, i) <= drop
        shut = (i >= start) & (i < start + size)
        value = lambda x, j: F.when(shut, 0.0).otherwise((F.when(lost, 0.0).otherwise(x + jitter * normal(seed, *k, i, j)) + noise * normal(seed + 2, *k, i, j)) * factor)
        return F.transform(f, value)

    return df.withColumn(window, F.transform(w, frame))


def train_and_test(df: DataFrame, label: str, key: Sequence[str], folds: int = 5, few: int = 10_000, share: float = 0.15) -> DataFrame:
    """``df`` with fold: of more than ``few`` rows 0 to ``folds`` - 1; else 0 for ``share`` of each class, the test set, and 1 for the rest."""
    if df.count() > few:
        return stratified_folds(df, label, key, folds)
    order = [_shuffled(*key), *[F.col(k) for k in key]]  # few rows, so a class fits a window
    numbered = df.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.round(F.count(F.lit(1)) * share).alias("_t"))
    return numbered.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_l"))).withColumn("fold", (F.col("_k") > F.col("_t")).cast("int")).drop("_k", "_l", "_t")


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], slices: int = 1024) -> DataFrame:
    """by and q, the quantiles of ``value`` per group, with linear interpolation between neighbours.

    Equal values are counted first; the counts of a group are cut into ``slices`` ranges of values and summed up
    over them, so no task sorts a group. Null and not finite values are left out; a group without others has no row.
    """
    v = finite(F.col(value))
    counts = df.select(F.to_json(F.struct(*by)).alias("_g"), *by, v.alias("_v")).where("_v is not null").groupBy("_g", *by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    place = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (slices - 1)), F.lit(0))
    rows = running_sum(counts.join(bounds, "_g").withColumn(SLICE, place), ["_g"], ["_v"], F.col("_n"), "_sum")
    at = {p: (F.col("_all") - 1) * F.lit(float(p)) for p in probs}
    found = rows.groupBy("_g", *by).agg(*[F.min(F.when(F.col("_sum") > f(at[p]), F.col("_v"))).alias(f"{n}{k}") for k, p in enumerate(probs) for n, f in (("_a", F.floor), ("_b", F.ceil))], F.max("_all").alias("_all"))
    between = [F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (at[p] - F.floor(at[p])) for k, p in enumerate(probs)]
    return found.select(*by, F.array(*between).alias("q"))


def cross_validation(df: DataFrame, label: str, predicted: str, fold: str) -> DataFrame:
    """One row: mean and population deviation of the accuracies of the folds, and their number."""
    per = accuracy(df, label, predicted, fold)
    return per.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("deviation"), F.count(F.lit(1)).alias("folds"))
