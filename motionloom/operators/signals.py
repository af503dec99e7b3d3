"""Filters that have no relational form, in NumPy, one call per gesture."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.operators.sliced import SLICE, with_halo

SIZE = 4096


def gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing along the first axis; the ends are mirrored including the end value."""
    radius = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    n = len(x)
    at = np.arange(-radius, n + radius) % (2 * n)
    at = np.where(at >= n, 2 * n - 1 - at, at)
    padded = x[at]
    return sum(w * padded[i : i + n] for i, w in enumerate(k))


def polynomial_smooth(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomial over a moving window; the first and last half window are read off the end polynomials."""
    half = window // 2
    t = np.arange(-half, half + 1)
    basis = np.vander(t, order + 1, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    out = np.empty(len(x))
    views = np.lib.stride_tricks.sliding_window_view(x, window)
    out[half : len(x) - half] = views @ fit[half]
    out[:half] = (fit @ x[:window])[:half]
    out[len(x) - half :] = (fit @ x[-window:])[half + 1 :]
    return out


def smooth_speed(x: np.ndarray) -> np.ndarray:
    """Window 15 and order 5, or the longest odd window a short series allows; a mean of three below 5."""
    n = len(x)
    if n >= 15:
        return polynomial_smooth(x, 15, 5)
    window = n if n % 2 else n - 1
    if window < 5:
        return np.convolve(x, np.ones(3) / 3, mode="same")
    return polynomial_smooth(x, window, min(5, window - 1))


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of all stretches of equal values that are higher than both sides."""
    if len(x) < 3:
        return np.empty(0, dtype=int)
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    end = np.append(begin[1:], len(x)) - 1
    level = x[begin]
    up = np.append(False, level[1:] > level[:-1])
    down = np.append(level[:-1] > level[1:], False)
    top = up & down
    return (begin[top] + end[top]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """How far each peak stands above the higher of the lowest points between it and higher ground on either side."""
    out = np.empty(len(peaks))
    for n, p in enumerate(peaks):
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        lo = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        hi = x[p : (p + 1 + right[0] if len(right) else len(x))].min()
        out[n] = x[p] - max(lo, hi)
    return out


def find_peaks(x: np.ndarray, distance: int, prominence: float, height: float = 0.0) -> np.ndarray:
    """Local maxima of at least ``height``, at least ``distance`` apart (higher ones first), of at least ``prominence``."""
    peaks = local_maxima(x)
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), dtype=bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            keep &= (np.abs(peaks - peaks[k]) >= distance) | (np.arange(len(peaks)) == k)
    peaks = peaks[keep]
    return peaks[prominences(x, peaks) >= prominence]


def submovements(speed: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and heights of the peaks of a speed profile; its highest point where there is no peak, place 0 and height 0 where it is empty."""
    if len(speed) == 0:
        return np.array([0]), np.array([0.0])
    smooth = speed if len(speed) < 3 else smooth_speed(speed)
    peaks = np.empty(0, dtype=int) if len(speed) < 3 else find_peaks(smooth, max(1, int(5 * fps / 25)), max(0.01, 0.1 * float(np.std(smooth))))
    if len(peaks) == 0:
        peaks = np.array([int(np.argmax(smooth))])
    return peaks, smooth[peaks]


def limb_motion(positions: np.ndarray, fps: float) -> dict[str, np.ndarray]:
    """Speed, size of acceleration and of jerk of a limb, after smoothing over time; zeros for a single frame."""
    if len(positions) < 2:
        zero = np.zeros(len(positions))
        return {"speed": zero, "acceleration": zero, "jerk": zero}
    v = np.gradient(gaussian(positions, 2.0), 1 / fps, axis=0)
    a = np.gradient(v, 1 / fps, axis=0)
    j = np.gradient(a, 1 / fps, axis=0)
    return {k: np.linalg.norm(x, axis=1) for k, x in (("speed", v), ("acceleration", a), ("jerk", j))}


_LIMB = "peak_speed double, mean_speed double, peak_acceleration double, peak_deceleration double, peak_jerk double, submovements int, peak_max double, peak_mean double, first_peak long"


def limb_features(frames: DataFrame, by: Sequence[str], joint: str, fps: float, index: str = "frame_idx") -> DataFrame:
    """Dynamics and submovements of a joint per gesture.

    A gesture is a clip of seconds, so its frames fit a task; only the joint's columns are sent
    to Python. Peak deceleration is the smallest size of acceleration, as in the reference.
    """
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", " + _LIMB
    cols = [f"{joint}_{a}" for a in "xyz"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.nan_to_num(pdf.sort_values(index)[cols].to_numpy(dtype=float))
        m = limb_motion(p, fps)
        peaks, heights = submovements(m["speed"], fps)
        row = [
            m["speed"].max(), m["speed"].mean(), m["acceleration"].max(), m["acceleration"].min(), m["jerk"].max(),
            len(peaks), heights.max(), heights.mean(), int(peaks.min()),
        ]
        return pd.DataFrame([[*key, *row]], columns=[c.split()[0] for c in schema.split(", ")])

    return frames.select(*by, index, *cols).groupBy(*by).applyInPandas(run, schema)


def smooth_over_time(frames: DataFrame, by: Sequence[str], columns: Sequence[str], sigma: float = 2.0, index: str = "frame_idx", size: int = SIZE) -> DataFrame:
    """by, index and the columns smoothed over time; ``index`` counts the rows of an entity without gaps from 0.

    A row needs its neighbours within the kernel's reach only, so an entity is cut into slices with a halo.
    At its ends rows are mirrored including the end row. A null within reach gives null.
    """
    reach = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = F.array(*[F.lit(float(w)) for w in k / k.sum()])
    rows = with_halo(frames.select(*by, index, *columns), index, size, reach, reach)
    w = Window.partitionBy(*by, SLICE).orderBy(index)
    rows = rows.withColumns({"_a": F.collect_list(F.struct(*columns)).over(w.rowsBetween(-reach, reach)), "_p": F.count(F.lit(1)).over(w.rowsBetween(-reach, -1))})
    n = F.size("_a")

    def at(step: Column) -> Column:
        inside = F.pmod(F.col("_p") + step, 2 * n)
        return F.get("_a", F.when(inside < n, inside).otherwise(2 * n - 1 - inside).cast("int"))

    steps = F.sequence(F.lit(-reach), F.lit(reach))
    smooth = {c: F.aggregate(F.zip_with(steps, weights, lambda s, x: at(s)[c].cast("double") * x), F.lit(0.0), lambda t, x: t + x) for c in columns}  # noqa: B023
    return rows.where("not halo").select(*by, index, *[v.alias(c) for c, v in smooth.items()])
