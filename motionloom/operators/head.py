"""Rotation of the head from six face points seen by a camera."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The face points that tell the rotation, in the order of the mesh.
ROTATION_POINTS = (1, 33, 61, 199, 263, 291)


def _turned(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors (n, 3)."""
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k -= k.transpose(0, 2, 1)
    safe = np.maximum(angle, 1e-12)
    one = np.where(angle < 1e-6, 1.0, np.sin(angle) / safe)
    two = np.where(angle < 1e-6, 0.5, (1 - np.cos(angle)) / safe**2)
    return np.eye(3) + one * k + two * (k @ k)


def camera_pose(solid: np.ndarray, seen: np.ndarray, focal: float, centre: tuple[float, float], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Rotation (n, 3, 3) and translation (n, 3) that bring points ``solid`` (n, k, 3) to the pixels ``seen`` (n, k, 2).

    Least squares over the pixels by damped Gauss-Newton steps, all frames at once. It begins at the pose
    in which the camera looks along the third axis and points without depth fall on their own pixels.
    """
    n, k, _ = solid.shape
    turn = np.tile(np.eye(3), (n, 1, 1))
    shift = np.tile([-centre[0], -centre[1], focal], (n, 1)).astype(float)
    damp = np.full(n, 1e-3)

    def miss(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        body = solid @ r.transpose(0, 2, 1)
        p = body + t[:, None]
        z = np.where(np.abs(p[..., 2]) < 1e-9, 1e-9, p[..., 2])
        uv = focal * p[..., :2] / z[..., None] + np.array(centre)
        return uv - seen, np.dstack([p[..., 0], p[..., 1], z]), body

    off, p, body = miss(turn, shift)
    cost = (off**2).sum((1, 2))
    for _ in range(rounds):
        x, y, z = p[..., 0], p[..., 1], p[..., 2]
        to = np.zeros((n, k, 2, 3))
        to[..., 0, 0] = to[..., 1, 1] = focal / z
        to[..., 0, 2], to[..., 1, 2] = -focal * x / z**2, -focal * y / z**2
        cross = np.zeros((n, k, 3, 3))
        cross[..., 0, 1], cross[..., 0, 2], cross[..., 1, 2] = body[..., 2], -body[..., 1], body[..., 0]
        cross -= cross.transpose(0, 1, 3, 2)
        j = np.concatenate([to @ cross, to], axis=3).reshape(n, 2 * k, 6)
        e = off.reshape(n, 2 * k)
        h, g = j.transpose(0, 2, 1) @ j, (j.transpose(0, 2, 1) @ e[..., None])[..., 0]
        scale = np.einsum("nii->ni", h) + 1e-12
        step = -np.linalg.solve(h + damp[:, None, None] * np.eye(6) * scale[:, None], g[..., None])[..., 0]
        r, t = _turned(step[:, :3]) @ turn, shift + step[:, 3:]
        off2, p2, body2 = miss(r, t)
        cost2 = (off2**2).sum((1, 2))
        good = cost2 <= cost
        turn, shift = np.where(good[:, None, None], r, turn), np.where(good[:, None], t, shift)
        off, p, body = (np.where(good[:, None, None], b, a) for a, b in ((off, off2), (p, p2), (body, body2)))
        gain = cost - cost2
        cost, damp = np.where(good, cost2, cost), np.where(good, np.maximum(damp / 10, 1e-12), np.minimum(damp * 10, 1e12))
        if (np.abs(gain) <= 1e-12 * (cost + 1e-12)).all():
            break
    return turn, shift


def euler_degrees(r: np.ndarray) -> np.ndarray:
    """Angles about x, y and z (n, 3), in degrees, of rotations done in that order."""
    return np.degrees(
        np.stack([np.arctan2(r[:, 2, 1], r[:, 2, 2]), np.arctan2(-r[:, 2, 0], np.hypot(r[:, 2, 1], r[:, 2, 2])), np.arctan2(r[:, 1, 0], r[:, 0, 0])], axis=1)
    )


def head_rotation(df: DataFrame, points: Sequence[str], width: int, height: int) -> DataFrame:
    """``df`` with rot_x, rot_y, rot_z: the head's angles in degrees, times 360 as the published features have them.

    ``points`` name six points, columns ``<point>_x``, ``_y`` (shares of the frame) and ``_z``. Pixels are
    whole numbers, the focal length is the frame's width. 0.0 where a coordinate is null or not finite.
    """

    @F.pandas_udf("rot_x double, rot_y double, rot_z double")
    def rotation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            raw = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1).reshape(len(columns[0]), len(points), 3)
            out = np.zeros((len(raw), 3))
            ok = np.isfinite(raw).all(axis=(1, 2))
            if ok.any():
                solid = raw[ok].copy()
                solid[..., 0], solid[..., 1] = np.trunc(solid[..., 0] * width), np.trunc(solid[..., 1] * height)
                out[ok] = euler_degrees(camera_pose(solid, solid[..., :2], width, (width / 2, height / 2))[0]) * 360
            yield pd.DataFrame(out, columns=["rot_x", "rot_y", "rot_z"])

    coordinates = [F.col(f"{p}_{a}").cast("double") for p in points for a in "xyz"]
    return df.withColumn("_r", rotation(*coordinates)).select(*df.columns, "_r.*")
