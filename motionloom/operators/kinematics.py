"""All kinematic features of gestures: space, time, submovements and dynamics of the more active arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.operators import signals, spatial


def kinematic_features(frames: DataFrame, by: Sequence[str], *, fps: float = 25.0, pause: float = 0.15, index: str = "frame_idx") -> DataFrame:
    """One row per gesture with the 25 numeric features and active_hand.

    ``frames`` are as ``spatial`` describes. Everything relational stays in expressions;
    filters and peaks of each limb take one vectorised call per gesture. An empty table gives an empty result.
    """
    by = list(by)
    hand = spatial.active_hand(frames, by, index).select(*by, "active_hand")
    side = F.col("active_hand")
    space = spatial.space_use(frames, by, index).withColumnRenamed("hand", "active_hand")
    volume = spatial.hand_volume(frames, by)
    height = spatial.max_height(frames, by)
    length = frames.groupBy(*by).agg((F.count(F.lit(1)) / F.lit(float(fps))).alias("duration"))
    out = hand.join(space, [*by, "active_hand"]).join(volume, by).join(height, by).join(length, by)
    out = out.withColumns(
        {
            "volume": F.when(side == "L", F.col("volume_left")).otherwise(F.col("volume_right")),
            "max_height": F.when(side == "L", F.col("max_height_left")).otherwise(F.col("max_height_right")),
        }
    ).drop("volume_left", "volume_right", "volume_both", "max_height_left", "max_height_right")
    chosen = frames.join(hand, by)
    for limb in ("hand", "elbow"):
        one = chosen.select(*by, index, *[F.when(side == "L", F.col(f"left_{limb}_{a}")).otherwise(F.col(f"right_{limb}_{a}")).alias(f"limb_{a}") for a in "xyz"])
        f = signals.limb_features(one, by, "limb", fps, index)
        names = {c: f"{limb}_{c}" for c in ("peak_speed", "mean_speed", "peak_acceleration", "peak_deceleration", "peak_jerk", "submovements")}
        f = f.withColumnsRenamed(names)
        if limb == "hand":
            peaks = f.select(*by, F.col("first_peak").alias("peak"))
            f = f.withColumnsRenamed({"peak_max": "hand_submovement_peak_max", "peak_mean": "hand_submovement_peak_mean"}).withColumn(
                "hand_mean_submovement_amplitude", F.col("hand_submovement_peak_mean")
            )
        else:
            f = f.withColumnRenamed("peak_mean", "elbow_mean_submovement_amplitude").drop("peak_max")
        out = out.join(f.drop("first_peak"), by)
    # Holds of the more active arm only, under the names of one side.
    arm = chosen.select(*by, index, *[F.when(side == "L", F.col(f"left_{limb}_{a}")).otherwise(F.col(f"right_{limb}_{a}")).alias(f"left_{limb}_{a}") for limb in ("hand", "elbow") for a in "xyz"])
    return out.join(spatial.holds(arm, by, "left", first_peak=peaks, fps=fps, pause=pause, index=index), by)
