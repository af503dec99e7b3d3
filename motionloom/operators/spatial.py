"""Use of space, height, volume and holds of the hands, as expressions over joint columns.

Frames carry columns ``<joint>_x``, ``_y``, ``_z`` for the joints in ``POINTS`` and
``left_vis``, ``right_vis`` for the wrists. ``neck`` and ``hip`` are the points the
reference calls so (left and right hip of the body layout); y grows downwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.operators.features import bounded
from motionloom.operators.sliced import chains, cut_by

POINTS = ("left_hand", "right_hand", "left_elbow", "right_elbow", "left_shoulder", "right_shoulder", "neck", "hip", "left_eye", "right_eye", "nose")
VISIBLE = 0.5


def _c(joint: str, axis: str) -> Column:
    return F.col(f"{joint}_{axis}")


def zone_grid() -> dict[str, Column]:
    """Bounds of the centre-centre, centre and periphery boxes of a frame."""
    centre = _c("neck", "y") - (_c("neck", "y") - _c("hip", "y")) / 2
    face = (_c("left_eye", "x") - _c("right_eye", "x")) * 2
    body = _c("left_shoulder", "x") - _c("right_shoulder", "x")
    cc0, cc1 = _c("right_shoulder", "x"), _c("left_shoulder", "x")
    c0, c1 = cc0 - body / 2, cc1 + body / 2
    half_cc, half_c = (cc1 - cc0) / 2, (c1 - c0) / 2
    top = _c("left_eye", "y") + (_c("left_eye", "y") - _c("nose", "y"))
    return {
        "cc_x0": cc0, "cc_x1": cc1, "cc_y0": centre - half_cc, "cc_y1": centre + half_cc,
        "c_x0": c0, "c_x1": c1, "c_y0": centre - half_c, "c_y1": centre + half_c,
        "p_x0": c0 - face, "p_x1": c1 + face, "p_y0": centre - (top - centre), "p_y1": top,
    }


def zone_code(side: str) -> Column:
    """Zone of a hand in a frame: 1, 2, 31..38 or 41..48; the mixed bounds of the outer zones are the reference's. NaN gives 45."""
    g = zone_grid()
    x, y = _c(f"{side}_hand", "x"), _c(f"{side}_hand", "y")
    # Spark holds NaN greater than all numbers; no test may hold for it.
    above = lambda v, b: (v > b) & ~F.isnan(v) & ~F.isnan(b)
    below = lambda v, b: (v < b) & ~F.isnan(v) & ~F.isnan(b)

    def inside(box: str) -> Column:
        return above(x, g[f"{box}_x0"]) & below(x, g[f"{box}_x1"]) & above(y, g[f"{box}_y0"]) & below(y, g[f"{box}_y1"])

    def ring(tens: int, right: Column, side_box: str, mid_box: str, left_box: str) -> Column:
        def column(box: str, high: int, mid: int, low: int) -> Column:
            return F.when(above(y, g[f"{box}_y1"]), high + tens).when(above(y, g[f"{box}_y0"]), mid + tens).otherwise(low + tens)

        middle = F.when(above(y, g[f"{mid_box}_y1"]), 8 + tens).otherwise(4 + tens)
        return F.when(above(x, right), column(side_box, 1, 2, 3)).when(above(x, g["cc_x0"]), middle).otherwise(column(left_box, 7, 6, 5))

    return (
        F.when(inside("cc"), 1)
        .when(inside("c"), 2)
        .when(inside("p"), ring(30, g["cc_x1"], "cc", "c", "cc"))
        .otherwise(ring(40, g["c_x1"], "cc", "c", "c"))
    )


def height_score(side: str) -> Column:
    """How high a hand is: 0 below the hip, then a digit for the body part passed plus the share of the next; 5 above the eyes, 0 if not visible.

    A body part of zero height gives null for its share (there is no such division).
    """
    y = _c(f"{side}_hand", "y")
    hip, neck, nose, eye = (_c(j, "y") for j in ("hip", "neck", "nose", f"{side}_eye"))
    return (
        F.when(F.coalesce(F.col(f"{side}_vis") < VISIBLE, F.lit(False)), F.lit(0.0))
        .when(y >= hip, F.lit(0.0))
        .when(y >= neck, 1 + F.try_divide(hip - y, hip - neck))
        .when(y >= nose, 2 + F.try_divide(neck - y, neck - nose))
        .when(y >= eye, 3 + F.try_divide(nose - y, nose - eye))
        .otherwise(F.lit(5.0))
    )


def space_use(frames: DataFrame, by: Sequence[str], index: str = "frame_idx") -> DataFrame:
    """Per gesture and hand: distinct zones, highest main zone, and the most frequent main zone, the one seen first of equals.

    Frames in which the hand is not visible count for nothing; without any the main zone is 1.
    """
    hands = []
    for side in ("left", "right"):
        seen = F.coalesce(F.col(f"{side}_vis") >= VISIBLE, F.lit(True))
        hands.append(F.struct(F.lit(side[0].upper()).alias("hand"), F.when(seen, zone_code(side)).alias("zone")))
    rows = frames.select(*by, index, F.explode(F.array(*hands)).alias("h")).select(*by, index, "h.*")
    main = F.when(F.col("zone") > 40, 4).when(F.col("zone") > 30, 3).otherwise(F.col("zone"))
    rows = rows.withColumn("main", F.when(F.col("zone").isNotNull(), main))
    mode = (
        rows.where("main is not null")
        .groupBy(*by, "hand", "main")
        .agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first"))
        .groupBy(*by, "hand")
        .agg(F.max_by("main", F.struct("n", F.negative("first"))).alias("mode"))
    )
    return (
        rows.groupBy(*by, "hand")
        .agg(F.count_distinct("zone").alias("space_use"), F.max("zone").alias("top"))
        .join(mode, [*by, "hand"], "left")
        .select(
            *by,
            "hand",
            "space_use",
            F.coalesce(F.when(F.col("top") > 40, 4).when(F.col("top") > 30, 3).otherwise(F.col("top")), F.lit(1)).cast("double").alias("mcneillian_max"),
            F.coalesce("mode", F.lit(1)).alias("mcneillian_mode"),
        )
    )


def hand_volume(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounding-box volume of the left hand, the right hand and both together."""
    aggs = [f(f"{s}_hand_{a}").alias(f"{n}_{s}_{a}") for s in ("left", "right") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
    box = frames.groupBy(*by).agg(*aggs)

    def volume(lo, hi) -> Column:
        return (hi("x") - lo("x")) * (hi("y") - lo("y")) * (hi("z") - lo("z"))

    return box.select(
        *by,
        *[volume(lambda a, s=s: F.col(f"lo_{s}_{a}"), lambda a, s=s: F.col(f"hi_{s}_{a}")).alias(f"volume_{s}") for s in ("left", "right")],
        volume(lambda a: F.least(f"lo_left_{a}", f"lo_right_{a}"), lambda a: F.greatest(f"hi_left_{a}", f"hi_right_{a}")).alias("volume_both"),
    )


def max_height(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    return frames.groupBy(*by).agg(*[F.max(height_score(s)).alias(f"max_height_{s}") for s in ("left", "right")])


def step_lengths(frames: DataFrame, by: Sequence[str], joints: Sequence[str], index: str = "frame_idx") -> DataFrame:
    """Distance of each joint from its place in the frame before, as ``<joint>_step``; null in the first frame."""

    def step(j: str):
        return lambda w: F.sqrt(sum(((_c(j, a) - F.lag(f"{j}_{a}").over(w)) ** 2 for a in "xyz"), F.lit(0.0)))

    return bounded(frames, by, index, 1, 0, {f"{j}_step": step(j) for j in joints})


def active_hand(frames: DataFrame, by: Sequence[str], index: str = "frame_idx") -> DataFrame:
    """The hand with the longer visible path, each scaled by the share of frames in which it is visible; equal paths give R."""
    cols = {f"{s}_next": (lambda w, s=s: F.sqrt(sum(((F.lead(f"{s}_hand_{a}").over(w) - _c(f"{s}_hand", a)) ** 2 for a in "xyz"), F.lit(0.0)))) for s in ("left", "right")}
    moved = bounded(frames, by, index, 0, 1, cols)

    def total(s: str) -> Column:
        seen = F.coalesce(F.col(f"{s}_vis") >= VISIBLE, F.lit(True))
        path = F.sum(F.when(seen, F.coalesce(f"{s}_next", F.lit(0.0))).otherwise(F.lit(0.0)))
        return path * (F.count(F.lit(1)) / F.greatest(F.count(F.when(seen, 1)), F.lit(1)))

    out = moved.groupBy(*by).agg(total("left").alias("left_path"), total("right").alias("right_path"))
    return out.withColumn("active_hand", F.when(F.col("left_path") > F.col("right_path"), "L").otherwise("R"))


def holds(
    frames: DataFrame, by: Sequence[str], side: str, *, first_peak: DataFrame | None = None, fps: float = 25.0, pause: float = 0.15, shortest: int = 3, index: str = "frame_idx"
) -> DataFrame:
    """hold_count, hold_time (s) and hold_avg_duration (frames) per gesture, for ``side`` left, right or both.

    A hold is a stretch of successive steps in which hand and elbow both move slower than
    ``pause``; one that begins before ``first_peak`` (by, peak) doesn't count. Steps are
    numbered from 0, so step k lies between frames k and k + 1.
    """
    sides = ("left", "right") if side == "both" else (side,)
    joints = [f"{s}_{j}" for s in sides for j in ("hand", "elbow")]
    steps = step_lengths(frames, by, joints, index)
    still = F.lit(True)
    for j in joints:
        still = still & (F.col(f"{j}_step") * fps < pause)
    paused = steps.where(still).select(*by, (F.col(index) - 1).alias("step"))
    islands = chains(
        cut_by(paused, "step", 4096), by, ["step"], lambda before, here: here("step") == before("step") + 1, ["step"], {"n": (F.lit(1), F.sum)}
    ).withColumn("begin", F.col("first.step"))
    if first_peak is not None:
        islands = islands.join(first_peak, list(by), "left").where(F.col("peak").isNull() | (F.col("begin") >= F.col("peak")))
    counted = islands.where(F.col("n") >= shortest).groupBy(*by).agg(F.count(F.lit(1)).alias("hold_count"), F.sum("n").alias("frames"))
    return (
        frames.select(*by)
        .distinct()
        .join(counted, list(by), "left")
        .select(
            *by,
            F.coalesce("hold_count", F.lit(0)).alias("hold_count"),
            (F.coalesce("frames", F.lit(0)) / F.lit(float(fps))).alias("hold_time"),
            F.coalesce(F.try_divide(F.col("frames").cast("double"), F.col("hold_count")), F.lit(0.0)).alias("hold_avg_duration"),
        )
    )
