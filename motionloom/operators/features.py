"""Windowed motion features over landmark frames, as expressions over arrays and bounded windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.operators.sliced import SLICE, with_halo

# Places of joints in the 33-point body layout.
JOINTS = {
    "nose": 0, "left_eye": 2, "right_eye": 5, "left_ear": 7, "right_ear": 8, "left_shoulder": 11, "right_shoulder": 12,
    "left_elbow": 13, "right_elbow": 14, "left_wrist": 15, "right_wrist": 16, "left_pinky": 17, "right_pinky": 18,
    "left_index": 19, "right_index": 20, "left_thumb": 21, "right_thumb": 22, "left_hip": 23, "right_hip": 24,
}
KEY_JOINTS = (11, 12, 13, 14, 15, 16)
FINGERS = {"left": ((17, 19, 21), 15), "right": ((18, 20, 22), 16)}
SIZE = 4096


def point(lm: Column, joint: int, axis: int) -> Column:
    """A coordinate of a flat landmark array (x, y, z of joint after joint); 0.0 where it is missing."""
    v = F.get(lm, F.lit(3 * joint + axis))
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def key_joints(lm: Column) -> Column:
    """18 values: both shoulders, elbows and wrists."""
    return F.array(*[point(lm, j, a) for j in KEY_JOINTS for a in range(3)])


def finger_vector(lm: Column, side: str, need_wrist: bool = False) -> Column:
    """9 values: pinky, index and thumb relative to the wrist; all 0 where ``need_wrist`` asks for a wrist off the origin and it isn't."""
    tips, wrist = FINGERS[side]
    diff = F.array(*[point(lm, j, a) - point(lm, wrist, a) for j in tips for a in range(3)])
    if not need_wrist:
        return diff
    there = (point(lm, wrist, 0) != 0) | (point(lm, wrist, 1) != 0) | (point(lm, wrist, 2) != 0)
    return F.when(there, diff).otherwise(F.array_repeat(F.lit(0.0), 9))


def _gap(v: Column, a: int, b: int) -> Column:
    return F.sqrt(sum(((F.get(v, F.lit(3 * a + k)) - F.get(v, F.lit(3 * b + k))) ** 2 for k in range(3)), F.lit(0.0)))


def finger_shape(left: Column, right: Column) -> Column:
    """6 distances: pinky to thumb, index to thumb, pinky to index of each hand; 0 for a hand that is all 0."""
    out = []
    for v in (left, right):
        seen = F.exists(v, lambda x: x != 0)
        out += [F.when(seen, _gap(v, a, b)).otherwise(F.lit(0.0)) for a, b in ((0, 2), (1, 2), (0, 1))]
    return F.array(*out)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def pixel_scaled(x: Column, y: Column, z: Column, width: int, height: int, depth: float = 3000.0) -> tuple[Column, Column, Column]:
    """A landmark in pixels; the depth of the nose has a scale of its own."""
    return x * width, y * height, z * depth


# Face mesh points whose distances describe brows, mouth width and mouth opening, and the two that give the head size.
FACE_PAIRS = {"left_brow_left_eye": (33, 225), "right_brow_right_eye": (263, 295), "mouth_corners": (61, 291), "mouth_apperture": (13, 14)}
HEAD_POINTS = (152, 10)


def paired_distances(pairs: dict[str, tuple], norm: Column) -> dict[str, Column]:
    """Plane distance of each pair of points (columns ``<point>_x``, ``<point>_y``) in units of ``norm``, 0.0 where it can't be told."""
    size = F.when(norm != 0, norm)
    return {n: normalised(distance(F.col(f"{a}_x"), F.col(f"{a}_y"), F.col(f"{b}_x"), F.col(f"{b}_y")), size) for n, (a, b) in pairs.items()}


def normalised(value: Column, norm: Column) -> Column:
    """A distance in units of the head size; 0.0 where either is missing."""
    return F.coalesce(F.try_divide(value, norm), F.lit(0.0))


# Pairs of joints whose distances describe arms and hands, in the order of the network's input.
BODY_PAIRS = (
    ("left_wrist", "right_wrist"), ("left_elbow", "right_elbow"), ("left_elbow", "left_shoulder"), ("right_elbow", "right_shoulder"),
    ("left_wrist", "left_shoulder"), ("right_wrist", "right_shoulder"), ("left_shoulder", "left_ear"), ("right_shoulder", "right_ear"),
    ("left_thumb", "left_index"), ("right_thumb", "right_index"), ("left_thumb", "left_pinky"), ("right_thumb", "right_pinky"),
)


def network_features(lm: Column) -> Column:
    """The 29 values of the network's input from a flat array of 23 body joints, in the reference's order.

    Head rotation (3), nose (3), head size, brows and mouth (4), distances of arm and hand joints (12), wrists
    from elbows (4), index fingers from the nose (2); all but the first seven in head sizes. Body joints have no face mesh:
    rotation, brows and mouth opening are 0.0, and the ears tell the head size.
    """
    at = lambda name, axis: point(lm, JOINTS[name], axis)
    gap = lambda a, b: distance(at(a, 0), at(a, 1), at(b, 0), at(b, 1))
    head = gap("left_ear", "right_ear")
    head = F.when(head != 0, head).otherwise(F.lit(1.0))
    none = F.lit(0.0)
    mouth = distance(point(lm, 9, 0), point(lm, 9, 1), point(lm, 10, 0), point(lm, 10, 1))
    offsets = [at(f"{s}_wrist", a) - at(f"{s}_elbow", a) for a in (0, 1) for s in ("left", "right")]
    scaled = [none, none, mouth, none, *[gap(a, b) for a, b in BODY_PAIRS], *offsets, gap("left_index", "nose"), gap("right_index", "nose")]
    return F.array(none, none, none, *[at("nose", a) for a in range(3)], head, *[x / head for x in scaled])


def bounded(df: DataFrame, by: Sequence[str], index: str, before: int, after: int, columns: dict, size: int = SIZE) -> DataFrame:
    """``columns`` (name to function of a window) over windows of at most that many rows back and ahead.

    ``index`` counts the rows of an entity without gaps, so slices with a halo give what one
    window over the whole entity would, and an entity spreads over many tasks.
    """
    placed = with_halo(df, index, size, before, after)
    w = Window.partitionBy(*by, SLICE).orderBy(index)
    return placed.withColumns({name: make(w) for name, make in columns.items()}).where(~F.col("halo")).drop("halo", SLICE)


def sliding_windows(df: DataFrame, by: Sequence[str], index: str, value: str, length: int, stride: int = 1) -> DataFrame:
    """by, start, window: every window of ``length`` successive values beginning at a multiple of ``stride``; none where there are fewer."""
    out = bounded(df.select(*by, index, value), by, index, 0, length - 1, {"window": lambda w: F.collect_list(F.struct(value)).over(w.rowsBetween(0, length - 1))})
    full = (F.size("window") == length) & (F.pmod(F.col(index), F.lit(stride)) == 0)
    return out.where(full).select(*by, F.col(index).alias("start"), F.transform("window", lambda x: x[value]).alias("window"))


def trailing_buffer(df: DataFrame, by: Sequence[str], index: str, value: str, length: int = 5) -> DataFrame:
    """by, index, buffer: the last ``length`` values at each row, from the first row that has so many."""
    out = bounded(df.select(*by, index, value), by, index, length - 1, 0, {"buffer": lambda w: F.collect_list(F.struct(value)).over(w.rowsBetween(-(length - 1), 0))})
    return out.where(F.size("buffer") == length).select(*by, index, F.transform("buffer", lambda x: x[value]).alias("buffer"))


def enhanced_features(df: DataFrame, by: Sequence[str], index: str, lm: str = "lm", length: int = 5, width: int = 80) -> DataFrame:
    """by, index, features: the feature vector of each frame that ends a full window.

    Pose (18), its change from the frame before (18), speed of both wrists (2), range of the
    wrists over the window (6), finger vectors (18) and finger shape (6), padded with 0 to ``width``.
    Each part is a window expression, so no window of frames is ever materialised.
    """
    base = df.select(*by, index, key_joints(F.col(lm)).alias("pose"), finger_vector(F.col(lm), "left").alias("lf"), finger_vector(F.col(lm), "right").alias("rf"))

    def span(k: int):
        return lambda w: (
            F.max(F.get("pose", F.lit(k))).over(w.rowsBetween(-(length - 1), 0)) - F.min(F.get("pose", F.lit(k))).over(w.rowsBetween(-(length - 1), 0))
        )

    columns = {"prev": lambda w: F.lag("pose").over(w), "seen": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-(length - 1), 0))}
    columns |= {f"range{k}": span(k) for k in range(12, 18)}
    out = bounded(base, by, index, length - 1, 0, columns).where(F.col("seen") == length)
    change = F.zip_with("pose", "prev", lambda a, b: a - b)
    out = out.withColumn("change", change)

    def speed(at: int) -> Column:
        return F.sqrt(sum((F.get("change", F.lit(at + k)) ** 2 for k in range(3)), F.lit(0.0)))

    parts = F.concat(
        "pose", "change", F.array(speed(12), speed(15)), F.array(*[F.col(f"range{k}") for k in range(12, 18)]), "lf", "rf", finger_shape(F.col("lf"), F.col("rf"))
    )
    return out.select(*by, index, F.concat(parts, F.array_repeat(F.lit(0.0), width - 68)).alias("features"))


def differences(x: str):
    """First and second difference, 0 at the front; the second is that of the padded first."""
    first = lambda w: F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    return {
        "d1": first,
        "d2": lambda w: F.when(F.lag(x).over(w).isNull(), F.lit(0.0)).otherwise(
            first(w) - F.coalesce(F.lag(x).over(w) - F.lag(x, 2).over(w), F.lit(0.0))
        ),
    }


def rolling_mean(x: str, length: int = 5):
    """Centred mean over ``length`` rows; rows too near an end keep their value."""
    half = length // 2
    return lambda w: F.when(F.count(F.lit(1)).over(w.rowsBetween(-half, half)) == length, F.avg(x).over(w.rowsBetween(-half, half))).otherwise(F.col(x))


def gradient(x: str, dt: float):
    """Central difference over time, one-sided at the ends; null where there is one row only."""
    def make(w: Window) -> Column:
        before, after = F.lag(x).over(w), F.lead(x).over(w)
        return F.when(before.isNull(), (after - F.col(x)) / dt).when(after.isNull(), (F.col(x) - before) / dt).otherwise((after - before) / (2 * dt))

    return make


def motion_gate(left: Sequence[str], right: Sequence[str], threshold: float = 0.02):
    """Whether either wrist moved more than ``threshold`` since the frame before; true where there is none."""
    def make(w: Window) -> Column:
        def moved(cols: Sequence[str]) -> Column:
            return F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in cols), F.lit(0.0)))

        return F.coalesce(F.greatest(moved(left), moved(right)) > threshold, F.lit(True))

    return make


def drop_repeats(df: DataFrame, by: Sequence[str], index: str, lm: str, digits: int = 2) -> DataFrame:
    """Frames that differ from the one before after rounding; equality of rounded vectors is transitive, so the one before serves as the last kept."""
    rounded = df.withColumn("_r", F.transform(lm, lambda x: F.round(x, digits)))
    out = bounded(rounded, by, index, 1, 0, {"_before": lambda w: F.lag("_r").over(w)})
    return out.where(F.col("_before").isNull() | (F.col("_r") != F.col("_before"))).drop("_r", "_before")


def decimated(frame: Column, fps: Column, target: float = 25.0) -> Column:
    """Whether a frame is kept when a video is thinned to ``target`` frames a second; the step is rounded half to even."""
    step = F.greatest(F.lit(1), F.bround(fps / target).cast("long"))
    return F.pmod(frame, step) == 0


def fill_nearest(df: DataFrame, by: Sequence[str], index: str, value: str, size: int = SIZE) -> DataFrame:
    """Missing values take that of the nearest frame that has one, of two equally near the earlier; all stay null where none has.

    What a slice of frames can't find inside comes from one summary row per slice.
    """
    rows = df.withColumn(SLICE, F.floor(F.col(index) / size))
    here = Window.partitionBy(*by, SLICE).orderBy(index)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*by, SLICE).agg(F.min(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))).alias("lo"), F.max(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))).alias("hi"))
    slices = rows.select(*by, SLICE).distinct().join(ends, [*by, SLICE], "left")
    across = Window.partitionBy(*by).orderBy(SLICE)
    carried = slices.select(
        *by,
        SLICE,
        F.last("hi", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi"),
        F.first("lo", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_lo"),
    )
    both = rows.withColumn("_b", F.last(seen, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_a", F.first(seen, ignorenulls=True).over(here.rowsBetween(0, Window.unboundedFollowing))
    )
    both = both.join(carried, [*by, SLICE], "left").withColumns({"_b": F.coalesce("_b", "_hi"), "_a": F.coalesce("_a", "_lo")})
    earlier = F.col("_a").isNull() | (F.col(index) - F.col("_b.i") <= F.col("_a.i") - F.col(index))
    filled = F.when(earlier & F.col("_b").isNotNull(), F.col("_b.v")).otherwise(F.col("_a.v"))
    return both.withColumn(value, filled).select(*df.columns)


# The three-point mixing that a Gaussian of width 1 gives over x, y, z with mirrored ends.
AXIS_MIX = ((0.64091491, 0.2960964, 0.06298868), (0.2960964, 0.40780719, 0.2960964), (0.06298868, 0.2960964, 0.64091491))


def smooth_axes(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Smoothing across the three coordinates of a point, as the reference does; see ``signals`` for smoothing over time."""
    return tuple(x * a + y * b + z * c for a, b, c in AXIS_MIX)


def mirrored(lm: Column, joints: int = 23) -> Column:
    """Landmarks seen in a mirror: x negated, left and right joints swapped."""
    swap = {j: j for j in range(joints)}
    for name, j in JOINTS.items():
        other = name.replace("left", "right") if "left" in name else name.replace("right", "left")
        if j < joints and other != name:
            swap[j] = JOINTS[other]
    # Eye corners and mouth, which have no name above.
    for a, b in ((1, 4), (3, 6), (9, 10)):
        swap[a], swap[b] = b, a
    return F.array(*[-F.get(lm, F.lit(3 * swap[j])) if a == 0 else F.get(lm, F.lit(3 * swap[j] + a)) for j in range(joints) for a in range(3)])
