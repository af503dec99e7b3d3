"""Landmark feature, spatial and signal queries, over training frames and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from motionloom.operators import features as X
from motionloom.operators import spatial as P
from motionloom.operators.head import head_rotation
from motionloom.operators.kinematics import kinematic_features
from motionloom.operators.signals import smooth_over_time
from motionloom.plans.adapters import FINGERS, FRAMES_EM_SQL, FRAMES_TR_SQL, frames_em, frames_tr
from motionloom.plans.base import Registry
from motionloom.runtime import cut

R = Registry()
TR = "WITH " + FRAMES_TR_SQL
EM = "WITH " + FRAMES_EM_SQL
KEY = "label, video, frame_idx"
BY = ["label", "video"]
PAD = 800  # frames of a padded sequence, as the reference has them


def _r(c, name, n=6):
    return F.round(c, n).alias(name)


def _jt(j, a):
    """SQL for a coordinate of a joint in a training frame."""
    return f"lm[{3 * j + a + 1}]"


def _norm(parts):
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


@R.add("op_p8_key_joints", f"{TR} SELECT {KEY}, round({' + '.join(f'{k + 1} * {_jt(j, a)}' for k, (j, a) in enumerate((j, a) for j in X.KEY_JOINTS for a in range(3)))}, 6) AS weighted FROM frames_tr")
def p8_key_joints(spark, d):
    v = X.key_joints(F.col("lm"))
    total = F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.lit(18)), lambda a, k: a * k), F.lit(0.0), lambda s, x: s + x)
    return frames_tr(spark, d).select(*BY, "frame_idx", _r(total, "weighted"))


_FV = {s: [[f"({_jt(j, a)} - {_jt(w, a)})" for a in range(3)] for j in tips] for s, (tips, w) in X.FINGERS.items()}


def _weighted(values):
    """SQL for the sum of values times 1, 2, 3, ...: one number that every value has a part in."""
    return " + ".join(f"{k} * {v}" for k, v in enumerate(values, 1))


def _weigh(v):
    """The same over an array."""
    return F.aggregate(F.transform(v, lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)


_F9 = {s: [c for p in v for c in p] for s, v in _FV.items()}


@R.add("op_p9_fingers", f"{TR} SELECT {KEY}, round({_FV['left'][0][0]}, 6) AS left_pinky_x, round({_FV['right'][2][2]}, 6) AS right_thumb_z, round({_weighted(_F9['left'])}, 5) AS left_all, round({_weighted(_F9['right'])}, 5) AS right_all FROM frames_tr")
def p9_fingers(spark, d):
    f = frames_tr(spark, d)
    left, right = (X.finger_vector(F.col("lm"), s) for s in ("left", "right"))
    return f.select(*BY, "frame_idx", _r(F.get(left, F.lit(0)), "left_pinky_x"), _r(F.get(right, F.lit(8)), "right_thumb_z"), _r(_weigh(left), "left_all", 5), _r(_weigh(right), "right_all", 5))


def _shape_sql(side):
    v = _FV[side]
    seen = " OR ".join(f"{c} <> 0" for p in v for c in p)
    return [f"CASE WHEN {seen} THEN {_norm([f'{x} - {y}' for x, y in zip(v[a], v[b])])} ELSE 0 END" for a, b in ((0, 2), (1, 2), (0, 1))]


@R.add("op_p10_finger_shape", f"{TR} SELECT {KEY}, {', '.join(f'round({e}, 6) AS d{k}' for k, e in enumerate(_shape_sql('left') + _shape_sql('right')))} FROM frames_tr")
def p10_finger_shape(spark, d):
    shape = X.finger_shape(X.finger_vector(F.col("lm"), "left"), X.finger_vector(F.col("lm"), "right"))
    f = frames_tr(spark, d).withColumn("s", shape)
    return f.select(*BY, "frame_idx", *[_r(F.get("s", F.lit(k)), f"d{k}") for k in range(6)])


@R.add("w1_windows", f"""{TR}, w AS (SELECT label, video, frame_idx, list(lm[1]) OVER (PARTITION BY label, video ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM frames_tr)
  SELECT label, video, frame_idx AS start, round(x[1], 6) AS first_x, round(x[5], 6) AS last_x FROM w WHERE len(x) = 5 AND frame_idx % 2 = 0""")
def w1_windows(spark, d):
    f = frames_tr(spark, d).withColumn("x", F.get("lm", F.lit(0)))
    w = X.sliding_windows(f, BY, "frame_idx", "x", 5, 2)
    return w.select(*BY, "start", _r(F.get("window", F.lit(0)), "first_x"), _r(F.get("window", F.lit(4)), "last_x"))


@R.add("w2_buffer", f"""{TR}, w AS (SELECT label, video, frame_idx, list(lm[1]) OVER (PARTITION BY label, video ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM frames_tr)
  SELECT {KEY}, round(x[1], 6) AS oldest, round(x[5], 6) AS newest FROM w WHERE len(x) = 5""")
def w2_buffer(spark, d):
    f = frames_tr(spark, d).withColumn("x", F.get("lm", F.lit(0)))
    w = X.trailing_buffer(f, BY, "frame_idx", "x")
    return w.select(*BY, "frame_idx", _r(F.get("buffer", F.lit(0)), "oldest"), _r(F.get("buffer", F.lit(4)), "newest"))


_W5 = "OVER (PARTITION BY label, video ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_LAG = "OVER (PARTITION BY label, video ORDER BY frame_idx)"


_POSE = [_jt(j, a) for j in X.KEY_JOINTS for a in range(3)]
_CHANGE = [f"({p} - lag({p}) {_LAG})" for p in _POSE]
_FEATURES = [*_POSE, *_CHANGE, *[_norm(_CHANGE[k : k + 3]) for k in (12, 15)], *[f"(max({p}) {_W5} - min({p}) {_W5})" for p in _POSE[12:]], *_F9["left"], *_F9["right"], *[f"({e})" for e in _shape_sql("left") + _shape_sql("right")]]


@R.add("w3_enhanced_features", f"""{TR}, e AS (SELECT {KEY}, count(*) {_W5} AS n, {_jt(11, 0)} AS pose0, {_jt(11, 0)} - lag({_jt(11, 0)}) {_LAG} AS change0,
    {_norm([f'{_jt(15, a)} - lag({_jt(15, a)}) {_LAG}' for a in range(3)])} AS speed_left, max({_jt(16, 2)}) {_W5} - min({_jt(16, 2)}) {_W5} AS range5, {_FV['left'][0][0]} AS finger0, {_shape_sql('right')[2]} AS shape5, {_weighted(_FEATURES)} AS every FROM frames_tr)
  SELECT {KEY}, 80 AS width, round(pose0, 6) AS pose0, round(change0, 6) AS change0, round(speed_left, 6) AS speed_left, round(range5, 6) AS range5, round(finger0, 6) AS finger0, round(shape5, 6) AS shape5, 0.0::DOUBLE AS pad, round(every, 4) AS every FROM e WHERE n = 5""")
def w3_enhanced_features(spark, d):
    e = X.enhanced_features(frames_tr(spark, d), BY, "frame_idx")
    at = {"pose0": 0, "change0": 18, "speed_left": 36, "range5": 43, "finger0": 44, "shape5": 67, "pad": 79}
    return e.select(*BY, "frame_idx", F.size("features").alias("width"), *[_r(F.get("features", F.lit(k)), n) for n, k in at.items()], _r(_weigh(F.col("features")), "every", 4))


@R.add("f6_drop_repeats", f"""{TR}, r AS (SELECT {KEY}, list_transform(lm, lambda x: round(x, 2)) AS v FROM frames_tr), q AS (SELECT *, lag(v) {_LAG} AS p FROM r) SELECT {KEY} FROM q WHERE p IS NULL OR v <> p""")
def f6_drop_repeats(spark, d):
    return X.drop_repeats(frames_tr(spark, d), BY, "frame_idx", "lm").select(*BY, "frame_idx")


@R.add("f9_pad", f"""{TR}, m AS (SELECT label, video, max(frame_idx) AS last FROM frames_tr GROUP BY label, video), p AS (SELECT label, video, last, unnest(range(last + 1, {PAD})) AS frame_idx FROM m)
  SELECT label, video, frame_idx, round(lm[1], 6) AS x FROM frames_tr WHERE frame_idx < {PAD} UNION ALL SELECT p.label, p.video, p.frame_idx, round(f.lm[1], 6) FROM p JOIN frames_tr f ON f.label = p.label AND f.video = p.video AND f.frame_idx = p.last""")
def f9_pad(spark, d):
    f = frames_tr(spark, d).select(*BY, "frame_idx", F.get("lm", F.lit(0)).alias("x"))
    last = f.groupBy(*BY).agg(F.max(F.struct("frame_idx", "x")).alias("l")).where(F.col("l.frame_idx") < PAD - 1)
    pad = last.select(*BY, F.explode(F.sequence(F.col("l.frame_idx") + 1, F.lit(PAD - 1).cast("long"))).alias("frame_idx"), F.col("l.x").alias("x"))
    return f.where(F.col("frame_idx") < PAD).unionByName(pad).select(*BY, "frame_idx", _r(F.col("x"), "x"))


_SWAP = {0: 0} | {a: b for x, y in ((1, 4), (2, 5), (3, 6), *((k, k + 1) for k in range(7, 22, 2))) for a, b in ((x, y), (y, x))}
_MIRROR = [f"({'-' if a == 0 else ''}{_jt(_SWAP[j], a)})" for j in range(23) for a in range(3)]


@R.add("m13_mirror", f"{TR} SELECT {KEY}, round(-{_jt(12, 0)}, 6) AS left_shoulder_x, round({_jt(16, 1)}, 6) AS left_wrist_y, round({_jt(21, 2)}, 6) AS right_thumb_z, round({_weighted(_MIRROR)}, 5) AS every FROM frames_tr")
def m13_mirror(spark, d):
    f = frames_tr(spark, d).withColumn("m", X.mirrored(F.col("lm")))
    some = [_r(X.point(F.col("m"), j, a), n) for n, j, a in (("left_shoulder_x", 11, 0), ("left_wrist_y", 15, 1), ("right_thumb_z", 22, 2))]
    return f.select(*BY, "frame_idx", *some, _r(_weigh(F.col("m")), "every", 5))


@R.add("w8_smooth_axes", f"{TR} SELECT {KEY}, " + ", ".join(f"round({' + '.join(f'lm[{k + 1}] * {c}::DOUBLE' for k, c in enumerate(row))}, 6) AS {n}" for n, row in zip("xyz", X.AXIS_MIX)) + " FROM frames_tr")
def w8_smooth_axes(spark, d):
    c = X.smooth_axes(*[F.get("lm", F.lit(k)) for k in range(3)])
    return frames_tr(spark, d).select(*BY, "frame_idx", *[_r(v, n) for v, n in zip(c, "xyz")])


_WE = "OVER (PARTITION BY track ORDER BY frame_idx)"


def _em(spark, d, columns, before, after):
    return X.bounded(frames_em(spark, d), ["track"], "frame_idx", before, after, columns)


@R.add("w5_differences", f"{EM}, a AS (SELECT track, frame_idx, coalesce(nose_x - lag(nose_x) {_WE}, 0) AS d1 FROM frames_em) SELECT track, frame_idx, round(d1, 6) AS d1, round(coalesce(d1 - lag(d1) {_WE}, 0), 6) AS d2 FROM a")
def w5_differences(spark, d):
    return _em(spark, d, X.differences("nose_x"), 2, 0).select("track", "frame_idx", _r(F.col("d1"), "d1"), _r(F.col("d2"), "d2"))


@R.add("w6_gradient", f"""{EM}, a AS (SELECT track, frame_idx, nose_x AS x, lag(nose_x) {_WE} AS p, lead(nose_x) {_WE} AS n FROM frames_em)
  SELECT track, frame_idx, round(CASE WHEN p IS NULL THEN (n - x) / 0.04::DOUBLE WHEN n IS NULL THEN (x - p) / 0.04::DOUBLE ELSE (n - p) / 0.08::DOUBLE END, 6) AS v FROM a""")
def w6_gradient(spark, d):
    return _em(spark, d, {"v": X.gradient("nose_x", 0.04)}, 1, 1).select("track", "frame_idx", _r(F.col("v"), "v"))


@R.add("w9_rolling_mean", f"""{EM}, a AS (SELECT *, count(*) OVER w AS n, avg(nose_x) OVER w AS m FROM frames_em WINDOW w AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT track, frame_idx, round(CASE WHEN n = 5 THEN m ELSE nose_x END, 6) AS v FROM a""")
def w9_rolling_mean(spark, d):
    return _em(spark, d, {"v": X.rolling_mean("nose_x")}, 2, 2).select("track", "frame_idx", _r(F.col("v"), "v"))


@R.add("w12_fill_nearest", f"""{EM}, h AS (SELECT track, frame_idx, CASE WHEN frame_idx % 5 IN (0, 4) THEN nose_x END AS v FROM frames_em), c AS (
  SELECT a.track, a.frame_idx, b.v, row_number() OVER (PARTITION BY a.track, a.frame_idx ORDER BY abs(a.frame_idx - b.frame_idx), b.frame_idx) AS k FROM h a JOIN h b ON a.track = b.track AND b.v IS NOT NULL)
  SELECT track, frame_idx, round(v, 6) AS v FROM c WHERE k = 1""")
def w12_fill_nearest(spark, d):
    f = frames_em(spark, d).select("track", "frame_idx", F.when(F.col("frame_idx") % 5 % 4 == 0, F.col("nose_x")).alias("v"))
    return X.fill_nearest(f, ["track"], "frame_idx", "v").select("track", "frame_idx", _r(F.col("v"), "v"))


@R.add("w14_local_maxima", f"{EM}, a AS (SELECT track, frame_idx, nose_x AS x, lag(nose_x) {_WE} AS p, lead(nose_x) {_WE} AS n FROM frames_em) SELECT track, frame_idx FROM a WHERE x > p AND x > n")
def w14_local_maxima(spark, d):
    f = _em(spark, d, {"p": lambda w: F.lag("nose_x").over(w), "n": lambda w: F.lead("nose_x").over(w)}, 1, 1)
    return f.where((F.col("nose_x") > F.col("p")) & (F.col("nose_x") > F.col("n"))).select("track", "frame_idx")


def _step_sql(j):
    return _norm([f"{j}_{a} - lag({j}_{a}) {_WE}" for a in "xyz"])


@R.add("w15_steps", f"{EM} SELECT track, frame_idx, round({_step_sql('left_hand')}, 6) AS left_hand, round({_step_sql('left_hand')} * 25, 6) AS speed FROM frames_em")
def w15_steps(spark, d):
    f = P.step_lengths(frames_em(spark, d), ["track"], ["left_hand"])
    return f.select("track", "frame_idx", _r(F.col("left_hand_step"), "left_hand"), _r(F.col("left_hand_step") * 25, "speed"))


@R.add("w16_statistics_w17_centre", f"""{EM}, a AS (SELECT track, frame_idx, nose_x AS x, avg(nose_x) OVER (PARTITION BY track) AS m, stddev_pop(nose_x) OVER (PARTITION BY track) AS s FROM frames_em)
  SELECT track, frame_idx, round(x - m, 6) AS centred, round(s, 6) AS deviation FROM a""")
def w16_statistics_w17_centre(spark, d):
    f = frames_em(spark, d).select("track", "frame_idx", "nose_x")
    # Joined rather than windowed: the aggregate combines on the map side, so a long track is no single task.
    m = f.groupBy("track").agg(F.avg("nose_x").alias("m"), F.stddev_pop("nose_x").alias("s"))
    return f.join(m, "track").select("track", "frame_idx", _r(F.col("nose_x") - F.col("m"), "centred"), _r(F.col("s"), "deviation"))


@R.add("w19_motion_gate", f"{EM} SELECT track, frame_idx, coalesce(greatest({_step_sql('left_hand')}, {_step_sql('right_hand')}) > 0.35::DOUBLE, TRUE) AS moving FROM frames_em")
def w19_motion_gate(spark, d):
    gate = X.motion_gate([f"left_hand_{a}" for a in "xyz"], [f"right_hand_{a}" for a in "xyz"], 0.35)
    return _em(spark, d, {"moving": gate}, 1, 0).select("track", "frame_idx", "moving")


_G8 = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
_M = "((p + k - 9) % (2 * len(a)) + 2 * len(a)) % (2 * len(a))"


def _smooth_sql(a):
    return f"round(list_sum([g[k] * {a}[1 + CASE WHEN {_M} < len(a) THEN {_M} ELSE 2 * len(a) - 1 - {_M} END] for k in range(1, 18)]), 6)"


@R.add("w7_smooth_over_time", f"""{EM}, w AS (SELECT track, frame_idx, list(nose_x) OVER w AS a, list(nose_y) OVER w AS b, least(frame_idx, 8) AS p, [{', '.join(repr(x / sum(_G8)) + '::DOUBLE' for x in _G8)}] AS g FROM frames_em
  WINDOW w AS (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) SELECT track, frame_idx, {_smooth_sql('a')} AS nose_x, {_smooth_sql('b')} AS nose_y FROM w""")
def w7_smooth_over_time(spark, d):
    s = smooth_over_time(frames_em(spark, d), ["track"], ["nose_x", "nose_y"])
    return s.select("track", "frame_idx", *[_r(F.col(c), c) for c in ("nose_x", "nose_y")])


@R.add("op_p1_pixels", f"{EM} SELECT track, frame_idx, round(nose_x * 640, 6) AS x, round(nose_y * 480, 6) AS y, round(nose_z * 3000, 6) AS z FROM frames_em")
def p1_pixels(spark, d):
    x, y, z = X.pixel_scaled(F.col("nose_x"), F.col("nose_y"), F.col("nose_z"), 640, 480)
    return frames_em(spark, d).select("track", "frame_idx", _r(x, "x"), _r(y, "y"), _r(z, "z"))


_FACE = {"brow_left": ("left_eye", "left_shoulder"), "brow_right": ("right_eye", "right_shoulder"), "mouth_width": ("neck", "hip"), "mouth_height": ("left_hand", "right_hand")}


@R.add("op_p3_face_distances", f"{EM} SELECT track, frame_idx, " + ", ".join(f"round(coalesce({_norm([f'{a}_{k} - {b}_{k}' for k in 'xy'])} / nullif({_norm(['left_eye_x - nose_x', 'left_eye_y - nose_y'])}, 0), 0), 6) AS {n}" for n, (a, b) in _FACE.items()) + " FROM frames_em")
def p3_face_distances(spark, d):
    f = X.paired_distances(_FACE, X.distance(F.col("left_eye_x"), F.col("left_eye_y"), F.col("nose_x"), F.col("nose_y")))
    return frames_em(spark, d).select("track", "frame_idx", *[_r(c, n) for n, c in f.items()])


@R.add("op_p6_head_rotation")
def p6_head_rotation(spark, d):
    points = ("nose", "left_eye", "right_eye", "neck", "left_shoulder", "right_shoulder")  # stand-ins for the face points
    f = head_rotation(frames_em(spark, d), points, 640, 480)
    return f.select("track", "frame_idx", *[_r(F.col(c), c, 3) for c in ("rot_x", "rot_y", "rot_z")])


_NORM = _norm(["left_eye_x - right_eye_x", "left_eye_y - right_eye_y"])


@R.add("op_p2_p4_body_distances", f"""{EM}, n AS (SELECT *, nullif({_NORM}, 0) AS nd FROM frames_em) SELECT track, frame_idx, round(coalesce(nd, 1), 6) AS norm_dist,
  round(coalesce({_norm(['left_hand_x - right_hand_x', 'left_hand_y - right_hand_y'])} / nd, 0), 6) AS wrists, round(coalesce({_norm(['left_index_x - nose_x', 'left_index_y - nose_y'])} / nd, 0), 6) AS index_nose,
  round(coalesce((left_hand_x - left_elbow_x) / nd, 0), 6) AS wrist_elbow_x FROM n""")
def p2_p4_body_distances(spark, d):
    c = F.col
    nd = X.distance(c("left_eye_x"), c("left_eye_y"), c("right_eye_x"), c("right_eye_y"))
    f = frames_em(spark, d).withColumn("nd", F.when(nd != 0, nd))
    return f.select(
        "track",
        "frame_idx",
        _r(F.coalesce("nd", F.lit(1.0)), "norm_dist"),
        _r(X.normalised(X.distance(c("left_hand_x"), c("left_hand_y"), c("right_hand_x"), c("right_hand_y")), c("nd")), "wrists"),
        _r(X.normalised(X.distance(c("left_index_x"), c("left_index_y"), c("nose_x"), c("nose_y")), c("nd")), "index_nose"),
        _r(X.normalised(c("left_hand_x") - c("left_elbow_x"), c("nd")), "wrist_elbow_x"),
    )


_GRID = """g AS (SELECT *, neck_y - (neck_y - hip_y) / 2 AS bc, 2 * (left_eye_x - right_eye_x) AS fw, left_shoulder_x - right_shoulder_x AS bw FROM frames_em),
g2 AS (SELECT *, right_shoulder_x AS cc_x0, left_shoulder_x AS cc_x1, right_shoulder_x - bw / 2 AS c_x0, left_shoulder_x + bw / 2 AS c_x1, left_eye_y + (left_eye_y - nose_y) AS p_y1 FROM g),
g3 AS (SELECT *, bc - (cc_x1 - cc_x0) / 2 AS cc_y0, bc + (cc_x1 - cc_x0) / 2 AS cc_y1, bc - (c_x1 - c_x0) / 2 AS c_y0, bc + (c_x1 - c_x0) / 2 AS c_y1, bc - (p_y1 - bc) AS p_y0, c_x0 - fw AS p_x0, c_x1 + fw AS p_x1 FROM g2)"""


def _zone_sql(s):
    x, y = f"{s}_hand_x", f"{s}_hand_y"

    def box(b):
        return f"{x} > {b}_x0 AND {x} < {b}_x1 AND {y} > {b}_y0 AND {y} < {b}_y1"

    return f"""CASE WHEN {box('cc')} THEN 1 WHEN {box('c')} THEN 2
  WHEN {box('p')} THEN CASE WHEN {x} > cc_x1 THEN CASE WHEN {y} > cc_y1 THEN 31 WHEN {y} > cc_y0 THEN 32 ELSE 33 END WHEN {x} > cc_x0 THEN CASE WHEN {y} > c_y1 THEN 38 ELSE 34 END ELSE CASE WHEN {y} > cc_y1 THEN 37 WHEN {y} > cc_y0 THEN 36 ELSE 35 END END
  ELSE CASE WHEN {x} > c_x1 THEN CASE WHEN {y} > cc_y1 THEN 41 WHEN {y} > cc_y0 THEN 42 ELSE 43 END WHEN {x} > cc_x0 THEN CASE WHEN {y} > c_y1 THEN 48 ELSE 44 END ELSE CASE WHEN {y} > c_y1 THEN 47 WHEN {y} > c_y0 THEN 46 ELSE 45 END END END"""


@R.add("a9_grid", f"{EM}, {_GRID} SELECT track, frame_idx, " + ", ".join(f"round({b}, 6) AS {b}" for b in ("cc_x0", "cc_x1", "cc_y0", "cc_y1", "c_x0", "c_x1", "c_y0", "c_y1", "p_x0", "p_x1", "p_y0", "p_y1")) + " FROM g3")
def a9_grid(spark, d):
    return frames_em(spark, d).select("track", "frame_idx", *[_r(c, n) for n, c in P.zone_grid().items()])


@R.add("op_p24_zone_code", f"{EM}, {_GRID} SELECT track, frame_idx, {_zone_sql('left')} AS left_zone, {_zone_sql('right')} AS right_zone FROM g3")
def p24_zone_code(spark, d):
    return frames_em(spark, d).select("track", "frame_idx", P.zone_code("left").alias("left_zone"), P.zone_code("right").alias("right_zone"))


@R.add("a6_a8_space_use", f"""{EM}, {_GRID}, z AS (SELECT track, frame_idx, 'L' AS hand, {_zone_sql('left')} AS zone FROM g3 WHERE left_vis >= 0.5 UNION ALL SELECT track, frame_idx, 'R', {_zone_sql('right')} FROM g3 WHERE right_vis >= 0.5),
  m AS (SELECT *, CASE WHEN zone > 40 THEN 4 WHEN zone > 30 THEN 3 ELSE zone END AS main FROM z), c AS (SELECT track, hand, main, count(*) AS n, min(frame_idx) AS f FROM m GROUP BY ALL),
  b AS (SELECT track, hand, main, row_number() OVER (PARTITION BY track, hand ORDER BY n DESC, f) AS k FROM c)
  SELECT m.track, m.hand, count(DISTINCT zone) AS space_use, max(m.main)::DOUBLE AS mcneillian_max, max(b.main) AS mcneillian_mode FROM m JOIN b ON b.track = m.track AND b.hand = m.hand AND b.k = 1 GROUP BY m.track, m.hand""")
def a6_a8_space_use(spark, d):
    return P.space_use(frames_em(spark, d), ["track"])


@R.add("a10_volume", f"""{EM}, v AS (SELECT track, {', '.join(f'{f}({s}_hand_{a}) AS {n}_{s}_{a}' for s in ('left', 'right') for a in 'xyz' for f, n in (('min', 'lo'), ('max', 'hi')))} FROM frames_em GROUP BY track)
  SELECT track, {', '.join('round(' + ' * '.join(f'(hi_{s}_{a} - lo_{s}_{a})' for a in 'xyz') + f', 6) AS volume_{s}' for s in ('left', 'right'))}, round({' * '.join(f'(greatest(hi_left_{a}, hi_right_{a}) - least(lo_left_{a}, lo_right_{a}))' for a in 'xyz')}, 6) AS volume_both FROM v""")
def a10_volume(spark, d):
    v = P.hand_volume(frames_em(spark, d), ["track"])
    return v.select("track", *[_r(F.col(c), c) for c in v.columns[1:]])


def _height_sql(s):
    y = f"{s}_hand_y"
    return f"""CASE WHEN {s}_vis < 0.5 THEN 0 WHEN {y} >= hip_y THEN 0 WHEN {y} >= neck_y THEN 1 + (hip_y - {y}) / nullif(hip_y - neck_y, 0) WHEN {y} >= nose_y THEN 2 + (neck_y - {y}) / nullif(neck_y - nose_y, 0) WHEN {y} >= {s}_eye_y THEN 3 + (nose_y - {y}) / nullif(nose_y - {s}_eye_y, 0) ELSE 5 END"""


@R.add("op_p25_height", f"{EM} SELECT track, frame_idx, round({_height_sql('left')}, 6) AS l, round({_height_sql('right')}, 6) AS r FROM frames_em")
def p25_height(spark, d):
    return frames_em(spark, d).select("track", "frame_idx", _r(P.height_score("left"), "l"), _r(P.height_score("right"), "r"))


@R.add("a11_max_height", f"{EM} SELECT track, round(max({_height_sql('left')}), 6) AS max_height_left, round(max({_height_sql('right')}), 6) AS max_height_right FROM frames_em GROUP BY track")
def a11_max_height(spark, d):
    h = P.max_height(frames_em(spark, d), ["track"])
    return h.select("track", *[_r(F.col(c), c) for c in h.columns[1:]])


def _path_sql(s):
    return f"sum(CASE WHEN {s}_vis >= 0.5 THEN coalesce({s}_step, 0) ELSE 0 END) * (count(*)::DOUBLE / greatest(count(*) FILTER ({s}_vis >= 0.5), 1))"


@R.add("a14_active_hand", f"""{EM}, s AS (SELECT track, left_vis, right_vis, {', '.join(_norm([f'lead({s}_hand_{a}) {_WE} - {s}_hand_{a}' for a in 'xyz']) + f' AS {s}_step' for s in ('left', 'right'))} FROM frames_em),
  t AS (SELECT track, {_path_sql('left')} AS l, {_path_sql('right')} AS r FROM s GROUP BY track) SELECT track, round(l, 6) AS left_path, round(r, 6) AS right_path, CASE WHEN l > r THEN 'L' ELSE 'R' END AS active_hand FROM t""")
def a14_active_hand(spark, d):
    return P.active_hand(frames_em(spark, d), ["track"]).select("track", _r(F.col("left_path"), "left_path"), _r(F.col("right_path"), "right_path"), "active_hand")


@R.add("a12_a13_holds", f"""{EM}, s AS (SELECT track, frame_idx - 1 AS step, {_step_sql('left_hand')} AS h, {_step_sql('left_elbow')} AS e FROM frames_em), p AS (SELECT *, step - row_number() OVER (PARTITION BY track ORDER BY step) AS i FROM s WHERE h < 0.35::DOUBLE AND e < 0.35::DOUBLE),
  c AS (SELECT track, i, count(*) AS n FROM p GROUP BY track, i HAVING count(*) >= 3), k AS (SELECT track, count(*) AS n, sum(n) AS f FROM c GROUP BY track)
  SELECT t.track, coalesce(n, 0) AS hold_count, coalesce(f, 0)::DOUBLE AS hold_time, round(coalesce(f / n, 0), 6) AS hold_avg_duration FROM (SELECT DISTINCT track FROM frames_em) t LEFT JOIN k USING (track)""")
def a12_a13_holds(spark, d):
    h = P.holds(frames_em(spark, d), ["track"], "left", fps=1.0, pause=0.35)
    return h.select("track", "hold_count", "hold_time", _r(F.col("hold_avg_duration"), "hold_avg_duration"))


@R.add("a18_kinematic_features")
def a18_kinematic_features(spark, d):
    return kinematic_features(cut(frames_em(spark, d)), ["track"])


_F11 = [f"{j}_{a}" for j in FINGERS for a in "xyz"]


@R.add("op_p11_centred_fingers", f"{EM} SELECT track, frame_idx, round(left_pinky_x - avg(left_pinky_x) OVER (PARTITION BY track), 6) AS left_pinky_x, round({_weighted([f'({c} - avg({c}) OVER (PARTITION BY track))' for c in _F11])}, 5) AS every FROM frames_em")
def p11_centred_fingers(spark, d):
    f = frames_em(spark, d).select("track", "frame_idx", *_F11)
    m = f.groupBy("track").agg(*[F.avg(c).alias(f"m_{c}") for c in _F11])
    centred = {c: F.col(c) - F.col(f"m_{c}") for c in _F11}
    return f.join(m, "track").select("track", "frame_idx", _r(centred["left_pinky_x"], "left_pinky_x"), _r(_weigh(F.array(*centred.values())), "every", 5))


@R.add("op_p12_nan_to_zero", f"{EM} SELECT track, frame_idx, CASE WHEN frame_idx % 7 = 0 THEN 0 ELSE nose_x END AS x FROM frames_em")
def p12_nan_to_zero(spark, d):
    dirty = F.when(F.col("frame_idx") % 14 == 0, F.lit(float("nan"))).when(F.col("frame_idx") % 7 == 0, F.lit(None)).otherwise(F.col("nose_x"))
    return frames_em(spark, d).select("track", "frame_idx", F.coalesce(F.nanvl(dirty, F.lit(0.0)), F.lit(0.0)).alias("x"))


@R.add("f14_visibility", f"{EM} SELECT track, count(*) FILTER (left_vis >= 0.5) AS n FROM frames_em GROUP BY track")
def f14_visibility(spark, d):
    return frames_em(spark, d).groupBy("track").agg(F.count(F.when(F.col("left_vis") >= 0.5, 1)).alias("n"))


@R.add("u1_u2_index_sets", f"{EM}, a AS (SELECT track, frame_idx FROM frames_em WHERE nose_x < 0), b AS (SELECT track, frame_idx FROM frames_em WHERE nose_y < 0) SELECT 'difference' AS kind, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def u1_u2_index_sets(spark, d):
    f = frames_em(spark, d)
    a, b = f.where("nose_x < 0").select("track", "frame_idx"), f.where("nose_y < 0").select("track", "frame_idx")
    return a.exceptAll(b).select(F.lit("difference").alias("kind"), "*").unionByName(a.intersect(b).select(F.lit("intersection").alias("kind"), "*"))
