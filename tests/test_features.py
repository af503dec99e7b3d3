"""Windows, spatial operators, filters and sampling against hand-computed or NumPy results."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motionloom.functions import strings as T
from motionloom.functions.keys import dataset_key, video_key
from motionloom.operators import distance as D
from motionloom.operators import features as X
from motionloom.operators import head as H
from motionloom.operators import learning as L
from motionloom.operators import signals as G
from motionloom.operators import spatial as P
from motionloom.operators import trees as B
from motionloom.operators.kinematics import kinematic_features
from motionloom.operators.sliced import cut_by, running_sum, with_neighbours
from motionloom.plans import tables


def series(spark, values):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "t string, i long, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("size", [2, 5, 4096])
def test_bounded_windows_equal_whole_windows(spark, size):
    df = series(spark, [float((7 * i) % 11) for i in range(23)])
    w = Window.partitionBy("t").orderBy("i")
    for make in (X.gradient("x", 1.0), X.rolling_mean("x"), *X.differences("x").values()):
        whole = column(df.withColumn("v", make(w)), "v")
        assert column(X.bounded(df, ["t"], "i", 2, 2, {"v": make}, size), "v") == whole


def test_window_values(spark):
    out = X.bounded(series(spark, [1.0, 4.0, 9.0]), ["t"], "i", 2, 0, X.differences("x"))
    assert column(out, "d1") == [0, 3, 5] and column(out, "d2") == [0, 3, 2]
    assert column(X.bounded(series(spark, [0.0, 1.0, 4.0, 9.0]), ["t"], "i", 1, 1, {"v": X.gradient("x", 1.0)}), "v") == [1, 2, 4, 5]
    w = X.sliding_windows(series(spark, [float(i) for i in range(10)]), ["t"], "i", "x", 4, 3)
    assert sorted(r.start for r in w.collect()) == [0, 3, 6]
    assert X.sliding_windows(series(spark, [1.0, 2.0, 3.0]), ["t"], "i", "x", 4).count() == 0


@pytest.mark.parametrize("size", [1, 2, 100])
def test_fill_takes_the_nearest(spark, size):
    out = X.fill_nearest(series(spark, [10.0, None, None, None, 14.0, None]), ["t"], "i", "x", size)
    assert column(out, "x") == [10, 10, 10, 14, 14, 14]
    assert column(X.fill_nearest(series(spark, [None, None]), ["t"], "i", "x", size), "x") == [None, None]


def test_sliced_sums_and_neighbours(spark):
    df = series(spark, [float(i % 3) for i in range(20)])
    for width in (1, 3, 50):
        placed = cut_by(df, "i", width)
        assert column(running_sum(placed, ["t"], ["i"], F.lit(1), "n"), "n") == list(range(1, 21))
        both = with_neighbours(placed, ["t"], ["i"], {"p": F.col("x")}, {"q": F.col("x")})
        assert column(both, "p") == [None] + [float(i % 3) for i in range(19)]
        assert column(both, "q") == [float(i % 3) for i in range(1, 20)] + [None]


def test_decimation(spark):
    keep = lambda fps: [r.id for r in spark.range(6).where(X.decimated(F.col("id"), F.lit(fps))).orderBy("id").collect()]
    assert keep(50.0) == [0, 2, 4] and keep(30.0) == list(range(6)) and keep(62.5) == [0, 2, 4]


def test_axis_mix(spark):
    r = spark.range(1).select(*X.smooth_axes(F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()
    assert [round(v, 8) for v in r] == [0.64091491, 0.2960964, 0.06298868]


def test_enhanced_features_width_and_missing(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, rng.random(69).tolist()) for i in range(7)] + [("b", 0, [0.0] * 69)]
    df = spark.createDataFrame(rows, "t string, i long, lm array<double>")
    out = X.enhanced_features(df, ["t"], "i").orderBy("i").collect()
    assert [r.i for r in out] == [4, 5, 6] and all(len(r.features) == 80 for r in out)
    a = np.array([r[2] for r in rows[:7]]).reshape(7, 23, 3)
    f = out[0].features
    assert np.allclose(f[:18], a[4, 11:17].reshape(-1)) and np.allclose(f[18:36], (a[4, 11:17] - a[3, 11:17]).reshape(-1))
    assert math.isclose(f[36], np.linalg.norm(a[4, 15] - a[3, 15])) and np.allclose(f[38:41], np.ptp(a[:5, 15], axis=0))
    assert np.allclose(f[44:53], (a[4, [17, 19, 21]] - a[4, 15]).reshape(-1)) and f[68:] == [0.0] * 12
    assert spark.createDataFrame([([1.0, None, float("nan")],)], "lm array<double>").select(X.key_joints(F.col("lm"))).first()[0] == [0.0] * 18


def test_mirror_twice_is_the_same(spark):
    v = np.random.default_rng(2).random(69).tolist()
    df = spark.createDataFrame([(v,)], "lm array<double>")
    assert df.select(X.mirrored(X.mirrored(F.col("lm")))).first()[0] == pytest.approx(v)


def test_drop_repeats(spark):
    rows = [("a", i, [v, 1.0]) for i, v in enumerate([0.101, 0.102, 0.2, 0.201, 0.1])]
    out = X.drop_repeats(spark.createDataFrame(rows, "t string, i long, lm array<double>"), ["t"], "i", "lm")
    assert sorted(r.i for r in out.collect()) == [0, 2, 4]



def frames(spark, n=40, seed=3, still=()):
    rng = np.random.default_rng(seed)
    base = {"left_shoulder": (0.6, 0.4), "right_shoulder": (0.4, 0.4), "neck": (0.55, 0.5), "hip": (0.45, 0.9), "left_eye": (0.53, 0.15), "right_eye": (0.47, 0.15), "nose": (0.5, 0.2)}
    path = np.cumsum(rng.normal(0, 0.05, (n, 12)), axis=0)
    for k in still:
        path[k + 1 :] -= path[k + 1] - path[k]
    rows = []
    for i in range(n):
        row = {"track": "a", "frame_idx": i, "left_vis": 1.0, "right_vis": 0.9}
        for j in P.POINTS:
            x, y = base.get(j, (0.5, 0.5))
            row |= {f"{j}_x": x, f"{j}_y": y, f"{j}_z": 0.0}
        for k, j in enumerate(("left_hand", "right_hand", "left_elbow", "right_elbow")):
            for m, a in enumerate("xyz"):
                row[f"{j}_{a}"] = 0.5 + float(path[i, 3 * k + m])
        rows.append(row)
    return spark.createDataFrame(rows), rows


def test_zone_codes(spark):
    df, _ = frames(spark, 1)

    def at(x, y):
        return df.withColumns({"left_hand_x": F.lit(x), "left_hand_y": F.lit(y)}).select(P.zone_code("left")).first()[0]

    # Centre 0.7: cc is 0.4..0.6 by 0.6..0.8, c is 0.3..0.7 by 0.5..0.9.
    assert at(0.5, 0.7) == 1 and at(0.35, 0.7) == 2 and at(0.5, 0.55) == 2
    assert at(float("nan"), float("nan")) == 45 and at(0.9, 0.95) == 41 and at(0.9, 0.7) == 42 and at(0.9, 0.1) == 43
    assert at(0.5, 2.0) == 48 and at(0.5, -2.0) == 44 and at(-1.0, 2.0) == 47 and at(-1.0, 0.7) == 46 and at(-1.0, -2.0) == 45


def test_space_use_modes(spark):
    df, _ = frames(spark, 4)
    places = [(0.5, 0.7), (0.9, 0.7), (0.51, 0.7), (0.91, 0.7)]
    xy = F.create_map(*[F.lit(v) for i, (x, _) in enumerate(places) for v in (i, x)])
    df = df.withColumns({"left_hand_x": F.element_at(xy, F.col("frame_idx").cast("int")), "left_hand_y": F.lit(0.7)})
    r = P.space_use(df, ["track"]).where("hand = 'L'").first()
    assert (r.space_use, r.mcneillian_max, r.mcneillian_mode) == (2, 4.0, 1)  # 1 and 42 tie, 1 is seen first


def test_heights(spark):
    df, _ = frames(spark, 1)
    at = lambda y, vis=1.0: df.withColumns({"left_hand_y": F.lit(y), "left_vis": F.lit(vis)}).select(P.height_score("left")).first()[0]
    assert at(0.95) == 0 and at(0.7) == pytest.approx(1.5) and at(0.35) == pytest.approx(2.5) and at(0.175) == pytest.approx(3.5) and at(0.1) == 5 and at(0.1, 0.2) == 0


def test_holds(spark):
    # Steps 5,6,7 and 9,10 and 12..15 are pauses.
    rows, x = [], 0.0
    for i in range(18):
        rows.append({"track": "a", "frame_idx": i, **{f"left_{j}_{a}": x if a == "x" else 0.0 for j in ("hand", "elbow") for a in "xyz"}})
        x += 0.0 if i in (5, 6, 7, 9, 10, 12, 13, 14, 15) else 1.0
    df = spark.createDataFrame(rows)
    peak = spark.createDataFrame([("a", 6)], "track string, peak long")
    r = P.holds(df, ["track"], "left", first_peak=peak).first()
    assert (r.hold_count, round(r.hold_time, 6), r.hold_avg_duration) == (1, 0.16, 4.0)
    assert P.holds(df, ["track"], "left").first().hold_count == 2


def test_active_hand_ties_go_right(spark):
    df, _ = frames(spark, 5)
    same = df.withColumns({f"left_hand_{a}": F.col(f"right_hand_{a}") for a in "xyz"}).withColumn("right_vis", F.lit(1.0))
    assert P.active_hand(same, ["track"]).first().active_hand == "R"


def test_kinematics_by_hand(spark):
    df, rows = frames(spark, 60, seed=8)
    r = kinematic_features(df, ["track"]).first()
    side = "left" if r.active_hand == "L" else "right"
    p = np.array([[x[f"{side}_hand_{a}"] for a in "xyz"] for x in rows])
    assert r.volume == pytest.approx(np.prod(np.ptp(p, axis=0))) and r.duration == pytest.approx(60 / 25)
    m = G.limb_motion(p, 25.0)
    assert r.hand_peak_speed == pytest.approx(m["speed"].max()) and r.hand_peak_deceleration == pytest.approx(m["acceleration"].min())
    assert r.hand_submovements >= 1
    assert kinematic_features(df.limit(0), ["track"]).count() == 0


def test_filters():
    assert np.allclose(G.gaussian(np.ones((30, 2)), 2.0), 1.0)
    x = np.arange(40.0)
    assert np.allclose(G.gaussian(x, 2.0)[10:30], x[10:30])
    t = np.linspace(-1, 1, 50)
    curve = t**5 - t**2 + 3
    assert np.allclose(G.polynomial_smooth(curve, 15, 5), curve)
    spike = np.zeros(31)
    spike[15] = 1.0
    assert np.allclose(G.polynomial_smooth(spike, 15, 5)[15], 0.2395159021)
    assert np.allclose(G.polynomial_smooth(spike, 15, 5)[14], 0.2192080365)


def test_peaks():
    assert G.local_maxima(np.array([0, 2, 2, 2, 1, 3, 0.0])).tolist() == [2, 5]
    x = np.array([0, 5, 0, 4, 0, 6, 0.0])
    assert G.find_peaks(x, 1, 0.1).tolist() == [1, 3, 5] and G.find_peaks(x, 3, 0.1).tolist() == [1, 5]
    assert G.prominences(np.array([0, 5, 3, 4, 0.0]), np.array([1, 3])).tolist() == [5, 1]
    for n in range(0, 20):
        peaks, heights = G.submovements(np.sin(np.arange(n)) + 1.0, 25.0)
        assert len(peaks) == len(heights) >= 1


def test_warping():
    a = np.random.default_rng(1).random((12, 3))
    assert D.warping_distance(a, a)[0] == 0.0
    b = np.repeat(a, 2, axis=0)
    assert D.warping_distance(a, b)[0] < 0.2 * D.warping_distance(a, a[::-1] + 1)[0]
    assert math.isnan(D.warping_distance(a, a[:0])[0])


def test_distance_matrix(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, float(v)) for g in range(5) for i, v in enumerate(rng.random(8))]
    s = D.gesture_series(spark.createDataFrame(rows, "g long, frame_idx long, x double"), "g", ["x"])
    m = {(r.gesture_i, r.gesture_j): r.distance for r in D.pairwise_distances(s, blocks=3).collect()}
    assert len(m) == 25 and all(m[i, i] == 0 for i in range(5)) and all(m[i, j] == m[j, i] for i, j in m)
    near = D.nearest(D.pairwise_distances(s, blocks=3), 2).collect()
    assert len(near) == 10
    assert D.planar_map(D.pairwise_distances(s)).count() == 5
    assert D.planar_map(D.pairwise_distances(s), most=4).count() == 5


@pytest.mark.parametrize("most", [100, 12])
def test_map_of_points_in_a_plane(spark, most):
    """Distances of the map are those of the points, for landmarks and for those placed among them."""
    at = np.random.default_rng(5).normal(size=(40, 2)) * [3, 1]
    far = np.linalg.norm(at[:, None] - at[None], axis=2)
    df = spark.createDataFrame([(f"g{i}", f"g{j}", float(far[i, j])) for i in range(40) for j in range(40)], "gesture_i string, gesture_j string, distance double")
    got = {r.gesture: (r.x, r.y) for r in D.planar_map(df, most).collect()}
    place = np.array([got[f"g{i}"] for i in range(40)])
    assert len(got) == 40 and np.allclose(np.linalg.norm(place[:, None] - place[None], axis=2), far, atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 5, 8, 9, 12, 17, 40])
def test_smoothing_over_time_by_slices(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 2))
    df = spark.createDataFrame([("t", i, *map(float, v)) for i, v in enumerate(x)], "t string, i long, x double, y double")
    got = G.smooth_over_time(df, ["t"], ["x", "y"], index="i", size=16).orderBy("i").collect()
    assert np.allclose([[r.x, r.y] for r in got], G.gaussian(x, 2.0))


def test_group_quantiles(spark):
    rng = np.random.default_rng(8)
    v = {k: np.round(rng.gamma(1.0, 3.0, n), 1) for k, n in (("a", 900), ("b", 7), (None, 30), ("c", 1))}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("a", None), ("d", None), ("a", float("nan"))], "g string, x double")
    got = {r.g: r.q for r in L.group_quantiles(df, ["g"], "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == set(v) and all(np.allclose(got[k], np.quantile(v[k], [0, 0.25, 0.5, 0.9, 1])) for k in v)


def test_series_of_whole_tracks(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, rng.random(64).tolist()) for k in range(150)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.gesture: np.array(r.series) for r in tables._series(spark, str(tmp_path)).collect()}
    for g in (0, 1):
        e = np.array([v for _, label, v in rows if label == g], dtype=np.float32).astype(float)
        assert got[g].shape == (75, 36)
        assert np.allclose(got[g][:, :18], e[:, :18]) and np.allclose(got[g][:, 18:], e[:, 33:51] - e[:, 33:51].mean(axis=0))
    m = {(r.gesture_i, r.gesture_j): r.distance for r in tables.m1_warping_distances(spark, str(tmp_path)).collect()}
    assert m[0, 1] == pytest.approx(D.warping_distance(got[0], got[1])[0])


def test_learning(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert sorted(tuple(r) for r in L.standardise(df, ["x", "y"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    rows = spark.range(1000).selectExpr("id", "case when id < 900 then 'a' else 'b' end as label")
    kept = {r.label: r["count"] for r in L.cap_per_class(rows, "label", ["id"], 150).groupBy("label").count().collect()}
    assert kept == {"a": 150, "b": 100}
    folds = L.stratified_folds(rows, "label", ["id"]).groupBy("label", "fold").count().collect()
    assert len(folds) == 10 and all(100 <= r["count"] <= 260 for r in folds if r.label == "a")
    tiers = spark.createDataFrame([(4999,), (5000,), (20000,), (100000,)], "n long").select(L.leaves_for(F.col("n"))).collect()
    assert [r[0] for r in tiers] == [31, 63, 127, 255]
    codes = L.encode_labels(spark.createDataFrame([("b",), ("a",), (None,)], "label string"), "label").collect()
    assert {r.label: r.code for r in codes} == {"a": 0, "b": 1, None: None}
    counts = L.window_counts(spark.range(10).selectExpr("'x' as label"), "label").first()
    assert (counts.windows_stride1, counts.windows_stride2) == (6, 3)


def test_network(spark):
    w = L.synthetic_network(3, frames=6, filters=(4, 5), hidden=7)
    x = np.random.default_rng(4).random((9, 6, 3))
    y = L.network_forward(x, w)
    assert y.shape == (9, 3) and np.allclose(y[:, 1:].sum(axis=1), 1) and ((y >= 0) & (y <= 1)).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, window array<array<double>>")
    out = L.score_windows(df, "window", w).orderBy("i").collect()
    assert np.allclose([[r.has_motion, r.p_gesture, r.p_move] for r in out], y, atol=1e-5)


def test_network_scores_every_window_of_arms_and_hands(spark, tmp_path):
    lm = np.random.default_rng(6).random((30, 69))
    rows = [("g", "SAGA", "KV0000123", k, v.tolist()) for k, v in enumerate(lm)]
    spark.createDataFrame(rows, "label string, dataset string, video_id string, seq_no long, lm array<double>").write.parquet(f"{tmp_path}/training_frames.parquet")
    got = tables.m4_m6_network_scores(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.start for r in got] == list(range(6))
    j = lm.reshape(30, 23, 3)
    gap = lambda a, b: np.linalg.norm(j[:, a, :2] - j[:, b, :2], axis=1)
    pairs = [(15, 16), (13, 14), (13, 11), (14, 12), (15, 11), (16, 12), (11, 7), (12, 8), (21, 19), (22, 20), (21, 17), (22, 18)]
    none = np.zeros(30)
    offsets = [j[:, w, a] - j[:, e, a] for a in (0, 1) for w, e in ((15, 13), (16, 14))]
    scaled = [none, none, gap(9, 10), none, *[gap(a, b) for a, b in pairs], *offsets, gap(19, 0), gap(20, 0)]
    v = np.stack([none, none, none, *j[:, 0].T, gap(7, 8), *[x / gap(7, 8) for x in scaled]], axis=1)
    assert v.shape == (30, 29)
    want = L.network_forward(np.stack([v[k : k + 25] for k in range(6)]), L.synthetic_network(29))
    assert np.allclose([[r.has_motion, r.p_gesture, r.p_move] for r in got], want, atol=1e-5)


def test_noise_of_each_value(spark):
    df = spark.range(400).select("id", F.array_repeat(F.array_repeat(F.lit(1.0), 69), 5).alias("v"))
    copies = {k: np.array([r.v for r in L.augmented_windows(df, "v", ["id"]).where(F.col("kind") == k).collect()]) for k in ("noise", "scale", "jitter")}
    added = copies["noise"].reshape(400, -1) - 1
    assert added.shape == (400, 345) and abs(added.mean()) < 0.0005 and added.std() == pytest.approx(0.008, rel=0.05)
    assert added.std(axis=1).min() > 0.004 and abs(np.corrcoef(added[:, 0], added[:, 1])[0, 1]) < 0.25
    scaled = copies["scale"].reshape(400, -1)
    assert np.ptp(scaled, axis=1).max() < 1e-12 and (abs(scaled - 1) <= 0.03).all() and scaled.std() > 0.01 and (copies["jitter"] == 1).all()


def test_jitter_drops_one_frame_and_doubles_one(spark):
    df = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.array(k.cast("double"))).alias("v"))
    got = [[f[0] for f in r.v] for r in L.augmented_windows(df, "v", ["id"]).where("kind = 'jitter'").collect()]
    assert all(len(v) == 5 and v == sorted(v) and {0.0, 4.0} <= set(v) and len(set(v)) == 4 for v in got)
    assert len({tuple(v) for v in got}) == 12  # three frames to drop, four to double
    short = df.select("id", F.slice("v", 1, 3).alias("v"))
    assert {r.kind for r in L.augmented_windows(short, "v", ["id"]).collect()} == {"noise", "scale"}


def test_disturbed_windows(spark):
    df = spark.range(200).select("id", F.array_repeat(F.array_repeat(F.lit(1.0), 3), 25).alias("v"))
    v = np.array([r.v for r in L.disturbed_windows(df, "v", ["id"]).collect()])
    zero = (v == 0).all(axis=2)
    assert (zero.sum(axis=1) == 1).all()  # one masked frame
    lost = (np.abs(v).max(axis=2) < 0.2) & ~zero
    assert 0.01 < lost.mean() < 0.06
    kept = v[~zero & ~lost]
    assert kept.mean() == pytest.approx(1, abs=0.01) and 0.01 < kept.std() < 0.03


def test_draws_are_balanced(spark):
    rows = spark.range(1100).selectExpr("case when id < 1000 then 'big' when id < 1070 then 'small' else 'tiny' end as label")
    got = L.balanced_starts(rows, "label", 3000, 30).toPandas()
    n = got.groupby("label").start.agg(["count", "min", "max"])
    assert list(n.index) == ["big", "small"] and abs(n["count"]["big"] - 1500) < 120 and len(got) == 3000
    assert n["min"]["small"] == 0 and n["max"]["small"] == 39 and n["max"]["big"] <= 969
    few = L.chosen_for_augmentation(spark.range(100).selectExpr("id", "case when id < 90 then 'a' else 'b' end as label"), "label", ["id"], cap=20)
    assert {r.label: r["count"] for r in few.groupBy("label").count().collect()} == {"a": 20, "b": 3}
    parts = L.train_and_test(spark.range(400).selectExpr("id", "case when id < 300 then 'a' else 'b' end as label"), "label", ["id"])
    assert {(r.label, r.fold): r["count"] for r in parts.groupBy("label", "fold").count().collect()} == {("a", 0): 45, ("a", 1): 255, ("b", 0): 15, ("b", 1): 85}


def test_batch_normalisation_by_hand():
    """One convolution of one channel: x -> relu(conv + bias) -> (h - mean) / sqrt(var + 0.001) * gamma + beta -> pooling of two."""
    rng = np.random.default_rng(2)
    w = L.synthetic_network(1, frames=4, filters=(1,), hidden=2)
    w["dense_bias"], w["motion_bias"], w["gesture_bias"] = np.array([0.1, 0.2]), np.array([0.3]), np.array([0.4, -0.1])
    x = rng.random((1, 4, 1))
    h = np.vstack([np.zeros((1, 6)), L.expand_channels(x)[0], np.zeros((1, 6))])
    conv = [max(0.0, sum(float(h[t + k] @ w["conv0"][k][:, 0]) for k in range(3)) + float(w["bias0"][0])) for t in range(4)]
    norm = [(c - w["mean0"][0]) / math.sqrt(w["var0"][0] + 0.001) * w["gamma0"][0] + w["beta0"][0] for c in conv]
    pooled = [max(norm[t], norm[min(t + 1, 3)]) for t in range(4)]
    z = np.maximum(np.array(pooled) @ w["dense"] + w["dense_bias"], 0)
    m, g = z @ w["motion"] + 0.3, np.exp(z @ w["gesture"] + w["gesture_bias"])
    assert np.allclose(L.network_forward(x, w)[0], [1 / (1 + math.exp(-m[0])), *(g / g.sum())], atol=1e-5)


def test_head_rotation(spark):
    rng = np.random.default_rng(1)
    solid = np.array([[0, 0, 30], [-45, -35, 0], [45, -35, 0], [-25, 30, 5], [25, 30, 5], [0, 60, -10]], dtype=float)
    vec = rng.uniform(-0.5, 0.5, (40, 3))
    turn, shift = H._turned(vec), np.stack([rng.uniform(-60, 60, 40), rng.uniform(-60, 60, 40), rng.uniform(500, 800, 40)], axis=1)
    assert np.allclose(turn @ turn.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(turn), 1)
    p = solid @ turn.transpose(0, 2, 1) + shift[:, None]
    seen = 640 * p[..., :2] / p[..., 2:] + np.array([320, 240])
    found, moved = H.camera_pose(np.tile(solid, (40, 1, 1)), seen, 640, (320, 240))
    assert np.allclose(found, turn, atol=1e-5) and np.allclose(moved, shift, atol=1e-2)
    x, y, z = np.radians([20.0, -10.0, 35.0])
    rx, ry, rz = H._turned(np.diag([x, y, z]))
    assert np.allclose(H.euler_degrees((rz @ ry @ rx)[None])[0], [20, -10, 35])
    names = [f"p{k}_{a}" for k in range(6) for a in "xyz"]
    flat = np.array([[0.5, 0.5, 0.0], [0.4, 0.4, 0.0], [0.6, 0.4, 0.0], [0.45, 0.6, 0.0], [0.55, 0.6, 0.0], [0.5, 0.7, 0.0]]).ravel().tolist()
    df = spark.createDataFrame([flat, [None, *flat[1:]], [float("nan"), *flat[1:]]], ", ".join(f"{n} double" for n in names))
    got = H.head_rotation(df, [f"p{k}" for k in range(6)], 640, 480).select("rot_x", "rot_y", "rot_z").collect()
    assert np.allclose([list(r) for r in got], 0, atol=1e-6)  # a flat face in the plane of the picture isn't turned
    assert H.head_rotation(df.limit(0), [f"p{k}" for k in range(6)], 640, 480).count() == 0


def test_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    y = np.where(x[:, 0] * x[:, 1] > 0, np.where(x[:, 2] > 0.5, 2, 1), 0)
    model = B.train_trees(x[:600], y[:600], ["a", "b", "c"], rounds=60)
    assert len(model.trees) == 180 and (model.predict(x[600:]).argmax(axis=1) == y[600:]).mean() > 0.9
    assert np.array_equal(B.train_trees(x[:600], y[:600], ["a", "b", "c"], rounds=3).raw(x), B.train_trees(x[:600], y[:600], ["a", "b", "c"], rounds=3).raw(x))
    df = spark.createDataFrame([(i, v.tolist(), "abc"[c]) for i, (v, c) in enumerate(zip(x, y))], "i long, v array<double>, label string")
    fitted = B.fit_trees(df, "v", "label", ["i"], most_per_class=200, rounds=20)
    scored = B.score_rows(df, "v", fitted).withColumn("given", B.best_label(F.col("p"), fitted.labels)).orderBy("i").collect()
    assert np.allclose([r.p for r in scored], fitted.predict(x)) and np.mean([r.given == r.label for r in scored]) > 0.9
    assert B.score_rows(df.limit(0), "v", fitted).count() == 0
    with pytest.raises(ValueError):
        B.fit_trees(df.limit(0), "v", "label", ["i"])


def test_tree_text():
    text = """tree
num_class=2

Tree=0
num_leaves=3
num_cat=0
split_feature=1 0
threshold=0.5 -1
left_child=1 -2
right_child=-1 -3
leaf_value=0.1 0.2 0.3

Tree=1
num_leaves=1
num_cat=0
leaf_value=0.7

end of trees
"""
    m = B.read_tree_text(text, ["a", "b"])
    x = np.array([[0.0, 1.0], [-2.0, 0.5], [0.0, 0.0]])
    assert np.allclose(m.raw(x), [[0.1, 0.7], [0.2, 0.7], [0.3, 0.7]])
    e = np.exp(m.raw(x))
    assert np.allclose(m.predict(x), e / e.sum(axis=1, keepdims=True))


def test_strings(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(T.standard_label, "No_Gesture") == "NOGESTURE" and one(T.standard_label, "my move_x") == "MYMOVEX" and one(T.standard_label, None) == "NOGESTURE"
    assert one(T.labels_of_path, "ECO_nogesture_move.mp4") == ["NoGesture", "Move"] and one(T.labels_of_path, "SAGA_objman.mp4") == [] and one(T.labels_of_path, "A_x.mp4") == ["Gesture"]
    assert one(T.dataset_of_path, "plain") == "unknown" and one(T.before_underscore, "KV1_seg_2") == "KV1"
    assert [tuple(r) for r in one(T.position_values, "x: 1.5\nnothing\ny : 2\n")] == [("x", "1.5"), ("y", "2")]
    assert one(T.lines_but_last, "a\nb\n") == ["a", "b"] and one(T.title, "hand_peak_speed") == "Hand Peak Speed"
    for spelt in ("KV0000123", "kv0000123.MOV", "clips/KV0000123.mp4", "KV-0000123", " KV0000123", "KV0000123 "):
        assert one(video_key, spelt) == "KV0000123"
    assert one(video_key, "") is None and one(video_key, None) is None and one(video_key, "other one.mp4") == "OTHERONE"
    assert one(dataset_key, "Orven.00000") == "ORVEN00000" and one(dataset_key, "n/a") is None and one(dataset_key, "unknown") is None
