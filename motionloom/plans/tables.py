"""Queries over names, gesture records and training sets: text, joins, sampling, evaluation, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionloom.functions import strings as T
from motionloom.functions.keys import dataset_key, dataset_key_sql
from motionloom.operators import distance as D
from motionloom.operators import learning as L
from motionloom.operators import trees as B
from motionloom.operators.features import decimated, enhanced_features, network_features, sliding_windows
from motionloom.operators.spatial import POINTS
from motionloom.plans.adapters import FINGERS, FRAMES_TR_SQL, GESTURES_SQL, PREDICTIONS_SQL, TRAINING_SQL, frames_em, frames_tr, gestures, predictions, training_rows
from motionloom.plans.base import Registry
from motionloom.runtime import cut, spread, table

R = Registry()
G = "WITH " + GESTURES_SQL
TR = "WITH " + TRAINING_SQL


def _r(c, name, n=6):
    return F.round(c, n).alias(name)


@R.add("g1_standard_label", """SELECT ann_id, CASE WHEN label IS NULL OR lower(label) IN ('', 'no_gesture', 'nogesture', 'none') THEN 'NOGESTURE' ELSE replace(replace(upper(label), '_', ''), ' ', '') END AS name FROM annotations""")
def g1_standard_label(spark, d):
    return table(spark, d, "annotations").select("ann_id", T.standard_label(F.col("label")).alias("name"))


@R.add("g2_g4_marker_lines", r"""SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit, greatest(len(string_split(text, chr(10))) - 1, 0) AS n_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) AS n_pairs, trim(string_split(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))[1], ':')[1], ' ') AS first_key FROM documents WHERE text IS NOT NULL""")
def g2_g4_marker_lines(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    v = T.position_values(F.col("text"))
    return t.select("doc_id", T.has_digit(F.col("text")).alias("has_digit"), F.size(T.lines_but_last(F.col("text"))).alias("n_lines"), F.size(v).alias("n_pairs"), F.get(v, F.lit(0))["key"].alias("first_key"))


@R.add("g5_column_names", """SELECT axis || '_' || marker AS name, count(*) AS n FROM (VALUES ('X'), ('Y'), ('Z'), ('visibility')) a(axis), (SELECT DISTINCT label AS marker FROM training_frames) m GROUP BY 1""")
def g5_column_names(spark, d):
    axis = spark.createDataFrame([("X",), ("Y",), ("Z",), ("visibility",)], "axis string")
    marker = table(spark, d, "training_frames").select(F.col("label").alias("marker")).distinct()
    return axis.crossJoin(marker).groupBy(F.concat_ws("_", "axis", "marker").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@R.add("g6_video_of_gesture", f"{G} SELECT rec_id, string_split(gesture_id, '_')[1] AS video_id FROM gestures WHERE gesture_id IS NOT NULL")
def g6_video_of_gesture(spark, d):
    return gestures(spark, d).where("gesture_id is not null").select("rec_id", T.before_underscore(F.col("gesture_id")).alias("video_id"))


@R.add("g7_dataset_of_path", "SELECT video_id, CASE WHEN contains(path, '_') THEN string_split(path, '_')[1] ELSE 'unknown' END AS dataset FROM video_names")
def g7_dataset_of_path(spark, d):
    return table(spark, d, "video_names").select("video_id", T.dataset_of_path(F.col("path")).alias("dataset"))


@R.add("g8_labels_of_path", """WITH l AS (SELECT video_id, lower(path) AS p FROM video_names WHERE path IS NOT NULL)
  SELECT video_id, 'NoGesture' AS label FROM l WHERE contains(p, 'nogesture') UNION ALL SELECT video_id, 'Gesture' FROM l WHERE NOT contains(p, 'nogesture') AND NOT contains(p, 'move') AND NOT contains(p, 'objman') UNION ALL SELECT video_id, 'Move' FROM l WHERE contains(p, 'move')""")
def g8_labels_of_path(spark, d):
    return table(spark, d, "video_names").where("path is not null").select("video_id", F.explode(T.labels_of_path(F.col("path"))).alias("label"))


@R.add("g9_paths", r"SELECT video_id, regexp_replace(path, '\.[A-Za-z0-9]+$', '') AS stem, 'labeled_' || path AS labeled FROM video_names")
def g9_paths(spark, d):
    return table(spark, d, "video_names").select("video_id", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "").alias("stem"), F.concat(F.lit("labeled_"), "path").alias("labeled"))


@R.add("g10_title", """SELECT DISTINCT label, upper(substr(replace(lower(label), '_', ' '), 1, 1)) || substr(replace(lower(label), '_', ' '), 2) AS title FROM training_frames WHERE label IS NOT NULL""")
def g10_title(spark, d):
    return table(spark, d, "training_frames").where("label is not null").select("label", T.title(F.col("label")).alias("title")).distinct()


@R.add("g11_stamps", "SELECT video_id, strftime(recorded_at, '%Y%m%d_%H%M%S') AS stamp FROM video_names")
def g11_stamps(spark, d):
    return table(spark, d, "video_names").select("video_id", F.date_format("recorded_at", "yyyyMMdd_HHmmss").alias("stamp"))


@R.add("op_p26_integer_fps", "SELECT video_id, trunc(fps)::INT AS fps FROM video_names")
def p26_integer_fps(spark, d):
    return table(spark, d, "video_names").select("video_id", F.col("fps").cast("int").alias("fps"))


@R.add("f4_decimation", """WITH v AS (SELECT DISTINCT video_id, fps, n_frames FROM video_names WHERE fps IS NOT NULL AND n_frames > 0 AND video_id IS NOT NULL), f AS (SELECT video_id, greatest(1, round_even(fps / 25, 0)::BIGINT) AS step, unnest(range(0, n_frames)) AS i FROM v)
  SELECT video_id, count(*) AS kept FROM f WHERE i % step = 0 GROUP BY video_id""")
def f4_decimation(spark, d):
    v = table(spark, d, "video_names").where("fps is not null and n_frames > 0 and video_id is not null").select("video_id", "fps", "n_frames").distinct()
    f = spread(v).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)))
    return f.where(decimated(F.col("i"), F.col("fps"))).groupBy("video_id").agg(F.count(F.lit(1)).alias("kept"))


@R.add("f1_row_validity", "SELECT label, count(*) AS n FROM training_frames WHERE lm IS NOT NULL AND video_id IS NOT NULL GROUP BY label")
def f1_row_validity(spark, d):
    return table(spark, d, "training_frames").where("lm is not null and video_id is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.add("f16_bounds", "SELECT rec_id, hold_time < duration AND hold_count <= hand_submovements AS inside FROM kinematic_features WHERE hold_time IS NOT NULL AND duration IS NOT NULL")
def f16_bounds(spark, d):
    k = table(spark, d, "kinematic_features").where("hold_time is not null and duration is not null")
    return k.select("rec_id", ((F.col("hold_time") < F.col("duration")) & (F.col("hold_count") <= F.col("hand_submovements"))).alias("inside"))


@R.add("s6_detection_gate", f"{TR} SELECT video, count(*) AS frames, round(avg(CASE WHEN lm IS NOT NULL AND list_sum(list_transform(lm, lambda x: abs(x))) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM training_rows WHERE video IS NOT NULL GROUP BY video HAVING share >= 0.4")
def s6_detection_gate(spark, d):
    seen = F.when(F.exists("lm", lambda x: x != 0), 1.0).otherwise(0.0)
    return training_rows(spark, d).where("video is not null").groupBy("video").agg(F.count(F.lit(1)).alias("frames"), _r(F.avg(seen), "share")).where("share >= 0.4")


@R.add("s11_latest_session", "SELECT arg_max(video_id, (recorded_at, video_id)) AS video_id FROM video_names WHERE recorded_at IS NOT NULL")
def s11_latest_session(spark, d):
    return table(spark, d, "video_names").where("recorded_at is not null").agg(F.max_by("video_id", F.struct("recorded_at", "video_id")).alias("video_id"))


@R.add("op_p13_select_but_ids", f"{G} SELECT rec_id, volume, duration, hand_peak_speed FROM gestures")
def p13_select_but_ids(spark, d):
    g = gestures(spark, d).drop("gesture_id", "video_id", "video", "computed_at", "active_hand")
    return g.select("rec_id", "volume", "duration", "hand_peak_speed")


@R.add("op_p16_standard_scaler", f"{G}, s AS (SELECT avg(duration) AS m, CASE WHEN stddev_pop(duration) = 0 THEN 1 ELSE stddev_pop(duration) END AS v FROM gestures) SELECT rec_id, round((duration - m) / v, 6) AS duration FROM gestures, s")
def p16_standard_scaler(spark, d):
    return L.standardise(gestures(spark, d).select("rec_id", "duration"), ["duration"]).select("rec_id", _r(F.col("duration"), "duration"))


@R.add("op_p17_label_codes", "SELECT DISTINCT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM training_frames WHERE label IS NOT NULL")
def p17_label_codes(spark, d):
    return L.encode_labels(table(spark, d, "training_frames").select("label").where("label is not null"), "label").distinct().withColumn("code", F.col("code").cast("long"))


@R.add("op_p23_z_score", f"""WITH {FRAMES_TR_SQL}, e AS (SELECT label, video, frame_idx, unnest(lm) AS x FROM frames_tr), s AS (SELECT label, video, frame_idx, avg(x) AS m, stddev_pop(x) AS v FROM e GROUP BY ALL)
  SELECT f.label, f.video, f.frame_idx, round((f.lm[4] - m) / (v + 1e-8), 5) AS z FROM frames_tr f JOIN s USING (label, video, frame_idx)""")
def p23_z_score(spark, d):
    return frames_tr(spark, d).select("label", "video", "frame_idx", _r(F.get(L.z_scored(F.col("lm")), F.lit(3)), "z", 5))


@R.add("f10_cap_per_class", f"{TR}, r AS (SELECT label, seq_no, row_number() OVER (PARTITION BY label ORDER BY md5(label || ':' || seq_no), label, seq_no) AS k FROM training_rows WHERE label IS NOT NULL) SELECT label, seq_no FROM r WHERE k <= 50")
def f10_cap_per_class(spark, d):
    return L.cap_per_class(training_rows(spark, d).where("label is not null").select("label", "seq_no"), "label", ["label", "seq_no"], 50)


@R.add("m10_folds")
def m10_folds(spark, d):
    f = L.stratified_folds(training_rows(spark, d).where("label is not null").select("label", "seq_no"), "label", ["label", "seq_no"])
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@R.add("a19_window_counts", f"{TR} SELECT label, count(*) AS frames, greatest(0, count(*) - 4) AS windows_stride1, greatest(0, (floor((count(*) - 5) / 2.0) + 1)::BIGINT) AS windows_stride2 FROM training_rows GROUP BY label")
def a19_window_counts(spark, d):
    return L.window_counts(training_rows(spark, d), "label")


@R.add("a20_class_balance", f"""{TR}, c AS (SELECT label, count(*) AS n FROM training_rows GROUP BY label)
  SELECT min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size, round(max(n)::DOUBLE / min(n), 6) AS ratio, CASE WHEN max(n)::DOUBLE / min(n) > 5 THEN 'severe' WHEN max(n)::DOUBLE / min(n) > 2 THEN 'moderate' ELSE 'balanced' END AS advice,
  CASE WHEN min(n) < 500 THEN 'few' WHEN max(n) > 100000 THEN 'many' ELSE 'enough' END AS size_advice FROM c""")
def a20_class_balance(spark, d):
    b = L.class_balance(training_rows(spark, d), "label")
    return b.select("smallest", "largest", _r(F.col("mean_size"), "mean_size"), _r(F.col("ratio"), "ratio"), "advice", "size_advice")


@R.add("a21_label_shares", f"{TR} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM training_rows GROUP BY label")
def a21_label_shares(spark, d):
    s = L.label_shares(training_rows(spark, d), "label")
    return s.select("label", "n", _r(F.col("share"), "share"))


@R.add("a22_finger_detection", f"{TR} SELECT label, count(*) FILTER (len(list_filter(lm[52:69], lambda x: x <> 0)) > 0) AS with_fingers FROM training_rows GROUP BY label")
def a22_finger_detection(spark, d):
    found = F.exists(F.slice("lm", 52, 18), lambda x: x != 0)
    return training_rows(spark, d).groupBy("label").agg(F.count(F.when(found, 1)).alias("with_fingers"))


@R.add("a23_dataset_labels", f"{TR} SELECT dataset, label, count(*) AS n FROM training_rows GROUP BY dataset, label")
def a23_dataset_labels(spark, d):
    return training_rows(spark, d).groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


_PRED = f"WITH {PREDICTIONS_SQL}, t AS (SELECT ann_id % 5 AS fold, label, CASE WHEN gesture_confidence >= move_confidence AND gesture_confidence >= nogesture_confidence THEN 'Gesture' WHEN move_confidence >= nogesture_confidence THEN 'Move' ELSE 'NoGesture' END AS given FROM predictions)"


def _given(spark, d):
    c = F.col
    best = F.when((c("gesture_confidence") >= c("move_confidence")) & (c("gesture_confidence") >= c("nogesture_confidence")), "Gesture").when(c("move_confidence") >= c("nogesture_confidence"), "Move").otherwise("NoGesture")
    return predictions(spark, d).select((c("ann_id") % 5).alias("fold"), "label", best.alias("given"))


@R.add("a24_fold_accuracy", f"{_PRED} SELECT fold, round(avg(CASE WHEN label = given THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM t GROUP BY fold")
def a24_fold_accuracy(spark, d):
    return L.accuracy(_given(spark, d), "label", "given", "fold").select("fold", _r(F.col("accuracy"), "accuracy"))


@R.add("a28_confusion", f"{_PRED} SELECT label, count(*) FILTER (given = 'Gesture') AS Gesture, count(*) FILTER (given = 'Move') AS Move, count(*) FILTER (given = 'NoGesture') AS NoGesture FROM t GROUP BY label")
def a28_confusion(spark, d):
    return L.confusion(_given(spark, d), "label", "given", ["Gesture", "Move", "NoGesture"])


@R.add("a25_motion_accuracy", f"""WITH {PREDICTIONS_SQL} SELECT track_id, count(*) AS n, sum(CASE WHEN (CASE WHEN label = 'Move' THEN 1 ELSE 0 END) = (CASE WHEN has_motion >= 0.5 AND gesture_confidence >= 0.9 THEN 0 WHEN has_motion >= 0.5 AND move_confidence >= 0.9 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END)::BIGINT AS agree FROM predictions WHERE has_motion IS NOT NULL GROUP BY track_id""")
def a25_motion_accuracy(spark, d):
    p = predictions(spark, d).where("has_motion is not null")
    on = lambda x: F.when(F.col("label") == x, 1.0).otherwise(0.0)
    ok = L.motion_accuracy((F.when(F.col("label") != "NoGesture", 1.0).otherwise(0.0), on("Gesture"), on("Move")), (F.col("has_motion"), F.col("gesture_confidence"), F.col("move_confidence")))
    return p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("agree"))


@R.add("a26_motion_loss", f"""WITH {PREDICTIONS_SQL}, q AS (SELECT *, least(greatest(has_motion, 1e-7), 1 - 1e-7) AS pm, (label <> 'NoGesture')::INT AS y, (label = 'Gesture')::INT * 0.95::DOUBLE + 0.025 AS yg, (label = 'Move')::INT * 0.95::DOUBLE + 0.025 AS ym, gesture_confidence + move_confidence AS s FROM predictions WHERE has_motion IS NOT NULL AND gesture_confidence + move_confidence > 0)
  SELECT track_id, round(avg(0.5 * (-(y * ln(pm) + (1 - y) * ln(1 - pm)) - y * (yg * ln(least(greatest(gesture_confidence / s, 1e-7), 1 - 1e-7)) + ym * ln(least(greatest(move_confidence / s, 1e-7), 1 - 1e-7))))), 5) AS loss FROM q GROUP BY track_id""")
def a26_motion_loss(spark, d):
    p = predictions(spark, d).where("has_motion is not null and gesture_confidence + move_confidence > 0")
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    loss = L.motion_loss(on(F.col("label") != "NoGesture"), on(F.col("label") == "Gesture"), on(F.col("label") == "Move"), F.col("has_motion"), F.col("gesture_confidence"), F.col("move_confidence"))
    return p.groupBy("track_id").agg(_r(F.avg(loss), "loss", 5))


@R.add("a27_distribution", f"{G} SELECT active_hand, count(duration) AS n, min(duration) AS lo, max(duration) AS hi, round(quantile_cont(duration, 0.25), 6) AS q1, round(quantile_cont(duration, 0.5), 6) AS q2, round(quantile_cont(duration, 0.75), 6) AS q3 FROM gestures GROUP BY active_hand")
def a27_distribution(spark, d):
    g = gestures(spark, d).select("active_hand", "duration")
    ends = g.groupBy("active_hand").agg(F.count("duration").alias("n"), F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    q = L.group_quantiles(g, ["active_hand"], "duration", (0.25, 0.5, 0.75)).withColumnRenamed("active_hand", "h")
    rows = ends.join(q, F.col("active_hand").eqNullSafe(F.col("h")), "left")
    return rows.select("active_hand", "n", "lo", "hi", *[_r(F.col("q")[k], f"q{k + 1}") for k in range(3)])


@R.add("m9_tiers", f"{TR} SELECT label, CASE WHEN count(*) >= 100000 THEN 255 WHEN count(*) >= 20000 THEN 127 WHEN count(*) >= 5000 THEN 63 ELSE 31 END AS leaves FROM training_rows GROUP BY label")
def m9_tiers(spark, d):
    return training_rows(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", L.leaves_for(F.col("n")).alias("leaves"))


@R.add("j6_gesture_lookup", f"{G} SELECT g.rec_id, g.video, v.fps, v.n_frames FROM gestures g JOIN (SELECT DISTINCT video_id, fps, n_frames FROM video_names) v ON g.video = v.video_id")
def j6_gesture_lookup(spark, d):
    v = table(spark, d, "video_names").select(F.col("video_id").alias("video"), "fps", "n_frames").distinct()
    return gestures(spark, d).join(v, "video").select("rec_id", "video", "fps", "n_frames")


@R.add("j11_dataset_tags", f"WITH f AS (SELECT video_id, {dataset_key_sql(chr(34) + 'part' + chr(34))} AS dataset FROM (SELECT video_id, string_split(path, '_')[1] AS part FROM video_names WHERE path IS NOT NULL)) SELECT * FROM f WHERE dataset IS NOT NULL")
def j11_dataset_tags(spark, d):
    v = table(spark, d, "video_names").where("path is not null")
    return v.select("video_id", dataset_key(T.before_underscore(F.col("path"))).alias("dataset")).where("dataset is not null")


@R.add("j5_positional", "WITH a AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY seq_no) AS k, seq_no FROM (SELECT DISTINCT label, seq_no FROM training_frames)), b AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY seq_no DESC) AS k, seq_no AS from_end FROM a) SELECT a.label, a.k, a.seq_no, b.from_end FROM a JOIN b ON a.label = b.label AND a.k = b.k")
def j5_positional(spark, d):
    from motionloom.operators.sliced import cut_by, running_sum

    rows = table(spark, d, "training_frames").select("label", "seq_no").distinct().where("label is not null and seq_no is not null")
    a = running_sum(cut_by(rows, "seq_no", 65536), ["label"], ["seq_no"], F.lit(1), "k").select("label", "k", "seq_no")
    back = rows.withColumn("order", -F.col("seq_no"))
    b = running_sum(cut_by(back, "order", 65536), ["label"], ["order"], F.lit(1), "k").select("label", "k", F.col("seq_no").alias("from_end"))
    return a.join(b, ["label", "k"])


@R.add("u3_union_min", f"{G}, p AS (SELECT video, hand_peak_speed AS v FROM gestures UNION ALL SELECT video, elbow_peak_speed FROM gestures) SELECT video, min(v) AS lowest FROM p GROUP BY video")
def u3_union_min(spark, d):
    g = gestures(spark, d)
    p = g.select("video", F.col("hand_peak_speed").alias("v")).unionAll(g.select("video", F.col("elbow_peak_speed").alias("v")))
    return p.groupBy("video").agg(F.min("v").alias("lowest"))


@R.add("u5_append", f"{TR} SELECT label, kind, count(*) AS n FROM (SELECT label, 'plain' AS kind FROM training_rows UNION ALL SELECT label, 'again' FROM training_rows) GROUP BY label, kind")
def u5_append(spark, d):
    t = training_rows(spark, d).select("label", "seq_no")
    both = t.withColumn("kind", F.lit("plain")).unionByName(t.withColumn("kind", F.lit("again")))
    return both.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


def _series(spark, d):
    arms = [f"{j}_{a}" for j in POINTS[:6] for a in "xyz"]
    fingers = [f"{j}_{a}" for j in FINGERS for a in "xyz"]
    return D.gesture_series(frames_em(spark, d), "track", arms, centred=fingers)


@R.add("m1_warping_distances")
def m1_warping_distances(spark, d):
    return D.pairwise_distances(_series(spark, d))


@R.add("j3_pairs", "WITH g AS (SELECT DISTINCT label AS g FROM embeddings) SELECT a.g AS gesture_i, b.g AS gesture_j FROM g a, g b")
def j3_pairs(spark, d):
    return D.pairwise_distances(_series(spark, d)).select("gesture_i", "gesture_j")


@R.add("m3_nearest")
def m3_nearest(spark, d):
    return D.nearest(D.pairwise_distances(_series(spark, d)), 5)


@R.add("m3_map")
def m3_map(spark, d):
    return D.planar_map(D.pairwise_distances(_series(spark, d)))


@R.add("m4_m6_network_scores")
def m4_m6_network_scores(spark, d):
    f = frames_tr(spark, d).withColumn("v", network_features(F.col("lm")))
    w = sliding_windows(f, ["label", "video"], "frame_idx", "v", 25)
    return L.score_windows(w, "window", L.synthetic_network(29)).drop("window")


def _u(seed, *parts):
    """SQL for ``learning.uniform``."""
    return "(('0x' || substr(md5(" + " || ':' || ".join([*parts, f"'{seed}'"]) + "), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def _n(seed, *parts):
    return f"(sqrt(-2 * ln(1 - {_u(seed, *parts)})) * cos(2 * pi() * {_u(seed + 1, *parts)}))"


_K = ("label", "video", "start")
_WINDOWS = f"""{FRAMES_TR_SQL}, w AS (SELECT label, video, frame_idx AS start, list(lm) OVER (PARTITION BY label, video ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM frames_tr),
  windows AS (SELECT label, video, start, x, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', label, video, start)), label, video, start) AS k, count(*) OVER (PARTITION BY label) AS n FROM w WHERE len(x) = 5),
  chosen AS (SELECT * FROM windows WHERE k <= least(n // 3, 5000))"""


@R.add("f11_m8_augmented", f"""WITH {_WINDOWS}, c AS (
  SELECT label, video, start, 'noise' AS kind, [[x[i][j] + 0.008::DOUBLE * {_n(42, *_K, '(i - 1)', '(j - 1)')} for j in range(1, 70)] for i in range(1, 6)] AS x FROM chosen UNION ALL
  SELECT label, video, start, 'scale', [[v * (0.97::DOUBLE + 0.06::DOUBLE * {_u(44, *_K)}) for v in f] for f in x] FROM chosen UNION ALL
  SELECT label, video, start, 'jitter', CASE t WHEN 0 THEN [y[1], y[1], y[2], y[3], y[4]] WHEN 1 THEN [y[1], y[2], y[2], y[3], y[4]] WHEN 2 THEN [y[1], y[2], y[3], y[3], y[4]] ELSE [y[1], y[2], y[3], y[4], y[4]] END
    FROM (SELECT *, floor({_u(46, *_K)} * 4)::INT AS t, x[:d] || x[d + 2:] AS y FROM (SELECT *, floor({_u(45, *_K)} * 3)::INT + 1 AS d FROM chosen)))
  SELECT label, video, start, kind, round(x[2][3], 6) AS early, round(x[4][60], 6) AS late, round(list_sum(flatten(x)), 5) AS total FROM c""")
def f11_m8_augmented(spark, d):
    w = sliding_windows(frames_tr(spark, d), ["label", "video"], "frame_idx", "lm", 5)
    some = L.chosen_for_augmentation(w.select("label", "video", "start", "window"), "label", list(_K))
    a = L.augmented_windows(some, "window", list(_K))
    value = lambda i, j: F.get(F.get("window", F.lit(i)), F.lit(j))
    total = F.aggregate(F.flatten("window"), F.lit(0.0), lambda s, x: s + x)
    return a.select("label", "video", "start", "kind", _r(value(1, 2), "early"), _r(value(3, 59), "late"), _r(total, "total", 5))


_SHUT = "(i - 1 >= hid AND i - 1 < hid + 1)"


@R.add("m7_disturbed", f"""WITH {FRAMES_TR_SQL}, w AS (SELECT label, video, frame_idx AS start, list(lm) OVER (PARTITION BY label, video ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS x FROM frames_tr),
  p AS (SELECT *, floor({_u(48, *_K)} * 24)::INT AS hid, 0.98::DOUBLE + 0.04::DOUBLE * {_u(49, *_K)} AS factor FROM w WHERE len(x) = 25),
  c AS (SELECT label, video, start, [[CASE WHEN {_SHUT} THEN 0 ELSE ((CASE WHEN {_u(46, *_K, '(i - 1)')} <= 0.03 THEN 0 ELSE x[i][j] + 0.005::DOUBLE * {_n(42, *_K, '(i - 1)', '(j - 1)')} END) + 0.01::DOUBLE * {_n(44, *_K, '(i - 1)', '(j - 1)')}) * factor END for j in range(1, 70)] for i in range(1, 26)] AS x FROM p)
  SELECT label, video, start, len(list_filter(x, lambda f: list_max(f) = 0 AND list_min(f) = 0)) AS masked, round(x[3][5], 6) AS early, round(list_sum(flatten(x)), 5) AS total FROM c""")
def m7_disturbed(spark, d):
    w = sliding_windows(frames_tr(spark, d), ["label", "video"], "frame_idx", "lm", 25).select("label", "video", "start", "window")
    a = L.disturbed_windows(w, "window", list(_K))
    masked = F.size(F.filter("window", lambda f: F.forall(f, lambda x: x == 0)))
    total = F.aggregate(F.flatten("window"), F.lit(0.0), lambda s, x: s + x)
    return a.select("label", "video", "start", masked.alias("masked"), _r(F.get(F.get("window", F.lit(2)), F.lit(4)), "early"), _r(total, "total", 5))


@R.add("f12_balanced_starts", f"""{TR}, c AS (SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS m FROM (SELECT label, count(*) AS n FROM training_rows WHERE label IS NOT NULL GROUP BY label HAVING count(*) > 25)), r AS (SELECT unnest(range(2000)) AS draw)
  SELECT draw, label, floor({_u(43, 'draw')} * (n - 25))::BIGINT AS start FROM r JOIN c ON floor({_u(42, 'draw')} * m) = k""")
def f12_balanced_starts(spark, d):
    return L.balanced_starts(training_rows(spark, d), "label", 2000, 25)


@R.add("m10_train_and_test", f"""{TR}, r AS (SELECT label, seq_no, row_number() OVER (PARTITION BY label ORDER BY md5(label || ':' || seq_no), label, seq_no) AS k, count(*) OVER (PARTITION BY label) AS n FROM training_rows WHERE label IS NOT NULL)
  SELECT label, seq_no, (k > round(n * 0.15::DOUBLE))::INT AS fold FROM r""")
def m10_train_and_test(spark, d):
    return L.train_and_test(training_rows(spark, d).where("label is not null").select("label", "seq_no"), "label", ["label", "seq_no"])


@R.add("a24_cross_validation", f"{_PRED} SELECT round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS deviation, count(*) AS folds FROM (SELECT avg(CASE WHEN label = given THEN 1.0::DOUBLE ELSE 0 END) AS a FROM t GROUP BY fold)")
def a24_cross_validation(spark, d):
    c = L.cross_validation(_given(spark, d), "label", "given", "fold")
    return c.select(_r(F.col("mean_accuracy"), "mean_accuracy"), _r(F.col("deviation"), "deviation"), "folds")


@R.add("m6_m9_tree_scores")
def m6_m9_tree_scores(spark, d):
    """Trees fitted on the training part, 30 rounds; accuracy per part over all its rows."""
    e = enhanced_features(frames_tr(spark, d), ["label", "video"], "frame_idx").select("label", "video", "frame_idx", "features")
    e = cut(L.train_and_test(e, "label", ["label", "video", "frame_idx"]))
    model = B.fit_trees(e.where("fold = 1"), "features", "label", ["label", "video", "frame_idx"], rounds=30)
    scored = B.score_rows(e, "features", model).withColumn("given", B.best_label(F.col("p"), model.labels))
    return L.accuracy(scored, "label", "given", "fold").select("fold", _r(F.col("accuracy"), "accuracy"))
