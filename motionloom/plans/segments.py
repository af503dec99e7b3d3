"""Labelling, segmentation, export and session queries, over the annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionloom.operators import segments as S
from motionloom.operators.sliced import cut_by, running_sum, with_neighbours
from motionloom.plans.adapters import PREDICTIONS_SQL, predictions
from motionloom.plans.base import Registry
from motionloom.runtime import spread, table
from motionloom.sources.tables import annotation_lines

R = Registry()
P = "WITH " + PREDICTIONS_SQL


def _segments_sql(gap: float, length: float) -> str:
    return f"""{PREDICTIONS_SQL}, a AS (
  SELECT track_id, time, ann_id, label, label <> 'NoGesture' AS g, coalesce(lag(label <> 'NoGesture') OVER w, FALSE) AS pg, lead(time) OVER w AS nt
  FROM predictions WINDOW w AS (PARTITION BY track_id ORDER BY time, ann_id)
), b AS (SELECT *, sum(CASE WHEN g AND NOT pg THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY time, ann_id) AS run FROM a),
c AS (SELECT track_id, run, min(time) AS s, arg_max(coalesce(nt, time), (time, ann_id)) AS e,
        CASE WHEN count(*) FILTER (label = 'Gesture') >= count(*) FILTER (label = 'Move') THEN 'Gesture' ELSE 'Move' END AS label
      FROM b WHERE g GROUP BY track_id, run),
d AS (SELECT *, CASE WHEN s - lag(e) OVER w <= {gap}::DOUBLE AND label = lag(label) OVER w THEN 0 ELSE 1 END AS brk FROM c WINDOW w AS (PARTITION BY track_id ORDER BY s, run)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY s, run) AS isl FROM d),
m AS (SELECT track_id, isl, min(s) AS start_time, max(e) AS end_time, min(label) AS label FROM i GROUP BY track_id, isl),
segments AS (SELECT track_id, start_time, end_time, row_number() OVER (PARTITION BY track_id ORDER BY start_time) AS labelid, label, end_time - start_time AS duration
      FROM m WHERE end_time - start_time >= {length}::DOUBLE),
sm AS (SELECT track_id, s, e, row_number() OVER (PARTITION BY track_id ORDER BY s) AS labelid FROM c WHERE e - s >= {length}::DOUBLE),
sd AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY track_id ORDER BY s) <= {gap}::DOUBLE THEN 0 ELSE 1 END AS brk FROM sm),
si AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY s) AS isl FROM sd),
session_segments AS (SELECT track_id, min(s) AS start_time, max(e) AS end_time, min(labelid) AS labelid, 'Gesture' AS label, max(e) - min(s) AS duration FROM si GROUP BY track_id, isl)"""


SEGMENTS_SQL = "WITH " + _segments_sql(0.3, 0.5)
_COLS = "track_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, labelid, label, round(duration, 6) AS duration"


def _rounded(df):
    return df.select("track_id", *[F.round(c, 6).alias(c) for c in ("start_time", "end_time")], F.col("labelid").cast("long").alias("labelid"), "label", F.round("duration", 6).alias("duration"))


@R.add("a1_segments", f"{SEGMENTS_SQL} SELECT {_COLS} FROM segments")
def a1_segments(spark, d):
    return _rounded(S.create_segments(predictions(spark, d, once=False)))


@R.add("a1_segments_fine", f"WITH {_segments_sql(0.04, 0.12)} SELECT {_COLS} FROM segments")
def a1_segments_fine(spark, d):
    return _rounded(S.create_segments(predictions(spark, d, once=False), min_gap_s=0.04, min_length_s=0.12))


@R.add("a2_session_segments", f"{SEGMENTS_SQL} SELECT {_COLS} FROM session_segments")
def a2_session_segments(spark, d):
    return _rounded(S.create_session_segments(predictions(spark, d, once=False)))


@R.add("f2_threshold_label", f"{P} SELECT ann_id, label FROM predictions")
def f2_threshold_label(spark, d):
    return predictions(spark, d).select("ann_id", "label")


@R.add("a3_track_statistics", f"{P} SELECT track_id, round(avg(has_motion), 6) AS average_motion, round(avg(gesture_confidence), 6) AS average_gesture, round(avg(move_confidence), 6) AS average_move FROM predictions GROUP BY track_id")
def a3_track_statistics(spark, d):
    s = S.track_statistics(predictions(spark, d))
    return s.select("track_id", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@R.add("a5_mode", f"{P}, c AS (SELECT track_id, label, count(*) AS n FROM predictions GROUP BY track_id, label) SELECT track_id, arg_min(label, (-n, label)) AS mode FROM c GROUP BY track_id")
def a5_mode(spark, d):
    counts = predictions(spark, d).groupBy("track_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("track_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("mode"))


@R.add("op_p19_bias_shift", f"""{P} SELECT ann_id, round(gesture_confidence + b, 9) AS gesture, round(move_confidence - b, 9) AS move FROM (
  SELECT *, CASE WHEN has_motion > 0 AND gesture_confidence + move_confidence > 0 THEN move_confidence * (0.4::DOUBLE * 0.5) ELSE 0 END AS b FROM predictions)""")
def p19_bias_shift(spark, d):
    g, m = S.bias_shift(F.col("has_motion"), F.col("gesture_confidence"), F.col("move_confidence"), 0.4)
    return predictions(spark, d).select("ann_id", F.round(g, 9).alias("gesture"), F.round(m, 9).alias("move"))


_ARGMAX = """CASE WHEN nogesture_confidence >= gesture_confidence AND nogesture_confidence >= move_confidence THEN 0 WHEN gesture_confidence >= move_confidence THEN 1 ELSE 2 END"""


@R.add("op_p18_argmax", f"{P} SELECT ann_id, {_ARGMAX} AS best, greatest(nogesture_confidence, gesture_confidence, move_confidence) AS confidence FROM predictions WHERE nogesture_confidence IS NOT NULL AND gesture_confidence IS NOT NULL AND move_confidence IS NOT NULL")
def p18_argmax(spark, d):
    conf = F.array("nogesture_confidence", "gesture_confidence", "move_confidence")
    rows = predictions(spark, d).dropna(subset=["nogesture_confidence", "gesture_confidence", "move_confidence"])
    return rows.select("ann_id", (F.array_position(conf, F.array_max(conf)) - 1).cast("int").alias("best"), F.array_max(conf).alias("confidence"))


@R.add("op_p20_class_confidences", f"""WITH {PREDICTIONS_SQL}, n AS (SELECT ann_id, CASE {_ARGMAX} WHEN 0 THEN 'NOGESTURE' WHEN 1 THEN 'GESTURE' ELSE 'MOVE' END AS name, greatest(nogesture_confidence, gesture_confidence, move_confidence) AS c FROM predictions)
  SELECT ann_id, CASE name WHEN 'NOGESTURE' THEN 1 - c WHEN 'MOVE' THEN 0 ELSE c END AS has_motion, CASE name WHEN 'NOGESTURE' THEN c ELSE 1 - c END AS nogesture,
  CASE name WHEN 'NOGESTURE' THEN 1 - c WHEN 'MOVE' THEN 0 ELSE c END AS gesture, CASE name WHEN 'MOVE' THEN c ELSE 0 END AS move FROM n""")
def p20_class_confidences(spark, d):
    conf = F.array("nogesture_confidence", "gesture_confidence", "move_confidence")
    name = F.element_at(F.array(F.lit("NOGESTURE"), F.lit("GESTURE"), F.lit("MOVE")), F.array_position(conf, F.array_max(conf)).cast("int"))
    out = S.class_confidences(name, F.array_max(conf))
    return predictions(spark, d).select("ann_id", *[c.cast("double").alias(k.removesuffix("_confidence").lower()) for k, c in out.items()])


@R.add("f3_realtime_threshold", f"""{P} SELECT ann_id, CASE WHEN label <> 'NoGesture' AND c < 0.8::DOUBLE THEN 'NoGesture' ELSE label END AS gesture, CASE WHEN label <> 'NoGesture' AND c < 0.8::DOUBLE THEN 0 ELSE c END AS confidence
  FROM (SELECT *, greatest(nogesture_confidence, gesture_confidence, move_confidence) AS c FROM predictions)""")
def f3_realtime_threshold(spark, d):
    rows = predictions(spark, d).withColumn("c", F.greatest("nogesture_confidence", "gesture_confidence", "move_confidence"))
    name, conf = S.realtime_label(F.col("label"), F.col("c"), 0.8)
    return rows.select("ann_id", name.alias("gesture"), conf.alias("confidence"))


@R.add("f5_stride", f"{P} SELECT track_id, count(*) AS n, count(DISTINCT label) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY time, ann_id) - 1 AS i FROM predictions) WHERE i % 3 = 0 GROUP BY track_id")
def f5_stride(spark, d):
    rows = running_sum(cut_by(predictions(spark, d), "time", 512.0), ["track_id"], ["time", "ann_id"], F.lit(1), "i")
    return rows.where((F.col("i") - 1) % 3 == 0).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))


@R.add("w4_change_points", f"""{P} SELECT ann_id, CASE WHEN g AND NOT pg THEN 1 ELSE -1 END AS change FROM (
  SELECT ann_id, label <> 'NoGesture' AS g, coalesce(lag(label <> 'NoGesture') OVER (PARTITION BY track_id ORDER BY time, ann_id), FALSE) AS pg FROM predictions) WHERE g <> pg""")
def w4_change_points(spark, d):
    rows = cut_by(predictions(spark, d), "time", 512.0).withColumn("g", F.col("label") != "NoGesture")
    rows = with_neighbours(rows, ["track_id"], ["time", "ann_id"], {"pg": F.col("g")}).withColumn("pg", F.coalesce("pg", F.lit(False)))
    return rows.where("g <> pg").select("ann_id", F.when(F.col("g"), 1).otherwise(-1).alias("change"))


@R.add("f13_interval_mask", f"{P} SELECT ann_id, time >= 10.0 AND time <= 20.5 AS inside FROM predictions")
def f13_interval_mask(spark, d):
    return predictions(spark, d).select("ann_id", F.col("time").between(10.0, 20.5).alias("inside"))


@R.add("f15_not_in", f"{P} SELECT track_id, count(*) AS n FROM predictions WHERE label NOT IN ('NoGesture', 'NOGESTURE') GROUP BY track_id")
def f15_not_in(spark, d):
    return predictions(spark, d).where(~F.col("label").isin("NoGesture", "NOGESTURE")).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("op_p21_centre_time", f"{P} SELECT ann_id, time + 0.5::DOUBLE AS centre FROM predictions")
def p21_centre_time(spark, d):
    return predictions(spark, d).select("ann_id", (F.col("time") + (25 / 2) / 25).alias("centre"))


@R.add("op_p14_clamp", f"{P} SELECT ann_id, greatest(0.1::DOUBLE, least(time / 100, 2.0::DOUBLE)) AS gap FROM predictions")
def p14_clamp(spark, d):
    return predictions(spark, d).select("ann_id", F.greatest(F.lit(0.1), F.least(F.col("time") / 100, F.lit(2.0))).alias("gap"))


@R.add("op_p15_quantise", f"{P} SELECT ann_id, trunc(gesture_confidence * 480)::INT AS y FROM predictions")
def p15_quantise(spark, d):
    return predictions(spark, d).select("ann_id", (F.col("gesture_confidence") * 480).cast("int").alias("y"))


@R.add("op_p22_one_hot", f"{P} SELECT ann_id, (label <> 'NoGesture')::INT AS has_motion, (label = 'Gesture')::INT AS gesture, (label = 'Move')::INT AS move FROM predictions")
def p22_one_hot(spark, d):
    return predictions(spark, d).select("ann_id", *[c.cast("int").alias(n) for n, c in (("has_motion", F.col("label") != "NoGesture"), ("gesture", F.col("label") == "Gesture"), ("move", F.col("label") == "Move"))])


@R.add("op_p27_lookup", f"{P} SELECT ann_id, CASE label WHEN 'Gesture' THEN 'green' WHEN 'Move' THEN 'blue' ELSE 'white' END AS colour FROM predictions")
def p27_lookup(spark, d):
    colours = F.create_map(F.lit("Gesture"), F.lit("green"), F.lit("Move"), F.lit("blue"))
    return predictions(spark, d).select("ann_id", F.coalesce(F.element_at(colours, F.col("label")), F.lit("white")).alias("colour"))


@R.add("j1_label_at_time", f"""{SEGMENTS_SQL} SELECT p.ann_id, coalesce(arg_min(s.label, s.labelid), 'NoGesture') AS segment_label
  FROM predictions p LEFT JOIN segments s ON p.track_id = s.track_id AND p.time BETWEEN s.start_time AND s.end_time GROUP BY p.ann_id""")
def j1_label_at_time(spark, d):
    p = predictions(spark, d, once=False)
    return S.label_at_time(p.select("ann_id", "track_id", "time"), S.create_segments(p)).select("ann_id", "segment_label")


@R.add("j2_segment_rows", f"""WITH {_segments_sql(0.3, 0.5)}, f AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY time, ann_id) - 1 AS frame_idx, gesture_confidence FROM predictions)
  SELECT s.track_id, s.labelid, count(*) AS n, round(sum(gesture_confidence), 6) AS total FROM segments s JOIN f ON s.track_id = f.track_id AND f.frame_idx >= trunc(s.start_time * 25)::BIGINT AND f.frame_idx < trunc(s.end_time * 25)::BIGINT GROUP BY s.track_id, s.labelid""")
def j2_segment_rows(spark, d):
    p = predictions(spark, d)
    f = running_sum(cut_by(p, "time", 512.0), ["track_id"], ["time", "ann_id"], F.lit(1), "i").select("track_id", (F.col("i") - 1).alias("frame_idx"), "gesture_confidence")
    rows = S.segment_rows(S.create_segments(p), f, 25.0)
    return rows.groupBy("track_id", "labelid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gesture_confidence"), 6).alias("total"))


@R.add("k4_slots", f"""{SEGMENTS_SQL} SELECT track_id, 'ts' || (2 * labelid - 1)::BIGINT AS slot_id, trunc(start_time * 1000)::BIGINT AS ms FROM segments
  UNION ALL SELECT track_id, 'ts' || (2 * labelid)::BIGINT, trunc(end_time * 1000)::BIGINT FROM segments""")
def k4_slots(spark, d):
    return S.annotation_slots(S.create_segments(predictions(spark, d, once=False))).select("track_id", "slot_id", "ms")


@R.add("j8_annotation_refs", f"""WITH {_segments_sql(0.3, 0.5)}, t AS (SELECT track_id, (2 * labelid - 1)::BIGINT AS slot, trunc(start_time * 1000)::BIGINT AS ms FROM segments UNION ALL SELECT track_id, (2 * labelid)::BIGINT, trunc(end_time * 1000)::BIGINT FROM segments),
  last AS (SELECT track_id, ms, max(slot) AS slot FROM t GROUP BY track_id, ms)
  SELECT s.track_id, 'a' || s.labelid AS annotation_id, 'ts' || x.slot AS slot_ref1, 'ts' || y.slot AS slot_ref2, s.label FROM segments s
  JOIN last x ON x.track_id = s.track_id AND x.ms = trunc(s.start_time * 1000)::BIGINT JOIN last y ON y.track_id = s.track_id AND y.ms = trunc(s.end_time * 1000)::BIGINT""")
def j8_annotation_refs(spark, d):
    return S.annotation_refs(S.create_segments(predictions(spark, d, once=False)))


_FIXED = [
    (0, 0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, 1, '<ANNOTATION_DOCUMENT AUTHOR="motionloom" FORMAT="3.0" VERSION="3.0">'), (0, 2, '  <HEADER TIME_UNITS="milliseconds"/>'), (0, 3, "  <TIME_ORDER>"),
    (2, 0, "  </TIME_ORDER>"), (2, 1, '  <TIER LINGUISTIC_TYPE_REF="default" TIER_ID="PREDICTED">'),
    (4, 0, "  </TIER>"), (4, 1, '  <LINGUISTIC_TYPE LINGUISTIC_TYPE_ID="default" TIME_ALIGNABLE="true"/>'), (4, 2, "</ANNOTATION_DOCUMENT>"),
]


@R.add("k4_annotation_files", f"""WITH {_segments_sql(0.3, 0.5)}, t AS (SELECT track_id, (2 * labelid - 1)::BIGINT AS slot, trunc(start_time * 1000)::BIGINT AS ms FROM segments UNION ALL SELECT track_id, (2 * labelid)::BIGINT, trunc(end_time * 1000)::BIGINT FROM segments),
  last AS (SELECT track_id, ms, max(slot) AS slot FROM t GROUP BY track_id, ms), fixed(section, n, line) AS (VALUES {', '.join(f"({s}, {n}, '{line}')" for s, n, line in _FIXED)})
  SELECT track_id, section, n::BIGINT AS n, line FROM fixed, (SELECT DISTINCT track_id FROM segments) UNION ALL
  SELECT track_id, 1, slot, '    <TIME_SLOT TIME_SLOT_ID="ts' || slot || '" TIME_VALUE="' || ms || '"/>' FROM t UNION ALL
  SELECT s.track_id, 3, s.labelid::BIGINT, '    <ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a' || s.labelid || '" TIME_SLOT_REF1="ts' || x.slot || '" TIME_SLOT_REF2="ts' || y.slot || '"><ANNOTATION_VALUE>' || s.label || '</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>'
  FROM segments s JOIN last x ON x.track_id = s.track_id AND x.ms = trunc(s.start_time * 1000)::BIGINT JOIN last y ON y.track_id = s.track_id AND y.ms = trunc(s.end_time * 1000)::BIGINT""")
def k4_annotation_files(spark, d):
    return annotation_lines(S.create_segments(predictions(spark, d, once=False)))


@R.add("w10_display_window", f"""{P}, b AS (SELECT *, min(time) OVER (PARTITION BY track_id) AS lo, max(time) OVER (PARTITION BY track_id) AS hi FROM predictions),
  v AS (SELECT ann_id, time, CASE WHEN time < lo + 2 THEN lo WHEN time > hi - 2 THEN greatest(lo, hi - 10) ELSE greatest(lo, time - 8) END AS s,
               CASE WHEN time < lo + 2 THEN least(hi, lo + 10) WHEN time > hi - 2 THEN hi ELSE least(hi, greatest(lo, time - 8) + 10) END AS e FROM b)
  SELECT ann_id, round(CASE WHEN e <= s THEN greatest(0, time - 5) ELSE s END, 6) AS window_start, round(CASE WHEN e <= s THEN greatest(0, time - 5) + 10 ELSE e END, 6) AS window_end FROM v""")
def w10_display_window(spark, d):
    p = predictions(spark, d)
    bounds = p.groupBy("track_id").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    begin, end = S.display_window(F.col("time"), F.col("lo"), F.col("hi"))
    return p.join(bounds, "track_id").select("ann_id", F.round(begin, 6).alias("window_start"), F.round(end, 6).alias("window_end"))


@R.add("a4_session_summary", f"""WITH {_segments_sql(0.3, 0.5)}, f AS (SELECT track_id, count(*) AS total_frames, max(time) AS d, count(*) FILTER (label NOT IN ('NoGesture', 'NOGESTURE')) AS gf FROM predictions GROUP BY track_id),
  s AS (SELECT track_id, count(*) AS n, sum(duration) AS t FROM session_segments GROUP BY track_id)
  SELECT f.track_id, total_frames, gf AS raw_gesture_frames, coalesce(n, 0) AS processed_segments, round(CASE WHEN d > 0 THEN total_frames / d ELSE 0 END, 6) AS average_fps, round(gf * 100.0::DOUBLE / total_frames, 6) AS raw_gesture_percentage,
  round(coalesce(t, 0), 6) AS total_gesture_time, round(CASE WHEN n > 0 THEN t / n ELSE 0 END, 6) AS average_segment_duration, round(CASE WHEN d > 0 THEN coalesce(n, 0) / (d / 60) ELSE 0 END, 6) AS gestures_per_minute FROM f LEFT JOIN s USING (track_id)""")
def a4_session_summary(spark, d):
    p = predictions(spark, d)
    raw = p.select("track_id", F.col("time").alias("timestamp"), F.col("time").alias("wall_clock_time"), F.col("label").alias("gesture"))
    s = S.session_summary(raw, S.create_session_segments(p))
    return s.select("track_id", "total_frames", "raw_gesture_frames", "processed_segments", *[F.round(c, 6).alias(c) for c in ("average_fps", "raw_gesture_percentage", "total_gesture_time", "average_segment_duration", "gestures_per_minute")])


@R.add("j10_detailed_summary", f"""WITH {_segments_sql(0.3, 0.5)}, n AS (SELECT track_id, count(*) AS total_frames FROM predictions GROUP BY track_id)
  SELECT track_id, total_frames, labelid, round(start_time, 6) AS start_time FROM n JOIN session_segments USING (track_id)""")
def j10_detailed_summary(spark, d):
    p = predictions(spark, d)
    n = p.groupBy("track_id").agg(F.count(F.lit(1)).alias("total_frames"))
    return n.join(S.create_session_segments(p), "track_id").select("track_id", "total_frames", F.col("labelid").cast("long").alias("labelid"), F.round("start_time", 6).alias("start_time"))


@R.add("w18_row_numbers", f"{P} SELECT ann_id, row_number() OVER (PARTITION BY track_id ORDER BY time, ann_id) AS n FROM predictions")
def w18_row_numbers(spark, d):
    rows = running_sum(cut_by(predictions(spark, d), "time", 512.0), ["track_id"], ["time", "ann_id"], F.lit(1), "n")
    return rows.select("ann_id", "n")


@R.add("f7_head_f8_tail", f"""{P}, r AS (SELECT ann_id, row_number() OVER (PARTITION BY track_id ORDER BY time, ann_id) AS a, row_number() OVER (PARTITION BY track_id ORDER BY time DESC, ann_id DESC) AS z FROM predictions)
  SELECT ann_id, a <= 5 AS head, z <= 5 AS tail FROM r WHERE a <= 5 OR z <= 5""")
def f7_head_f8_tail(spark, d):
    rows = running_sum(cut_by(predictions(spark, d), "time", 512.0), ["track_id"], ["time", "ann_id"], F.lit(1), "a")
    total = rows.groupBy("track_id").agg(F.max("a").alias("n"))
    rows = rows.join(total, "track_id").withColumn("z", F.col("n") - F.col("a") + 1)
    return rows.where("a <= 5 or z <= 5").select("ann_id", (F.col("a") <= 5).alias("head"), (F.col("z") <= 5).alias("tail"))


@R.add("w11_resample", """WITH v AS (SELECT DISTINCT video_id, n_frames, fps FROM video_names WHERE fps > 0 AND n_frames IS NOT NULL AND video_id IS NOT NULL),
  k AS (SELECT video_id, fps, n_frames, unnest(range(0, ceil(n_frames / fps * 25)::BIGINT + 1)) AS k FROM v) SELECT video_id, count(*) AS n, sum(trunc(k / 25.0::DOUBLE * fps)::BIGINT)::BIGINT AS total FROM k WHERE trunc(k / 25.0::DOUBLE * fps) < n_frames GROUP BY video_id""")
def w11_resample(spark, d):
    v = table(spark, d, "video_names").where("fps > 0 and n_frames > 0 and video_id is not null").select("video_id", "n_frames", "fps").distinct()
    # Output frame k shows the time k / 25; the last one lies before the video's end.
    last = F.ceil(F.col("n_frames") / F.col("fps") * 25.0)
    k = spread(v).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("source", (F.col("k") / 25.0 * F.col("fps")).cast("long"))
    return k.where("source < n_frames").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum("source").alias("total"))


@R.add("u4_distinct", f"{P} SELECT DISTINCT track_id, label FROM predictions")
def u4_distinct(spark, d):
    return predictions(spark, d).select("track_id", "label").distinct()


@R.add("u7_best_track", f"{SEGMENTS_SQL} SELECT track_id, arg_max(labelid, (duration, labelid)) AS longest FROM segments GROUP BY track_id")
def u7_best_track(spark, d):
    s = S.create_segments(predictions(spark, d, once=False))
    return s.groupBy("track_id").agg(F.max_by("labelid", F.struct("duration", "labelid")).alias("longest"))


@R.add("k13_missing_outputs", f"{SEGMENTS_SQL} SELECT DISTINCT track_id FROM predictions WHERE track_id NOT IN (SELECT track_id FROM segments)")
def k13_missing_outputs(spark, d):
    p = predictions(spark, d, once=False)
    return p.select("track_id").distinct().join(S.create_segments(p), "track_id", "left_anti")


@R.add("j7_semi", f"{SEGMENTS_SQL} SELECT DISTINCT track_id FROM predictions WHERE track_id IN (SELECT track_id FROM segments)")
def j7_semi(spark, d):
    p = predictions(spark, d, once=False)
    return p.select("track_id").distinct().join(S.create_segments(p), "track_id", "left_semi")
