"""From labelled frames to timed segments, and what is derived from segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.operators.sliced import SLICE, chains, cut_by, running_sum
from motionloom.runtime import cut, finite

REST = "NoGesture"


def threshold_label(nogesture: Column, gesture: Column, move: Column, motion_threshold: float = 0.7, gesture_threshold: float = 0.7) -> Column:
    """Two-stage label: enough motion, then the larger of the sufficient classes; a tie goes to Gesture. Null confidences suffice for nothing."""
    g_ok, m_ok = F.coalesce(gesture >= gesture_threshold, F.lit(False)), F.coalesce(move >= gesture_threshold, F.lit(False))
    moving = F.coalesce(F.lit(1.0) - nogesture >= motion_threshold, F.lit(False))
    return (
        F.when(moving & g_ok & (~m_ok | (gesture >= move)), F.lit("Gesture")).when(moving & m_ok, F.lit("Move")).otherwise(F.lit(REST))
    )


def realtime_label(name: Column, confidence: Column, threshold: float) -> tuple[Column, Column]:
    """Name and confidence of a live prediction; an unsure gesture becomes NoGesture with confidence 0."""
    unsure = (name != REST) & (confidence < threshold)
    return F.when(unsure, F.lit(REST)).otherwise(name), F.when(unsure, F.lit(0.0)).otherwise(confidence)


def bias_shift(has_motion: Column, gesture: Column, move: Column, bias: float) -> tuple[Column, Column]:
    """Gesture and Move confidence after moving ``bias`` half the Move share to Gesture, where there is motion at all."""
    shift = F.when((has_motion > 0) & (gesture + move > 0), move * (bias * 0.5)).otherwise(F.lit(0.0))
    return gesture + shift, move - shift


def class_confidences(name: Column, confidence: Column) -> dict[str, Column]:
    """The three confidences and has_motion that a classifier's winning class stands for."""
    rest, moving = name == "NOGESTURE", F.upper(name).contains("MOVE")
    g = F.when(rest, 1.0 - confidence).when(moving, F.lit(0.0)).otherwise(confidence)
    return {
        "has_motion": g,
        "NoGesture_confidence": F.when(rest, confidence).otherwise(1.0 - confidence),
        "Gesture_confidence": g,
        "Move_confidence": F.when(~rest & moving, confidence).otherwise(F.lit(0.0)),
    }


def _frames(df: DataFrame, track: str, time: str, label: str, tie: str, slice_s: float) -> DataFrame:
    rows = df.select(
        F.col(track).alias("track_id"),
        finite(F.col(time)).alias("time"),
        (F.coalesce(F.col(label), F.lit(REST)) != REST).alias("active"),
        F.col(label).alias("label"),
        F.col(tie).alias("tie"),
    ).where("track_id is not null and time is not null")
    # Sorted once for this and for the runs: the windows share partitions and the beginning of their order.
    w = Window.partitionBy("track_id", SLICE).orderBy("time", "tie", "label")
    again = F.coalesce((F.lag("time").over(w) == F.col("time")) & (F.lag("tie").over(w) == F.col("tie")), F.lit(False))
    return cut_by(rows, "time", slice_s).withColumn("again", again).where("not again").drop("again")


def _runs(df: DataFrame, track: str, time: str, label: str, tie: str, slice_s: float) -> DataFrame:
    """track_id, start_time, end_time, label of each run of active frames; it ends with the first frame after it."""
    rows = _frames(df, track, time, label, tie, slice_s)
    gesture = (F.col("label") == "Gesture") & F.col("active")
    runs = chains(
        rows,
        ["track_id"],
        ["time", "tie"],
        lambda before, here: before("active") == here("active"),
        ["active"],
        {
            "active": (F.col("active"), F.max),
            "n_gesture": (F.when(gesture, 1).otherwise(0), F.sum),
            "n_other": (F.when(F.col("active") & ~gesture, 1).otherwise(0), F.sum),
            "other": (F.when(F.col("active") & ~gesture, F.col("label")), F.max),
        },
        after="time",
    )
    # Only Gesture and Move can win; the frame after the run never does. A tie goes to the smaller name.
    return runs.where("active").select(
        "track_id",
        F.col("first.time").alias("start_time"),
        F.coalesce("after", F.col("last.time")).alias("end_time"),
        F.when(F.col("n_gesture") >= F.col("n_other"), F.lit("Gesture")).otherwise(F.col("other")).alias("label"),
        F.col("first.tie").alias("tie"),
    )


def _merge(runs: DataFrame, same_label: bool, min_gap_s: float, slice_s: float, extra: dict) -> DataFrame:
    """Neighbouring runs of a track joined where the gap allows it."""

    def near(before, here) -> Column:
        close = here("start_time") - before("end_time") <= min_gap_s
        return close & (here("label") == before("label")) if same_label else close

    merged = chains(
        cut_by(runs, "start_time", slice_s),
        ["track_id"],
        ["start_time", "tie"],
        near,
        ["start_time", "end_time", "label"],
        {"end_time": (F.col("end_time"), F.max), "label": (F.col("label"), F.min), **extra},
    )
    return merged.withColumn("start_time", F.col("first.start_time"))


def create_segments(
    df: DataFrame,
    *,
    track: str = "track_id",
    time: str = "time",
    label: str = "label",
    tie: str = "ann_id",
    min_gap_s: float = 0.3,
    min_length_s: float = 0.5,
    slice_s: float = 512.0,
) -> DataFrame:
    """track_id, start_time, end_time, labelid, label, duration of the batch segments.

    Runs of labels other than NoGesture, labelled by majority; neighbours with the same label
    and a gap of at most ``min_gap_s`` are merged; then segments shorter than ``min_length_s``
    are dropped and the rest numbered from 1 per track. Frames without track or time are left
    out, a null label counts as NoGesture, ``tie`` orders frames of equal time; rows that repeat track, time and
    tie count once, the one with the smallest label. The result is typed even when empty.
    """
    merged = _merge(_runs(df, track, time, label, tie, slice_s), True, min_gap_s, slice_s, {})
    kept = merged.select("track_id", "start_time", "end_time", "label", (F.col("end_time") - F.col("start_time")).alias("duration")).where(F.col("duration") >= min_length_s)
    # Numbering reads its input twice; the segments, far fewer than frames, are written once for it.
    return running_sum(cut_by(cut(kept), "start_time", slice_s), ["track_id"], ["start_time"], F.lit(1), "labelid").select(
        "track_id", "start_time", "end_time", "labelid", "label", "duration"
    )


def create_session_segments(
    df: DataFrame,
    *,
    track: str = "track_id",
    time: str = "time",
    label: str = "label",
    tie: str = "ann_id",
    min_gap_s: float = 0.3,
    min_length_s: float = 0.5,
    slice_s: float = 512.0,
) -> DataFrame:
    """The realtime form: short runs go before merging, numbers are given before merging (so they have holes), every label is Gesture."""
    runs = _runs(df, track, time, label, tie, slice_s).where(F.col("end_time") - F.col("start_time") >= min_length_s)
    numbered = running_sum(cut_by(cut(runs), "start_time", slice_s), ["track_id"], ["start_time"], F.lit(1), "labelid").drop(SLICE)
    merged = _merge(numbered, False, min_gap_s, slice_s, {"labelid": (F.col("labelid"), F.min)})
    return merged.select("track_id", "start_time", "end_time", "labelid", F.lit("Gesture").alias("label"), (F.col("end_time") - F.col("start_time")).alias("duration"))


def track_statistics(predictions: DataFrame, track: str = "track_id") -> DataFrame:
    """Average motion, gesture and move confidence per track."""
    return predictions.groupBy(track).agg(
        F.avg("has_motion").alias("average_motion"), F.avg("gesture_confidence").alias("average_gesture"), F.avg("move_confidence").alias("average_move")
    )


def session_summary(raw: DataFrame, segments: DataFrame, session: str = "track_id", threshold: float = 0.7) -> DataFrame:
    """One row per session: frames, durations, rates and segment figures, 0 where a divisor is 0.

    ``raw``: session, timestamp, wall_clock_time, gesture; ``segments``: session, duration.
    """
    is_gesture = ~F.col("gesture").isin("NoGesture", "NOGESTURE")
    frames = raw.groupBy(session).agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.max("timestamp").alias("duration_seconds"),
        F.max("wall_clock_time").alias("wall_clock_duration_seconds"),
        F.count(F.when(is_gesture, 1)).alias("raw_gesture_frames"),
    )
    seg = segments.groupBy(session).agg(F.count(F.lit(1)).alias("processed_segments"), F.sum("duration").alias("total_gesture_time"))
    both = frames.join(seg, session, "left").na.fill({"processed_segments": 0, "total_gesture_time": 0.0})

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return both.withColumns(
        {
            "average_fps": over(F.col("total_frames"), F.col("duration_seconds")),
            "raw_gesture_percentage": over(F.col("raw_gesture_frames") * 100.0, F.col("total_frames")),
            "average_segment_duration": over(F.col("total_gesture_time"), F.col("processed_segments")),
            "gestures_per_minute": over(F.col("processed_segments"), F.col("wall_clock_duration_seconds") / 60.0),
            "confidence_threshold": F.lit(threshold),
        }
    )


def label_at_time(frames: DataFrame, segments: DataFrame, *, track: str = "track_id", time: str = "time", bucket_s: float = 10.0) -> DataFrame:
    """Every frame with the label of the first segment that covers its time, ends included, else NoGesture.

    Range join by equality: a segment is laid out over the time buckets it touches, a frame
    looks in its own bucket only; track and bucket are the join key, so no cross join arises.
    ``frames`` must have unique rows per (track, frame_id).
    """
    spread = segments.select(
        F.col(track).alias("track_id"),
        "start_time",
        "end_time",
        "labelid",
        F.col("label").alias("segment_label"),
        F.explode(F.sequence(F.floor(F.col("start_time") / bucket_s), F.floor(F.col("end_time") / bucket_s))).alias("bucket"),
    )
    placed = frames.withColumn("bucket", F.floor(F.col(time) / bucket_s))
    hit = placed.join(spread, [track, "bucket"], "left").withColumn(
        "covers", F.coalesce((F.col(time) >= F.col("start_time")) & (F.col(time) <= F.col("end_time")), F.lit(False))
    )
    keys = [c for c in frames.columns]
    return hit.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(F.col("covers"), F.col("segment_label")), F.when(F.col("covers"), F.col("labelid"))), F.lit(REST)).alias("segment_label"))


def segment_rows(segments: DataFrame, features: DataFrame, fps: float, *, track: str = "track_id", index: str = "frame_idx", bucket: int = 256) -> DataFrame:
    """Feature rows of each segment: indices from int(start*fps) up to, not with, int(end*fps)."""
    spans = segments.select(
        F.col(track).alias("track_id"), "labelid", (F.col("start_time") * fps).cast("long").alias("lo"), (F.col("end_time") * fps).cast("long").alias("hi")
    ).where("hi > lo")
    spread = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    placed = features.withColumn("bucket", F.floor(F.col(index) / bucket))
    return placed.join(spread, [track, "bucket"]).where((F.col(index) >= F.col("lo")) & (F.col(index) < F.col("hi"))).drop("bucket", "lo", "hi")


def annotation_slots(segments: DataFrame, track: str = "track_id") -> DataFrame:
    """Time slots of the annotation export: ts1.. per track, two per segment, in whole milliseconds."""
    two = segments.select(
        F.col(track).alias("track_id"),
        "labelid",
        F.explode(
            F.array(
                F.struct((F.col("labelid") * 2 - 1).alias("slot"), (F.col("start_time") * 1000).cast("long").alias("ms")),
                F.struct((F.col("labelid") * 2).alias("slot"), (F.col("end_time") * 1000).cast("long").alias("ms")),
            )
        ).alias("s"),
    )
    return two.select("track_id", "labelid", F.concat(F.lit("ts"), F.col("s.slot").cast("string")).alias("slot_id"), F.col("s.slot").alias("slot"), F.col("s.ms").alias("ms"))


def annotation_refs(segments: DataFrame, track: str = "track_id") -> DataFrame:
    """Annotations a1.. with their slots; of slots with equal milliseconds the last one is referred to."""
    slots = annotation_slots(segments, track)
    by_ms = slots.groupBy("track_id", "ms").agg(F.max("slot").alias("slot"))
    begin = by_ms.select("track_id", F.col("ms").alias("ms1"), F.concat(F.lit("ts"), F.col("slot").cast("string")).alias("slot_ref1"))
    end = by_ms.select("track_id", F.col("ms").alias("ms2"), F.concat(F.lit("ts"), F.col("slot").cast("string")).alias("slot_ref2"))
    rows = segments.select(
        F.col(track).alias("track_id"),
        F.concat(F.lit("a"), F.col("labelid").cast("string")).alias("annotation_id"),
        (F.col("start_time") * 1000).cast("long").alias("ms1"),
        (F.col("end_time") * 1000).cast("long").alias("ms2"),
        "label",
    )
    return rows.join(begin, ["track_id", "ms1"]).join(end, ["track_id", "ms2"]).select("track_id", "annotation_id", "slot_ref1", "slot_ref2", "label")


def display_window(time: Column, low: Column, high: Column, span: float = 10.0) -> tuple[Column, Column]:
    """Bounds of the stretch shown around a time: pinned to the start or the end within a fifth of the span, else trailing."""
    near_start, near_end = time < low + span * 0.2, time > high - span * 0.2
    middle = F.greatest(low, time - span * 0.8)
    begin = F.when(near_start, low).when(near_end, F.greatest(low, high - span)).otherwise(middle)
    end = F.when(near_start, F.least(high, low + span)).when(near_end, high).otherwise(F.least(high, middle + span))
    flat = end <= begin
    fixed = F.greatest(F.lit(0.0), time - span / 2)
    return F.when(flat, fixed).otherwise(begin), F.when(flat, fixed + span).otherwise(end)

