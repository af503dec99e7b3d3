"""Views of the given tables in the shape the operators work on, for Spark and, as text, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.functions.keys import dataset_key, dataset_key_sql, video_key, video_key_sql
from motionloom.operators.segments import threshold_label
from motionloom.operators.sliced import cut_by, running_sum
from motionloom.operators.spatial import POINTS
from motionloom.runtime import finite, table

THRESHOLD = 0.6


def predictions(spark: SparkSession, d: str, threshold: float = THRESHOLD, once: bool = True) -> DataFrame:
    """Frame predictions with the label their confidences give; one row per ann_id, or where ``once`` is false one per delivery, for operators that count repeated rows once themselves."""
    rows = table(spark, d, "annotations").select(
        "ann_id", "track_id", finite(F.col("time")).alias("time"), "has_motion", "nogesture_confidence", "gesture_confidence", "move_confidence"
    )
    rows = rows.where("time is not null and track_id is not null")
    rows = rows.distinct() if once else rows
    return rows.withColumn("label", threshold_label(F.col("nogesture_confidence"), F.col("gesture_confidence"), F.col("move_confidence"), threshold, threshold))


PREDICTIONS_SQL = f"""predictions AS (
  SELECT *, CASE WHEN 1.0::DOUBLE - nogesture_confidence >= {THRESHOLD}::DOUBLE THEN
      CASE WHEN gesture_confidence >= {THRESHOLD}::DOUBLE AND (gesture_confidence >= move_confidence OR move_confidence IS NULL OR move_confidence < {THRESHOLD}::DOUBLE) THEN 'Gesture'
           WHEN move_confidence >= {THRESHOLD}::DOUBLE THEN 'Move' ELSE 'NoGesture' END
      ELSE 'NoGesture' END AS label
  FROM (SELECT DISTINCT ann_id, track_id, time, has_motion, nogesture_confidence, gesture_confidence, move_confidence
        FROM annotations WHERE isfinite(time) AND track_id IS NOT NULL))"""


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training frames, one per label and seq_no, with canonical video and dataset."""
    rows = table(spark, d, "training_frames").select("label", "seq_no", video_key(F.col("video_id")).alias("video"), dataset_key(F.col("dataset")).alias("dataset"), "lm")
    return rows.groupBy("label", "seq_no").agg(F.min("video").alias("video"), F.min("dataset").alias("dataset"), F.min("lm").alias("lm"))


TRAINING_SQL = f"""training_rows AS (
  SELECT label, seq_no, min({video_key_sql('video_id')}) AS video, min({dataset_key_sql('dataset')}) AS dataset, min(lm) AS lm
  FROM training_frames GROUP BY label, seq_no)"""


def frames_tr(spark: SparkSession, d: str) -> DataFrame:
    """Frames with landmarks of known videos, numbered without gaps per label and video."""
    rows = training_rows(spark, d).where("lm is not null and size(lm) = 69 and video is not null")
    rows = cut_by(rows, "seq_no", 1 << 16)
    return running_sum(rows, ["label", "video"], ["seq_no"], F.lit(1), "n").select("label", "video", "dataset", "seq_no", "lm", (F.col("n") - 1).alias("frame_idx"))


FRAMES_TR_SQL = f"""{TRAINING_SQL}, frames_tr AS (
  SELECT label, video, dataset, seq_no, lm, row_number() OVER (PARTITION BY label, video ORDER BY seq_no) - 1 AS frame_idx
  FROM training_rows WHERE lm IS NOT NULL AND len(lm) = 69 AND video IS NOT NULL)"""

FINGERS = [f"{s}_{f}" for s in ("left", "right") for f in ("pinky", "index", "thumb")]
_EM = [f"{j}_{a}" for j in (*POINTS, *FINGERS) for a in "xyz"]


def frames_em(spark: SparkSession, d: str) -> DataFrame:
    """Landmark frames made of the embeddings: 17 points, wrist visibilities, one track per label."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    numbered = running_sum(cut_by(table(spark, d, "embeddings"), "vec_id", 1 << 16), ["label"], ["vec_id"], F.lit(1), "n")
    return numbered.select(
        F.col("label").alias("track"),
        (F.col("n") - 1).alias("frame_idx"),
        *[e(k).alias(c) for k, c in enumerate(_EM)],
        F.abs(e(51)).alias("left_vis"),
        F.abs(e(52)).alias("right_vis"),
    ).withColumns({"left_vis": F.least(F.col("left_vis") * 8, F.lit(1.0)), "right_vis": F.least(F.col("right_vis") * 8, F.lit(1.0))})


FRAMES_EM_SQL = (
    "frames_em AS (SELECT label AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, "
    + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}" for k, c in enumerate(_EM))
    + ", least(abs(embedding[52]::DOUBLE) * 8, 1.0) AS left_vis, least(abs(embedding[53]::DOUBLE) * 8, 1.0) AS right_vis FROM embeddings)"
)


def gestures(spark: SparkSession, d: str) -> DataFrame:
    """Gesture records, one per rec_id (the first delivered), with canonical video."""
    rows = table(spark, d, "kinematic_features").where("rec_id is not null")
    first = rows.groupBy("rec_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "rec_id"]), F.struct("computed_at", "video_id")).alias("r"))
    return first.select("rec_id", "r.*").withColumn("video", video_key(F.col("video_id")))


GESTURES_SQL = f"""gestures AS (
  SELECT * EXCLUDE (copy), {video_key_sql('video_id')} AS video FROM (
    SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY computed_at NULLS FIRST, video_id NULLS FIRST) AS copy FROM kinematic_features WHERE rec_id IS NOT NULL)
  WHERE copy = 1)"""
