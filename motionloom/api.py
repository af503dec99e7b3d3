"""The engine as two objects: a detector over stored frames and one over a live stream."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.operators import distance, features, learning, segments
from motionloom.operators.kinematics import kinematic_features
from motionloom.operators.sliced import cut_by, running_sum
from motionloom.streaming import live

MODELS = ("network", "scores")


@dataclass(frozen=True)
class Options:
    """Settings of a detector. Values are taken as given; 0.0 is a value, None stands for the default."""

    labels: tuple[str, ...] = ("NoGesture", "Gesture", "Move")
    window: int = 25
    channels: int = 29
    motion_threshold: float = 0.7
    gesture_threshold: float = 0.7
    min_gap_s: float = 0.3
    min_length_s: float = 0.5
    class_bias: float = 0.0
    model: str = "scores"

    def __post_init__(self) -> None:
        if self.model not in MODELS:
            raise ValueError(f"model {self.model!r} is none of {', '.join(MODELS)}")


def refinement(min_gap_s: float, min_length_s: float) -> tuple[float, float]:
    """Gap and length within the bounds the live detector allows."""
    return max(0.1, min(2.0, min_gap_s)), max(0.1, min(3.0, min_length_s))


def model_file(*candidates: str | Path | None) -> Path | None:
    """The first of the candidate paths that exists."""
    return next((Path(c) for c in candidates if c and Path(c).is_file()), None)


def available_models(folder: str | Path) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.npz"))


def save_model(path: str | Path, weights: Mapping[str, np.ndarray], **facts: object) -> None:
    """Weights with the facts needed to use them (labels, window size, flags)."""
    np.savez_compressed(path, __facts__=np.array(json.dumps(facts)), **weights)


def load_model(path: str | Path) -> tuple[dict[str, np.ndarray], dict]:
    with np.load(path, allow_pickle=False) as z:
        return {k: z[k] for k in z.files if k != "__facts__"}, json.loads(str(z["__facts__"]))


@dataclass
class GestureDetector:
    """Labels frames, joins them to segments and analyses gestures; every method maps tables to tables."""

    options: Options = field(default_factory=Options)
    weights: Mapping[str, np.ndarray] | None = None

    def predict(self, frames: DataFrame, stride: int = 1) -> DataFrame:
        """Predictions with labels.

        For ``scores``, ``frames`` carries has_motion, gesture_confidence, move_confidence and
        nogesture_confidence already. For ``network``, it carries track_id, frame_idx, time and the feature vector ``v``.
        """
        o = self.options
        if o.model == "network":
            if self.weights is None:
                raise ValueError("a network needs weights")
            windows = features.sliding_windows(frames, ["track_id"], "frame_idx", "v", o.window, stride)
            scored = learning.score_windows(windows, "window", self.weights).drop("window")
            frames = scored.withColumnsRenamed({"start": "frame_idx"}).join(frames.select("track_id", "frame_idx", "time"), ["track_id", "frame_idx"])
            frames = frames.withColumns(
                {
                    "time": F.col("time") + o.window / 25 / 2,
                    "gesture_confidence": F.col("p_gesture") * F.col("has_motion"),
                    "move_confidence": F.col("p_move") * F.col("has_motion"),
                    "nogesture_confidence": 1 - F.col("has_motion"),
                }
            ).drop("p_gesture", "p_move")
        if o.class_bias:
            g, m = segments.bias_shift(F.col("has_motion"), F.col("gesture_confidence"), F.col("move_confidence"), o.class_bias)
            frames = frames.withColumns({"gesture_confidence": g, "move_confidence": m})
        label = segments.threshold_label(F.col("nogesture_confidence"), F.col("gesture_confidence"), F.col("move_confidence"), o.motion_threshold, o.gesture_threshold)
        return frames.withColumn("label", label)

    def process(self, frames: DataFrame, tie: str = "frame_idx") -> tuple[DataFrame, DataFrame, DataFrame]:
        """Predictions, segments and statistics per track."""
        p = self.predict(frames)
        s = segments.create_segments(p, tie=tie, min_gap_s=self.options.min_gap_s, min_length_s=self.options.min_length_s)
        return p, s, segments.track_statistics(p)

    def fill_and_smooth(self, frames: DataFrame, by: Sequence[str], points: Sequence[str]) -> DataFrame:
        """Missing points from the nearest frame, then smoothed across their coordinates."""
        for p in points:
            for a in "xyz":
                frames = features.fill_nearest(frames, by, "frame_idx", f"{p}_{a}")
        for p in points:
            mixed = features.smooth_axes(*[F.col(f"{p}_{a}") for a in "xyz"])
            frames = frames.withColumns({f"{p}_{a}": c for a, c in zip("xyz", mixed)})
        return frames

    def kinematics(self, frames: DataFrame, by: Sequence[str], fps: float = 25.0) -> DataFrame:
        return kinematic_features(frames, by, fps=fps)

    def pairwise_dtw(self, frames: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
        return distance.pairwise_distances(distance.gesture_series(frames, by, list(columns)))

    def embed(self, distances: DataFrame) -> DataFrame:
        return distance.planar_map(distances)

    def dashboard_tables(self, kinematics: DataFrame, positions: DataFrame, key: str = "gesture") -> DataFrame:
        """Each gesture with its place on the map, its features and a seeded jitter for drawing."""
        return positions.join(kinematics, key).withColumn("jitter", (learning.uniform(42, F.col(key)) - 0.5) * 0.2)


@dataclass
class LiveDetector:
    """Labels frames as they come and segments sessions when they end."""

    threshold: float = 0.5
    min_gap_s: float = 0.3
    min_length_s: float = 0.5

    def start_stream(self, frames: DataFrame, path: str, checkpoint: str):
        return live.write_table(live.live_gestures(frames, "name", "confidence", self.threshold), path, checkpoint)

    def set_refinement(self, min_gap_s: float, min_length_s: float) -> None:
        self.min_gap_s, self.min_length_s = refinement(min_gap_s, min_length_s)

    def finalize(self, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Segments and summary of stored sessions."""
        s = live.finish_session(stored, self.min_gap_s, self.min_length_s)
        return s, segments.session_summary(stored, s, threshold=self.threshold)


def numbered_frames(df: DataFrame, by: Sequence[str], order: str, width: float) -> DataFrame:
    """``df`` with gap-free frame_idx per entity, without a window over whole entities."""
    return running_sum(cut_by(df, order, width), by, [order], F.lit(1), "frame_idx").withColumn("frame_idx", F.col("frame_idx") - 1)
