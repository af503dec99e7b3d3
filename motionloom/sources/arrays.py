"""NumPy files as data sources: one row per frame of ``.npy`` tracks and of ``.npz`` training sets."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SKIP = ("feature_names", "dataset_tracking")


class FilePart(InputPartition):
    def __init__(self, path: str, key: str = "", first: int = 0, last: int = 0) -> None:
        self.path, self.key, self.first, self.last = path, key, first, last


def _npy_shape(f) -> tuple[int, ...]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)[0]


class TrackReader(DataSourceReader):
    """Landmark tracks [frames, joints, 3]; long tracks are read in parts through a memory map."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*_world_landmarks.npy")
        self.rows = int(options.get("rows", 65536))

    def partitions(self) -> list[FilePart]:
        out = []
        for p in sorted(glob.glob(os.path.join(self.folder, self.pattern))):
            with open(p, "rb") as f:
                n = _npy_shape(f)[0]
            out += [FilePart(p, "", a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        return out or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        if not part.path:
            return
        track = os.path.basename(part.path).removesuffix(".npy").removesuffix("_world_landmarks")
        a = np.load(part.path, mmap_mode="r")
        for i in range(part.first, part.last):
            yield track, i, np.asarray(a[i], dtype=float).reshape(-1).tolist()


class LandmarkTracks(DataSource):
    """``spark.read.format("landmark_tracks").load(folder)``: track_id, frame_idx, lm."""

    @classmethod
    def name(cls) -> str:
        return "landmark_tracks"

    def schema(self) -> str:
        return "track_id string, frame_idx long, lm array<double>"

    def reader(self, schema) -> TrackReader:
        return TrackReader(dict(self.options))


class TrainingReader(DataSourceReader):
    """Training sets: one key per label holding [frames, values]; bookkeeping keys are skipped."""

    def __init__(self, options: dict) -> None:
        self.paths = sorted(glob.glob(options["path"]))

    def partitions(self) -> list[FilePart]:
        out = []
        for p in self.paths:
            with np.load(p, allow_pickle=False) as z:
                out += [FilePart(p, k) for k in z.files if k not in SKIP]
        return out or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        if not part.path:
            return
        with np.load(part.path, allow_pickle=False) as z:
            for i, row in enumerate(z[part.key]):
                yield part.key, i, np.asarray(row, dtype=float).reshape(-1).tolist()


class TrainingFrames(DataSource):
    """``spark.read.format("training_npz").load(path)``: label, seq_no, lm."""

    @classmethod
    def name(cls) -> str:
        return "training_npz"

    def schema(self) -> str:
        return "label string, seq_no long, lm array<double>"

    def reader(self, schema) -> TrainingReader:
        return TrainingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandmarkTracks)
    spark.dataSource.register(TrainingFrames)
