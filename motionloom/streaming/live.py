"""Live frames: buffered windows, session segments and sinks, with Structured Streaming."""

from __future__ import annotations

import csv
import os
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motionloom.operators.segments import create_session_segments, realtime_label

BUFFER = 5


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def two_clocks(df: DataFrame, frame: str, wall: str, saved_fps: float | None = 20.0) -> DataFrame:
    """``timestamp`` is video time (frame over the writer's rate) when a video is saved, else wall time; ``wall_clock_time`` is always kept."""
    video: Column = F.col(frame) / F.lit(saved_fps) if saved_fps else F.col(wall)
    return df.withColumns({"timestamp": video, "wall_clock_time": F.col(wall)})


def live_gestures(df: DataFrame, name: str, confidence: str, threshold: float) -> DataFrame:
    """gesture, confidence and raw_gesture of each frame, appended as frames come."""
    gesture, conf = realtime_label(F.col(name), F.col(confidence), threshold)
    return df.withColumns({"raw_gesture": F.col(name), "gesture": gesture, "confidence": conf, "threshold": F.lit(threshold)})


def buffered_sums(df: DataFrame, key: str, order: str, value: str, length: int = BUFFER) -> DataFrame:
    """key, order, total: the sum of the last ``length`` values of a key at each row, from the first row that has so many.

    The state of a key is its last ``length`` - 1 values, kept across batches; a new key (session
    and track) begins empty. Rows of a batch are taken in order of ``order``, ties by value;
    null values count as 0. Late rows are appended, not sorted back. The rows of one key in one batch
    meet in a task, so the batch size (``files_per_trigger``) bounds them.
    """
    kinds = dict(df.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values([order, value])
        kept = np.array(state.get[0] if state.exists else [], dtype=float)
        v = np.concatenate([kept, pdf[value].fillna(0.0).to_numpy(dtype=float)])
        state.update((v[max(0, len(v) - length + 1) :].tolist(),))
        full = len(v) - length + 1
        if full > 0:
            total = np.lib.stride_tricks.sliding_window_view(v, length).sum(axis=1)
            yield pd.DataFrame({key: [k[0]] * full, order: pdf[order].to_numpy()[len(pdf) - full :], "total": total})

    return (
        df.select(key, order, value)
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, total double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)
    )


def online_sessions(df: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Segments while the stream runs: a session of a key ends when nothing comes for ``gap``; rows later than ``late`` are dropped by the watermark."""
    return df.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(df: DataFrame, at: str, size: str, slide: str | None = None, late: str = "1 day", *by: str) -> DataFrame:
    """Counts per (sliding) time window and the columns ``by``."""
    return df.withWatermark(at, late).groupBy(F.window(at, size, slide or size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def write_table(df: DataFrame, path: str, checkpoint: str, extra: Callable[[DataFrame, int], None] | None = None):
    """Each batch as a folder of its own, so a batch that is tried again replaces itself; runs through what is there and stops."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if extra:
            extra(batch, number)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_session(frames: DataFrame, min_gap_s: float = 0.3, min_length_s: float = 0.5) -> DataFrame:
    """Segments of the stored frames of ended sessions: track_id, timestamp, gesture, frame."""
    return create_session_segments(frames, time="timestamp", label="gesture", tie="frame", min_gap_s=min_gap_s, min_length_s=min_length_s)


def run_to_files(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into parquet files below ``folder``, and give its rows; nothing passes through the driver.

    ``folder`` lies where all executors reach it and holds the checkpoint too, so a run that failed goes on where it
    stopped. In complete mode the last batch, which has all rows, stands.
    """
    rows, checkpoint = f"{folder}/rows", f"{folder}/checkpoint"
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").start(rows)
    else:
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return df.sparkSession.read.schema(df.schema).parquet(rows)


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Let a stream run for ``seconds`` at most, then stop it; whether it had ended by itself."""
    ended = bool(query.awaitTermination(seconds))
    if not ended:
        query.stop()
    return ended


def run_with_retries(start: Callable[[], StreamingQuery], tries: int = 3, wait: float = 1.0) -> int:
    """Start a stream and wait for its end; after a failure start it again, from its checkpoint, ``tries`` times in all. Gives the tries used."""
    for n in range(1, tries + 1):
        try:
            start().awaitTermination()
            return n
        except StreamingQueryException:
            if n == tries:
                raise
            time.sleep(wait)
    raise ValueError("tries must be 1 or more")


class Status(StreamingQueryListener):
    """Tells the state of a stream whenever another ``every`` frames have come: name, frames so far, frames a second.

    ``tell`` takes the state; ``to_csv`` makes one that appends it to a file, so metrics are kept as the stream runs.
    """

    def __init__(self, tell: Callable[[dict], None], every: int = 1500) -> None:
        self.tell, self.every, self.frames = tell, every, {}

    @staticmethod
    def to_csv(path: str) -> Callable[[dict], None]:
        def tell(state: dict) -> None:
            fresh = not os.path.exists(path)
            with open(path, "a", newline="", encoding="utf-8") as f:
                w = csv.DictWriter(f, list(state))
                if fresh:
                    w.writeheader()
                w.writerow(state)

        return tell

    def onQueryStarted(self, event) -> None:
        self.frames[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        before = self.frames.get(str(p.runId), 0)
        now = self.frames[str(p.runId)] = before + p.numInputRows
        if now // self.every > before // self.every:
            self.tell({"stream": p.name or str(p.id), "frames": now, "frames_per_second": round(p.processedRowsPerSecond or 0.0, 3)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.frames.pop(str(event.runId), None)
