"""Tables as files: explicit schemas for reading, and sinks that skip what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.operators.segments import annotation_refs, annotation_slots

SCHEMAS = {
    "predictions": "track_id string, time double, has_motion double, NoGesture_confidence double, Gesture_confidence double, Move_confidence double, label string",
    "segments": "track_id string, start_time double, end_time double, labelid long, label string, duration double",
    "raw_frames": "frame long, timestamp double, wall_clock_time double, gesture string, confidence double, threshold double, raw_gesture string",
    "dtw_distances": "gesture_i string, gesture_j string, distance double",
    "gesture_visualization": "x double, y double, gesture string",
    "train_metrics": "loss double, custom_accuracy double, val_loss double, val_custom_accuracy double",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV table of a known kind; its schema is never inferred, malformed numbers become null."""
    return spark.read.csv(path, header=True, schema=SCHEMAS[kind])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_tracks(df: DataFrame, path: str, track: str = "track_id", mode: str = "overwrite") -> None:
    """Parquet in one folder per track; a long track is written by as many tasks as its rows ask for."""
    salted = df.withColumn("_part", F.floor(F.rand(7) * 8))
    salted.repartition(track, "_part").drop("_part").write.mode(mode).partitionBy(track).parquet(path)


def scan_videos(spark: SparkSession, folder: str, pattern: str = "*.mp4", recursive: bool = False) -> DataFrame:
    """path, modified, bytes of the files that match; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def not_yet_done(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no output yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def distance_matrix(distances: DataFrame, names: list[str]) -> DataFrame:
    """The long distance table as a matrix with the named columns."""
    return distances.groupBy("gesture_i").pivot("gesture_j", names).agg(F.first("distance")).orderBy("gesture_i")


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotation_lines(segments: DataFrame, track: str = "track_id", author: str = "motionloom") -> DataFrame:
    """track_id, section, n, line: the annotation file of each track, line by line in order of (section, n).

    Slots come in order, annotations in one tier ``PREDICTED``; labels are escaped. Lines stay
    rows, so a file of any length is never built in one task. A track without segments has no file.
    """
    tracks = segments.select(F.col(track).alias("track_id")).distinct()

    def fixed(section: int, *lines: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(k).cast("long").alias("n"), F.lit(x).alias("line")) for k, x in enumerate(lines)])
        return tracks.select("track_id", F.lit(section).alias("section"), F.explode(rows).alias("r")).select("track_id", "section", "r.*")

    slots = annotation_slots(segments, track).select(
        "track_id",
        F.lit(1).alias("section"),
        F.col("slot").alias("n"),
        F.format_string('    <TIME_SLOT TIME_SLOT_ID="%s" TIME_VALUE="%d"/>', "slot_id", "ms").alias("line"),
    )
    refs = annotation_refs(segments, track).select(
        "track_id",
        F.lit(3).alias("section"),
        F.substring("annotation_id", 2, 20).cast("long").alias("n"),
        F.format_string(
            '    <ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="%s" TIME_SLOT_REF1="%s" TIME_SLOT_REF2="%s"><ANNOTATION_VALUE>%s</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>',
            "annotation_id",
            "slot_ref1",
            "slot_ref2",
            _escaped(F.col("label")),
        ).alias("line"),
    )
    head = fixed(0, '<?xml version="1.0" encoding="UTF-8"?>', f'<ANNOTATION_DOCUMENT AUTHOR="{author}" FORMAT="3.0" VERSION="3.0">', '  <HEADER TIME_UNITS="milliseconds"/>', "  <TIME_ORDER>")
    middle = fixed(2, "  </TIME_ORDER>", '  <TIER LINGUISTIC_TYPE_REF="default" TIER_ID="PREDICTED">')
    tail = fixed(4, "  </TIER>", '  <LINGUISTIC_TYPE LINGUISTIC_TYPE_ID="default" TIME_ALIGNABLE="true"/>', "</ANNOTATION_DOCUMENT>")
    return head.unionByName(slots).unionByName(middle).unionByName(refs).unionByName(tail)


def write_annotations(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per track with its lines in order; a very long file continues in the next part."""
    ordered = lines.repartitionByRange("track_id", "section", "n").sortWithinPartitions("track_id", "section", "n")
    ordered.select("track_id", "line").write.mode(mode).partitionBy("track_id").text(path)


def latest_session(sessions: DataFrame, created: str = "created", name: str = "session") -> DataFrame:
    """The most recent session; ties by name."""
    return sessions.agg(F.max_by(F.struct(*sessions.columns), F.struct(created, name)).alias("s")).where("s is not null").select("s.*")
