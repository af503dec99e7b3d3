"""Hand-computed cases of labels, segments and what derives from them."""

import random

import pytest
from pyspark.sql import functions as F

from motionloom.operators import segments as S

SCHEMA = "track_id string, time double, ann_id long, label string"
NAMES = {"N": "NoGesture", "G": "Gesture", "M": "Move"}


def frames(spark, *tracks, step=1.0):
    rows = [(f"t{k}", i * step, 1000 * k + i, NAMES.get(c)) for k, t in enumerate(tracks) for i, c in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select("track_id", "start_time", "end_time", "labelid", "label").collect())


@pytest.mark.parametrize("slice_s", [2.0, 3.0, 512.0])
def test_batch_segments(spark, slice_s):
    make = lambda f, gap, length: got(S.create_segments(f, min_gap_s=gap, min_length_s=length, slice_s=slice_s))
    assert make(frames(spark, "NGGNGGN"), 1.0, 2.0) == [("t0", 1.0, 6.0, 1, "Gesture")]
    assert make(frames(spark, "NGGNGGN"), 0.5, 2.0) == [("t0", 1.0, 3.0, 1, "Gesture"), ("t0", 4.0, 6.0, 2, "Gesture")]
    assert make(frames(spark, "NGG"), 0.3, 1.0) == [("t0", 1.0, 2.0, 1, "Gesture")]
    assert make(frames(spark, "MGN"), 0.3, 1.0) == [("t0", 0.0, 2.0, 1, "Gesture")]
    assert make(frames(spark, "MMNGGN"), 1.0, 1.0) == [("t0", 0.0, 2.0, 1, "Move"), ("t0", 3.0, 5.0, 2, "Gesture")]


def test_session_segments(spark):
    out = got(S.create_session_segments(frames(spark, "GNGGNGGNN"), min_gap_s=1.0, min_length_s=2.0, slice_s=2.0))
    assert out == [("t0", 2.0, 7.0, 1, "Gesture")]


def brute(labels, gap, length):
    runs, i = [], 0
    while i < len(labels):
        if labels[i] == "N":
            i += 1
            continue
        j = i
        while j < len(labels) and labels[j] != "N":
            j += 1
        part = labels[i:j]
        runs.append([float(i), float(j if j < len(labels) else j - 1), "Gesture" if part.count("G") >= part.count("M") else "Move"])
        i = j
    merged = []
    for r in runs:
        if merged and r[0] - merged[-1][1] <= gap and merged[-1][2] == r[2]:
            merged[-1][1] = r[1]
        else:
            merged.append(list(r))
    return [(s, e, lab) for s, e, lab in merged if e - s >= length]


@pytest.mark.parametrize("slice_s", [3.0, 7.0, 1000.0])
def test_random_tracks_against_brute_force(spark, slice_s):
    rng = random.Random(3)
    tracks = ["".join(rng.choice("NNGGM") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    out = got(S.create_segments(frames(spark, *tracks), min_gap_s=1.0, min_length_s=2.0, slice_s=slice_s))
    expected = sorted((f"t{k}", s, e, n + 1, lab) for k, t in enumerate(tracks) for n, (s, e, lab) in enumerate(brute(t, 1.0, 2.0)))
    assert out == expected
    for a, b in zip(out, out[1:]):  # disjoint and in order
        assert a[0] != b[0] or a[2] <= b[1]


def test_edge_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.create_segments(empty).columns == ["track_id", "start_time", "end_time", "labelid", "label", "duration"]
    assert S.create_segments(empty).count() == 0 and S.create_session_segments(empty).count() == 0
    odd = spark.createDataFrame(
        [(None, 0.0, 1, "Gesture"), ("a", None, 2, "Gesture"), ("a", float("nan"), 3, "Gesture"), ("a", 0.0, 4, None), ("a", 1.0, 5, "Gesture"), ("a", 1.0, 6, "Gesture"), ("a", 3.0, 7, "NoGesture")],
        SCHEMA,
    ).withColumns({"start_time": F.lit("x"), "slice": F.lit(1), "active": F.lit("y")})
    assert got(S.create_segments(odd)) == [("a", 1.0, 3.0, 1, "Gesture")]


@pytest.mark.parametrize("n, g, m, expected", [(0.3, 0.65, 0.65, "Gesture"), (0.5, 0.9, 0.0, "NoGesture"), (0.1, 0.5, 0.55, "NoGesture"), (0.1, 0.2, 0.7, "Move"), (None, 0.9, 0.9, "NoGesture"), (0.1, None, 0.7, "Move")])
def test_threshold_label(spark, n, g, m, expected):
    df = spark.createDataFrame([(n, g, m)], "n double, g double, m double")
    assert df.select(S.threshold_label(F.col("n"), F.col("g"), F.col("m"), 0.6, 0.6)).first()[0] == expected


def test_label_at_time_takes_the_first(spark):
    seg = spark.createDataFrame([("a", 0.0, 1.0, 1, "Gesture"), ("a", 1.0, 25.0, 2, "Move")], "track_id string, start_time double, end_time double, labelid long, label string")
    fr = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("a", 24.9), ("a", 30.0), ("b", 0.5)], "track_id string, time double")
    out = {tuple(r)[:2]: r.segment_label for r in S.label_at_time(fr, seg).collect()}
    assert out == {("a", 1.0): "Gesture", ("a", 1.5): "Move", ("a", 24.9): "Move", ("a", 30.0): "NoGesture", ("b", 0.5): "NoGesture"}


def test_segment_rows_are_half_open(spark):
    seg = spark.createDataFrame([("a", 0.1, 0.5, 1)], "track_id string, start_time double, end_time double, labelid long")
    fr = spark.createDataFrame([("a", i) for i in range(20)], "track_id string, frame_idx long")
    assert sorted(r.frame_idx for r in S.segment_rows(seg, fr, 25.0).collect()) == list(range(2, 12))


def test_slots_share_the_last_reference(spark):
    seg = spark.createDataFrame([("a", 0.1, 0.2, 1, "G"), ("a", 0.2, 1.2345, 2, "G")], "track_id string, start_time double, end_time double, labelid long, label string")
    assert [(r.slot_id, r.ms) for r in S.annotation_slots(seg).orderBy("slot").collect()] == [("ts1", 100), ("ts2", 200), ("ts3", 200), ("ts4", 1234)]
    assert sorted((r.slot_ref1, r.slot_ref2) for r in S.annotation_refs(seg).collect()) == [("ts1", "ts3"), ("ts3", "ts4")]


def test_frames_to_the_end_of_a_video(spark, tmp_path):
    from motionloom.plans import segments, tables

    videos = [("a", 50.0, 1000), ("b", 12.5, 451), ("c", 29.97, 44998), ("d", 25.0, 1), ("e", None, 300), ("f", 30.0, None)]
    spark.createDataFrame(videos, "video_id string, fps double, n_frames long").write.parquet(f"{tmp_path}/video_names.parquet")
    sources = {v: [s for s in (int(k / 25.0 * fps) for k in range(3 * n)) if s < n] for v, fps, n in videos if fps and n}
    assert {r.video_id: (r.n, r.total) for r in segments.w11_resample(spark, str(tmp_path)).collect()} == {v: (len(s), sum(s)) for v, s in sources.items()}
    kept = {v: len(range(0, n, max(1, round(fps / 25)))) for v, fps, n in videos if fps and n}
    assert {r.video_id: r.kept for r in tables.f4_decimation(spark, str(tmp_path)).collect()} == kept
