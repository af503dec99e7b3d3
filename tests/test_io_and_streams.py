"""Sources, sinks, streams, detector objects and the registry."""

import importlib
import os
import sys
import time

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from motionloom.api import GestureDetector, LiveDetector, Options, available_models, load_model, model_file, numbered_frames, refinement, save_model
from motionloom.operators.learning import synthetic_network
from motionloom.operators.segments import create_segments
from motionloom.runtime import cut, shared_dir, spread
from motionloom.sources import arrays, tables
from motionloom.streaming import live

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_array_files(spark, tmp_path):
    arrays.register(spark)
    rng = np.random.default_rng(0)
    for k in range(2):
        np.save(tmp_path / f"g{k}_world_landmarks.npy", rng.random((10 + k, 33, 3)))
    df = spark.read.format("landmark_tracks").option("rows", 4).load(str(tmp_path))
    assert df.groupBy("track_id").count().orderBy("track_id").collect()[1]["count"] == 11
    a = np.load(tmp_path / "g1_world_landmarks.npy")
    assert np.allclose(df.where("track_id = 'g1' and frame_idx = 9").first().lm, a[9].reshape(-1))
    np.savez_compressed(tmp_path / "set.npz", Move=rng.random((5, 69)), Gesture=rng.random((3, 69)), feature_names=np.array(["x"]))
    n = spark.read.format("training_npz").load(str(tmp_path / "*.npz"))
    assert {r.label: r["count"] for r in n.groupBy("label").count().collect()} == {"Move": 5, "Gesture": 3}
    assert spark.read.format("landmark_tracks").load(str(tmp_path / "none")).count() == 0


def test_tables_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("a", 0.1, 0.9, 1, "Gesture", 0.8), ("b", 1.0, 2.0, 1, 'x<&"', 1.0)], tables.SCHEMAS["segments"])
    tables.write_csv(seg, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), "segments").collect())) == sorted(map(tuple, seg.collect()))
    tables.write_csv(seg, str(tmp_path / "csv"), "append")
    assert tables.read_csv(spark, str(tmp_path / "csv"), "segments").count() == 4
    tables.write_tracks(seg, str(tmp_path / "tracks"))
    assert spark.read.parquet(str(tmp_path / "tracks")).count() == 2
    assert [r.track_id for r in tables.not_yet_done(seg, seg.where("track_id = 'a'"), "track_id").collect()] == ["b"]
    tables.write_annotations(tables.annotation_lines(seg), str(tmp_path / "eaf"))
    text = {r.track_id: r.n for r in spark.read.text(str(tmp_path / "eaf")).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    assert text == {"a": 12, "b": 12}
    lines = [r.line for r in tables.annotation_lines(seg).where("track_id = 'b'").orderBy("section", "n").collect()]
    import xml.etree.ElementTree as ET

    doc = ET.fromstring("\n".join(lines[1:]))
    assert doc.find(".//ANNOTATION_VALUE").text == 'x<&"' and [s.get("TIME_VALUE") for s in doc.iter("TIME_SLOT")] == ["1000", "2000"]
    (tmp_path / "videos").mkdir()
    for k in range(3):
        (tmp_path / "videos" / f"v{k}.mp4").write_bytes(b"x" * k)
    assert tables.scan_videos(spark, str(tmp_path / "videos")).agg(F.sum("bytes")).first()[0] == 3
    s = spark.createDataFrame([("s1", 1), ("s2", 5), ("s3", 5)], "session string, created long")
    assert tables.latest_session(s).first().session == "s3" and tables.latest_session(s.limit(0)).count() == 0


def test_matrix(spark):
    d = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0), ("a", "a", 0.0), ("b", "b", 0.0)], tables.SCHEMAS["dtw_distances"])
    assert [tuple(r) for r in tables.distance_matrix(d, ["a", "b"]).collect()] == [("a", 0.0, 2.0), ("b", 2.0, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(t), float(v)) for t, (k, v) in enumerate(zip(rng.integers(0, 3, 60), rng.random(60)))]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "k long, t double, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.file_stream(spark, str(tmp_path / "in"), "*.parquet", "k long, t double, v double")
    out = live.run_to_files(live.buffered_sums(stream, "k", "t", "v"), str(tmp_path / "run")).collect()
    want = []
    for k in range(3):
        v = [(t, x) for q, t, x in rows if q == k]
        want += [(k, v[i][0], round(sum(x for _, x in v[i - 4 : i + 1]), 9)) for i in range(4, len(v))]
    assert sorted((r.k, r.t, round(r.total, 9)) for r in out) == sorted(want)
    q = live.write_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_live_detector(spark, tmp_path):
    rows = [("s", i, i / 20, i / 20, "Gesture" if 4 <= i < 30 else "NoGesture", 0.9) for i in range(60)]
    spark.createDataFrame(rows, "track_id string, frame long, timestamp double, wall_clock_time double, name string, confidence double").write.parquet(str(tmp_path / "in"))
    d = LiveDetector()
    d.set_refinement(0.0, 9.0)
    assert (d.min_gap_s, d.min_length_s) == (0.1, 3.0) == refinement(-1, 5)
    d.set_refinement(0.3, 0.5)
    s = live.file_stream(spark, str(tmp_path / "in"), "*.parquet", "track_id string, frame long, timestamp double, wall_clock_time double, name string, confidence double")
    d.start_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    seg, summary = d.finalize(spark.read.parquet(str(tmp_path / "out")))
    assert [(r.start_time, r.end_time) for r in seg.collect()] == [(0.2, 1.5)]
    assert summary.first().raw_gesture_frames == 26 and summary.first().processed_segments == 1


def test_status_limit_and_retries(spark, tmp_path):
    for k in range(4):
        spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    rows = live.file_stream(spark, str(tmp_path / "in" / "part*"), "*.parquet", "id long")
    status = live.Status(live.Status.to_csv(str(tmp_path / "metrics.csv")))
    spark.streams.addListener(status)
    try:
        start = lambda n: live.write_table(rows, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"))
        assert live.run_with_retries(lambda: start(0)) == 1
        for _ in range(100):
            if (tmp_path / "metrics.csv").exists() and len((tmp_path / "metrics.csv").read_text().splitlines()) == 3:
                break
            time.sleep(0.1)
        lines = (tmp_path / "metrics.csv").read_text().splitlines()
        assert lines[0] == "stream,frames,frames_per_second" and [int(x.split(",")[1]) for x in lines[1:]] == [2000, 3000]
        assert live.run_for(start(1), 60) and not live.run_for(rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start(), 1)
    finally:
        spark.streams.removeListener(status)

    def fail(batch, number):
        raise ValueError("broken")

    with pytest.raises(StreamingQueryException):
        live.run_with_retries(lambda: live.write_table(rows, str(tmp_path / "out3"), str(tmp_path / "cp3"), fail), tries=2, wait=0.0)


def test_batch_detector(spark, tmp_path):
    rows = [("a", i, i / 25, 0.9 if i > 10 else 0.1, 0.8 if i > 10 else 0.05, 0.1, 0.1 if i > 10 else 0.9) for i in range(60)]
    df = spark.createDataFrame(rows, "track_id string, frame_idx long, time double, has_motion double, gesture_confidence double, move_confidence double, nogesture_confidence double")
    p, s, stats = GestureDetector(Options(class_bias=0.2)).process(df)
    assert p.count() == 60 and s.count() == 1 and stats.count() == 1
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([("a", i, i / 25, rng.random(3).tolist()) for i in range(40)], "track_id string, frame_idx long, time double, v array<double>")
    out = GestureDetector(Options(model="network", channels=3), synthetic_network(3)).predict(v, stride=5).collect()
    assert len(out) == 4 and {r.label for r in out} <= {"NoGesture", "Gesture", "Move"} and out[0].time >= 0.5
    with pytest.raises(ValueError):
        Options(model="other")
    path = tmp_path / "m.npz"
    save_model(path, synthetic_network(3), labels=["a"], window=25)
    w, facts = load_model(path)
    assert facts["window"] == 25 and set(w) == set(synthetic_network(3)) and available_models(tmp_path) == ["m"]
    assert model_file(None, tmp_path / "no", path) == path and model_file(None) is None
    n = numbered_frames(spark.createDataFrame([("a", t) for t in (5.0, 1.0, 900.0)], "track_id string, time double"), ["track_id"], "time", 100.0)
    assert [r.frame_idx for r in n.orderBy("time").collect()] == [0, 1, 2]


def test_runtime(spark):
    assert shared_dir(spark) and cut(spark.range(3)).count() == 3
    assert spread(spark.range(3)).count() == 3


def test_registry():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert "a1_segments" in q and "p3_found" in q and set(sql) <= set(q)
    core = importlib.import_module("motionloom.plans.queries").queries()
    assert not [n for n in core if n[0] == "p" and n[1:2].isdigit() and n != "p3_found"]


def test_core_does_not_need_the_training_data_subpackage(monkeypatch):
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("motionloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "motionloom.llm", None)
    assert "p3_found" in e.queries() and "p1_found" not in e.queries() and "a1_segments" in e.oracle_sql()


@has_data
def test_core_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    core = importlib.import_module("motionloom.plans.queries")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    some = ["a1_segments_fine", "a2_session_segments", "j1_label_at_time", "j8_annotation_refs", "w3_enhanced_features", "op_p24_zone_code", "a12_a13_holds", "f10_cap_per_class"]
    for name in some:
        got, want = core.queries()[name](spark, DATA).toPandas(), c.sql(core.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)

        def rows(df):
            return sorted(tuple(round(float(v), 6) + 0.0 if isinstance(v, (int, float, np.number, bool)) else str(v) for v in r) for r in df[cols].to_numpy(dtype=object))

        assert rows(got) == rows(want), name


@has_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and create_segments
