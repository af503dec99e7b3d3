import random

import pytest
from pyspark.sql import functions as F

from motionloom.functions.labels import label_class
from motionloom.llm.runs import collapse_runs

SCHEMA = "ann_id long, track_id string, time double, label string"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("NoGesture", "NoGesture"), (" no_gesture", "NoGesture"), ("No-Gesture", "NoGesture"), ("NoGesutre", "NoGesture"), ("NоGesture", "NoGesture"),
        ("NoGesture​", "NoGesture"), ("\tgesture", "Gesture"), ('"Gesture"', "Gesture"), ("Ｇesture", "Gesture"), ("Gestrue", "Gesture"), ("gesture.", "Gesture"),
        ("Mvoe", "Move"), ("Moove", "Move"), ("Ｍove", "Move"), ("Mоve", "Move"), ("MOVE", "Move"),
        (None, None), ("", None), ("  ", None), ("?", None), ("undefined", None), ("n/a", None), ("none", None), ("null", None), ("-", None), ("x" * 5000, None),
    ],
)
def test_label_spelling(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(label_class(F.col("t"))).first()[0] == expected


def brute(rows, gap=1.0):
    tracks = {}
    for i, t, at, v in rows:
        if at is not None and t is not None:
            tracks.setdefault(t, {}).setdefault((at, i), []).append(v)
    out = []
    for t, frames in tracks.items():
        run = None
        for (at, i), vs in sorted(frames.items()):
            v = min((x for x in vs if x is not None), default=None)
            if run and v is not None and v == run[1] and at - run[4] <= gap:
                run[3], run[4], run[5] = i, at, run[5] + 1
            else:
                if run:
                    out.append(tuple(run))
                run = [t, v, i, i, at, 1] if v is not None else None
        if run:
            out.append(tuple(run))
    return sorted((t, v, a, b, n) for t, v, a, b, _, n in out)


@pytest.mark.parametrize("slice_s", [1.5, 4.0, 1e9])
def test_against_brute_force(spark, slice_s):
    rng = random.Random(1)
    rows = []
    for i in range(800):
        t = rng.choice(["a", "a", "b"])
        rows.append((i, t, None if rng.random() < 0.03 else round(rng.random() * 60, 1), rng.choice(["Move", "Gesture", None, "Move"])))
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    out = collapse_runs(spark.createDataFrame(rows, SCHEMA), slice_s=slice_s)
    assert sorted(tuple(r) for r in out.select("entity", "value", "first_event_id", "last_event_id", "n_events").collect()) == brute(rows)


def test_edge_inputs(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(
        [(1, "a", 0.0, "x"), (1, "a", 0.0, None), (None, "a", 0.5, "x"), (None, "a", 0.5, "x"), (2, None, 0.0, "x"), (3, "a", float("inf"), "x"), (4, "a", float("nan"), "x"), (5, "a", 5.0, "y" * 100000)], SCHEMA
    ).withColumns({"slice": F.lit(0), "rn": F.lit("q"), "v": F.lit(None), "id": F.lit(9)})
    out = sorted((r.first_event_id, r.n_events, round(r.duration, 6)) for r in collapse_runs(df).collect())
    assert out == [(1, 3, 0.5), (5, 1, 0.0)]


def test_one_run_over_many_slices(spark):
    df = spark.range(5000).selectExpr("id as ann_id", "'a' as track_id", "id / 25.0D as time", "'x' as label")
    r = collapse_runs(df, slice_s=8.0).collect()
    assert len(r) == 1 and r[0].n_events == 5000 and r[0].last_event_id == 4999
