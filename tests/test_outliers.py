from dataclasses import replace

import numpy as np
import pytest

from motionloom.operators.outliers import implausible, implausible_arm, implausible_peaks, sliced_rows, stuck, decimals, ARM_RULE
from pyspark.sql import functions as F

ARM = "reading_id long, track_id string, limb string, frame_idx long, time double, speed double, acceleration double, jerk double"


def arm(spark, values, acceleration=None):
    rows = [(i, "t", "hand", i, i / 25, v, acceleration[i] if acceleration else None, 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ARM)


def wave(n, seed=0):
    t = np.arange(n)
    return [round(float(0.5 + 0.3 * np.sin(t[i] / 9) + 0.01 * np.sin(i * 1.7)), 5) for i in range(n)]


def ids(df, field="speed"):
    return sorted(r.row_id for r in df.where(F.col("field") == field).collect())


def test_spikes_and_impossible_values(spark):
    v = wave(400)
    v[50], v[51], v[200], v[300], v[301] = 9.0, 12.5, -1.0, float("inf"), float("nan")
    v[120] = 1.4  # fast, but no spike
    assert ids(implausible_arm(arm(spark, v))) == [50, 51, 200, 300, 301]


def test_the_low_rank_part_decides(spark):
    """Without the sparse part nothing is a spike; where everything counts as sparse, more is."""
    v = wave(400)
    v[50], v[51], v[200] = 9.0, 12.5, 1.9
    some = arm(spark, v)
    args = dict(row_id="reading_id", position="frame_idx", source=[F.col("track_id"), F.col("limb")], fields=("speed",))
    assert ids(implausible(some, rule=replace(ARM_RULE, sparse=1e9), **args)) == []
    assert ids(implausible(some, rule=ARM_RULE, **args)) == [50, 51]
    assert {50, 51} < set(ids(implausible(some, rule=replace(ARM_RULE, sparse=1.0001, above=1.3), **args)))


def test_levels_hold_over_slices(spark):
    """A stretch that is high throughout is what its source normally shows, wherever slices are cut."""
    v = wave(600)
    v[300:420] = [6 * x for x in v[300:420]]
    v[40] = 5.0
    args = dict(row_id="reading_id", position="frame_idx", source=[F.col("track_id")], fields=("speed",), rule=ARM_RULE)
    assert ids(implausible(arm(spark, v), slice_bits=6, **args)) == []


def test_rows_without_position_or_source_are_spread(spark):
    """30 percent without position and all without track: no slice holds more than its share, and values are still tested."""
    n, bits = 4000, 6
    rows = [(i, None, "hand", None if i % 10 < 3 else i % 50, 0.0, -1.0 if i % 100 == 1 else 0.5 + (i * 37 % 101) / 300, 0.1, 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, ARM)
    args = dict(row_id="reading_id", position="frame_idx", source=[F.col("track_id"), F.col("limb")], fields=("speed",), rule=ARM_RULE)
    assert ids(implausible(df, slice_bits=bits, **args)) == list(range(1, n, 100))
    named = spark.createDataFrame([(r[0], "t", *r[2:]) for r in rows], ARM)
    assert ids(implausible(named, slice_bits=bits, **args))[:5] == [1, 101, 201, 301, 401]
    sizes = sliced_rows(df, row_id="reading_id", position="frame_idx", source=[F.col("track_id")], wanted=["speed"], slice_bits=bits)[1].groupBy("s0", "slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1 << bits


@pytest.mark.parametrize("begin", [10, 60, 121])
@pytest.mark.parametrize("length", [7, 8, 20])
def test_stuck_runs_across_slices(spark, begin, length):
    v = wave(200)
    for k in range(length):
        v[begin + k] = 0.6789 + 0.00001 * (k % 3 - 1)
    args = dict(row_id="reading_id", position="frame_idx", source=[F.col("track_id")], fields=("speed",), rule=ARM_RULE)
    expected = list(range(begin, begin + length)) if length >= 8 else []
    for bits in (4, 6, 13):
        assert ids(implausible(arm(spark, v), slice_bits=bits, **args)) == expected


def test_nulls_are_skipped_in_runs(spark):
    v = wave(100)
    for k in range(20, 32):
        v[k] = 0.7 if k % 4 else None
    assert ids(implausible_arm(arm(spark, v))) == [k for k in range(20, 32) if k % 4]


def test_slow_drift_is_no_run():
    v = np.round(0.2 + 0.0001 * np.arange(30), 5)
    assert not stuck(v, decimals(v)).any()


def test_edge_inputs(spark):
    empty = spark.createDataFrame([], ARM)
    assert implausible_arm(empty).count() == 0
    df = arm(spark, [None] * 5 + [0.0, 0.1]).withColumns({"row_id": F.lit("x"), "slice": F.lit("y"), "pos": F.lit(1), "field": F.lit(2)})
    assert implausible_arm(df).count() == 0
    twice = arm(spark, [-1.0, 0.2, 0.3]).union(arm(spark, [-1.0, 0.2, 0.3]))
    assert implausible_arm(twice).count() == 1
    loose = spark.createDataFrame([(1, None, None, None, None, -5.0, None, None), (None, "t", "hand", 3, 0.1, -5.0, None, None)], ARM)
    assert ids(implausible_arm(loose)) == [1]


def test_peaks_use_sibling_measures(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        s = float(np.exp(rng.normal(0, 0.7)))
        rows.append((i, f" kv0000001{'.mp4' if i % 2 else ''}", s, s * 0.6, s * 0.4, s, s * 8))
    rows[10] = (10, "KV0000001", 60.0, 0.5, 0.3, 0.8, 6.0)
    rows[11] = (11, "KV0000001", 0.0, 0.5, 0.3, 0.8, 6.0)
    df = spark.createDataFrame(rows, "rec_id long, video_id string, hand_peak_speed double, elbow_peak_speed double, hand_mean_speed double, hand_submovement_peak_max double, hand_peak_acceleration double")
    assert ids(implausible_peaks(df), "hand_peak_speed") == [10, 11]
