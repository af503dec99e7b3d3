"""Clusters, components, splits and percentiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.llm.clusters import STEPS, banding_recall, describe_clusters, medoid_groups, similar_nodes, similarity_clusters
from motionloom.llm.graph import components
from motionloom.llm.quantiles import merge_counts, percentiles, value_counts
from motionloom.llm.splits import allot, assign_groups, grouped_records, pack, split_records

REC = "rec_id long, gesture_id string, volume double, duration double, hand_peak_speed double, space_use int"


def gestures(seed=0, n=1200):
    rng = random.Random(seed)
    centres = [(0.002, 0.8, 0.5, 2), (0.02, 1.9, 0.9, 8), (0.2, 5.0, 2.5, 13)]
    rows, truth = [], {}
    for i in range(n):
        if rng.random() < 0.06:
            rows.append((i, f"g{i}", math.exp(rng.uniform(-8, 0)), math.exp(rng.uniform(-1, 2.7)), math.exp(rng.uniform(-2, 1.7)), rng.randint(0, 19)))
        elif rng.random() < 0.2:  # a long thin one
            t = rng.random() * 1.5
            rows.append((i, f"g{i}", 0.9 * math.exp(t) * math.exp(rng.uniform(-0.1, 0.1)), 0.6 * math.exp(t * 0.7), 0.25 * math.exp(rng.uniform(-0.1, 0.1)), 17))
            truth[i] = "long"
        else:
            k = rng.choice([0, 0, 0, 1, 2])
            v, d, s, u = centres[k]
            rows.append((i, f"g{i}", v * math.exp(rng.uniform(-0.2, 0.2)), d * math.exp(rng.uniform(-0.14, 0.14)), s * math.exp(rng.uniform(-0.14, 0.14)), u + rng.randint(-1, 1)))
            truth[i] = k
    return rows, truth


def test_clusters(spark):
    rows, truth = gestures()
    rows += [(5000, "x", None, 1.0, 1.0, 2), (5001, "x", 0.0, 0.8, 0.5, 2), (5002, "x", 0.002, 0.8, float("nan"), 2), (5003, "x", 0.002, 0.8, -0.5, 2), (None, "x", 0.002, 0.8, 0.5, 2)]
    rows += rows[:40]
    first = min(i for i, k in truth.items() if k == 0)
    df = spark.createDataFrame(rows, REC).withColumns({"q0": F.lit("clash"), "node": F.lit(1)})
    out = similarity_clusters(df, exclude=spark.createDataFrame([(first,)], "rec_id long"))
    got = {r.rec_id: r.cluster for r in out.collect()}
    truth.pop(first)
    firsts = {k: min(i for i, c in truth.items() if c == k) for k in set(truth.values())}
    assert {i: firsts[k] for i, k in truth.items()}.items() <= got.items()
    assert len(got) - len(truth) <= 2  # background that happens to lie in a cluster
    told = {r.cluster: r for r in describe_clusters(out, df).collect()}
    assert len(told) == 4 and all(r.medoid_rec_id in got and len(r.typical_gestures.split(",")) == 3 for r in told.values())


@pytest.mark.parametrize("bridge_share, groups", [(0.02, 2), (0.6, 1)])
def test_bridges(spark, bridge_share, groups):
    """Two dense groups stay two where a thin bridge of records joins them, and are one where the bridge is dense."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        x = rng.random() * 0.2 if i % 2 else 2.2 + rng.random() * 0.2
        rows.append((i, "g", 0.01 * math.exp(x), 1.0, 1.0, 5))
    bridge = int(4000 * bridge_share)
    rows += [(10_000 + i, "g", 0.01 * math.exp(0.1 + 2.2 * i / bridge), 1.0, 1.0, 5) for i in range(bridge * 2)]
    got = {r.rec_id: r.cluster for r in similarity_clusters(spark.createDataFrame(rows, REC)).collect()}
    assert len({got[i] for i in range(4000)}) == groups and len(set(got.values())) == groups
    assert len({got[i] for i in range(0, 4000, 2)}) == len({got[i] for i in range(1, 4000, 2)}) == 1


def test_medoid_groups_equal_a_plain_search():
    rng = np.random.default_rng(4)
    for trial in range(30):
        n = 40
        degree = rng.integers(1, 60, n)
        pairs = np.array([(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.05])
        a, b = np.r_[pairs[:, 0], np.arange(n)], np.r_[pairs[:, 1], np.arange(n)]
        node, whole = medoid_groups(a, b, degree[a], degree[b], 0.0)
        comp = brute_components(list(zip(a.tolist(), b.tolist())))
        assert {frozenset(np.flatnonzero(whole == w).tolist()) for w in set(whole.tolist())} == {frozenset(k for k in comp if comp[k] == c) for c in set(comp.values())}
        _, split = medoid_groups(a, b, degree[a], degree[b], 1.01)
        assert all(split[k] == k or degree[split[k]] >= degree[k] for k in range(n)) and len(set(split.tolist())) >= len(set(whole.tolist()))


def test_banding_recall(spark):
    rng = np.random.default_rng(3)
    q = np.unique(rng.integers(-3, 6, (300, 4)), axis=0)
    r = banding_recall(spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(q)], "node long, q0 int, q1 int, q2 int, q3 int")).first()
    shared = np.maximum(0, STEPS - np.abs(q[:, None] - q[None])).prod(axis=2)
    assert r.similar == ((shared / (2 * STEPS**4 - shared) >= 1 / 3).sum() - len(q)) // 2 and r.recall >= 0.99


def test_clusters_of_nothing(spark):
    assert similarity_clusters(spark.createDataFrame([], REC)).count() == 0
    alike = spark.createDataFrame([(i, "g", 0.1, 1.0, 1.0, 3) for i in range(5)], REC)
    assert sorted((r.rec_id, r.cluster, r.size) for r in similarity_clusters(alike).collect()) == [(i, 0, 5) for i in range(5)]


def test_two_alike_are_a_cluster(spark):
    """Two of 300 records are 0.5 percent and more; of 601 they aren't."""
    for n, want in ((300, {(7, 7, 2), (9, 7, 2)}), (601, set())):
        rows = [(i, "g", 0.1 * 50.0 ** (i % 25), 1.0 * 50.0 ** (i // 25), 1.0, 3) for i in range(n)]
        rows[9] = (9, *rows[7][1:])
        assert {(r.rec_id, r.cluster, r.size) for r in similarity_clusters(spark.createDataFrame(rows, REC)).collect()} == want


def test_banding_loses_no_similar_pair(spark):
    rng = np.random.default_rng(3)
    q = np.unique(rng.integers(-3, 6, (300, 4)), axis=0)
    nodes = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(q)], "node long, q0 int, q1 int, q2 int, q3 int")
    got = {(r.a, r.b) for r in similar_nodes(nodes, 1 / 3).collect()}
    shared = np.maximum(0, STEPS - np.abs(q[:, None] - q[None])).prod(axis=2)
    a, b = np.nonzero(shared / (2 * STEPS**4 - shared) >= 1 / 3)
    want = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_banding_nominates_every_similar_pair(spark):
    """Every place in the grid with everything near it; random orders of the cells lose a few of these pairs."""
    steps = np.stack(np.meshgrid(*[np.arange(-2, 3)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    near = steps[(STEPS - np.abs(steps)).prod(axis=1) >= 2 * STEPS**4 / 4]
    place = np.stack(np.meshgrid(*[np.arange(STEPS)] * 4, indexing="ij"), axis=-1).reshape(-1, 4) - 40 * np.arange(STEPS**4)[:, None]
    shared = (STEPS - np.minimum(STEPS, np.abs(near[:, None] - near[None]))).prod(axis=2)
    n = len(near)
    want = {(k * n + i, k * n + j) for i, j in zip(*(x.tolist() for x in np.nonzero(shared / (2 * STEPS**4 - shared) >= 1 / 3))) if i < j for k in range(len(place))}
    q = (place[:, None] + near[None]).reshape(-1, 4)
    got = similar_nodes(spark.createDataFrame([(i, *r) for i, r in enumerate(q.tolist())], "node long, q0 int, q1 int, q2 int, q3 int"), 1 / 3)
    rows = [(r.a, r.b) for r in got.collect()]
    assert n == 41 and len(rows) == len(set(rows)) and set(rows) == want
    with pytest.raises(ValueError):
        similar_nodes(got, 0.2)


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, kind):
    rng = random.Random(6)
    edges = {
        "random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)],
        "path": [(i, i + 1) for i in range(120)][::-1],
        "star": [(77, i) for i in range(150)],
        "loops": [(1, 1), (2, 2), (2, 3)],
    }[kind]
    df = spark.createDataFrame(edges + [(None, 4), (5, None)], "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == brute_components(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


FRAMES = "label string, dataset string, seq_no long, video_id string, lm array<double>"


def test_groups_and_splits(spark):
    rng = random.Random(7)
    frames, n = [], 0
    for k in range(60):
        for v in range(3):
            spelt = rng.choice([f"KV{3 * k + v:07d}", f" kv{3 * k + v:07d}", f"clips/KV{3 * k + v:07d}.mp4", f"KV-{3 * k + v:07d}"])
            frames.append(("Move", rng.choice([f"DATA{k:05d}", f"data-{k:05d}", f"Data.{k:05d}"]), n, spelt, None))
            n += 1
    frames += [("Move", "AAAA00099", n, "KV0000000", None), ("Move", "AAAA00099", n + 1, "KV0000009", None), ("Move", "unknown", n + 2, "KV0000020", None), ("Move", "unknown", n + 3, "KV0000030", None), ("Move", "DATA00004", n + 4, None, None), ("Move", None, n + 5, None, None)]
    frames += frames[:5]
    recs = [(i, rng.choice([f"KV{v:07d}", f"kv{v:07d}.MOV"])) for i, v in enumerate(rng.randint(0, 179) for _ in range(3000))] + [(9000, None), (9001, "KV7777777"), (9002, "other")]
    fr, rc = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(recs + recs[:9], "rec_id long, video_id string").withColumn("group", F.lit("x"))
    found = {int(r.row_id): r.group_id for r in grouped_records(rc, fr).where("source = 'kinematic_features' and video is not null").collect()}
    want = {}
    for i, v in recs[:3000]:
        k = int("".join(c for c in v.lower().split(".")[0] if c.isdigit())) // 3
        want[i] = "AAAA00099" if k in (0, 3) else f"DATA{k:05d}"
    assert found == want | {9001: None, 9002: None}
    rows = split_records(rc, fr).collect()
    assert len(rows) == len({(r.source, r.row_id) for r in rows}) == 3003 + n + 6
    by = {}
    for r in rows:
        by.setdefault(r.group, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    gest = [r.split for r in rows if r.source == "kinematic_features"]
    assert abs(gest.count("train") / len(gest) - 0.8) < 0.03 and abs(gest.count("test") / len(gest) - 0.1) < 0.03


def test_all_deliveries_of_a_row_link(spark):
    frames = [("Move", "AAA00001", 1, "KV0000001", None), ("Move", "BBB00002", 1, "KV0000002", None), (None, "CCC00003", None, "KV0000003", None), (None, "DDD00004", None, "KV0000004", None), (None, None, None, None, None)]
    recs = [(1, "KV0000002"), (2, "KV0000003"), (3, "KV0000004"), (3, "KV0000009"), (4, "KV0000009"), (5, None), (6, None)]
    rows = split_records(spark.createDataFrame(recs, "rec_id long, video_id string"), spark.createDataFrame(frames, FRAMES)).collect()
    got = {int(r.row_id): (r.group_id, r.group) for r in rows if r.source == "kinematic_features"}
    assert {k: v[0] for k, v in got.items()} == {1: "AAA00001", 2: "CCC00003", 3: "DDD00004", 4: "DDD00004", 5: None, 6: None}
    assert got[5][1] != got[6][1] and len([r for r in rows if r.source == "training_frames"]) == 4


@pytest.mark.parametrize("most", [0, 200_000])
def test_one_dataset_holds_half_of_all(spark, most):
    """Hub and large groups take the broadcast paths; the packing sees a bounded list though frames weigh nothing."""
    frames = [("Move", "HUB00000" if k % 2 else f"DAT{k:05d}", k, f"KV{k:07d}", None) for k in range(4000)]
    fr = spark.createDataFrame(frames, FRAMES)
    links = fr.selectExpr("'d:' || dataset a", "'v:' || video_id b")
    hub = {r.node: r.component for r in components(links, "a", "b", hub=20).collect()}
    assert hub == {r.node: r.component for r in components(links, "a", "b").collect()} and len(hub) == 4000 + 2001
    for recs in ([], [(k, f"KV{k:07d}") for k in range(3000)]):
        rows = split_records(spark.createDataFrame(recs, "rec_id long, video_id string"), fr, most=most).collect()
        assert len(rows) == 4000 + len(recs)
        by = {}
        for r in rows:
            by.setdefault(r.group, set()).add(r.split)
        assert len(by) == 2001 and all(len(s) == 1 for s in by.values())
    even = assign_groups(spark.range(6000).selectExpr("concat('g', id) as group", "0 as weight")).groupBy("split").count()
    assert {r.split: r["count"] for r in even.collect()}.keys() == {"train", "validation", "test"}
    assert abs({r.split: r["count"] for r in even.collect()}["train"] - 4800) < 100


def test_splits_of_nothing(spark):
    fr, rc = spark.createDataFrame([], FRAMES), spark.createDataFrame([], "rec_id long, video_id string")
    assert split_records(rc, fr).count() == 0 and grouped_records(rc, fr).count() == 0


def test_packing():
    rng = random.Random(1)
    items = [(str(i), rng.random() ** 3) for i in range(300)]
    loads = [0.0] * 10
    for name, k in pack(items, 10):
        loads[k] += dict(items)[name]
    assert max(loads) - min(loads) < 0.01 * sum(loads)
    assert pack([], 4) == [] and allot([5.0, 1.0, 1.0, 3.0], {"a": 0.8, "b": 0.1, "c": 0.1}) == ["a", "b", "c", "a"]


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["d1", "d2"]), rng.choice([0.0, -0.0, round(rng.gauss(0, 5), 1), None, float("nan"), float("inf")])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, day string, x double").withColumns({"n": F.lit(0), "part": F.lit(1), "value": F.lit("c")})
    probs = (0.0, 0.01, 0.5, 0.99, 1.0)
    days = value_counts(df, ["g", "day"], "x")
    out = {r.g: r for r in percentiles(merge_counts(days.where("day = 'd1'"), days.where("day = 'd2'"), groups=["g"]), ["g"], probs).collect()}
    for g in ("a", "b", None):
        v = sorted(x + 0.0 for k, _, x in rows if k == g and x is not None and math.isfinite(x))
        assert out[g].n == len(v)
        assert [out[g][c] for c in ("p0", "p1", "p50", "p99", "p100")] == [v[max(1, math.ceil(p * len(v) - 1e-9)) - 1] for p in probs]
    near = {r.g: r for r in percentiles(value_counts(df, ["g"], "x", relative_error=0.01), ["g"], (0.25, 0.9)).collect()}
    exact = {r.g: r for r in percentiles(value_counts(df, ["g"], "x"), ["g"], (0.25, 0.9)).collect()}
    for g in exact:
        for c in ("p25", "p90"):
            assert abs(near[g][c] - exact[g][c]) <= 0.0101 * abs(exact[g][c])
    assert percentiles(value_counts(df.limit(0), ["g"], "x"), ["g"], probs).count() == 0
