"""Train, validation and test splits that keep whatever belongs together in one split.

Method: components of the graph of videos and datasets; then largest differencing over many
equal bins (again and again the two partial packings that differ most are combined, heaviest
bins onto lightest), and whole bins go to the splits by target proportion. Light groups are
gathered into a bounded number of hash buckets first, so the packing sees a bounded list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.functions.keys import dataset_key, video_key
from motionloom.llm.graph import components
from motionloom.runtime import cut

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _named(records: DataFrame, frames: DataFrame, rec_id: str = "rec_id", video: str = "video_id", dataset: str = "dataset") -> DataFrame:
    """source, row_id, video, dataset of every delivery, names in canonical spelling; a frame without seq_no is told by what it holds."""
    none = F.lit(None).cast("string")
    recs = records.select(F.lit("kinematic_features").alias("source"), F.col(rec_id).cast("string").alias("row_id"), video_key(F.col(video)).alias("video"), none.alias("dataset")).where("row_id is not null")
    number = F.coalesce(F.col("seq_no").cast("string"), F.concat(F.lit("#"), F.md5(F.to_json(F.struct(video, dataset, "lm")))))
    fr = frames.select(
        F.lit("training_frames").alias("source"),
        F.concat(F.coalesce(F.concat(F.col("label"), F.lit(":")), F.lit(":")), number).alias("row_id"),
        video_key(F.col(video)).alias("video"),
        dataset_key(F.col(dataset)).alias("dataset"),
    )
    return recs.unionByName(fr)


def grouped_records(records: DataFrame, frames: DataFrame, rec_id: str = "rec_id", video: str = "video_id", dataset: str = "dataset") -> DataFrame:
    """source, row_id, video, dataset, group_id, group of every gesture and every training frame, once.

    source is ``kinematic_features`` (row_id = rec_id) or ``training_frames`` (row_id = label:seq_no).
    group is shared by whatever hangs together: videos and datasets of a frame, through any number of
    frames, and the names of all deliveries of a row; a row with neither stands alone. group_id is the
    smallest dataset of the group, null where it has none. video and dataset are the row's smallest.
    Videos and datasets are compared by their canonical spelling; a name that is no dataset joins nothing.
    """
    # Prefixes keep the kinds apart and datasets smallest, so a component is named by its smallest dataset.
    v, d = F.concat(F.lit("v:"), "video"), F.concat(F.lit("d:"), "dataset")
    named = cut(_named(records, frames, rec_id, video, dataset).distinct())
    rows = cut(
        named.groupBy("source", "row_id").agg(
            F.min("video").alias("video"), F.min("dataset").alias("dataset"), ((F.count_distinct("video") > 1) | (F.count_distinct("dataset") > 1)).alias("several")
        )
    )
    node = F.coalesce(v, d)
    links = named.where("video is not null and dataset is not null").select(d.alias("a"), v.alias("b"))
    other = named.join(rows.where("several").select("source", "row_id", node.alias("a")), ["source", "row_id"])
    other = other.select("a", F.explode(F.array(v, d)).alias("b")).where("b is not null")
    nodes = components(links.union(other).distinct(), "a", "b")
    own = rows.withColumn("node", F.coalesce(v, d, F.concat_ws(":", F.lit("row"), "source", "row_id")))
    # A node is one of few, a video may hold a third of the rows: the rows are joined, not grouped.
    top = F.coalesce("component", "node")
    return own.join(nodes, "node", "left").select(
        "source",
        "row_id",
        "video",
        "dataset",
        F.when(top.startswith("d:"), F.substring(top, 3, 1 << 20)).alias("group_id"),
        F.when(top.startswith("d:"), F.substring(top, 3, 1 << 20)).when(top.startswith("v:"), F.concat(F.lit("video:"), F.substring(top, 3, 1 << 20))).otherwise(top).alias("group"),
    )


def pack(weights: list[tuple[str, float]], bins: int) -> list[tuple[str, int]]:
    """Bin of each item by largest differencing; bins are numbered from the heaviest."""
    heap: list[tuple[float, int, list[tuple[float, list[str]]]]] = []
    for n, (name, w) in enumerate(sorted(weights, key=lambda x: (-x[1], x[0]))):
        heapq.heappush(heap, (-w, n, [(w, [name])] + [(0.0, [])] * (bins - 1)))
    n = len(weights)
    while len(heap) > 1:
        (_, _, one), (_, _, two) = heapq.heappop(heap), heapq.heappop(heap)
        joined = [(a + b, x + y) for (a, x), (b, y) in zip(one, reversed(two))]
        joined.sort(key=lambda t: -t[0])
        n += 1
        heapq.heappush(heap, (-(joined[0][0] - joined[-1][0]), n, joined))
    return [(name, k) for k, (_, names) in enumerate(heap[0][2]) for name in names] if heap else []


def allot(loads: list[float], targets: dict[str, float]) -> list[str]:
    """Split of each bin: heaviest first, to the split that is furthest below its share."""
    total = sum(loads) or 1.0
    have = dict.fromkeys(targets, 0.0)
    out = [""] * len(loads)
    for k in sorted(range(len(loads)), key=lambda i: -loads[i]):
        name = max(targets, key=lambda s: (targets[s] * total - have[s], targets[s]))
        have[name] += loads[k]
        out[k] = name
    return out


def assign_groups(weights: DataFrame, targets: dict[str, float] = TARGETS, bins: int = 200, buckets: int = 2048) -> DataFrame:
    """group, split for a table of (group, weight), weights summing to the split shares as nearly as groups allow.

    A group that weighs at least 1/``buckets`` of all is packed by itself (there are at most
    ``buckets``); lighter ones share one of ``buckets`` hash buckets. So at most twice
    ``buckets`` rows meet in the one task that packs them, whatever the size of the input.
    Where all weights are zero, every group weighs the same.
    """
    sized = cut(weights.select("group", F.col("weight").cast("double").alias("weight")))
    total = sized.agg(F.sum("weight")).first()[0] or 0.0
    if total == 0:
        sized = sized.withColumn("weight", F.lit(1.0))
        total = float(sized.count())
    light = F.concat(F.lit("#"), F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("string"))
    placed = sized.withColumn("atom", F.when(F.col("weight") * buckets >= total, F.concat(F.lit("="), "group")).otherwise(light))
    atoms = placed.groupBy("atom").agg(F.sum("weight").alias("weight"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(a, w) for pdf in batches for a, w in zip(pdf["atom"], pdf["weight"])]
        if rows:
            size = dict(rows)
            packed = pack(rows, bins)
            loads = [0.0] * bins
            for a, k in packed:
                loads[k] += size[a]
            names = allot(loads, targets)
            yield pd.DataFrame([(a, names[k]) for a, k in packed], columns=["atom", "split"])

    chosen = atoms.repartition(1).mapInPandas(solve, "atom string, split string")
    return placed.join(F.broadcast(chosen), "atom").select("group", "split")


def split_records(records: DataFrame, frames: DataFrame, targets: dict[str, float] = TARGETS, most: int = 200_000, **names: str) -> DataFrame:
    """The rows of ``grouped_records`` with the split of each.

    Shares are counted in gestures, in groups where there are none. Up to ``most`` groups are broadcast
    with their split; of more, those with at least a 1000th of the rows are, so no task joins a large group.
    """
    rows = cut(grouped_records(records, frames, **names))
    weights = cut(rows.groupBy("group").agg(F.count(F.when(F.col("source") == "kinematic_features", 1)).alias("weight"), F.count(F.lit(1)).alias("n")))
    size = weights.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    split = assign_groups(weights, targets)
    if size.groups <= most:
        return rows.join(F.broadcast(split), "group")
    split = cut(split.join(weights.select("group", (F.col("n") * 1000 >= size.rows).alias("large")), "group"))
    large = F.broadcast(split.where("large").select("group", "split"))
    rest = rows.join(large, "group", "left_anti").join(split.where("not large").select("group", "split"), "group")
    return rows.join(large, "group").unionByName(rest)
