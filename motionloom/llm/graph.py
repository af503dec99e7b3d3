"""Connected components on executors, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.runtime import cut


def _state(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0x3FFFFFFF))).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, left: str, right: str, rounds: int = 40, hub: int = 50_000) -> DataFrame:
    """node, component (its smallest node) of every node in ``edges``; nodes of one type, any order, loops allowed.

    Every round links each node's larger neighbours to its smallest one, then the smaller
    ones likewise; stars shrink to one per component in few rounds whatever the shape of the
    graph. Only counts and a checksum reach the driver; each round is cut to the shared
    checkpoint folder. The links of a node with more than ``hub`` links, and more than a 500th of
    all, never meet in a task (``_with_low``). Null ends give nothing; an empty table gives an empty result.
    """
    raw = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = raw.select(F.col("a").alias("node")).union(raw.select("b")).distinct()
    pairs = cut(raw.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(pairs)
    for _ in range(rounds):
        if state[0] == 0:
            break
        # Both steps have at most two ends per link.
        limit = max(hub, 2 * state[0] // 500)
        both = pairs.union(pairs.select("v", "u"))
        large = _with_low(both, limit, state[0] * 2, F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        linked = _with_low(large, limit, state[0] * 2, F.col("m"))
        small = linked.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in "uv"])).alias("p")).select("p.*")
        pairs = cut(small.where("u <> v").distinct())
        new = _state(pairs)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(pairs.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _with_low(links: DataFrame, limit: int, most: int, low: Column) -> DataFrame:
    """u, v, m: every link with the smallest neighbour of u.

    Where there are ``most`` links at most and that is no more than ``limit``, no node has more and a
    plain join serves. Else the nodes with more than ``limit`` links, at most ``most / limit`` and so 500
    of them, are broadcast with their smallest neighbour, and only the links of the others are shuffled.
    """
    if most <= limit:
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", low.alias("m"))
        return links.join(least, "u").select("u", "v", "m")
    links = cut(links)
    least = cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", low.alias("m"), "n"))
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = links.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= limit), "u")
    return rest.select("u", "v", "m").union(links.join(hubs, "u").select("u", "v", "m"))
