"""Percentiles per group over any number of values, from counts that can be added up.

Method: values are reduced to (group, value, count); the counts are sorted by range over the
cluster; each range's total gives the offset of the next one, so running counts need no task
that holds a whole group; a percentile is the first value whose running count reaches its rank.
The counts are the mergeable form: those of days or files are added by ``merge_counts``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionloom.runtime import cut, finite


def value_counts(df: DataFrame, groups: Sequence[str], value: str, relative_error: float = 0.0) -> DataFrame:
    """The groups' columns, value and n: how often each value stands in its group.

    With ``relative_error`` 0 values are kept as they are and percentiles are exact. Else a
    positive or negative value is replaced by the middle of its logarithmic bin, which is
    within that share of it, so the state stays small whatever the input. Null, NaN and
    infinite values are left out; zero stays zero; a null group is a group.
    """
    v = finite(F.col(value))
    if relative_error > 0:
        step = math.log((1 + relative_error) / (1 - relative_error))
        middle = F.exp((F.floor(F.ln(F.abs(v)) / step) + 0.5) * step)
        v = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * middle)
    v = F.when(v == 0, F.lit(0.0)).otherwise(v)  # minus zero is zero
    return df.select(*groups, v.alias("value")).where("value is not null").groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(first: DataFrame, *others: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The counts of several parts as the counts of their union; ``groups`` may be fewer than the parts have."""
    every = first.select(*groups, "value", "n")
    for o in others:
        every = every.unionByName(o.select(*groups, "value", "n"))
    return every.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The groups' columns, n and p<percent> for each of ``probs``: the smallest value with at least that share at or below it.

    An empty state gives an empty result; a group without values has no row.
    """
    key = F.struct(*[F.col(g) for g in groups]) if groups else F.lit(0)
    state = counts.select(key.alias("g"), "value", "n")
    # The ranges are written, so that every later stage sees the same ones.
    ranged = cut(state.repartitionByRange("g", "value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("g", "part").agg(F.sum("n").alias("here"))
    whole = Window.partitionBy("g")
    # One row per group and range it lies in: at most groups + ranges rows.
    offsets = totals.select(
        "g",
        "part",
        F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("here").over(whole).alias("total"),
    )
    inside = Window.partitionBy("g", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    offsets = offsets.withColumnsRenamed({"g": "g2", "part": "part2"})
    ranked = (
        ranged.withColumn("run", F.sum("n").over(inside))
        .join(offsets, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2")))
        .select("g", "value", "total", (F.col("run") + F.col("offset")).alias("upto"))
    )
    target = [F.greatest(F.ceil(F.col("total") * F.lit(float(p)) - 1e-9), F.lit(1)) for p in probs]
    out = ranked.groupBy("g").agg(
        F.first("total").alias("n"), *[F.min(F.when(F.col("upto") >= t, F.col("value"))).alias(prob_name(p)) for p, t in zip(probs, target)]
    )
    return out.select(*[F.col(f"g.`{g}`").alias(g) for g in groups], "n", *[prob_name(p) for p in probs])


def prob_name(p: float) -> str:
    return "p" + f"{100 * p:g}".replace(".", "_")
