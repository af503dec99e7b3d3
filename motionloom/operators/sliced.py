"""Window operations over long entities, without ever holding an entity in one task.

An entity's rows are cut into slices of bounded extent (time or index). Work inside a slice
is an ordinary window; what crosses a border comes from one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "slice"


def cut_by(df: DataFrame, column: str, width: float) -> DataFrame:
    """``df`` with the slice of each row by the value of ``column``."""
    return df.withColumn(SLICE, F.floor(F.col(column) / width))


def _join(rows: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(summary, [*by, SLICE], "left")


def with_neighbours(
    df: DataFrame, by: Sequence[str], order: Sequence[str], before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None
) -> DataFrame:
    """Columns of the previous (``before``) and next (``after``) row of the entity; null at its ends.

    ``order`` must be total within an entity; entity and slice must not be null.
    """
    before, after = dict(before or {}), dict(after or {})
    here = Window.partitionBy(*by, SLICE).orderBy(*order)
    key = F.struct(*[F.col(c) for c in order])
    rows = df.withColumns(
        {f"_b_{k}": F.lag(c).over(here) for k, c in before.items()}
        | {f"_a_{k}": F.lead(c).over(here) for k, c in after.items()}
        | {"_first": F.lag(F.lit(1)).over(here).isNull(), "_last": F.lead(F.lit(1)).over(here).isNull()}
    )
    tell: list[Column] = []
    if before:
        tell.append(F.max_by(F.struct(*[c.alias(k) for k, c in before.items()]), key).alias("_out"))
    if after:
        tell.append(F.min_by(F.struct(*[c.alias(k) for k, c in after.items()]), key).alias("_in"))
    ends = df.groupBy(*by, SLICE).agg(*tell)
    across = Window.partitionBy(*by).orderBy(SLICE)
    keep = [*by, SLICE]
    if before:
        ends = ends.withColumn("_from", F.lag("_out").over(across))
        keep.append("_from")
    if after:
        ends = ends.withColumn("_to", F.lead("_in").over(across))
        keep.append("_to")
    out = _join(rows, ends.select(*keep), by)
    out = out.withColumns(
        {k: F.when(F.col("_first"), F.col(f"_from.{k}")).otherwise(F.col(f"_b_{k}")) for k in before}
        | {k: F.when(F.col("_last"), F.col(f"_to.{k}")).otherwise(F.col(f"_a_{k}")) for k in after}
    )
    return out.drop(*[f"_b_{k}" for k in before], *[f"_a_{k}" for k in after], "_first", "_last", "_from", "_to")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the entity's rows up to and with each row; 1 as value gives row numbers."""
    here = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.groupBy(*by, SLICE).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*by, SLICE, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return _join(df.withColumn(name, F.sum(value).over(here)), offset, by).withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")


def chains(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    uses: Sequence[str],
    aggregates: Mapping[str, tuple[Column, Callable[[Column], Column]]],
    after: str | None = None,
) -> DataFrame:
    """One row per chain of successive rows of an entity that are linked pair by pair.

    ``link(before, here)`` says whether a row is linked to the one before it; both arguments
    give a column of ``uses`` of the respective row. ``aggregates``: name to (expression over
    a row, function that merges it over rows). Adds ``first`` and ``last`` (structs of ``order``)
    and, for ``after``, the value of that column in the first row after the chain (null at the entity's end).

    Chains inside a slice are whole after one pass; only the outermost chains of each slice
    meet in a second pass over the entity, so the plan is linear and no task holds an entity.
    """
    here = Window.partitionBy(*by, SLICE).orderBy(*order)
    rows = df.withColumns({f"_b_{c}": F.lag(c).over(here) for c in uses} | {"_rn": F.row_number().over(here), "_more": F.lead(F.lit(1)).over(here)})
    if after:
        rows = rows.withColumn("_next", F.lead(after).over(here))
    linked = (F.col("_rn") > 1) & F.coalesce(link(lambda c: F.col(f"_b_{c}"), F.col), F.lit(False))
    rows = rows.withColumn("_chain", F.sum((~linked).cast("int")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order)
    used = F.struct(*uses)
    tell = [
        F.min(key).alias("first"),
        F.max(key).alias("last"),
        F.min_by(used, "_rn").alias("_head"),
        F.max_by(used, "_rn").alias("_tail"),
        (F.min("_rn") == 1).alias("_opens"),
        F.max(F.col("_more").isNull()).alias("_closes"),
        F.min("_rn").alias("_rn"),
        *[merge(expr).alias("_v_" + n) for n, (expr, merge) in aggregates.items()],
    ]
    if after:
        tell += [F.max_by("_next", "_rn").alias("_next"), F.min_by(after, "_rn").alias("_begin")]
    pieces = rows.groupBy(*by, SLICE, "_chain").agg(*tell)
    pieces = pieces.withColumn("_lane", F.when(F.col("_opens") | F.col("_closes"), F.lit(None)).otherwise(F.col(SLICE)))
    across = Window.partitionBy(*by, "_lane").orderBy(SLICE, "_rn")
    before = F.lag("_tail").over(across)
    joined = F.col("_opens") & F.lag("_closes").over(across) & link(lambda c: before[c], lambda c: F.col(f"_head.{c}"))
    pieces = pieces.withColumn("_starts", (~F.coalesce(joined, F.lit(False))).cast("int"))
    if after:
        border = F.when(F.col("_closes") & F.lead("_opens").over(across), F.lead("_begin").over(across))
        pieces = pieces.withColumn("_next", F.coalesce("_next", border))
    pieces = pieces.withColumn("_whole", F.sum("_starts").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    out = [F.min("first").alias("first"), F.max("last").alias("last"), *[merge(F.col("_v_" + n)).alias(n) for n, (_, merge) in aggregates.items()]]
    if after:
        out.append(F.max_by("_next", F.struct(SLICE, "_rn")).alias("after"))
    return pieces.groupBy(*by, "_lane", "_whole").agg(*out).drop("_lane", "_whole")


def with_halo(df: DataFrame, index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Each row in its slice of ``size`` gap-free indices, and again, marked ``halo``, where a neighbour's window needs it.

    A window of up to ``before`` rows back and ``after`` rows ahead, partitioned by entity and
    slice, then gives every row that is no halo what a window over the whole entity would.
    """
    own = F.floor(F.col(index) / size)
    inside = F.pmod(F.col(index), F.lit(size))
    places = [F.struct(own.alias(SLICE), F.lit(False).alias("halo"))]
    if before:
        places.append(F.when(inside >= size - before, F.struct((own + 1).alias(SLICE), F.lit(True).alias("halo"))))
    if after:
        places.append(F.when((inside < after) & (own > 0), F.struct((own - 1).alias(SLICE), F.lit(True).alias("halo"))))
    return df.withColumn("_at", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull()))).select(*df.columns, "_at.slice", "_at.halo")
