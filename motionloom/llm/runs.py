"""Repeated consecutive events: each run of equal events becomes one row.

Method: row number within the entity minus row number within entity and value; the
difference is constant along a run of equal canonical values. Entities are cut into
time slices first, so no task holds a whole entity; only the two outermost runs of each
slice take part in joining runs across slice borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.runtime import finite, pick


def collapse_runs(
    df: DataFrame,
    *,
    event_id: str = "ann_id",
    entity: str = "track_id",
    at: str = "time",
    value: Column | str = "label",
    max_gap: float = 1.0,
    slice_s: float = 512.0,
) -> DataFrame:
    """One row per longest stretch of equal ``value`` of an entity in order of ``at``.

    Returns entity, value, first_event_id, last_event_id, n_events, start_time, end_time,
    duration. A null value names no class: it belongs to no run and ends the run before it.
    A gap over ``max_gap`` ends a run too. Rows without time (null, NaN, infinite) or entity
    are left out as if absent. Ties in time are ordered by id. A re-delivered row (same
    entity, time and id) counts once, the copy with a usable value and then the smallest
    value first; rows without an id are all kept. An empty table gives an empty result;
    further columns of ``df``, whatever their names, play no part.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = (
        df.select(F.col(event_id).alias("id"), F.col(entity).alias("ent"), finite(F.col(at)).alias("t"), v.alias("v"))
        .where(F.col("t").isNotNull() & F.col("ent").isNotNull())
        .withColumn("slice", F.floor(F.col("t") / slice_s))
    )
    order = [F.col("t"), F.col("id")]
    in_slice = Window.partitionBy("ent", "slice")
    once = rows.withColumn("prev_id", F.lag("id").over(in_slice.orderBy(*order, F.col("v").asc_nulls_last()))).withColumn(
        "prev_t", F.lag("t").over(in_slice.orderBy(*order, F.col("v").asc_nulls_last()))
    )
    once = once.where(~F.coalesce((F.col("id") == F.col("prev_id")) & (F.col("t") == F.col("prev_t")), F.lit(False)))

    ordered = in_slice.orderBy(*order)
    numbered = (
        once.withColumn("rn", F.row_number().over(ordered))
        .withColumn("gap", (F.col("t") - F.lag("t").over(ordered) > max_gap).cast("int"))
        .withColumn("leg", F.sum(F.coalesce("gap", F.lit(0))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n_slice", F.count(F.lit(1)).over(in_slice))
        .withColumn("diff", F.col("rn") - F.row_number().over(Window.partitionBy("ent", "slice", "v").orderBy(*order)))
    )
    pieces = numbered.groupBy("ent", "slice", "v", "leg", "diff").agg(
        F.min(F.struct("t", "id")).alias("first"),
        F.max(F.struct("t", "id")).alias("last"),
        F.count(F.lit(1)).alias("n"),
        (F.min("rn") == 1).alias("opens"),
        (F.max("rn") == F.first("n_slice")).alias("closes"),
        F.min("rn").alias("rn"),
    )
    # Runs inside a slice are whole; they stay apart, so a long entity doesn't gather in one task.
    pieces = pieces.withColumn("lane", F.when(F.col("opens") | F.col("closes"), F.lit(None)).otherwise(F.col("slice")))
    across = Window.partitionBy("ent", "lane").orderBy("slice", "rn")
    joins = (
        F.col("opens")
        & F.lag("closes").over(across)
        & (F.col("v") == F.lag("v").over(across))
        & (F.col("first.t") - F.lag("last.t").over(across) <= max_gap)
    )
    runs = pieces.withColumn("starts", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn(
        "run", F.sum("starts").over(across.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        runs.groupBy("ent", "lane", "run")
        .agg(F.first("v").alias("value"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_events"))
        .where(F.col("value").isNotNull())
        .select(
            F.col("ent").alias("entity"),
            "value",
            F.col("first.id").alias("first_event_id"),
            F.col("last.id").alias("last_event_id"),
            "n_events",
            F.col("first.t").alias("start_time"),
            F.col("last.t").alias("end_time"),
            (F.col("last.t") - F.col("first.t")).alias("duration"),
        )
    )
