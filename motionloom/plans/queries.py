"""Registry of the core queries and of the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionloom.operators.outliers import implausible_arm, implausible_peaks
from motionloom.plans import frames, segments, streams, tables
from motionloom.plans.base import Query, Registry
from motionloom.runtime import table

R = Registry()


@R.add("p3_found")
def p3_found(spark, d):
    arm = implausible_arm(table(spark, d, "arm_kinematics"))
    peaks = implausible_peaks(table(spark, d, "kinematic_features"))
    return (
        arm.withColumn("table_name", F.lit("arm_kinematics"))
        .unionByName(peaks.withColumn("table_name", F.lit("kinematic_features")))
        .select("table_name", "row_id", "field")
    )


_PARTS = [segments.R, frames.R, tables.R, streams.R, R]


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
