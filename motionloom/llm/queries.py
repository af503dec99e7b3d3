"""The training-data queries p1, p2 and p4 to p8, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.functions.keys import video_key
from motionloom.functions.labels import label_class
from motionloom.llm.bpe import token_ids
from motionloom.llm.clusters import banding_recall, describe_clusters, grid_nodes, similarity_clusters
from motionloom.llm.leaks import leaked_spans, leaks, removal_spans
from motionloom.llm.quantiles import merge_counts, percentiles, value_counts
from motionloom.llm.runs import collapse_runs
from motionloom.llm.splits import TARGETS, split_records
from motionloom.llm.textstats import fit_running_language, text_statistics
from motionloom.operators.outliers import implausible_peaks
from motionloom.runtime import cut, table

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "annotations"), value=label_class(F.col("label")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).where(F.col("n_events") >= 2)
    return runs.select(F.col("first_event_id").alias("first_ann_id"), F.col("last_event_id").alias("last_ann_id"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select(
        F.col("entity").alias("track_id"),
        F.col("value").alias("label"),
        F.col("first_event_id").alias("first_ann_id"),
        "n_events",
        F.round("start_time", 6).alias("start_time"),
        F.round("duration", 6).alias("duration"),
    )


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    features = table(spark, d, "kinematic_features")
    flagged = implausible_peaks(features).select(F.col("row_id").alias("rec_id"))
    return features, similarity_clusters(features, exclude=flagged)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members = _clusters(spark, d)[1]
    return members.where("rec_id <> cluster").select(F.col("cluster").alias("first_rec_id"), "rec_id")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    features, members = _clusters(spark, d)
    return describe_clusters(members, features)


def p2_banding_recall(spark: SparkSession, d: str) -> DataFrame:
    return banding_recall(grid_nodes(table(spark, d, "kinematic_features"))[2]).withColumn("recall", F.round("recall", 4))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return split_records(table(spark, d, "kinematic_features"), table(spark, d, "training_frames"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d).where("source = 'kinematic_features' and video is not null and split is not null")
    return rows.select(F.col("row_id").cast("long").alias("rec_id"), "group_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("source", "row_id", "group", "split")


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: rows and groups, what lies in two splits, and whether shares are met up to the largest group."""
    rows = cut(_split(spark, d))
    out = rows.agg(
        F.count(F.when(F.col("source") == "kinematic_features", 1)).alias("gestures"),
        F.count(F.when(F.col("source") == "training_frames", 1)).alias("frames"),
        F.count_distinct("group").alias("groups"),
    )
    for c in ("group", "video", "dataset"):
        several = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b"))
        out = out.crossJoin(several.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias(f"{c}s_in_two_splits")))  # one row by construction
    per = rows.where("source = 'kinematic_features'").groupBy("group", "split").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("split").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    share = {k: F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)) / F.sum("n") for k in TARGETS}
    met = F.lit(True)
    for k, target in TARGETS.items():
        met = met & (F.abs(share[k] - target) <= F.greatest(F.lit(0.005), F.max("largest") / F.sum("n")))
    return out.crossJoin(per.agg(met.alias("shares_met")))


def _gestures(spark: SparkSession, d: str) -> DataFrame:
    """One row per rec_id: canonical video, day of arrival of the first delivery, measures."""
    rows = table(spark, d, "kinematic_features").where("rec_id is not null")
    return (
        rows.groupBy("rec_id")
        .agg(F.min(F.struct("computed_at", "video_id", "duration", "hold_time")).alias("r"))
        .select(
            "rec_id",
            video_key(F.col("r.video_id")).alias("video_id"),
            F.to_date("r.computed_at").cast("string").alias("day"),
            F.explode(
                F.array(
                    F.struct(F.lit("duration").alias("measure"), F.col("r.duration").alias("value")),
                    F.struct(F.lit("hold_time").alias("measure"), F.col("r.hold_time").alias("value")),
                )
            ).alias("m"),
        )
        .select("rec_id", "video_id", "day", "m.*")
    )


def p5_video_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["video_id", "measure"]
    return percentiles(value_counts(_gestures(spark, d).where("video_id is not null"), keys, "value"), keys, PROBS)


def p5_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["day", "measure"]
    return percentiles(value_counts(_gestures(spark, d).where("day is not null"), keys, "value"), keys, PROBS)


def p5_days_combined(spark: SparkSession, d: str) -> DataFrame:
    days = value_counts(_gestures(spark, d), ["day", "measure"], "value")
    return percentiles(merge_counts(days, groups=["measure"]), ["measure"], PROBS)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_spans(spark, d)).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(_spans(spark, d))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words_found").alias("most_words"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    found = removal_spans(table(spark, d, "documents"), cut(_spans(spark, d)))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def _text_statistics(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return text_statistics(documents, fit_running_language(documents, table(spark, d, "doc_kinds")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _text_statistics(spark, d).where("not_prose").select("doc_id")


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return _text_statistics(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_runs, p2_found, p2_clusters, p2_banding_recall, p4_found, p4_splits, p4_checks, p5_video_percentiles, p5_day_percentiles,
        p5_days_combined, p6_ids, p7_found, p7_items, p7_spans, p8_found, p8_stats,
    )
    return {f.__name__: f for f in every}
