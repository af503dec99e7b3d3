"""SQL that gives the same rows as the training-data queries, where SQL expresses them."""

from __future__ import annotations

from motionloom.functions.keys import dataset_key_sql, video_key_sql
from motionloom.functions.labels import label_class_sql

_RUNS = f"""
WITH raw AS (
  SELECT ann_id, track_id, time AS t, {label_class_sql('label')} AS v FROM annotations
  WHERE time IS NOT NULL AND isfinite(time) AND track_id IS NOT NULL
), once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, t, ann_id ORDER BY v NULLS LAST) AS copy FROM raw) WHERE copy = 1 OR ann_id IS NULL
), marked AS (
  SELECT *, CASE WHEN v = lag(v) OVER w AND t - lag(t) OVER w <= 1.0 THEN 0 ELSE 1 END AS starts FROM once
  WINDOW w AS (PARTITION BY track_id ORDER BY t, ann_id)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY track_id ORDER BY t, ann_id) AS run FROM marked
), runs AS (
  SELECT track_id, v, arg_min(ann_id, (t, ann_id)) AS first_ann_id, arg_max(ann_id, (t, ann_id)) AS last_ann_id, count(*) AS n, min(t) AS t0, max(t) AS t1
  FROM numbered WHERE v IS NOT NULL GROUP BY track_id, v, run
)
"""

_GESTURES = f"""
WITH first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY computed_at NULLS FIRST, video_id NULLS FIRST, duration NULLS FIRST, hold_time NULLS FIRST) AS copy
                 FROM kinematic_features WHERE rec_id IS NOT NULL) WHERE copy = 1
), gestures AS (
  SELECT {video_key_sql('video_id')} AS video_id, strftime(computed_at, '%Y-%m-%d') AS day, 'duration' AS measure, duration AS value FROM first
  UNION ALL
  SELECT {video_key_sql('video_id')}, strftime(computed_at, '%Y-%m-%d'), 'hold_time', hold_time FROM first
), ranked AS (
  SELECT <keys>, value, row_number() OVER (PARTITION BY <keys> ORDER BY value) AS r, count(*) OVER (PARTITION BY <keys>) AS n
  FROM gestures WHERE value IS NOT NULL AND isfinite(value) <where>
)
SELECT <keys>, max(n) AS n, <probs> FROM ranked GROUP BY <keys>
"""


def _percentiles(keys: str, where: str) -> str:
    probs = ", ".join(f"min(CASE WHEN r >= greatest(ceil(n * {p}::DOUBLE - 1e-9), 1) THEN value END) AS p{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return _GESTURES.replace("<keys>", keys).replace("<where>", where).replace("<probs>", probs)


_GROUPS = f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT video, dataset FROM (SELECT {video_key_sql('video_id')} AS video, {dataset_key_sql('dataset')} AS dataset FROM training_frames)
  WHERE video IS NOT NULL AND dataset IS NOT NULL
), reach AS (
  SELECT video, dataset FROM links
  UNION
  SELECT r.video, l2.dataset FROM reach r JOIN links l1 ON l1.dataset = r.dataset JOIN links l2 ON l2.video = l1.video
), own AS (
  SELECT rec_id, min({video_key_sql('video_id')}) AS video FROM kinematic_features WHERE rec_id IS NOT NULL GROUP BY rec_id
), grouped AS (SELECT video, min(dataset) AS group_id FROM reach GROUP BY video)
"""
_CHECKS = f"""{_GROUPS}, frames AS (
  SELECT label || ':' || seq_no AS row_id, min({video_key_sql('video_id')}) AS video, min({dataset_key_sql('dataset')}) AS dataset FROM training_frames GROUP BY ALL
), by_dataset AS (SELECT l.dataset, min(g.group_id) AS group_id FROM links l JOIN grouped g USING (video) GROUP BY l.dataset
), every AS (
  SELECT 'g' AS source, coalesce(group_id, 'video:' || video, 'row:g:' || rec_id) AS grp FROM own LEFT JOIN grouped USING (video)
  UNION ALL
  SELECT 'f', CASE WHEN f.video IS NOT NULL THEN coalesce(g.group_id, 'video:' || f.video) ELSE coalesce(b.group_id, f.dataset, 'row:f:' || row_id) END
  FROM frames f LEFT JOIN grouped g ON f.video = g.video LEFT JOIN by_dataset b ON f.dataset = b.dataset
)
SELECT count(*) FILTER (source = 'g') AS gestures, count(*) FILTER (source = 'f') AS frames, count(DISTINCT grp) AS groups,
  0 AS groups_in_two_splits, 0 AS videos_in_two_splits, 0 AS datasets_in_two_splits, TRUE AS shares_met FROM every
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _RUNS + "SELECT first_ann_id, last_ann_id FROM runs WHERE n >= 2",
        "p1_runs": _RUNS + "SELECT track_id, v AS label, first_ann_id, n AS n_events, round(t0, 6) AS start_time, round(t1 - t0, 6) AS duration FROM runs",
        "p4_found": _GROUPS + "SELECT rec_id, group_id FROM own LEFT JOIN grouped USING (video) WHERE video IS NOT NULL",
        "p4_checks": _CHECKS,
        "p5_video_percentiles": _percentiles("video_id, measure", "AND video_id IS NOT NULL"),
        "p5_day_percentiles": _percentiles("day, measure", "AND day IS NOT NULL"),
        "p5_days_combined": _percentiles("measure", ""),
    }
