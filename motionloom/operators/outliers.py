"""Implausible readings: impossible values, spikes and stuck sensors, per source.

Spikes: the readings of a source are laid out as a profile matrix (short stretches of
successive frames as rows, or records with their sibling measures as columns) in logarithms;
robust principal components part it into a low-rank normal behaviour and sparse deviations.
The source's normal level is the highest reading without a sparse part, over all its slices; a
sparse reading far above that level is a spike. Impossible values and constant runs are tested
separately. Sources are cut into slices of bounded size; runs across slice borders are found from
the few rows at the borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions.keys import video_key
from motionloom.runtime import cut

RUN = 8
_WIDTH = 16


@dataclass(frozen=True)
class SpikeRule:
    """Parameters of the spike test.

    sparse: smallest sparse part, as a factor over what the low-rank part tells; above: how far over
    the source's normal level a spike lies, as a factor; rank: components of normal behaviour.
    """

    sparse: float = 1.8
    above: float = 3.0
    rank: int = 2
    zero_is_possible: bool = True


def low_rank_and_sparse(m: np.ndarray, known: np.ndarray, rank: int, floor: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The sparse part of ``m``, and how far its first column lies above what the other columns alone tell.

    Sparse is what a low-rank matrix plus column centres leaves over, where it exceeds
    ``floor``. Unknown cells are filled by the current low-rank estimate and never sparse.
    """
    centre = np.nanmedian(np.where(known, m, np.nan), axis=0)
    centre = np.where(np.isfinite(centre), centre, 0.0)
    x = np.where(known, m - centre, 0.0)
    # Begin with everything far above the bulk set aside, so that no component follows a spike.
    bulk = x[known]
    top = np.quantile(bulk, 0.9) if bulk.size else 0.0
    sparse = np.where(x > top + floor, x - top, 0.0)
    low = np.zeros_like(x)
    for _ in range(rounds):
        clean = np.where(known, x - sparse, low)
        _, vectors = np.linalg.eigh(clean.T @ clean)
        basis = vectors[:, -rank:]
        low = clean @ basis @ basis.T
        rest = x - low
        sparse = np.where(known & (rest > floor), rest, 0.0)
    lead = basis[:, -1]
    weight = np.where(known[:, 1:], lead[1:] ** 2, 0.0).sum(axis=1)
    score = np.where(known[:, 1:], x[:, 1:] * lead[1:], 0.0).sum(axis=1) / np.maximum(weight, 1e-9)
    return sparse, np.where(weight > 0, x[:, 0] - score * lead[0], 0.0)


def decimals(v: np.ndarray) -> np.ndarray:
    """Digits after the point with which each value is written, up to 6; 12 beyond."""
    out = np.full(len(v), 12)
    for d in range(6, -1, -1):
        out[np.abs(np.round(v, d) - v) < 1e-9] = d
    return out


def tolerance(high: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How far readings lie apart that differ in the last digit only, bounded by a small share of their size."""
    return np.minimum(2.2 * 10.0 ** -places.astype(float), 0.002 * np.abs(high)) + 1e-12


def stuck(v: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each reading is in a stretch of ``RUN`` or more that stay the same but for the last digit."""
    out = np.zeros(len(v), dtype=bool)
    if len(v) < RUN:
        return out
    win = np.lib.stride_tricks.sliding_window_view(v, RUN)
    pl = np.lib.stride_tricks.sliding_window_view(places, RUN).max(axis=1)
    high, low = win.max(axis=1), win.min(axis=1)
    for at in np.flatnonzero(high - low <= tolerance(high, pl)).tolist():
        out[at : at + RUN] = True
    return out


# what: 0 implausible for certain, 1 spike if far above the level, 2 border of a slice, 3 highest normal reading of a slice.
_OUT = "what int, row_id long, field string, value double, places int, rn long, n long"


def _flag(table: pa.Table, keys: int, fields: Sequence[str], siblings: Sequence[str], rule: SpikeRule, schema: pa.Schema) -> pa.Table:
    ids = table.column("row_id").to_numpy(zero_copy_only=False)
    order_null = table.column("pos").is_null().to_numpy(zero_copy_only=False)
    pos = table.column("pos").fill_null(0).to_numpy(zero_copy_only=False)
    by = np.lexsort((ids, pos, order_null))
    ids, pos, order_null = ids[by], pos[by], order_null[by]
    once = np.append(True, ids[1:] != ids[:-1])
    by, ids, order_null = by[once], ids[once], order_null[once]
    column = {c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[by] for c in {*fields, *siblings}}
    known = {c: ~table.column(c).is_null().to_numpy(zero_copy_only=False)[by] for c in column}
    out: list[list] = [[] for _ in range(7)]

    def put(what: int, at: np.ndarray, field: str, places: np.ndarray | int = 0, rn: np.ndarray | int = 0, n: int = 0) -> None:
        for store, x in zip(out, (what, ids[at], field, column[field][at], places, rn, n)):
            store.append(np.broadcast_to(np.asarray(x), at.shape))

    for field in fields:
        v, ok = column[field], known[field].copy()
        with np.errstate(invalid="ignore"):
            wrong = ok & (~np.isfinite(v) | (v < 0) | ((v == 0) & (not rule.zero_is_possible)))
        put(0, np.flatnonzero(wrong), field)
        # Runs.
        seq = np.flatnonzero(ok & np.isfinite(v) & ~order_null)
        places = decimals(v[seq])
        held = np.flatnonzero(stuck(v[seq], places))
        put(0, seq[held], field)
        edge = np.unique(np.r_[0 : min(RUN - 1, len(seq)), max(0, len(seq) - RUN + 1) : len(seq)]).astype(int)
        put(2, seq[edge], field, places[edge], edge + 1, len(seq))
        # Spikes.
        fine = ok & ~wrong & (v > 0) & ~order_null
        at = np.flatnonzero(fine)
        if len(at) == 0:
            continue
        if siblings:
            names = [field, *siblings]
            with np.errstate(all="ignore"):
                m = np.stack([np.log(column[c]) for c in names], axis=1)[at]
            seen = np.isfinite(m)
            floor = np.log(rule.sparse)
            sparse, beyond = low_rank_and_sparse(np.where(seen, m, 0.0), seen, min(rule.rank, len(names) - 1), floor)
            rest = np.maximum(sparse[:, 0], np.where(beyond > floor, beyond, 0.0))
        else:
            width = min(_WIDTH, max(2, len(at) // 4))
            rows = -(-len(at) // width)
            flat = np.zeros(rows * width)
            seen = np.zeros(rows * width, dtype=bool)
            flat[: len(at)], seen[: len(at)] = np.log(v[at]), True
            rest = low_rank_and_sparse(flat.reshape(rows, width), seen.reshape(rows, width), min(rule.rank, width - 1), np.log(rule.sparse))[0].ravel()[: len(at)]
        put(1, at[rest > 0], field)
        normal = at[rest <= 0]
        if len(normal):
            put(3, normal[[int(np.argmax(v[normal]))]], field)
    parts = [np.concatenate(x) if x else np.empty(0) for x in out]
    n = len(parts[0])
    arrays = [pa.array([table.column(k)[0].as_py()] * n, type=schema.field(k).type) for k in range(keys)]
    kinds = [schema.field(keys + k).type for k in range(7)]
    arrays += [pa.array(p.tolist() if pa.types.is_string(t) else p, type=t) for p, t in zip(parts, kinds)]
    return pa.Table.from_arrays(arrays, schema=schema)


def sliced_rows(df: DataFrame, row_id: str, position: str, source: Sequence[Column], wanted: Sequence[str], slice_bits: int) -> tuple[list[str], DataFrame]:
    """The names of the source columns, and source, slice, row_id, pos and the wanted columns of all rows with a row_id."""
    keys = [f"s{k}" for k in range(len(source))]
    nameless = F.lit(False)
    for c in source:
        nameless = nameless | c.isNull()
    number, place = F.col(row_id).cast("long"), F.col(position).cast("long")
    return keys, df.select(
        *[c.cast("string").alias(k) for c, k in zip(source, keys)],
        F.shiftright(F.when(nameless, number).otherwise(F.coalesce(place, number)), slice_bits).alias("slice"),
        number.alias("row_id"),
        F.when(place.isNotNull(), F.when(nameless, number).otherwise(place)).alias("pos"),
        *[F.col(c).cast("double").alias(c) for c in wanted],
    ).where(F.col("row_id").isNotNull())


def implausible(
    df: DataFrame,
    *,
    row_id: str,
    position: str,
    source: Sequence[Column],
    fields: Sequence[str],
    siblings: Sequence[str] = (),
    rule: SpikeRule = SpikeRule(),
    slice_bits: int = 13,
) -> DataFrame:
    """row_id, field of every implausible reading in ``fields``.

    ``source`` gives the columns that name a source; readings follow one another by
    ``position`` within it. A reading is implausible when it is negative, NaN or infinite (zero too,
    where the rule says so), when it is one of ``RUN`` or more successive readings that
    stay the same but for the last digit, or when it is a spike (see the module). Null
    readings are skipped; a row without position is tested for value only; a row without
    row_id is left out. Rows repeating a row_id and position count once. Rows with a null in a source column
    are a source of their own, in order of row_id. Slices hold 2**slice_bits positions, or row_ids
    where a row has no position or no source, so neither gathers rows in a task. The table is read
    once. An empty table gives an empty result.
    """
    keys, base = sliced_rows(df, row_id, position, source, list(dict.fromkeys([*fields, *siblings])), slice_bits)
    schema = ", ".join([*[f"{k} string" for k in keys], "slice long", _OUT])
    arrow = pa.schema(
        [*[(k, pa.string()) for k in keys], ("slice", pa.int64()), ("what", pa.int32()), ("row_id", pa.int64()), ("field", pa.string()), ("value", pa.float64()), ("places", pa.int32()), ("rn", pa.int64()), ("n", pa.int64())]
    )
    n_keys = len(keys) + 1

    def flag(table: pa.Table) -> pa.Table:
        return _flag(table, n_keys, fields, siblings, rule, arrow)

    found = cut(base.groupBy(*keys, "slice").applyInArrow(flag, schema))
    certain = found.where("what = 0").select("row_id", "field")

    # Runs across slice borders, from the outermost rows of each slice.
    along = Window.partitionBy(*keys, "field").orderBy("slice", "rn")
    ahead, back = along.rowsBetween(0, RUN - 1), along.rowsBetween(-(RUN - 1), 0)
    follows = F.when(F.col("slice") == F.lag("slice").over(along), F.col("rn") == F.lag("rn").over(along) + 1).otherwise(
        (F.col("rn") == 1) & (F.lag("rn").over(along) == F.lag("n").over(along))
    )
    edges = (
        found.where("what = 2")
        .withColumn("joined", F.coalesce(follows, F.lit(False)).cast("int"))
        .withColumn("high", F.max("value").over(ahead))
        .withColumn("low", F.min("value").over(ahead))
        .withColumn("most", F.max("places").over(ahead))
        .withColumn("links", F.sum("joined").over(along.rowsBetween(1, RUN - 1)))
        .withColumn(
            "begins",
            (F.col("links") == RUN - 1)
            & (F.col("high") - F.col("low") <= F.least(2.2 * F.pow(F.lit(10.0), -F.col("most")), 0.002 * F.abs("high")) + 1e-12),
        )
        .withColumn("held", F.max(F.coalesce("begins", F.lit(False)).cast("int")).over(back))
        .where("held = 1")
        .select("row_id", "field")
    )

    level = (
        found.where("what = 3")
        .groupBy(*keys, "field")
        .agg(F.max("value").alias("level"))
        .withColumnsRenamed({k: f"u_{k}" for k in keys} | {"field": "u_field"})
    )
    same = F.col("field") == F.col("u_field")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"u_{k}"))
    spikes = found.where("what = 1").join(level, same).where(F.col("value") > rule.above * F.col("level")).select("row_id", "field")
    return certain.unionByName(edges).unionByName(spikes).distinct()


ARM_RULE = SpikeRule()
PEAK_RULE = SpikeRule(sparse=2.0, above=3.05, rank=1, zero_is_possible=False)
PEAK_SIBLINGS = ("elbow_peak_speed", "hand_mean_speed", "hand_submovement_peak_max", "hand_peak_acceleration")


def implausible_arm(arm: DataFrame) -> DataFrame:
    """row_id, field of implausible speeds and accelerations; a source is a track and limb, in order of frames."""
    return implausible(
        arm, row_id="reading_id", position="frame_idx", source=[F.col("track_id"), F.col("limb")], fields=("speed", "acceleration"), rule=ARM_RULE
    )


def implausible_peaks(features: DataFrame) -> DataFrame:
    """row_id, field of implausible peak speeds; a source is a video in any spelling, in order of rec_id."""
    return implausible(
        features,
        row_id="rec_id",
        position="rec_id",
        source=[video_key(F.col("video_id"))],
        fields=("hand_peak_speed",),
        siblings=PEAK_SIBLINGS,
        rule=PEAK_RULE,
    )
