"""Weekend blocks: practice, qualifying and sprint.  Windows never span more than one race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import gap_pct, mean_of, position_norm, rank_where

SESSIONS = ("fp1", "fp2", "fp3")
MIN_LAP_SECONDS = 50.0
PRACTICE_TARGET_LAPS = 70.0


def valid_laps(laps: DataFrame) -> DataFrame:
    """Laps that count: longer than fifty seconds and not deleted."""
    return laps.where((F.col("lap_s") > MIN_LAP_SECONDS) & ~F.coalesce("deleted", F.lit(False)))


def clean_running(laps: DataFrame) -> DataFrame:
    """Drops in-laps and out-laps where the table carries pit columns."""
    for c in ("pit_in", "pit_out"):
        if c in laps.columns:
            laps = laps.where(F.col(c).isNull())
    return laps


def practice_sessions(laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best lap and lap count per session, one row per entrant and race."""
    per = valid_laps(laps).groupBy(*keys, "session").agg(F.min("lap_s").alias("best"), F.count("lap_s").alias("n"))
    wide = per.groupBy(*keys).pivot("session", list(SESSIONS)).agg(F.first("best").alias("best"), F.first("n").alias("n"))
    return wide.select(
        *keys,
        *[F.col(f"{s}_best").alias(f"{s}_best_lap") for s in SESSIONS],
        *[F.col(f"{s}_n").alias(f"{s}_laps") for s in SESSIONS],
    )


def add_practice_features(rows: DataFrame, race: Sequence[str]) -> DataFrame:
    """Gaps, ranks and volumes from the per-session columns; rows are the entry list."""
    field = Window.partitionBy(*race)
    best = [F.col(f"{s}_best_lap") for s in SESSIONS]
    n = [F.coalesce(f"{s}_laps", F.lit(0)) for s in SESSIONS]
    rows = rows.withColumns({f"{s}_laps": c for s, c in zip(SESSIONS, n)})
    rows = rows.withColumns(
        {f"{s}_gap_pct": gap_pct(b, F.min(b).over(field)) for s, b in zip(SESSIONS, best)}
        | {"best_practice_lap": F.least(*best), "avg_practice_lap": mean_of(*best)}
    )
    ordered = field.orderBy(F.col("best_practice_lap").asc_nulls_last())
    laps = sum((F.col(f"{s}_laps") for s in SESSIONS), F.lit(0)).cast("long")
    return rows.withColumns(
        {
            "practice_gap_pct": gap_pct(F.col("best_practice_lap"), F.min("best_practice_lap").over(field)),
            "practice_rank": rank_where(F.col("best_practice_lap"), ordered),
            "practice_laps": laps,
            "practice_laps_norm": laps / F.lit(PRACTICE_TARGET_LAPS),
            "practice_sessions": sum((b.isNotNull().cast("long") for b in best), F.lit(0)).cast("long"),
        }
    )


def practice_block(laps: DataFrame, lineup: DataFrame, keys: Sequence[str], race: Sequence[str]) -> DataFrame:
    return add_practice_features(lineup.join(practice_sessions(laps, keys), list(keys), "left"), race)


def _usable(c: Column) -> Column:
    return F.when(c > MIN_LAP_SECONDS, c)


def add_qualifying_features(rows: DataFrame, race: Sequence[str]) -> DataFrame:
    """Position norm, gap to pole, per-segment gaps and a no-time flag from q1..q3 and q_position."""
    field = Window.partitionBy(*race)
    entrants = F.count(F.lit(1)).over(field)
    n = F.when(entrants > 1, entrants).otherwise(F.lit(22))
    rows = rows.withColumn("best_quali_lap", F.least(*[_usable(F.col(q)) for q in ("q1", "q2", "q3")]))
    return rows.withColumns(
        {
            "quali_pos_norm": position_norm(F.col("q_position"), n),
            "quali_gap_pct": gap_pct(F.col("best_quali_lap"), F.min("best_quali_lap").over(field)),
            "quali_no_time": F.col("best_quali_lap").isNull().cast("long"),
        }
        | {f"{q}_gap_pct": gap_pct(F.col(q), F.min(q).over(field)) for q in ("q1", "q2", "q3")}
    )


def qualifying_block(quali: DataFrame, lineup: DataFrame, keys: Sequence[str], race: Sequence[str]) -> DataFrame:
    """Entrants without a qualifying row keep nulls and the no-time flag."""
    return add_qualifying_features(lineup.join(quali, list(keys), "left"), race)


def sprint_block(
    sprint_quali: DataFrame, sprint_race: DataFrame, lineup: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Sprint qualifying position, sprint finish and places gained; null on ordinary weekends."""
    sq = sprint_quali.select(*keys, F.col("position").cast("double").alias("sprint_quali_pos"))
    sr = sprint_race.select(
        *keys,
        F.col("position").cast("double").alias("sprint_finish_pos"),
        (F.col("grid") - F.col("position")).cast("double").alias("sprint_pos_delta"),
    )
    return lineup.join(sq, list(keys), "left").join(sr, list(keys), "left")
