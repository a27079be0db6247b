"""Cleaning, validation and audits.  Audits return rows, never collect them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.names import is_service_vehicle
from lapwing.functions.status import count_if

# Columns known only after the race.
POST_RACE_COLUMNS = ("ActualFinish", "Position", "Points", "Status", "Laps", "Time", "ClassifiedPosition")

_QUALI_FEATURES = [
    "QualifyingPosition", "quali_pos_norm", "quali_gap_pct", "quali_no_time", "q1_gap_pct", "q2_gap_pct",
    "q3_gap_pct", "teammate_quali_gap_pct",
]
_GRID_FEATURES = [
    "GridPosition", "ActualStartingGrid", "simulation_start_rank", "is_pit_lane_start", "StartingGridStatus",
    "GridPenalty", "grid_penalty_places", "grid_vs_quali_delta", "grid_norm", "expected_grid_finish",
    "grid_retention_prob", "teammate_grid_delta",
]
_SPRINT_FEATURES = ["sprint_quali_pos", "sprint_finish_pos", "sprint_pos_delta"]
_PRACTICE_FEATURES = [
    "fp1_best_lap", "fp2_best_lap", "fp3_best_lap", "best_practice_lap", "avg_practice_lap", "practice_gap_pct",
    "practice_rank", "practice_laps", "practice_laps_norm", "practice_sessions", "fp1_gap_pct", "fp2_gap_pct",
    "fp3_gap_pct",
]
_RUNNING_FEATURES = [
    "long_run_pace_gap_pct", "long_run_pace_rank", "race_pace_consistency", "race_pace_sample_count",
    "long_run_stint_length", "race_pace_confidence", "soft_tyre_deg_rate", "medium_tyre_deg_rate",
    "hard_tyre_deg_rate", "estimated_tyre_deg_rate", "compound_pace_delta", "tyre_deg_confidence",
    "optimal_strategy_stops", "strategy_time_loss_sec", "wet_conditions_indicator", "weather_confidence",
]
_SUNDAY = _QUALI_FEATURES + _GRID_FEATURES + ["race_pace_vs_quali_delta"]
_LATER_PRACTICE = ["fp2_best_lap", "fp3_best_lap", "fp2_gap_pct", "fp3_gap_pct"]

# Features not yet known at each stage, and sessions already run.
STAGE_HIDDEN: dict[str, list[str]] = {
    "pre_fp1": _PRACTICE_FEATURES + _SPRINT_FEATURES + _SUNDAY + _RUNNING_FEATURES,
    "after_fp1": _LATER_PRACTICE + _SPRINT_FEATURES + _SUNDAY,
    "after_sprint_qualifying": _LATER_PRACTICE + _SPRINT_FEATURES[1:] + _SUNDAY,
    "after_sprint_race": _LATER_PRACTICE + _SUNDAY,
    "after_sprint": _LATER_PRACTICE + _SUNDAY,
    "after_fp2": ["fp3_best_lap", "fp3_gap_pct"] + _SPRINT_FEATURES + _SUNDAY,
    "after_fp3": _SPRINT_FEATURES + _SUNDAY,
    "after_qualifying": [],
    "before_race": [],
    "post_race": [],
}
STAGE_SESSIONS: dict[str, tuple[str, ...]] = {
    "pre_fp1": (),
    "after_fp1": ("fp1",),
    "after_fp2": ("fp1", "fp2"),
    "after_fp3": ("fp1", "fp2", "fp3"),
    "after_sprint_qualifying": ("fp1", "sprint_qualifying"),
    "after_sprint_race": ("fp1", "sprint_qualifying", "sprint_race"),
    "after_sprint": ("fp1", "sprint_qualifying", "sprint_race"),
}


def drop_service_vehicles(rows: DataFrame, session: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Removes safety, medical and test cars; renumbers ``position`` only in sessions that lost a row.

    Rows need code, broadcast_name, full_name, team, number and position.
    """
    bad = is_service_vehicle(*[F.col(c) for c in ("code", "broadcast_name", "full_name", "team", "number")])
    whole = Window.partitionBy(*session)
    flagged = rows.withColumn("_bad", bad).withColumn("_lost", F.max(F.col("_bad").cast("int")).over(whole))
    kept = flagged.where(~F.col("_bad"))
    has = F.col("position").isNotNull()
    renumbered = F.sum(has.cast("long")).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn(
        "position", F.when((F.col("_lost") == 1) & has, renumbered).otherwise(F.col("position"))
    ).drop("_bad", "_lost")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """De-duplicates on ``keys``, keeping the smallest row by ``order`` (ascending, nulls first).

    An aggregate, not a window: copies are dropped on the map side, so a key with
    very many copies never reaches one task as rows.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    ranked = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(ranked.alias("_m")).select(*keys, "_m.row.*").select(*df.columns)


def stage_gate(sessions: DataFrame, stages: DataFrame) -> DataFrame:
    """Sessions visible at each row's stage: a semi join to the (stage, session) dimension."""
    return sessions.join(stages, ["stage", "session"], "left_semi")


def stage_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(st, s) for st, ss in STAGE_SESSIONS.items() for s in ss], "stage string, session string")


def mask_stage(df: DataFrame, stage: str | Column) -> DataFrame:
    """Nulls the features that are not known at a stage (a literal stage or a column)."""
    if isinstance(stage, str):
        hidden = set(STAGE_HIDDEN.get(stage.lower().strip(), []))
        return df.select(*[F.lit(None).cast(t).alias(c) if c in hidden else F.col(c) for c, t in df.dtypes])
    key = F.lower(F.trim(stage))
    out = []
    for c, t in df.dtypes:
        at = [s for s, cols in STAGE_HIDDEN.items() if c in cols]
        out.append(F.when(key.isin(*at), F.lit(None).cast(t)).otherwise(F.col(c)).alias(c) if at else F.col(c))
    return df.select(*out)


def forbidden_columns(columns: Iterable[str], stage: str = "after_qualifying") -> list[str]:
    """Post-race columns present in a target table (a check of the schema, no job)."""
    return [] if stage == "post_race" else [c for c in POST_RACE_COLUMNS if c in set(columns)]


def leakage_audit(training: DataFrame, scope: Sequence[str], target_round: Column | int) -> DataFrame:
    """Per scope: rows from the target round, from later rounds, and with more history than is possible."""
    target = target_round if isinstance(target_round, Column) else F.lit(target_round)
    r, done = F.col("rnd"), F.col("races_completed")
    out = training.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("training_rows"),
        count_if(r == target).alias("target_round_rows"),
        F.countDistinct(F.when(r > target, r)).alias("future_rounds"),
        count_if(done > r - 1).alias("impossible_history_rows"),
    )
    clean = (F.col("target_round_rows") == 0) & (F.col("future_rounds") == 0) & (F.col("impossible_history_rows") == 0)
    return out.withColumn("is_clean", clean)


def training_check(training: DataFrame, scope: Sequence[str], field_size: int) -> DataFrame:
    """Rows with impossible history or a start slot outside 1..n, per scope."""
    g = F.col("GridPosition")
    out = training.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col("races_completed") > F.col("rnd") - 1).alias("impossible_history_rows"),
        count_if((g < 1) | (g > field_size)).alias("grid_out_of_range"),
    )
    return out.withColumn("ok", (F.col("impossible_history_rows") == 0) & (F.col("grid_out_of_range") == 0))


# Columns a training set must have.
TRAINING_COLUMNS = ("rnd", "entity", "ActualFinish", "GridPosition")


def training_errors(training: DataFrame, field_size: int) -> DataFrame:
    """What is wrong with a training set, one row an error: ``error, rows``.  No row means it can be used.

    An empty set and absent columns are errors; checks whose columns are absent are left out.
    """
    have = set(training.columns)
    found = [F.struct(F.lit(f"missing column {c}").alias("error"), F.lit(0).cast("long").alias("rows")) for c in TRAINING_COLUMNS if c not in have]
    tests = {}
    if {"rnd", "races_completed"} <= have:
        tests["impossible history"] = count_if(F.col("races_completed") > F.col("rnd") - 1)
    if "GridPosition" in have:
        slot = F.col("GridPosition").try_cast("double")
        tests["grid position out of range"] = count_if((slot < 1) | (slot > field_size))
    row = training.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"t{i}") for i, c in enumerate(tests.values())])
    empty = F.struct(F.lit("empty training set").alias("error"), F.lit(0).cast("long").alias("rows"))
    counted = [F.when(F.col(f"t{i}") > 0, F.struct(F.lit(name).alias("error"), F.col(f"t{i}").alias("rows"))) for i, name in enumerate(tests)]
    errors = F.when(F.col("n") == 0, F.array(empty)).otherwise(F.array_compact(F.array(*found, *counted) if found or counted else F.array(F.lit(None).cast("struct<error:string,rows:bigint>"))))
    return row.select(F.inline(errors))


def permutation_check(rows: DataFrame, race: Sequence[str], who: str, grid: str, expected: Column | None = None) -> DataFrame:
    """Field size, unique entrants, and whether the start slots are exactly 1..n."""
    n = F.count(F.lit(1))
    want = expected if expected is not None else n
    g = F.col(grid)
    exact = (F.count(g) == n) & (F.countDistinct(g) == n) & (F.min(g) == 1) & (F.max(g) == n)
    out = rows.groupBy(*race).agg(
        n.alias("entrants"),
        F.countDistinct(who).alias("unique_entrants"),
        F.coalesce(exact, F.lit(False)).alias("is_permutation"),
        (n == want).alias("size_ok"),
    )
    ok = F.col("size_ok") & F.col("is_permutation") & (F.col("entrants") == F.col("unique_entrants"))
    return out.withColumn("ok", ok)


FORECAST_NOT_NULL = (
    "ExpectedFinish", "MedianFinish", "WinProbability", "Top3Probability", "Top5Probability", "PointsProbability",
    "PredictedPosition", "P5", "P25", "P50", "P75", "P95",
)
FORECAST_PROBABILITIES = ("WinProbability", "Top3Probability", "Top5Probability", "PointsProbability")


def forecast_audit(forecast: DataFrame, race: Sequence[str], who: str, min_rows: int = 10) -> DataFrame:
    """Size, uniqueness, nulls among starters, probability bounds and contiguous ranks, per race."""
    active = ~F.coalesce(F.col("StartingGridStatus").isin("DNS", "DSQ"), F.lit(False))
    missing = [F.col(c).isNull() for c in FORECAST_NOT_NULL if c in forecast.columns]
    outside = [(F.col(c) < -1e-5) | (F.col(c) > 100 + 1e-5) for c in FORECAST_PROBABILITIES if c in forecast.columns]
    any_of = lambda cs: F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs])
    pos = F.when(active, F.col("PredictedPosition"))
    out = forecast.groupBy(*race).agg(
        F.count(F.lit(1)).alias("entrants"),
        F.countDistinct(who).alias("unique_entrants"),
        count_if(active).alias("starters"),
        count_if(active & any_of(missing)).alias("null_rows"),
        count_if(any_of(outside)).alias("probability_rows"),
        F.countDistinct(pos).alias("_d"),
        F.min(pos).alias("_lo"),
        F.max(pos).alias("_hi"),
    )
    n = F.col("starters")
    ranks = (n == 0) | ((F.col("_d") == n) & (F.col("_lo") == 1) & (F.col("_hi") == n))
    good = (
        (F.col("entrants") >= min_rows)
        & (F.col("entrants") == F.col("unique_entrants"))
        & (F.col("null_rows") == 0)
        & (F.col("probability_rows") == 0)
        & F.coalesce(ranks, F.lit(False))
    )
    return out.withColumn("ranks_ok", F.coalesce(ranks, F.lit(False))).withColumn("ok", good).drop("_d", "_lo", "_hi")


def check_session(
    rows: DataFrame, keys: Sequence[str], expected_season: Column, expected_round: Column
) -> tuple[DataFrame, DataFrame]:
    """Splits session rows into accepted and quarantined (with a reason); accepted rows are de-duplicated."""
    reason = (
        F.when(F.coalesce(F.trim(F.col("driver")), F.lit("")) == "", "no driver")
        .when(F.col("position").isNull(), "no position")
        .when((F.col("season") != expected_season) | (F.col("rnd") != expected_round), "wrong event")
    )
    marked = rows.withColumn("reason", reason)
    good = keep_first(marked.where(F.col("reason").isNull()).drop("reason"), keys, [F.col("position"), F.col("driver")])
    return good, marked.where(F.col("reason").isNotNull())


def stamp(rows: DataFrame, source: str, collected_at: Column, **values) -> DataFrame:
    """Lineage columns."""
    cols = {k: F.lit(v) for k, v in values.items()}
    return rows.withColumns(cols | {"data_source": F.lit(source), "collected_at": collected_at})


def feature_inventory(df: DataFrame, features: Sequence[str], groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Missing share, constant flag, type, group and stages of every feature: one aggregate row, then unpivoted.

    Features the table doesn't have are wholly missing; those of no group are ``Other``.

    A feature is constant when its smallest and largest values agree, which needs
    no distinct set in memory.
    """
    df = df.withColumns({f: F.lit(None).cast("double") for f in features if f not in df.columns})
    group_of = {f: g for g, own in (groups or {}).items() for f in own}
    types = dict(df.dtypes)
    aggs = []
    for f in features:
        aggs += [
            F.avg(F.col(f).isNull().cast("double")).alias(f"{f}__missing"),
            F.coalesce(F.min(f).eqNullSafe(F.max(f)), F.lit(True)).alias(f"{f}__constant"),
        ]
    wide = df.agg(*aggs)
    stages = lambda f: ",".join(s for s, cols in STAGE_HIDDEN.items() if f not in cols)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(types[f]).alias("dtype"),
                (F.col(f"{f}__missing") * 100.0).alias("missing_pct"),
                F.col(f"{f}__constant").alias("is_constant"),
                F.lit(stages(f)).alias("stages"),
                F.lit(group_of.get(f, "Other")).alias("feature_group"),
            )
            for f in features
        ]
    )
    return wide.select(F.inline(rows))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    a = left.select(*keys).distinct()
    b = right.select(*keys).distinct()
    only_left = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return only_left.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))
