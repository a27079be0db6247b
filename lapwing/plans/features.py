"""Feature assembly: training and target tables from one builder.

All blocks hang off one per-entrant table laid out by championship, so the
windows share its shuffle and only the lap blocks join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.numbers import position_norm
from lapwing.operators import conversion, form, stints, teammates, weekend
from lapwing.operators.quality import STAGE_HIDDEN, STAGE_SESSIONS, mask_stage
from lapwing.operators.skew import HotGroups
from lapwing.session import cut_lineage

MISSING_GRID = 12.0

# Model inputs by group, and those of the qualifying model.
FEATURE_GROUPS = {
    "grid": ["GridPosition", "grid_norm", "expected_grid_finish", "grid_retention_prob", "is_pit_lane_start"],
    "qualifying": [
        "QualifyingPosition", "quali_pos_norm", "quali_gap_pct", "quali_no_time", "q1_gap_pct", "q2_gap_pct", "q3_gap_pct",
    ],
    "practice": ["practice_gap_pct", "practice_rank", "practice_laps_norm", "fp1_gap_pct", "fp2_gap_pct", "fp3_gap_pct"],
    "driver_form": [
        "driver_finish_ewma", "driver_quali_ewma", "driver_dnf_rate", "recent_finish", "recent_grid", "recent_points",
        "avg_finish", "avg_grid", "total_points", "races_completed",
    ],
    "team_form": ["team_finish_ewma", "team_points_rate", "team_avg_finish", "team_points"],
    "sprint": ["sprint_finish_pos", "sprint_pos_delta"],
    "teammate": ["teammate_quali_gap_pct", "teammate_grid_delta", "driver_teammate_h2h_ratio"],
    "race_pace": ["long_run_pace_gap_pct", "long_run_pace_rank", "race_pace_consistency"],
}
QUALIFYING_FEATURES = [
    "practice_gap_pct", "practice_rank", "practice_laps_norm", "fp1_gap_pct", "driver_quali_ewma",
    "driver_finish_ewma", "driver_dnf_rate", "recent_grid", "avg_grid", "recent_finish", "avg_finish",
    "team_finish_ewma", "team_points_rate", "team_avg_finish", "sprint_quali_pos", "sprint_finish_pos",
    "sprint_pos_delta", "driver_teammate_h2h_ratio",
]
MODEL_FEATURES = [c for own in FEATURE_GROUPS.values() for c in own]


def add_grid_features(rows: DataFrame, field_size: int) -> DataFrame:
    """Start-slot features: a pit-lane start counts as the back, an unknown slot as midfield."""
    n = F.lit(float(field_size))
    pit = F.coalesce(F.col("grid") <= 0, F.lit(False))
    slot = F.when(pit, n).otherwise(F.coalesce(F.col("grid").cast("double"), F.lit(MISSING_GRID)))
    rows = rows.withColumns(
        {
            "GridPosition": slot,
            "ActualStartingGrid": F.when(~pit, F.coalesce(F.col("grid").cast("double"), F.lit(MISSING_GRID))),
            "simulation_start_rank": slot,
            "is_pit_lane_start": pit.cast("double"),
        }
    )
    q = F.coalesce(F.col("q_position").cast("double"), F.col("GridPosition"))
    return rows.withColumns(
        {
            "grid_norm": position_norm(F.col("GridPosition"), field_size),
            "QualifyingPosition": q,
            "grid_vs_quali_delta": F.col("GridPosition") - q,
            "grid_penalty_places": F.lit(0.0),
        }
    )


def lap_blocks(
    base: DataFrame, laps: DataFrame, hot: HotGroups | None, race: Sequence[str]
) -> DataFrame:
    """Race pace per entrant, and tyre wear where ``base`` carries a circuit ``deg_multiplier``."""
    keys = [*race, "entity"]
    found = stints.stint_summary(laps, keys + ["stint", "compound"], hot=hot)
    out = stints.long_run_pace(found, keys).select(
        *keys, "fuel_adj_pace", "race_pace_consistency", "race_pace_sample_count", "long_run_stint_length"
    )
    if "deg_multiplier" in base.columns:
        lineup = base.select(*keys, "team", "deg_multiplier")
        out = stints.compound_wear(laps, lineup, race, hot=hot).join(out, keys, "left")
    return out


def _scope(scope: str | Sequence[str]) -> list[str]:
    return [scope] if isinstance(scope, str) else list(scope)


def _timeless(base: DataFrame, scope: list[str], field_size: int) -> DataFrame:
    """The blocks that no practice session changes: qualifying, grid, form, teammates, conversion, sprint."""
    race, who = [*scope, "rnd"], [*scope, "entity"]
    keys = [*race, "entity"]
    history = base.select(*keys, "team", "position", "grid", "points", "status")
    out = weekend.add_qualifying_features(base, race)
    out = add_grid_features(out, field_size)
    out = form.add_driver_form(out, who)
    out = teammates.add_quali_gap(out, [*race, "team"])
    out = teammates.add_grid_delta(out, [*race, "team"])
    out = conversion.add_conversion(out, history, scope, "GridPosition", field_size)
    out = out.join(form.team_form(history, [*scope, "team"]), [*race, "team"], "left")
    out = out.join(teammates.h2h(history, scope), keys, "left")
    for c in ("sprint_quali_pos", "sprint_finish_pos", "sprint_pos_delta"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.withColumn("ActualFinish", F.col("position").cast("double"))


def build(
    rows: DataFrame,
    series: str | Sequence[str] = "series",
    field_size: int = 20,
    laps: DataFrame | None = None,
    hot: HotGroups | None = None,
    stage: str | None = None,
) -> DataFrame:
    """One row per entrant and round with every feature, leakage-free.

    ``series`` are the columns that name a championship; with a season among them, form and history start anew with each.
    ``rows`` holds the raw per-entrant columns (results, qualifying segments,
    practice sessions, optionally sprint columns).  It feeds several blocks, so it is written once instead of being derived
    per block; the lap blocks read one exchange of the laps.
    ``ActualFinish`` is the label.
    """
    scope = _scope(series)
    race = [*scope, "rnd"]
    keys = [*race, "entity"]
    if stage:
        rows = gate_practice(rows, stage)
        laps = gate_laps(laps, stage) if laps is not None else None
    base = cut_lineage(rows)
    out = _timeless(weekend.add_practice_features(base.repartition(*scope), race), scope, field_size)
    if laps is not None:
        out = out.join(lap_blocks(base, laps, hot, race), keys, "left")
        out = stints.add_race_pace(out, race, "q_position")
    return mask_stage(out, stage) if stage else out


ALL_STAGES = tuple(STAGE_HIDDEN)


def _views(stages: Sequence[str]) -> list[tuple[tuple[str, ...], list[str]]]:
    """The different sets of practice sessions that stages see, each with its stages."""
    found: dict[tuple[str, ...], list[str]] = {}
    for stage in stages:
        seen = STAGE_SESSIONS.get(stage.lower().strip(), weekend.SESSIONS)
        found.setdefault(tuple(s for s in weekend.SESSIONS if s in seen), []).append(stage)
    return list(found.items())


def staged_matrix(
    rows: DataFrame,
    series: str | Sequence[str] = "series",
    field_size: int = 20,
    laps: DataFrame | None = None,
    hot: HotGroups | None = None,
    stages: Sequence[str] = ALL_STAGES,
) -> DataFrame:
    """The matrix as it could be known at each stage: one row per entrant, round and ``stage``.

    All stages come from one plan.  What no practice session changes is built once.  Stages that have seen the same practice
    sessions share a view: practice columns and laps are gated by view before any gap, rank, stint or slope is taken from them,
    and laps are read once for all views.  The rows of a view then become rows of its stages, and what isn't known yet at a
    stage is hidden.
    """
    scope = _scope(series)
    race = [*scope, "rnd"]
    keys = [*race, "entity"]
    views = _views(stages)
    base = cut_lineage(rows)
    out = _timeless(base.repartition(*scope), scope, field_size)

    seen = {s: [i for i, (sessions, _) in enumerate(views) if s in sessions] for s in weekend.SESSIONS}
    raw = [f"{s}_{c}" for s in weekend.SESSIONS for c in ("best_lap", "laps")]
    at = F.explode(F.array(*[F.lit(i) for i in range(len(views))]))
    practice = base.select(*keys, *raw, *[c for c in ("team", "q_position", "deg_multiplier") if c in base.columns]).withColumn("view", at)
    practice = practice.withColumns({c: F.when(F.col("view").isin(seen[c[:3]]), F.col(c)) for c in raw})
    own = weekend.add_practice_features(practice, [*race, "view"])
    if laps is not None:
        open_to = F.coalesce(*[F.when(F.col("session") == s, F.array(*[F.lit(i) for i in v])) for s, v in seen.items() if v], F.array().cast("array<int>"))
        gated = laps.withColumn("view", F.explode(open_to))
        if hot is not None:  # a hot stint is hot in every view that sees any of it: sizes are upper bounds
            hot = HotGroups([*hot.keys, "view"], hot.frame.withColumn("view", at), hot.limit)
        own = own.join(lap_blocks(practice, gated, hot, [*race, "view"]), [*race, "view", "entity"], "left")
        own = stints.add_race_pace(own, [*race, "view"], "q_position")
    both = out.drop(*[c for c in own.columns if c not in keys]).join(own, keys)
    names = F.coalesce(*[F.when(F.col("view") == i, F.array(*[F.lit(s) for s in own_stages])) for i, (_, own_stages) in enumerate(views)])
    return mask_stage(both.withColumn("stage", F.explode(names)).drop("view"), F.col("stage"))


def gate_practice(rows: DataFrame, stage: str) -> DataFrame:
    """Nulls what practice sessions that haven't run at a stage would say, before any block is built from them."""
    seen = STAGE_SESSIONS.get(stage.lower().strip())
    if seen is None:
        return rows
    late = [f"{s}_{c}" for s in weekend.SESSIONS if s not in seen for c in ("best_lap", "laps")]
    return rows.select(*[F.lit(None).cast(t).alias(c) if c in late else F.col(f"`{c}`") for c, t in rows.dtypes])


def gate_laps(laps: DataFrame, stage: str) -> DataFrame:
    """Laps of the sessions that have run at a stage; laps that name no session belong to none that has."""
    seen = STAGE_SESSIONS.get(stage.lower().strip())
    if seen is None:
        return laps
    return laps.where(F.col("session").isin(*seen)) if seen and "session" in laps.columns else laps.where(F.lit(False))


def sprint_columns(rows: DataFrame, race: Sequence[str]) -> DataFrame:
    """Sprint features for tables that carry sprint_grid and sprint_finish."""
    return rows.withColumns(
        {
            "sprint_quali_pos": F.col("sprint_grid").cast("double"),
            "sprint_finish_pos": F.col("sprint_finish").cast("double"),
            "sprint_pos_delta": (F.col("sprint_grid") - F.col("sprint_finish")).cast("double"),
        }
    )


def training_rows(features: DataFrame, target_round: int) -> DataFrame:
    return features.where((F.col("rnd") < target_round) & F.col("ActualFinish").isNotNull())


def target_rows(features: DataFrame, target_round: int, keep: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """The round to forecast, without the label or any post-race column."""
    cols = [c for c in ("series", "rnd", "entity", "team", "simulation_start_rank") if c in features.columns]
    return features.where(F.col("rnd") == target_round).select(*cols, *[c for c in keep if c not in cols])


def target_qualifying_label(rows: DataFrame, field_size: int) -> DataFrame:
    """Label of the qualifying model: the qualifying position, else a positive grid slot, else the field size."""
    grid = F.when(F.col("grid") > 0, F.col("grid"))
    return rows.withColumn("TargetQualifyingPosition", F.coalesce(F.col("q_position"), grid, F.lit(field_size)).cast("double"))

