"""Feature matrix, stage masking, audits and cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import lapwing.queries.form  # noqa: F401
import lapwing.queries.stints  # noqa: F401
import lapwing.queries.weekend  # noqa: F401
from lapwing.operators import quality
from lapwing.plans import features
from lapwing.queries.registry import REGISTRY, query, r6, shown
from lapwing.queries.views import ENTRIES, LAPS, QUALI, RESULTS, sql
from lapwing.sources import star

RACE = ["series", "rnd"]


def raw_rows(spark, sf):
    """The per-entrant table with every raw column the features need."""
    base = star.with_qualifying(star.with_results(star.entries(spark, sf)))
    race = Window.partitionBy(*RACE)
    sprint = star.is_sprint_round(F.col("rnd"))
    grid = F.row_number().over(race.orderBy(F.col("q1").asc_nulls_last(), "entity"))
    finish = F.row_number().over(race.orderBy(F.desc(F.col("quantity") % 101), "entity"))
    base = base.withColumn("sprint_grid", F.when(sprint, grid)).withColumn("sprint_finish", F.when(sprint, finish))
    base = features.sprint_columns(base, RACE)
    return base


def matrix(spark, sf, with_laps: bool = True, stage: str | None = None):
    rows = raw_rows(spark, sf)
    if not with_laps:
        return features.build(rows, field_size=star.FIELD_SIZE, stage=stage)
    hot = star.hot_stints(spark, sf)
    priors = star.circuit_priors(spark, sf).select("circuit", "deg_multiplier")
    rows = rows.withColumn("circuit", star.circuit_of(F.col("rnd"))).join(priors, "circuit", "left")
    return features.build(rows, field_size=star.FIELD_SIZE, laps=star.laps(spark, sf, hot), hot=hot, stage=stage)


FORM = [
    "races_completed", "avg_finish", "avg_grid", "total_points", "recent_finish", "recent_grid", "recent_points",
    "driver_finish_ewma", "driver_quali_ewma", "driver_dnf_rate",
]
TEAM = ["team_avg_finish", "team_finish_ewma", "team_points", "team_points_rate"]
QUALIFYING = ["quali_pos_norm", "quali_gap_pct", "quali_no_time", "q1_gap_pct", "q2_gap_pct", "q3_gap_pct"]
PRACTICE = [
    "fp1_best_lap", "fp2_best_lap", "fp3_best_lap", "best_practice_lap", "avg_practice_lap", "practice_gap_pct",
    "practice_rank", "practice_laps", "practice_laps_norm", "practice_sessions", "fp1_gap_pct", "fp2_gap_pct", "fp3_gap_pct",
]
SPRINT = ["sprint_quali_pos", "sprint_finish_pos", "sprint_pos_delta"]
PACE = [
    "long_run_pace_gap_pct", "long_run_pace_rank", "race_pace_consistency", "race_pace_sample_count",
    "long_run_stint_length", "race_pace_vs_quali_delta", "race_pace_confidence",
]
WEAR = [
    "soft_tyre_deg_rate", "medium_tyre_deg_rate", "hard_tyre_deg_rate", "estimated_tyre_deg_rate",
    "compound_pace_delta", "tyre_deg_confidence",
]
MATES = ["teammate_quali_gap_pct", "teammate_grid_delta", "driver_teammate_h2h_ratio"]
GRID = [
    "GridPosition", "ActualStartingGrid", "is_pit_lane_start", "grid_norm", "QualifyingPosition", "grid_vs_quali_delta",
    "expected_grid_finish", "grid_retention_prob",
]
MATRIX = [*FORM, *TEAM, *QUALIFYING, *PRACTICE, *SPRINT, *PACE, *WEAR, *MATES, *GRID, "ActualFinish"]


def block(name: str) -> str:
    return f"({REGISTRY[name].sql})"


# Each block is the statement of its own query; only the assembly is new here.
MATRIX_SQL = (
    f"""WITH g AS (
  SELECT *, CASE WHEN grid <= 0 THEN 20 ELSE grid END AS eff FROM {block("results_view")}),
grid AS (
  SELECT g.series, g.rnd, g.entity, g.team, {r6("eff")} AS "GridPosition", {r6("CASE WHEN grid > 0 THEN grid END")} AS "ActualStartingGrid",
    {r6("cast(grid <= 0 AS int)")} AS is_pit_lane_start, {r6("(eff - 1) / 19.0")} AS grid_norm, {r6("qualifying_position")} AS "QualifyingPosition",
    {r6("eff - qualifying_position")} AS grid_vs_quali_delta, expected_grid_finish, grid_retention_prob, {r6("position")} AS "ActualFinish"
  FROM g JOIN {block("qualifying_block")} q USING (series, rnd, entity) JOIN {block("grid_conversion")} c ON c.series = g.series AND c.rnd = g.rnd AND c.slot = g.eff),
matrix AS (
SELECT grid.series, grid.rnd, grid.entity, {", ".join('"' + c + '"' for c in MATRIX)} FROM grid
  JOIN {block("season_form_asof")} f USING (series, rnd, entity)
  JOIN {block("team_form_asof")} t ON t.series = grid.series AND t.rnd = grid.rnd AND t.team = grid.team
  JOIN {block("qualifying_block")} q USING (series, rnd, entity) JOIN {block("practice_block")} p USING (series, rnd, entity)
  JOIN {block("sprint_block")} s USING (series, rnd, entity) JOIN {block("long_run_pace")} l USING (series, rnd, entity)
  JOIN {block("compound_degradation")} w USING (series, rnd, entity) JOIN {block("teammate_quali_gap")} m1 USING (series, rnd, entity)
  JOIN {block("teammate_grid_delta")} m2 USING (series, rnd, entity) JOIN {block("teammate_h2h_shrunk")} m3 USING (series, rnd, entity))
"""
)


@query("feature_matrix", MATRIX_SQL + "SELECT * FROM matrix")
def feature_matrix(spark, sf):
    return shown(matrix(spark, sf).select(*star.KEYS, *MATRIX))


def raw_matrix(spark, sf):
    """Raw rows with the circuit's wear, the lap table and its hot stints."""
    hot = star.hot_stints(spark, sf)
    priors = star.circuit_priors(spark, sf).select("circuit", "deg_multiplier")
    rows = raw_rows(spark, sf).withColumn("circuit", star.circuit_of(F.col("rnd"))).join(priors, "circuit", "left")
    return rows, star.laps(spark, sf, hot), hot


# Stages by what practice they have seen (the last line number that counts), and what else is out by then.
_SEEN = {
    "pre_fp1": 0, "after_fp1": 2, "after_sprint_qualifying": 2, "after_sprint_race": 2, "after_sprint": 2, "after_fp2": 4, "after_fp3": 7,
    "after_qualifying": 7, "before_race": 7, "post_race": 7,
}
_SUNDAY = "stage IN ('after_qualifying', 'before_race', 'post_race')"
_SHOWN = (
    {c: "stage <> 'pre_fp1'" for c in [*PRACTICE, *PACE, *WEAR]}
    | {c: f"stage IN ('after_fp2', 'after_fp3') OR {_SUNDAY}" for c in ("fp2_best_lap", "fp2_gap_pct")}
    | {c: f"stage = 'after_fp3' OR {_SUNDAY}" for c in ("fp3_best_lap", "fp3_gap_pct")}
    | {c: _SUNDAY for c in [*QUALIFYING, *GRID, "race_pace_vs_quali_delta", "teammate_quali_gap_pct", "teammate_grid_delta"]}
    | {"sprint_quali_pos": f"stage LIKE 'after_sprint%' OR {_SUNDAY}"}
    | {c: f"stage IN ('after_sprint_race', 'after_sprint') OR {_SUNDAY}" for c in ("sprint_finish_pos", "sprint_pos_delta")}
)


def _gated(name: str, last: int) -> str:
    """A block's statement over the laps of the first sessions alone; laps keep their numbers."""
    inner = LAPS.strip().removeprefix("laps AS (").removesuffix(")")
    sessions = [s for s, n in (("fp1", 2), ("fp2", 4), ("fp3", 7)) if n <= last]
    kept = " OR ".join(f"session = '{s}'" for s in sessions) or "false"
    return block(name).replace(LAPS, f"\nlaps AS (SELECT * FROM ({inner}) WHERE {kept})")


def _of_view(last: int) -> str:
    own = ", ".join([f'p."{c}"' for c in PRACTICE] + [f'l."{c}"' for c in PACE] + [f'w."{c}"' for c in WEAR])
    return f"""SELECT {last} AS last, p.series, p.rnd, p.entity, {own} FROM {_gated("practice_block", last)} p
  JOIN {_gated("long_run_pace", last)} l USING (series, rnd, entity) JOIN {_gated("compound_degradation", last)} w USING (series, rnd, entity)"""


_OWN = {*PRACTICE, *PACE, *WEAR}
STAGED_SQL = (
    MATRIX_SQL
    + f""", stage AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {n})" for s, n in _SEEN.items())}) v(stage, last)),
view AS ({" UNION ALL ".join(_of_view(n) for n in (0, 2, 4, 7))}),
staged AS (SELECT matrix.series, matrix.rnd, matrix.entity, stage, {", ".join((f"CASE WHEN {_SHOWN[c]} THEN " if c in _SHOWN else "") + ("view" if c in _OWN else "matrix") + f'."{c}"' + (" END" if c in _SHOWN else "") + f' AS "{c}"' for c in MATRIX)}
  FROM matrix JOIN view USING (series, rnd, entity) JOIN stage USING (last))
"""
)


@query("staged_matrix", STAGED_SQL + "SELECT * FROM staged")
def staged_matrix(spark, sf):
    """The matrix at all ten stages, every block built from the sessions its stage has seen."""
    rows, laps, hot = raw_matrix(spark, sf)
    return shown(features.staged_matrix(rows, field_size=star.FIELD_SIZE, laps=laps, hot=hot).select(*star.KEYS, "stage", *MATRIX))


MASK_COLS = ["fp1_gap_pct", "fp2_gap_pct", "fp3_gap_pct", "practice_rank", "sprint_quali_pos", "quali_gap_pct", "GridPosition", "avg_finish"]


@query("stage_mask", STAGED_SQL + f"""SELECT series, rnd, entity, stage, {", ".join('"' + c + '"' for c in MASK_COLS)} FROM staged WHERE stage = {list(_SEEN)}[cast(rnd % 10 AS int) + 1]""")
def stage_mask(spark, sf):
    """Another stage in every round, its practice columns from gated sessions."""
    rows, _, _ = raw_matrix(spark, sf)
    stage = F.element_at(F.array(*[F.lit(s) for s in _SEEN]), (F.col("rnd") % 10 + 1).cast("int"))
    staged = features.staged_matrix(rows, field_size=star.FIELD_SIZE)
    return shown(staged.where(F.col("stage") == stage).select(*star.KEYS, "stage", *MASK_COLS))


@query(
    "stage_gate",
    """WITH l AS (SELECT series, rnd, entity, 'fp1' AS session, fp1_laps AS n, rnd % 5 AS k FROM {e} UNION ALL SELECT series, rnd, entity, 'fp2', fp2_laps, rnd % 5 FROM {e}
  UNION ALL SELECT series, rnd, entity, 'fp3', fp3_laps, rnd % 5 FROM {e})
SELECT series, rnd, session, cast(sum(n) AS bigint) AS laps FROM l WHERE (k = 1 AND session = 'fp1') OR (k = 2 AND session IN ('fp1', 'fp2')) OR k = 3 OR (k = 4 AND session = 'fp1') GROUP BY ALL""".replace(
        "{e}", "(" + sql("SELECT * FROM entries", ENTRIES) + ")"
    ),
)
def stage_gate(spark, sf):
    base = star.entries(spark, sf)
    long = base.select(
        *star.KEYS,
        F.inline(F.array(*[F.struct(F.lit(s).alias("session"), F.col(f"{s}_laps").alias("n")) for s in ("fp1", "fp2", "fp3")])),
    )
    names = ["pre_fp1", "after_fp1", "after_fp2", "after_fp3", "after_sprint_race"]
    stage = F.element_at(F.array(*[F.lit(s) for s in names]), (F.col("rnd") % 5 + 1).cast("int"))
    seen = quality.stage_gate(long.withColumn("stage", stage), quality.stage_dimension(spark))
    return shown(seen.groupBy(*RACE, "session").agg(F.sum("n").alias("laps")))


@query(
    "leakage_audit",
    sql(
        """, t AS (SELECT series, rnd + CASE WHEN series % 3 = 1 AND rnd = 20 THEN 5 ELSE 0 END AS rnd,
    (rnd - 1) + CASE WHEN series % 3 = 2 AND rnd = 4 THEN 1 ELSE 0 END AS done FROM results WHERE rnd < 24)
SELECT series, count(*) AS training_rows, count(*) FILTER (rnd = 24) AS target_round_rows, count(DISTINCT rnd) FILTER (rnd > 24) AS future_rounds,
  count(*) FILTER (done > rnd - 1) AS impossible_history_rows,
  count(*) FILTER (rnd >= 24) = 0 AND count(*) FILTER (done > rnd - 1) = 0 AS is_clean FROM t GROUP BY ALL""",
        RESULTS,
    ),
)
def leakage_audit(spark, sf):
    from lapwing.operators import form

    rows = form.add_driver_form(star.results(spark, sf), ["series", "entity"])
    rows = features.training_rows(rows.withColumn("ActualFinish", F.col("position").cast("double")), 24)
    moved = (F.col("series") % 3 == 1) & (F.col("rnd") == 20)
    early = (F.col("series") % 3 == 2) & (F.col("rnd") == 4)
    rows = rows.withColumn("races_completed", F.col("races_completed") + early.cast("long"))
    rows = rows.withColumn("rnd", F.col("rnd") + F.when(moved, 5).otherwise(0))
    return shown(quality.leakage_audit(rows, ["series"], 24))


@query(
    "training_check",
    sql(
        """SELECT series, count(*) AS rows, cast(0 AS bigint) AS impossible_history_rows, count(*) FILTER (grid < 1 OR grid > 19) AS grid_out_of_range,
  count(*) FILTER (grid < 1 OR grid > 19) = 0 AS ok FROM results GROUP BY ALL""",
        RESULTS,
    ),
)
def training_check(spark, sf):
    rows = star.results(spark, sf).withColumn("GridPosition", F.col("grid")).withColumn("races_completed", F.col("rnd") - 1)
    return shown(quality.training_check(rows, ["series"], 19))


@query(
    "noncompetitor_filter",
    sql(
        """, x AS (SELECT *, (entity + rnd) % 9 = 0 OR (entity * 3 + rnd) % 11 = 0 OR (entity + rnd * 2) % 13 = 0 AS bad FROM results),
l AS (SELECT *, bool_or(bad) OVER (PARTITION BY series, rnd) AS lost FROM x)
SELECT series, rnd, entity, CASE WHEN lost THEN row_number() OVER (PARTITION BY series, rnd ORDER BY position) ELSE position END AS position FROM l WHERE NOT bad""",
        RESULTS,
    ),
)
def noncompetitor_filter(spark, sf):
    e, r = F.col("entity"), F.col("rnd")
    a, b, c = (e + r) % 9 == 0, (e * 3 + r) % 11 == 0, (e + r * 2) % 13 == 0
    rows = star.results(spark, sf).select(
        *star.KEYS,
        "position",
        F.when(a, "sc2 ").otherwise(F.concat(F.lit("D"), e.cast("string"))).alias("code"),
        F.when(b, "Medical Car").otherwise("A Driver").alias("broadcast_name"),
        F.when(c, "None None").otherwise("A Driver").alias("full_name"),
        F.when(c, F.lit(None)).otherwise("Team").alias("team"),
        F.lit(4).alias("number"),
    )
    return shown(quality.drop_service_vehicles(rows, RACE, [F.col("position")]).select(*star.KEYS, "position"))


@query(
    "session_validation",
    sql(
        """, x AS (SELECT series, rnd, entity, CASE WHEN entity % 20 = 5 THEN 'no driver' WHEN (entity + rnd) % 17 = 0 THEN 'no position' WHEN rnd = 13 THEN 'wrong event' END AS reason FROM results)
SELECT series, rnd, coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM x GROUP BY ALL""",
        RESULTS,
    ),
)
def session_validation(spark, sf):
    e, r = F.col("entity"), F.col("rnd")
    rows = star.results(spark, sf).select(
        *star.KEYS,
        F.when(r == 13, r + 1).otherwise(r).alias("stamped_rnd"),
        F.col("season"),
        F.when(e % 20 == 5, " ").otherwise(e.cast("string")).alias("driver"),
        F.when((e + r) % 17 != 0, F.col("position")).alias("position"),
    )
    # every file arrives twice; the second copy must disappear
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    first = quality.keep_first(twice, star.KEYS, [F.col("copy")]).drop("copy")
    good, bad = quality.check_session(first, star.KEYS, F.col("season"), F.col("stamped_rnd"))
    good = quality.stamp(good.withColumn("reason", F.lit("accepted")), "file", F.current_timestamp()).drop("data_source", "collected_at")
    both = good.unionByName(bad)
    return shown(both.groupBy(*RACE, F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))




# columns of whole numbers
WHOLE = {"practice_rank", "practice_laps", "practice_sessions", "quali_no_time", "races_completed", "race_pace_sample_count", "long_run_stint_length", "long_run_pace_rank"}
INVENTORY = [*[c for c in MATRIX if c != "ActualFinish"], "p_safety_car", "p_vsc", "p_red_flag"]  # the last ones aren't in the table
_GROUP_OF = {f: g for g, own in features.FEATURE_GROUPS.items() for f in own}
_STAGES_OF = {c: [s for s in quality.STAGE_HIDDEN if c not in quality.STAGE_HIDDEN[s]] for c in INVENTORY}


@query(
    "feature_inventory",
    MATRIX_SQL
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{"bigint" if c in WHOLE else "double"}' AS dtype, {r6(f'avg(cast("{c}" IS NULL AS int)) * 100' if c in MATRIX else "max(100)")} AS missing_pct, {f'count(DISTINCT "{c}") <= 1' if c in MATRIX else "true"} AS is_constant,
  '{_GROUP_OF.get(c, "Other")}' AS feature_group, {len(_STAGES_OF[c])} AS n_stages FROM matrix"""
        for c in INVENTORY
    ),
)
def feature_inventory(spark, sf):
    """All features of the matrix, and some it doesn't have."""
    out = quality.feature_inventory(matrix(spark, sf), INVENTORY, features.FEATURE_GROUPS)
    return shown(out.withColumn("n_stages", F.size(F.split("stages", ","))).drop("stages"))
