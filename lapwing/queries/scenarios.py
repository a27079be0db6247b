"""Finish distributions from replayed residuals, and pit plans."""

from __future__ import annotations

from pyspark.sql import functions as F

import lapwing.queries.stints  # noqa: F401
from lapwing.operators import conditions, pit_plans, replay
from lapwing.queries.features import block
from lapwing.queries.metrics import PREDS, prediction_table
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import CIRCUITS, sql
from lapwing.sources import star

RACE = ["series", "rnd"]


def scored(spark, sf):
    """Scored entrants of every race, what became of them, and who didn't start."""
    status = star.results(spark, sf).select(*star.KEYS, "status")
    rows = prediction_table(spark, sf).join(status, star.KEYS)
    st = F.when(F.col("status") == "Did not start", "DNS").when(F.col("status") == "Disqualified", "DSQ").otherwise("CLASSIFIED")
    return rows.select(*star.KEYS, F.col("rf").alias("score"), "actual", F.col("status").isin("Engine", "Collision").alias("out"), st.alias("StartingGridStatus"), "status")


def history(rows):
    return replay.residuals(rows, RACE, retired="out")


REPLAY = f"""
h AS (SELECT p.series, p.rnd, p.entity, rf AS score, actual - rf AS residual, coalesce(status IN ('Engine', 'Collision'), false) AS retired, status FROM preds p JOIN {block("results_view")} r USING (series, rnd, entity)),
starters AS (SELECT * FROM h WHERE {{0}}),
races AS (SELECT DISTINCT series, rnd FROM h),
sc AS (
  SELECT e.series, e.rnd, e.entity, e.score, k.rnd AS scenario FROM starters e JOIN races k ON k.series = e.series AND k.rnd < e.rnd
  UNION ALL SELECT e.series, e.rnd, e.entity, e.score, -1 FROM starters e WHERE NOT EXISTS (SELECT 1 FROM races k WHERE k.series = e.series AND k.rnd < e.rnd)),
raced AS (SELECT sc.*, sc.score + coalesce(b.residual, 0) AS raw, coalesce(b.retired, false) AS retired FROM sc LEFT JOIN h b ON b.series = sc.series AND b.rnd = scenario AND b.entity = sc.entity),
fin AS (SELECT *, row_number() OVER (PARTITION BY series, rnd, scenario ORDER BY round(raw + CASE WHEN retired THEN 1000 ELSE 0 END, 9), entity) AS finish FROM raced)"""
_STARTED = "status IS NULL OR status NOT IN ('Did not start', 'Disqualified')"

_DISTRIBUTION = f"""d AS (SELECT series, rnd, entity, avg(finish) AS x, median(finish) AS m, 100.0 * avg(cast(finish = 1 AS int)) AS w, 100.0 * avg(cast(finish <= 3 AS int)) AS t3,
  100.0 * avg(cast(finish <= 5 AS int)) AS t5, 100.0 * avg(cast(finish <= 10 AS int)) AS t10, quantile_cont(finish, 0.05) AS p5, quantile_cont(finish, 0.25) AS p25, quantile_cont(finish, 0.75) AS p75, quantile_cont(finish, 0.95) AS p95, count(*) AS scenarios FROM fin GROUP BY ALL)
SELECT e.series, e.rnd, e.entity, {r6("x")} AS "ExpectedFinish", cast(floor(m) AS bigint) AS "MedianFinish", {r6("coalesce(w, 0)")} AS "WinProbability", {r6("coalesce(t3, 0)")} AS "Top3Probability",
  {r6("coalesce(t5, 0)")} AS "Top5Probability", {r6("coalesce(t10, 0)")} AS "PointsProbability", cast(floor(p5) AS bigint) AS "P5", cast(floor(p25) AS bigint) AS "P25", cast(floor(m) AS bigint) AS "P50",
  cast(floor(p75) AS bigint) AS "P75", cast(floor(p95) AS bigint) AS "P95", scenarios, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY e.series, e.rnd ORDER BY x NULLS LAST, e.entity) END AS "PredictedPosition"
FROM h e LEFT JOIN d USING (series, rnd, entity)"""


@query("residual_distribution", f"WITH {PREDS}, {REPLAY.format('true')}, {_DISTRIBUTION}")
def residual_distribution(spark, sf):
    """Every race of every championship, forecast from the residuals of the races before it."""
    rows = scored(spark, sf).drop("StartingGridStatus")
    return shown(replay.finish_distribution(rows.select(*star.KEYS, "score"), history(rows)))


@query("rank_distribution", f"WITH {PREDS}, {REPLAY.format(_STARTED)}, {_DISTRIBUTION}")
def rank_distribution(spark, sf):
    """As above, without those who don't start; they come back with zero chances."""
    rows = scored(spark, sf)
    return shown(replay.finish_distribution(rows.select(*star.KEYS, "score", "StartingGridStatus"), history(rows)))


def _incidents(rows):
    """What interrupted each race, as a share that its field keeps of its gaps: crashes more than failures."""
    kind = F.max(F.when(F.col("status") == "Collision", 2).when(F.col("status") == "Engine", 1).otherwise(0))
    return rows.groupBy("series", F.col("rnd").alias("scenario")).agg(kind.alias("incident"))


@query(
    "field_compression",
    f"""WITH {PREDS}, {REPLAY.format(_STARTED)},
inc AS (SELECT series, rnd AS scenario, max(CASE status WHEN 'Collision' THEN 2 WHEN 'Engine' THEN 1 ELSE 0 END) AS incident FROM h GROUP BY ALL),
fld AS (SELECT r.*, coalesce(incident, 0) AS incident, avg(raw) FILTER (NOT retired) OVER (PARTITION BY series, rnd, scenario) AS mu FROM raced r LEFT JOIN inc USING (series, scenario)),
sq AS (SELECT *, CASE WHEN retired THEN raw ELSE mu + CASE incident WHEN 2 THEN 0.75 WHEN 1 THEN 0.9 ELSE 1.0 END * (raw - mu) END AS squeezed FROM fld)
SELECT series, rnd, entity, count(*) AS scenarios, count(*) FILTER (incident = 2) AS safety_cars, count(*) FILTER (incident = 1) AS virtual_cars, count(*) FILTER (retired) AS retirements, {r6("avg(squeezed)")} AS mean_score FROM sq GROUP BY ALL""",
)
def field_compression(spark, sf):
    """The field drawn together in scenarios whose race was interrupted."""
    rows = scored(spark, sf)
    active = rows.where(~F.col("StartingGridStatus").isin(*replay.NON_STARTERS)).select(*star.KEYS, "score")
    heats = replay.replay(active, history(rows)).join(_incidents(rows), ["series", "scenario"], "left")
    heats = heats.withColumn("incident", F.coalesce("incident", F.lit(0)))
    share = F.when(F.col("incident") == 2, 0.75).when(F.col("incident") == 1, 0.9).otherwise(1.0)
    n = lambda c: F.count(F.when(c, 1))
    return shown(
        replay.compress_field(heats, RACE, share).groupBy(*star.KEYS).agg(
            F.count(F.lit(1)).alias("scenarios"), n(F.col("incident") == 2).alias("safety_cars"), n(F.col("incident") == 1).alias("virtual_cars"),
            n(F.col("retired")).alias("retirements"), F.avg("raw").alias("mean_score"),
        )
    )


@query(
    "retirement_ranks",
    f"""WITH {PREDS}, {REPLAY.format(_STARTED)} SELECT series, rnd, scenario, count(*) AS field, count(*) FILTER (retired) AS retired, min(finish) FILTER (retired) AS first_retired,
  max(finish) FILTER (NOT retired) AS last_runner, cast(sum(finish * entity) AS bigint) AS checksum FROM fin GROUP BY ALL""",
)
def retirement_ranks(spark, sf):
    rows = scored(spark, sf)
    active = rows.where(~F.col("StartingGridStatus").isin(*replay.NON_STARTERS)).select(*star.KEYS, "score")
    ranked = replay.rank_scenarios(replay.replay(active, history(rows)), RACE)
    f, out = F.col("finish"), F.col("retired")
    return shown(
        ranked.groupBy(*RACE, "scenario").agg(
            F.count(F.lit(1)).alias("field"), F.count(F.when(out, 1)).alias("retired"), F.min(F.when(out, f)).alias("first_retired"),
            F.max(F.when(~out, f)).alias("last_runner"), F.sum(f * F.col("entity")).alias("checksum"),
        )
    )


def plan_entrants(spark, sf):
    rows = star.qualifying(spark, sf).withColumn("circuit", star.circuit_of(F.col("rnd")))
    rows = conditions.add_circuit_priors(rows, star.circuit_priors(spark, sf), "circuit")
    k = F.col("entity") % 5
    return rows.select(
        *star.KEYS,
        F.col("q_position").alias("QualifyingPosition"),
        (F.lit(44) + F.col("circuit") * 9).alias("total_laps"),
        "pit_loss_seconds",
        (F.lit(0.09) + k / 100).alias("soft_tyre_deg_rate"),
        F.when(k != 0, F.lit(0.05) + k / 200).alias("medium_tyre_deg_rate"),
        (F.lit(0.03) + k / 300).alias("hard_tyre_deg_rate"),
    )


# stints are costed lap by lap here, not in closed form
PLANS = """
pe AS (SELECT q.series, q.rnd, q.entity, qualifying_position AS q, cast(44 + circuit * 9 AS bigint) AS t, pit_loss, 0.09::double + (q.entity % 5) / 100.0 AS ws,
    CASE WHEN q.entity % 5 <> 0 THEN 0.05::double + (q.entity % 5) / 200.0 ELSE 0.065::double END AS wm, 0.03::double + (q.entity % 5) / 300.0 AS wh
  FROM {quali} q JOIN circuits ON circuit = (q.rnd - 1) % 4),
plan AS (SELECT * FROM (VALUES {values}) v(plan, name, comp, cuts, limited)),
cut AS (SELECT DISTINCT t, plan, name, comp, limited, list_transform(cuts, lambda c: cast(round_even(c * t, 0) AS bigint)) AS cuts FROM pe, plan),
seg AS (SELECT t, plan, name, limited, cuts, comp[k] AS c, CASE WHEN k = 1 THEN 0 ELSE cuts[k - 1] END AS a, CASE WHEN k = len(comp) THEN t ELSE cuts[k] END AS b FROM cut, unnest(range(1, len(comp) + 1)) u(k)),
lap AS (SELECT t, plan, name, limited, cuts, c, sum(greatest(0, t - (a + i))) * 0.035 AS fuel, sum(i) AS age, count(*) AS n FROM seg, unnest(range(1, b - a + 1)) w(i) GROUP BY t, plan, name, limited, cuts, c, a),
bad AS (SELECT DISTINCT t, plan FROM lap WHERE limited AND n > CASE c WHEN 'SOFT' THEN 22 WHEN 'MEDIUM' THEN 35 ELSE 48 END),
cost AS (
  SELECT series, rnd, entity, plan, name || ' @ ' || array_to_string(cuts, ', ') AS plan_name, len(cuts) AS stops,
    sum(n * (85.0::double + (q - 1) * 0.08 + CASE c WHEN 'SOFT' THEN -0.65 WHEN 'HARD' THEN 0.55 WHEN 'INTERMEDIATE' THEN 3.5 ELSE 0 END)
      + CASE c WHEN 'SOFT' THEN ws WHEN 'MEDIUM' THEN wm WHEN 'HARD' THEN wh ELSE 0.08::double END * age + fuel) + len(cuts) * any_value(pit_loss) AS s
  FROM pe JOIN lap USING (t) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.t = pe.t AND bad.plan = lap.plan) GROUP BY series, rnd, entity, plan, name, cuts)"""


def plans_sql(wet: bool) -> str:
    rows = []
    for i, (name, comp, cuts, limited) in enumerate(pit_plans.WET_PLANS if wet else pit_plans.DRY_PLANS):
        rows.append(f"({i}, '{name}', {list(comp)}, {[float(c) for c in cuts]}::double[], {str(limited).lower()})")
    return PLANS.format(quali=block("qualifying_block"), values=", ".join(rows))


@query(
    "pit_plan_costs",
    sql(f"SELECT series, rnd, entity, plan_name, stops, {r6('s')} AS total_seconds FROM cost", CIRCUITS, plans_sql(False)),
)
def pit_plan_costs(spark, sf):
    out = pit_plans.plan_costs(plan_entrants(spark, sf))
    return shown(out.select(*star.KEYS, "plan_name", "stops", "total_seconds"))


_BEST = f"""SELECT series, rnd, entity, optimal_strategy_stops, recommended_strategy, coalesce(alt, recommended_strategy) AS alternative_strategy, {r6("coalesce(alt_s - s, 0)")} AS strategy_delta_seconds FROM (
  SELECT series, rnd, entity, stops AS optimal_strategy_stops, plan_name AS recommended_strategy, s, row_number() OVER w AS k, lead(plan_name) OVER w AS alt, lead(s) OVER w AS alt_s
  FROM cost WINDOW w AS (PARTITION BY series, rnd, entity ORDER BY round(s, 6), plan)) WHERE k = 1"""


@query("pit_plan_best", sql(_BEST, CIRCUITS, plans_sql(False)))
def pit_plan_best(spark, sf):
    return shown(pit_plans.best_plans(pit_plans.plan_costs(plan_entrants(spark, sf)), star.KEYS))


@query("pit_plan_wet", sql(_BEST, CIRCUITS, plans_sql(True)))
def pit_plan_wet(spark, sf):
    return shown(pit_plans.best_plans(pit_plans.plan_costs(plan_entrants(spark, sf), wet=True), star.KEYS))
