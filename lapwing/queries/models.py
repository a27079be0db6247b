"""Model queries.  Fits are compared by row counts only; the deterministic parts have SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import conditions
from lapwing.plans import boosting, features, forecasts, gram, models
from lapwing.queries.features import MATRIX_SQL, block, matrix
from lapwing.queries.features import feature_matrix as feature_matrix_rows
from lapwing.queries.metrics import PREDS, prediction_table
from lapwing.queries.registry import query, r6, rounded, shown
from lapwing.queries.views import CIRCUITS
from lapwing.sources import star

RACE = ["series", "rnd"]
TARGET = 28
# Fewer trees and rounds than the library defaults where three models are fitted for each of all rounds.
QUICK = models.ModelParams(models.ForestParams(trees=20, depth=6), boosting.Penalised(rounds=30, rate=0.1))

IMPUTED = ["quali_gap_pct", "q3_gap_pct", "sprint_quali_pos", "fp1_gap_pct", "fp3_gap_pct", "grid_penalty_places"]


def table(spark, sf):
    return matrix(spark, sf, with_laps=False)


def full_table(spark, sf):
    """The matrix with the features of laps, which the models take."""
    return matrix(spark, sf)


@query(
    "median_impute",
    f"""WITH m AS (SELECT series, rnd, entity, quali_gap_pct, q3_gap_pct, sprint_quali_pos, fp1_gap_pct, fp3_gap_pct, cast(0 AS double) AS grid_penalty_places
  FROM {block("practice_block")} JOIN {block("qualifying_block")} USING (series, rnd, entity) JOIN {block("sprint_block")} USING (series, rnd, entity)),
d AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in IMPUTED)} FROM m)
SELECT series, rnd, entity, {", ".join(r6(f"coalesce({c}, m_{c}, 0)") + f" AS {c}" for c in IMPUTED)} FROM m, d""",
)
def median_impute(spark, sf):
    rows = table(spark, sf).select(*star.KEYS, *[rounded(F.col(c)).alias(c) for c in IMPUTED])
    return shown(models.impute(rows, models.medians(rows, IMPUTED)))


@query(
    "ensemble_blend",
    f"""WITH {PREDS} SELECT series, rnd, entity, {r6("rf")} AS rf_mode, {r6("ridge")} AS ridge_mode, {r6("0.4 * rf + 0.3 * xgb + 0.3 * ridge")} AS ensemble,
  {r6("(0.2 * rf + 0.6 * xgb) / 0.8")} AS hybrid, {r6("0.6 * rf + 0.4 * xgb")} AS repaired FROM preds""",
)
def ensemble_blend(spark, sf):
    p = prediction_table(spark, sf)
    c = [F.col(m) for m in ("rf", "xgb", "ridge")]
    return shown(
        p.select(
            *star.KEYS, models.blend_scores("rf", *c).alias("rf_mode"), models.blend_scores("hybrid", *c, weights={"rf": 0.0, "xgb": 0.0, "ridge": 1.0}).alias("ridge_mode"),
            models.blend_scores("ensemble", *c).alias("ensemble"), models.blend_scores("hybrid", *c, weights={"rf": 0.2, "xgb": 0.6, "ridge": -1.0}).alias("hybrid"),
            models.blend_scores("hybrid", *c, weights={"rf": 0.0, "xgb": -3.0, "ridge": 0.0}).alias("repaired"),
        )
    )


@query(
    "grid_blend",
    f"""WITH {PREDS}, {CIRCUITS}, b AS (SELECT preds.*, CASE circuit_type WHEN 'street' THEN 0.5 WHEN 'permanent' THEN 0.65 ELSE 0.55 END AS w FROM preds JOIN circuits ON circuit = (rnd - 1) % 4)
SELECT series, rnd, entity, {r6("w * rf + (1 - w) * grid")} AS blended, row_number() OVER (PARTITION BY series, rnd ORDER BY grid, entity) AS baseline_rank FROM b""",
)
def grid_blend(spark, sf):
    rows = prediction_table(spark, sf).withColumn("circuit", star.circuit_of(F.col("rnd")))
    rows = rows.join(star.circuit_priors(spark, sf).select("circuit", "circuit_type"), "circuit")
    rows = models.baseline(rows, RACE, "grid")
    return shown(
        rows.select(*star.KEYS, models.blend_with_grid(F.col("rf"), F.col("grid"), F.col("circuit_type")).alias("blended"), F.col("pred_rank").alias("baseline_rank"))
    )


@query(
    "ridge_fit",
    f"""WITH {PREDS}, s AS (SELECT count(*) AS n, avg(rf) AS m, stddev_pop(rf) AS sd, avg(actual) AS ym, covar_pop(actual, rf) AS c FROM preds WHERE rnd < 28)
SELECT series, rnd, entity, {r6("ym + (n * c / sd) / (n + 100.0) * ((rf - m) / sd)")} AS prediction FROM preds, s WHERE rnd = 28""",
)
def ridge_fit(spark, sf):
    p = prediction_table(spark, sf)
    ridge = models.Ridge(["rf"], "actual", 100.0).fit(p.where(F.col("rnd") < TARGET))
    return shown(p.where(F.col("rnd") == TARGET).select(*star.KEYS, ridge.score().alias("prediction")))


def ridge_sql(columns, subsets, matrix="matrix", alpha=100.0) -> str:
    """Ridge of every fold and subset as its normal equations: medians, standard scores, dot products, Gauss-Jordan steps.

    Ends in ``held(series, rnd, entity, subset, ridge, actual)``.
    """
    p = len(columns)
    members = ", ".join(f"('{name}', {[columns.index(c) + 1 for c in own]})" for name, own in subsets.items())
    return f"""m AS (SELECT series, rnd, entity, "ActualFinish" AS y, [{", ".join(f'cast("{c}" AS double)' for c in columns)}] AS x FROM {matrix} WHERE "ActualFinish" IS NOT NULL),
fold AS (SELECT rnd AS fold FROM (SELECT DISTINCT rnd FROM m) QUALIFY row_number() OVER (ORDER BY rnd) > 3),
l AS (SELECT series, rnd, entity, y, unnest(range(1, {p} + 1)) AS j, unnest(x) AS v FROM m),
fill AS (SELECT fold, j, coalesce(median(v), 0) AS fill FROM l JOIN fold ON rnd < fold GROUP BY ALL),
z AS (SELECT fold, j, series, rnd, entity, y, coalesce(v, fill) AS v FROM l JOIN fold ON rnd < fold JOIN fill USING (fold, j)),
s AS (SELECT fold, j, avg(v) AS mean, CASE WHEN stddev_pop(v) > 1e-9 THEN stddev_pop(v) ELSE 1 END AS sd, avg(y) AS ym FROM z GROUP BY ALL),
col AS (SELECT fold, j, list((v - mean) / sd ORDER BY series, rnd, entity) AS u, list(y - ym ORDER BY series, rnd, entity) AS t FROM z JOIN s USING (fold, j) GROUP BY ALL),
subset AS (SELECT * FROM (VALUES {members}) v(subset, members)),
pick AS (SELECT subset, len(members) AS size, unnest(members) AS j, unnest(range(1, len(members) + 1)) AS i FROM subset),
dot AS (SELECT a.fold, a.j AS ja, b.j AS jb, list_dot_product(a.u, b.u) + CASE WHEN a.j = b.j THEN {alpha} ELSE 0 END AS g FROM col a JOIN col b USING (fold)),
eq AS (
  SELECT fold, a.subset, a.size, a.i, list_append(list(g ORDER BY b.i), any_value(list_dot_product(c.u, c.t))) AS eq
  FROM pick a JOIN pick b USING (subset) JOIN dot ON ja = a.j AND jb = b.j JOIN col c USING (fold) WHERE c.j = a.j GROUP BY ALL),
solved AS (
  SELECT fold, subset, size, i, cast(1 AS bigint) AS step, eq FROM eq
  UNION ALL
  SELECT fold, subset, size, i, step + 1, CASE WHEN i = step THEN list_transform(eq, lambda v: v / eq[step]) ELSE list_transform(eq, lambda v, k: v - eq[step] * lead[k] / lead[step]) END
  FROM (SELECT *, max(CASE WHEN i = step THEN eq END) OVER (PARTITION BY fold, subset) AS lead FROM solved) WHERE step <= size),
weight AS (SELECT fold, subset, j, eq[size + 1] / sd AS w, mean, ym FROM solved JOIN pick USING (subset, size, i) JOIN s USING (fold, j) WHERE step = size + 1),
held AS (
  SELECT series, rnd, entity, subset, any_value(ym) + sum(w * (coalesce(v, fill) - mean)) AS ridge, any_value(y) AS actual
  FROM l JOIN weight ON rnd = fold AND l.j = weight.j JOIN fill ON fill.fold = weight.fold AND fill.j = weight.j GROUP BY series, rnd, entity, subset)
"""


RIDGE_MATRIX = MATRIX_SQL.replace("WITH g AS", "WITH RECURSIVE g AS", 1)


def metrics_sql(subsets) -> str:
    """Race metrics of ``held``, averaged for each subset, as four digits."""
    names = ["mae_continuous", "mae_ordinal", "rmse", "spearman", "top3_overlap", "podium_f1", "exact_podium", "winner_accuracy", "top5_overlap"]
    sizes = " ".join(f"WHEN '{name}' THEN {len(own)}" for name, own in subsets.items())
    return f"""h AS (SELECT * REPLACE (round(ridge, 6) AS ridge) FROM held),
o AS (SELECT *, row_number() OVER (PARTITION BY series, rnd, subset ORDER BY ridge, entity) AS p, row_number() OVER (PARTITION BY series, rnd, subset ORDER BY actual, entity) AS a,
  rank() OVER (PARTITION BY series, rnd, subset ORDER BY ridge) + (count(*) OVER (PARTITION BY series, rnd, subset, ridge) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY series, rnd, subset ORDER BY actual) + (count(*) OVER (PARTITION BY series, rnd, subset, actual) - 1) / 2.0 AS ra FROM h),
r AS (SELECT series, rnd, subset, avg(abs(ridge - actual)) AS mae_continuous, avg(abs(p - actual)) AS mae_ordinal, sqrt(avg(pow(ridge - actual, 2))) AS rmse,
  CASE WHEN max(rs) = min(rs) OR max(ra) = min(ra) THEN 0 ELSE corr(rs, ra) END AS spearman, count(*) FILTER (p <= 3 AND a <= 3) AS top3_overlap,
  count(*) FILTER (p <= 3 AND a <= 3) / 3.0 AS podium_f1, cast(count(*) >= 3 AND count(*) FILTER (p <= 3 AND p = a) = 3 AS int) AS exact_podium,
  max(cast(p = 1 AND a = 1 AS int)) AS winner_accuracy, count(*) FILTER (p <= 5 AND a <= 5) AS top5_overlap FROM o GROUP BY ALL),
means AS (SELECT subset, CASE subset {sizes} END AS features, count(*) AS races, {", ".join(f"avg({n}) AS {n}" for n in names)} FROM r GROUP BY ALL)
"""


_SHOWN = ", ".join(f"{r6(n, 4)} AS {n}" for n in forecasts.ABLATION_METRICS)
_DELTAS = ", ".join(
    r6(f"{n} - max(CASE WHEN subset = 'full' THEN {n} END) OVER ()", 4) + f" AS delta_{n}" for n in ("mae_continuous", "mae_ordinal", "top3_overlap")
)


def shown_table(spark, sf):
    """The matrix as the query shows it, so that both engines fit the same numbers."""
    return feature_matrix_rows(spark, sf)


@query(
    "ridge_walk_forward",
    f"""{RIDGE_MATRIX}, {ridge_sql(features.MODEL_FEATURES, {"all": features.MODEL_FEATURES})}
SELECT series, rnd, entity, {r6("ridge", 5)} AS ridge, {r6("actual", 5)} AS "ActualFinish" FROM held""",
)
def ridge_walk_forward(spark, sf):
    held = gram.walk_forward(forecasts.cut_lineage(shown_table(spark, sf)), features.MODEL_FEATURES)
    return shown(held.select(*star.KEYS, "ridge", "ActualFinish"), 5)


THREE = ["rf", "xgb", "ridge"]
_GAPS = "CASE WHEN (entity + rnd) % 5 <> 0 THEN xgb END AS xgb"


@query(
    "ridge_correlated",
    f"""WITH RECURSIVE {PREDS}, gaps AS (SELECT series, rnd, entity, rf, {_GAPS}, ridge, actual AS "ActualFinish" FROM preds),
{ridge_sql(THREE, {"all": THREE, "pair": ["rf", "ridge"], "one": ["xgb"]}, "gaps")}
SELECT series, rnd, entity, subset, {r6("ridge", 5)} AS ridge FROM held""",
)
def ridge_correlated(spark, sf):
    """Three forms of one driver's finishes, strongly correlated, one of them with gaps."""
    p = prediction_table(spark, sf).withColumn("xgb", F.when((F.col("entity") + F.col("rnd")) % 5 != 0, F.col("xgb")))
    rows = p.select(*star.KEYS, F.col("rf"), F.col("xgb"), F.col("ridge").alias("mean_finish"), F.col("actual").alias("ActualFinish"))
    columns = ["rf", "xgb", "mean_finish"]
    held = gram.walk_forward(forecasts.cut_lineage(rows), columns, subsets={"all": columns, "pair": ["rf", "mean_finish"], "one": ["xgb"]})
    return shown(held.select(*star.KEYS, "subset", "ridge"), 5)


@query("rf_walk_forward")
def rf_walk_forward(spark, sf):
    held = models.walk_forward(forecasts.cut_lineage(full_table(spark, sf)), features.MODEL_FEATURES, params=QUICK, models=("rf",))
    return shown(held.select(*star.KEYS, "rf", "ActualFinish"))


@query("gbt_walk_forward")
def gbt_walk_forward(spark, sf):
    return shown(boosting.walk_forward(forecasts.cut_lineage(full_table(spark, sf)), features.MODEL_FEATURES))


SHORT = boosting.Penalised(rounds=3, depth=2, rate=0.3, rows=1.0, features=1.0, bins=5000)
STEPS = ["grid", "form", "mean_finish"]


def boost_sql(columns, rows: str, p: boosting.Penalised) -> str:
    """Penalised trees of two levels, unrolled: ``rows`` has series, rnd, entity, y and the columns without gaps.

    The best split of a node has the largest gain over all (feature, cut); equal gains go to the first.  Ends in ``score``.
    """
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {p.l1}, 0))"
    worth = lambda g, n: f"pow({soft(g)}, 2) / ({n} + {p.l2})"
    value = lambda g, n: f"-{soft(g)} / ({n} + {p.l2})"
    features_of = " UNION ALL ".join(f"SELECT series, rnd, entity, {j} AS feature, {c} AS v FROM {rows}" for j, c in enumerate(columns))
    out = [f"f0 AS (SELECT rnd AS fold FROM (SELECT DISTINCT rnd FROM {rows}) QUALIFY row_number() OVER (ORDER BY rnd) > 3)"]
    out += [f"long AS ({features_of})"]
    out += [f"""s0 AS (SELECT fold, series, rnd, entity, y, avg(CASE WHEN rnd < fold THEN y END) OVER (PARTITION BY fold) AS score FROM {rows} JOIN f0 ON rnd <= fold)"""]
    for t in range(p.rounds):
        node, state = "0", f"s{t}"
        for level in range(2):
            rows_at = f"n{t}_{level}"
            out.append(f"{rows_at} AS (SELECT *, {node} AS node FROM {state})" if level == 0 else f"{rows_at} AS (SELECT * FROM {state})")
            out.append(f"""c{t}_{level} AS (SELECT fold, node, feature, v, sum(score - y) AS g, count(*) AS n FROM {rows_at} JOIN long USING (series, rnd, entity) WHERE rnd < fold AND node >= 0 GROUP BY ALL),
b{t}_{level} AS (SELECT fold, node, feature, v AS cut, gl, nl, ga - gl AS gr, na - nl AS nr FROM (
  SELECT *, sum(g) OVER k AS gl, sum(n) OVER k AS nl, sum(g) OVER (PARTITION BY fold, node, feature) AS ga, sum(n) OVER (PARTITION BY fold, node, feature) AS na
  FROM c{t}_{level} WINDOW k AS (PARTITION BY fold, node, feature ORDER BY v))
  WHERE nl >= {p.leaf} AND na - nl >= {p.leaf} AND {worth("gl", "nl")} + {worth("(ga - gl)", "(na - nl)")} - {worth("ga", "na")} > {p.gain}
  QUALIFY row_number() OVER (PARTITION BY fold, node ORDER BY round({worth("gl", "nl")} + {worth("(ga - gl)", "(na - nl)")} - {worth("ga", "na")}, 6) DESC, feature, v) = 1),
m{t}_{level} AS (SELECT r.* EXCLUDE (node{", leaf" if level else ""}), CASE WHEN cut IS NULL THEN -1 ELSE 2 * r.node + 1 + cast(v > cut AS int) END AS node,
  CASE WHEN cut IS NULL THEN {"leaf" if level else "0"} WHEN v <= cut THEN {value("gl", "nl")} ELSE {value("gr", "nr")} END AS leaf
  FROM {rows_at} r LEFT JOIN b{t}_{level} b USING (fold, node) LEFT JOIN long l ON l.series = r.series AND l.rnd = r.rnd AND l.entity = r.entity AND l.feature = b.feature)""")
            state = f"m{t}_{level}"
        out.append(f"s{t + 1} AS (SELECT fold, series, rnd, entity, y, score + {p.rate} * leaf AS score FROM {state})")
    return ",\n".join(out) + f",\nscore AS (SELECT series, rnd, entity, score, y FROM s{p.rounds} WHERE rnd = fold)"


@query(
    "boosted_trees",
    f"""WITH {PREDS}, steps AS (SELECT series, rnd, entity, actual AS y, grid, round(rf) AS form, round(ridge) AS mean_finish FROM preds),
{boost_sql(STEPS, "steps", SHORT)}
SELECT series, rnd, entity, {r6("score", 4)} AS xgb, {r6("y", 4)} AS actual FROM score""",
)
def boosted_trees(spark, sf):
    """Three small trees of every fold on features of few values, which SQL can follow."""
    p = prediction_table(spark, sf)
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("double")
    rows = p.select(*star.KEYS, "grid", whole("rf").alias("form"), whole("ridge").alias("mean_finish"), "actual")
    return shown(boosting.walk_forward(rows, STEPS, "actual", SHORT), 4)


_OMIT, _ALONE = forecasts.group_runs(), forecasts.group_runs(standalone=True)
_SUBSETS = {"all": features.MODEL_FEATURES, "common": features.FEATURE_GROUPS["grid"] + features.FEATURE_GROUPS["driver_form"]}
_FULL = _OMIT["full"]


@query("ablation", f"{RIDGE_MATRIX}, {ridge_sql(_FULL, _OMIT)}, {metrics_sql(_OMIT)} SELECT subset AS run, features, races, {_SHOWN}, {_DELTAS} FROM means")
def ablation(spark, sf):
    return shown(forecasts.ablation(shown_table(spark, sf), "ridge", digits=6), 4)


@query("standalone_groups", f"{RIDGE_MATRIX}, {ridge_sql(_FULL, _ALONE)}, {metrics_sql(_ALONE)} SELECT subset AS run, features, races, {_SHOWN}, {_DELTAS} FROM means")
def standalone_groups(spark, sf):
    return shown(forecasts.ablation(shown_table(spark, sf), "ridge", standalone=True, digits=6), 4)


@query("feature_subsets", f"{RIDGE_MATRIX}, {ridge_sql(features.MODEL_FEATURES, _SUBSETS)}, {metrics_sql(_SUBSETS)} SELECT subset, features, races, {_SHOWN} FROM means")
def feature_subsets(spark, sf):
    return shown(forecasts.subset_evaluation(shown_table(spark, sf), _SUBSETS, "ridge", digits=6), 4)


@query("importance")
def importance(spark, sf):
    return shown(models.importance(forecasts.cut_lineage(full_table(spark, sf)), features.MODEL_FEATURES, "ActualFinish", TARGET, QUICK))


@query("qualifying_forecast")
def qualifying_forecast(spark, sf):
    rows = matrix(spark, sf, with_laps=False, stage="after_sprint_race")
    return shown(forecasts.qualifying_forecast(rows, TARGET, params=QUICK).table)


def forecast_rows(spark, sf):
    rows = full_table(spark, sf).drop("circuit", "deg_multiplier").withColumn("circuit", star.circuit_of(F.col("rnd")))
    dims = star.circuit_priors(spark, sf)
    extra = dims.select("circuit", "circuit_type", F.col("climate_rain_prob").alias("rain_probability"))
    rows = conditions.add_circuit_priors(rows, dims, "circuit").join(extra, "circuit", "left")
    rows = rows.withColumns(conditions.incident_odds(F.lit(False)))
    st = F.when(F.col("status") == "Did not start", "DNS").otherwise("CLASSIFIED")
    return rows.withColumn("StartingGridStatus", st)


@query("race_forecast")
def race_forecast(spark, sf):
    out_of_race = F.col("status").isin("Engine", "Collision")
    return shown(forecasts.race_forecast(forecast_rows(spark, sf), TARGET, params=QUICK, retired=out_of_race).table)


@query("benchmark_summary")
def benchmark_summary(spark, sf):
    return shown(forecasts.benchmark(forecast_rows(spark, sf), features.MODEL_FEATURES, QUICK)["summary"])


_MODELS = {
    forecasts.BASELINE: "grid", "Random Forest": "rf", "XGBoost": "xgb", "Ridge Regression": "ridge", "Ensemble": "0.4 * rf + 0.3 * xgb + 0.3 * ridge",
    forecasts.HYBRID: "0.65 * (0.6 * rf + 0.4 * xgb) + 0.35 * grid",
}


@query(
    "benchmark_paired",
    f"""WITH {PREDS}, long AS ({" UNION ALL ".join(f"SELECT series, rnd, entity, actual, '{m}' AS model, {r6(e)} AS score FROM preds" for m, e in _MODELS.items())}),
o AS (SELECT *, row_number() OVER (PARTITION BY series, rnd, model ORDER BY score, entity) AS p FROM long),
r AS (SELECT series, rnd, model, avg(abs(p - actual)) AS mae FROM o GROUP BY ALL),
d AS (SELECT a.model, b.model AS against, a.mae - b.mae AS d FROM r a JOIN r b USING (series, rnd) WHERE b.model IN ('{forecasts.BASELINE}', '{forecasts.HYBRID}') AND a.model <> b.model)
SELECT model, against, count(*) AS n_races, {r6("avg(d)")} AS mean_diff, {r6("median(d)")} AS median_diff, {r6("stddev_samp(d)")} AS std_diff, {r6("avg(d) / stddev_samp(d)")} AS cohens_d,
  'wilcoxon' AS test_type, {r6("avg(d) / (stddev_samp(d) / sqrt(count(*)))", 4)} AS t_stat FROM d GROUP BY ALL""",
)
def benchmark_paired(spark, sf):
    """The benchmark's tables over stand-in predictions: every model against the grid and against the hybrid, all races."""
    rows = prediction_table(spark, sf)
    long = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("score")) for m, e in _MODELS.items()]))
    preds = rows.select(*RACE, "entity", "actual", long).withColumn("score", rounded(F.col("score")))
    tests = forecasts.benchmark_tables(preds)["paired_tests"].drop("p_value", "significant", "t_p_value")
    return shown(tests).withColumn("t_stat", rounded(F.col("t_stat"), 4))


FOLD_COLUMNS = ["GridPosition", "grid_norm", "driver_finish_ewma", "avg_finish", "avg_grid"]


@query(
    "circuit_fold_scores",
    f"""WITH RECURSIVE rolled AS (
  SELECT series, rnd, entity, position, cast(coalesce(grid, 12) AS double) AS g, count(*) OVER (PARTITION BY series, rnd) AS n,
    coalesce(avg(position) OVER (PARTITION BY series, entity ORDER BY rnd ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 12) AS last3 FROM {block("results_view")}),
cf AS (SELECT series, rnd, entity, g AS "GridPosition", (g - 1) / greatest(n - 1, 1) AS grid_norm, last3 AS driver_finish_ewma, last3 AS avg_finish, g AS avg_grid, cast(position AS double) AS "ActualFinish" FROM rolled),
{ridge_sql(FOLD_COLUMNS, {"all": FOLD_COLUMNS}, "cf")}
SELECT series, rnd, entity, {r6("ridge", 5)} AS ridge, {r6("actual", 5)} AS "ActualFinish" FROM held""",
)
def circuit_fold_scores(spark, sf):
    rows = forecasts.circuit_folds(star.results(spark, sf), ["series", "entity"])
    held = models.walk_forward(forecasts.cut_lineage(rows), FOLD_COLUMNS, models=("ridge",))
    return shown(held.select(*star.KEYS, "ridge", "ActualFinish"), 5)
