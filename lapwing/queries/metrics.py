"""Forecast-quality queries over a deterministic prediction table.

The three model columns are form numbers rounded to six digits, so both engines
rank the same values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

import lapwing.queries.form  # noqa: F401
from lapwing.operators import form, metrics, quality
from lapwing.queries.features import block
from lapwing.queries.registry import query, r6, rounded, shown
from lapwing.queries.views import CIRCUITS
from lapwing.sources import star

RACE = ["series", "rnd"]
SCOPE = ["series", "entity"]
MIN_ROUNDS = 3


def prediction_table(spark, sf):
    rows = form.add_driver_form(star.results(spark, sf), SCOPE)
    rows = form.add_rolling_finish(rows, SCOPE).where(F.col("rnd") > MIN_ROUNDS)
    return rows.select(
        *star.KEYS,
        rounded(F.col("driver_finish_ewma")).alias("rf"),
        rounded(F.col("rolling_finish")).alias("xgb"),
        rounded(F.col("avg_finish")).alias("ridge"),
        F.when(F.col("grid") <= 0, 20.0).otherwise(F.col("grid").cast("double")).alias("grid"),
        F.col("position").cast("double").alias("actual"),
    )


PREDS = f"""
preds AS (
  SELECT r.series, r.rnd, r.entity, driver_finish_ewma AS rf, rolling_finish AS xgb, avg_finish AS ridge,
    cast(CASE WHEN grid <= 0 THEN 20 ELSE grid END AS double) AS grid, cast(position AS double) AS actual
  FROM {block("results_view")} r JOIN {block("season_form_asof")} f USING (series, rnd, entity) JOIN {block("rolling_last3")} l USING (series, rnd, entity)
  WHERE r.rnd > 3)"""

_BLENDS = ", ".join(f"('{n}', {a}::double, {b}::double, {c}::double)" for n, a, b, c in metrics.BLENDS)
BLENDED = f"""
blends AS (SELECT * FROM (VALUES {_BLENDS}) b(model, w_rf, w_xgb, w_ridge)),
scored AS (SELECT preds.*, model, w_rf, w_xgb, w_ridge, w_rf * rf + w_xgb * xgb + w_ridge * ridge AS score FROM preds, blends)"""

RANKED = f"""
ord AS (
  SELECT *, row_number() OVER (PARTITION BY series, rnd, model ORDER BY {r6("score")}, entity) AS pr,
    row_number() OVER (PARTITION BY series, rnd, model ORDER BY actual, entity) AS ar,
    rank() OVER (PARTITION BY series, rnd, model ORDER BY {r6("score")}) + (count(*) OVER (PARTITION BY series, rnd, model, {r6("score")}) - 1) / 2.0 AS rs,
    actual AS ra FROM scored)"""


def scored_rows(spark, sf):
    rows = metrics.with_blends(prediction_table(spark, sf))
    return rows.withColumn("score", rounded(F.col("score")))


@query(
    "race_metrics",
    f"""WITH {PREDS}, {BLENDED}, {RANKED} SELECT series, rnd, model, {r6(f"avg(abs({r6('score')} - actual))")} AS mae_continuous,
  {r6("avg(abs(pr - actual))")} AS mae_ordinal, {r6(f"sqrt(avg(pow({r6('score')} - actual, 2)))")} AS rmse,
  {r6("CASE WHEN max(rs) = min(rs) THEN 0 ELSE corr(rs, ra) END")} AS spearman,
  {r6("max(cast(pr = 1 AND ar = 1 AS int))")} AS winner_accuracy, {r6("cast(count(*) FILTER (pr <= 3 AND pr = ar) = 3 AS int)")} AS exact_podium,
  {r6("count(*) FILTER (pr <= 3 AND ar <= 3)")} AS top3_overlap, {r6("count(*) FILTER (pr <= 3 AND ar <= 3) / 3.0")} AS podium_f1,
  {r6("count(*) FILTER (pr <= 5 AND ar <= 5)")} AS top5_overlap, {r6("count(*) FILTER (pr <= 10 AND ar <= 10) / 10.0")} AS points_accuracy, count(*) AS driver_count
FROM ord GROUP BY ALL""",
)
def race_metrics(spark, sf):
    rows = metrics.add_order(scored_rows(spark, sf), [*RACE, "model"], "score", "pred_rank")
    return shown(metrics.race_metrics(rows, [*RACE, "model"]))


@query(
    "topk_overlap",
    f"""WITH {PREDS}, {BLENDED}, {RANKED} SELECT series, rnd, model, {", ".join(r6(f"count(*) FILTER (pr <= {k} AND ar <= {k}) / {k}.0") + f" AS top{k}_overlap" for k in (1, 3, 5, 10))} FROM ord GROUP BY ALL""",
)
def topk_overlap(spark, sf):
    return shown(metrics.top_k_overlap(scored_rows(spark, sf), [*RACE, "model"], "score", "actual", (1, 3, 5, 10)))


@query(
    "podium_lists",
    f"""WITH {PREDS}, {BLENDED}, {RANKED} SELECT series, rnd, model, string_agg(cast(entity AS varchar), ',' ORDER BY pr) FILTER (pr <= 3) AS predicted_podium,
  string_agg(cast(entity AS varchar), ',' ORDER BY ar) FILTER (ar <= 3) AS actual_podium, count(*) FILTER (pr <= 3 AND ar <= 3) AS overlap, count(*) FILTER (pr = 1 AND ar = 1) AS winner_hit
FROM ord GROUP BY ALL""",
)
def podium_lists(spark, sf):
    return shown(metrics.podium_lists(scored_rows(spark, sf), [*RACE, "model"]))


_POOL = f"""
z AS (SELECT *, rank() OVER (PARTITION BY {{0}} ORDER BY score) + (count(*) OVER (PARTITION BY {{0}}, score) - 1) / 2.0 AS rs,
   rank() OVER (PARTITION BY {{0}} ORDER BY actual) + (count(*) OVER (PARTITION BY {{0}}, actual) - 1) / 2.0 AS ra FROM {{1}})"""
_POOL_COLS = f"""count(*) AS samples, {r6("avg(abs(score - actual))")} AS mae, {r6("median(abs(score - actual))")} AS medae,
  {r6("sqrt(avg(pow(score - actual, 2)))")} AS rmse, {r6("corr(rs, ra)")} AS spearman"""


@query(
    "model_comparison",
    f"""WITH {PREDS}, {BLENDED}, {_POOL.format("model", "scored")}, m AS (SELECT model, w_rf, w_xgb, w_ridge, {_POOL_COLS} FROM z GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY mae, model) = 1 AS is_best FROM m""",
)
def model_comparison(spark, sf):
    return shown(metrics.model_comparison(prediction_table(spark, sf)))


@query(
    "blend_sweep",
    f"""WITH {PREDS}, {BLENDED}, g AS (SELECT unnest({metrics.SWEEP_GRID_WEIGHTS})::double AS grid_weight),
mixed AS (SELECT model, grid_weight, 1.0::double - grid_weight AS ml_weight, actual, (1.0::double - grid_weight) * score + grid_weight * grid AS score FROM scored, g), {_POOL.format("model, grid_weight", "mixed")},
m AS (SELECT model, grid_weight, avg(abs(score - actual)) AS raw, {_POOL_COLS} FROM z GROUP BY ALL)
SELECT model, grid_weight, samples, mae, medae, rmse, spearman, {r6("raw - max(CASE WHEN grid_weight = 0 THEN raw END) OVER (PARTITION BY model)")} AS delta_mae FROM m""",
)
def blend_sweep(spark, sf):
    return shown(metrics.blend_sweep(prediction_table(spark, sf), metrics.BLENDS))


_CAND = ", ".join(
    f"({i}, {a}::double, {b}::double, {c}::double, {g}::double)"
    for i, (a, b, c, g) in enumerate((a, b, c, g) for a, b, c in metrics.SEARCH_ML for g in metrics.SEARCH_GRID)
)


@query(
    "weight_search",
    f"""WITH {PREDS}, c AS (SELECT * FROM (VALUES {_CAND}) v(candidate, w_rf, w_xgb, w_ridge, w_grid)),
f AS (SELECT series, rnd, candidate, w_rf, w_xgb, w_ridge, w_grid, avg(abs((1 - w_grid) * (w_rf * rf + w_xgb * xgb + w_ridge * ridge) + w_grid * grid - actual)) AS m FROM preds, c GROUP BY ALL),
a AS (SELECT series, candidate, w_rf, w_xgb, w_ridge, w_grid, avg(m) AS mm FROM f GROUP BY ALL)
SELECT series, cast(candidate AS bigint) AS candidate, w_rf, w_xgb, w_ridge, w_grid, {r6("mm")} AS mean_fold_mae, row_number() OVER (PARTITION BY series ORDER BY mm, candidate) = 1 AS is_best FROM a""",
)
def weight_search(spark, sf):
    return shown(metrics.weight_search(prediction_table(spark, sf), ["series"], ["rnd"]))


_FIXED = ", ".join(f"('{n}', {a}::double, {b}::double, {c}::double, {g}::double)" for n, a, b, c, g in metrics.COMBINATIONS)


@query(
    "combination_eval",
    f"""WITH {PREDS}, c AS (SELECT * FROM (VALUES {_CAND}) v(candidate, w_rf, w_xgb, w_ridge, w_grid)),
f AS (SELECT series, rnd, candidate, w_rf, w_xgb, w_ridge, w_grid, avg(abs((1 - w_grid) * (w_rf * rf + w_xgb * xgb + w_ridge * ridge) + w_grid * grid - actual)) AS m FROM preds, c GROUP BY ALL),
h AS (SELECT t.series, t.rnd, f.candidate, f.w_rf, f.w_xgb, f.w_ridge, f.w_grid, avg(m) AS mm FROM (SELECT DISTINCT series, rnd FROM preds) t JOIN f ON f.series = t.series AND f.rnd < t.rnd GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY series, rnd ORDER BY round(mm, 9), candidate) = 1),
w AS (SELECT series, rnd, model, w_rf, w_xgb, w_ridge, w_grid FROM (SELECT DISTINCT series, rnd FROM preds), (VALUES {_FIXED}) v(model, w_rf, w_xgb, w_ridge, w_grid)
  UNION ALL SELECT t.series, t.rnd, '{metrics.ADAPTIVE}', coalesce(w_rf, 0.5), coalesce(w_xgb, 0.25), coalesce(w_ridge, 0.25), coalesce(w_grid, 0.35) FROM (SELECT DISTINCT series, rnd FROM preds) t LEFT JOIN b USING (series, rnd)),
s AS (SELECT series, rnd, model, actual, {r6("(1 - w_grid) * (w_rf * rf + w_xgb * xgb + w_ridge * ridge) + w_grid * grid")} AS score, entity FROM preds JOIN w USING (series, rnd)),
o AS (SELECT *, row_number() OVER (PARTITION BY series, rnd, model ORDER BY score, entity) AS p, row_number() OVER (PARTITION BY series, rnd, model ORDER BY actual, entity) AS a FROM s),
r AS (SELECT series, rnd, model, avg(abs(score - actual)) AS mae, avg(abs(p - actual)) AS mo, count(*) FILTER (p <= 3 AND a <= 3) AS t3 FROM o GROUP BY ALL)
SELECT series, model, count(*) AS n, {r6("avg(mae)")} AS mae_continuous, {r6("avg(mo)")} AS mae_ordinal, {r6("avg(t3)")} AS top3_overlap FROM r GROUP BY ALL""",
)
def combination_eval(spark, sf):
    rows = metrics.with_combinations(prediction_table(spark, sf), ["series"]).withColumn("score", rounded(F.col("score")))
    rows = metrics.add_order(rows, [*RACE, "model"], "score", "pred_rank")
    per_race = metrics.race_metrics(rows, [*RACE, "model"])
    return shown(metrics.summarise(per_race, [["series", "model"]], ["mae_continuous", "mae_ordinal", "top3_overlap"]))


@query(
    "circuit_type_eval",
    f"""WITH {PREDS}, {BLENDED}, {CIRCUITS}, t AS (SELECT scored.*, circuit_type FROM scored JOIN circuits ON circuit = (rnd - 1) % 4),
r AS (SELECT series, rnd, model, circuit_type, avg(abs(score - actual)) AS mae, sqrt(avg(pow(score - actual, 2))) AS rmse FROM t GROUP BY ALL)
SELECT circuit_type, model, count(*) AS n, {r6("avg(mae)")} AS mae, {r6("avg(rmse)")} AS rmse FROM r GROUP BY GROUPING SETS ((circuit_type, model), (model))""",
)
def circuit_type_eval(spark, sf):
    rows = metrics.with_blends(prediction_table(spark, sf)).withColumn("circuit", star.circuit_of(F.col("rnd")))
    kinds = star.circuit_priors(spark, sf).select("circuit", "circuit_type")
    e = F.col("score") - F.col("actual")
    per = rows.join(kinds, "circuit").groupBy(*RACE, "model", "circuit_type").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return shown(metrics.summarise(per, [["circuit_type", "model"], ["model"]], ["mae", "rmse"]))


@query(
    "paired_comparison",
    f"""WITH {PREDS}, e AS (SELECT series, rnd, avg(abs(rf - actual)) AS a, avg(abs(grid - actual)) AS b FROM preds GROUP BY ALL),
d AS (SELECT series, {r6("a")} - {r6("b")} AS d FROM e)
SELECT series, count(*) AS n_races, {r6("avg(d)")} AS mean_diff, {r6("median(d)")} AS median_diff, {r6("stddev_samp(d)")} AS std_diff,
  {r6("avg(d) / stddev_samp(d)")} AS cohens_d, 'wilcoxon' AS test_type FROM d GROUP BY ALL""",
)
def paired_comparison(spark, sf):
    preds = prediction_table(spark, sf)
    err = lambda c: rounded(F.avg(F.abs(F.col(c) - F.col("actual"))))
    pairs = preds.groupBy(*RACE).agg(err("rf").alias("a"), err("grid").alias("b"))
    return shown(metrics.paired_comparison(pairs, ["series"]).drop("p_value", "significant", "t_stat", "t_p_value"))


@query(
    "paired_test",
    f"""WITH RECURSIVE {PREDS}, e AS (SELECT series, rnd, avg(abs(rf - actual)) AS a, avg(abs(xgb - actual)) AS b, avg(abs(ridge - actual)) AS c, avg(abs(grid - actual)) AS g FROM preds GROUP BY ALL),
ways AS (SELECT 0 AS k, [cast(1 AS double)] AS w UNION ALL
  SELECT k + 1, list_transform(range(0, len(w) + k + 1), lambda s: coalesce(w[s + 1], 0) + CASE WHEN s > k THEN w[s - k] ELSE 0 END) FROM ways WHERE k < {metrics.EXACT_PAIRS}),
d AS (SELECT series, 'grid' AS against, {r6("a")} - {r6("g")} AS d FROM e UNION ALL SELECT series, 'rolling', {r6("a")} - {r6("b")} FROM e UNION ALL SELECT series, 'mean', {r6("a")} - {r6("c")} FROM e),
r AS (SELECT *, rank() OVER (PARTITION BY series, against ORDER BY abs(round(d, 6))) AS rk, count(*) OVER (PARTITION BY series, against, abs(round(d, 6))) AS ties FROM d),
m AS (
  SELECT series, against, count(*) AS n_races, avg(d) AS mean, median(d) AS mid, stddev_samp(d) AS sd, cast(sum(rk) FILTER (d > 0) AS bigint) AS plus, max(ties) AS ties, min(abs(d)) AS least
  FROM r GROUP BY ALL),
t AS (SELECT *, mean / (sd / sqrt(n_races)) AS t_stat, n_races - 1 AS nu FROM m),
tails AS (
  SELECT t.*, list_sum(w[1:plus + 1]) AS low, list_sum(w[plus + 1:]) AS high, list_sum(w) AS whole,
    -- Simpson's rule over the density between 0 and |t|
    1 - 2 * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * abs(t_stat) / 6000
      * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t_stat * i / 2000, 2) / nu, -(nu + 1) / 2))) AS t_p
  FROM t JOIN ways ON k = n_races WHERE ties = 1 AND least > 0)
SELECT series, against, n_races, {r6("mean")} AS mean_diff, {r6("mid")} AS median_diff, {r6("least(1, 2 * least(low, high) / whole)")} AS p_value, 'wilcoxon' AS test_type,
  least(1, 2 * least(low, high) / whole) < 0.05 AS significant, {r6("t_stat")} AS t_stat, {r6("t_p")} AS t_p_value FROM tails""",
)
def paired_test(spark, sf):
    """Signed ranks and paired t of one model against three others in each championship; differences without ties or zeros."""
    preds = prediction_table(spark, sf)
    err = lambda c: rounded(F.avg(F.abs(F.col(c) - F.col("actual"))))
    per_race = preds.groupBy(*RACE).agg(err("rf").alias("a"), *[err(c).alias(f"b_{c}") for c in ("grid", "xgb", "ridge")])
    named = {"b_grid": "grid", "b_xgb": "rolling", "b_ridge": "mean"}
    pairs = per_race.select("series", "a", F.inline(F.array(*[F.struct(F.lit(n).alias("against"), F.col(c).alias("b")) for c, n in named.items()])))
    gap = F.round(F.abs(F.col("a") - F.col("b")), 6)
    same = pairs.groupBy("series", "against").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(gap).alias("_u"), F.min(gap).alias("_least"))
    plain = same.where((F.col("_n") == F.col("_u")) & (F.col("_least") > 0)).select("series", "against")
    out = metrics.paired_comparison(pairs.join(plain, ["series", "against"]), ["series", "against"])
    return shown(out.drop("std_diff", "cohens_d"))


def toy_forecast(spark, sf):
    """Probabilities that depend on rank only, so every engine has the same ones."""
    rows = metrics.add_order(prediction_table(spark, sf), RACE, "rf", "PredictedPosition")
    p = F.col("PredictedPosition")
    share = lambda k: F.lit(100.0) * F.least(F.lit(1.0), F.lit(float(k)) / (p + 1))
    return rows.select(
        *star.KEYS, "PredictedPosition", F.col("rf").alias("ExpectedFinish"), share(1).alias("WinProbability"), share(2).alias("Top3Probability"),
        share(4).alias("Top5Probability"), share(8).alias("PointsProbability"), "actual",
    )


FORECAST = f"""
fc AS (
  SELECT series, rnd, entity, pos AS "PredictedPosition", rf AS "ExpectedFinish", least(1.0, 1.0 / (pos + 1)) AS p1, least(1.0, 2.0 / (pos + 1)) AS p3,
    least(1.0, 4.0 / (pos + 1)) AS p5, actual, count(*) OVER (PARTITION BY series, rnd) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY series, rnd ORDER BY rf, entity) AS pos FROM preds))"""


@query(
    "probability_metrics",
    f"""WITH {PREDS}, {FORECAST}, e AS (SELECT *, cast(actual = 1 AS int) AS y1, cast(actual <= 3 AS int) AS y3, cast(actual <= 5 AS int) AS y5 FROM fc)
SELECT series, rnd, {r6("avg(pow(p1 - y1, 2))")} AS brier_win, {r6("1 - avg(pow(p1 - y1, 2)) / avg(pow(1.0 / n - y1, 2))")} AS bss_win,
  {r6("avg(pow(p3 - y3, 2))")} AS brier_top3, {r6("1 - avg(pow(p3 - y3, 2)) / avg(pow(3.0 / n - y3, 2))")} AS bss_top3, {r6("avg(pow(p5 - y5, 2))")} AS brier_top5 FROM e GROUP BY ALL""",
)
def probability_metrics(spark, sf):
    fc = toy_forecast(spark, sf)
    return shown(metrics.probability_metrics(fc.drop("actual"), fc.select(*star.KEYS, "actual"), RACE))


@query(
    "forecast_score",
    f"""WITH {PREDS}, {FORECAST}, o AS (SELECT *, "PredictedPosition" AS p, row_number() OVER (PARTITION BY series, rnd ORDER BY actual, entity) AS a,
   rank() OVER (PARTITION BY series, rnd ORDER BY "ExpectedFinish") + (count(*) OVER (PARTITION BY series, rnd, "ExpectedFinish") - 1) / 2.0 AS rs FROM fc)
SELECT series, rnd, {r6('avg(abs("ExpectedFinish" - actual))')} AS mae_expected, {r6("avg(abs(p - actual))")} AS mae_predicted, {r6("corr(rs, actual)")} AS spearman_rank_corr,
  {", ".join(f"count(*) FILTER (p <= {k} AND a <= {k}) AS top{k}_overlap" for k in (1, 3, 5, 10))}, {r6("avg(pow(p3 - cast(actual <= 3 AS int), 2))")} AS podium_brier_score, count(*) AS evaluated_drivers FROM o GROUP BY ALL""",
)
def forecast_score(spark, sf):
    fc = toy_forecast(spark, sf)
    return shown(metrics.score_forecast(fc.drop("actual"), fc.select(*star.KEYS, "actual"), RACE))


@query(
    "saved_forecast_table",
    f"""WITH {PREDS}, {FORECAST} SELECT series, rnd, entity, "PredictedPosition" AS predicted, {r6("actual")} AS actual, {r6('"PredictedPosition" - actual')} AS delta, {r6('abs("PredictedPosition" - actual)')} AS abs_delta FROM fc""",
)
def saved_forecast_table(spark, sf):
    fc = toy_forecast(spark, sf)
    twice = fc.drop("actual").withColumn("PredictedPosition", F.explode(F.array(F.col("PredictedPosition"), F.col("PredictedPosition") + 40)))
    out = metrics.saved_forecast_table(twice, fc.select(*star.KEYS, "actual"), RACE)
    return shown(out.select(*star.KEYS, F.col("PredictedPosition").alias("predicted"), "actual", "delta", "abs_delta"))


@query(
    "forecast_integrity",
    f"""WITH {PREDS}, {FORECAST}, x AS (SELECT *, (entity + rnd) % 19 = 0 AS out, rnd % 7 = 0 AND "PredictedPosition" = 5 AS hole, rnd % 11 = 0 AND "PredictedPosition" = 2 AS hot FROM fc),
a AS (SELECT series, rnd, count(*) AS entrants, count(DISTINCT entity) AS unique_entrants, count(*) FILTER (NOT out) AS starters, count(*) FILTER (NOT out AND hole) AS null_rows,
  count(*) FILTER (hot) AS probability_rows, max(CASE WHEN NOT out THEN "PredictedPosition" END) = count(*) FILTER (NOT out) AS ranks_ok FROM x GROUP BY ALL)
SELECT *, ranks_ok AND null_rows = 0 AND probability_rows = 0 AS ok FROM a""",
)
def forecast_integrity(spark, sf):
    fc = toy_forecast(spark, sf)
    out = (F.col("entity") + F.col("rnd")) % 19 == 0
    hole = (F.col("rnd") % 7 == 0) & (F.col("PredictedPosition") == 5)
    hot = (F.col("rnd") % 11 == 0) & (F.col("PredictedPosition") == 2)
    fc = fc.withColumns(
        {
            "StartingGridStatus": F.when(out, "DNS").otherwise("CLASSIFIED"),
            "ExpectedFinish": F.when(~hole, F.col("ExpectedFinish")),
            "Top5Probability": F.when(hot, 140.0).otherwise(F.col("Top5Probability")),
        }
    )
    return shown(quality.forecast_audit(fc, RACE, "entity"))


@query(
    "unmatched_entities",
    """WITH f AS (SELECT DISTINCT l_suppkey AS entity FROM lineitem), a AS (SELECT s_suppkey AS entity FROM supplier UNION ALL SELECT c_custkey FROM customer)
SELECT 'left' AS side, entity FROM f WHERE entity NOT IN (SELECT entity FROM a) UNION ALL SELECT DISTINCT 'right', entity FROM a WHERE entity NOT IN (SELECT entity FROM f)""",
)
def unmatched_entities(spark, sf):
    left = star.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"))
    right = star.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"))
    right = right.unionByName(star.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")))
    return shown(quality.unmatched(left, right, ["entity"]))


@query(
    "robust_scale",
    f"""WITH {PREDS}, r AS (SELECT rnd, actual - rf AS r FROM preds), m AS (SELECT rnd, median(r) AS md FROM r GROUP BY ALL)
SELECT rnd, {r6("greatest(1.4826 * median(abs(r - md)), 1.5)")} AS sigma FROM r JOIN m USING (rnd) GROUP BY ALL""",
)
def robust_scale(spark, sf):
    res = prediction_table(spark, sf).select("rnd", (F.col("actual") - F.col("rf")).alias("residual"))
    return shown(metrics.robust_scale(res, ["rnd"], "residual"))
