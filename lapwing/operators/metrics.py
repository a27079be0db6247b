"""Forecast quality: per-race metrics, probability scores, paired tests, blends and weight searches.

Per-race metrics window over one race.  Pooled metrics (one group holding every
row) are sums, prefix-sum ranks and split percentiles, so no task sees the pool.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.status import count_if
from lapwing.operators import pooled
from lapwing.operators.quality import keep_first
from lapwing.operators.skew import attach, find_hot, group_percentile, prefix_rank, rank_correlation
from lapwing.session import cut_lineage

# Tested model blends (rf, xgb, ridge), sweep weights and search candidates.
BLENDS = [
    ("100% RF", 1.00, 0.00, 0.00),
    ("75% RF / 25% XGB", 0.75, 0.25, 0.00),
    ("60% RF / 40% XGB", 0.60, 0.40, 0.00),
    ("50% RF / 50% XGB", 0.50, 0.50, 0.00),
    ("40% RF / 60% XGB", 0.40, 0.60, 0.00),
    ("25% RF / 75% XGB", 0.25, 0.75, 0.00),
    ("100% XGB", 0.00, 1.00, 0.00),
    ("100% Ridge", 0.00, 0.00, 1.00),
    ("40% RF / 30% XGB / 30% Ridge", 0.40, 0.30, 0.30),
]
SWEEP_GRID_WEIGHTS = [0.00, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
SEARCH_ML = [(0.60, 0.40, 0.00), (0.50, 0.30, 0.20), (0.40, 0.30, 0.30), (0.50, 0.00, 0.50), (0.34, 0.33, 0.33)]
SEARCH_GRID = [0.15, 0.25, 0.35, 0.45]
# Compared combinations (rf, xgb, ridge, grid).
COMBINATIONS = [
    ("Random Forest", 1.00, 0.00, 0.00, 0.00),
    ("XGBoost", 0.00, 1.00, 0.00, 0.00),
    ("Ridge Regression", 0.00, 0.00, 1.00, 0.00),
    ("RF + XGBoost (60/40)", 0.60, 0.40, 0.00, 0.00),
    ("RF + Ridge (60/40)", 0.60, 0.00, 0.40, 0.00),
    ("XGBoost + Ridge (50/50)", 0.00, 0.50, 0.50, 0.00),
    ("RF + XGBoost + Ridge (40/30/30)", 0.40, 0.30, 0.30, 0.00),
    ("Production Hybrid (0.65 ML + 0.35 Grid)", 0.60, 0.40, 0.00, 0.35),
]
ADAPTIVE = "Inner-CV Optimized Hybrid"
ADAPTIVE_START = (0.50, 0.25, 0.25, 0.35)
MIN_SCALE = 1.5
MAD_TO_SIGMA = 1.4826


def with_blends(preds: DataFrame, blends: Sequence[tuple[str, float, float, float]] = BLENDS) -> DataFrame:
    """One row per prediction and blend, from a literal list of weights."""
    weights = F.array(
        *[F.struct(F.lit(n).alias("model"), F.lit(a).alias("w_rf"), F.lit(b).alias("w_xgb"), F.lit(c).alias("w_ridge")) for n, a, b, c in blends]
    )
    rows = preds.select("*", F.explode(weights).alias("_w")).select(*preds.columns, "_w.*")
    score = F.col("w_rf") * F.col("rf") + F.col("w_xgb") * F.col("xgb") + F.col("w_ridge") * F.col("ridge")
    return rows.withColumn("score", score)


def add_order(rows: DataFrame, race: Sequence[str], value: str, out: str) -> DataFrame:
    """Ordinal rank in a race, ties broken by entity."""
    w = Window.partitionBy(*race).orderBy(F.col(value).asc_nulls_last(), "entity")
    return rows.withColumn(out, F.row_number().over(w).cast("long"))


def _average_rank(value: str, race: Sequence[str]) -> Column:
    ties = F.count(F.lit(1)).over(Window.partitionBy(*race, value))
    return F.rank().over(Window.partitionBy(*race).orderBy(value)) + (ties - 1) / F.lit(2.0)


def race_metrics(preds: DataFrame, race: Sequence[str]) -> DataFrame:
    """Error, rank, podium and points metrics; ``race`` includes the model column.

    Rows need entity, score, pred_rank and actual.
    """
    race = list(race)
    rows = preds.where(F.col("score").isNotNull() & F.col("actual").isNotNull())
    rows = add_order(add_order(rows, race, "actual", "_a"), race, "pred_rank", "_p")
    rows = rows.withColumn("_rs", _average_rank("score", race)).withColumn("_ra", _average_rank("actual", race))
    n = F.count(F.lit(1))
    both = lambda k: count_if((F.col("_a") <= k) & (F.col("_p") <= k))
    hit = count_if((F.col("_a") <= 3) & (F.col("_a") == F.col("_p")))
    err, rank_err = F.col("score") - F.col("actual"), F.col("pred_rank") - F.col("actual")
    flat = (F.max("_rs") == F.min("_rs")) | (F.max("_ra") == F.min("_ra"))
    spread = F.stddev_pop("_rs") * F.stddev_pop("_ra")
    top = F.least(F.lit(10), n)
    return rows.groupBy(*race).agg(
        F.avg(F.abs(err)).alias("mae_continuous"),
        F.avg(F.abs(rank_err)).alias("mae_ordinal"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop("_rs", "_ra"), spread)).alias("spearman"),
        F.max(((F.col("_a") == 1) & (F.col("_p") == 1)).cast("double")).alias("winner_accuracy"),
        ((n >= 3) & (hit == 3)).cast("double").alias("exact_podium"),
        both(3).cast("double").alias("top3_overlap"),
        (both(3) / 3.0).alias("podium_f1"),
        both(5).cast("double").alias("top5_overlap"),
        (both(10) / top).alias("points_accuracy"),
        n.alias("driver_count"),
    )


def probability_metrics(forecast: DataFrame, actual: DataFrame, race: Sequence[str]) -> DataFrame:
    """Brier scores for win, top three and top five, and skill against a uniform guess."""
    race = list(race)
    rows = forecast.join(actual.select(*race, "entity", "actual"), [*race, "entity"])
    n = F.count(F.lit(1)).over(Window.partitionBy(*race)).cast("double")
    y = lambda k: F.coalesce((F.col("actual") <= k).cast("double"), F.lit(0.0))
    p = {1: F.col("WinProbability") / 100.0, 3: F.col("Top3Probability") / 100.0, 5: F.col("Top5Probability") / 100.0}
    rows = rows.withColumns(
        {f"_e{k}": (p[k] - y(k)) * (p[k] - y(k)) for k in p} | {f"_u{k}": (F.lit(float(k)) / n - y(k)) * (F.lit(float(k)) / n - y(k)) for k in (1, 3)}
    )
    skill = lambda k: F.when(F.avg(f"_u{k}") > 0, 1.0 - F.avg(f"_e{k}") / F.avg(f"_u{k}")).otherwise(0.0)
    return rows.groupBy(*race).agg(
        F.avg("_e1").alias("brier_win"),
        skill(1).alias("bss_win"),
        F.avg("_e3").alias("brier_top3"),
        skill(3).alias("bss_top3"),
        F.avg("_e5").alias("brier_top5"),
    )


EXACT_PAIRS = 50  # the signed-rank test's own rule: more pairs take the normal distribution
SERIES_DEGREES = 2_000  # above, Student's tail is the normal one at a corrected place, right to 1e-7


def _signed_rank_chances(n: Column) -> Column:
    """Chance of every rank sum 0 .. n (n + 1) / 2 when each of the ranks 1 .. n counts with chance one half."""
    share = lambda old, s: F.coalesce(F.get(old, s.cast("int")), F.lit(0.0)) / 2

    def with_rank(old: Column, k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.size(old) + k - 1), lambda s: share(old, s) + share(old, s - k))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), F.array(F.lit(1.0)), with_rank)


def _exact_signed_rank_p(n: Column, rank_sum: Column) -> Column:
    """Two-sided exact p of a signed-rank sum; null where ``n`` is."""
    at = F.round(rank_sum).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda x, y: x + y)
    chances = _signed_rank_chances(n)
    low, high = total(F.slice(chances, F.lit(1), at + 1)), total(F.slice(chances, at + 1, F.size(chances)))
    return F.when(n.isNotNull(), F.least(F.lit(1.0), 2.0 * F.least(low, high)))


def _student_tail(t: Column, degrees: Column) -> Column:
    """Two-sided tail of Student's distribution: for whole degrees of freedom a finite series in the angle of t."""
    angle = F.atan(F.abs(t) / F.sqrt(degrees))
    c2 = F.cos(angle) * F.cos(angle)
    odd = F.pmod(degrees.cast("long"), F.lit(2).cast("long")) == 1
    # terms 1, 1/2 c2, 1*3/(2*4) c2^2, ... (even) or 1, 2/3 c2, 2*4/(3*5) c2^2, ... (odd)
    count = F.when(odd, (degrees - 1) / 2 - 1).otherwise(degrees / 2 - 1).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(at: Column, i: Column) -> Column:
        k = i.cast("double")
        term = at["term"] * c2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (at["sum"] + term).alias("sum"))

    terms = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(terms, first, step)["sum"]
    inside = F.when(odd, (angle + F.when(degrees > 1, F.sin(angle) * F.cos(angle) * series).otherwise(0.0)) * 2 / math.pi).otherwise(F.sin(angle) * series)
    far = _normal_tail(t * (1 - 1 / (4 * degrees)) / F.sqrt(1 + t * t / (2 * degrees)))
    return F.when(degrees <= SERIES_DEGREES, F.greatest(1.0 - inside, F.lit(0.0))).otherwise(far)


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of erfc (relative error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the erfc approximation, lowest power first.
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def paired_comparison(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired differences of ``a`` minus ``b`` per key: mean, median, spread, effect size, signed-rank and paired-t p.

    Zero differences are ranked and then left out of the sums.  ``EXACT_PAIRS`` pairs or
    fewer without ties or zeros get the exact distribution, others the normal one.  Where the
    signed ranks have no spread the paired t decides.
    """
    keys = list(keys)
    d = pairs.select(*keys, (F.col("a") - F.col("b")).alias("_d")).where(F.col("_d").isNotNull())
    # read for group sizes, medians, spreads and ranks, which share a layout: written once, or a task would hold what leads to it for each of them
    d = cut_lineage(d)
    hot = find_hot(d, keys)
    med = group_percentile(d, keys, "_d", 0.5, "median_diff", hot)
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_races"), F.avg("_d").alias("mean_diff"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("std_diff")
    )
    sizes = d.groupBy(*keys, F.abs("_d").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), count_if(F.col("_d") > 0).alias("_plus"), count_if(F.col("_d") < 0).alias("_minus")
    )
    ranked = prefix_rank(sizes, keys, "_v", "_c", 1e-3, "_r")
    c = F.col("_c").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_plus") * F.col("_r")).alias("_tp"),
        F.sum(F.col("_minus") * F.col("_r")).alias("_tm"),
        F.coalesce(F.sum(F.when(F.col("_v") == 0, c)), F.lit(0.0)).alias("_z"),
        F.sum(F.when(F.col("_v") > 0, c * c * c - c).otherwise(0.0)).alias("_ties"),
    )
    rows = stats.join(med, keys).join(sums, keys)
    n, z = F.col("n_races").cast("double"), F.col("_z")
    mean = n * (n + 1) / 4 - z * (z + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("_ties") / 2) / 24
    stat = F.least("_tp", "_tm")
    t = F.try_divide(F.col("mean_diff"), F.col("std_diff") / F.sqrt(n))
    rows = rows.withColumn("t_stat", F.when((n > 1) & (F.col("std_diff") > 0), t))
    rows = rows.withColumn("t_p_value", F.when(F.col("t_stat").isNotNull(), _student_tail(F.col("t_stat"), F.greatest(n - 1, F.lit(1.0)))))
    plain = (n <= EXACT_PAIRS) & (z == 0) & (F.col("_ties") == 0)
    exact = _exact_signed_rank_p(F.when(plain, F.col("n_races")), F.when(plain, F.col("_tp")))
    p = F.when(plain, exact).when(var > 0, _normal_tail((stat - mean) / F.sqrt(var))).otherwise(F.coalesce("t_p_value", F.lit(1.0)))
    p = F.when((n < 5) | (z == n), 1.0).otherwise(F.least(p, F.lit(1.0)))
    kind = F.when(n < 5, "none").when(z == n, "exact_zero").when(plain | (var > 0), "wilcoxon").otherwise("paired_t")
    rows = rows.withColumn("p_value", p).withColumn("test_type", kind)
    return rows.select(
        *keys, "n_races", "mean_diff", "median_diff", "std_diff",
        F.when(F.col("std_diff") > 1e-6, F.col("mean_diff") / F.col("std_diff")).otherwise(0.0).alias("cohens_d"),
        "p_value", "test_type", (F.col("p_value") < 0.05).alias("significant"), "t_stat", "t_p_value",
    )


def pooled_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE, median error, RMSE and Spearman over all rows of each key, where keys are columns of the rows."""
    keys = list(keys)
    rows = scored.where(F.col("score").isNotNull() & F.col("actual").isNotNull())
    rows = rows.select(*keys, "score", "actual", F.abs(F.col("score") - F.col("actual")).alias("_e"))
    med = group_percentile(rows, keys, "_e", 0.5, "medae", find_hot(rows, keys))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse")
    )
    rho = rank_correlation(rows, keys, "score", "actual", "spearman")
    return base.join(med, keys).join(rho, keys)


def _blended(weights: Sequence[tuple[float, float, float, float]]) -> pooled.Scores:
    """Scores of all (rf, xgb, ridge, grid) weightings at once."""

    def scores(c: dict) -> np.ndarray:
        out = []
        for a, b, r, g in weights:
            score = a * c["rf"] + b * c["xgb"] + r * c["ridge"]
            out.append(score if g is None else (1.0 - g) * score + g * c["grid"])
        return np.stack(out)

    return scores


def model_comparison(preds: DataFrame, blends: Sequence[tuple[str, float, float, float]] = BLENDS) -> DataFrame:
    """Pooled metrics of every blend; ``is_best`` marks the smallest error."""
    rows = preds.select("rf", "xgb", "ridge", "actual")
    try:
        out = pooled.pooled(rows, _blended([(a, b, c, None) for _, a, b, c in blends]), len(blends))
    except pooled.TooManyOutcomes:
        out = pooled_metrics(with_blends(cut_lineage(preds), blends), ["model", "w_rf", "w_xgb", "w_ridge"])
        return out.withColumn("is_best", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mae", "model")) == 1)  # a row a blend
    out.insert(0, "model", [b[0] for b in blends])
    for i, name in enumerate(("w_rf", "w_xgb", "w_ridge"), 1):
        out.insert(i, name, [float(b[i]) for b in blends])
    best = out.sort_values(["mae", "model"], na_position="last")["model"].iloc[0]
    out["is_best"] = (out["model"] == best) & (out["samples"] > 0)
    return _as_table(preds, out, "model string, w_rf double, w_xgb double, w_ridge double", "is_best boolean")


def _as_table(like: DataFrame, found, before: str, after: str) -> DataFrame:
    """One row a weighting, as a table; weightings without rows have none."""
    found = found[found["samples"] > 0]
    schema = f"{before}, samples long, mae double, medae double, rmse double, spearman double, {after}"
    return like.sparkSession.createDataFrame(list(found.itertuples(index=False, name=None)), schema)


def _exploded_sweep(preds: DataFrame, blends: Sequence[tuple[str, float, float, float]], grid_weights: Sequence[float]) -> DataFrame:
    mixed = with_blends(preds, blends).select("*", F.explode(F.array(*[F.lit(float(w)) for w in grid_weights])).alias("grid_weight"))
    mixed = mixed.withColumn("score", (1.0 - F.col("grid_weight")) * F.col("score") + F.col("grid_weight") * F.col("grid"))
    out = pooled_metrics(mixed, ["model", "grid_weight"])
    pure = out.where(F.col("grid_weight") == 0).select("model", F.col("mae").alias("_pure"))
    return out.join(pure, "model", "left").withColumn("delta_mae", F.col("mae") - F.col("_pure")).drop("_pure")


def blend_sweep(
    preds: DataFrame, blends: Sequence[tuple[str, float, float, float]], grid_weights: Sequence[float] = SWEEP_GRID_WEIGHTS
) -> DataFrame:
    """Metrics for every mix of model score and start slot, with the change from the pure model."""
    cases = [(name, float(g), (a, b, c, g)) for name, a, b, c in blends for g in grid_weights]
    rows = preds.select("rf", "xgb", "ridge", "grid", "actual")
    try:
        out = pooled.pooled(rows, _blended([w for *_, w in cases]), len(cases))
    except pooled.TooManyOutcomes:
        return _exploded_sweep(cut_lineage(rows), blends, grid_weights)
    out.insert(0, "model", [c[0] for c in cases])
    out.insert(1, "grid_weight", [c[1] for c in cases])
    pure = {m: e for m, g, e in zip(out["model"], out["grid_weight"], out["mae"]) if g == 0}
    out["delta_mae"] = [None if pure.get(m) is None or e is None else e - pure[m] for m, e in zip(out["model"], out["mae"])]
    return _as_table(preds, out, "model string, grid_weight double", "delta_mae double")


_WEIGHTS = ("w_rf", "w_xgb", "w_ridge", "w_grid")


def _weighted(w: Sequence[Column]) -> Column:
    ml = w[0] * F.col("rf") + w[1] * F.col("xgb") + w[2] * F.col("ridge")
    return (F.lit(1.0) - w[3]) * ml + w[3] * F.col("grid")


def _fold_errors(preds: DataFrame, fold: Sequence[str]) -> DataFrame:
    """Mean absolute error of every candidate weighting on every fold."""
    combos = [(a, b, c, g) for a, b, c in SEARCH_ML for g in SEARCH_GRID]
    cand = F.array(
        *[F.struct(F.lit(i).alias("candidate"), *[F.lit(v).alias(n) for n, v in zip(_WEIGHTS, c)]) for i, c in enumerate(combos)]
    )
    rows = preds.select("*", F.explode(cand).alias("_c")).select(*preds.columns, "_c.*")
    err = F.abs(_weighted([F.col(w) for w in _WEIGHTS]) - F.col("actual"))
    return rows.groupBy(*fold, "candidate", *_WEIGHTS).agg(F.avg(err).alias("fold_mae"))


def weight_search(preds: DataFrame, scope: Sequence[str], fold: Sequence[str]) -> DataFrame:
    """Mean fold error of every candidate weighting; the first smallest is marked, per scope."""
    scope = list(scope)
    out = _fold_errors(preds, [*scope, *fold]).groupBy(*scope, "candidate", *_WEIGHTS).agg(F.avg("fold_mae").alias("mean_fold_mae"))
    first = F.row_number().over(Window.partitionBy(*scope).orderBy("mean_fold_mae", "candidate"))
    return out.withColumn("is_best", first == 1)


def adaptive_weights(preds: DataFrame, scope: Sequence[str], fold: str = "rnd") -> DataFrame:
    """The weighting that did best on strictly earlier folds, one row per (scope, fold)."""
    scope = list(scope)
    before = Window.partitionBy(*scope, "candidate").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    seen = _fold_errors(preds, [*scope, fold]).withColumn("_m", F.round(F.avg("fold_mae").over(before), 9))
    pick = F.min_by(F.struct(*_WEIGHTS), F.when(F.col("_m").isNotNull(), F.struct("_m", "candidate")))
    best = seen.groupBy(*scope, fold).agg(pick.alias("_b"))
    return best.select(*scope, fold, *[F.coalesce(F.col(f"_b.{w}"), F.lit(v)).alias(w) for w, v in zip(_WEIGHTS, ADAPTIVE_START)])


def with_combinations(preds: DataFrame, scope: Sequence[str], fold: str = "rnd") -> DataFrame:
    """One row per prediction and combination, the adaptive one included."""
    fixed = F.array(*[F.struct(F.lit(n).alias("model"), *[F.lit(v).alias(k) for k, v in zip(_WEIGHTS, w)]) for n, *w in COMBINATIONS])
    rows = preds.select("*", F.explode(fixed).alias("_c")).select(*preds.columns, "_c.*")
    adaptive = preds.withColumn("model", F.lit(ADAPTIVE)).join(adaptive_weights(preds, scope, fold), [*scope, fold])
    both = rows.unionByName(adaptive)
    return both.withColumn("score", _weighted([F.col(w) for w in _WEIGHTS]))


def top_k_overlap(rows: DataFrame, race: Sequence[str], predicted: str, actual: str, ks: Sequence[int]) -> DataFrame:
    """Share of the actual top k found in the predicted top k, per race."""
    rows = add_order(add_order(rows, race, predicted, "_p"), race, actual, "_a")
    return rows.groupBy(*race).agg(
        *[(count_if((F.col("_p") <= k) & (F.col("_a") <= k)) / F.lit(float(k))).alias(f"top{k}_overlap") for k in ks]
    )


def podium_lists(scored: DataFrame, race: Sequence[str]) -> DataFrame:
    """Predicted and actual top three as text, and how many agree; ``race`` includes the model."""
    rows = add_order(add_order(scored, race, "score", "_p"), race, "actual", "_a")

    def names(col: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col(col) <= 3, F.struct(F.col(col).alias("k"), F.col("entity").alias("e")))))
        return F.array_join(F.transform(picked, lambda s: s["e"].cast("string")), ",")

    hit = count_if((F.col("_p") <= 3) & (F.col("_a") <= 3))
    return rows.groupBy(*race).agg(
        names("_p").alias("predicted_podium"),
        names("_a").alias("actual_podium"),
        hit.alias("overlap"),
        count_if((F.col("_p") == 1) & (F.col("_a") == 1)).alias("winner_hit"),
    )


def robust_scale(residuals: DataFrame, keys: Sequence[str], value: str, floor: float = MIN_SCALE) -> DataFrame:
    """``max(1.4826 * MAD, floor)`` per key."""
    keys = list(keys)
    hot = find_hot(residuals, keys)
    mid = group_percentile(residuals, keys, value, 0.5, "_mid", hot)
    dev = attach(residuals.select(*keys, value), mid, keys, hot)
    dev = dev.select(*keys, F.abs(F.col(value) - F.col("_mid")).alias("_dev"))
    mad = group_percentile(dev, keys, "_dev", 0.5, "_mad", hot)
    return mad.select(*keys, F.greatest(F.col("_mad") * MAD_TO_SIGMA, F.lit(floor)).alias("sigma"))


def score_forecast(forecast: DataFrame, actual: DataFrame, race: Sequence[str]) -> DataFrame:
    """Post-race score of a forecast: errors, rank correlation, top-k overlaps and podium Brier."""
    race = list(race)
    rows = forecast.join(actual.select(*race, "entity", "actual").where(F.col("actual").isNotNull()), [*race, "entity"])
    rows = add_order(add_order(rows, race, "PredictedPosition", "_p"), race, "actual", "_a")
    rows = rows.withColumn("_rs", _average_rank("ExpectedFinish", race)).withColumn("_ra", _average_rank("actual", race))
    y = (F.col("actual") <= 3).cast("double")
    gap = F.col("Top3Probability") / 100.0 - y
    both = lambda k: count_if((F.col("_p") <= k) & (F.col("_a") <= k))
    return rows.groupBy(*race).agg(
        F.avg(F.abs(F.col("ExpectedFinish") - F.col("actual"))).alias("mae_expected"),
        F.avg(F.abs(F.col("PredictedPosition") - F.col("actual"))).alias("mae_predicted"),
        F.try_divide(F.covar_pop("_rs", "_ra"), F.stddev_pop("_rs") * F.stddev_pop("_ra")).alias("spearman_rank_corr"),
        *[both(k).alias(f"top{k}_overlap") for k in (1, 3, 5, 10)],
        F.avg(gap * gap).alias("podium_brier_score"),
        F.count(F.lit(1)).alias("evaluated_drivers"),
    )


def saved_forecast_table(forecast: DataFrame, actual: DataFrame, race: Sequence[str]) -> DataFrame:
    """Row-level comparison of a saved forecast with results, both sides de-duplicated."""
    keys = [*race, "entity"]
    f = keep_first(forecast, keys, [F.col("PredictedPosition")])
    a = keep_first(actual.select(*keys, "actual"), keys, [F.col("actual")])
    joined = f.join(a, keys)
    return joined.withColumn("delta", F.col("PredictedPosition") - F.col("actual")).withColumn("abs_delta", F.abs("delta"))


def summarise(metrics: DataFrame, dims: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Mean metrics at several levels in one pass (grouping sets); absent dimensions are null."""
    names = list(dict.fromkeys(c for d in dims for c in d))
    out = metrics.groupingSets([[F.col(c) for c in d] for d in dims], *[F.col(c) for c in names])
    return out.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
