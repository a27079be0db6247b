"""Walk-forward fits against brute force on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapwing.operators import metrics, pooled
from lapwing.plans import boosting, forecasts, gram

COLUMNS = ["a", "b", "c", "d", "empty", "same"]


@pytest.fixture(scope="module")
def frame():
    """Correlated columns, ties, gaps, a column without values and one without spread."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 4))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[:, 2] = np.round(x[:, 2] * 3)
    y = x @ [1, 2, 0.5, 0] + rng.normal(size=700)
    x[rng.random(x.shape) < 0.2] = np.nan
    df = pd.DataFrame(x, columns=list("abcd"))
    df["empty"], df["same"] = np.nan, 3.0
    df["rnd"] = rng.integers(1, 8, 700)
    df.loc[df["rnd"] < 4, "d"] = np.nan
    df["series"], df["entity"], df["ActualFinish"] = 0, np.arange(700), y
    return df


def fitted(df, columns, r):
    train, test = df[df.rnd < r], df[df.rnd == r]
    fill = train[columns].median().fillna(0)
    a, b = train[columns].fillna(fill).values, test[columns].fillna(fill).values
    mean, sd = a.mean(0), a.std(0)
    sd[sd < 1e-9] = 1
    a, y = (a - mean) / sd, train.ActualFinish.mean()
    w = np.linalg.solve(a.T @ a + 100 * np.eye(len(columns)), a.T @ (train.ActualFinish - y))
    return dict(zip(test.entity, y + ((b - mean) / sd) @ w))


@pytest.mark.parametrize("grid", [{}, {"cells": 4, "enough": 5}, {"cells": 2, "enough": 1}])
def test_prefix_medians_by_brute_force(spark, frame, grid):
    folds = [1, 3, 5, 7, 9]
    found = {(r.fold, r.feature): r.median for r in gram.prefix_medians(spark.createDataFrame(frame), COLUMNS, folds, **grid).collect()}
    want = {(f, j): np.nanmedian(frame[frame.rnd < f][c]) for f in folds for j, c in enumerate(COLUMNS) if frame[frame.rnd < f][c].notna().any()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_prefix_medians_of_far_apart_values(spark):
    values = [1e300, -1e300, 5e-324, 0.0, -0.0, 1e-9, 2e-9, 1e9, -1e9, 3.0, 3.0, 3.0]
    rows = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "rnd long, x double")
    found = gram.prefix_medians(rows, ["x"], [1, 2, 3], cells=3, enough=1).collect()
    assert {r.fold: r.median for r in found} == {f: float(np.median([v for i, v in enumerate(values) if i % 3 < f])) for f in (1, 2, 3)}


def test_ridge_folds_and_subsets_by_brute_force(spark, frame):
    subsets = {"all": COLUMNS, "ab": ["a", "b"], "empty": ["empty"], "none": []}
    held = gram.walk_forward(spark.createDataFrame(frame), COLUMNS, subsets=subsets).toPandas()
    assert len(held) == 4 * (frame.rnd > 3).sum() and not held.in_sample.any()
    for name, columns in subsets.items():
        own = held[held.subset == name]
        for r in range(4, 8):
            want = fitted(frame, columns, r) if columns else dict.fromkeys(own[own.rnd == r].entity, frame[frame.rnd < r].ActualFinish.mean())
            got = dict(zip(own[own.rnd == r].entity, own[own.rnd == r].ridge))
            assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-8 for e in want)


def test_ridge_with_too_few_rounds_scores_in_sample(spark, frame):
    few = frame[frame.rnd <= 2]
    held = gram.walk_forward(spark.createDataFrame(few), ["a", "b"]).toPandas()
    want = fitted(pd.concat([few, few.assign(rnd=9)]).query("rnd <= 2 or rnd == 9"), ["a", "b"], 9)
    assert held.in_sample.all() and all(abs(want[e] - v) < 1e-8 for e, v in zip(held.entity, held.ridge))


def test_unlabelled_rows_neither_teach_nor_are_scored(spark, frame):
    part = frame.assign(ActualFinish=frame.ActualFinish.where(frame.entity % 3 > 0))
    table = spark.createDataFrame(part).withColumn("ActualFinish", F.when(~F.isnan("ActualFinish"), F.col("ActualFinish")))
    held = gram.walk_forward(table, ["a", "c"]).toPandas()
    want = fitted(part.dropna(subset="ActualFinish"), ["a", "c"], 6)
    got = dict(zip(held[held.rnd == 6].entity, held[held.rnd == 6].ridge))
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-8 for e in want)


def test_subset_metrics_are_means_of_races(spark, frame):
    out = {r["run"]: r for r in forecasts.ablation(spark.createDataFrame(frame), groups={"first": ["a", "b"], "second": ["c", "same"]}).collect()}
    assert {k: v["features"] for k, v in out.items()} == {"full": 4, "first": 2, "second": 2}
    for name, columns in {"full": ["a", "b", "c", "same"], "first": ["c", "same"], "second": ["a", "b"]}.items():
        errors = []
        for r in range(4, 8):
            p = fitted(frame, columns, r)
            errors.append(np.mean([abs(p[e] - y) for e, y in zip(frame.entity, frame.ActualFinish) if e in p]))
        assert out[name]["races"] == 4 and abs(out[name]["mae_continuous"] - np.mean(errors)) < 1e-8
        assert abs(out[name]["delta_mae_continuous"] - (out[name]["mae_continuous"] - out["full"]["mae_continuous"])) < 1e-12


def test_race_metrics_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, "m", e, 5.0, float(e), e) for e in range(1, 5)], "rnd int, model string, entity int, score double, actual double, pred_rank int")
    assert metrics.race_metrics(rows, ["rnd", "model"]).first()["spearman"] == 0.0


def grown(train, test, columns, p, fold):
    """Brute force: every split of every node over the rows' own values, with the samples the library draws."""
    fill = train[columns].median().fillna(0.0)
    a, b, y = train[columns].fillna(fill).values, test[columns].fillna(fill).values, train.ActualFinish.values
    at, out = np.full(len(a), y.mean()), np.full(len(b), y.mean())
    soft = lambda g: np.sign(g) * max(abs(g) - p.l1, 0)

    def grow(g, rows, others, depth, allowed, live):
        taken = rows[live[rows]]
        total, n, best, where = g[taken].sum(), len(taken), p.gain, None
        for j in np.flatnonzero(allowed) if depth else []:
            for v in np.unique(a[taken, j])[:-1]:
                left = a[taken, j] <= v
                k = left.sum()
                if min(k, n - k) >= p.leaf:
                    s = g[taken][left].sum()
                    gain = soft(s) ** 2 / (k + p.l2) + soft(total - s) ** 2 / (n - k + p.l2) - soft(total) ** 2 / (n + p.l2)
                    if gain > best + 1e-9 * abs(best):
                        best, where = gain, (j, v)
        if where is None:
            at[rows] += p.rate * -soft(total) / (n + p.l2)
            out[others] += p.rate * -soft(total) / (n + p.l2)
            return
        j, v = where
        for side in (np.less_equal, np.greater):
            grow(g, rows[side(a[rows, j], v)], others[side(b[others, j], v)], depth - 1, allowed, live)

    for r in range(p.rounds):
        live = boosting.sampled_rows(train.number.values, fold, r, p)
        grow(at - y, np.arange(len(a)), np.arange(len(b)), p.depth, boosting.sampled_features(len(columns), fold, r, p), live)
    return dict(zip(test.entity, out))


@pytest.mark.parametrize(
    "p", [boosting.Penalised(rounds=250, rows=1.0, features=1.0, bins=700), boosting.Penalised(rounds=40, rate=0.2, depth=2, rows=0.7, features=0.6, leaf=5, bins=700)]
)
def test_boosting_by_brute_force(spark, frame, p):
    columns = ["a", "b", "c", "d", "same"]
    rows = frame[frame.rnd <= 5].head(500).copy()
    rows["ActualFinish"] = rows.ActualFinish + 3 * np.sin(3 * rows.a.fillna(0))
    table = spark.createDataFrame(rows)
    rows["number"] = [r[0] for r in table.select(F.xxhash64("series", "rnd", "entity")).collect()]
    held = boosting.fit(table.repartition(3), columns, "ActualFinish", [4, 5], p).held.toPandas()
    for fold in (4, 5):
        want = grown(rows[rows.rnd < fold], rows[rows.rnd == fold], columns, p, fold)
        got = dict(zip(held[held.rnd == fold].entity, held[held.rnd == fold].xgb))
        assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in want) < 1e-6


def test_boosting_doesnt_depend_on_partitions(spark, frame):
    p = boosting.Penalised(rounds=6, rate=0.3, bins=20)
    held = [boosting.walk_forward(spark.createDataFrame(frame).repartition(n), ["a", "b", "c"], params=p).toPandas().sort_values("entity") for n in (1, 7)]
    assert held[0].xgb.tolist() == held[1].xgb.tolist() and len(held[0]) == (frame.rnd > 3).sum()
    error = [np.abs(held[0].xgb - held[0].ActualFinish).mean(), np.abs(held[0].ActualFinish - frame.ActualFinish.mean()).mean()]
    assert error[0] < 0.8 * error[1]


def test_boosting_scores_unlabelled_rows(spark, frame):
    part = spark.createDataFrame(frame).withColumn("ActualFinish", F.when(F.col("rnd") < 6, F.col("ActualFinish")))
    p = boosting.Penalised(rounds=4, rate=0.3)
    m = boosting.fit(part, ["a", "b", "empty"], "ActualFinish", [1, 6, 40], p)
    held = m.held.toPandas()
    assert held[held.rnd == 1].xgb.eq(0).all() and held[held.rnd == 6].xgb.nunique() > 3 and set(held.rnd) == {1, 6}
    assert abs(m.importance(6).sum() - 1) < 1e-9 and m.importance(6)[2] == 0 and m.importance(1).sum() == 0


def test_student_tail_by_integration(spark):
    t = [0.0, 0.3, -1.0, 2.5, 12.0]
    degrees = [1, 2, 3, 4, 9, 24, 121, 2000, 2001, 50_000]
    table = spark.createDataFrame([(x, float(v)) for x in t for v in degrees], "t double, v double")
    for r in table.withColumn("p", metrics._student_tail(F.col("t"), F.col("v"))).collect():
        x = np.linspace(0, abs(r["t"]), 200_001)
        density = np.exp(math.lgamma((r["v"] + 1) / 2) - math.lgamma(r["v"] / 2)) / math.sqrt(r["v"] * math.pi) * (1 + x * x / r["v"]) ** (-(r["v"] + 1) / 2)
        want = 1 - 2 * float(np.sum((density[1:] + density[:-1]) / 2 * np.diff(x)))
        assert abs(r["p"] - want) < (2e-7 if r["v"] > 2000 else 1e-8), r


def test_signed_rank_chances_by_enumeration(spark):
    for n in (1, 2, 5, 9):
        sums = [sum(k + 1 for k in range(n) if picked >> k & 1) for picked in range(2**n)]
        want = np.bincount(sums, minlength=n * (n + 1) // 2 + 1) / 2**n
        rows = spark.createDataFrame([(n, float(s)) for s in range(len(want))], "n long, s double")
        got = rows.select("s", metrics._signed_rank_chances(F.col("n")).alias("c"), metrics._exact_signed_rank_p(F.col("n"), F.col("s")).alias("p")).collect()
        assert np.allclose(got[0]["c"], want)
        assert all(abs(r["p"] - min(1, 2 * min(want[: int(r["s"]) + 1].sum(), want[int(r["s"]) :].sum()))) < 1e-12 for r in got)


@pytest.mark.parametrize("grid", [pooled.Grid(), pooled.Grid(cells=3, block=10), pooled.Grid(cells=2, block=1), pooled.Grid(cells=7, block=40)])
def test_pooled_metrics_by_brute_force(spark, grid):
    """Ties, gaps that differ by weighting, a weighting without rows and one without spread."""
    rng = np.random.default_rng(6)
    n = 400
    df = pd.DataFrame({"a": rng.integers(0, 12, n) / 2, "b": rng.normal(size=n) ** 3 * 1e3, "c": np.full(n, 4.0), "none": np.full(n, np.nan), "actual": rng.integers(1, 9, n) * 1.0})
    df.loc[rng.random(n) < 0.3, "a"] = np.nan
    df.loc[rng.random(n) < 0.1, "actual"] = np.nan
    names = ["a", "b", "c", "none"]
    table = spark.createDataFrame(df).repartition(5)
    table = table.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    out = pooled.pooled(table, lambda c: np.stack([c[m] for m in names]), 4, grid)
    for i, m in enumerate(names):
        own = df[[m, "actual"]].dropna()
        got = out.iloc[i]
        assert got["samples"] == len(own)
        if len(own):
            e = (own[m] - own["actual"]).abs()
            rho = own[m].rank().corr(own["actual"].rank()) if own[m].nunique() > 1 else 0.0
            assert np.allclose([got["mae"], got["medae"], got["rmse"], got["spearman"]], [e.mean(), e.median(), np.sqrt((e**2).mean()), rho])


def test_blends_of_many_outcomes_take_the_other_way(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = pd.DataFrame(rng.normal(size=(200, 5)), columns=["rf", "xgb", "ridge", "grid", "actual"])
    table = spark.createDataFrame(df)
    near = [{r[c]: r for r in f(table).collect()} for f, c in ((metrics.model_comparison, "model"),)]
    sweep = {(r["model"], r["grid_weight"]): r for r in metrics.blend_sweep(table, metrics.BLENDS[:3]).collect()}
    monkeypatch.setattr(pooled, "ACTUALS", 10)
    for r in metrics.model_comparison(table).collect():
        want = near[0][r["model"]]
        assert all(r[c] == pytest.approx(want[c]) for c in ("samples", "mae", "medae", "rmse", "spearman", "w_rf", "is_best"))
    again = {(r["model"], r["grid_weight"]): r for r in metrics.blend_sweep(table, metrics.BLENDS[:3]).collect()}
    assert again.keys() == sweep.keys()
    assert all(again[k][c] == pytest.approx(sweep[k][c]) for k in again for c in ("samples", "mae", "medae", "rmse", "spearman", "delta_mae"))


def test_forecasts_know_nothing_of_their_round(spark):
    """Other results of the target round change neither forecast; chances add up; all models and folds take part."""
    from lapwing.queries.models import QUICK, forecast_rows
    from lapwing.session import cut_lineage

    small = type(QUICK)(type(QUICK.forest)(trees=2, depth=3), boosting.Penalised(rounds=2, rate=0.3, bins=16))
    rows = cut_lineage(forecast_rows(spark, "/root/testdata/sf0.001").where("rnd >= 20"))
    target = 28
    last = F.col("rnd") == target
    other = rows.withColumns({"ActualFinish": F.when(last, 99.0).otherwise(F.col("ActualFinish")), "status": F.when(last, "Engine").otherwise(F.col("status"))})
    found = []
    for table in (rows, other):
        out = forecasts.race_forecast(table, target, params=small, columns=["GridPosition", "avg_finish", "driver_finish_ewma", "quali_gap_pct"], retired=F.col("status") == "Engine")
        found.append({r["entity"]: r for r in out.table.collect()})
        assert out.comparison.count() == len(metrics.BLENDS) and out.sigma >= metrics.MIN_SCALE
    assert found[0] == found[1] and len(found[0]) > 5
    live = [r for r in found[0].values() if r["ExpectedFinish"] is not None]
    assert sum(r["WinProbability"] for r in live) == pytest.approx(100) and sorted(r["PredictedPosition"] for r in live) == list(range(1, len(live) + 1))
    assert {r["scenarios"] for r in live} == {5} and all(r["rain_probability"] is not None for r in live)

    quali = [forecasts.qualifying_forecast(t, target, params=small, columns=["avg_grid", "driver_quali_ewma"]) for t in (rows, rows.withColumn("q_position", F.when(last, 3).otherwise(F.col("q_position"))))]
    a, b = ({r["entity"]: r for r in q.table.collect()} for q in quali)
    assert a == b and sum(r["PoleProbability"] for r in a.values()) == pytest.approx(100)


def test_sigma_is_the_robust_spread(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 5, 301)
    rows = spark.createDataFrame([(float(x),) for x in r] + [(None,)], "residual double")
    assert forecasts._sigma(rows) == pytest.approx(1.4826 * np.median(np.abs(r - np.median(r))))
    assert forecasts._sigma(rows.limit(0)) == forecasts.FALLBACK_SIGMA
