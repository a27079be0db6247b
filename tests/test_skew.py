"""The split operators must agree with brute force, hot groups or not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapwing.operators import skew, stints
from lapwing.operators.metrics import pooled_metrics, robust_scale
from lapwing.sources import star


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 6000
    # one key holds more than half of the rows, with many ties
    key = np.where(rng.random(n) < 0.55, 0, rng.integers(1, 40, n))
    value = np.round(rng.normal(100, 30, n), 1)
    value[rng.random(n) < 0.2] = 100.0
    pdf = pd.DataFrame({"k": key, "v": value, "o": rng.permutation(n), "day": rng.integers(0, 30, n)})
    return spark.createDataFrame(pdf).repartition(6), pdf


@pytest.mark.parametrize("hot_rows", [None, 50, 500])
@pytest.mark.parametrize("p", [0.5, 0.05, 0.9, 0.0, 1.0])
def test_group_percentile(frame, p, hot_rows):
    df, pdf = frame
    hot = skew.find_hot(df, ["k"], hot_rows)
    assert (hot is None) == (hot_rows is None)
    got = {r["k"]: r["m"] for r in skew.group_percentile(df, ["k"], "v", p, "m", hot).collect()}
    want = pdf.groupby("k")["v"].quantile(p).to_dict()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_ordered_index(frame, hot_rows):
    df, pdf = frame
    hot = skew.find_hot(df, ["k"], hot_rows)
    steps = [F.format_string("%05d", F.col("day")), F.floor(F.col("o") / 100)]
    out = skew.ordered_index(df, ["k"], [F.col("day"), F.col("o")], steps, "i", hot)
    got = {r["o"]: r["i"] for r in out.collect()}
    want = pdf.sort_values(["k", "day", "o"]).assign(i=lambda d: d.groupby("k").cumcount() + 1)
    assert got == dict(zip(want["o"], want["i"]))


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_attach_keeps_every_row(frame, hot_rows):
    df, pdf = frame
    hot = skew.find_hot(df, ["k"], hot_rows)
    stats = df.groupBy("k").agg(F.sum("v").alias("s"))
    out = skew.attach(df, stats, ["k"], hot)
    assert out.count() == len(pdf)
    assert out.columns == ["k", "v", "o", "day", "s"]
    assert out.where(F.col("k") == 0).select("s").distinct().count() == 1


def test_every_hot_group_is_listed(frame):
    df, pdf = frame
    hot = skew.find_hot(df, ["k"], 100)
    sizes = pdf.groupby("k").size()
    assert {r.k: r.hot_rows for r in hot.frame.collect()} == sizes[sizes > 100].to_dict()


def test_rank_correlation(frame):
    df, pdf = frame
    got = {r["k"]: r["rho"] for r in skew.rank_correlation(df, ["k"], "v", "day", "rho", width=7.0).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(part["v"].rank().corr(part["day"].rank()), abs=1e-9)


def test_rank_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 2.0)], "k int, x double, y double")
    assert skew.rank_correlation(df, ["k"], "x", "y", "rho").first()["rho"] == 0.0


def test_stints_and_slopes_agree_with_and_without_hot_groups(spark):
    sf = "/root/testdata/sf0.001"
    hot = star.hot_stints(spark, sf, 9)
    assert hot is not None and hot.frame.count() > 20
    keys = star.KEYS + ["stint", "compound"]
    for build in (
        lambda h: stints.stint_summary(star.laps(spark, sf, h), keys, hot=h),
        lambda h: stints.robust_slope(star.laps(spark, sf, h), star.STINT_KEYS, "lap", h),
    ):
        plain = build(None).toPandas().sort_values(star.STINT_KEYS).reset_index(drop=True)
        split = build(hot).toPandas().sort_values(star.STINT_KEYS).reset_index(drop=True)
        pd.testing.assert_frame_equal(plain, split, check_dtype=False, atol=1e-9)


def test_pooled_metrics_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"m": "a", "score": rng.normal(10, 4, 800), "actual": rng.integers(1, 21, 800).astype(float)})
    df = spark.createDataFrame(pdf)
    for limit in (10_000, 100):
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
        row = pooled_metrics(df, ["m"]).first()
        err = (pdf["score"] - pdf["actual"]).abs()
        assert row["mae"] == pytest.approx(err.mean())
        assert row["medae"] == pytest.approx(err.median())
        assert row["rmse"] == pytest.approx(np.sqrt((err**2).mean()))
        assert row["spearman"] == pytest.approx(pdf["score"].rank().corr(pdf["actual"].rank()))


def test_robust_scale(spark, monkeypatch):
    values = np.random.default_rng(5).normal(0, 3, 401)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "r": values}))
    want = max(1.4826 * np.median(np.abs(values - np.median(values))), 1.5)
    for limit in (10_000, 50):
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
        assert robust_scale(df, ["k"], "r").first()["sigma"] == pytest.approx(want)
    assert robust_scale(df.withColumn("r", F.lit(0.1)), ["k"], "r").first()["sigma"] == 1.5


def test_null_keys_and_empty_groups_are_kept_on_both_ways(spark):
    from lapwing.operators import skew

    data = [("a", float(i)) for i in range(30)] + [(None, float(i * i)) for i in range(25)] + [("b", None)] * 20 + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    hot = skew.find_hot(df, ["k"], 10)
    sides = []
    for groups in (None, hot):
        out = skew.add_group_percentile(df, ["k"], "v", 0.3, "p", groups)
        out = skew.add_group_columns(out, ["k"], {"n": F.count("v")}, groups)
        sides.append(sorted((r.k or "", r.v if r.v is not None else -1.0, r.p, r.n) for r in out.collect()))
    assert len(sides[0]) == len(data)
    assert [(k, v, p and round(p, 9), n) for k, v, p, n in sides[0]] == [(k, v, p and round(p, 9), n) for k, v, p, n in sides[1]]
