"""The staged matrix against single stages, and seasons that don't mix."""

import pytest
from pyspark.sql import functions as F

from lapwing.operators import weekend
from lapwing.operators.skew import find_hot
from lapwing.plans import features
from lapwing.queries.features import MATRIX, raw_matrix, raw_rows
from lapwing.sources import star

SF = "/root/testdata/sf0.001"


def table(df, *keys):
    cols = [*keys, *[c for c in MATRIX if c in df.columns]]
    return {tuple(r)[: len(keys)]: tuple(round(x, 9) if isinstance(x, float) else x for x in tuple(r)[len(keys) :]) for r in df.select(*cols).collect()}


@pytest.fixture(scope="module")
def raw(spark):
    rows, laps, hot = raw_matrix(spark, SF)
    return rows, laps, hot


@pytest.fixture(scope="module")
def staged(spark, raw):
    rows, laps, hot = raw
    return features.staged_matrix(rows, laps=laps, hot=hot).persist()


@pytest.mark.parametrize("stage", ["pre_fp1", "after_fp2", "after_sprint_race", "before_race"])
def test_staged_matrix_is_every_stage_by_itself(raw, staged, stage):
    rows, laps, hot = raw
    one = features.build(rows, laps=laps, hot=hot, stage=stage)
    assert table(staged.where(F.col("stage") == stage), *star.KEYS) == table(one, *star.KEYS)


def test_all_stages_have_all_rows(raw, staged):
    n = raw[0].count()
    assert {r["stage"]: r["count"] for r in staged.groupBy("stage").count().collect()} == dict.fromkeys(features.ALL_STAGES, n)


def test_hot_stints_are_gated_too(spark, raw, staged):
    rows, laps, _ = raw
    hot = find_hot(laps, star.STINT_KEYS, 3)
    assert hot is not None
    few = ["after_fp1", "after_fp3"]
    again = features.staged_matrix(rows, laps=laps, hot=hot, stages=few)
    assert table(again, "stage", *star.KEYS) == table(staged.where(F.col("stage").isin(few)), "stage", *star.KEYS)


def test_later_sessions_leave_earlier_stages_alone(raw, staged):
    rows, laps, hot = raw
    later = rows.withColumns({f"fp3_{c}": F.col(f"fp3_{c}") * 0 + 61 for c in ("best_lap", "laps")})
    later = later.withColumns({c: F.col(c) + 1 for c in ("q1", "q2", "q3")})
    faster = laps.withColumn("lap_s", F.when(F.col("session") == "fp3", 61.0).otherwise(F.col("lap_s")))
    early = ["pre_fp1", "after_fp1", "after_fp2"]
    again = features.staged_matrix(later, laps=faster, hot=hot, stages=[*early, "after_fp3"])
    for stage in early:
        assert table(again.where(F.col("stage") == stage), *star.KEYS) == table(staged.where(F.col("stage") == stage), *star.KEYS)
    assert table(again.where("stage = 'after_fp3'"), *star.KEYS) != table(staged.where("stage = 'after_fp3'"), *star.KEYS)


def test_seasons_dont_mix(spark):
    """Rounds start anew in another season, whose rows change nothing in this one."""
    rows = raw_rows(spark, SF).withColumn("season", F.lit(2025))
    other = rows.withColumns({"season": F.lit(2026), "position": 21 - F.col("position"), "points": F.lit(1.0), "fp1_best_lap": F.lit(55.0)})
    both = features.build(rows.unionByName(other), series=["series", "season"])
    alone = features.build(rows)
    assert table(both.where("season = 2025"), *star.KEYS) == table(alone, *star.KEYS)
    assert table(both.where("season = 2026"), *star.KEYS) == table(features.build(other), *star.KEYS)
    assert weekend.SESSIONS == ("fp1", "fp2", "fp3")
