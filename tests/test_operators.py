import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lapwing.operators import archive, calendar, conversion, form, grids, metrics, quality, roster, pit_plans, replay, stints, teammates, weekend
from lapwing.plans import models


def results(spark, data):
    """(rnd, entity, team, grid, position, points, status) rows of one championship."""
    return spark.createDataFrame(
        [(1, *d) for d in data], "series long, rnd long, entity long, team long, grid long, position long, points double, status string"
    )


def test_form_matches_the_recursive_definition(spark):
    pos = [3, 8, None, 5, 12, 1]
    data = [(r, 1, 1, r, p, 1.0, "Finished" if r % 2 else "Engine") for r, p in enumerate(pos, 1)]
    out = form.add_driver_form(results(spark, data), ["series", "entity"]).orderBy("rnd").collect()
    for i, row in enumerate(out):
        seen = pd.Series([p for p in pos[:i] if p is not None], dtype=float)
        want = seen.ewm(alpha=0.3, adjust=False).mean().iloc[-1] if len(seen) else 12.0
        assert row["driver_finish_ewma"] == pytest.approx(want)
        assert row["avg_finish"] == pytest.approx(seen.mean() if len(seen) else 12.0)
        assert row["recent_finish"] == (seen.iloc[-1] if len(seen) else 12.0)
        assert row["races_completed"] == i
    assert out[-1]["driver_dnf_rate"] == pytest.approx(2 / 5)
    single = form.season_form(results(spark, data), ["series", "entity"], 6).first()
    for c in ("driver_finish_ewma", "avg_finish", "driver_dnf_rate", "recent_grid", "races_completed"):
        assert single[c] == pytest.approx(out[-1][c])


def test_rates_use_their_own_denominators(spark):
    data = [(r, 1, 1, 1, 1, 0.0, s) for r, s in enumerate(["Finished", "DNS", "DSQ", "NC", "Engine", None], 1)]
    row = form.season_form(results(spark, data), ["series", "entity"], 9).first()
    assert (row["driver_dns_rate"], row["driver_dsq_rate"]) == (0.2, 0.2)
    assert (row["driver_dnf_rate"], row["driver_nc_rate"]) == (0.25, 0.25)


def test_rolling_finish_skips_unknown_results(spark):
    data = [(r, 1, 1, 1, p, 0.0, "Finished") for r, p in enumerate([4, None, 8, 6, None, 2], 1)]
    got = [r["rolling_finish"] for r in form.add_rolling_finish(results(spark, data), ["series", "entity"]).orderBy("rnd").collect()]
    assert got == [12.0, 4.0, 4.0, 6.0, 6.0, 6.0]


def test_team_form_with_one_car_missing(spark):
    data = [(1, 1, 9, 1, 4, 12.0, "Finished"), (2, 1, 9, 1, 6, 8.0, "Finished"), (2, 2, 9, 2, 2, 18.0, "Finished"), (3, 1, 9, 1, 1, 25.0, "Finished")]
    out = {r["rnd"]: r for r in form.team_form(results(spark, data), ["series", "team"]).collect()}
    assert out[1]["team_avg_finish"] == 12.0
    assert out[3]["team_avg_finish"] == 4.0 and out[3]["team_points"] == 38.0
    assert out[3]["team_finish_ewma"] == pytest.approx(pd.Series([4.0, 6, 2]).ewm(alpha=0.3, adjust=False).mean().iloc[-1])
    assert out[3]["team_points_rate"] == pytest.approx(38 / 4)


def test_teammates_need_exactly_two(spark):
    data = [(1, 1, 1, 3, 1, 0.0, None), (1, 2, 1, 7, 2, 0.0, None), (1, 3, 2, 5, 3, 0.0, None), (1, 4, 3, 1, 4, 0.0, None),
            (1, 5, 3, 2, 5, 0.0, None), (1, 6, 3, 4, 6, 0.0, None)]
    out = teammates.add_grid_delta(results(spark, data), ["series", "rnd", "team"])
    assert rows(out, "entity", "teammate_grid_delta") == [(1, -4.0), (2, 4.0), (3, None), (4, None), (5, None), (6, None)]


def test_head_to_head(spark):
    ok, out = "Finished", "Engine"
    data = []
    for r, (a, b) in enumerate([((2, ok), (5, ok)), ((9, out), (8, out)), ((9, out), (3, ok)), ((1, ok), (2, ok)), ((1, ok), (2, ok))], 1):
        data += [(r, 1, 7, 1, a[0], 0.0, a[1]), (r, 2, 7, 2, b[0], 0.0, b[1])]
    got = {(r["rnd"], r["entity"]): r["driver_teammate_h2h_ratio"] for r in teammates.h2h(results(spark, data), ["series"]).collect()}
    assert got[1, 1] == 0.5
    assert got[2, 1] == pytest.approx(2.5 / 4)
    assert got[3, 1] == got[2, 1]  # both out: not counted
    assert got[4, 1] == pytest.approx(2.5 / 5)
    assert got[5, 1] == pytest.approx(3.5 / 6) and got[5, 2] == pytest.approx(2.5 / 6)


def test_head_to_head_is_clamped_and_follows_the_seat(spark):
    data = []
    for r in range(1, 21):
        data += [(r, 1, 7, 1, 1, 0.0, "Finished"), (r, 2, 7, 2, 2, 0.0, "Finished")]
    # driver 3 takes the seat of driver 2; 2 moves to a team of three
    data += [(21, 1, 7, 1, 1, 0.0, "Finished"), (21, 3, 7, 2, 2, 0.0, "Finished")]
    data += [(21, e, 8, 3, e, 0.0, "Finished") for e in (2, 4, 5)]
    got = {(r["rnd"], r["entity"]): r["driver_teammate_h2h_ratio"] for r in teammates.h2h(results(spark, data), ["series"]).collect()}
    assert got[20, 1] == 0.85 and got[20, 2] == 0.15
    assert got[21, 1] == 0.5 and got[21, 2] == 0.5


def test_bucket_without_finisher_uses_its_midpoint(spark):
    data = [(1, 1, 1, 1, 1, 0.0, "Engine"), (1, 2, 1, 2, 9, 0.0, "Engine"), (1, 3, 2, 4, 3, 0.0, "Finished"), (2, 1, 1, 1, 1, 0.0, "Finished")]
    got = {(r["rnd"], r["slot"]): r for r in conversion.conversion_map(results(spark, data), ["series"], 22).collect()}
    front, top5, back = got[2, 1], got[2, 4], got[2, 20]
    assert front["expected_grid_finish"] == pytest.approx((2 * 1.5 + 5 * 1) / 7)
    assert front["grid_retention_prob"] == pytest.approx((2 * 0.5 + 5 * 0.5) / 7)
    assert top5["expected_grid_finish"] == pytest.approx((1 * 3 + 5 * 4) / 6)
    assert back["expected_grid_finish"] == 20.0
    assert got[1, 22]["grid_retention_prob"] == pytest.approx(0.75)


def penalised(spark, entrants, penalties):
    e = spark.createDataFrame([(1, *x) for x in entrants], "race int, driver string, q_position int, tie_time double, status string, is_pit_lane boolean, permitted_to_start boolean")
    p = spark.createDataFrame([(1, *x) for x in penalties], "race int, driver string, penalty_type string, places int, reason string") if penalties else None
    return {r["driver"]: r for r in grids.resolve_grid(e, p, ["race"]).collect()}


def test_grid_penalties(spark):
    entrants = [(chr(64 + i), i, 80.0 + i, "", False, False) for i in range(1, 11)]
    got = penalised(spark, entrants, [("A", "GRID_DROP", 3, ""), ("B", "GRID_DROP", 2, ""), ("C", "GRID_DROP", 10, ""), ("C", "GRID_DROP", 5, ""),
                                      ("D", "PIT_LANE", 0, ""), ("E", "DNS", 0, ""), ("F", "BACK_OF_GRID", 0, ""), ("G", "DSQ", 0, "permitted under rule")])
    order = sorted((r["simulation_start_rank"], d) for d, r in got.items() if r["simulation_start_rank"])
    assert [d for _, d in order] == ["A", "B", "H", "I", "J", "C", "F", "G", "D"]
    assert got["D"]["ActualStartingGrid"] is None and got["D"]["is_pit_lane_start"] == 1
    assert got["E"]["StartingGridStatus"] == "DNS" and got["E"]["simulation_start_rank"] is None
    assert got["C"]["grid_penalty_places"] == 15 and got["C"]["StartingGridStatus"] == "PENALIZED"
    assert got["H"]["StartingGridStatus"] == "CLASSIFIED"


def test_grid_rule_equals_the_pairwise_rule(spark):
    rng = np.random.default_rng(11)
    entrants, penalties, want = [], [], []
    for race in range(60):
        places = {d: int(rng.choice([0, 0, 0, 1, 2, 3, 5, 10])) for d in range(12)}
        quali = dict(enumerate(rng.permutation(12) + 1))
        for d in range(12):
            entrants.append((race, f"d{d:02d}", int(quali[d])))
            if places[d]:
                penalties.append((race, f"d{d:02d}", "GRID_DROP", places[d]))

        def ahead(a, b):
            qa, qb, pa, pb = quali[a], quali[b], places[a], places[b]
            if not pa and not pb:
                return qa < qb
            if pa and not pb:
                return not qa + pa >= qb
            if pb and not pa:
                return qb + pb >= qa
            return (qa + pa, qa) < (qb + pb, qb)

        want += [((race, f"d{a:02d}"), 1 + sum(ahead(b, a) for b in range(12) if b != a)) for a in range(12)]
    e = spark.createDataFrame(entrants, "race int, driver string, q_position int")
    p = spark.createDataFrame(penalties, "race int, driver string, penalty_type string, places int")
    got = {(r["race"], r["driver"]): r["simulation_start_rank"] for r in grids.resolve_grid(e, p, ["race"]).collect()}
    assert got == dict(want)


def test_short_grid_fails_loudly(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "race int, driver string, simulation_start_rank long")
    assert grids.sorted_grid(df, ["race"], 2).count() == 2
    with pytest.raises(Exception, match="grid has 2 entrants"):
        grids.sorted_grid(df, ["race"], 22).collect()


def test_manifest_errors(spark):
    doc = lambda grid: f'{{"season":1,"round":1,"circuit_key":"c","publication_status":"FINAL","grid":{grid}}}'
    docs = [
        doc('[{"driver":"a","grid_pos":1,"simulation_start_rank":1},{"driver":"b","is_pit_lane_start":1,"simulation_start_rank":2}]'),
        doc('[{"driver":"a","grid_pos":1},{"driver":"A ","grid_pos":3},{"driver":"c","is_pit_lane_start":1,"grid_pos":2},{"driver":"d"}]'),
        doc("[]"),
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    parsed = df.select("i", F.from_json("doc", grids.MANIFEST_SCHEMA).alias("m")).select("i", "m.*")
    got = {r["i"]: r["errors"] for r in grids.manifest_errors(parsed, ["i"]).collect()}
    assert got[0] == ""
    assert got[1] == "duplicate driver; pit-lane starter with grid position; starter without grid position; grid positions not contiguous"
    assert got[2] == "empty grid"


def test_stints(spark):
    t = [90.0, 90.5, 91.0, 91.5, 92.0, 130.0]
    data = [(1, 1, "SOFT", i, s, False) for i, s in enumerate(t, 1)] + [(1, 2, "HARD", i, 88.0, False) for i in range(1, 4)]
    data += [(1, 3, "HARD", i, 88.0, i > 3) for i in range(1, 8)]
    laps = spark.createDataFrame(data, "entity int, stint int, compound string, lap int, lap_s double, deleted boolean")
    out = stints.stint_summary(laps, ["entity", "stint", "compound"]).collect()
    assert len(out) == 1
    row = out[0]
    assert row["lap_count"] == 5 and row["median_lap"] == 91.0 and row["deg_slope"] == pytest.approx(0.5)
    assert row["fuel_adj_mean_lap"] == pytest.approx(np.mean(np.array(t[:5]) + 0.035 * np.arange(5)))
    assert row["std_lap"] == pytest.approx(np.std(t[:5]))


def test_robust_slope_bounds_and_short_stints(spark):
    x = np.arange(12)
    noisy = 90 + 0.1 * x + np.random.default_rng(2).normal(0, 0.2, 12)
    noisy[10] += 4
    m, c = np.polyfit(x, noisy, 1)
    res = noisy - (m * x + c)
    keep = np.abs(res) <= max(2.5 * 1.4826 * np.median(np.abs(res - np.median(res))), 0.5)
    assert 3 <= keep.sum() < 12
    want = np.polyfit(x[keep], noisy[keep], 1)[0]
    data = [(1, float(i), float(v)) for i, v in zip(x, noisy)] + [(2, float(i), float(90 + 5 * i)) for i in x] + [(3, float(i), float(95 - i)) for i in x]
    data += [(4, 0.0, 90.0), (4, 1.0, 91.0)]
    out = {r["k"]: r for r in stints.robust_slope(spark.createDataFrame(data, "k int, age double, lap_s double"), ["k"], "age").collect()}
    assert out[1]["slope"] == pytest.approx(want)
    assert out[2]["slope"] == 0.40 and out[3]["slope"] == 0.005
    assert (out[4]["slope"], out[4]["r2"]) == (0.05, 0.0)


def test_wear_borrows_from_the_teammate(spark):
    laps = spark.createDataFrame([(1, 10, 1, "SOFT", i, 90 + 0.2 * i) for i in range(1, 7)], "race int, entity int, stint int, compound string, lap int, lap_s double")
    lineup = spark.createDataFrame([(1, 10, 5, 1.0), (1, 11, 5, 1.0), (1, 12, 6, 2.0)], "race int, entity int, team int, deg_multiplier double")
    out = {r["entity"]: r for r in stints.compound_wear(laps, lineup, ["race"]).collect()}
    assert out[10]["soft_tyre_deg_rate"] == pytest.approx(0.5 * 0.2 + 0.5 * 0.110)
    assert out[11]["soft_tyre_deg_rate"] == pytest.approx(0.5 * 0.2 + 0.5 * 0.110)
    assert out[12]["soft_tyre_deg_rate"] == pytest.approx(0.220)
    assert out[10]["tyre_deg_confidence"] == pytest.approx(6 / 18) and out[11]["tyre_deg_confidence"] == 0.20


def test_stage_mask_hides_every_listed_column(spark):
    cols = sorted({c for v in quality.STAGE_HIDDEN.values() for c in v})
    df = spark.range(1).select(*[F.lit(1.0).alias(c) for c in cols], F.lit(2.0).alias("avg_finish"))
    for stage, hidden in quality.STAGE_HIDDEN.items():
        row = quality.mask_stage(df, stage).first().asDict()
        assert {c for c, v in row.items() if v is None} == set(hidden)
    assert quality.forbidden_columns(["Points", "grid"]) == ["Points"]
    assert quality.forbidden_columns(["Points"], "post_race") == []


def test_permutation_and_keep_first(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1), (3, 1, 0), (3, 2, 2)], "race int, e int, g int")
    got = {r["race"]: r["is_permutation"] for r in quality.permutation_check(df, ["race"], "e", "g").collect()}
    assert got == {1: True, 2: False, 3: False}
    assert rows(quality.keep_first(df, ["race"], [-F.col("e")])) == [(1, 2, 2), (2, 2, 1), (3, 2, 2)]


def test_career_before_qualifying_records(spark):
    data = [("x", 1992, 1, "T", 1, "1", 10.0, "Finished"), ("x", 1995, 1, "T", 2, "2", 6.0, "+1 Lap"), ("x", 1995, 2, "U", 14, "14", 0.0, "Engine"),
            ("x", 1995, 3, "U", None, "W", 0.0, "Withdrew"), ("x", 1995, 4, "U", None, "R", 0.5, "Engine")]
    df = spark.createDataFrame(data, "entity string, season int, rnd int, constructor string, position int, position_text string, points double, status string")
    quali = spark.createDataFrame([("x", 1995, 1, 1), ("x", 1995, 2, 2)], "entity string, season int, rnd int, q_position int")
    row = archive.career_stats(df, quali, ["entity"]).first()
    assert (row["total_entries"], row["total_starts"], row["wins"], row["podiums"]) == (5, 4, 1, 2)
    assert (row["classified_retirements"], row["unclassified_retirements"], row["dnf_count"]) == (1, 1, 2)
    assert row["career_poles"] is None and row["known_covered_poles"] == 1
    assert row["seasons_missing"] == [1993, 1994] and row["retirement_reasons"] == "Engine:2"
    assert row["avg_finish_position"] == pytest.approx(17 / 3) and row["total_points"] == 16.5


def test_season_ranges(spark):
    df = spark.createDataFrame([("a", y) for y in (2018, 2019, 2021)] + [("b", 2020)], "k string, season int")
    got = {r["k"]: r for r in calendar.season_ranges(df, ["k"]).collect()}
    assert got["a"]["ranges"] == "2018–2019, 2021" and got["a"]["available"] == "2018, 2019, 2021" and not got["a"]["is_contiguous"]
    assert got["b"]["available"] == "2020"
    assert rows(calendar.default_season(df, ["k"], 2019), "k", "default_season") == [("a", 2019), ("b", 2020)]


def test_roster_fills_the_team_from_qualifying(spark):
    prior = spark.createDataFrame(
        [(1, "T", "old", 1, 1, 0), (1, "T", "aaa", 5, 0, 0), (1, "T", "bbb", 5, 0, 1), (1, "T", "aaa", 5, 1, 0), (1, "T", "old", 5, 1, 1)],
        "race int, team string, driver string, rnd_seen int, kind int, ordinal int",
    )
    pool = roster.season_pool(prior, ["race"])
    assert rows(pool, "driver") == [("aaa",), ("bbb",)]
    seats = spark.createDataFrame([(1, "T", "new", "practice")], "race int, team string, driver string, source string")
    stack = seats.unionByName(pool.select("race", "team", "driver", F.lit("season_pool").alias("source")))
    races = spark.createDataFrame([(1, 20, "after_fp1")], "race int, expected int, stage string")
    assert rows(roster.resolve_roster(stack, races, ["race"]), "driver", "source") == [("aaa", "season_pool"), ("new", "practice")]


def test_exact_signed_rank(spark):
    a, b = [1.0, 2.5, 3.1, 4.9, 5.2, 6.6], [0.9, 2.0, 3.4, 4.1, 4.0, 5.0]
    row = metrics.paired_comparison(spark.createDataFrame([("m", x, y) for x, y in zip(a, b)], "m string, a double, b double"), ["m"]).first()
    # ranks of |d| = .1 .5 .3 .8 1.2 1.6 -> the negative one has rank 2: P(T <= 2) * 2 = 2 * 3/64
    assert row["p_value"] == pytest.approx(2 * 3 / 64) and row["test_type"] == "wilcoxon" and not row["significant"]
    d = np.array(a) - np.array(b)
    assert row["cohens_d"] == pytest.approx(d.mean() / d.std(ddof=1)) and row["median_diff"] == pytest.approx(np.median(d))


def test_paired_edge_cases(spark):
    zero = metrics.paired_comparison(spark.createDataFrame([("m", 1.0, 1.0)] * 6, "m string, a double, b double"), ["m"]).first()
    assert (zero["p_value"], zero["test_type"]) == (1.0, "exact_zero")
    few = metrics.paired_comparison(spark.createDataFrame([("m", 1.0, 2.0)] * 3, "m string, a double, b double"), ["m"]).first()
    assert few["test_type"] == "none"


def test_replayed_residuals(spark):
    """Two earlier races: entrants' errors stay together, retirements are replayed, a newcomer keeps its score."""
    old = [("s", 1, "a", 2.0, False), ("s", 1, "b", -1.5, False), ("s", 1, "c", 0.0, True), ("s", 2, "a", 0.0, False), ("s", 2, "b", 0.0, False), ("s", 2, "c", -3.0, False), ("s", 9, "a", 50.0, True), ("t", 1, "a", 9.0, True)]
    past = spark.createDataFrame(old, "series string, rnd int, entity string, residual double, retired boolean")
    now = spark.createDataFrame([("s", 3, "a", 1.0, None), ("s", 3, "b", 2.0, None), ("s", 3, "c", 3.0, None), ("s", 3, "new", 2.4, None), ("s", 3, "d", 1.0, "DNS"), ("s", 1, "a", 1.0, None), ("s", 1, "b", 2.0, None)], "series string, rnd int, entity string, score double, StartingGridStatus string")
    heats = replay.replay(now, past)
    assert {(r["rnd"], r["scenario"], r["entity"]): (r["raw"], r["retired"]) for r in heats.collect() if r["rnd"] == 3 and r["entity"] != "d"} == {
        (3, 1, "a"): (3.0, False), (3, 1, "b"): (0.5, False), (3, 1, "c"): (3.0, True), (3, 1, "new"): (2.4, False),
        (3, 2, "a"): (1.0, False), (3, 2, "b"): (2.0, False), (3, 2, "c"): (0.0, False), (3, 2, "new"): (2.4, False),
    }
    assert {r["scenario"] for r in heats.where("rnd = 1").collect()} == {-1}
    out = {(r["rnd"], r["entity"]): r for r in replay.finish_distribution(now, past).collect()}
    # races 1 and 2 replayed: b new a c and c a b new
    assert {e: out[3, e]["ExpectedFinish"] for e in ("a", "b", "c", "new")} == {"a": 2.5, "b": 2.0, "c": 2.5, "new": 3.0}
    assert [out[3, e]["PredictedPosition"] for e in ("b", "a", "c", "new")] == [1, 2, 3, 4] and out[3, "b"]["WinProbability"] == 50.0
    assert out[3, "d"]["ExpectedFinish"] is None and out[3, "d"]["WinProbability"] == 0.0 and out[1, "a"]["WinProbability"] == 100.0
    drawn = {(r["scenario"], r["entity"]): r["raw"] for r in replay.compress_field(heats.where("rnd = 3 and entity <> 'd'"), ["series", "rnd"], F.lit(0.5)).collect()}
    assert drawn[1, "c"] == 3.0 and drawn[1, "b"] == pytest.approx((0.5 + (3.0 + 0.5 + 2.4) / 3) / 2)


def test_plan_cost_equals_the_lap_sum(spark):
    df = spark.createDataFrame([(56, 22.0, 3.0, 0.11, None, 0.04)], "total_laps int, pit_loss_seconds double, QualifyingPosition double, soft_tyre_deg_rate double, medium_tyre_deg_rate double, hard_tyre_deg_rate double")
    got = {r["plan"]: r for r in pit_plans.plan_costs(df).collect()}
    cut = round(56 * 0.42)
    total = 22.0
    for lap in range(1, 57):
        c, age = ("MEDIUM", lap) if lap <= cut else ("HARD", lap - cut)
        total += 85 + 2 * 0.08 + pit_plans.COMPOUNDS[c].pace + (0.065 if c == "MEDIUM" else 0.04) * age + 0.035 * max(0, 56 - lap)
    assert got[0]["total_seconds"] == pytest.approx(total) and got[0]["plan_name"] == f"1-Stop (M-H) @ {cut}"


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [1.0, -0.4, 2.0] + rng.normal(size=200)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, k=1.0)
    df = spark.createDataFrame(pdf)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 100 * np.eye(3), z.T @ (y - y.mean()))
    model = models.Ridge(["a", "b", "c", "k"], "y", 100.0).fit(df)
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    assert np.allclose(np.sort(got), np.sort(z @ w + y.mean()), atol=1e-8)


def test_imputer_keeps_an_empty_feature(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (8.0, None)], "a double, b double")
    fill = models.medians(df, ["a", "b"])
    assert fill == {"a": 3.0, "b": 0.0}
    assert rows(models.impute(df, fill)) == [(1.0, 0.0), (3.0, 0.0), (3.0, 0.0), (8.0, 0.0)]


def test_ewma_at_any_length(spark):
    n = 2_600
    rows = spark.range(n).selectExpr("'s' as series", "'x' as entity", "'t' as team", "cast(id + 1 as int) as rnd", "cast(if(id % 7 = 3, null, id * 7919 % 20 + 1) as double) as position", "cast(id % 20 + 1 as double) as grid", "1.0D as points", "'Finished' as status")
    values, want, team = [r.position for r in rows.orderBy("rnd").collect()], {}, None
    for i, v in enumerate(values):
        want[i + 1] = team
        if v is not None:
            team = v if team is None else 0.7 * team + 0.3 * v
    got = {r.rnd: r.driver_finish_ewma for r in form.add_driver_form(rows, ["series", "entity"]).collect()}
    assert all(got[k] == pytest.approx(12.0 if v is None else v, rel=1e-9) for k, v in want.items())
    got = {r.rnd: r.team_finish_ewma for r in form.team_form(rows, ["series", "team"]).collect()}
    assert all(got[k] == pytest.approx(12.0 if v is None else v, rel=1e-9) for k, v in want.items())


def test_later_sessions_change_nothing(spark):
    from lapwing.plans import features

    row = "series string, rnd int, entity string, fp1_best_lap double, fp2_best_lap double, fp3_best_lap double, fp1_laps int, fp2_laps int, fp3_laps int"
    one = spark.createDataFrame([("s", 1, "a", 80.0, 79.0, 78.0, 9, 9, 9), ("s", 1, "b", 81.0, 77.0, 79.0, 9, 9, 9)], row)
    two = spark.createDataFrame([("s", 1, "a", 80.0, 70.0, 60.0, 9, 1, 1), ("s", 1, "b", 81.0, None, 90.0, 9, 2, 3)], row)
    blocks = [sorted(weekend.add_practice_features(features.gate_practice(t, "after_fp1"), ["series", "rnd"]).collect()) for t in (one, two)]
    assert blocks[0] == blocks[1]
    assert features.gate_practice(one, "after_qualifying").collect() == one.collect()
    laps = spark.createDataFrame([("fp1", 1), ("fp2", 2), (None, 3)], "session string, lap int")
    assert [r.lap for r in features.gate_laps(laps, "after_fp1").collect()] == [1] and features.gate_laps(laps, "pre_fp1").count() == 0


def test_manifest_fields_and_statuses(spark):
    docs = ['{"season":1,"round":1,"grid":[{"driver":"a","grid_pos":1}]}', '{"season":1,"round":2,"circuit_key":"c","publication_status":"maybe"}',
            '{"season":1,"round":3,"circuit_key":"c","publication_status":" final ","grid":[{"driver":"a","grid_pos":1}]}']
    parsed = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string").select("i", F.from_json("doc", grids.MANIFEST_SCHEMA).alias("m")).select("i", "m.*")
    got = {r["i"]: r["errors"] for r in grids.manifest_errors(parsed, ["i"]).collect()}
    assert got == {0: "missing circuit_key; missing publication_status", 1: "missing grid; unknown publication_status", 2: ""}
    bare = {r["i"]: r["errors"] for r in grids.manifest_errors(parsed.drop("circuit_key", "season"), ["i"]).collect()}
    assert bare[2] == "missing season; missing circuit_key"


def test_grids_before_qualifying_are_unpublished(spark):
    races = spark.createDataFrame([(1, "after_fp3"), (2, None), (3, "before_race"), (4, " AFTER_SPRINT ")], "race int, stage string")
    rows = [(r, d, p, s, v) for r in (1, 2, 4) for d in ("a", "b") for p, s, v in ((4, "algorithmic_fallback", True), (1, "official_manifest", r != 2))]
    stack = spark.createDataFrame(rows, "race int, driver string, priority int, source string, valid boolean")
    got = sorted((r["race"], r["driver"], r["provenance"], r["publication_status"], r["document_reference"]) for r in grids.resolve_grids(races, stack, ["race"]).fillna("").collect())
    assert got == [
        (1, "", "unpublished", "UNOFFICIAL", "Pre-Qualifying Cutoff"), (2, "a", "algorithmic_fallback", "", ""), (2, "b", "algorithmic_fallback", "", ""),
        (3, "", "unavailable", "UNOFFICIAL", ""), (4, "", "unpublished", "UNOFFICIAL", "Pre-Qualifying Cutoff"),
    ]


def test_weekend_stages(spark):
    seen = spark.createDataFrame([(r, s) for r in (1, 2) for s in ("fp1", "fp2", "sprint_race", "qualifying", "race")], "rnd int, session string")
    target = lambda *t: spark.createDataFrame(t, "rnd int, stage string, is_sprint boolean")
    got = calendar.weekend_sessions(seen, target((1, "after_sprint", True), (2, "after_fp2", None)), ["rnd"])
    assert rows(got, "rnd", "session") == [(1, "fp1"), (1, "sprint_race"), (2, "fp1"), (2, "fp2")]
    wrong = target((1, "after_fp2", True), (2, "after_sprint_race", False), (3, "never", False), (4, None, True))
    assert rows(calendar.stage_errors(wrong), "rnd", "error") == [
        (1, "stage is invalid for a sprint weekend"), (2, "stage is invalid for a standard weekend"), (3, "unknown stage"),
    ]
    assert calendar.weekend_sessions(seen, wrong, ["rnd"], strict=False).count() == 0
    with pytest.raises(Exception, match="stage is invalid for its weekend"):
        calendar.weekend_sessions(seen, wrong, ["rnd"]).collect()


def test_training_errors(spark):
    good = spark.createDataFrame([(3, "a", 1.0, 2.0, 2)], "rnd int, entity string, ActualFinish double, GridPosition double, races_completed int")
    assert rows(quality.training_errors(good, 20)) == []
    assert rows(quality.training_errors(good.limit(0), 20)) == [("empty training set", 0)]
    assert rows(quality.training_errors(good.select("rnd"), 20)) == [("missing column ActualFinish", 0), ("missing column GridPosition", 0), ("missing column entity", 0)]
    bad = good.withColumns({"races_completed": F.lit(3), "GridPosition": F.lit("21")})
    assert rows(quality.training_errors(bad, 20)) == [("grid position out of range", 1), ("impossible history", 1)]
