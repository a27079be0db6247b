"""Faults that showed on larger tables."""

import os

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from lapwing.operators import metrics
from lapwing.plans import boosting, gram, models
from lapwing.queries.registry import REGISTRY
from lapwing.session import cut_lineage

SMALL = "/root/testdata/sf0.001"


def test_sorted_grid_takes_a_race_that_an_entrant_missed(spark, tmp_path):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    missed = (F.col("l_suppkey") == 3) & (F.year("l_shipdate") == 1997) & (F.quarter("l_shipdate") == 2)
    lines.where(~missed).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SMALL}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["series"], r["rnd"]): r["line_up"].split(">") for r in REGISTRY["sorted_grid"].run(spark, str(tmp_path)).collect()}
    whole = {(r["series"], r["rnd"]): r["line_up"].split(">") for r in REGISTRY["sorted_grid"].run(spark, SMALL).collect()}
    short = (0, (1997 - 1995) * 4 + 2)
    assert "3" in whole[short] and sorted(got[short]) == sorted(e for e in whole[short] if e != "3")
    assert {k: v for k, v in got.items() if k != short} == {k: v for k, v in whole.items() if k != short}


def test_a_table_that_packs_well_is_not_broadcast_unmeasured(spark):
    rows = cut_lineage(spark.range(1_000_000).selectExpr("abs(hash(id)) % 50 AS k", "cast(abs(hash(id, 1)) % 2 AS double) AS v"))
    more = cut_lineage(spark.range(1_500_000).selectExpr("abs(hash(id)) % 50 AS k", "cast(abs(hash(id, 1)) % 3 AS double) AS w"))
    assert "BroadcastHashJoin" not in more.join(rows, "k")._jdf.queryExecution().executedPlan().toString()
    few = cut_lineage(spark.range(50).selectExpr("id AS k", "id AS u"))
    assert "BroadcastHashJoin" in more.join(few, "k")._jdf.queryExecution().executedPlan().toString()


def test_medians_do_not_broadcast_the_rows(spark):
    rows = cut_lineage(spark.range(30_000).selectExpr("id % 5 AS rnd", "cast(id % 7 AS double) AS a", "cast(id AS double) AS b"))
    got = {(r["fold"], r["feature"]): r["median"] for r in gram.prefix_medians(rows, ["a", "b"], [2, 5], cells=16, enough=100).collect()}
    want = {}
    for fold in (2, 5):
        own = rows.where(F.col("rnd") < fold)
        for j, c in enumerate("ab"):
            want[fold, j] = own.agg(F.expr(f"percentile({c}, 0.5)")).first()[0]
    assert got == want


def test_boosting_counts_only_what_it_needs(spark, monkeypatch):
    """Below the root one child of each split is counted, of the allowed features; rows are dealt over all cores."""
    seen, histogram, binned = [], boosting._histogram, boosting._binned

    def watched(table, model, since, growing, level, rnd, counted, allowed, tasks):
        seen.append((level, counted.sum(axis=1).max(), allowed.sum(axis=1).max()))
        return histogram(table, model, since, growing, level, rnd, counted, allowed, tasks)

    def dealt(rows, *rest):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        return binned(rows, *rest)

    monkeypatch.setattr(boosting, "_histogram", watched)
    monkeypatch.setattr(boosting, "_binned", dealt)
    rows = spark.range(4000).selectExpr("id AS entity", "id % 6 AS rnd", "0 AS series", *[f"cast(abs(hash(id, {c})) % 90 AS double) AS c{c}" for c in range(5)])
    rows = rows.withColumn("ActualFinish", F.col("c0") + F.col("c1") * 2 + F.col("c2") % 7).coalesce(1)
    boosting.walk_forward(rows, [f"c{c}" for c in range(5)], params=boosting.Penalised(rounds=2, rate=0.3)).count()
    assert [s[0] for s in seen] == [0, 1, 2, 0, 1, 2] and all(nodes <= max(1, 2 ** (level - 1)) and used == 4 for level, nodes, used in seen)


def test_many_rounds_over_few_rows_take_no_job_a_level(spark, monkeypatch):
    """A task grows all trees of a fold where its rows are few; a job a level gives the same trees and scores."""
    rows = spark.range(3000).selectExpr("id AS entity", "id % 6 AS rnd", "0 AS series", *[f"CASE WHEN abs(hash(id, {c}, 5)) % 9 > 0 THEN cast(abs(hash(id, {c})) % 90 AS double) END AS c{c}" for c in range(4)])
    label = F.coalesce("c0", F.lit(30.0)) + F.coalesce("c1", F.lit(9.0)) * 2 + F.col("rnd")
    rows = cut_lineage(rows.withColumn("ActualFinish", F.when(F.col("entity") % 11 > 0, label)))
    columns, p, levels, histogram = [f"c{c}" for c in range(4)], boosting.Penalised(rounds=23, rate=0.2), [], boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda *a: levels.append(0) or histogram(*a))
    found = []
    for most in (boosting.FOLD_ROWS, 0):
        monkeypatch.setattr(boosting, "FOLD_ROWS", most)
        m = boosting.fit(rows, columns, "ActualFinish", [0, 3, 5, 40], p)
        trees = [[(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in own] for own in m.trees]
        found.append((len(levels), trees[1:], sorted(tuple(r) for r in m.held.select("entity", "xgb").collect())))
    assert found[0][0] == 0 and found[1][0] == 69 and found[0][1:] == found[1][1:]
    assert len(found[0][2]) == 1500 and all(len(own) == 23 for own in found[0][1])


def test_levels_read_rows_in_large_blocks(spark, monkeypatch):
    """A level's tasks take a few values of many rows each, and large tables don't take more tasks than keep the cores busy."""
    rows = spark.range(5000).selectExpr("id AS entity", "id % 6 AS rnd", "0 AS series", *[f"cast(abs(hash(id, {c})) % 90 AS double) AS c{c}" for c in range(3)])
    rows = cut_lineage(rows.withColumn("ActualFinish", F.when(F.col("entity") % 9 > 0, F.col("c0") + F.col("c1") * 2)))
    read, histogram = [], boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda table, *a: read.append(table.count()) or histogram(table, *a))
    assert boosting.fit(rows, ["c0", "c1", "c2"], "ActualFinish", [3, 5], boosting.Penalised(rounds=2, rate=0.3)).held.count() == 1666
    cores = spark.sparkContext.defaultParallelism
    assert read and max(read) <= cores and [boosting.tasks_for(spark, n) for n in (0, boosting.TASK_ROWS, cores * boosting.TASK_ROWS + 1)] == [cores, cores, 2 * cores]


def test_scores_of_earlier_rounds_are_not_kept(spark, monkeypatch):
    """Of the tables that boosting writes on its way only the binned rows are left."""
    rows = spark.range(800).selectExpr("id AS entity", "id % 6 AS rnd", "0 AS series", "cast(abs(hash(id)) % 90 AS double) AS a")
    rows = cut_lineage(rows.withColumn("ActualFinish", F.col("a") * 2))
    written = []
    monkeypatch.setattr(boosting, "FOLD_ROWS", 0)
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    monkeypatch.setattr(boosting, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    folder_of, seen = boosting.folder_of, []
    monkeypatch.setattr(boosting, "folder_of", lambda df: seen.append(folder_of(df)) or seen[-1])
    m = boosting.fit(rows, ["a"], "ActualFinish", [3, 5], boosting.Penalised(rounds=7, depth=2, rate=0.3))
    assert len(written) == 4 and len(seen) == 3 and not any(os.path.exists(f.removeprefix("file:")) for f in seen)
    assert m.held.count() == 266 and [len(own) for own in m.trees] == [7, 7]


def test_cells_of_one_value_are_not_looked_into_again(spark, monkeypatch):
    rows = cut_lineage(spark.range(60_000).selectExpr("id % 5 AS rnd", "cast(abs(hash(id)) % 20 AS double) AS place"))
    written = []
    monkeypatch.setattr(gram, "cut_lineage", lambda df: written.append(0) or cut_lineage(df))
    assert {r["median"] for r in gram.prefix_medians(rows, ["place"], [2, 5]).collect()} <= {9.0, 9.5, 10.0}
    assert len(written) == 1


def test_forests_take_the_medians_of_all_folds_from_one_search(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id AS entity", "id % 6 AS rnd", "0 AS series", "CASE WHEN id % 7 > 0 THEN cast(abs(hash(id)) % 90 AS double) END AS a", "cast(NULL AS double) AS none")
    rows = cut_lineage(rows.withColumn("ActualFinish", F.coalesce("a", F.lit(3.0)) + F.col("rnd")))
    fitted, fit = [], models.fit_models
    monkeypatch.setattr(models, "medians", None)
    monkeypatch.setattr(models, "fit_models", lambda *a: fitted.append(a[-1]) or fit(*a))
    params = models.ModelParams(models.ForestParams(trees=2, depth=2))
    held = models.walk_forward(rows, ["a", "none"], params=params, models=("rf",)).collect()
    assert {r["rnd"] for r in held} == {3, 4, 5} and len(held) == 300 and all(r["rf"] is not None for r in held)
    want = [{"a": rows.where(F.col("rnd") < f).agg(F.expr("percentile(a, 0.5)")).first()[0], "none": 0.0} for f in (3, 4, 5)]
    assert sorted(fitted, key=str) == sorted(want, key=str)


def test_a_second_run_learns_the_same_forests(spark):
    rows = spark.range(900).selectExpr("id AS entity", "id % 9 AS rnd", "0 AS series", "cast(abs(hash(id)) % 90 AS double) AS a", "cast(abs(hash(id, 1)) % 40 AS double) AS b")
    rows = cut_lineage(rows.withColumn("ActualFinish", F.col("a") + F.col("b") * 2 + F.col("rnd")))
    params = models.ModelParams(models.ForestParams(trees=3, depth=4))
    found = []
    for _ in range(3):
        table = cut_lineage(rows.repartition(3, "b"))
        found.append({(r["rnd"], r["entity"]): r["rf"] for r in models.walk_forward(table, ["a", "b"], params=params, models=("rf",)).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 600


def test_ranks_of_many_rows_are_found_in_few_looks(spark, monkeypatch):
    """Skewed values, one frequent value, gaps: one look at counts by cell, one at the rows of the cells in question; all wanted ranks at once."""
    rows = spark.range(60_000).selectExpr("id % 7 AS rnd", "CASE WHEN id % 11 > 0 THEN exp(cast(abs(hash(id)) % 30000 AS double) / 1000) END AS a", "cast(abs(hash(id, 1)) % 9 AS double) AS b")
    rows = cut_lineage(rows.withColumn("a", F.when(F.col("a") < 100, 5.0).otherwise(F.col("a"))))
    written = []
    monkeypatch.setattr(gram, "cut_lineage", lambda df: written.append(0) or cut_lineage(df))
    found = boosting.ranges(rows, ["a", "b", "a"], [2, 6, 9], 50)
    assert len(written) <= 3
    for j, c in enumerate("aba"):
        known = sorted(r[0] for r in rows.where(F.col(c).isNotNull()).select(c).collect())
        assert found.edges[j].tolist() == sorted({known[int((len(known) - 1) * (i / 50))] for i in range(51)})
        for f in (2, 6, 9):
            assert found.medians[f][j] == rows.where(F.col("rnd") < f).agg(F.expr(f"percentile({c}, 0.5)")).first()[0]


def test_pairs_are_derived_once(spark):
    """What leads to the pairs isn't repeated for each statistic inside one task."""
    rows = spark.range(400).selectExpr("id % 4 AS series", "abs(xxhash64(id)) % 1000 / 100D AS a", "abs(xxhash64(id, 1)) % 1000 / 100D AS b")
    out = metrics.paired_comparison(rows, ["series"])
    assert "xxhash64" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {s: rows.where(F.col("series") == s).agg(F.count("*"), F.expr("percentile(a - b, 0.5)")).first() for s in range(4)}
    assert {r["series"]: (r["n_races"], r["median_diff"]) for r in out.collect()} == {s: (w[0], w[1]) for s, w in want.items()}
