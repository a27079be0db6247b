import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lapwing.operators import calendar, grids
from lapwing.session import checkpoint_dir, cut_lineage
from lapwing.sources import archive_json, files


@pytest.fixture()
def folder(tmp_path):
    wide = "DriverNumber,BroadcastName,Abbreviation,TeamName,FullName,Position,GridPosition,Q1,Status,Points\n"
    (tmp_path / "2026_round_1_race.csv").write_text(wide + '1,A A,AAA,"Team, One",Ann Alpha,1.0,2.0,,Finished,25.0\n2,B B,,Team Two,Bob Beta,2.0,,,+1 Lap,18.0\n')
    (tmp_path / "2026_round_1_qualifying.csv").write_text("Abbreviation,TeamName,Position,Q1\nBBB,Team Two,1,1:36.477\nAAA,Team One,2,0 days 00:01:37.5\n")
    (tmp_path / "2026_round_2_race.csv").write_text("")
    (tmp_path / "2026_round_3_race.csv").write_text(wide)
    (tmp_path / "2026_round_4_race.csv").write_text("Driver,Position\nCCC\n\nDDD,x\n")
    (tmp_path / "2026_round_1_sprint_race.csv").write_text("Driver,Position,Grid\nAAA,3,1\n")
    (tmp_path / "2026_round_1_fp1.csv").write_text(
        "Driver,LapTime,LapTimeSeconds,LapNumber,Stint,Compound,Deleted\nAAA,0 days 00:01:30,,1.0,1.0,soft,False\nAAA,,88.5,2.0,,,True\nAAA,nan,nan,3.0,1.0,SOFT,\n"
    )
    return tmp_path


def test_csv_shapes(spark, folder):
    df = files.read_sessions(spark, f"{folder}/*.csv")
    got = {(r["rnd"], r["session"], r["driver"]): r for r in df.collect()}
    assert {k[:2] for k in got} == {(1, "race"), (1, "qualifying"), (4, "race"), (1, "sprint_race"), (1, "fp1")}
    assert got[1, "race", "AAA"]["team"] == "Team, One" and got[1, "race", "AAA"]["grid"] == 2.0
    assert got[1, "race", "Bob Beta"]["grid"] is None  # the code was empty, so the name stands in
    assert got[4, "race", "CCC"]["position"] is None and got[4, "race", "DDD"]["position"] is None
    assert got[1, "sprint_race", "AAA"]["grid"] == 1.0
    assert files.read_sessions(spark, f"{folder}/*_race.csv", max_round=1).select("rnd").distinct().count() == 1


def test_laps(spark, folder):
    df = files.read_laps(spark, f"{folder}/*_fp1.csv").orderBy("lap")
    assert [tuple(r) for r in df.select("lap_s", "stint", "compound", "deleted").collect()] == [
        (90.0, 1.0, "SOFT", False), (88.5, 1.0, "UNKNOWN", True), (None, 1.0, "SOFT", None),
    ]


def test_large_csv_has_the_same_shape(spark, folder):
    cols = ["Abbreviation", "TeamName", "Position", "Q1"]
    path = f"{folder}/2026_round_1_qualifying.csv"
    small, large = files.read_csv(spark, path), files.read_large_csv(spark, path, cols)
    pick = lambda df: rows(files.canonical(df, {"driver": ("string", ("Abbreviation",)), "q1": ("seconds", ("Q1",))}), "driver", "q1")
    assert pick(small) == pick(large) == [("AAA", 97.5), ("BBB", 96.477)]


def test_mixed_headers_scan_like_whole_files(spark, tmp_path):
    """Large and small files, four headers, byte-order mark, repeated and empty names, short and long rows, quotes."""
    rng = random.Random(1)
    headers = ["Driver,Position,Grid", "Grid,Driver,Team,Team", "\ufeffDriver,,Position", 'Team,"Na,me",Position']
    for i in range(9):
        lines = [headers[i % 4]]
        for k in range(rng.choice([0, 2, 40])):
            cells = [rng.choice(["", f"x{k}", '"a, b"', '"say ""hi"""', "1.5", " y "]) for _ in range(rng.choice([2, 3, 4, 4, 5]))]
            lines.append(",".join(cells) if any(cells) else "z")
        (tmp_path / f"{i}.csv").write_text(rng.choice(["\n", "\r\n"]).join(lines) + "\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    whole = files.read_csv(spark, f"{tmp_path}/*.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        pieces = files.scan_csv(spark, f"{tmp_path}/*.csv", large=120)
        assert files.scan_csv(spark, f"{tmp_path}/5.csv", large=1).rdd.getNumPartitions() > 3
        flat = lambda df: [(r["file"].rsplit("/")[-1], sorted(r["cells"].items())) for r in df.orderBy("file", "line").collect()]
        trim = lambda rows: [(f, [(k, v) for k, v in kv if v is not None and v.strip()]) for f, kv in rows]
        assert trim(flat(pieces)) == trim(flat(whole))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert files.scan_csv(spark, f"{tmp_path}/empty.csv").count() == 0


def test_land_load_and_preference(spark, folder, tmp_path):
    df = files.read_sessions(spark, f"{folder}/*_race.csv").where("rnd = 1 and session = 'race'")
    out = str(tmp_path / "landed")
    files.land(df, out)
    files.land(df.withColumn("rnd", F.lit(2)), out)
    assert files.load(spark, out, season=2026, rounds=[2]).count() == 2
    assert files.load(spark, out, max_round=1, sessions=["race"]).count() == 2
    plan = files.load(spark, out, rounds=[2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rnd" in plan
    second = df.withColumn("driver", F.lit("zzz")).unionByName(df.withColumn("rnd", F.lit(9)))
    best = files.prefer_source([df, second])
    assert rows(best.groupBy("rnd").count()) == [(1, 2), (9, 2)]
    assert best.where("driver = 'zzz'").count() == 0


def test_merge_history(spark):
    a = spark.createDataFrame([(1, "x")], "season int, a string")
    b = spark.createDataFrame([(2, 0.5)], "season int, b double")
    assert rows(files.merge_history([a, b]), "season", "a", "b") == [(1, "x", None), (2, None, 0.5)]


def test_manifest_round_trip(spark, tmp_path):
    src = spark.createDataFrame(
        [("2026", "b", 2, "A", "T", 1, 2, 0, "CLASSIFIED"), ("2026", "b", 1, "B", "T", 2, 1, 0, "CLASSIFIED"), ("2026", "b", 3, "C", "U", 3, None, 1, "PIT_LANE")],
        "season string, circuit_key string, simulation_start_rank int, driver string, team string, qualifying_pos int, grid_pos int, is_pit_lane_start int, status string",
    ).withColumn("season", F.col("season").cast("int"))
    docs = grids.build_manifests(src, ["season", "circuit_key"])
    files.write_manifests(docs, str(tmp_path / "m"), ["season", "circuit_key"])
    back = spark.read.schema(grids.MANIFEST_SCHEMA).json(str(tmp_path / "m"))
    flat = grids.flatten_manifests(back, ("season", "circuit_key"))
    assert rows(flat, "driver", "ActualStartingGrid", "is_pit_lane_start") == [("A", 2.0, 0), ("B", 1.0, 0), ("C", None, 1)]
    (tmp_path / "one.json").write_text(json.dumps({"season": 2026, "circuit_key": " B ", "grid": []}, indent=1))
    assert files.read_manifests(spark, str(tmp_path / "one.json"), "b").count() == 1
    assert files.read_manifests(spark, str(tmp_path / "one.json"), "c").count() == 0


def test_configuration(spark, tmp_path):
    tracks = {"tracks": {"one": {"display_name": "One GP", "event_name_patterns": ["First"], "round_2026": 3}, "two": {"display_name": "Two GP", "event_name_patterns": ["Second", "Deuxville"]}}}
    (tmp_path / "t.json").write_text(json.dumps(tracks, indent=2))
    dim = files.read_tracks(spark, str(tmp_path / "t.json"))
    assert [r["key"] for r in dim.orderBy("ordinal").collect()] == ["one", "two"]
    events = spark.createDataFrame([(2026, 1, "Opening", "Deuxville"), (2026, 3, "Third", "x"), (2026, 4, "First again", "y")], "season int, rnd int, event_name string, location string")
    assert files.event_round(events, dim, "one").first()["rnd"] == 3
    assert files.event_round(events, dim, "two").first()["rnd"] == 1
    (tmp_path / "s.json").write_text(json.dumps({"circuit_priors": {"one": {"sc_probability": 0.5, "deg_multiplier": 1.2}}}))
    assert files.read_circuit_priors(spark, str(tmp_path / "s.json")).first()["deg_multiplier"] == 1.2


def test_exports(spark, tmp_path):
    t = spark.createDataFrame([("A", 1.5, 1)], "entity string, ExpectedFinish double, PredictedPosition int")
    files.export_forecast(t, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns[0] == "entity" and len(back.columns) == 18
    files.export_tables({"a": t}, str(tmp_path / "all"), {"seed": "42"})
    assert spark.read.parquet(str(tmp_path / "all" / "metadata")).first()["value"] == "42"
    assert files.lookup(t, entity="A").count() == 1


def test_archive_documents_with_gaps(spark):
    doc = {"Races": [{"season": "1954", "round": "2", "Results": [
        {"position": "1", "positionText": "1", "grid": "0", "points": "8.14", "laps": "x", "status": "Finished", "Driver": {"driverId": "a", "givenName": "Al", "familyName": "Fa"}, "Constructor": {"constructorId": "m", "name": "Make"}},
        {"position": "oops", "grid": "3", "Driver": {"familyName": "Solo"}, "FastestLap": {"rank": "2", "Time": {"time": "1:20.1"}}},
    ]}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("not json",)], "doc string")
    got = {r["driver_id"]: r for r in archive_json.race_results(df).collect()}
    assert got["a"]["points"] == 8.14 and got["a"]["grid"] is None and got["a"]["laps"] == 0 and got["a"]["driver_name"] == "Al Fa"
    assert got["unknown"]["position"] is None and got["unknown"]["status"] == "Unknown" and got["unknown"]["fastest_lap_rank"] == 2
    seasons = spark.createDataFrame([('{"Seasons":[{"season":"1950"},{"season":"x"},{"season":"1950"}]}',)], "doc string")
    assert rows(archive_json.available_seasons(seasons)) == [(1950,)]


def test_page_without_table_yields_nothing(spark):
    df = spark.createDataFrame([(1, "<html><p>No results</p></html>"), (2, "<table><tr><th>h</th></tr><tr><td>1</td></tr></table>")], "id int, html string")
    assert grids.parse_grid_pages(df, ["id"]).count() == 0


def test_provenance_text(spark):
    df = spark.createDataFrame([("official_manifest", "FINAL", "Doc 1"), ("official_manifest", "X", None), ("unpublished", None, None), (None, None, None)], "p string, s string, r string")
    got = [r[0] for r in df.select(grids.provenance_text(F.col("p"), F.col("s"), F.col("r"), F.lit("after_fp1"))).collect()]
    assert got == ["FIA Official Final Starting Grid (Doc 1)", "FIA Official Provisional Starting Grid",
                   "Provisional Predicted Grid (Pre-Qualifying Stage: after_fp1)", "Starting Grid Unavailable"]


def test_collection_status(spark):
    plan = spark.createDataFrame(
        [(1, "race", "2026-01-01 00:00:00", None), (2, "race", "2026-03-09 00:00:00", None), (3, "race", "2026-03-11 00:00:00", None), (4, "race", "2026-01-01 00:00:00", "Timeout"), (5, "race", "2026-01-01 00:00:00", "Session NOT FOUND")],
        "rnd int, session string, scheduled_ts string, last_error string",
    ).withColumn("scheduled_ts", F.to_timestamp("scheduled_ts"))
    landed = spark.createDataFrame([(1, "race")], "rnd int, session string")
    now = F.lit("2026-03-10 00:00:00").cast("timestamp")
    got = calendar.collection_status(plan, landed, ["rnd"], now)
    assert rows(got, "rnd", "status") == [(1, "SUCCESS"), (2, "NOT_YET_AVAILABLE"), (3, "FUTURE_SESSION"), (4, "COLLECTION_FAILED"), (5, "DATA_MISSING")]


def test_cut_lineage_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = checkpoint_dir(spark)
    assert folder == named if named else folder
    out = cut_lineage(spark.range(5))
    assert out.count() == 5 and f"{folder}/lapwing-" in out.inputFiles()[0]


def test_csv_of_many_columns_and_quoted_breaks(spark, tmp_path):
    names = [f"c{i}" for i in range(198)] + ["Abbreviation", "Position"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(["x"] * 198 + ["VER", "1"]) + "\n")
    (tmp_path / "quoted.csv").write_text('"Driver","Status, full",Note\r\nVER,"Engine\nfire, ""hot""",\n\n,open " quote,z\n')
    cells = {(r.file.rsplit("/", 1)[1], r.line): r.cells for r in files.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert len(cells["wide.csv", 0]) == 200 and cells["wide.csv", 0]["Abbreviation"] == "VER" and cells["wide.csv", 0]["Position"] == "1"
    assert cells["quoted.csv", 0] == {"Driver": "VER", "Status, full": 'Engine\nfire, "hot"', "Note": None}
    assert cells["quoted.csv", 1]["Driver"] is None and cells["quoted.csv", 1]["Note"] == "z"


def test_scratch_is_one_folder_of_the_application(spark, tmp_path, monkeypatch):
    from lapwing import session

    assert session.checkpoint_dir(spark) == session.checkpoint_dir(spark) and spark.sparkContext.applicationId in session.scratch_dir(spark)
    monkeypatch.setattr(session, "scratch_dir", lambda spark: str(tmp_path / "own"))
    kept = session.cut_lineage(spark.range(3))
    assert kept.count() == 3 and len(list((tmp_path / "own").iterdir())) == 1
    session.drop_scratch(spark)
    assert not (tmp_path / "own").exists()
    assert session.cut_lineage(spark.range(2)).count() == 2
