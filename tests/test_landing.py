"""Ledger tables: runs visible whole or not at all, keys landed once."""

import pytest
from pyspark.sql import functions as F

from lapwing.operators import calendar, collection
from lapwing.session import cut_lineage
from lapwing.sources import files
from lapwing.sources.ledger import Ledger, LedgerConflict, new_rows
from lapwing.streaming import landing

SCHEMA = "k long, part string, v int"
def order():
    return [F.col("v")]


def found(ledger):
    return sorted((tuple(r) for r in ledger.table().collect()), key=str)


def test_a_run_is_visible_only_when_published(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.table() is None
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA)
    folder = ledger.stage(rows, "one", ["part"])
    assert ledger.table() is None
    first = ledger.publish(ledger.state(), rows, [folder], {"w": 0})
    ledger.stage(rows.withColumn("k", F.lit(9).cast("long")), "two", ["part"])  # fails before its entry
    assert found(ledger) == [(1, "a", 1), (2, "b", 2)] and ledger.state() == first
    with pytest.raises(LedgerConflict):
        ledger.publish(first.__class__(), rows, ["_run=two"])
    with pytest.raises(TypeError):
        ledger.publish(first, rows.withColumn("v", F.lit("x")), ["_run=two"])
    assert ledger.state() == first


def test_later_columns_and_empty_runs(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    ledger.publish(ledger.state(), rows, [ledger.stage(rows, "1", ["part"])])
    none = rows.limit(0)
    ledger.publish(ledger.state(), none, [ledger.stage(none, "2", ["part"])])
    more = spark.createDataFrame([("new", 2, "b", 5)], "w string, k long, part string, v int")
    ledger.publish(ledger.state(), more, [ledger.stage(more, "3", ["part"])])
    assert found(ledger) == [(1, "a", 1, None), (2, "b", 5, "new")]
    before = ledger.state()
    ledger.compact("whole", ["part"])
    assert found(ledger) == [(1, "a", 1, None), (2, "b", 5, "new")] and len(ledger.state().folders) == 1
    assert sorted((tuple(r) for r in ledger.table(before).collect()), key=str) == found(ledger)


def test_batches_land_once(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path))
    land = lambda batch, rows, name="s": landing.land_batch(spark.createDataFrame(rows, SCHEMA), ledger, name, batch, ["k"], ["part"], order())
    assert land(0, [(1, "a", 3), (1, "a", 2), (None, "a", 7), (2, "b", 1)])
    assert not land(0, [(8, "a", 8)])  # the same batch again
    assert land(1, [(1, "a", 0), (None, "a", 1), (3, None, 4), (4, "b", 5)])
    assert land(2, [(3, None, 9)]) and land(3, [(2, "b", 0), (1, "a", 0)])
    want = sorted([(1, "a", 2), (None, "a", 7), (2, "b", 1), (3, None, 4), (4, "b", 5)], key=str)
    assert found(ledger) == want
    publish = Ledger.publish
    monkeypatch.setattr(Ledger, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        land(4, [(5, "a", 1), (6, "a", 1)])
    assert found(ledger) == want
    monkeypatch.setattr(Ledger, "publish", publish)
    assert land(4, [(5, "a", 1)]) and found(ledger) == sorted([*want, (5, "a", 1)], key=str)
    assert land(0, [(5, "a", 0), (7, "b", 0)], "other")  # another stream counts its own batches
    assert found(ledger) == sorted([*want, (5, "a", 1), (7, "b", 0)], key=str)


def test_keys_are_looked_up_in_touched_partitions_only(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], SCHEMA)
    ledger.publish(ledger.state(), rows, [ledger.stage(rows, "1", ["part"])])
    again = spark.createDataFrame([(1, "a", 5), (4, "a", 5), (3, "a", 5)], SCHEMA)
    assert sorted(r["k"] for r in new_rows(again, ledger.table(), ["k"], ["part"]).collect()) == [3, 4]
    assert sorted(r["k"] for r in new_rows(again, ledger.table(), ["k"]).collect()) == [4]


def test_stream_with_late_repeats_and_a_lost_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(source))

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        landing.land_stream(stream, out, str(tmp_path / checkpoint), ["k"], ["part"], order()).awaitTermination()
        return found(Ledger(spark, out))

    add([(1, "a", 1), (1, "a", 1)])
    add([(2, "b", 2)])
    assert run("c") == [(1, "a", 1), (2, "b", 2)]
    version = Ledger(spark, out).state().version
    assert run("c") == [(1, "a", 1), (2, "b", 2)] and Ledger(spark, out).state().version == version
    add([(1, "a", 9), (3, "a", 3)])  # a repeat much later
    assert run("c") == [(1, "a", 1), (2, "b", 2), (3, "a", 3)]
    assert run("new") == [(1, "a", 1), (2, "b", 2), (3, "a", 3)]


INCOMING = "season int, rnd int, session string, driver string, position double, lap_s double, event_round int, note string"


@pytest.fixture()
def weekend(spark):
    names = ["Practice 1", "Practice 2", "Practice 3", "Qualifying", "Race"]
    days = ["2026-03-01", "2026-03-08", "2026-06-09", "2026-07-01"]
    events = [(2026, r, f"Event {r}", "conventional", names, day, *names, *([day] * 5)) for r, day in enumerate(days, 1)]
    cols = "season int, rnd int, event_name string, event_format string, session_names array<string>, event_date string, " + ", ".join(
        [f"session{i} string" for i in range(1, 6)] + [f"session{i}_utc string" for i in range(1, 6)]
    )
    events = spark.createDataFrame(events, cols).withColumn("event_date", F.col("event_date").cast("timestamp"))
    events = events.withColumns({f"session{i}_utc": F.col(f"session{i}_utc").cast("timestamp") for i in range(1, 6)})
    rows = [
        (2026, 1, "race", "AAA", 1.0, None, 1, "x"), (2026, 1, "race", "AAA", 7.0, None, 1, "x"), (2026, 1, "race", "BBB", None, None, 1, "x"), (2026, 1, "race", "SC1", 2.0, None, 1, "x"),
        (2026, 1, "qualifying", "AAA", None, None, 1, "x"), (2026, 1, "fp1", "AAA", None, 80.5, 1, "x"), (2026, 1, "fp1", "AAA", None, None, 1, "x"),
        (2026, 1, "fp2", "AAA", 3.0, None, 1, "x"), (2026, 1, "fp3", " ", 3.0, 80.0, None, "x"),
        (2026, 2, "race", "AAA", 1.0, None, 3, "x"), (2026, 2, "qualifying", "AAA", 1.0, None, 2, "x"), (2026, 9, "race", "AAA", 1.0, None, 9, "x"),
    ]
    return events, spark.createDataFrame(rows, INCOMING)


def collected(spark, ledger, run, events, incoming):
    now = F.lit("2026-06-10 12:00:00").cast("timestamp")
    out = collection.collect(ledger, run, events, calendar.session_plan(spark), incoming, ["season", "rnd"], now)
    return {(r["rnd"], r["session"]): (r["status"], r["detail"], r["records"]) for r in out.report.collect()}


def test_collection_statuses(spark, tmp_path, weekend):
    ledger = Ledger(spark, str(tmp_path))
    got = collected(spark, ledger, "one", *weekend)
    assert got[1, "race"] == ("SUCCESS", None, 2) and got[1, "fp1"] == ("SUCCESS", None, 2) and got[1, "fp2"] == ("SUCCESS", None, 1)
    assert got[1, "qualifying"][:2] == ("COLLECTION_FAILED", collection.NO_POSITION) and got[1, "fp3"][:2] == ("COLLECTION_FAILED", collection.NO_DRIVER)
    assert got[2, "race"][:2] == ("COLLECTION_FAILED", collection.OTHER_ROUND) and got[2, "fp1"][:2] == ("DATA_MISSING", collection.EMPTY)
    assert got[3, "race"][0] == "NOT_YET_AVAILABLE" and got[4, "race"][0] == "FUTURE_SESSION" and len(got) == 20
    landed = ledger.table().where("rnd = 1 and session = 'race'").orderBy("driver").collect()
    assert [(r["driver"], r["position"], r["data_source"], r["run"], r["event_name"], r["note"]) for r in landed] == [
        ("AAA", 1.0, "archive", "one", "Event 1", "x"), ("BBB", None, "archive", "one", "Event 1", "x"),
    ]
    late = spark.createDataFrame([(2026, 1, "race", "ZZZ", 1.0, None, 1, "y"), (2026, 1, "qualifying", "AAA", 4.0, None, 1, "y")], INCOMING)
    again = collected(spark, ledger, "two", weekend[0], late)
    assert again[1, "race"] == ("SKIPPED", None, 0) and again[1, "qualifying"] == ("SUCCESS", None, 1)
    assert ledger.table().where("driver = 'ZZZ'").isEmpty() and collection.reports(ledger).select("run").distinct().count() == 2


def test_a_failed_collection_leaves_nothing_visible(spark, tmp_path, weekend, monkeypatch):
    ledger = Ledger(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(Ledger, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            collected(spark, ledger, "one", *weekend)
    assert ledger.table() is None and collection.reports(ledger) is None
    first = collected(spark, ledger, "one", *weekend)
    assert first[1, "race"] == ("SUCCESS", None, 2) and ledger.table().count() == 6


def test_one_event_of_a_circuit(spark, tmp_path, weekend):
    events, incoming = weekend
    tracks = spark.createDataFrame([("north", 2, ["Event 3"]), ("south", None, ["Event 1"]), ("east", None, None)], "key string, round_2026 int, patterns array<string>")
    events = events.withColumn("location", F.lit("Town"))
    pick = lambda key: [r["rnd"] for r in files.event_round(events, tracks, key).collect()]
    assert (pick(" North "), pick("south"), pick("east"), pick("none")) == ([2], [1], [], [])
    got = collected(spark, Ledger(spark, str(tmp_path)), "one", files.event_round(events, tracks, "south"), incoming)
    assert {k[0] for k in got} == {1} and got[1, "race"][0] == "SUCCESS"


def test_rows_meet_their_session_once(spark, tmp_path, weekend, monkeypatch):
    """Sessions are planned and checked once and written; what is taken joins rows with them, and doesn't derive them again."""
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(collection, "cut_lineage", watched)
    ledger = Ledger(spark, str(tmp_path))
    assert collected(spark, ledger, "one", *weekend)[1, "race"] == ("SUCCESS", None, 2)
    collected(spark, ledger, "two", *weekend)
    # both kinds of rows with the checked sessions, the plan, and what has landed
    assert len(plans) == 6 and max(plan.count("Join ") for plan in (plans[2], plans[5])) <= 4
