import math
import random

import pytest
from pyspark.sql import functions as F

from lapwing.functions import names, numbers, status, timing
from lapwing.operators import circuits


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, fn, kind="string"):
    df = column(spark, values, kind).select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_seconds(spark):
    texts = ["0 days 00:01:41.331000", "1:36.477", "0:01:30.5", "88.25", " 90 ", "-5", "0", "NaT", "dnf", "", None, "abc", "1 days 00:00:01"]
    want = [101.331, 96.477, 90.5, 88.25, 90.0, None, None, None, None, None, None, None, 86401.0]
    got = apply(spark, texts, timing.seconds)
    assert [g if g is None else pytest.approx(g) for g in got] == want


def test_tie_break_time_prefers_the_last_segment(spark):
    df = spark.createDataFrame([("1:20.0", "1:21.0", None), (None, None, "nat"), ("bad", None, "0 days 00:01:22")], "a string, b string, c string")
    got = [r[0] for r in df.select(timing.best_for_tie_break(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] == 80.0 and math.isinf(got[1]) and got[2] == 82.0


def test_lap_text(spark):
    assert apply(spark, [101.331, 59.9999, -1.0, None], timing.lap_text, "double") == ["1:41.331", "0:60.000", "No Time", "No Time"]


def test_gap_text(spark):
    df = spark.createDataFrame([("1:20.000", "1:20.345"), ("80.0", "1:19.9"), ("x", "1:20.0"), (None, "1:20")], "a string, b string")
    assert [r[0] for r in df.select(timing.gap_text(F.col("a"), F.col("b"))).collect()] == ["+0.345", None, None, None]


def test_status_classes(spark):
    texts = ["Finished", "+2 Laps", "Lapped", "Did not start", "Withdrew", "DSQ", "Excluded", "NC", "Not classified",
             "Engine", "Power Unit", "Spun", "", None, "Disqualified"]
    want = ["FINISHED"] * 3 + ["DNS"] * 2 + ["DSQ"] * 2 + ["NC"] * 2 + ["RETIRED"] * 2 + ["UNKNOWN"] * 3 + ["DSQ"]
    assert apply(spark, texts, status.classify) == want
    assert apply(spark, ["Engine", "DNS", None], status.is_dnf) == [True, False, False]
    assert apply(spark, ["DNS", "NC", "DSQ"], lambda c: status.is_dnf(c, include_dns=True, include_nc=True)) == [True, True, False]


def test_archive_flags(spark):
    df = spark.createDataFrame(
        [("Finished", "1"), ("Engine", "15"), ("Engine", "R"), ("Did not start", "W"), ("Disqualified", "D"), ("+1 Lap", "9"), ("Accident", "F")],
        "s string, p string",
    )
    flags = status.archive_flags(F.col("s"), F.col("p"))
    got = [tuple(r) for r in df.select(*[flags[k] for k in ("non_start", "running_finish", "classified", "retired")]).collect()]
    assert got == [
        (False, True, True, False),
        (False, False, True, True),
        (False, False, False, True),
        (True, False, False, False),
        (False, False, False, False),
        (False, True, True, False),
        (True, False, False, False),
    ]


def test_grid_reading(spark):
    got = apply(spark, ["5", "0", "-1", "PL", " ", None], numbers.interpret_grid)
    assert [g["grid"] for g in got] == [5, None, None, None, None, None]
    assert got[0]["note"] == "Grid P5" and got[3]["note"] == "Non-numeric Grid Position (PL)"
    assert apply(spark, [1.0, 3.4, 5.5, 10.0, 16.5, 17.0, None], numbers.grid_bucket, "double") == [
        "front_row", "top_5", "points_zone", "points_zone", "midfield", "backmarkers", None,
    ]


def test_field_size_and_format(spark):
    assert apply(spark, [1990, 2011, 2014, 2020, 2026], numbers.expected_field, "int") == [20, 24, 22, 20, 22]
    fmt = apply(spark, [2005], lambda y: numbers.qualifying_format(y, F.lit(True)), "int")[0]
    assert (fmt["format"], fmt["code"]) == ("Qualifying Aggregate (QA)", "QA")


def test_clip_keeps_null(spark):
    assert apply(spark, [None, -1.0, 0.4, 9.0], lambda c: numbers.clip(c, 0.0, 1.0), "double") == [None, 0.0, 0.4, 1.0]


def test_names(spark):
    assert apply(spark, ["Practice 1", "Sprint_Shootout", "sprint-race", "Q uali", "", None], names.session_name) == [
        "fp1", "sprint_qualifying", "sprint_race", "q_uali", "", "",
    ]
    assert apply(spark, [" rb ", "Lotus ", "nan", None], lambda c: names.team_name(c, {"RB": "Racing Bulls"})) == [
        "Racing Bulls", "Lotus", "Unknown", "Unknown",
    ]
    directory = spark.createDataFrame([("AAA", "Ann Alpha", 0), ("BBB", "Bob Beta", 1)], "code string, full_name string, ordinal int")
    df = column(spark, [" aaa", "Ann Alpha", "BETA", "carl"])
    got = names.normalise_entities(df, "v", directory, "code").orderBy("i").collect()
    assert [r["code"] for r in got] == ["AAA", "AAA", "BBB", "CARL"]


CIRCUITS = "ordinal int, key string, display_name string, circuit_name string, patterns array<string>"


def test_circuit_tiers(spark):
    table = spark.createDataFrame(
        [(1, "north", "Northern Grand Prix", "North Ring", ["Northern", "Norland"]), (2, "south", "Southern Grand Prix", "South Park", ["Southern"])], CIRCUITS
    )
    aliases = spark.createDataFrame([("old", "south"), ("gone", "west")], "alias string, key string")
    texts = ["North", "old", "south_park", "The Northern Grand Prix 2026", "visit norland now", "nowhere", " ", None, "SOUTHERN"]
    want = ["north", "south", "south", "north", "north", None, None, None, "south"]
    df = column(spark, texts)
    got = circuits.add_circuit_key(df, ["v"], table, aliases, "k").orderBy("i").collect()
    assert [r["k"] for r in got] == want
    two = df.withColumn("w", F.reverse(F.array(F.lit("x"), F.lit("Norland")))[0]).withColumn("k", F.lit("clash"))
    assert [r["k"] for r in circuits.add_circuit_key(two, ["v", "w"], table, aliases, "k").orderBy("i").collect()] == [k or "north" for k in want]


def by_tiers(text, table, aliases):
    """The tiers one after another over the whole table."""
    raw = text.strip()
    slug, spaced = raw.lower().replace("-", "_").replace(" ", "_"), raw.lower().replace("_", " ").strip()
    keys = [k for _, k, *_ in table]
    if not raw or slug in keys:
        return slug if raw else None
    if aliases.get(slug) in keys:
        return aliases[slug]
    low = lambda n: (n or "").lower().strip()
    for _, key, shown, course, patterns in table:
        called = [n for n in map(low, (shown, course, *(patterns or ()))) if n]
        if any(spaced == n or slug == n.replace(" ", "_") for n in called) or (low(shown) and low(shown) in spaced):
            return key
    for _, key, _, _, patterns in table:
        if any(n and (n in spaced or n in slug) for n in map(low, patterns or ())):
            return key


def test_circuit_names_by_brute_force(spark):
    """Short and shared names, names inside words, hyphens and underscores, repeated rows and nulls."""
    rng = random.Random(3)
    part = ["spa", "a", "grand prix", "ring", "monte-carlo", "st", "x_y", "old town", "É", "of"]
    name = lambda n: " ".join(rng.choice(part) for _ in range(rng.randint(1, n)))
    table = [(i, f"k{i % 35}", name(3).title(), name(2), [name(2) for _ in range(rng.randint(0, 2))]) for i in range(40)]
    table += [(40, "none", None, None, None), (41, "blank", " ", "", ["", " "]), (42, "spa", "Spa", "Spa Ring", ["spa"])]
    aliases = {"a_a": "k3", "st": "missing"}
    texts = {rng.choice(["", "the ", "in", "X"]) + rng.choice([str.upper, str.lower, str.title])(name(4)).replace(" ", rng.choice(" _-")) for _ in range(400)}
    texts |= {"spa", "k1", "K_2", " ", "zzz"}
    got = circuits.resolve(
        spark.createDataFrame([(t,) for t in texts] * 2, "t string"), spark.createDataFrame(table, CIRCUITS), spark.createDataFrame(list(aliases.items()), "alias string, key string")
    ).collect()
    want = {t: k for t in texts if (k := by_tiers(t, table, aliases))}
    assert len(got) == len(want) and {r["identifier"]: r["key"] for r in got} == want
    assert circuits.resolve(spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([], CIRCUITS)).count() == 0


def test_service_vehicles(spark):
    df = spark.createDataFrame(
        [("SC1", "x", "x", "T", 1), ("SCH", "x", "x", "T", 1), ("AAA", "Safety Car", "x", "T", 1), ("AAA", "x", "None None", None, 1),
         ("AAA", "x", "x", None, 242), ("AAA", "x", "x", "T", 242)],
        "c string, b string, f string, t string, n int",
    )
    got = [r[0] for r in df.select(names.is_service_vehicle(*[F.col(c) for c in "cbftn"])).collect()]
    assert got == [True, False, True, True, True, False]


def test_event_status(spark):
    df = spark.createDataFrame(
        [("GP", "2026-01-01", None), ("GP", "2026-01-02", "11:00:00Z"), ("GP", "2026-01-02", "13:00:00Z"), ("GP [cancelled]", "2026-01-01", None), ("GP", "soon", None)],
        "n string, d string, t string",
    )
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    got = [r[0] for r in df.select(numbers.event_status(F.col("n"), F.col("d"), F.col("t"), now)).collect()]
    assert got == ["Scheduled (Past Date)", "Scheduled (Past Date)", "Upcoming", "Advisory: Likely Cancelled", "Date Unknown"]
