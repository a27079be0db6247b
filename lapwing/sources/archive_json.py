"""Nested archive JSON to flat rows.  Every leaf arrives as text and is cast tolerantly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import event_status, interpret_grid, positions_gained, qualifying_format
from lapwing.operators.quality import keep_first
from lapwing.functions.timing import gap_text

_PERSON = "driverId:string,givenName:string,familyName:string,permanentNumber:string,code:string"
_MAKER = "constructorId:string,name:string"
_RESULT = (
    "position:string,positionText:string,number:string,grid:string,laps:string,points:string,status:string,"
    f"Driver:struct<{_PERSON}>,Constructor:struct<{_MAKER}>,Time:struct<time:string>,"
    "FastestLap:struct<rank:string,Time:struct<time:string>>"
)
RESULTS_SCHEMA = f"Races array<struct<season:string,round:string,Results:array<struct<{_RESULT}>>>>"
QUALIFYING_SCHEMA = (
    "Races array<struct<season:string,round:string,QualifyingResults:array<struct<position:string,"
    f"Driver:struct<{_PERSON}>,Constructor:struct<{_MAKER}>,Q1:string,Q2:string,Q3:string>>>>"
)
_SEGMENT = "struct<time:string>"
ALT_QUALIFYING_SCHEMA = (
    "season int, round int, session_type string, results array<struct<position:string,time:string,"
    "driver:struct<id:string,given_name:string,family_name:string,abbreviation:string>,"
    f"team:struct<id:string,name:string>,components:struct<Q1:{_SEGMENT},Q2:{_SEGMENT},Q3:{_SEGMENT}>>>"
)
_PLACE = "circuitId:string,circuitName:string,url:string,Location:struct<lat:string,long:string,locality:string,country:string>"
CALENDAR_SCHEMA = f"Races array<struct<season:string,round:string,raceName:string,date:string,time:string,url:string,Circuit:struct<{_PLACE}>>>"
CIRCUITS_SCHEMA = f"Circuits array<struct<{_PLACE}>>"


def _int(c) -> Column:
    return F.col(c).try_cast("int") if isinstance(c, str) else c.try_cast("int")


def person_name(given: Column, family: Column, fallback: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~blank(given) & ~blank(family), F.concat(given, F.lit(" "), family)).when(~blank(family), family).otherwise(fallback)
    )


def _filled(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(default))


def _people(d: str, m: str) -> dict[str, Column]:
    driver = _filled(F.col(f"{d}.driverId"), "unknown")
    maker = _filled(F.col(f"{m}.constructorId"), "unknown")
    return {
        "driver_id": driver,
        "driver_name": person_name(F.col(f"{d}.givenName"), F.col(f"{d}.familyName"), driver),
        "constructor_id": maker,
        "constructor_name": F.when(F.coalesce(F.col(f"{m}.name"), F.lit("")) != "", F.col(f"{m}.name")).otherwise(maker),
    }


def race_results(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Result pages to rows: safe casts, names, start slot, places gained, fastest lap."""
    races = pages.select(F.explode(F.from_json(doc, RESULTS_SCHEMA)["Races"]).alias("r"))
    rows = races.select(_int("r.season").alias("season"), _int("r.round").alias("rnd"), F.explode("r.Results").alias("e"))
    position = _int("e.position")
    grid = interpret_grid(F.col("e.grid"))["grid"]
    return rows.select(
        "season",
        "rnd",
        position.alias("position"),
        F.coalesce(F.nullif(F.col("e.positionText"), F.lit("")), F.col("e.position"), F.lit("")).alias("position_text"),
        *[c.alias(n) for n, c in _people("e.Driver", "e.Constructor").items()],
        F.coalesce(F.nullif(F.col("e.number"), F.lit("")), F.col("e.Driver.permanentNumber")).alias("driver_number"),
        grid.alias("grid"),
        F.trim(F.coalesce(F.col("e.grid"), F.lit(""))).alias("raw_grid"),
        positions_gained(grid, position).alias("positions_gained"),
        F.col("e.Time.time").alias("time_or_gap"),
        F.coalesce(_int("e.laps"), F.lit(0)).alias("laps"),
        F.coalesce(F.col("e.points").try_cast("double"), F.lit(0.0)).alias("points"),
        _filled(F.col("e.status"), "Unknown").alias("status"),
        _int("e.FastestLap.rank").alias("fastest_lap_rank"),
        F.col("e.FastestLap.Time.time").alias("fastest_lap_time"),
    )


def season_classifications(rows: DataFrame) -> DataFrame:
    """Merges pages: the same entry may arrive on two of them."""
    return rows.dropDuplicates(["season", "rnd", "driver_id", "constructor_id", "position_text", "raw_grid"])


def completed_rounds(events: DataFrame, results: DataFrame, keys: Sequence[str] = ("season", "rnd")) -> DataFrame:
    """A round is complete when it has results."""
    return events.join(results.select(*keys).distinct(), list(keys), "left_semi")


def qualifying_results(pages: DataFrame, doc: str = "doc", first_season: int = 1994) -> DataFrame:
    """Qualifying pages to rows: best time, gap to pole, format by era; nothing before records begin."""
    races = pages.select(F.explode(F.from_json(doc, QUALIFYING_SCHEMA)["Races"]).alias("r"))
    rows = races.select(_int("r.season").alias("season"), _int("r.round").alias("rnd"), F.explode("r.QualifyingResults").alias("e"))
    time = lambda q: F.nullif(F.col(f"e.{q}"), F.lit(""))
    fmt = qualifying_format(F.col("season"), time("Q1").isNotNull() & time("Q2").isNotNull())
    flat = rows.where(F.col("season") >= first_season).select(
        "season",
        "rnd",
        _int("e.position").alias("position"),
        *[c.alias(n) for n, c in _people("e.Driver", "e.Constructor").items()],
        F.col("e.Driver.code").alias("driver_code"),
        time("Q1").alias("q1"),
        time("Q2").alias("q2"),
        time("Q3").alias("q3"),
        F.coalesce(time("Q3"), time("Q2"), time("Q1")).alias("best"),
        fmt["format"].alias("session_format"),
        fmt["code"].alias("session_code"),
    )
    flat = flat.where(F.col("position").isNotNull())
    pole = F.max(F.when(F.col("position") == 1, F.col("best"))).over(Window.partitionBy("season", "rnd"))
    return flat.withColumn("_pole", pole).withColumn(
        "gap_to_pole", F.when(F.col("position") > 1, gap_text(F.col("_pole"), F.col("best")))
    ).drop("_pole")


def season_qualifying(rows: DataFrame) -> DataFrame:
    """Merges pages of qualifying entries: an entry that arrives on two of them counts once, with its best time."""
    order = [F.col("best").isNull(), F.col("best")]
    return keep_first(rows, ["season", "rnd", "driver_id", "position"], order)


def alt_qualifying_results(docs: DataFrame) -> DataFrame:
    """The second dialect: segments under ``components``, one document per session."""
    rows = docs.select("season", F.col("round").alias("rnd"), F.upper(F.coalesce("session_type", F.lit(""))).alias("st"), F.explode("results").alias("e"))
    q = {n: F.col(f"e.components.{n}.time") for n in ("Q1", "Q2", "Q3")}
    driver = _filled(F.col("e.driver.id"), "unknown")
    fmt = (
        F.when(F.col("st") == "QA", "Qualifying Aggregate (QA)")
        .when(F.col("st") == "QO", "Qualifying Shootout Order (QO)")
        .when(F.col("st") == "QB", "Qualifying Best Lap (QB)")
        .when(q["Q3"].isNotNull() | q["Q2"].isNotNull(), "Knockout")
        .otherwise("Single Session")
    )
    name = F.trim(F.concat_ws(" ", "e.driver.given_name", "e.driver.family_name"))
    flat = rows.select(
        "season",
        "rnd",
        F.coalesce(_int("e.position"), F.lit(0)).alias("position"),
        driver.alias("driver_id"),
        F.when(name != "", name).otherwise(driver).alias("driver_name"),
        F.col("e.driver.abbreviation").alias("driver_code"),
        _filled(F.col("e.team.name"), "unknown").alias("constructor_name"),
        q["Q1"].alias("q1"),
        q["Q2"].alias("q2"),
        q["Q3"].alias("q3"),
        F.coalesce(F.col("e.time"), q["Q3"], q["Q2"], q["Q1"]).alias("best"),
        fmt.alias("session_format"),
        F.nullif(F.col("st"), F.lit("")).alias("session_code"),
    )
    pole = F.max(F.when(F.col("position") == 1, F.col("best"))).over(Window.partitionBy("season", "rnd"))
    return flat.withColumn("_pole", pole).withColumn(
        "gap_to_pole", F.when(F.col("position") > 1, gap_text(F.col("_pole"), F.col("best")))
    ).drop("_pole")


def starting_grids(results: DataFrame) -> DataFrame:
    """Archive start slots with their reading; ``start_order`` puts unknown slots last."""
    note = interpret_grid(F.col("raw_grid"))["note"]
    rows = results.select("season", "rnd", "driver_id", "driver_name", "constructor_name", "grid", "raw_grid", note.alias("grid_status"))
    rows = rows.dropDuplicates(["season", "rnd", "driver_id", "raw_grid"])
    line = Window.partitionBy("season", "rnd").orderBy(F.col("grid").asc_nulls_last(), "driver_id")
    return rows.withColumn("start_order", F.row_number().over(line).cast("long"))


def calendar(pages: DataFrame, now: Column, doc: str = "doc") -> DataFrame:
    """Calendar pages to events with a status against ``now``."""
    races = pages.select(F.explode(F.from_json(doc, CALENDAR_SCHEMA)["Races"]).alias("r"))
    rnd = F.coalesce(_int("r.round"), F.lit(0))
    name = F.when(F.coalesce(F.col("r.raceName"), F.lit("")) != "", F.col("r.raceName")).otherwise(F.concat(F.lit("Round "), rnd.cast("string")))
    return races.select(
        _int("r.season").alias("season"),
        rnd.alias("rnd"),
        name.alias("event_name"),
        _filled(F.col("r.Circuit.circuitId"), "unknown").alias("circuit_id"),
        F.col("r.Circuit.circuitName").alias("circuit_name"),
        F.col("r.date").alias("date"),
        F.col("r.time").alias("time"),
        event_status(name, F.col("r.date"), F.col("r.time"), now).alias("status_label"),
    )


def available_seasons(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Distinct seasons named by the archive."""
    races = pages.select(F.explode(F.from_json(doc, "Seasons array<struct<season:string>>")["Seasons"]).alias("s"))
    return races.select(_int("s.season").alias("season")).where(F.col("season").isNotNull()).distinct()


def circuits(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Circuit pages to the circuit dimension."""
    rows = pages.select(F.explode(F.from_json(doc, CIRCUITS_SCHEMA)["Circuits"]).alias("c"))
    return rows.select(
        F.col("c.circuitId").alias("circuit_id"),
        F.col("c.circuitName").alias("name"),
        F.col("c.Location.locality").alias("locality"),
        F.col("c.Location.country").alias("country"),
        F.col("c.Location.lat").try_cast("double").alias("latitude"),
        F.col("c.Location.long").try_cast("double").alias("longitude"),
    ).where(F.coalesce("circuit_id", F.lit("")) != "").dropDuplicates(["circuit_id"])
