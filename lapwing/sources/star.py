"""Racing tables derived from the star-schema test tables.

A supplier is an entrant, two consecutive suppliers are a team, twenty are the
field of one championship (``series``), a calendar quarter is a round and a
line item is a timed lap.  A race therefore never has more than twenty entrants
however large the tables grow, and one shuffle on ``series`` serves every later
window, aggregate and join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapwing.operators.skew import HotGroups, find_hot, ordered_index

FIELD_SIZE = 20
FIRST_YEAR = 1995
POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
KEYS = ["series", "rnd", "entity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_for(position: Column) -> Column:
    out = F.lit(0.0)
    for place, pts in reversed(list(enumerate(POINTS, 1))):
        out = F.when(position == place, F.lit(float(pts))).otherwise(out)
    return out


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the racing keys; a narrow projection of the scan."""
    li = table(spark, sf_dir, "lineitem")
    season = F.year("l_shipdate")
    return li.select(
        F.expr(f"l_suppkey div {FIELD_SIZE}").alias("series"),
        season.cast("long").alias("season"),
        ((season - FIRST_YEAR) * 4 + F.quarter("l_shipdate")).cast("long").alias("rnd"),
        F.col("l_suppkey").alias("entity"),
        F.expr("l_suppkey div 2").alias("team"),
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_returnflag",
        "l_linestatus",
        (F.lit(60.0) + F.col("l_extendedprice") / F.col("l_quantity") / F.lit(100.0)).alias("lap_s"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)).alias("deleted"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything known per (race, entrant), in one pass over the laps.

    The aggregate combines on the map side, so a very busy entrant costs one row
    per task; its result is laid out by ``series`` once.
    """
    lines = timed_lines(spark, sf_dir)
    ln, lap = F.col("l_linenumber"), F.col("lap_s")
    segment = {"1": ln <= 2, "2": ln.between(3, 4), "3": ln >= 5}
    aggs = [
        F.min("season").alias("season"),
        F.min("team").alias("team"),
        F.sum(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("revenue_cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
    ]
    aggs += [F.min(F.when(cond, lap)).alias(f"q{n}") for n, cond in segment.items()]
    clean = (~F.col("deleted")) & (lap > 50)
    for n, cond in segment.items():
        aggs.append(F.min(F.when(cond & clean, lap)).alias(f"fp{n}_best_lap"))
        aggs.append(F.count(F.when(cond & clean, lap)).alias(f"fp{n}_laps"))
    return lines.groupBy(*KEYS).agg(*aggs).repartition("series")


def status_text() -> Column:
    code = (F.col("entity") * 7 + F.col("rnd") * 3) % 11
    return (
        F.when(code <= 3, "Finished")
        .when(code == 4, "+1 Lap")
        .when(code == 5, "Engine")
        .when(code == 6, "Collision")
        .when(code == 7, "Did not start")
        .when(code == 8, "Disqualified")
        .when(code == 9, "NC")
    )


def with_results(base: DataFrame) -> DataFrame:
    """Adds grid, position, points and status to the per-entrant table."""
    race = Window.partitionBy("series", "rnd")
    slot = F.row_number().over(race.orderBy(F.desc("quantity"), "entity")).cast("long")
    finish = F.row_number().over(race.orderBy(F.desc("revenue_cents"), "entity")).cast("long")
    pit = (F.col("entity") * 5 + F.col("rnd")) % 17 == 0
    return (
        base.withColumn("grid_slot", slot)
        .withColumn("position", finish)
        .withColumn("grid", F.when(pit, F.lit(0).cast("long")).otherwise(F.col("grid_slot")))
        .withColumn("points", points_for(F.col("position")))
        .withColumn("status", status_text())
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_results(entries(spark, sf_dir)).select(
        "series", "season", "rnd", "entity", "team", "grid_slot", "grid", "position", "points", "status"
    )


def with_qualifying(base: DataFrame) -> DataFrame:
    race = Window.partitionBy("series", "rnd").orderBy(F.col("best").asc_nulls_last(), "entity")
    best = F.least("q1", "q2", "q3")
    return base.withColumn("best", best).withColumn("q_position", F.row_number().over(race).cast("long"))


def qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_qualifying(entries(spark, sf_dir)).select(
        "series", "season", "rnd", "entity", "team", "q1", "q2", "q3", "best", "q_position"
    )


STINT_KEYS = KEYS + ["compound"]


def compound_of(flag: Column) -> Column:
    return F.when(flag == "A", "SOFT").when(flag == "N", "MEDIUM").otherwise("HARD")


def hot_stints(spark: SparkSession, sf_dir: str, hot_rows: int | None = None) -> HotGroups | None:
    """Stints too large for one task, found with one count over the keys."""
    lines = timed_lines(spark, sf_dir)
    return find_hot(lines.select(*KEYS, compound_of(F.col("l_returnflag")).alias("compound")), STINT_KEYS, hot_rows)


def laps(spark: SparkSession, sf_dir: str, hot: HotGroups | None) -> DataFrame:
    """Long lap table with a lap number inside (round, entrant, compound)."""
    ln = F.col("l_linenumber")
    lines = timed_lines(spark, sf_dir).select(
        *KEYS,
        "season",
        "team",
        F.when(ln <= 2, "fp1").when(ln <= 4, "fp2").otherwise("fp3").alias("session"),
        compound_of(F.col("l_returnflag")).alias("compound"),
        "lap_s",
        "deleted",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
    )
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "deleted")]
    steps = [F.col("l_shipdate"), F.floor(F.col("l_orderkey") / 65_536)]
    numbered = ordered_index(lines, STINT_KEYS, order, steps, "lap", hot)
    return numbered.select(
        *KEYS, "season", "team", "session", F.lit(1).cast("long").alias("stint"), "compound", "lap", "lap_s", "deleted"
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather samples: three sessions a day, rain flagged by the event type."""
    return weather_samples(table(spark, sf_dir, "events"))


def weather_samples(ev: DataFrame) -> DataFrame:
    value = F.col("value")
    return ev.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.hour("ts") < 8, "fp1").when(F.hour("ts") < 16, "fp2").otherwise("fp3").alias("session"),
        F.col("ts"),
        (F.lit(10.0) + value / 10).alias("air_temp"),
        (F.lit(15.0) + value / 8).alias("track_temp"),
        (F.lit(40.0) + F.col("user_id") % 50).alias("humidity"),
        (F.col("user_id") % 10 / F.lit(2.0)).alias("wind_speed"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("rainfall"),
    )


def circuit_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit dimension: one row per nation, with priors and climate."""
    k = F.col("n_nationkey").cast("double")
    kind = F.when(k % 3 == 0, "street").when(k % 3 == 1, "permanent").otherwise("temporary")
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("circuit"),
        F.lower("n_name").alias("circuit_key"),
        kind.alias("circuit_type"),
        (F.lit(0.4) + (k % 8) / 20).alias("sc_probability"),
        (F.lit(0.3) + (k % 10) / 50).alias("vsc_probability"),
        (F.lit(0.1) + (k % 12) / 100).alias("red_flag_probability"),
        (F.lit(20.0) + k % 9).alias("pit_loss_seconds"),
        (F.lit(0.6) + (k % 7) / 10).alias("deg_multiplier"),
        (F.lit(18.0) + k % 13).alias("climate_air_temp"),
        (F.lit(26.0) + k % 17).alias("climate_track_temp"),
        (F.lit(45.0) + k % 30).alias("climate_humidity"),
        (F.lit(2.0) + (k % 5) / 2).alias("climate_wind_speed"),
        ((k % 11) / 20).alias("climate_rain_prob"),
    )


def is_sprint_round(rnd: Column) -> Column:
    """The second quarter of every season is a sprint weekend."""
    return rnd % 4 == 2


def circuit_of(rnd: Column) -> Column:
    """Circuit visited in a round: the same one in the same quarter of every season."""
    return (rnd - 1) % 4


ARCHIVE_SHIFT = 3


def position_text(status: Column, position: Column) -> Column:
    return (
        F.when(status.isin("Engine", "Collision"), "R")
        .when(status == "Did not start", "W")
        .when(status == "Disqualified", "D")
        .when(status == "NC", "N")
        .otherwise(position.cast("string"))
    )


def archive(base: DataFrame) -> DataFrame:
    """Archive rows: seasons shifted back so some precede qualifying records; team changes name by season."""
    rows = with_qualifying(with_results(base))
    season = F.col("season") - ARCHIVE_SHIFT
    return rows.select(
        "series",
        season.alias("season"),
        "rnd",
        "entity",
        F.concat(F.lit("Team "), F.col("team").cast("string")).alias("constructor"),
        "grid",
        "position",
        position_text(F.col("status"), F.col("position")).alias("position_text"),
        "points",
        "status",
        "q_position",
        "q1",
        "q2",
        "q3",
        circuit_of(F.col("rnd")).alias("circuit"),
    )
