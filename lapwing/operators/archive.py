"""Descriptive statistics over a results archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import ratio
from lapwing.functions.status import archive_flags, count_if, race_flags

FIRST_QUALIFYING_SEASON = 1994
TOP_K = 10
RECENT_K = 5


def season_breakdown(results: DataFrame, quali: DataFrame, keys: Sequence[str], provisional: int | None = None) -> DataFrame:
    """One row per (entity, season).  Poles are null before qualifying records begin.

    ``results`` needs season, rnd, constructor, position, position_text, points, status.
    """
    keys = list(keys)
    flags = archive_flags(F.col("status"), F.col("position_text"))
    rows = results.withColumns({f"is_{n}": c for n, c in flags.items()})
    placed = F.col("is_classified") & (F.col("position") > 0)
    per = rows.groupBy(*keys, "season").agg(
        F.max_by("constructor", F.when(F.col("constructor").isNotNull(), F.col("rnd"))).alias("constructor"),
        F.count(F.lit(1)).alias("races"),
        count_if(~F.col("is_non_start")).alias("starts"),
        count_if(F.col("is_non_start")).alias("non_starts"),
        count_if(F.col("is_running_finish")).alias("running_finishes"),
        count_if(F.col("is_classified")).alias("classified_finishes"),
        count_if(F.col("is_classified") & F.col("is_retired")).alias("classified_retirements"),
        count_if(~F.col("is_classified") & F.col("is_retired")).alias("unclassified_retirements"),
        count_if(placed & (F.col("position") == 1)).alias("wins"),
        count_if(placed & (F.col("position") <= 3)).alias("podiums"),
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"),
        F.min(F.when(placed, F.col("position"))).alias("best_finish"),
        F.sum(F.when(placed, F.col("position"))).alias("finish_sum"),
        count_if(placed).alias("finish_n"),
    )
    poles = quali.where(F.col("q_position") == 1).groupBy(*keys, "season").agg(F.count(F.lit(1)).alias("poles"))
    covered = F.col("season") >= FIRST_QUALIFYING_SEASON
    return (
        per.join(poles, keys + ["season"], "left")
        .withColumn("poles", F.when(covered, F.coalesce("poles", F.lit(0))))
        .withColumn("dnfs", F.col("classified_retirements") + F.col("unclassified_retirements"))
        .withColumn("avg_finish", F.when(F.col("finish_n") > 0, F.col("finish_sum") / F.col("finish_n")))
        .withColumn("is_provisional", F.col("season") == F.lit(provisional) if provisional else F.lit(False))
    )


def retirement_reasons(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent retirement reasons as ``reason:count`` text, counted before they are gathered."""
    flags = archive_flags(F.col("status"), F.col("position_text"))
    counts = results.where(flags["retired"]).groupBy(*keys, F.trim(F.coalesce("status", F.lit("Unknown"))).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_s").alias("s"))))
    text = F.array_join(F.transform(ordered, lambda r: F.concat(r["s"], F.lit(":"), (-r["n"]).cast("string"))), ", ")
    return counts.groupBy(*keys).agg(text.alias("retirement_reasons"))


def career_stats(results: DataFrame, quali: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Career totals, rolled up from the season breakdown, with coverage of the pole count."""
    keys = list(keys)
    seasons = season_breakdown(results, quali, keys)
    total = lambda c, alias=None: F.sum(c).alias(alias or c)
    active = F.sort_array(F.collect_set("season"))
    rolled = seasons.groupBy(*keys).agg(
        active.alias("seasons_active"),
        total("races", "total_entries"),
        total("starts", "total_starts"),
        total("non_starts"),
        total("running_finishes"),
        total("classified_finishes"),
        total("classified_retirements"),
        total("unclassified_retirements"),
        total("wins"),
        total("podiums"),
        total("points", "total_points"),
        total("dnfs", "dnf_count"),
        F.when(F.sum("finish_n") > 0, F.sum("finish_sum") / F.sum("finish_n")).alias("avg_finish_position"),
        F.sum("poles").alias("known_covered_poles"),
        F.max((F.col("season") < FIRST_QUALIFYING_SEASON).cast("int")).alias("_early"),
    )
    years = F.sequence(F.element_at("seasons_active", 1), F.element_at("seasons_active", -1))
    out = rolled.withColumn("seasons_missing", F.array_except(years, F.col("seasons_active"))).withColumn(
        "career_poles", F.when(F.col("_early") == 0, F.col("known_covered_poles"))
    )
    return out.drop("_early").join(retirement_reasons(results, keys), keys, "left")


def _top(df: DataFrame, scope: Sequence[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)


def season_standings(results: DataFrame, scope: Sequence[str], entity: str, k: int = TOP_K) -> DataFrame:
    """Top-k by points, wins, then name; ``entity`` is the driver or the constructor."""
    totals = results.groupBy(*scope, entity).agg(
        F.sum("points").alias("points"), count_if(F.col("position") == 1).alias("wins")
    )
    return _top(totals, scope, [F.desc("points"), F.desc("wins"), F.col(entity)], k)


def season_summary(results: DataFrame, calendar: DataFrame, quali: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rounds run and scheduled, entrants, constructors, and coverage texts."""
    scope = list(scope)
    run = results.groupBy(*scope).agg(
        F.countDistinct("rnd").alias("completed_rounds"),
        F.countDistinct("entity").alias("drivers"),
        F.countDistinct("constructor").alias("constructors"),
    )
    planned = calendar.groupBy(*scope).agg(F.countDistinct("rnd").alias("scheduled_rounds"))
    seen = quali.groupBy(*scope).agg(F.countDistinct("rnd").alias("quali_rounds"))
    rows = planned.join(run, scope, "left").join(seen, scope, "left").fillna(
        0, ["completed_rounds", "drivers", "constructors", "quali_rounds"]
    )
    season, done, plan = F.col("season").cast("string"), F.col("completed_rounds"), F.col("scheduled_rounds")
    ratio_text = F.concat(done.cast("string"), F.lit("/"), plan.cast("string"))
    status = (
        F.when(done == 0, F.concat(F.lit("Season "), season, F.lit(" (Scheduled / Pending: "), ratio_text, F.lit(" Rounds Completed)")))
        .when(done < plan, F.concat(F.lit("Season "), season, F.lit(" (In-Progress / Provisional: "), ratio_text, F.lit(" Rounds Completed)")))
        .otherwise(F.concat(F.lit("Season "), season, F.lit(" (Completed Championship: "), done.cast("string"), F.lit(" Rounds)")))
    )
    q_text = F.when(
        F.col("season") < FIRST_QUALIFYING_SEASON,
        F.concat(F.lit("Qualifying session data unavailable for season "), season),
    ).otherwise(
        F.concat(F.lit("Qualifying sessions recorded for "), F.col("quali_rounds").cast("string"), F.lit("/"), done.cast("string"), F.lit(" completed rounds."))
    )
    return rows.select(
        *scope, "scheduled_rounds", "completed_rounds", "drivers", "constructors",
        (done < plan).alias("is_in_progress"), status.alias("status_display"), q_text.alias("qualifying_coverage"),
    )


def circuit_history(results: DataFrame, races: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Races with a known winner at each circuit, first and last year."""
    scope = list(scope)
    winners = results.where(F.col("position") == 1).select(*scope, "season", "rnd").distinct()
    run = races.join(winners, [*scope, "season", "rnd"], "left_semi")
    done = run.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("_done"), F.min("season").alias("first_year"), F.max("season").alias("last_year")
    )
    hosted = races.groupBy(*scope).agg(F.count(F.lit(1)).alias("_hosted"))
    return hosted.join(done, scope, "left").select(
        *scope, F.coalesce("_done", "_hosted").alias("total_races"), "first_year", "last_year"
    )


def circuit_leaders(results: DataFrame, scope: Sequence[str], k: int = TOP_K) -> DataFrame:
    """Top-k lists per circuit: winners, winning constructors and podium finishers.

    Podiums come from the full results, so second and third places count.
    """
    scope = list(scope)
    won = results.where(F.col("position") == 1)
    pod = results.where(F.col("position").between(1, 3))
    lists = [("wins", won, "entity"), ("constructor_wins", won, "constructor"), ("podiums", pod, "entity")]
    parts = []
    for name, rows, who in lists:
        counted = rows.groupBy(*scope, F.col(who).alias("who")).agg(F.count(F.lit(1)).alias("n"))
        top = _top(counted, scope, [F.desc("n"), F.col("who")], k).withColumn("board", F.lit(name))
        parts.append(top.withColumn("who", F.col("who").cast("string")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recent_winners(results: DataFrame, scope: Sequence[str], k: int = RECENT_K) -> DataFrame:
    won = results.where((F.col("position") == 1) & (F.col("season") > 0))
    return _top(won, scope, [F.desc("season"), F.desc("rnd"), F.col("entity")], k).select(
        *scope, "rank", "season", "rnd", "entity", "constructor"
    )


def qualifying_summary(quali: DataFrame, grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions, poles, front rows, top tens, mean position, formats, histogram and grid drops."""
    keys = list(keys)
    rows = quali.join(grids.select(*keys, "season", "rnd", "grid"), [*keys, "season", "rnd"], "left")
    q = F.col("q_position")
    delta = F.when(F.col("grid") > 0, F.col("grid") - q)
    main = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        count_if(q == 1).alias("pole_positions"),
        count_if(q <= 2).alias("front_row_starts"),
        count_if(q <= 10).alias("top_10_starts"),
        F.avg(q).alias("avg_qualifying_position"),
        F.array_join(F.sort_array(F.collect_set("format")), "; ").alias("formats"),
        F.count(delta).alias("grids_compared"),
        F.avg(delta).alias("avg_grid_drop"),
    )
    bars = rows.groupBy(*keys, q.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_n")))
    text = F.array_join(
        F.transform(ordered, lambda b: F.concat(F.lit("P"), b["_p"].cast("string"), F.lit(":"), b["_n"].cast("string"))), ", "
    )
    return main.join(bars.groupBy(*keys).agg(text.alias("position_distribution")), keys)


def race_performance(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starts, finishes, podiums, points, failure rate, places gained and finish histogram."""
    pos, grid = F.col("position"), F.col("grid")
    flags = race_flags(F.col("status"), F.col("position_text"), pos)
    rows = results.withColumns({f"_{n}": c for n, c in flags.items()})
    ok = F.col("_classified")
    gained = F.when(ok & (grid > 0) & (pos > 0), grid - pos)
    bucket = {
        "p1": ok & (pos == 1),
        "p2": ok & (pos == 2),
        "p3": ok & (pos == 3),
        "p4_p10": ok & pos.between(4, 10),
        "p11_plus": ok & (pos.isNull() | (pos > 10)),
        "dnf": ~ok,
    }
    dnfs, starts = count_if(~ok), count_if(F.col("_started"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_races"),
        starts.alias("starts"),
        count_if(ok).alias("classified_finishes"),
        count_if(ok & (pos == 1)).alias("wins"),
        count_if(ok & pos.between(1, 3)).alias("podiums"),
        count_if(F.col("points") > 0).alias("points_finishes"),
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("total_points"),
        dnfs.alias("dnfs"),
        ratio(dnfs * 100.0, starts).alias("dnf_rate_pct"),
        F.sum(gained).alias("positions_gained_total"),
        F.avg(gained).alias("avg_positions_gained"),
        F.count(gained).alias("valid_grid_starts"),
        *[count_if(c).alias(f"finish_{n}") for n, c in bucket.items()],
    )


def retirement_breakdown(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of the statuses that ended unclassified races."""
    ok = race_flags(F.col("status"), F.col("position_text"), F.col("position"))["classified"]
    return (
        results.where(~ok)
        .groupBy(*keys, F.trim(F.coalesce("status", F.lit("Unknown"))).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
