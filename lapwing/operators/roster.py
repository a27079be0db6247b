"""Roster resolution from several sources, one small group per race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators.quality import keep_first

# Sources in order of trust.
SOURCES = {
    "official_entry_list": (1, "verified"),
    "starting_grid": (2, "verified"),
    "qualifying": (3, "high"),
    "practice": (4, "high"),
    "season_pool": (5, "provisional"),
    "prior_race_fallback": (6, "fallback"),
    "catalog_baseline": (7, "provisional"),
}
OBSERVED_STAGES = ("after_qualifying", "before_race", "post_race")


def season_pool(prior: DataFrame, race: Sequence[str], cars: int = 2) -> DataFrame:
    """The two most recent drivers of every team before each race.

    ``prior`` has (race, team, driver, rnd_seen, kind, ordinal) for earlier
    rounds only; qualifying (kind 0) is read before the race (kind 1), so a
    driver who missed the start still counts.
    """
    latest = keep_first(prior, [*race, "team", "driver"], [-F.col("rnd_seen"), F.col("kind"), F.col("ordinal")])
    slot = F.row_number().over(Window.partitionBy(*race, "team").orderBy(F.desc("rnd_seen"), "kind", "ordinal", "driver"))
    return latest.withColumn("_slot", slot).where(F.col("_slot") <= cars).drop("_slot")


def resolve_roster(candidates: DataFrame, races: DataFrame, race: Sequence[str]) -> DataFrame:
    """Takes, per race, the most trusted source that is complete enough.

    ``candidates`` stacks (race, source, team, driver); ``races`` has (race,
    expected, stage).  Entry list, grid and qualifying need ``max(expected - 2,
    10)`` drivers (the latter two only once qualifying has run), practice needs
    the full field, the rest need one.  Practice drivers keep their seat when the
    season pool fills a team.
    """
    race = list(race)
    order = F.create_map(*[F.lit(x) for s, (p, _) in SOURCES.items() for x in (s, p)])
    trust = F.create_map(*[F.lit(x) for s, (_, t) in SOURCES.items() for x in (s, t)])
    ranked = keep_first(
        candidates.withColumn("_p", order[F.col("source")]), [*race, "source", "driver"], [F.col("team"), F.col("driver")]
    )
    sized = ranked.groupBy(*race, "source", "_p").agg(F.count(F.lit(1)).alias("_n")).join(races, race)
    close = F.greatest(F.col("expected") - 2, F.lit(10))
    observed = F.col("stage").isin(*OBSERVED_STAGES)
    ok = (
        F.when(F.col("source") == "official_entry_list", F.col("_n") >= close)
        .when(F.col("source").isin("starting_grid", "qualifying"), observed & (F.col("_n") >= close))
        .when(F.col("source") == "practice", F.col("_n") >= F.col("expected"))
        .otherwise(F.col("_n") >= 1)
    )
    best = sized.where(ok).groupBy(*race).agg(F.min("_p").alias("_best"))
    chosen = ranked.join(best, race).where(F.col("_p") == F.col("_best"))
    # seats already taken by practice runners come first when the pool is used
    pool = F.lit(SOURCES["season_pool"][0])
    practice = ranked.where(F.col("source") == "practice").join(best.where(F.col("_best") == pool), race)
    both = chosen.unionByName(practice)
    seat = Window.partitionBy(*race, "team").orderBy(F.when(F.col("source") == "practice", 0).otherwise(1), "driver")
    unique = keep_first(both, [*race, "driver"], [F.col("_p")])
    seated = unique.withColumn("_seat", F.row_number().over(seat))
    kept = seated.where((F.col("_best") != pool) | (F.col("source") == "practice") | (F.col("_seat") <= 2))
    return kept.select(*race, "driver", "team", "source", trust[F.col("source")].alias("confidence"))
