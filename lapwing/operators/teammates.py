"""Teammate comparisons.

The other car of a two-car team is read with ``lead``/``lag`` inside the team;
histories are looked up for the current pair only, so no pairs are enumerated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import clip
from lapwing.functions.status import count_if, out_of_head_to_head, teammate_classified

PRIOR_WEIGHT = 3.0
BOUNDS = (0.15, 0.85)


def _other(column: str, team_scope: Sequence[str]) -> Column:
    """The teammate's value when the team has exactly two cars, else null."""
    w = Window.partitionBy(*team_scope).orderBy("entity")
    two = F.count(F.lit(1)).over(Window.partitionBy(*team_scope)) == 2
    first = F.row_number().over(w) == 1
    return F.when(two & first, F.lead(column).over(w)).when(two, F.lag(column).over(w))


def add_quali_gap(rows: DataFrame, team_scope: Sequence[str], lap: str = "best_quali_lap") -> DataFrame:
    """Percent gap to the teammate's best lap; negative is faster."""
    other = _other(lap, team_scope)
    return rows.withColumn("_other", other).withColumn(
        "teammate_quali_gap_pct",
        F.when((F.col(lap) > 0) & (F.col("_other") > 0), (F.col(lap) - F.col("_other")) / F.col("_other") * 100.0),
    ).drop("_other")


def add_grid_delta(rows: DataFrame, team_scope: Sequence[str], grid: str = "grid") -> DataFrame:
    """Own start slot minus the teammate's; negative starts ahead."""
    return rows.withColumn("teammate_grid_delta", (F.col(grid) - _other(grid, team_scope)).cast("double"))


def h2h(
    rows: DataFrame,
    scope: Sequence[str],
    prior_weight: float = PRIOR_WEIGHT,
    bounds: tuple[float, float] = BOUNDS,
) -> DataFrame:
    """Shrunk win rate against the current teammate over earlier rounds in the same team,
    one row per entrant and round.

    ``scope`` holds the championship columns.  A round where both stopped is not
    counted; if one stopped, the other wins; equal places are half a win.
    """
    scope = list(scope)
    team = [*scope, "rnd", "team"]
    lineup = rows.withColumn("partner", _other("entity", team))
    pairs = lineup.where(F.col("partner").isNotNull()).select(*scope, "entity", "partner").distinct()
    raced = rows.select(*scope, "rnd", "team", "entity", "position", out_of_head_to_head(F.col("status")).alias("out"))
    partner = raced.select(
        *scope,
        "rnd",
        "team",
        F.col("entity").alias("partner"),
        F.col("position").alias("p_position"),
        F.col("out").alias("p_out"),
    )
    met = raced.join(pairs, [*scope, "entity"]).join(partner, [*scope, "rnd", "team", "partner"])
    both_placed = F.col("position").isNotNull() & F.col("p_position").isNotNull()
    win = (
        F.when(F.col("out"), 0.0)
        .when(F.col("p_out"), 1.0)
        .when(both_placed & (F.col("position") < F.col("p_position")), 1.0)
        .when(both_placed & (F.col("position") == F.col("p_position")), 0.5)
        .otherwise(0.0)
    )
    counted = ~(F.col("out") & F.col("p_out")) & (F.col("out") | F.col("p_out") | both_placed)
    before = Window.partitionBy(*scope, "entity", "partner").orderBy("rnd").rowsBetween(Window.unboundedPreceding, -1)
    scored = (
        met.withColumn("_win", F.when(counted, win))
        .withColumn("_wins", F.coalesce(F.sum("_win").over(before), F.lit(0.0)))
        .withColumn("_n", F.count("_win").over(before))
        .select(*scope, "rnd", "entity", "partner", "_wins", "_n")
    )
    rate = (F.col("_wins") + prior_weight * 0.5) / (F.col("_n") + F.lit(prior_weight))
    return (
        lineup.join(scored, [*scope, "rnd", "entity", "partner"], "left")
        .select(*scope, "rnd", "entity", F.coalesce(clip(rate, *bounds), F.lit(0.5)).alias("driver_teammate_h2h_ratio"))
    )


def season_compare(results: DataFrame, quali: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Season totals of each two-car pairing, one row per (season, team, pair).

    The lower entity is ``first``.  A finisher beats a non-finisher; rounds where
    neither is classified count for nobody; qualifying needs both positions.
    """
    scope = list(scope)
    team = [*scope, "rnd", "team"]
    ok = teammate_classified(F.col("status"), F.col("position_text"), F.col("position"))
    rows = results.withColumn("ok", ok).join(quali.select(*scope, "rnd", "entity", "q_position"), [*scope, "rnd", "entity"], "left")
    other = {f"o_{c}": _other(c, team) for c in ("entity", "position", "points", "ok", "q_position")}
    duel = rows.withColumns(other).where(F.col("entity") < F.col("o_entity"))
    p, o = F.col("position"), F.col("o_position")
    ok1, ok2 = F.col("ok"), F.col("o_ok")
    q, oq = F.col("q_position"), F.col("o_q_position")
    ahead1 = (ok1 & ok2 & (p < o)) | (ok1 & ~ok2)
    ahead2 = (ok1 & ok2 & (o < p)) | (ok2 & ~ok1)
    q_ok = (q > 0) & (oq > 0)
    return duel.groupBy(*scope, "season", "team", F.col("entity").alias("first"), F.col("o_entity").alias("second")).agg(
        F.count(F.lit(1)).alias("races"),
        count_if(ok1 & ok2).alias("both_finished"),
        count_if(ahead1).alias("first_ahead"),
        count_if(ahead2).alias("second_ahead"),
        count_if(q_ok).alias("quali_compared"),
        count_if(q_ok & (q < oq)).alias("first_quali_ahead"),
        count_if(q_ok & (oq < q)).alias("second_quali_ahead"),
        count_if(p == 1).alias("first_wins"),
        count_if(o == 1).alias("second_wins"),
        count_if(p <= 3).alias("first_podiums"),
        count_if(o <= 3).alias("second_podiums"),
        F.sum("points").alias("first_points"),
        F.sum("o_points").alias("second_points"),
        count_if(~ok1).alias("first_dnfs"),
        count_if(~ok2).alias("second_dnfs"),
    )
