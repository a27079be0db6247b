"""Long-run pace and tyre wear from lap tables.

Laps are the one table whose groups can be arbitrarily large, so medians, lap
indices and the joins back to group statistics use the skew-safe forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import clip, gap_pct, rank_where
from lapwing.operators.skew import HotGroups, add_group_columns, add_group_percentile, ordered_index
from lapwing.operators.weekend import clean_running, valid_laps

MIN_LAPS = 4
SLOW_LAP = 1.12
FUEL_PER_LAP = 0.035
LONG_RUN_LAPS = 12.0

# Tyre model.
BASE_RATE = {"SOFT": 0.110, "MEDIUM": 0.065, "HARD": 0.038}
RACE_MIX = {"SOFT": 0.20, "MEDIUM": 0.50, "HARD": 0.30}
SLOPE_BOUNDS = (0.005, 0.40)
SHORT_STINT_SLOPE = 0.05
BASE_PACE_DELTA = 0.65


def _lap_levels(lap: str) -> list[Column]:
    return [F.format_string("%018d", F.floor(F.col(lap) / 1_048_576).cast("long")), F.floor(F.col(lap) / 1_024)]


def stint_summary(
    laps: DataFrame,
    keys: Sequence[str],
    min_laps: int = MIN_LAPS,
    slow: float = SLOW_LAP,
    fuel: float = FUEL_PER_LAP,
    hot: HotGroups | None = None,
) -> DataFrame:
    """One row per representative stint; ``keys`` end in (stint, compound).

    Stints need ``min_laps`` laps before and after dropping laps slower than
    ``slow`` times the stint median.
    """
    keys = list(keys)
    clean = clean_running(valid_laps(laps)).where(F.col("stint").isNotNull() & F.col("compound").isNotNull())
    clean = clean.select(*keys, "lap", "lap_s")
    clean = add_group_columns(clean, keys, {"_n": F.count(F.lit(1))}, hot)
    clean = add_group_percentile(clean, keys, "lap_s", 0.5, "_median", hot)
    kept = clean.where((F.col("_n") >= min_laps) & (F.col("lap_s") <= F.col("_median") * F.lit(slow)))
    kept = ordered_index(kept.drop("_n", "_median"), keys, [F.col("lap"), F.col("lap_s")], _lap_levels("lap"), "_i", hot)
    kept = add_group_percentile(kept, keys, "lap_s", 0.5, "_middle", hot)
    i = (F.col("_i") - 1).cast("double")
    stats = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lap_count"),
        F.avg("lap_s").alias("mean_lap"),
        F.first("_middle").alias("median_lap"),
        F.min("lap_s").alias("best_lap"),
        F.stddev_pop("lap_s").alias("std_lap"),
        F.avg(F.col("lap_s") + F.lit(fuel) * i).alias("fuel_adj_mean_lap"),
        F.regr_slope(F.col("lap_s"), i).alias("deg_slope"),
    )
    return stats.where(F.col("lap_count") >= min_laps)


def long_run_pace(stints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per entrant: the longest (then fastest) stint, total laps and pooled spread.

    The pooled spread is combined from the stints' counts, means and spreads.
    """
    keys = list(keys)
    who = Window.partitionBy(*keys)
    n, mu, sd = F.col("lap_count"), F.col("mean_lap"), F.col("std_lap")
    rows = stints.withColumn("_mean", F.sum(n * mu).over(who) / F.sum(n).over(who))
    spread = F.sqrt(F.sum(n * sd * sd + n * (mu - F.col("_mean")) ** 2) / F.sum(n))
    best = F.min_by(
        F.struct("mean_lap", "median_lap", "fuel_adj_mean_lap", "compound", "deg_slope"),
        F.struct(-n, F.col("fuel_adj_mean_lap"), F.col("compound"), F.col("stint")),
    )
    out = rows.groupBy(*keys).agg(
        best.alias("_b"),
        spread.alias("race_pace_consistency"),
        F.sum(n).alias("race_pace_sample_count"),
        F.max(n).alias("long_run_stint_length"),
    )
    return out.select(
        *keys,
        F.lit(True).alias("has_long_run"),
        F.col("_b.mean_lap").alias("best_stint_mean"),
        F.col("_b.median_lap").alias("best_stint_median"),
        F.col("_b.fuel_adj_mean_lap").alias("fuel_adj_pace"),
        "race_pace_consistency",
        "race_pace_sample_count",
        "long_run_stint_length",
        F.col("_b.compound").alias("primary_compound"),
        F.col("_b.deg_slope").alias("deg_slope"),
    )


def add_race_pace(rows: DataFrame, race: Sequence[str], q_position: str | None = None) -> DataFrame:
    """Field gap, rank, confidence and qualifying-minus-pace rank; rows are the entry list joined to
    :func:`long_run_pace`."""
    field = Window.partitionBy(*race)
    ordered = field.orderBy(F.col("fuel_adj_pace").asc_nulls_last())
    rows = rows.withColumns(
        {
            "race_pace_sample_count": F.coalesce("race_pace_sample_count", F.lit(0)),
            "long_run_stint_length": F.coalesce("long_run_stint_length", F.lit(0)),
            "long_run_pace_gap_pct": gap_pct(F.col("fuel_adj_pace"), F.min("fuel_adj_pace").over(field)),
            "long_run_pace_rank": rank_where(F.col("fuel_adj_pace"), ordered),
        }
    )
    delta = F.col(q_position) - F.col("long_run_pace_rank") if q_position else F.lit(None)
    return rows.withColumns(
        {
            "race_pace_confidence": clip(F.col("race_pace_sample_count") / LONG_RUN_LAPS, 0.0, 1.0),
            "race_pace_vs_quali_delta": delta.cast("double"),
        }
    )


def robust_slope(laps: DataFrame, keys: Sequence[str], age: str, hot: HotGroups | None = None) -> DataFrame:
    """Wear per lap by a trimmed line fit, one row per group: (slope, r2, n).

    A first least-squares line gives residuals; laps further out than
    ``max(2.5 * 1.4826 * MAD, 0.5)`` are dropped and the line is fitted again
    when three or more laps remain.
    """
    keys = list(keys)
    pts = laps.where(F.col("lap_s").isNotNull() & F.col(age).isNotNull()).select(
        *keys, F.col(age).cast("double").alias("_x"), F.col("lap_s").alias("_y")
    )
    line = {"_m": F.regr_slope("_y", "_x"), "_c": F.regr_intercept("_y", "_x"), "_n": F.count(F.lit(1))}
    res = add_group_columns(pts, keys, line, hot)
    res = res.withColumn("_r", F.coalesce(F.col("_y") - (F.col("_m") * F.col("_x") + F.col("_c")), F.lit(0.0))).drop("_c")
    res = add_group_percentile(res, keys, "_r", 0.5, "_mid", hot)
    res = res.withColumn("_d", F.abs(F.col("_r") - F.col("_mid"))).drop("_mid")
    res = add_group_percentile(res, keys, "_d", 0.5, "_mad", hot)
    keep = F.abs("_r") <= F.greatest(F.lit(2.5) * 1.4826 * F.col("_mad"), F.lit(0.5))
    y, x = F.when(keep, F.col("_y")), F.when(keep, F.col("_x"))
    syy, sxx, sxy = F.regr_syy(y, x), F.regr_sxx(y, x), F.regr_sxy(y, x)
    fit = res.groupBy(*keys).agg(
        F.first("_m").alias("_m"),
        F.first("_n").alias("n"),
        F.regr_slope(y, x).alias("_m2"),
        F.count(y).alias("_n2"),
        F.when((syy > 1e-6) & (sxx > 0), 1.0 - (syy - sxy * sxy / sxx) / (syy + 1e-8)).otherwise(0.0).alias("_r2"),
    )
    refit = (F.col("_n2") >= 3) & F.col("_m2").isNotNull()
    short = F.col("n") < 3
    slope = F.when(short, F.lit(SHORT_STINT_SLOPE)).otherwise(
        clip(F.when(refit, F.col("_m2")).otherwise(F.col("_m")), *SLOPE_BOUNDS)
    )
    r2 = F.when(short | ~F.coalesce(refit, F.lit(False)), F.lit(0.0)).otherwise(clip(F.col("_r2"), 0.0, 1.0))
    return fit.select(*keys, F.coalesce(slope, F.lit(SHORT_STINT_SLOPE)).alias("slope"), r2.alias("r2"), "n")


def temperature_scale(track_temperature: Column) -> Column:
    """1.5 % more wear per degree above thirty, within bounds; one when unknown."""
    return F.coalesce(clip(F.lit(1.0) + (track_temperature - 30.0) * 0.015, 0.70, 1.45), F.lit(1.0))


def compound_wear(
    laps: DataFrame,
    lineup: DataFrame,
    race: Sequence[str],
    age: str = "lap",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Wear rates per entrant and compound, shrunk to the circuit prior.

    ``lineup`` has (race, entity, team, deg_multiplier[, track_temperature]).
    Own stints are weighted by laps; without any, the team's rate is mixed half
    and half with the prior; without that, the prior stands.
    """
    race = list(race)
    who = race + ["entity"]
    keep = laps.where((F.col("lap_s") > 50) & F.col("compound").isin(*BASE_RATE))
    runs = robust_slope(keep, who + ["stint", "compound"], age, hot).where(F.col("n") >= MIN_LAPS)
    own = runs.groupBy(*who, "compound").agg(F.sum("n").alias("own_laps"), (F.sum(F.col("slope") * F.col("n")) / F.sum("n")).alias("own_rate"))
    scale = temperature_scale(F.col("track_temperature")) if "track_temperature" in lineup.columns else F.lit(1.0)
    base = F.explode(F.array(*[F.struct(F.lit(c).alias("compound"), F.lit(r).alias("rate")) for c, r in BASE_RATE.items()]))
    grid = lineup.select(*who, "team", scale.alias("_scale"), "deg_multiplier", base.alias("_b")).select(
        *who, "team", F.col("_b.compound").alias("compound"),
        (F.col("_b.rate") * F.col("deg_multiplier") * F.col("_scale")).alias("prior"),
    )
    rows = grid.join(own, who + ["compound"], "left")
    # the whole team is in the line-up, so its pooled rate is a window over a handful of rows
    garage = Window.partitionBy(*race, "team", "compound")
    laps_of_team = F.sum("own_laps").over(garage)
    rows = rows.withColumn("team_laps", laps_of_team).withColumn(
        "team_rate", F.sum(F.col("own_rate") * F.col("own_laps")).over(garage) / F.col("team_laps")
    )
    w = F.least(F.col("own_laps") / 12.0, F.lit(0.85))
    rate = (
        F.when(F.col("own_laps") > 0, w * F.col("own_rate") + (1.0 - w) * F.col("prior"))
        .when(F.col("team_laps") > 0, F.col("team_rate") * 0.5 + F.col("prior") * 0.5)
        .otherwise(F.col("prior"))
    )
    seen = F.coalesce("own_laps", F.floor(F.col("team_laps") * 0.5), F.lit(0))
    pick = lambda c: F.max(F.when(F.col("compound") == c, F.col("_rate")))
    mix = sum((pick(c) * F.lit(m) for c, m in RACE_MIX.items()), F.lit(0.0))
    return (
        rows.withColumn("_rate", rate)
        .withColumn("_seen", seen)
        .groupBy(*who)
        .agg(
            pick("SOFT").alias("soft_tyre_deg_rate"),
            pick("MEDIUM").alias("medium_tyre_deg_rate"),
            pick("HARD").alias("hard_tyre_deg_rate"),
            mix.alias("estimated_tyre_deg_rate"),
            (pick("SOFT") - pick("MEDIUM") + BASE_PACE_DELTA).alias("compound_pace_delta"),
            clip(F.sum("_seen") / 18.0, 0.20, 1.0).alias("tyre_deg_confidence"),
        )
    )
