"""Pit plans: costs of every candidate plan in closed form, and the best one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_PACE = 85.0
PACE_PER_PLACE = 0.08


@dataclass(frozen=True)
class Compound:
    """Wear in seconds a lap, pace against the medium, and laps it lasts."""

    wear: float
    pace: float
    laps: int


# Tyre compounds.
COMPOUNDS = {
    "SOFT": Compound(0.110, -0.65, 22),
    "MEDIUM": Compound(0.065, 0.0, 35),
    "HARD": Compound(0.038, 0.55, 48),
    "INTERMEDIATE": Compound(0.080, 3.50, 30),
    "WET": Compound(0.095, 7.50, 28),
}


@dataclass(frozen=True)
class Strategy:
    """What plans are costed with; read from a configuration by ``files.read_strategy``."""

    pit_loss: float = 22.0
    fuel_per_lap: float = 0.035
    compounds: dict = field(default_factory=lambda: dict(COMPOUNDS))


RACE_TYRES = ("SOFT", "MEDIUM", "HARD")
# Plans as (name, compounds, change points as shares of the distance, limit stint length).
DRY_PLANS = [
    ("1-Stop (M-H)", ("MEDIUM", "HARD"), (0.42,), True),
    ("1-Stop (H-M)", ("HARD", "MEDIUM"), (0.58,), True),
    ("1-Stop (S-H)", ("SOFT", "HARD"), (0.28,), True),
    ("2-Stop (M-H-M)", ("MEDIUM", "HARD", "MEDIUM"), (0.30, 0.68), False),
    ("2-Stop (S-M-H)", ("SOFT", "MEDIUM", "HARD"), (0.22, 0.58), False),
]
WET_PLANS = [
    ("1-Stop (Inter-Inter)", ("INTERMEDIATE", "INTERMEDIATE"), (0.50,), False),
    ("2-Stop (Inter-Inter-Inter)", ("INTERMEDIATE",) * 3, (0.33, 0.67), False),
]


def stint_seconds(pace: Column, offset: float, wear: Column, start: Column, laps: Column, total: Column, fuel_per_lap: float) -> Column:
    """Time of a stint starting on lap ``start``: the sum over laps in closed form."""
    fuel = laps * (total - start) - laps * (laps - 1) / 2
    return laps * (pace + offset) + wear * laps * (laps + 1) / 2 + fuel * fuel_per_lap


def plan_costs(entrants: DataFrame, wet: bool = False, strategy: Strategy = Strategy()) -> DataFrame:
    """Cost of every admissible plan per entrant.

    Rows need total_laps, QualifyingPosition and, in the dry, soft/medium/hard_tyre_deg_rate; a null pit_loss_seconds or
    wear rate is the strategy's.
    """
    total = F.col("total_laps").cast("double")
    pace = F.lit(BASE_PACE) + (F.col("QualifyingPosition") - 1.0) * PACE_PER_PLACE
    tyres = strategy.compounds
    wear = {c: F.coalesce(F.col(f"{c.lower()}_tyre_deg_rate"), F.lit(t.wear)) if c in RACE_TYRES and not wet else F.lit(t.wear) for c, t in tyres.items()}
    lost = F.coalesce(F.col("pit_loss_seconds"), F.lit(strategy.pit_loss))
    plans = []
    for i, (name, compounds, cuts, limited) in enumerate(WET_PLANS if wet else DRY_PLANS):
        stops = [F.rint(total * c) for c in cuts]
        edges = [F.lit(0.0), *stops, total]
        time, fits = lost * float(len(stops)), F.lit(True)
        for k, c in enumerate(compounds):
            laps = edges[k + 1] - edges[k]
            time = time + stint_seconds(pace, tyres[c].pace, wear[c], edges[k] + 1, laps, total, strategy.fuel_per_lap)
            if limited:
                fits = fits & (laps <= tyres[c].laps)
        label = F.concat(F.lit(name), F.lit(" @ "), F.concat_ws(", ", *[s.cast("int").cast("string") for s in stops]))
        plans.append(
            F.when(fits, F.struct(F.lit(i).alias("plan"), label.alias("plan_name"), F.lit(len(stops)).alias("stops"), time.alias("total_seconds")))
        )
    return entrants.select("*", F.explode(F.array_compact(F.array(*plans))).alias("_p")).select(*entrants.columns, "_p.*")


def best_plans(costs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cheapest and next plan per entrant with the difference in seconds."""
    w = Window.partitionBy(*keys).orderBy(F.round("total_seconds", 6), "plan")
    rows = costs.withColumns(
        {
            "_k": F.row_number().over(w),
            "_alt": F.lead("plan_name").over(w),
            "_alt_s": F.lead("total_seconds").over(w),
        }
    ).where(F.col("_k") == 1)
    return rows.select(
        *keys, F.col("stops").alias("optimal_strategy_stops"), F.col("plan_name").alias("recommended_strategy"),
        F.coalesce("_alt", "plan_name").alias("alternative_strategy"),
        F.coalesce(F.col("_alt_s") - F.col("total_seconds"), F.lit(0.0)).alias("strategy_delta_seconds"),
    )
