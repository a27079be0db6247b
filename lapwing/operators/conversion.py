"""Grid-to-finish conversion and circuit history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import grid_bucket
from lapwing.functions.status import count_if, is_classified_finish

# Start-slot buckets.
BUCKETS = {
    "front_row": (1, 2),
    "top_5": (3, 5),
    "points_zone": (6, 10),
    "midfield": (11, 16),
    "backmarkers": (17, 22),
}
EMPTY_RETENTION = 0.60
SHRINKAGE = 5.0


def _bucket_dimension():
    return F.explode(
        F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit((lo + hi) / 2.0).alias("mid")) for b, (lo, hi) in BUCKETS.items()])
    )


def bucket_history(results: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per (scope, target round, bucket): count, mean classified finish and share holding the slot,
    over strictly earlier rounds."""
    scope = list(scope)
    top = max(hi for _, hi in BUCKETS.values())
    valid = results.where(F.col("grid").between(1, top) & F.col("position").isNotNull())
    classified = is_classified_finish(F.col("status"))
    per_round = valid.groupBy(*scope, "rnd", grid_bucket(F.col("grid")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("position") <= F.col("grid")).alias("held"),
        F.sum(F.when(classified, F.col("position"))).alias("fin"),
        count_if(classified).alias("n_fin"),
    )
    rounds = results.select(*scope, "rnd").distinct().select("*", _bucket_dimension().alias("_b")).select(
        *scope, "rnd", "_b.bucket", "_b.mid"
    )
    before = Window.partitionBy(*scope, "bucket").orderBy("rnd").rowsBetween(Window.unboundedPreceding, -1)
    total = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "held", "fin", "n_fin")}
    filled = rounds.join(per_round, [*scope, "rnd", "bucket"], "left").withColumns({f"_{c}": v for c, v in total.items()})
    return filled.select(
        *scope,
        "rnd",
        "bucket",
        F.col("_n").alias("bucket_n"),
        F.when(F.col("_n_fin") > 0, F.col("_fin") / F.col("_n_fin")).otherwise(F.col("mid")).alias("running_mean"),
        F.when(F.col("_n") > 0, F.col("_held") / F.col("_n")).otherwise(F.lit(EMPTY_RETENTION)).alias("retention"),
    )


def _shrunk(slot, field_size: int, m: float):
    n = F.col("bucket_n")
    prior_keep = F.lit(0.50) + F.lit(0.25) * ((slot - 1) / F.lit(float(max(field_size - 1, 1))))
    return {
        "expected_grid_finish": (n * F.col("running_mean") + m * slot) / (n + F.lit(m)),
        "grid_retention_prob": (n * F.col("retention") + m * prior_keep) / (n + F.lit(m)),
    }


def conversion_map(results: DataFrame, scope: Sequence[str], field_size: int = 22, m: float = SHRINKAGE) -> DataFrame:
    """Expected finish and holding probability for every slot, as of each round."""
    slots = F.explode(F.sequence(F.lit(1), F.lit(field_size)))
    history = bucket_history(results, scope)
    grid = results.select(*scope, "rnd").distinct().withColumn("slot", slots)
    grid = grid.withColumn("bucket", grid_bucket(F.col("slot")))
    out = grid.join(history, [*scope, "rnd", "bucket"]).withColumns(_shrunk(F.col("slot"), field_size, m))
    return out.select(*scope, "rnd", F.col("slot").cast("long").alias("slot"), "expected_grid_finish", "grid_retention_prob")


def add_conversion(rows: DataFrame, results: DataFrame, scope: Sequence[str], grid: str, field_size: int, m: float = SHRINKAGE) -> DataFrame:
    """Conversion features of each row's start slot (clamped to the field)."""
    scope = list(scope)
    slot = F.least(F.greatest(F.rint(F.col(grid)), F.lit(1.0)), F.lit(float(field_size)))
    keyed = rows.withColumn("_slot", slot).withColumn("bucket", grid_bucket(F.col("_slot")))
    out = keyed.join(bucket_history(results, scope), [*scope, "rnd", "bucket"], "left")
    return out.withColumns(_shrunk(F.col("_slot"), field_size, m)).drop("_slot", "bucket", "bucket_n", "running_mean", "retention")


def track_history(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean finish, grid and places gained of each entrant at a circuit."""
    return history.groupBy(*keys).agg(
        F.avg("position").alias("track_avg_finish"),
        F.avg("grid").alias("track_avg_grid"),
        F.avg(F.col("grid") - F.col("position")).alias("track_avg_pos_gained"),
        F.count("position").alias("track_races_completed"),
    )


def with_track_history(lineup: DataFrame, history: DataFrame, keys: Sequence[str], default: float = 12.0) -> DataFrame:
    """Entrants with no visit get neutral values."""
    joined = lineup.join(track_history(history, keys), list(keys), "left")
    return joined.withColumns(
        {
            "track_avg_finish": F.coalesce("track_avg_finish", F.lit(default)),
            "track_avg_grid": F.coalesce("track_avg_grid", F.lit(default)),
            "track_avg_pos_gained": F.coalesce("track_avg_pos_gained", F.lit(0.0)),
            "track_races_completed": F.coalesce("track_races_completed", F.lit(0)),
        }
    )
