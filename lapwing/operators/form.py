"""Season form as of each round: nothing from the target round or later is used.

Every target round is answered by one expanding window instead of one pass over
the history per round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import ratio
from lapwing.functions.status import classify, count_if

ALPHA = 0.3
DEFAULT_POSITION = 12.0


def ewma(values: Column, alpha: float = ALPHA) -> Column:
    """EWMA of an ordered array (newest last), nulls dropped; exact at any length."""
    clean = F.filter(values, lambda v: v.isNotNull())
    rest = F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0)))
    return F.when(
        F.size(clean) > 0,
        F.aggregate(rest, F.get(clean, F.lit(0)), lambda acc, v: acc * F.lit(1 - alpha) + v * F.lit(alpha)),
    )


def _block_length(alpha: float) -> int:
    """Observations of a block: inside one the powers stay within a double, and what lies two blocks back has a weight
    under 1e-150, so it can't change a double."""
    return max(1, int(150 * math.log(10) / -math.log(1 - alpha)))


def _reach(alpha: float) -> int:
    """Known values after which a weight is below 1e-17, so that it can't change a double."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    return math.ceil(17 * math.log(10) / -math.log(1 - alpha))


def add_ewma(df: DataFrame, scope: list[str], columns: dict[str, str], alpha: float = ALPHA) -> DataFrame:
    """Adds for each ``value: name`` the EWMA of all known values before a row, exact at any length of a history.

    Known values are numbered, and a row sums the last ones that can matter, each scaled by its place in a block of numbers.
    A reach is shorter than a block, so it meets two blocks at most, an even and an odd one: two sums in one frame, put
    on the row's own scale, are the mean.
    """
    keep, reach = 1 - alpha, _reach(alpha)
    block = 2 * reach
    by_round = Window.partitionBy(*scope).orderBy("rnd")
    seen = by_round.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"_n_{v}": F.count(v).over(seen) for v in columns})
    for value, name in columns.items():
        n = F.col(f"_n_{value}")
        inside = F.pmod(n, F.lit(block)).cast("double")
        odd = F.pmod(F.floor(n / block), F.lit(2)) == 1
        weight = F.when(n == 1, 1.0).otherwise(alpha) * F.pow(F.lit(keep), -inside)
        term = F.when(F.col(value).isNotNull(), weight * F.col(value))
        frame = Window.partitionBy(*scope).orderBy(f"_n_{value}").rangeBetween(-reach, 0)
        even_sum = F.coalesce(F.sum(F.when(~odd, term)).over(frame), F.lit(0.0))
        odd_sum = F.coalesce(F.sum(F.when(odd, term)).over(frame), F.lit(0.0))
        own, before = F.when(odd, odd_sum).otherwise(even_sum), F.when(odd, even_sum).otherwise(odd_sum)
        mean = own * F.pow(F.lit(keep), inside) + before * F.pow(F.lit(keep), inside + block)
        # the frame ends with the row's own value, which doesn't count yet
        earlier = F.when(n > 1, (mean - alpha * F.col(value)) / keep)
        rows = rows.withColumn(name, F.when(F.col(value).isNotNull(), earlier).when(n > 0, mean))
    return rows.drop(*[f"_n_{v}" for v in columns])


def add_driver_form(df: DataFrame, scope: list[str], alpha: float = ALPHA, default: float = DEFAULT_POSITION) -> DataFrame:
    """Adds the as-of form of each entrant to every race row.

    ``scope`` names the columns that contain an entrant's history (for example
    championship and entity); rows need rnd, position, grid, points, status and
    optionally q_position.
    """
    by_round = Window.partitionBy(*scope).orderBy("rnd")
    prior = by_round.rowsBetween(Window.unboundedPreceding, -1)
    has_q = "q_position" in df.columns

    rows = df.withColumn("status_class", classify(F.col("status")))
    means = {"position": "_fin_ewma", "grid": "_grid_ewma"} | ({"q_position": "_q_ewma"} if has_q else {})
    rows = add_ewma(rows, scope, means, alpha)

    def seen(name: str) -> Column:
        return count_if(F.col("status_class") == name).over(prior)

    total = F.count(F.lit(1)).over(prior)
    rows = (
        rows.withColumn("races_completed", total)
        .withColumn("_entries", total - seen("UNKNOWN"))
        .withColumn("_starts", F.greatest(F.col("_entries") - seen("DNS"), F.lit(0)))
    )
    d = F.lit(default)
    quali_ewma = F.coalesce("_q_ewma", "_grid_ewma") if has_q else F.col("_grid_ewma")
    out = {
        "avg_finish": F.coalesce(F.avg("position").over(prior), d),
        "avg_grid": F.coalesce(F.avg("grid").over(prior), d),
        "total_points": F.coalesce(F.sum("points").over(prior), F.lit(0.0)),
        "recent_finish": F.coalesce(F.last("position", ignorenulls=True).over(prior).cast("double"), d),
        "recent_grid": F.coalesce(F.last("grid", ignorenulls=True).over(prior).cast("double"), d),
        "recent_points": F.coalesce(F.last("points").over(prior), F.lit(0.0)),
        "driver_finish_ewma": F.coalesce(F.col("_fin_ewma"), d),
        "driver_quali_ewma": F.coalesce(quali_ewma, d),
        "driver_dns_rate": ratio(seen("DNS"), F.col("_entries")),
        "driver_dnf_rate": ratio(seen("RETIRED"), F.col("_starts")),
        "driver_dsq_rate": ratio(seen("DSQ"), F.col("_entries")),
        "driver_nc_rate": ratio(seen("NC"), F.col("_starts")),
    }
    rows = rows.withColumns(out)
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def driver_form(history: DataFrame, keys: list[str], alpha: float = ALPHA, default: float = DEFAULT_POSITION) -> DataFrame:
    """Form over a whole (already cut off) history, one row per entrant."""
    rows = history.withColumn("status_class", classify(F.col("status")))
    n = lambda name: count_if(F.col("status_class") == name)
    entries = F.count(F.lit(1)) - n("UNKNOWN")
    starts = F.greatest(entries - n("DNS"), F.lit(0))
    d = F.lit(default)

    def series(col: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("rnd", F.col(col).cast("double").alias("v")))))
        return F.transform(pairs, lambda s: s["v"])

    def latest(col: str) -> Column:
        return F.max_by(F.col(col).cast("double"), F.when(F.col(col).isNotNull(), F.col("rnd")))

    quali = ewma(series("q_position"), alpha) if "q_position" in history.columns else F.lit(None).cast("double")
    return rows.groupBy(*keys).agg(
        F.coalesce(F.avg("position"), d).alias("avg_finish"),
        F.coalesce(F.avg("grid"), d).alias("avg_grid"),
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("total_points"),
        F.count(F.lit(1)).alias("races_completed"),
        F.coalesce(latest("position"), d).alias("recent_finish"),
        F.coalesce(latest("grid"), d).alias("recent_grid"),
        F.coalesce(F.max_by("points", "rnd"), F.lit(0.0)).alias("recent_points"),
        F.coalesce(ewma(series("position"), alpha), d).alias("driver_finish_ewma"),
        F.coalesce(quali, ewma(series("grid"), alpha), d).alias("driver_quali_ewma"),
        ratio(n("DNS"), entries).alias("driver_dns_rate"),
        ratio(n("RETIRED"), starts).alias("driver_dnf_rate"),
        ratio(n("DSQ"), entries).alias("driver_dsq_rate"),
        ratio(n("NC"), starts).alias("driver_nc_rate"),
    )


def season_form(results: DataFrame, keys: list[str], target_round: int, **kw) -> DataFrame:
    """Form for one target round: strictly earlier rounds only."""
    return driver_form(results.where(F.col("rnd") < target_round), keys, **kw)


def team_form(df: DataFrame, scope: list[str], alpha: float = ALPHA, default: float = DEFAULT_POSITION) -> DataFrame:
    """Team form as of each round, one row per (scope, round).

    A team has several rows per round, so each round is first reduced to sums
    and counts, and only those are run through the expanding window.  Inside a
    round the cars are taken in entity order.
    """
    in_round = Window.partitionBy(*scope, "rnd").orderBy("entity")
    cars = df.withColumn("_k", F.count("position").over(in_round.rowsBetween(Window.unboundedPreceding, 0)))
    decay, a = F.lit(1 - alpha), F.lit(alpha)
    per_round = cars.groupBy(*scope, "rnd").agg(
        F.count("position").alias("_n"),
        F.sum("position").alias("_sum"),
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("_points"),
        F.sum(a * F.pow(decay, -F.col("_k")) * F.col("position")).alias("_mid"),
        F.max(F.when(F.col("_k") == 1, F.col("position"))).alias("_first"),
    )
    by_round = Window.partitionBy(*scope).orderBy("rnd")
    prior = by_round.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(prior), F.lit(0))
    length = _block_length(alpha)
    per_round = per_round.withColumn("_before", before).withColumn("_b", F.floor(F.col("_before") / length))
    per_round = per_round.withColumn("_i", (F.col("_before") - F.col("_b") * length).cast("double"))
    # the very first value of a team has weight 1 instead of alpha
    opening = F.when((F.col("_before") == 0) & (F.col("_n") > 0), (F.lit(1.0) - a) * F.pow(decay, F.lit(-1.0)) * F.col("_first"))
    term = F.pow(decay, -F.col("_i")) * (F.coalesce("_mid", F.lit(0.0)) + F.coalesce(opening, F.lit(0.0)))
    in_block = Window.partitionBy(*scope, "_b").orderBy("rnd").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("_i") + F.col("_n")
    per_round = per_round.withColumn("_own", F.sum(term).over(in_block) * F.pow(decay, after)).withColumn("_end", F.lag("_own").over(by_round))
    carried = F.first("_end").over(in_block) * F.pow(decay, after - F.first("_i").over(in_block))
    per_round = per_round.withColumn("_ewma", F.col("_own") + F.when(F.col("_b") > 0, F.coalesce(carried, F.lit(0.0))).otherwise(0.0))
    per_round = per_round.withColumn("_ewma", F.when(F.col("_before") + F.col("_n") > 0, F.col("_ewma"))).withColumn("_ewma", F.lag("_ewma").over(by_round))
    d = F.lit(default)
    rounds = F.count(F.lit(1)).over(prior)
    points = F.coalesce(F.sum("_points").over(prior), F.lit(0.0))
    return per_round.select(
        *scope,
        "rnd",
        F.coalesce(F.sum("_sum").over(prior) / F.nullif(F.col("_before"), F.lit(0)), d).alias("team_avg_finish"),
        F.coalesce(F.col("_ewma"), d).alias("team_finish_ewma"),
        points.alias("team_points"),
        (points / F.greatest(rounds * 2, F.lit(1))).alias("team_points_rate"),
    )
def add_rolling_finish(df: DataFrame, scope: list[str], n: int = 3, default: float = DEFAULT_POSITION) -> DataFrame:
    """Mean of the last ``n`` known finishes before each round."""
    by_round = Window.partitionBy(*scope).orderBy("rnd")
    known = df.where(F.col("position").isNotNull())
    if n < 1:
        raise ValueError("n must be positive")
    # finishes are numbered among known ones only, so an unknown result never uses up a slot
    last = by_round.rowsBetween(-n, -1)
    rolled = known.withColumn("rolling_finish", F.coalesce(F.avg("position").over(last), F.lit(default)))
    unknown = df.where(F.col("position").isNull())
    asof = Window.partitionBy(*scope).orderBy("rnd").rowsBetween(Window.unboundedPreceding, 0)
    merged = rolled.withColumn(
        "_next", F.avg("position").over(by_round.rowsBetween(-(n - 1), 0))
    ).unionByName(unknown.withColumn("rolling_finish", F.lit(None).cast("double")).withColumn("_next", F.lit(None).cast("double")))
    return merged.withColumn(
        "rolling_finish",
        F.coalesce("rolling_finish", F.last("_next", ignorenulls=True).over(asof), F.lit(default)),
    ).drop("_next")
