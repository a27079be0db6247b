"""Group operators that stay correct and distributed when one group is huge.

A plain window or ``percentile`` sends a whole group to one task.  A caller
first asks :func:`find_hot` for the *hot* groups, those of more than
``HOT_ROWS`` rows.  There are at most rows / ``HOT_ROWS`` of them; their list is
a table in the shared folder, and Spark chooses each join from its size.  Cold groups take the plain operator;
hot groups take a split one with the same exact result,
null keys and groups without a value included.  Without hot groups the
plan is just the plain operator.  A list found on a table also holds for any
subset of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.session import cut_lineage

HOT_ROWS = 500_000


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys; null equals null."""
    named = other.select(*[F.col(c).alias(f"_r_{c}" if c in set(keys) else c) for c in other.columns])
    same = [df[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return df.join(named, same, "left").drop(*[f"_r_{k}" for k in keys])


class HotGroups:
    """Keys and sizes of the largest groups of one table."""

    def __init__(self, keys: Sequence[str], frame: DataFrame, limit: int):
        self.keys, self.frame, self.limit = list(keys), frame, limit

    def flag(self, df: DataFrame) -> DataFrame:
        """Adds ``hot_rows``: the group size for hot groups, null for the rest."""
        return null_safe_join(df, self.frame, self.keys)

    def salts(self) -> Column:
        return F.ceil(F.col("hot_rows") / F.lit(self.limit)).cast("int")


def find_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> HotGroups | None:
    """Counts the groups (combined on the map side) and keeps the few large ones; None when there are none."""
    limit = HOT_ROWS if hot_rows is None else hot_rows
    found = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("hot_rows"))
        .where(F.col("hot_rows") > limit)
    )
    kept = cut_lineage(found)
    return None if kept.isEmpty() else HotGroups(keys, kept, limit)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], hot: HotGroups | None) -> DataFrame:
    """Joins rows to one-row-per-group statistics; rows whose group has none keep nulls.

    Rows of a hot group are spread over ``ceil(size / limit)`` salts and the
    group's single statistics row is copied once per salt.  The salt is a hash
    of the row, so a task that is run again sends each row the same way.
    """
    keys = list(keys)
    if hot is None:
        return null_safe_join(df, stats, keys)
    salts = hot.salts()
    spread = F.pmod(F.xxhash64(*df.columns), F.greatest(salts, F.lit(1))).cast("int")
    rows = hot.flag(df).withColumn("_salt", F.when(F.col("hot_rows").isNull(), F.lit(0)).otherwise(spread))
    copies = hot.flag(stats).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(salts - 1, F.lit(0))))
    )
    return null_safe_join(rows.drop("hot_rows"), copies.drop("hot_rows"), keys + ["_salt"]).drop("_salt")


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Column],
    out: str,
    hot: HotGroups | None,
) -> DataFrame:
    """``row_number`` (1-based) in ``order`` within ``keys``.

    ``levels`` are two coarse steps of the order (first, second), each monotone
    in it: a hot group is numbered inside every (level, level) cell and the
    cells are shifted by prefix sums of their counts.
    """
    keys = list(keys)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(whole).cast("long"))
    first, second = levels
    is_hot = F.col("hot_rows").isNotNull()
    flagged = hot.flag(df).withColumn("_l1", F.when(is_hot, first.cast("string"))).withColumn(
        "_l2", F.when(is_hot, second.cast("long"))
    )
    local = Window.partitionBy(*keys, "_l1", "_l2").orderBy(*order)
    numbered = flagged.withColumn("_local", F.row_number().over(local).cast("long"))

    cells = flagged.where(is_hot).groupBy(*keys, "_l1", "_l2").agg(F.count(F.lit(1)).alias("_n"))
    before_cell = Window.partitionBy(*keys, "_l1").orderBy("_l2").rowsBetween(Window.unboundedPreceding, -1)
    before_step = Window.partitionBy(*keys).orderBy("_l1").rowsBetween(Window.unboundedPreceding, -1)
    steps = cells.groupBy(*keys, "_l1").agg(F.sum("_n").alias("_step_n"))
    steps = steps.withColumn("_step_off", F.coalesce(F.sum("_step_n").over(before_step), F.lit(0))).drop("_step_n")
    offsets = cells.withColumn("_cell_off", F.coalesce(F.sum("_n").over(before_cell), F.lit(0)))
    offsets = null_safe_join(offsets, steps, keys + ["_l1"])
    shift = offsets.select(*keys, "_l1", "_l2", (F.col("_cell_off") + F.col("_step_off")).alias("_shift"))
    return (
        null_safe_join(numbered, shift, keys + ["_l1", "_l2"])
        .withColumn(out, F.col("_local") + F.coalesce("_shift", F.lit(0)))
        .drop("_local", "_shift", "_l1", "_l2", "hot_rows")
    )


def group_percentile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, out: str, hot: HotGroups | None
) -> DataFrame:
    """Exact, linearly interpolated percentile per group, one row per group.

    Cold groups use ``percentile``.  For a hot group a mergeable sketch brackets
    the answer, the rows below the bracket are only counted, and just the rows
    inside it (about 1/25,000 of the group) are sorted.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    if hot is None:
        return rows.groupBy(*keys).agg(F.percentile(value, p).cast("double").alias(out))
    flagged = hot.flag(rows)
    cold = (
        flagged.where(F.col("hot_rows").isNull()).groupBy(*keys).agg(F.percentile(value, p).cast("double").alias(out))
    )
    large = flagged.where(F.col("hot_rows").isNotNull()).drop("hot_rows")

    # the sketch is off by at most 1e-5 of the group; two more ranks cover the
    # difference between its rank convention and linear interpolation
    accuracy, margin = 100_000, max(2e-5, 2.0 / hot.limit)
    sketch = F.percentile_approx(value, [max(p - margin, 0.0), min(p + margin, 1.0)], accuracy)
    bracket = large.groupBy(*keys).agg(sketch.alias("_b"), F.count(F.lit(1)).alias("_n"))
    bracket = bracket.select(*keys, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    placed = null_safe_join(large, bracket, keys)
    below = placed.groupBy(*keys).agg(
        F.sum((F.col(value) < F.col("_lo")).cast("long")).alias("_below"), F.first("_n").alias("_n")
    )
    inside = placed.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    inside = null_safe_join(inside, below, keys)
    running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.col("_below") + F.sum("_c").over(running)).withColumn(
        "_pos", (F.col("_n") - 1) * F.lit(p)
    )
    # zero-based ranks covered by a value are [_to - _c, _to - 1]
    start, low, high = F.col("_to") - F.col("_c"), F.floor("_pos"), F.ceil("_pos")
    picked = inside.groupBy(*keys).agg(
        F.max(F.when((start <= low) & (low < F.col("_to")), F.col(value))).alias("_vl"),
        F.max(F.when((start <= high) & (high < F.col("_to")), F.col(value))).alias("_vh"),
        F.first("_pos").alias("_pos"),
    )
    frac = F.col("_pos") - F.floor("_pos")
    exact = F.when(
        F.col("_vl").isNull() | F.col("_vh").isNull(), F.raise_error(F.lit("percentile bracket missed"))
    ).otherwise(F.col("_vl") + frac * (F.col("_vh") - F.col("_vl")))
    return cold.unionByName(picked.select(*keys, exact.cast("double").alias(out)))


def add_group_columns(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], hot: HotGroups | None) -> DataFrame:
    """Adds group aggregates to every row.

    Without hot groups this is a window, so any number of such steps on the same
    keys share one shuffle; with them, each step aggregates and joins back.
    """
    if hot is None:
        whole = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(whole) for n, c in aggs.items()})
    return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys, hot)


def add_group_percentile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, out: str, hot: HotGroups | None
) -> DataFrame:
    """Adds the exact group percentile to every row; null for groups without a value."""
    if hot is None:
        return df.withColumn(out, F.percentile(value, p).over(Window.partitionBy(*keys)).cast("double"))
    return attach(df, group_percentile(df, keys, value, p, out, hot), keys, hot)


def prefix_rank(df: DataFrame, keys: Sequence[str], value: str, weight: str, width: float, out: str) -> DataFrame:
    """Average rank of each distinct value, given one weighted row per value.

    Values are cut into cells of ``width``; the cell totals are summed along the
    axis and only one cell at a time is sorted.
    """
    keys = list(keys)
    cells = df.withColumn("_cell", F.floor(F.col(value) / F.lit(width)).cast("long"))
    totals = cells.groupBy(*keys, "_cell").agg(F.sum(weight).alias("_t"))
    ahead = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_cell", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_to", F.sum(weight).over(within)).join(totals, keys + ["_cell"])
    return ranked.withColumn(out, F.col("_off") + F.col("_to") - (F.col(weight) - 1) / F.lit(2.0)).drop(
        "_cell", "_to", "_off"
    )


def rank_correlation(
    df: DataFrame, keys: Sequence[str], x: str, y: str, out: str, width: float = 1e-3
) -> DataFrame:
    """Spearman correlation per group over any number of rows.

    Equal (x, y) pairs are counted before anything is shuffled by value, ranks
    come from prefix sums, and the correlation is a weighted sum over pairs.
    """
    keys = list(keys)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    by_x = prefix_rank(pairs.groupBy(*keys, "_x").agg(F.sum("_w").alias("_c")), keys, "_x", "_c", width, "_rx")
    by_y = prefix_rank(pairs.groupBy(*keys, "_y").agg(F.sum("_w").alias("_c")), keys, "_y", "_c", width, "_ry")
    ranked = pairs.join(by_x.drop("_c"), keys + ["_x"]).join(by_y.drop("_c"), keys + ["_y"])
    w, rx, ry = F.col("_w").cast("double"), F.col("_rx"), F.col("_ry")
    # centre on the known mean rank (n + 1) / 2 so the sums stay small
    sizes = pairs.groupBy(*keys).agg(((F.sum("_w") + 1) / F.lit(2.0)).alias("_mid"))
    centred = ranked.join(sizes, keys) if keys else ranked
    dx, dy = rx - F.col("_mid"), ry - F.col("_mid")
    sums = centred.groupBy(*keys).agg(
        F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy")
    )
    denom = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    return sums.select(*keys, F.when(denom > 0, F.col("_xy") / denom).otherwise(F.lit(0.0)).alias(out))
