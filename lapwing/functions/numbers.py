"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def gap_pct(value: Column, best: Column) -> Column:
    """Percent gap to the best; null unless the best is positive."""
    return F.when(best > 0, (value - best) / best * 100.0)


def position_norm(position: Column, field: Column | int) -> Column:
    """(p - 1) / (n - 1), with a field of one counted as two."""
    n = field if isinstance(field, Column) else F.lit(field)
    return (position - 1.0) / F.greatest(n - 1, F.lit(1))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def mean_of(*cols: Column) -> Column:
    """Row mean over the non-null values."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def rank_where(value: Column, w: WindowSpec) -> Column:
    """Competition rank with nulls left out; the window must order nulls last."""
    return F.when(value.isNotNull(), F.rank().over(w)).cast("long")


def half_even(c: Column, digits: int) -> Column:
    """Banker's rounding, for presentation."""
    return F.bround(c, digits)


def positions_gained(grid: Column, finish: Column) -> Column:
    return F.when((grid > 0) & (finish > 0), grid - finish)


def grid_bucket(position: Column) -> Column:
    """Front row, top five, points zone, midfield, backmarkers."""
    p = F.rint(position)
    return (
        F.when(p <= 2, "front_row")
        .when(p <= 5, "top_5")
        .when(p <= 10, "points_zone")
        .when(p <= 16, "midfield")
        .when(p.isNotNull(), "backmarkers")
    )


def interpret_grid(raw: Column) -> Column:
    """Struct(grid, note): a start slot only when it is a positive whole number."""
    text = F.trim(raw)
    value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    note = (
        F.when(text.isNull() | (text == ""), F.lit("Grid position unrecorded"))
        .when(value > 0, F.concat(F.lit("Grid P"), value.cast("string")))
        .when(value == 0, F.lit("Unclassified / Non-standard Grid Position (0)"))
        .when(value < 0, F.concat(F.lit("Non-standard Grid Position ("), text, F.lit(")")))
        .otherwise(F.concat(F.lit("Non-numeric Grid Position ("), text, F.lit(")")))
    )
    return F.struct(F.when(value > 0, value).alias("grid"), note.alias("note"))


def expected_field(year: Column) -> Column:
    """Field size by era."""
    return (
        F.when(year >= 2026, 22)
        .when(year.between(2017, 2025), 20)
        .when(year.between(2013, 2016), 22)
        .when(year.between(2010, 2012), 24)
        .otherwise(20)
    )


def qualifying_format(year: Column, has_two_runs: Column) -> Column:
    """Struct(format, code) by era."""
    label = (
        F.when(year >= 2006, "Knockout")
        .when((year == 2005) & has_two_runs, "Qualifying Aggregate (QA)")
        .when(year.between(2003, 2005), "Single Lap Shootout (QO/QB)")
        .when(year.between(1994, 2002), "Qualifying Best Lap (QB)")
        .otherwise("Pre-1994 Archive")
    )
    code = F.when(year >= 2006, "Q").when((year == 2005) & has_two_runs, "QA").otherwise("QB")
    return F.struct(label.alias("format"), code.alias("code"))


def event_status(name: Column, date_text: Column, time_text: Column, now: Column) -> Column:
    """Calendar status against a reference instant; a bare date counts until the end of its day."""
    clock = F.when(time_text.contains(":"), F.rtrim(F.trim(time_text), F.lit("Z"))).otherwise(F.lit("23:59:59"))
    at = F.try_to_timestamp(F.concat(F.trim(date_text), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    return (
        F.when(F.lower(name).contains("cancelled"), "Advisory: Likely Cancelled")
        .when(at.isNull(), "Date Unknown")
        .when(at < now, "Scheduled (Past Date)")
        .otherwise("Upcoming")
    )
