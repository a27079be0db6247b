"""Lap-time text and number handling as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "no time".
NULL_WORDS = ("nan", "none", "nat", "dnf", "dns", "dq")
GRID_NULL_WORDS = ("nan", "nat", "none")

_DURATION = r"^(-?\d+) days? (?:([+-]?\d+):)(\d+):(\d+(?:\.\d+)?)$"
_CLOCK = r"(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)"


def _num(c: Column) -> Column:
    return c.try_cast("double")


def number(c: Column) -> Column:
    """Numeric text to double, null when it does not parse or is NaN."""
    value = _num(F.trim(c.cast("string")))
    return F.when(~F.isnan(value), value)


def _hms(text: Column, pattern: str) -> Column:
    hours = F.coalesce(_num(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))), F.lit(0.0))
    minutes = _num(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")))
    seconds = _num(F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")))
    return hours * 3600 + minutes * 60 + seconds


def seconds(text: Column) -> Column:
    """Duration text, ``[H:]M:S.f`` or plain seconds to double; null unless positive."""
    t = F.trim(text)
    duration = (
        _num(F.nullif(F.regexp_extract(t, _DURATION, 1), F.lit(""))) * 86400
        + _num(F.nullif(F.regexp_extract(t, _DURATION, 2), F.lit(""))) * 3600
        + _num(F.nullif(F.regexp_extract(t, _DURATION, 3), F.lit(""))) * 60
        + _num(F.nullif(F.regexp_extract(t, _DURATION, 4), F.lit("")))
    )
    clock = F.when(t.contains(":"), _hms(t, _CLOCK))
    value = F.coalesce(duration, clock, number(t))
    return F.when(F.lower(t).isin(*NULL_WORDS) | (t == ""), F.lit(None)).when(value > 0, value)


def seconds_of_number(c: Column) -> Column:
    """Numeric lap time: positive values only."""
    return F.when((c > 0) & ~F.isnan(c.cast("double")), c.cast("double"))


def tie_break_seconds(text: Column) -> Column:
    """Lap time used to break grid ties: two or three colon parts, or plain seconds."""
    t = F.trim(text)
    parts = F.split(t, ":")
    two = _num(F.get(parts, F.lit(0))) * 60 + _num(F.get(parts, F.lit(1)))
    three = (
        _num(F.get(parts, F.lit(0))) * 3600 + _num(F.get(parts, F.lit(1))) * 60 + _num(F.get(parts, F.lit(2)))
    )
    plain = F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three).when(F.size(parts) == 1, number(t))
    long_form = F.when(t.contains("day"), seconds(t))
    return F.when(F.lower(t).isin(*GRID_NULL_WORDS) | (t == ""), F.lit(None)).otherwise(F.coalesce(long_form, plain))


def best_for_tie_break(*texts: Column) -> Column:
    """First positive time among Q3, Q2, Q1 and any stand-ins; infinity when there is none."""
    usable = [F.when(tie_break_seconds(t) > 0, tie_break_seconds(t)) for t in texts]
    return F.coalesce(*usable, F.lit(float("inf")))


def lap_text(secs: Column, default: str = "No Time") -> Column:
    """Seconds to ``m:ss.mmm``."""
    minutes = F.floor(secs / 60).cast("int")
    rest = secs - minutes * 60
    return F.when(secs > 0, F.format_string("%d:%06.3f", minutes, rest)).otherwise(F.lit(default))


def millis(text: Column) -> Column:
    """``m:ss.mmm`` or plain seconds to whole milliseconds."""
    t = F.trim(text)
    parts = F.split(t, ":")
    clock = _num(F.get(parts, F.lit(0))) * 60 + _num(F.get(parts, F.lit(1)))
    secs = F.when(t.contains(":"), clock).otherwise(number(t))
    return F.rint(secs * 1000).cast("long")


def gap_text(leader: Column, own: Column) -> Column:
    """``+s.mmm`` behind the leader; null when a time is missing or the gap is negative."""
    delta = millis(own) - millis(leader)
    return F.when(delta >= 0, F.format_string("+%.3f", delta / F.lit(1000.0)))
