"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.session import tune

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        REGISTRY[name] = Entry(name, run, sql)
        return fn

    return register


# Doubles are shown to six digits.  The cut sits a hair off the half, so a value
# that ends in an exact 5 at the seventh digit goes the same way in any engine.
_NUDGE = 0.5000123


def rounded(c: Column, digits: int = 6) -> Column:
    return F.floor(c.cast("double") * 10.0**digits + F.lit(_NUDGE)) / F.lit(10.0**digits)


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation: doubles to six digits, whole numbers as bigint."""
    cols = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(field.name)
        if kind in ("double", "float"):
            c = rounded(c, digits)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def r6(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded`."""
    return f"(floor(cast({expr} as double) * 1e{digits} + {_NUDGE}) / 1e{digits})"
