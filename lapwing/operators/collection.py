"""Collection runs: plan, anti-join to what has landed, check, stamp, and publish all of a run or nothing.

A run's sessions and its report become visible with one ledger entry.  A run that fails leaves staged files that no reader
looks at; run again under its name it writes over them, and it never collects what has landed meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.names import is_service_vehicle
from lapwing.operators import calendar
from lapwing.operators.quality import keep_first
from lapwing.session import cut_lineage
from lapwing.sources.ledger import Ledger, State

PRACTICE = ("fp1", "fp2", "fp3")
PARTITIONS = ("season", "session")

# Why a session isn't taken.
EMPTY, NO_POSITION, NO_DRIVER, OTHER_ROUND = "Session results table is empty", "No classified positions", "No valid driver", "Round identity mismatch"


@dataclass(frozen=True)
class Run:
    """What a run left: the ledger's state and one row for each planned session."""

    state: State
    report: DataFrame


def competitors(rows: DataFrame) -> DataFrame:
    """Without course cars, where the table names its entrants."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    number = F.col("number") if "number" in rows.columns else F.lit(None).cast("int")
    return rows.where(~F.coalesce(is_service_vehicle(F.col("driver"), have("broadcast_name"), have("full_name"), have("team"), number), F.lit(False)))


def checked_sessions(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted sessions that can be taken, and ``keys, session, reason`` of the others that have rows.

    Practice sessions with any lap time are lap tables, all others (and practice without) result tables.  A session falls as a
    whole if it says to be another round, has no entrant with a name, or, as a result table, has no position.  Of a result
    table's rows for one entrant the best place is kept; laps are kept as they are.  All tests of a session come from one
    aggregate, which is written, so that rows meet their session once.
    """
    keys = [*keys, "session"]
    named = F.coalesce(F.trim("driver"), F.lit("")) != ""
    tests = rows.groupBy(*keys).agg(
        F.max(F.col("lap_s").isNotNull()).alias("_timed"),
        F.max(named).alias("_named"),
        F.max(F.col("position").isNotNull()).alias("_placed"),
        F.max((F.col("event_round") > 0) & (F.col("event_round") != F.col("rnd"))).alias("_other"),
    )
    tests = tests.withColumn("as_laps", F.col("session").isin(*PRACTICE) & F.col("_timed"))
    reason = (
        F.when(F.coalesce("_other", F.lit(False)), OTHER_ROUND)
        .when(~F.col("_placed") & ~F.col("as_laps"), NO_POSITION)
        .when(~F.col("_named"), NO_DRIVER)
    )
    tests = cut_lineage(tests.select(*keys, "as_laps", reason.alias("reason")).join(wanted.select(*keys), keys, "left_semi"))  # a row a session
    good = rows.join(tests.where(F.col("reason").isNull()).drop("reason"), keys).where(named)
    results = keep_first(good.where(~F.col("as_laps")), [*keys, "driver"], [F.col("position").isNull(), F.col("position")])
    failed = tests.where(F.col("reason").isNotNull()).select(*keys, "reason")
    return results.unionByName(good.where("as_laps")).drop("as_laps", "event_round"), failed


def collect(
    ledger: Ledger,
    run: str,
    events: DataFrame,
    plan: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    now: Column,
    mode: str = "full",
    source: str = "archive",
) -> Run:
    """Collects the planned sessions of ``events`` that haven't landed from ``incoming``, and publishes them as one run.

    ``events`` has keys, event_name, location, country, a format and a schedule; ``incoming`` has keys, session, driver,
    position, lap_s, event_round and any other columns.  A session counts as tried with the reason it failed for; the status
    of what wasn't taken follows from the schedule and that reason.
    """
    keys = list(keys)
    state = ledger.state()
    landed = ledger.table(state)
    about = [c for c in ("event_name", "location", "country") if c in events.columns]
    planned = calendar.plan_sessions(events, plan, mode).select(*keys, "session", *about)
    at = calendar.session_schedule(events, keys)
    # a row a session, read for what to take, the stamps and the report: written once
    planned = cut_lineage(planned.join(at, [*keys, "session"], "left"))
    if landed is None:
        wanted, have = planned, planned.limit(0).select(*keys, "session")
    else:
        have = landed.select(*keys, "session").distinct()
        wanted = calendar.to_collect(planned, have, keys)
    good, failed = checked_sessions(competitors(incoming), wanted, keys)
    stamped = good.join(wanted, [*keys, "session"]).withColumnRenamed("scheduled_ts", "session_date")
    # read for the table and for the report: written once, with the run's time as a value
    taken = cut_lineage(stamped.withColumns({"data_source": F.lit(source), "collected_at": now, "run": F.lit(run)}))
    folder = ledger.stage(taken, run, PARTITIONS)
    counts = taken.groupBy(*keys, "session").agg(F.count("*").alias("records"))
    tried = wanted.join(failed, [*keys, "session"], "left").withColumn("last_error", F.coalesce("reason", F.lit(EMPTY)))
    status = calendar.collection_status(tried, counts, keys, now).join(counts, [*keys, "session"], "left")
    status = status.select(*keys, "session", "status", F.when(F.col("status") != "SUCCESS", F.col("last_error")).alias("detail"), F.coalesce("records", F.lit(0)).alias("records"))
    skipped = planned.join(have, [*keys, "session"], "left_semi").select(*keys, "session", F.lit("SKIPPED").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("records"))
    status.unionByName(skipped).write.mode("overwrite").parquet(f"{ledger.path}/reports/run={run}")
    return Run(ledger.publish(state, taken, [folder]), reports(ledger, [run]))


def reports(ledger: Ledger, runs: Sequence[str] | None = None) -> DataFrame | None:
    """The reports of published runs, or of some of them; None before the first."""
    published = [f.split("=", 1)[1] for f in ledger.state().folders]
    wanted = [r for r in published if runs is None or r in runs]
    if not wanted:
        return None
    return ledger.spark.read.option("basePath", f"{ledger.path}/reports").parquet(*[f"{ledger.path}/reports/run={r}" for r in wanted])
