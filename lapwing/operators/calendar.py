"""Calendars, session plans, collection status, season discovery and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.functions.names import session_name
from lapwing.functions.status import count_if

DETAILED_FROM = 2018
PENDING_HOURS = 48

# Sessions of each weekend format by collection mode.
SESSION_PLAN = {
    ("sprint", "full"): ("fp1", "sprint_qualifying", "sprint_race", "qualifying", "race"),
    ("sprint", "prediction_only"): ("sprint_qualifying", "sprint_race", "qualifying", "race"),
    ("sprint", "practice_only"): ("fp1",),
    ("standard", "full"): ("fp1", "fp2", "fp3", "qualifying", "race"),
    ("standard", "prediction_only"): ("qualifying", "race"),
    ("standard", "practice_only"): ("fp1", "fp2", "fp3"),
}
# Sessions a forecast at each stage must have.
STAGE_REQUIRES = {
    "pre_fp1": (),
    "after_fp1": ("fp1",),
    "after_fp2": ("fp1", "fp2"),
    "after_fp3": ("fp1", "fp2", "fp3"),
    "after_sprint_qualifying": ("fp1", "sprint_qualifying"),
    "after_sprint_race": ("fp1", "sprint_qualifying", "sprint_race"),
    "after_qualifying": ("qualifying",),
    "post_race": ("qualifying", "race"),
}
# Sessions that have run at each stage, by weekend format; a stage a format doesn't name is invalid for it.
WEEKEND_STAGES = {
    "standard": {
        "pre_fp1": (), "after_fp1": ("fp1",), "after_fp2": ("fp1", "fp2"), "after_fp3": ("fp1", "fp2", "fp3"),
        "after_qualifying": ("fp1", "fp2", "fp3", "qualifying"), "before_race": ("fp1", "fp2", "fp3", "qualifying"),
        "post_race": ("fp1", "fp2", "fp3", "qualifying", "race"),
    },
    "sprint": {
        "pre_fp1": (), "after_fp1": ("fp1",), "after_sprint_qualifying": ("fp1", "sprint_qualifying"),
        "after_sprint_race": ("fp1", "sprint_qualifying", "sprint_race"),
        "after_qualifying": ("fp1", "sprint_qualifying", "sprint_race", "qualifying"),
        "before_race": ("fp1", "sprint_qualifying", "sprint_race", "qualifying"),
        "post_race": ("fp1", "sprint_qualifying", "sprint_race", "qualifying", "race"),
    },
}
STAGE_ALIASES = {"after_sprint": "after_sprint_race"}
# Error texts that mean the source simply has nothing.
GAP_WORDS = ("not available", "empty", "archive", "not found", "zero drivers", "missing information")


def _dimension(spark: SparkSession, table: dict, columns: Sequence[str]) -> DataFrame:
    rows = []
    for key, sessions in table.items():
        head = key if isinstance(key, tuple) else (key,)
        rows += [(*head, s) for s in sessions]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def session_plan(spark: SparkSession) -> DataFrame:
    return _dimension(spark, SESSION_PLAN, ["format", "mode", "session"])


def stage_requirements(spark: SparkSession) -> DataFrame:
    return _dimension(spark, STAGE_REQUIRES, ["stage", "session"])


def _weekend_format(sprint: Column) -> Column:
    return F.when(F.coalesce(sprint, F.lit(False)), "sprint").otherwise("standard")


def _canonical_stage(stage: Column) -> Column:
    out = F.lower(F.trim(F.coalesce(stage, F.lit("after_qualifying"))))
    for alias, name in STAGE_ALIASES.items():
        out = F.when(out == alias, name).otherwise(out)
    return out


def stage_errors(targets: DataFrame) -> DataFrame:
    """The targets whose ``stage`` isn't one of their weekend's (``is_sprint``), with ``error``: unknown or invalid for the format."""
    stage, fmt = _canonical_stage(F.col("stage")), _weekend_format(F.col("is_sprint"))
    known = sorted({s for own in WEEKEND_STAGES.values() for s in own})
    valid = F.lit(False)
    for name, own in WEEKEND_STAGES.items():
        valid = valid | ((fmt == name) & stage.isin(*own))
    error = F.when(~stage.isin(*known), "unknown stage").otherwise(F.concat(F.lit("stage is invalid for a "), fmt, F.lit(" weekend")))
    return targets.where(~valid).withColumn("error", error)


def weekend_sessions(sessions: DataFrame, targets: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Session rows that a forecast of each target may see: those its weekend's format has run by its ``stage``.

    ``targets`` has keys, stage and is_sprint.  A stage that isn't one of the weekend's fails the job, or with ``strict`` off
    sees nothing; :func:`stage_errors` lists such targets.
    """
    rows = [(f, st, s) for f, own in WEEKEND_STAGES.items() for st, run in own.items() for s in run]
    plan = targets.sparkSession.createDataFrame(rows, "_format string, _stage string, session string")
    wanted = targets.withColumn("_format", _weekend_format(F.col("is_sprint"))).withColumn("_stage", _canonical_stage(F.col("stage")))
    if strict:
        pairs = [F.lit(f"{f}/{st}") for f, own in WEEKEND_STAGES.items() for st in own]
        pair = F.concat_ws("/", "_format", "_stage")
        fails = F.raise_error(F.concat(F.lit("stage is invalid for its weekend: "), pair)).cast("string")
        wanted = wanted.withColumn("_stage", F.when(F.array_contains(F.array(*pairs), pair), F.col("_stage")).otherwise(fails))
    allowed = wanted.join(plan, ["_format", "_stage"]).select(*keys, "stage", "session")
    return sessions.join(allowed, [*keys, "session"])


def practice_and_sprint(sessions: DataFrame, sprint_rounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Practice and sprint sessions as each weekend's format has them: one practice and the sprint's two, or three practices."""
    marked = sessions.join(sprint_rounds.select(*keys).distinct().withColumn("_sprint", F.lit(True)), list(keys), "left")
    sprint = F.coalesce("_sprint", F.lit(False))
    fits = F.when(sprint, F.col("session").isin("fp1", "sprint_qualifying", "sprint_race")).otherwise(F.col("session").isin("fp1", "fp2", "fp3"))
    return marked.where(fits).drop("_sprint")


def is_sprint_format(fmt: Column, sessions: Column) -> Column:
    """Sprint weekend: the format or any session name says so."""
    named = F.exists(sessions, lambda s: F.lower(s).contains("sprint"))
    return F.coalesce(F.lower(fmt).contains("sprint"), F.lit(False)) | F.coalesce(named, F.lit(False))


def plan_sessions(events: DataFrame, plan: DataFrame, mode: str) -> DataFrame:
    """One row per event and planned session."""
    fmt = F.when(is_sprint_format(F.col("event_format"), F.col("session_names")), "sprint").otherwise("standard")
    wanted = plan.where(F.col("mode") == mode).select("format", "session")
    return events.withColumn("format", fmt).join(wanted, "format")


def session_slug(name: Column) -> Column:
    """Slug of a schedule entry, tolerant of its wording."""
    n = F.lower(F.trim(name))
    squeezed = F.translate(n, " ", "")
    sprint = n.contains("sprint")
    by_words = (
        F.when(sprint & (n.contains("shootout") | n.contains("quali")), "sprint_qualifying")
        .when(sprint, "sprint_race")
        .when(n.contains("quali"), "qualifying")
        .when(n.contains("race") | (n == "r"), "race")
    )
    for p in ("fp1", "fp2", "fp3"):
        by_words = by_words.when(squeezed.contains(p), p)
    return F.coalesce(by_words, session_name(name))


def session_schedule(events: DataFrame, keys: Sequence[str], slots: int = 5) -> DataFrame:
    """Unpivots session1..n with their dates to (event, session, scheduled_ts); a race without a slot
    falls back to the event date."""
    entries = F.array(
        *[F.struct(F.col(f"session{i}").alias("name"), F.col(f"session{i}_utc").alias("ts")) for i in range(1, slots + 1)]
    )
    rows = events.select(*keys, "event_date", F.explode(entries).alias("s"))
    rows = rows.where(F.coalesce(F.trim("s.name"), F.lit("")) != "")
    slugged = rows.select(*keys, session_slug(F.col("s.name")).alias("session"), F.col("s.ts").alias("ts"))
    found = slugged.groupBy(*keys, "session").agg(F.min("ts").alias("scheduled_ts"))
    main = events.select(*keys, F.lit("race").alias("session"), F.col("event_date").alias("_fallback"))
    both = found.join(main, [*keys, "session"], "full_outer")
    return both.select(*keys, "session", F.coalesce("scheduled_ts", F.col("_fallback").cast("timestamp")).alias("scheduled_ts"))


def session_map(events: DataFrame, keys: Sequence[str], slots: int = 5) -> DataFrame:
    """Calendar row per event: sessions as a map of slug to time, sprint flag; rounds below one are dropped."""
    names = F.array_compact(F.array(*[F.col(f"session{i}") for i in range(1, slots + 1)]))
    pairs = F.array(
        *[
            F.struct(session_slug(F.col(f"session{i}")).alias("k"), F.col(f"session{i}_utc").alias("v"))
            for i in range(1, slots + 1)
        ]
    )
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & (p["k"] != ""))
    return events.where(F.col("rnd") > 0).select(
        *keys, "event_name", F.map_from_entries(kept).alias("sessions"), is_sprint_format(F.col("event_format"), names).alias("is_sprint")
    )


def collection_status(plan: DataFrame, landed: DataFrame, keys: Sequence[str], now: Column) -> DataFrame:
    """Status of every planned session; what is already landed is never collected again.

    ``plan`` has (keys, session, scheduled_ts, last_error); ``landed`` has one or
    more rows per landed (keys, session).
    """
    keys = [*keys, "session"]
    have = landed.select(*keys).distinct().withColumn("_have", F.lit(True))
    ts, err = F.col("scheduled_ts"), F.lower(F.col("last_error"))
    gap = err.isNull() | (err == "") | err.rlike("|".join(GAP_WORDS))
    status = (
        F.when(F.col("_have"), "SUCCESS")
        .when(ts > now, "FUTURE_SESSION")
        .when(ts > now - F.expr(f"INTERVAL {PENDING_HOURS} HOURS"), "NOT_YET_AVAILABLE")
        .when(gap, "DATA_MISSING")
        .otherwise("COLLECTION_FAILED")
    )
    return plan.join(have, keys, "left").withColumn("status", status).drop("_have")


STATUSES = ("SUCCESS", "FUTURE_SESSION", "NOT_YET_AVAILABLE", "DATA_MISSING", "COLLECTION_FAILED")


def collection_scorecard(statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per status, one row per event."""
    return statuses.groupBy(*keys).agg(*[count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def to_collect(plan: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned sessions that have not been landed yet."""
    return plan.join(landed.select(*keys, "session").distinct(), [*keys, "session"], "left_anti")


def season_status(landed: DataFrame, scope: Sequence[str], workflow: str = "prediction") -> DataFrame:
    """Per season: rounds with race and qualifying rows, kind of source, usable flag and file counts.

    ``landed`` has (scope, season, rnd, session, n_rows), one row per file.
    """
    scope = [*scope, "season"]
    filled = F.col("n_rows") > 0
    rounds = landed.groupBy(*scope, "rnd").agg(
        F.count(F.lit(1)).alias("_files"),
        count_if(filled).alias("_valid"),
        F.max((filled & (F.col("session") == "race")).cast("int")).alias("_race"),
        F.max((filled & (F.col("session") == "qualifying")).cast("int")).alias("_quali"),
    )
    out = rounds.groupBy(*scope).agg(
        F.sum("_files").alias("total_files"),
        F.sum("_valid").alias("valid_files"),
        count_if((F.col("_race") == 1) & (F.col("_quali") == 1)).alias("completed_rounds"),
    )
    detailed = F.col("season") >= DETAILED_FROM
    some = F.col("completed_rounds") >= 1
    source = F.when(F.col("valid_files") == 0, "incomplete").when(~detailed, "results_only").when(some, "fastf1_detailed").otherwise("incomplete")
    return out.withColumn("source_type", source).withColumn("usable", (some & detailed) if workflow == "prediction" else some)


def season_islands(seasons: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Runs of consecutive seasons: (scope, first, last)."""
    w = Window.partitionBy(*scope).orderBy("season")
    marked = seasons.select(*scope, "season").distinct().withColumn("_i", F.col("season") - F.row_number().over(w))
    return marked.groupBy(*scope, "_i").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season")).drop("_i")


def season_ranges(seasons: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Range text per scope ("2018–2021, 2023"), contiguity flag, and the plain list form."""
    runs = season_islands(seasons, scope)
    one = F.col("first_season") == F.col("last_season")
    text = F.when(one, F.col("first_season").cast("string")).otherwise(
        F.concat(F.col("first_season").cast("string"), F.lit("–"), F.col("last_season").cast("string"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_season", text.alias("t"))))
    years = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_season", "last_season"))), lambda r: F.sequence(r["first_season"], r["last_season"])))
    out = runs.groupBy(*scope).agg(
        F.array_join(F.transform(ordered, lambda r: r["t"]), ", ").alias("ranges"),
        F.count(F.lit(1)).alias("_runs"),
        F.array_join(F.transform(years, lambda y: y.cast("string")), ", ").alias("_list"),
    )
    contiguous = F.col("_runs") == 1
    return out.select(
        *scope, "ranges", contiguous.alias("is_contiguous"), F.when(contiguous, F.col("ranges")).otherwise(F.col("_list")).alias("available")
    )


def default_season(seasons: DataFrame, scope: Sequence[str], preferred: int) -> DataFrame:
    """The preferred season where present, else the latest."""
    has = F.max(F.when(F.col("season") == preferred, F.lit(preferred)))
    return seasons.groupBy(*scope).agg(F.coalesce(has, F.max("season")).cast("long").alias("default_season"))


def coverage_matrix(landed: DataFrame, keys: Sequence[str], sessions: Sequence[str]) -> DataFrame:
    """Files per session, one column each."""
    out = landed.groupBy(*keys).pivot("session", list(sessions)).agg(F.count(F.lit(1)))
    return out.fillna(0, list(sessions))


def sprint_flag(rounds: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sprint weekend: the calendar's word, else a landed sprint session, else the configured flag.

    ``rounds`` has nullable calendar_sprint and configured_sprint; a round with
    any landed session is settled by the sessions.
    """
    seen = landed.groupBy(*keys).agg(F.bool_or(F.col("session").startswith("sprint")).alias("_seen"))
    return rounds.join(seen, list(keys), "left").withColumn(
        "is_sprint", F.coalesce("calendar_sprint", "_seen", "configured_sprint", F.lit(False))
    ).drop("_seen")


def readiness(targets: DataFrame, landed: DataFrame, requirements: DataFrame, scope: Sequence[str], min_rounds: int = 3) -> DataFrame:
    """BLOCKED, EXPERIMENTAL or VALIDATED per (scope, season, rnd, stage).

    Needs at least one earlier round with a race and every session the stage requires.
    """
    scope = [*scope, "season"]
    races = landed.where(F.col("session") == "race").select(*scope, "rnd").distinct().withColumn("_raced", F.lit(1))
    rounds = targets.select(*scope, "rnd").distinct()
    steps = rounds.join(races, [*scope, "rnd"], "full_outer")
    before = Window.partitionBy(*scope).orderBy("rnd").rowsBetween(Window.unboundedPreceding, -1)
    prior = steps.withColumn("completed_rounds", F.coalesce(F.sum("_raced").over(before), F.lit(0))).drop("_raced")
    have = landed.select(*scope, "rnd", "session").distinct().withColumn("_have", F.lit(1))
    needed = targets.join(requirements, "stage").join(have, [*scope, "rnd", "session"], "left")
    missing = needed.groupBy(*scope, "rnd", "stage").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_have").isNull(), F.col("session")))), ",").alias("missing")
    )
    rows = targets.join(prior, [*scope, "rnd"], "left").join(missing, [*scope, "rnd", "stage"], "left")
    rows = rows.withColumn("missing", F.coalesce("missing", F.lit("")))
    blocked = (F.col("missing") != "") | (F.col("completed_rounds") == 0)
    return rows.withColumn(
        "classification",
        F.when(blocked, "BLOCKED").when(F.col("completed_rounds") < min_rounds, "EXPERIMENTAL").otherwise("VALIDATED"),
    )


def next_round(explicit: Column, supplied: Column, configured: Column) -> Column:
    """Round resolution: the explicit argument, then the supplied map, then the configuration."""
    return F.coalesce(explicit, supplied, configured)
