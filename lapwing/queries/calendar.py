"""Calendars, discovery, coverage and collection over the order book.

Sixty consecutive customers form a calendar ``scope``; an order is a landed
file, its month a round and its priority a session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import calendar
from lapwing.queries.registry import query, shown
from lapwing.sources import star

SCOPE = ["scope"]

LANDED = """
landed AS (
  SELECT o_custkey // 60 AS scope, year(o_orderdate) + 20 AS season, month(o_orderdate) AS rnd,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'race' WHEN '2-HIGH' THEN 'qualifying' WHEN '3-MEDIUM' THEN 'fp1'
      WHEN '5-LOW' THEN 'fp3' ELSE 'fp2' END AS session,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 20 END AS n_rows, o_orderdate, o_orderkey FROM orders)"""


def landed_files(spark, sf):
    o = star.table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    session = (
        F.when(p == "1-URGENT", "race").when(p == "2-HIGH", "qualifying").when(p == "3-MEDIUM", "fp1").when(p == "5-LOW", "fp3").otherwise("fp2")
    )
    return o.select(
        F.floor(F.col("o_custkey") / 60).cast("long").alias("scope"),
        (F.year("o_orderdate") + 20).cast("long").alias("season"),
        F.month("o_orderdate").cast("long").alias("rnd"),
        session.alias("session"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(20).alias("n_rows"),
        F.col("o_orderdate"),
        F.col("o_orderkey"),
    )


@query(
    "season_discovery",
    f"""WITH {LANDED}, r AS (SELECT scope, season, rnd, count(*) AS f, count(*) FILTER (n_rows > 0) AS v,
    bool_or(n_rows > 0 AND session = 'race') AND bool_or(n_rows > 0 AND session = 'qualifying') AS done FROM landed GROUP BY ALL),
s AS (SELECT scope, season, cast(sum(f) AS bigint) AS total_files, cast(sum(v) AS bigint) AS valid_files, count(*) FILTER (done) AS completed_rounds FROM r GROUP BY ALL)
SELECT *, CASE WHEN valid_files = 0 THEN 'incomplete' WHEN season < 2018 THEN 'results_only' WHEN completed_rounds > 0 THEN 'fastf1_detailed' ELSE 'incomplete' END AS source_type,
  completed_rounds > 0 AND season >= 2018 AS usable FROM s""",
)
def season_discovery(spark, sf):
    return shown(calendar.season_status(landed_files(spark, sf), SCOPE))


@query(
    "season_gaps",
    """WITH y AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS season FROM orders),
i AS (SELECT entity, season, season - row_number() OVER (PARTITION BY entity ORDER BY season) AS g FROM y)
SELECT entity, min(season) AS first_season, max(season) AS last_season FROM i GROUP BY entity, g""",
)
def season_gaps(spark, sf):
    o = star.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("season"))
    return shown(calendar.season_islands(o.distinct(), ["entity"]))


@query(
    "season_ranges",
    """WITH y AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS season FROM orders),
i AS (SELECT entity, season, season - row_number() OVER (PARTITION BY entity ORDER BY season) AS g FROM y),
r AS (SELECT entity, min(season) AS a, max(season) AS b FROM i GROUP BY entity, g),
t AS (SELECT entity, string_agg(CASE WHEN a = b THEN cast(a AS varchar) ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges, count(*) = 1 AS is_contiguous FROM r GROUP BY entity),
l AS (SELECT entity, string_agg(cast(season AS varchar), ', ' ORDER BY season) AS li, CASE WHEN bool_or(season = 1998) THEN 1998 ELSE max(season) END AS default_season FROM y GROUP BY entity)
SELECT entity, ranges, is_contiguous, CASE WHEN is_contiguous THEN ranges ELSE li END AS available, default_season FROM t JOIN l USING (entity)""",
)
def season_ranges(spark, sf):
    o = star.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("season")).distinct()
    out = calendar.season_ranges(o, ["entity"]).join(calendar.default_season(o, ["entity"], 1998), "entity")
    return shown(out)


ALL_SESSIONS = ["fp1", "fp2", "fp3", "qualifying", "race"]


@query(
    "coverage_matrix",
    f"""WITH {LANDED} SELECT scope, season, rnd, {", ".join(f"count(*) FILTER (session = '{s}') AS {s}" for s in ALL_SESSIONS)} FROM landed GROUP BY ALL""",
)
def coverage_matrix(spark, sf):
    return shown(calendar.coverage_matrix(landed_files(spark, sf), ["scope", "season", "rnd"], ALL_SESSIONS))


STAGES = ["pre_fp1", "after_fp1", "after_fp2", "after_fp3", "after_qualifying", "post_race"]


@query(
    "readiness",
    f"""WITH {LANDED}, t AS (SELECT DISTINCT scope, season, rnd, stage FROM landed, unnest({STAGES}) u(stage)),
have AS (SELECT DISTINCT scope, season, rnd, session FROM landed),
req AS (SELECT * FROM (VALUES ('after_fp1', 'fp1'), ('after_fp2', 'fp1'), ('after_fp2', 'fp2'), ('after_fp3', 'fp1'), ('after_fp3', 'fp2'), ('after_fp3', 'fp3'),
   ('after_qualifying', 'qualifying'), ('post_race', 'qualifying'), ('post_race', 'race')) v(stage, session)),
miss AS (SELECT t.scope, t.season, t.rnd, t.stage, string_agg(req.session, ',' ORDER BY req.session) AS missing FROM t JOIN req USING (stage)
   LEFT JOIN have h ON h.scope = t.scope AND h.season = t.season AND h.rnd = t.rnd AND h.session = req.session WHERE h.session IS NULL GROUP BY ALL),
races AS (SELECT scope, season, rnd FROM have WHERE session = 'race'),
prior AS (SELECT t.scope, t.season, t.rnd, t.stage, count(races.rnd) AS completed_rounds FROM t
   LEFT JOIN races ON races.scope = t.scope AND races.season = t.season AND races.rnd < t.rnd GROUP BY ALL)
SELECT scope, season, rnd, stage, completed_rounds, coalesce(missing, '') AS missing,
  CASE WHEN missing IS NOT NULL OR completed_rounds = 0 THEN 'BLOCKED' WHEN completed_rounds < 3 THEN 'EXPERIMENTAL' ELSE 'VALIDATED' END AS classification
FROM prior LEFT JOIN miss USING (scope, season, rnd, stage)""",
)
def readiness(spark, sf):
    files = landed_files(spark, sf)
    targets = files.select("scope", "season", "rnd").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    return shown(calendar.readiness(targets, files, calendar.stage_requirements(spark), SCOPE))


EVENTS = """
ev AS (
  SELECT o_custkey // 60 AS scope, year(o_orderdate) + 20 AS season, month(o_orderdate) AS rnd, min(o_orderdate) AS d,
    month(o_orderdate) % 4 = 2 AS sprint FROM orders GROUP BY ALL),
sched AS (
  SELECT scope, season, rnd, sprint, s.n AS session, d + INTERVAL (s.h) HOUR AS scheduled_ts FROM ev,
    LATERAL (SELECT unnest(CASE WHEN sprint THEN
       [{'n': 'fp1', 'h': 8}, {'n': 'sprint_qualifying', 'h': 12}, {'n': 'sprint_race', 'h': 32}, {'n': 'qualifying', 'h': 36}, {'n': 'race', 'h': 60}]
       ELSE [{'n': 'fp1', 'h': 8}, {'n': 'fp2', 'h': 12}, {'n': 'fp3', 'h': 32}, {'n': 'qualifying', 'h': 36}, {'n': 'race', 'h': 60}] END) AS s))"""


def calendar_events(spark, sf):
    ev = (
        star.table(spark, sf, "orders")
        .groupBy(
            F.floor(F.col("o_custkey") / 60).cast("long").alias("scope"),
            (F.year("o_orderdate") + 20).cast("long").alias("season"),
            F.month("o_orderdate").cast("long").alias("rnd"),
        )
        .agg(F.min("o_orderdate").cast("timestamp").alias("event_date"))
    )
    sprint = F.col("rnd") % 4 == 2
    normal = ["Practice 1", "FP2", "Free Practice 3", "Qualifying", "Race"]
    special = ["FP 1", "Sprint Shootout", "Sprint", "Quali", "Grand Prix Race"]
    hours = [8, 12, 32, 36, 60]
    cols = {f"session{i}": F.when(sprint, special[i - 1]).otherwise(normal[i - 1]) for i in range(1, 6)}
    cols |= {f"session{i}_utc": F.col("event_date") + F.expr(f"INTERVAL {hours[i - 1]} HOURS") for i in range(1, 6)}
    cols |= {
        "event_format": F.when(sprint, "sprint_shootout").otherwise("conventional"),
        "event_name": F.concat(F.lit("Round "), F.col("rnd").cast("string")),
    }
    ev = ev.withColumns(cols)
    return ev.withColumn("session_names", F.array(*[F.col(f"session{i}") for i in range(1, 6)]))


@query(
    "session_schedule",
    f"""WITH {EVENTS} SELECT scope, season, rnd, session, strftime(scheduled_ts, '%Y-%m-%d %H:%M') AS scheduled FROM sched""",
)
def session_schedule(spark, sf):
    out = calendar.session_schedule(calendar_events(spark, sf), ["scope", "season", "rnd"])
    return out.select("scope", "season", "rnd", "session", F.date_format("scheduled_ts", "yyyy-MM-dd HH:mm").alias("scheduled"))


@query(
    "calendar_sessions",
    f"""WITH {EVENTS} SELECT scope, season, rnd, sprint AS is_sprint, cast(5 AS bigint) AS n_sessions,
  max(CASE WHEN session = 'race' THEN strftime(scheduled_ts, '%Y-%m-%d %H:%M') END) AS race_at,
  max(CASE WHEN session = 'sprint_race' THEN strftime(scheduled_ts, '%Y-%m-%d %H:%M') END) AS sprint_at FROM sched GROUP BY ALL""",
)
def calendar_sessions(spark, sf):
    out = calendar.session_map(calendar_events(spark, sf), ["scope", "season", "rnd"])
    at = lambda s: F.date_format(F.try_element_at("sessions", F.lit(s)), "yyyy-MM-dd HH:mm")
    return shown(out.select("scope", "season", "rnd", "is_sprint", F.size("sessions").alias("n_sessions"), at("race").alias("race_at"), at("sprint_race").alias("sprint_at")))


ERRORS = ["NULL", "'Session not found'", "'ValueError: bad token'", "''"]

_STATUS_SQL = f"""WITH {LANDED}, {EVENTS},
have AS (SELECT DISTINCT scope, season, rnd, session FROM landed WHERE n_rows > 0),
st AS (SELECT s.*, CASE WHEN h.session IS NOT NULL THEN 'SUCCESS' WHEN scheduled_ts > TIMESTAMP '2019-06-10 12:00:00' THEN 'FUTURE_SESSION'
    WHEN scheduled_ts > TIMESTAMP '2019-06-08 12:00:00' THEN 'NOT_YET_AVAILABLE'
    WHEN (scope + s.rnd) % 4 = 2 THEN 'COLLECTION_FAILED' ELSE 'DATA_MISSING' END AS status
  FROM sched s LEFT JOIN have h USING (scope, season, rnd, session))"""


def _statuses(spark, sf):
    events = calendar_events(spark, sf)
    keys = ["scope", "season", "rnd"]
    plan = calendar.plan_sessions(events, calendar.session_plan(spark), "full").select(*keys, "session")
    at = calendar.session_schedule(events, keys)
    code = (F.col("scope") + F.col("rnd")) % 4
    err = F.when(code == 1, "Session not found").when(code == 2, "ValueError: bad token").when(code == 3, "")
    plan = plan.join(at, [*keys, "session"], "left").withColumn("last_error", err)
    files = landed_files(spark, sf).where(F.col("n_rows") > 0)
    return calendar.collection_status(plan, files, keys, F.lit("2019-06-10 12:00:00").cast("timestamp"))


@query("collection_status", _STATUS_SQL + " SELECT season, rnd, session, status, count(*) AS n FROM st GROUP BY ALL")
def collection_status(spark, sf):
    return _statuses(spark, sf).groupBy("season", "rnd", "session", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "collection_scorecard",
    _STATUS_SQL
    + " SELECT scope, season, rnd, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in calendar.STATUSES)
    + " FROM st GROUP BY ALL",
)
def collection_scorecard(spark, sf):
    return calendar.collection_scorecard(_statuses(spark, sf), ["scope", "season", "rnd"])


@query(
    "sessions_to_collect",
    f"""WITH {LANDED}, {EVENTS}, have AS (SELECT DISTINCT scope, season, rnd, session FROM landed)
SELECT scope, season, rnd, session FROM sched s WHERE session IN ('sprint_qualifying', 'sprint_race', 'qualifying', 'race')
  AND NOT EXISTS (SELECT 1 FROM have h WHERE h.scope = s.scope AND h.season = s.season AND h.rnd = s.rnd AND h.session = s.session)""",
)
def sessions_to_collect(spark, sf):
    keys = ["scope", "season", "rnd"]
    plan = calendar.plan_sessions(calendar_events(spark, sf), calendar.session_plan(spark), "prediction_only")
    return calendar.to_collect(plan.select(*keys, "session"), landed_files(spark, sf), keys)


@query(
    "sprint_rounds",
    f"""WITH {LANDED}, r AS (SELECT scope, season, rnd, bool_or(session = 'fp1' AND n_rows = 0) AS sp FROM landed GROUP BY ALL)
SELECT scope, season, rnd, CASE WHEN season = 2015 THEN rnd % 4 = 2 ELSE sp END AS is_sprint FROM r""",
)
def sprint_rounds(spark, sf):
    keys = ["scope", "season", "rnd"]
    files = landed_files(spark, sf)
    label = F.when((F.col("session") == "fp1") & (F.col("n_rows") == 0), "sprint_race").otherwise(F.col("session"))
    rounds = files.select(*keys).distinct().withColumn("calendar_sprint", F.when(F.col("season") == 2015, F.col("rnd") % 4 == 2))
    rounds = rounds.withColumn("configured_sprint", F.lit(False))
    return calendar.sprint_flag(rounds, files.withColumn("session", label), keys).select(*keys, "is_sprint")
