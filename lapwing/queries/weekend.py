"""Practice, qualifying, sprint, teammate, conversion and circuit-history queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapwing.operators import conversion, teammates, weekend
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import ENTRIES, LAPS, QUALI, RESULTS, sql
from lapwing.sources import star

RACE = ["series", "rnd"]
TEAM = ["series", "rnd", "team"]

PRACTICE_COLS = [
    "fp1_best_lap", "fp2_best_lap", "fp3_best_lap", "fp1_gap_pct", "fp2_gap_pct", "fp3_gap_pct",
    "best_practice_lap", "avg_practice_lap", "practice_gap_pct", "practice_rank", "practice_laps",
    "practice_laps_norm", "practice_sessions",
]


def _gap(c: str) -> str:
    best = f"min({c}) OVER (PARTITION BY series, rnd)"
    return r6(f"({c} - {best}) / {best} * 100.0")


@query(
    "practice_block",
    sql(
        f""", per AS (
  SELECT series, rnd, entity, session, min(lap_s) AS best, count(*) AS n FROM laps
  WHERE lap_s > 50 AND NOT deleted GROUP BY ALL),
wide AS (
  SELECT e.series, e.rnd, e.entity,
    max(best) FILTER (session = 'fp1') AS b1, max(best) FILTER (session = 'fp2') AS b2,
    max(best) FILTER (session = 'fp3') AS b3, cast(coalesce(sum(n), 0) AS bigint) AS total
  FROM entries e LEFT JOIN per p USING (series, rnd, entity) GROUP BY ALL),
blend AS (SELECT *, least(b1, b2, b3) AS b, list_avg(list_filter([b1, b2, b3], lambda x: x IS NOT NULL)) AS a FROM wide)
SELECT series, rnd, entity, {r6("b1")} AS fp1_best_lap, {r6("b2")} AS fp2_best_lap, {r6("b3")} AS fp3_best_lap,
  {_gap("b1")} AS fp1_gap_pct, {_gap("b2")} AS fp2_gap_pct, {_gap("b3")} AS fp3_gap_pct,
  {r6("b")} AS best_practice_lap, {r6("a")} AS avg_practice_lap, {_gap("b")} AS practice_gap_pct,
  CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY series, rnd ORDER BY b NULLS LAST) END AS practice_rank,
  total AS practice_laps, {r6("total / 70.0")} AS practice_laps_norm,
  len(list_filter([b1, b2, b3], lambda x: x IS NOT NULL)) AS practice_sessions
FROM blend""",
        ENTRIES,
        LAPS,
    ),
)
def practice_block(spark, sf):
    lines = star.timed_lines(spark, sf)
    ln = F.col("l_linenumber")
    session = F.when(ln <= 2, "fp1").when(ln <= 4, "fp2").otherwise("fp3")
    laps = lines.select(*star.KEYS, session.alias("session"), "lap_s", "deleted")
    lineup = lines.select(*star.KEYS).distinct()
    out = weekend.practice_block(laps, lineup, star.KEYS, RACE)
    return shown(out.select(*star.KEYS, *PRACTICE_COLS))


@query(
    "qualifying_block",
    sql(
        f"""SELECT series, rnd, entity, q_position AS qualifying_position,
  {r6("(q_position - 1.0) / (count(*) OVER (PARTITION BY series, rnd) - 1)")} AS quali_pos_norm,
  {_gap("best")} AS quali_gap_pct, cast(best IS NULL AS bigint) AS quali_no_time,
  {_gap("q1")} AS q1_gap_pct, {_gap("q2")} AS q2_gap_pct, {_gap("q3")} AS q3_gap_pct FROM quali""",
        ENTRIES,
        QUALI,
    ),
)
def qualifying_block(spark, sf):
    quali = star.qualifying(spark, sf)
    lineup = quali.select(*star.KEYS)
    out = weekend.qualifying_block(quali.select(*star.KEYS, "q1", "q2", "q3", "q_position"), lineup, star.KEYS, RACE)
    return shown(
        out.select(
            *star.KEYS, F.col("q_position").alias("qualifying_position"), "quali_pos_norm", "quali_gap_pct",
            "quali_no_time", "q1_gap_pct", "q2_gap_pct", "q3_gap_pct",
        )
    )


@query(
    "sprint_block",
    sql(
        """SELECT e.series, e.rnd, e.entity,
  CASE WHEN e.rnd % 4 = 2 THEN cast(row_number() OVER (PARTITION BY series, rnd ORDER BY q1 NULLS LAST, entity) AS double) END AS sprint_quali_pos,
  CASE WHEN e.rnd % 4 = 2 THEN cast(row_number() OVER (PARTITION BY series, rnd ORDER BY quantity % 101 DESC, entity) AS double) END AS sprint_finish_pos,
  CASE WHEN e.rnd % 4 = 2 THEN cast(row_number() OVER (PARTITION BY series, rnd ORDER BY q1 NULLS LAST, entity)
    - row_number() OVER (PARTITION BY series, rnd ORDER BY quantity % 101 DESC, entity) AS double) END AS sprint_pos_delta
FROM entries e""",
        ENTRIES,
    ),
)
def sprint_block(spark, sf):
    base = star.entries(spark, sf)
    race = Window.partitionBy(*RACE)
    sprint = (
        base.where(star.is_sprint_round(F.col("rnd")))
        .withColumn("grid", F.row_number().over(race.orderBy(F.col("q1").asc_nulls_last(), "entity")))
        .withColumn("finish", F.row_number().over(race.orderBy(F.desc(F.col("quantity") % 101), "entity")))
    )
    sq = sprint.select(*star.KEYS, F.col("grid").alias("position"))
    sr = sprint.select(*star.KEYS, "grid", F.col("finish").alias("position"))
    return shown(weekend.sprint_block(sq, sr, base.select(*star.KEYS), star.KEYS))


@query(
    "teammate_quali_gap",
    sql(
        f"""SELECT a.series, a.rnd, a.entity, {r6("(a.best - b.best) / b.best * 100.0")} AS teammate_quali_gap_pct
FROM quali a LEFT JOIN quali b ON a.series = b.series AND a.rnd = b.rnd AND a.team = b.team AND a.entity <> b.entity""",
        ENTRIES,
        QUALI,
    ),
)
def teammate_quali_gap(spark, sf):
    rows = star.qualifying(spark, sf).withColumnRenamed("best", "best_quali_lap")
    return shown(teammates.add_quali_gap(rows, TEAM).select(*star.KEYS, "teammate_quali_gap_pct"))


@query(
    "teammate_grid_delta",
    sql(
        f"""SELECT a.series, a.rnd, a.entity, {r6("a.grid - b.grid")} AS teammate_grid_delta
FROM results a LEFT JOIN results b ON a.series = b.series AND a.rnd = b.rnd AND a.team = b.team AND a.entity <> b.entity""",
        RESULTS,
    ),
)
def teammate_grid_delta(spark, sf):
    return shown(teammates.add_grid_delta(star.results(spark, sf), TEAM).select(*star.KEYS, "teammate_grid_delta"))


@query(
    "teammate_h2h_shrunk",
    sql(
        f""", duel AS (
  SELECT a.series, a.rnd, a.entity, a.position AS p, b.position AS o,
         coalesce(a.status IN ('Engine', 'Collision', 'Did not start'), false) AS out_a,
         coalesce(b.status IN ('Engine', 'Collision', 'Did not start'), false) AS out_b
  FROM results a JOIN results b ON a.series = b.series AND a.rnd = b.rnd AND a.team = b.team AND a.entity <> b.entity),
tally AS (
  SELECT t.series, t.rnd, t.entity,
    count(*) FILTER (h.rnd IS NOT NULL AND NOT (out_a AND out_b)) AS n,
    count(*) FILTER (NOT out_a AND (out_b OR p < o)) AS wins
  FROM results t LEFT JOIN duel h ON h.series = t.series AND h.entity = t.entity AND h.rnd < t.rnd GROUP BY ALL)
SELECT series, rnd, entity, {r6("least(greatest((wins + 1.5) / (n + 3.0), 0.15), 0.85)")} AS driver_teammate_h2h_ratio FROM tally""",
        RESULTS,
    ),
)
def teammate_h2h_shrunk(spark, sf):
    return shown(teammates.h2h(star.results(spark, sf), ["series"]))


@query(
    "teammate_season_compare",
    sql(
        f""", r AS (
  SELECT results.*, q_position, coalesce(status IN ('Finished', '+1 Lap'), false) OR coalesce(status NOT IN ('Engine', 'Collision', 'Did not start', 'Disqualified', 'NC'), false) AS ok
  FROM results JOIN quali USING (series, rnd, entity))
SELECT a.series, a.season, a.team, a.entity AS first, b.entity AS second, count(*) AS races,
  count(*) FILTER (a.ok AND b.ok) AS both_finished,
  count(*) FILTER (a.ok AND (NOT b.ok OR a.position < b.position)) AS first_ahead,
  count(*) FILTER (b.ok AND (NOT a.ok OR b.position < a.position)) AS second_ahead,
  count(*) AS quali_compared, count(*) FILTER (a.q_position < b.q_position) AS first_quali_ahead,
  count(*) FILTER (b.q_position < a.q_position) AS second_quali_ahead,
  count(*) FILTER (a.position = 1) AS first_wins, count(*) FILTER (b.position = 1) AS second_wins,
  count(*) FILTER (a.position <= 3) AS first_podiums, count(*) FILTER (b.position <= 3) AS second_podiums,
  {r6("sum(a.points)")} AS first_points, {r6("sum(b.points)")} AS second_points,
  count(*) FILTER (NOT a.ok) AS first_dnfs, count(*) FILTER (NOT b.ok) AS second_dnfs
FROM r a JOIN r b ON a.series = b.series AND a.rnd = b.rnd AND a.team = b.team AND a.entity < b.entity GROUP BY ALL""",
        RESULTS,
        QUALI,
    ),
)
def teammate_season_compare(spark, sf):
    rows = star.with_qualifying(star.with_results(star.entries(spark, sf)))
    ok = F.col("status").isin("Finished", "+1 Lap")
    rows = rows.withColumn("position_text", F.when(ok, F.col("position").cast("string")).otherwise("R"))
    return shown(teammates.season_compare(rows.drop("q_position"), rows, ["series"]))


@query(
    "grid_conversion",
    sql(
        f""", hist AS (
  SELECT t.series, t.rnd, CASE WHEN grid <= 2 THEN 1 WHEN grid <= 5 THEN 3 WHEN grid <= 10 THEN 6 WHEN grid <= 16 THEN 11 ELSE 17 END AS b,
         position, grid, status IN ('Finished', '+1 Lap') AS fin
  FROM (SELECT DISTINCT series, rnd FROM results) t JOIN results h ON h.series = t.series AND h.rnd < t.rnd WHERE grid >= 1),
stat AS (SELECT series, rnd, b, count(*) AS n, avg(position) FILTER (fin) AS m, avg(cast(position <= grid AS int)) AS keep FROM hist GROUP BY ALL),
slots AS (
  SELECT DISTINCT series, rnd, s AS slot, CASE WHEN s <= 2 THEN 1 WHEN s <= 5 THEN 3 WHEN s <= 10 THEN 6 WHEN s <= 16 THEN 11 ELSE 17 END AS b,
    CASE WHEN s <= 2 THEN 1.5 WHEN s <= 5 THEN 4 WHEN s <= 10 THEN 8 WHEN s <= 16 THEN 13.5 ELSE 19.5 END AS mid
  FROM results, range(1, 21) x(s))
SELECT series, rnd, slot,
  {r6("(coalesce(n, 0) * coalesce(m, mid) + 5.0 * slot) / (coalesce(n, 0) + 5.0)")} AS expected_grid_finish,
  {r6("(coalesce(n, 0) * coalesce(keep, 0.6) + 5.0 * (0.5 + 0.25 * ((slot - 1) / 19.0))) / (coalesce(n, 0) + 5.0)")} AS grid_retention_prob
FROM slots LEFT JOIN stat USING (series, rnd, b)""",
        RESULTS,
    ),
)
def grid_conversion(spark, sf):
    return shown(conversion.conversion_map(star.results(spark, sf), ["series"], field_size=star.FIELD_SIZE))


@query(
    "track_history",
    sql(
        f"""SELECT t.series, t.entity, (t.rnd - 1) % 4 AS circuit,
  {r6("coalesce(avg(h.position), 12)")} AS track_avg_finish, {r6("coalesce(avg(h.grid), 12)")} AS track_avg_grid,
  {r6("coalesce(avg(h.grid - h.position), 0)")} AS track_avg_pos_gained, count(h.position) AS track_races_completed
FROM results t LEFT JOIN results h ON h.series = t.series AND h.entity = t.entity AND (h.rnd - 1) % 4 = (t.rnd - 1) % 4 AND h.rnd <= 24
WHERE t.rnd > 24 GROUP BY ALL""",
        RESULTS,
    ),
)
def track_history(spark, sf):
    rows = star.results(spark, sf).withColumn("circuit", (F.col("rnd") - 1) % 4)
    lineup = rows.where(F.col("rnd") > 24).select("series", "entity", "circuit")
    past = rows.where(F.col("rnd") <= 24)
    return shown(conversion.with_track_history(lineup, past, ["series", "entity", "circuit"]))
