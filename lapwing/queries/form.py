"""Result views and season form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import form
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import CLASSED, ENTRIES, LAPS, QUALI, RESULTS, sql
from lapwing.sources import star

SCOPE = ["series", "entity"]
TARGET = 28

FORM_COLS = (
    "avg_finish", "avg_grid", "total_points", "recent_finish", "recent_grid", "recent_points",
    "driver_finish_ewma", "driver_quali_ewma", "driver_dns_rate", "driver_dnf_rate", "driver_dsq_rate",
    "driver_nc_rate",
)


@query(
    "results_view",
    sql("SELECT series, season, rnd, entity, team, grid, position, points, status FROM results", RESULTS),
)
def results_view(spark, sf):
    return shown(star.results(spark, sf).drop("grid_slot"))


@query("quali_view", sql(f"SELECT series, rnd, entity, {r6('best')} AS best, q_position FROM quali", ENTRIES, QUALI))
def quali_view(spark, sf):
    return shown(star.qualifying(spark, sf).select("series", "rnd", "entity", "best", "q_position"))


@query(
    "laps_view",
    sql(
        f"""SELECT series, rnd, entity, compound, count(*) AS n_laps, max(lap) AS max_lap,
            {r6("sum(lap * lap_s) / sum(lap)")} AS lap_weighted_s
            FROM laps GROUP BY series, rnd, entity, compound""",
        ENTRIES,
        LAPS,
    ),
)
def laps_view(spark, sf):
    laps = star.laps(spark, sf, star.hot_stints(spark, sf))
    out = laps.groupBy("series", "rnd", "entity", "compound").agg(
        F.count(F.lit(1)).alias("n_laps"),
        F.max("lap").alias("max_lap"),
        (F.sum(F.col("lap") * F.col("lap_s")) / F.sum("lap")).alias("lap_weighted_s"),
    )
    return shown(out)


def asof_sql(target: str) -> str:
    """One row per (entrant, target round) from a plain self join on earlier rounds."""
    return sql(
        f"""
, hist AS (
  SELECT t.series, t.entity, t.rnd AS rnd, h.rnd AS hr, h.position, h.grid, h.points, h.cls, q.q_position,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY t.series, t.entity, t.rnd) AS n
  FROM results t JOIN classed h ON h.series = t.series AND h.entity = t.entity AND h.rnd < t.rnd
  LEFT JOIN quali q ON q.series = h.series AND q.entity = h.entity AND q.rnd = h.rnd
  WHERE {target}
  WINDOW w AS (PARTITION BY t.series, t.entity, t.rnd ORDER BY h.rnd)),
agg AS (
  SELECT series, entity, rnd, count(*) AS races_completed,
         avg(position) AS avg_finish, avg(grid) AS avg_grid, sum(points) AS total_points,
         arg_max(position, hr) AS recent_finish, arg_max(grid, hr) AS recent_grid, arg_max(points, hr) AS recent_points,
         sum(CASE WHEN i = 1 THEN 1 ELSE 0.3 END * pow(0.7, n - i) * position) AS fin_ewma,
         sum(CASE WHEN i = 1 THEN 1 ELSE 0.3 END * pow(0.7, n - i) * q_position) AS q_ewma,
         count(*) FILTER (cls <> 'UNKNOWN') AS ents,
         count(*) FILTER (cls NOT IN ('UNKNOWN', 'DNS')) AS starts,
         count(*) FILTER (cls = 'DNS') AS dns, count(*) FILTER (cls = 'DSQ') AS dsq,
         count(*) FILTER (cls = 'RETIRED') AS ret, count(*) FILTER (cls = 'NC') AS nc
  FROM hist GROUP BY series, entity, rnd)
SELECT t.series, t.rnd, t.entity, coalesce(races_completed, 0) AS races_completed,
  {r6("coalesce(avg_finish, 12)")} AS avg_finish, {r6("coalesce(avg_grid, 12)")} AS avg_grid,
  {r6("coalesce(total_points, 0)")} AS total_points, {r6("coalesce(recent_finish, 12)")} AS recent_finish,
  {r6("coalesce(recent_grid, 12)")} AS recent_grid, {r6("coalesce(recent_points, 0)")} AS recent_points,
  {r6("coalesce(fin_ewma, 12)")} AS driver_finish_ewma, {r6("coalesce(q_ewma, 12)")} AS driver_quali_ewma,
  {r6("CASE WHEN ents > 0 THEN dns / ents ELSE 0 END")} AS driver_dns_rate,
  {r6("CASE WHEN starts > 0 THEN ret / starts ELSE 0 END")} AS driver_dnf_rate,
  {r6("CASE WHEN ents > 0 THEN dsq / ents ELSE 0 END")} AS driver_dsq_rate,
  {r6("CASE WHEN starts > 0 THEN nc / starts ELSE 0 END")} AS driver_nc_rate
FROM results t LEFT JOIN agg USING (series, entity, rnd) WHERE {target}""",
        RESULTS,
        CLASSED,
        QUALI,
    )


def race_rows(spark, sf):
    return star.with_qualifying(star.with_results(star.entries(spark, sf)))


@query("season_form_asof", asof_sql("t.rnd >= 1"))
def season_form_asof(spark, sf):
    rows = form.add_driver_form(race_rows(spark, sf), SCOPE)
    return shown(rows.select("series", "rnd", "entity", "races_completed", *FORM_COLS))


@query("season_form", asof_sql(f"t.rnd = {TARGET}"))
def season_form(spark, sf):
    rows = race_rows(spark, sf)
    lineup = rows.where(F.col("rnd") == TARGET).select(*star.KEYS)
    known = form.season_form(rows, SCOPE, TARGET)
    out = lineup.join(known, SCOPE, "left").select(
        *star.KEYS,
        F.coalesce("races_completed", F.lit(0)).alias("races_completed"),
        *[
            F.coalesce(c, F.lit(0.0 if "rate" in c or "points" in c else form.DEFAULT_POSITION)).alias(c)
            for c in FORM_COLS
        ],
    )
    return shown(out)


@query(
    "team_form_asof",
    sql(
        f"""
, hist AS (
  SELECT t.series, t.team, t.rnd, h.rnd AS hr, h.position, h.points,
         row_number() OVER (PARTITION BY t.series, t.team, t.rnd ORDER BY h.rnd, h.entity) AS i,
         count(*) OVER (PARTITION BY t.series, t.team, t.rnd) AS n
  FROM (SELECT DISTINCT series, team, rnd FROM results) t
  JOIN results h ON h.series = t.series AND h.team = t.team AND h.rnd < t.rnd)
SELECT t.series, t.rnd, t.team, {r6("coalesce(avg(position), 12)")} AS team_avg_finish,
  {r6("coalesce(sum(CASE WHEN i = 1 THEN 1 ELSE 0.3 END * pow(0.7, n - i) * position), 12)")} AS team_finish_ewma,
  {r6("coalesce(sum(points), 0)")} AS team_points,
  {r6("coalesce(sum(points), 0) / greatest(count(DISTINCT hr) * 2, 1)")} AS team_points_rate
FROM (SELECT DISTINCT series, team, rnd FROM results) t LEFT JOIN hist USING (series, team, rnd)
GROUP BY t.series, t.rnd, t.team""",
        RESULTS,
    ),
)
def team_form_asof(spark, sf):
    return shown(form.team_form(star.results(spark, sf), ["series", "team"]))


@query(
    "rolling_last3",
    sql(
        f"""SELECT series, rnd, entity,
  {r6('''coalesce(avg(position) OVER (PARTITION BY series, entity ORDER BY rnd
        ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 12)''')} AS rolling_finish FROM results""",
        RESULTS,
    ),
)
def rolling_last3(spark, sf):
    rows = form.add_rolling_finish(star.results(spark, sf), SCOPE)
    return shown(rows.select("series", "rnd", "entity", "rolling_finish"))
