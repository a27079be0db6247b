"""Career, season, circuit, qualifying and race statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions.numbers import qualifying_format
from lapwing.operators import archive
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import ARCHIVE, sql
from lapwing.sources import star

WHO = ["series", "entity"]
SEASON_COLS = [
    "races", "starts", "non_starts", "running_finishes", "classified_finishes", "classified_retirements",
    "unclassified_retirements", "wins", "podiums", "poles", "dnfs", "best_finish",
]


def rows_of(spark, sf):
    return star.archive(star.entries(spark, sf))


@query(
    "season_breakdown",
    sql(
        f"""SELECT series, entity, season, constructor, {", ".join(SEASON_COLS)}, {r6("points")} AS points, {r6("avg_finish")} AS avg_finish FROM brk""",
        ARCHIVE,
    ),
)
def season_breakdown(spark, sf):
    rows = rows_of(spark, sf)
    out = archive.season_breakdown(rows, rows, WHO)
    return shown(out.select(*WHO, "season", "constructor", *SEASON_COLS, "points", "avg_finish"))


CAREER = ["non_starts", "running_finishes", "classified_finishes", "classified_retirements", "unclassified_retirements", "wins", "podiums"]


@query(
    "career_stats",
    sql(
        f""", why AS (SELECT series, entity, string_agg(s || ':' || n, ', ' ORDER BY n DESC, s) AS retirement_reasons FROM (
    SELECT series, entity, coalesce(status, 'Unknown') AS s, count(*) AS n FROM arch WHERE ret GROUP BY ALL) GROUP BY ALL)
SELECT series, entity, string_agg(cast(season AS varchar), ',' ORDER BY season) AS seasons_active, cast(sum(races) AS bigint) AS total_entries,
  cast(sum(starts) AS bigint) AS total_starts, {", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in CAREER)},
  {r6("sum(points)")} AS total_points, cast(sum(dnfs) AS bigint) AS dnf_count, {r6("sum(fs) / sum(fn)")} AS avg_finish_position,
  CASE WHEN min(season) >= 1994 THEN cast(sum(poles) AS bigint) END AS career_poles, cast(sum(poles) AS bigint) AS known_covered_poles,
  '' AS seasons_missing, any_value(retirement_reasons) AS retirement_reasons
FROM brk LEFT JOIN why USING (series, entity) GROUP BY series, entity""",
        ARCHIVE,
    ),
)
def career_stats(spark, sf):
    rows = rows_of(spark, sf)
    out = archive.career_stats(rows, rows, WHO)
    text = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ",")
    out = out.withColumn("seasons_active", text(F.col("seasons_active"))).withColumn("seasons_missing", text(F.col("seasons_missing")))
    return shown(out)


@query(
    "season_standings",
    sql(
        f""", t AS (SELECT series, season, 'driver' AS board, cast(entity AS varchar) AS who, sum(points) AS p, count(*) FILTER (position = 1) AS w, entity AS tie, '' AS tie2 FROM archive GROUP BY series, season, entity
  UNION ALL SELECT series, season, 'constructor', constructor, sum(points), count(*) FILTER (position = 1), 0, constructor FROM archive GROUP BY series, season, constructor),
r AS (SELECT *, row_number() OVER (PARTITION BY series, season, board ORDER BY p DESC, w DESC, tie, tie2) AS rank FROM t)
SELECT series, season, board, rank, who, {r6("p")} AS points, w AS wins FROM r WHERE rank <= 10""",
        ARCHIVE,
    ),
)
def season_standings(spark, sf):
    rows = rows_of(spark, sf)
    boards = []
    for board, who in (("driver", "entity"), ("constructor", "constructor")):
        top = archive.season_standings(rows, ["series", "season"], who)
        boards.append(top.select("series", "season", F.lit(board).alias("board"), "rank", F.col(who).cast("string").alias("who"), "points", "wins"))
    return shown(boards[0].unionByName(boards[1]))


@query(
    "season_summary",
    sql(
        """, plan AS (SELECT DISTINCT series, season, rnd FROM archive UNION SELECT DISTINCT series, 1998, 29 FROM archive UNION SELECT DISTINCT series, 1999, 30 FROM archive),
p AS (SELECT series, season, count(*) AS s FROM plan GROUP BY ALL),
a AS (SELECT series, season, count(DISTINCT rnd) AS c, count(DISTINCT entity) AS d, count(DISTINCT constructor) AS k FROM archive GROUP BY ALL)
SELECT series, season, s AS scheduled_rounds, coalesce(c, 0) AS completed_rounds, coalesce(d, 0) AS drivers, coalesce(k, 0) AS constructors,
  coalesce(c, 0) < s AS is_in_progress,
  CASE WHEN c IS NULL THEN 'Season ' || season || ' (Scheduled / Pending: 0/' || s || ' Rounds Completed)'
    WHEN c < s THEN 'Season ' || season || ' (In-Progress / Provisional: ' || c || '/' || s || ' Rounds Completed)'
    ELSE 'Season ' || season || ' (Completed Championship: ' || c || ' Rounds)' END AS status_display,
  CASE WHEN season < 1994 THEN 'Qualifying session data unavailable for season ' || season
    ELSE 'Qualifying sessions recorded for ' || coalesce(c, 0) || '/' || coalesce(c, 0) || ' completed rounds.' END AS qualifying_coverage
FROM p LEFT JOIN a USING (series, season)""",
        ARCHIVE,
    ),
)
def season_summary(spark, sf):
    rows = rows_of(spark, sf)
    held = rows.select("series", "season", "rnd").distinct()
    ahead = rows.select("series").distinct().select(
        "series", F.explode(F.array(F.struct(F.lit(1998).alias("season"), F.lit(29).alias("rnd")), F.struct(F.lit(1999).alias("season"), F.lit(30).alias("rnd")))).alias("e")
    ).select("series", F.col("e.season").cast("long").alias("season"), F.col("e.rnd").cast("long").alias("rnd"))
    return shown(archive.season_summary(rows, held.unionByName(ahead), rows, ["series", "season"]))


AT = ["series", "circuit"]


@query(
    "circuit_winners",
    sql(
        """, c AS (
  SELECT series, circuit, 'wins' AS board, cast(entity AS varchar) AS who, entity AS tie, count(*) AS n FROM archive WHERE position = 1 GROUP BY ALL
  UNION ALL SELECT series, circuit, 'constructor_wins', constructor, 0, count(*) FROM archive WHERE position = 1 GROUP BY ALL
  UNION ALL SELECT series, circuit, 'podiums', cast(entity AS varchar), entity, count(*) FROM archive WHERE position <= 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series, circuit, board ORDER BY n DESC, tie, who) AS rank FROM c)
SELECT series, circuit, board, rank, who, n FROM r WHERE rank <= 10""",
        ARCHIVE,
    ),
)
def circuit_winners(spark, sf):
    return shown(archive.circuit_leaders(rows_of(spark, sf), AT).select(*AT, "board", "rank", "who", "n"))


@query(
    "circuit_recent",
    sql(
        """, w AS (SELECT *, row_number() OVER (PARTITION BY series, circuit ORDER BY season DESC, rnd DESC, entity) AS rank FROM archive WHERE position = 1),
t AS (SELECT series, circuit, count(*) AS total_races, min(season) AS first_year, max(season) AS last_year FROM w GROUP BY ALL)
SELECT series, circuit, rank, season, rnd, entity, constructor, total_races, first_year, last_year FROM w JOIN t USING (series, circuit) WHERE rank <= 5""",
        ARCHIVE,
    ),
)
def circuit_recent(spark, sf):
    rows = rows_of(spark, sf)
    races = rows.select(*AT, "season", "rnd").distinct()
    totals = archive.circuit_history(rows, races, AT)
    return shown(archive.recent_winners(rows, AT).join(totals, AT))


@query(
    "quali_summary",
    sql(
        f""", h AS (SELECT series, entity, string_agg('P' || p || ':' || n, ', ' ORDER BY p) AS position_distribution FROM (
    SELECT series, entity, q_position AS p, count(*) AS n FROM archive GROUP BY ALL) GROUP BY ALL)
SELECT series, entity, count(*) AS total_sessions, count(*) FILTER (q_position = 1) AS pole_positions,
  count(*) FILTER (q_position <= 2) AS front_row_starts, count(*) FILTER (q_position <= 10) AS top_10_starts,
  {r6("avg(q_position)")} AS avg_qualifying_position, 'Pre-1994 Archive; Qualifying Best Lap (QB)' AS formats,
  count(*) FILTER (grid > 0) AS grids_compared, {r6("avg(grid - q_position) FILTER (grid > 0)")} AS avg_grid_drop, any_value(position_distribution) AS position_distribution
FROM archive JOIN h USING (series, entity) GROUP BY series, entity""",
        ARCHIVE,
    ),
)
def quali_summary(spark, sf):
    rows = rows_of(spark, sf)
    two = F.col("q1").isNotNull() & F.col("q2").isNotNull()
    quali = rows.select(*WHO, "season", "rnd", "q_position", qualifying_format(F.col("season"), two)["format"].alias("format"))
    return shown(archive.qualifying_summary(quali, rows, WHO))


@query(
    "race_performance",
    sql(
        f""", x AS (SELECT *, coalesce(status IN ('Finished', '+1 Lap'), true) AS ok, coalesce(status <> 'Did not start', true) AS st FROM archive)
SELECT series, entity, count(*) AS total_races, count(*) FILTER (st) AS starts, count(*) FILTER (ok) AS classified_finishes,
  count(*) FILTER (ok AND position = 1) AS wins, count(*) FILTER (ok AND position <= 3) AS podiums, count(*) FILTER (points > 0) AS points_finishes,
  {r6("sum(points)")} AS total_points, count(*) FILTER (NOT ok) AS dnfs, {r6("count(*) FILTER (NOT ok) * 100.0 / count(*) FILTER (st)")} AS dnf_rate_pct,
  cast(sum(grid - position) FILTER (ok AND grid > 0) AS bigint) AS positions_gained_total, {r6("avg(grid - position) FILTER (ok AND grid > 0)")} AS avg_positions_gained,
  count(*) FILTER (ok AND grid > 0) AS valid_grid_starts, count(*) FILTER (ok AND position = 1) AS finish_p1, count(*) FILTER (ok AND position = 2) AS finish_p2,
  count(*) FILTER (ok AND position = 3) AS finish_p3, count(*) FILTER (ok AND position BETWEEN 4 AND 10) AS finish_p4_p10,
  count(*) FILTER (ok AND position > 10) AS finish_p11_plus, count(*) FILTER (NOT ok) AS finish_dnf FROM x GROUP BY series, entity""",
        ARCHIVE,
    ),
)
def race_performance(spark, sf):
    return shown(archive.race_performance(rows_of(spark, sf), WHO))


@query(
    "retirement_breakdown",
    sql(
        "SELECT series, season, status AS reason, count(*) AS n FROM archive WHERE status NOT IN ('Finished', '+1 Lap') GROUP BY ALL",
        ARCHIVE,
    ),
)
def retirement_breakdown(spark, sf):
    return shown(archive.retirement_breakdown(rows_of(spark, sf), ["series", "season"]))
