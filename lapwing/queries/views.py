"""SQL text of the racing views, written against the given tables."""

ENTRIES = """
lines AS (
  SELECT l_suppkey // 20 AS series, year(l_shipdate) AS season,
         (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS rnd,
         l_suppkey AS entity, l_suppkey // 2 AS team, l_linenumber AS ln,
         60.0 + l_extendedprice / l_quantity / 100.0 AS lap_s,
         (l_linestatus = 'F' AND l_linenumber = 7) AS deleted, *
  FROM lineitem),
entries AS (
  SELECT series, rnd, entity, min(season) AS season, min(team) AS team,
         cast(sum(cast(floor(l_extendedprice * (1 - l_discount) * 100) AS bigint)) AS bigint) AS revenue_cents,
         cast(sum(cast(l_quantity AS bigint)) AS bigint) AS quantity,
         min(lap_s) FILTER (ln <= 2) AS q1, min(lap_s) FILTER (ln BETWEEN 3 AND 4) AS q2,
         min(lap_s) FILTER (ln >= 5) AS q3,
         min(lap_s) FILTER (ln <= 2 AND NOT deleted AND lap_s > 50) AS fp1_best_lap,
         min(lap_s) FILTER (ln BETWEEN 3 AND 4 AND NOT deleted AND lap_s > 50) AS fp2_best_lap,
         min(lap_s) FILTER (ln >= 5 AND NOT deleted AND lap_s > 50) AS fp3_best_lap,
         count(*) FILTER (ln <= 2 AND NOT deleted AND lap_s > 50) AS fp1_laps,
         count(*) FILTER (ln BETWEEN 3 AND 4 AND NOT deleted AND lap_s > 50) AS fp2_laps,
         count(*) FILTER (ln >= 5 AND NOT deleted AND lap_s > 50) AS fp3_laps
  FROM lines GROUP BY series, rnd, entity)"""

RESULTS = (
    ENTRIES
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series, rnd ORDER BY quantity DESC, entity) AS grid_slot,
         row_number() OVER (PARTITION BY series, rnd ORDER BY revenue_cents DESC, entity) AS position
  FROM entries),
results AS (
  SELECT series, season, rnd, entity, team, grid_slot,
         CASE WHEN (entity * 5 + rnd) % 17 = 0 THEN 0 ELSE grid_slot END AS grid, position,
         cast(coalesce(list_extract([25, 18, 15, 12, 10, 8, 6, 4, 2, 1], position), 0) AS double) AS points,
         CASE (entity * 7 + rnd * 3) % 11
           WHEN 0 THEN 'Finished' WHEN 1 THEN 'Finished' WHEN 2 THEN 'Finished' WHEN 3 THEN 'Finished'
           WHEN 4 THEN '+1 Lap' WHEN 5 THEN 'Engine' WHEN 6 THEN 'Collision' WHEN 7 THEN 'Did not start'
           WHEN 8 THEN 'Disqualified' WHEN 9 THEN 'NC' END AS status
  FROM ranked)"""
)

# status classes of the derived results, spelled out independently of the word rules
CLASSED = """
classed AS (
  SELECT *, CASE WHEN status IN ('Finished', '+1 Lap') THEN 'FINISHED'
                 WHEN status IN ('Engine', 'Collision') THEN 'RETIRED'
                 WHEN status = 'Did not start' THEN 'DNS' WHEN status = 'Disqualified' THEN 'DSQ'
                 WHEN status = 'NC' THEN 'NC' ELSE 'UNKNOWN' END AS cls
  FROM results)"""

QUALI = """
quali AS (
  SELECT series, season, rnd, entity, team, q1, q2, q3, least(q1, q2, q3) AS best,
         row_number() OVER (PARTITION BY series, rnd ORDER BY least(q1, q2, q3) NULLS LAST, entity) AS q_position
  FROM entries)"""

LAPS = """
laps AS (
  SELECT series, rnd, entity, season, team,
         CASE WHEN ln <= 2 THEN 'fp1' WHEN ln <= 4 THEN 'fp2' ELSE 'fp3' END AS session,
         cast(1 AS bigint) AS stint,
         CASE l_returnflag WHEN 'A' THEN 'SOFT' WHEN 'N' THEN 'MEDIUM' ELSE 'HARD' END AS compound,
         row_number() OVER (PARTITION BY series, rnd, entity,
              CASE l_returnflag WHEN 'A' THEN 'SOFT' WHEN 'N' THEN 'MEDIUM' ELSE 'HARD' END
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, deleted) AS lap,
         lap_s, deleted
  FROM lines)"""


def sql(body: str, *ctes: str) -> str:
    """A WITH statement over the named views."""
    return "WITH " + ",".join(ctes) + "\n" + body

CIRCUITS = """
circuits AS (
  SELECT cast(n_nationkey AS bigint) AS circuit, lower(n_name) AS circuit_key,
    CASE n_nationkey % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'permanent' ELSE 'temporary' END AS circuit_type,
    cast(0.4 AS double) + (n_nationkey % 8) / 20.0 AS sc, cast(0.3 AS double) + (n_nationkey % 10) / 50.0 AS vsc,
    cast(0.1 AS double) + (n_nationkey % 12) / 100.0 AS rf, 20.0 + n_nationkey % 9 AS pit_loss,
    cast(0.6 AS double) + (n_nationkey % 7) / 10.0 AS deg_multiplier,
    18.0 + n_nationkey % 13 AS c_air, 26.0 + n_nationkey % 17 AS c_track, 45.0 + n_nationkey % 30 AS c_hum,
    2.0 + (n_nationkey % 5) / 2.0 AS c_wind, (n_nationkey % 11) / 20.0 AS c_rain
  FROM nation)"""

SLOPES = """
pts AS (SELECT series, rnd, entity, compound, cast(lap AS double) AS x, lap_s AS y FROM laps WHERE lap_s > 50),
f1 AS (SELECT series, rnd, entity, compound, regr_slope(y, x) AS m, regr_intercept(y, x) AS c, count(*) AS n
       FROM pts GROUP BY ALL),
res AS (SELECT pts.*, y - (m * x + c) AS r FROM pts JOIN f1 USING (series, rnd, entity, compound)),
med AS (SELECT series, rnd, entity, compound, median(r) AS md FROM res GROUP BY ALL),
mad AS (SELECT series, rnd, entity, compound, greatest(2.5 * 1.4826 * median(abs(r - md)), 0.5) AS lim
        FROM res JOIN med USING (series, rnd, entity, compound) GROUP BY ALL),
f2 AS (SELECT series, rnd, entity, compound, regr_slope(y, x) AS m2, count(*) AS n2, regr_syy(y, x) AS syy,
         regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy
       FROM res JOIN mad USING (series, rnd, entity, compound) WHERE abs(r) <= lim GROUP BY ALL),
slopes AS (
  SELECT f1.series, f1.rnd, f1.entity, f1.compound, f1.n,
    CASE WHEN n < 3 THEN 0.05 WHEN n2 >= 3 AND m2 IS NOT NULL THEN least(greatest(m2, 0.005), 0.4)
         ELSE least(greatest(m, 0.005), 0.4) END AS slope,
    CASE WHEN n < 3 OR n2 IS NULL OR n2 < 3 OR m2 IS NULL OR syy <= 1e-6 THEN 0.0
         ELSE least(greatest(1 - (syy - sxy * sxy / sxx) / (syy + 1e-8), 0), 1) END AS r2
  FROM f1 LEFT JOIN f2 USING (series, rnd, entity, compound))"""

STINTS = """
ok AS (SELECT * FROM laps WHERE lap_s > 50 AND NOT deleted),
lim AS (SELECT series, rnd, entity, compound, median(lap_s) * 1.12 AS lim, count(*) AS n FROM ok GROUP BY ALL),
kept AS (SELECT ok.*, row_number() OVER (PARTITION BY series, rnd, entity, compound ORDER BY lap) - 1 AS i
         FROM ok JOIN lim USING (series, rnd, entity, compound) WHERE n >= 4 AND lap_s <= lim),
stints AS (
  SELECT series, rnd, entity, compound, count(*) AS lap_count, avg(lap_s) AS mean_lap, median(lap_s) AS median_lap,
    min(lap_s) AS best_lap, stddev_pop(lap_s) AS std_lap, avg(lap_s + 0.035 * i) AS fuel_adj_mean_lap,
    regr_slope(lap_s, i) AS deg_slope
  FROM kept GROUP BY ALL HAVING count(*) >= 4)"""

ARCHIVE = (
    RESULTS
    + ","
    + QUALI
    + """,
archive AS (
  SELECT r.series, r.season - 3 AS season, r.rnd, r.entity, 'Team ' || r.team AS constructor, grid, position,
    CASE WHEN status IN ('Engine', 'Collision') THEN 'R' WHEN status = 'Did not start' THEN 'W'
         WHEN status = 'Disqualified' THEN 'D' WHEN status = 'NC' THEN 'N' ELSE cast(position AS varchar) END AS position_text,
    points, status, q_position, (r.rnd - 1) % 4 AS circuit
  FROM results r JOIN quali USING (series, rnd, entity)),
arch AS (
  SELECT *, coalesce(status IN ('Did not start', 'NC'), false) AS ns, coalesce(status IN ('Finished', '+1 Lap'), false) AS run,
    coalesce(status IN ('Finished', '+1 Lap'), true) AS cls,
    status IS NULL OR status IN ('Engine', 'Collision') AS ret
  FROM archive),
brk AS (
  SELECT series, entity, season, any_value(constructor) AS constructor, count(*) AS races, count(*) FILTER (NOT ns) AS starts,
    count(*) FILTER (ns) AS non_starts, count(*) FILTER (run) AS running_finishes, count(*) FILTER (cls) AS classified_finishes,
    count(*) FILTER (cls AND ret) AS classified_retirements, count(*) FILTER (NOT cls AND ret) AS unclassified_retirements,
    count(*) FILTER (cls AND position = 1) AS wins, count(*) FILTER (cls AND position <= 3) AS podiums, sum(points) AS points,
    min(position) FILTER (cls) AS best_finish, avg(position) FILTER (cls) AS avg_finish, count(*) FILTER (cls) AS fn,
    sum(position) FILTER (cls) AS fs, count(*) FILTER (ret) AS dnfs,
    CASE WHEN season >= 1994 THEN count(*) FILTER (q_position = 1) END AS poles
  FROM arch GROUP BY series, entity, season)"""
)
