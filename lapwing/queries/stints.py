"""Stints, tyre wear, weather and incident odds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import conditions, stints
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import CIRCUITS, ENTRIES, LAPS, QUALI, SLOPES, STINTS, sql
from lapwing.sources import star

RACE = ["series", "rnd"]
STINT = star.KEYS + ["stint", "compound"]


def laps_and_hot(spark, sf):
    hot = star.hot_stints(spark, sf)
    return star.laps(spark, sf, hot), hot


STINT_STATS = ["mean_lap", "median_lap", "best_lap", "std_lap", "fuel_adj_mean_lap", "deg_slope"]


@query(
    "stint_summary",
    sql(
        "SELECT series, rnd, entity, compound, lap_count, "
        + ", ".join(f"{r6(c)} AS {c}" for c in STINT_STATS)
        + " FROM stints",
        ENTRIES,
        LAPS,
        STINTS,
    ),
)
def stint_summary(spark, sf):
    laps, hot = laps_and_hot(spark, sf)
    out = stints.stint_summary(laps, STINT, hot=hot)
    return shown(out.select(*star.KEYS, "compound", "lap_count", *STINT_STATS))


@query(
    "long_run_pace",
    sql(
        f""", pooled AS (
  SELECT series, rnd, entity, stddev_pop(lap_s) AS sd, count(*) AS total
  FROM kept JOIN stints USING (series, rnd, entity, compound) GROUP BY ALL),
pick AS (
  SELECT *, row_number() OVER (PARTITION BY series, rnd, entity ORDER BY lap_count DESC, fuel_adj_mean_lap, compound) AS k FROM stints),
pace AS (
  SELECT e.series, e.rnd, e.entity, q_position, fuel_adj_mean_lap AS pace, sd, coalesce(total, 0) AS total,
         coalesce(lap_count, 0) AS longest, p.compound
  FROM quali e LEFT JOIN pick p ON e.series = p.series AND e.rnd = p.rnd AND e.entity = p.entity AND k = 1
  LEFT JOIN pooled o ON e.series = o.series AND e.rnd = o.rnd AND e.entity = o.entity),
placed AS (
  SELECT *, CASE WHEN pace IS NOT NULL THEN rank() OVER (PARTITION BY series, rnd ORDER BY pace NULLS LAST) END AS pos,
         min(pace) OVER (PARTITION BY series, rnd) AS fastest FROM pace)
SELECT series, rnd, entity, compound AS primary_compound, {r6("(pace - fastest) / fastest * 100.0")} AS long_run_pace_gap_pct,
  pos AS long_run_pace_rank, {r6("sd")} AS race_pace_consistency, total AS race_pace_sample_count,
  longest AS long_run_stint_length, {r6("q_position - pos")} AS race_pace_vs_quali_delta,
  {r6("least(total / 12.0, 1.0)")} AS race_pace_confidence FROM placed""",
        ENTRIES,
        LAPS,
        QUALI,
        STINTS,
    ),
)
def long_run_pace(spark, sf):
    laps, hot = laps_and_hot(spark, sf)
    found = stints.stint_summary(laps, STINT, hot=hot)
    lineup = star.qualifying(spark, sf).select(*star.KEYS, "q_position")
    rows = lineup.join(stints.long_run_pace(found, star.KEYS), star.KEYS, "left")
    out = stints.add_race_pace(rows, RACE, "q_position")
    return shown(
        out.select(
            *star.KEYS, "primary_compound", "long_run_pace_gap_pct", "long_run_pace_rank", "race_pace_consistency",
            "race_pace_sample_count", "long_run_stint_length", "race_pace_vs_quali_delta", "race_pace_confidence",
        )
    )


@query(
    "robust_slope",
    sql(
        f"SELECT series, rnd, entity, compound, n, {r6('slope')} AS slope, {r6('r2')} AS r2 FROM slopes",
        ENTRIES,
        LAPS,
        SLOPES,
    ),
)
def robust_slope(spark, sf):
    laps, hot = laps_and_hot(spark, sf)
    return shown(stints.robust_slope(laps.where(F.col("lap_s") > 50), star.STINT_KEYS, "lap", hot))


@query(
    "compound_degradation",
    sql(
        f""", own AS (SELECT * FROM slopes WHERE n >= 4),
team AS (SELECT series, rnd, entity // 2 AS team, compound, sum(n) AS tn, sum(slope * n) / sum(n) AS trate FROM own GROUP BY ALL),
base AS (
  SELECT e.series, e.rnd, e.entity, e.team, b.compound, b.rate * c.deg_multiplier AS prior
  FROM entries e JOIN circuits c ON c.circuit = (e.rnd - 1) % 4,
       (VALUES ('SOFT', 0.110::double), ('MEDIUM', 0.065::double), ('HARD', 0.038::double)) b(compound, rate)),
r AS (
  SELECT b.series, b.rnd, b.entity, b.compound,
    CASE WHEN o.n IS NOT NULL THEN least(o.n / 12.0, 0.85) * slope + (1 - least(o.n / 12.0, 0.85)) * prior
         WHEN tn IS NOT NULL THEN 0.5 * trate + 0.5 * prior ELSE prior END AS rate,
    coalesce(o.n, floor(tn * 0.5), 0) AS seen
  FROM base b LEFT JOIN own o USING (series, rnd, entity, compound)
  LEFT JOIN team t ON t.series = b.series AND t.rnd = b.rnd AND t.team = b.team AND t.compound = b.compound),
w AS (
  SELECT series, rnd, entity, max(rate) FILTER (compound = 'SOFT') AS s, max(rate) FILTER (compound = 'MEDIUM') AS m,
         max(rate) FILTER (compound = 'HARD') AS h, sum(seen) AS seen FROM r GROUP BY ALL)
SELECT series, rnd, entity, {r6("s")} AS soft_tyre_deg_rate, {r6("m")} AS medium_tyre_deg_rate, {r6("h")} AS hard_tyre_deg_rate,
  {r6("0.2 * s + 0.5 * m + 0.3 * h")} AS estimated_tyre_deg_rate, {r6("s - m + 0.65")} AS compound_pace_delta,
  {r6("least(greatest(seen / 18.0, 0.2), 1.0)")} AS tyre_deg_confidence FROM w""",
        ENTRIES,
        LAPS,
        SLOPES,
        CIRCUITS,
    ),
)
def compound_degradation(spark, sf):
    laps, hot = laps_and_hot(spark, sf)
    lineup = star.entries(spark, sf).select(*star.KEYS, "team", star.circuit_of(F.col("rnd")).alias("circuit"))
    lineup = conditions.add_circuit_priors(lineup, star.circuit_priors(spark, sf), "circuit")
    return shown(stints.compound_wear(laps, lineup.select(*star.KEYS, "team", "deg_multiplier"), RACE, hot=hot))


_WEATHER = """
wx AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN hour(ts) < 8 THEN 'fp1' WHEN hour(ts) < 16 THEN 'fp2' ELSE 'fp3' END AS session,
    10 + value / 10 AS air, 15 + value / 8 AS track, 40.0 + user_id % 50 AS hum, user_id % 10 / 2.0 AS wind,
    cast(event_type = 'error' AS int) AS rain FROM events),
sess AS (
  SELECT day, session, avg(air) AS air_temp, avg(track) AS track_temp, avg(hum) AS humidity, avg(wind) AS wind_speed,
    avg(rain) AS rain_fraction, cast(max(rain) AS bigint) AS rain_detected FROM wx GROUP BY ALL)"""


@query(
    "session_weather",
    sql(
        "SELECT day, session, rain_detected, "
        + ", ".join(f"{r6(c)} AS {c}" for c in ("air_temp", "track_temp", "humidity", "wind_speed", "rain_fraction"))
        + " FROM sess",
        _WEATHER,
    ),
)
def session_weather(spark, sf):
    return shown(conditions.session_weather(star.weather(spark, sf), ["day", "session"]))


@query(
    "weather_block",
    sql(
        f""", ev AS (SELECT DISTINCT strftime(o_orderdate, '2024-01-%d') AS day FROM orders),
m AS (SELECT day, avg(air_temp) AS a, avg(track_temp) AS t, avg(humidity) AS h, avg(wind_speed) AS w, avg(rain_fraction) AS r FROM sess GROUP BY ALL),
p AS (
  SELECT ev.day, m.day IS NOT NULL AS seen, coalesce(a, c_air) AS a, coalesce(t, c_track) AS t, coalesce(h, c_hum) AS h,
    coalesce(w, c_wind) AS w, CASE WHEN m.day IS NOT NULL THEN least(greatest(r * 2, c_rain * 0.5), 0.9) ELSE c_rain END AS p
  FROM ev LEFT JOIN m USING (day) JOIN circuits ON circuit = cast(right(ev.day, 2) AS bigint) % 25)
SELECT day, {r6("a")} AS air_temperature, {r6("t")} AS track_temperature, {r6("h")} AS humidity, {r6("w")} AS wind_speed,
  {r6("p")} AS rain_probability, {r6("CASE WHEN p >= 0.5 THEN 1 WHEN p >= 0.25 THEN 0.5 ELSE 0 END")} AS wet_conditions_indicator,
  {r6("CASE WHEN seen THEN 0.85 ELSE 0.3 END")} AS weather_confidence FROM p""",
        _WEATHER,
        CIRCUITS,
    ),
)
def weather_block(spark, sf):
    days = star.table(spark, sf, "orders").select(F.concat(F.lit("2024-01-"), F.date_format("o_orderdate", "dd")).alias("day"))
    days = days.distinct().withColumn("circuit", F.substring("day", 9, 2).cast("long") % 25)
    climate = star.circuit_priors(spark, sf).select("circuit", *[c for c in star.circuit_priors(spark, sf).columns if c.startswith("climate_")])
    events = days.join(climate, "circuit", "left")
    sessions = conditions.session_weather(star.weather(spark, sf), ["day", "session"])
    return shown(conditions.weather_block(events, sessions, ["day"]))


@query(
    "incident_priors",
    sql(
        f""", races AS (SELECT DISTINCT series, rnd, (series * 3 + rnd) % 30 AS circuit, rnd % 3 = 0 AS wet FROM entries),
p AS (SELECT series, rnd, wet, coalesce(sc, 0.5) AS sc, coalesce(vsc, 0.4) AS vsc, coalesce(rf, 0.15) AS rf,
        coalesce(pit_loss, 22) AS pit_loss FROM races LEFT JOIN circuits USING (circuit))
SELECT series, rnd, wet, {r6("CASE WHEN wet THEN least(sc * 1.4, 0.95) ELSE sc END")} AS p_safety_car,
  {r6("CASE WHEN wet THEN least(vsc * 1.4, 0.9) ELSE vsc END")} AS p_vsc,
  {r6("CASE WHEN wet THEN least(rf * 1.4, 0.6) ELSE rf END")} AS p_red_flag, {r6("pit_loss")} AS pit_loss_seconds FROM p""",
        ENTRIES,
        CIRCUITS,
    ),
)
def incident_priors(spark, sf):
    races = star.timed_lines(spark, sf).select("series", "rnd").distinct()
    races = races.withColumn("circuit", (F.col("series") * 3 + F.col("rnd")) % 30).withColumn("wet", F.col("rnd") % 3 == 0)
    priors = star.circuit_priors(spark, sf).withColumn("circuit", F.col("circuit").cast("string"))
    rows = conditions.add_circuit_priors(races.withColumn("circuit", F.col("circuit").cast("string")), priors, "circuit")
    return shown(rows.select("series", "rnd", "wet", *[c.alias(n) for n, c in conditions.incident_odds(F.col("wet")).items()], "pit_loss_seconds"))
