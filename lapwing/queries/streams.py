"""Streaming queries over the event and order tables, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lapwing.queries.registry import query, r6, shown
from lapwing.session import scratch_dir
from lapwing.sources import star
from lapwing.sources.ledger import Ledger
from lapwing.streaming import landing, weather


def _stream(spark, sf, name):
    """The named table of the folder as a file stream."""
    schema = star.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _folders(spark):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query(
    "weather_stream",
    f"""WITH e AS (SELECT date_trunc('hour', ts) AS h, ts, value, user_id, event_type FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(*) AS samples, {r6("avg(10 + value / 10)")} AS air_temp, {r6("avg(15 + value / 8)")} AS track_temp,
  {r6("avg(40.0 + user_id % 50)")} AS humidity, {r6("avg(user_id % 10 / 2.0)")} AS wind_speed, {r6("avg(cast(event_type = 'error' AS int))")} AS rain_fraction
FROM e, m WHERE h + INTERVAL 1 HOUR <= wm GROUP BY ALL""",
)
def weather_stream(spark, sf):
    ev = _stream(spark, sf, "events")
    samples = star.weather_samples(ev).withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = _folders(spark)
    weather.weather_stream(weather.weather_windows(samples), out, state).awaitTermination()
    done = spark.read.parquet(out)
    cols = ["samples", "air_temp", "track_temp", "humidity", "wind_speed", "rain_fraction"]
    return shown(done.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), *cols))


@query(
    "landing_stream",
    """SELECT year(o_orderdate) AS season, o_orderpriority AS session, count(DISTINCT o_orderkey) AS files, cast(sum(o_custkey) AS bigint) AS checksum FROM orders GROUP BY ALL""",
)
def landing_stream(spark, sf):
    o = _stream(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderpriority").alias("session"),
    )
    twice = o.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out, state = _folders(spark)
    # the second stream has lost the first one's checkpoint: it reads all again and lands nothing
    for checkpoint in (state, f"{state}-lost"):
        landing.land_stream(twice, out, checkpoint, ["o_orderkey"], ["season", "session"], [F.col("o_custkey")]).awaitTermination()
    done = Ledger(spark, out).table()
    return shown(done.groupBy("season", "session").agg(F.count(F.lit(1)).alias("files"), F.sum("o_custkey").alias("checksum")))
