"""Sources and sinks over files that Spark writes from the given tables, read back by the library's scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lapwing.operators import calendar, collection, grids, quality, weekend
from lapwing.queries.calendar import EVENTS, LANDED, calendar_events, landed_files
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import ENTRIES, QUALI, RESULTS, sql
from lapwing.schema import SESSION_ALIASES
from lapwing.session import scratch_dir
from lapwing.sources import archive_json, files, star
from lapwing.sources.ledger import Ledger


def folder(spark, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


# Three headers that mean the same.
HEADERS = (
    {"Abbreviation": "entity", "TeamName": "team", "Position": "position", "GridPosition": "grid", "Points": "points", "Status": "status", "EventName": "race"},
    {"Race": "race", "Status": "status", "Driver": "entity", "Constructor": "team", "FinishPosition": "position", "Grid": "grid"},
    {"DriverId": "entity", "Team": "team", "ClassifiedPosition": "position", "StartingGrid": "grid", "Points": "points", "Race": "race"},
)


@query(
    "mixed_csv_scan",
    sql(
        f"""SELECT season || ', round ' || rnd || ' of ' || series AS race, cast(entity AS varchar) AS driver, 'Team, ' || team AS team, {r6("position")} AS position, {r6("grid")} AS grid,
  CASE WHEN series % 3 <> 1 THEN {r6("points")} END AS points, CASE WHEN series % 3 <> 2 THEN status END AS status FROM results""",
        RESULTS,
    ),
)
def mixed_csv_scan(spark, sf):
    """Three headers, commas inside fields; files from empty ones to the whole table, the large ones read in pieces."""
    race = F.concat(F.col("season").cast("string"), F.lit(", round "), F.col("rnd").cast("string"), F.lit(" of "), F.col("series").cast("string"))
    rows = star.results(spark, sf).withColumns({"race": race, "team": F.concat(F.lit("Team, "), F.col("team").cast("string"))})
    base = folder(spark, "csv")
    for kind, header in enumerate(HEADERS):
        own = rows.where(F.col("series") % 3 == kind).select(*[F.col(c).cast("string").alias(name) for name, c in header.items()])
        own.write.option("header", True).csv(f"{base}/{kind}")
    cells = files.scan_csv(spark, [f"{base}/{kind}/*.csv" for kind in range(len(HEADERS))], large=20_000)
    return shown(files.canonical(cells, SESSION_ALIASES).select("race", "driver", "team", "position", "grid", "points", "status"))


def _incoming(spark, sf):
    """Session rows as they come in: an order is an entrant's row; some without place, name or lap, some of another round."""
    o = landed_files(spark, sf)
    k = F.col("o_orderkey")
    return o.select(
        "scope", "season", "rnd", "session",
        F.when(k % 13 == 0, " ").when(k % 17 == 0, "SC1").otherwise(F.concat(F.lit("d"), (k % 40).cast("string"))).alias("driver"),
        F.when(F.col("n_rows") > 0, (k % 20 + 1).cast("double")).alias("position"),
        F.when(k % 3 == 0, 80.0 + k % 10).alias("lap_s"),
        F.when((F.col("scope") + F.col("rnd")) % 11 == 0, F.col("rnd") + 1).otherwise(F.col("rnd")).alias("event_round"),
    )


_INCOMING = f"""WITH {LANDED}, {EVENTS},
inc AS (SELECT scope, season, rnd, session, CASE WHEN o_orderkey % 13 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN 'SC1' ELSE 'd' || (o_orderkey % 40) END AS driver,
  CASE WHEN n_rows > 0 THEN o_orderkey % 20 + 1 END AS position, o_orderkey % 3 = 0 AS timed, (scope + rnd) % 11 = 0 AS other FROM landed),
test AS (SELECT scope, season, rnd, session, any_value(other) AS other, bool_or(position IS NOT NULL) AS placed, bool_or(trim(driver) <> '') AS named, bool_or(timed) AND session LIKE 'fp_' AS laps,
  count(*) FILTER (trim(driver) <> '') AS lap_rows, count(DISTINCT driver) FILTER (trim(driver) <> '') AS drivers
  FROM inc WHERE driver <> 'SC1' GROUP BY scope, season, rnd, session),
why AS (SELECT *, CASE WHEN other THEN 'Round identity mismatch' WHEN NOT placed AND NOT laps THEN 'No classified positions' WHEN NOT named THEN 'No valid driver' END AS reason, CASE WHEN laps THEN lap_rows ELSE drivers END AS n FROM test),
st AS (SELECT s.scope, s.season, s.rnd, s.session, s.season < 2017 AND w.scope IS NOT NULL AND reason IS NULL AS before, w.scope IS NOT NULL AND reason IS NULL AS ok, coalesce(reason, 'Session results table is empty') AS detail, n, scheduled_ts
  FROM sched s LEFT JOIN why w USING (scope, season, rnd, session))
"""


@query(
    "event_collection",
    _INCOMING
    + """SELECT scope, season, rnd, session, CASE WHEN before THEN 'SKIPPED' WHEN ok THEN 'SUCCESS' WHEN scheduled_ts > TIMESTAMP '2019-06-10 12:00:00' THEN 'FUTURE_SESSION'
  WHEN scheduled_ts > TIMESTAMP '2019-06-08 12:00:00' THEN 'NOT_YET_AVAILABLE' WHEN detail LIKE '%empty%' THEN 'DATA_MISSING' ELSE 'COLLECTION_FAILED' END AS status,
  CASE WHEN NOT ok THEN detail END AS detail, CASE WHEN before THEN 0 WHEN ok THEN n ELSE 0 END AS records, CASE WHEN ok THEN n ELSE 0 END AS landed FROM st""",
)
def event_collection(spark, sf):
    """Two runs over the whole calendar, the first up to a season, and between them one that dies before it is published."""
    events, plan = calendar_events(spark, sf), calendar.session_plan(spark)
    ledger, incoming, keys = Ledger(spark, folder(spark, "collected")), _incoming(spark, sf), ["scope", "season", "rnd"]
    now = F.lit("2019-06-10 12:00:00").cast("timestamp")
    early = events.where("season < 2017")
    collection.collect(ledger, "early", early, plan, incoming, keys, now)
    ledger.stage(ledger.table().limit(0).unionByName(ledger.table()), "dead", collection.PARTITIONS)
    report = collection.collect(ledger, "all", events, plan, incoming, keys, now).report
    landed = ledger.table().groupBy(*keys, "session").agg(F.count("*").alias("landed"))
    out = report.join(landed, [*keys, "session"], "left")
    return shown(out.select(*keys, "session", "status", "detail", "records", F.coalesce("landed", F.lit(0)).alias("landed")))


# Landed sessions ------------------------------------------------------------------------------------


def _landed_results(spark, sf) -> str:
    """Results as a landed table: race and qualifying of every round."""
    path = folder(spark, "landed")
    rows = star.results(spark, sf).select("season", "rnd", F.lit("race").alias("session"), "series", "entity", "position", "points")
    quali = star.qualifying(spark, sf).select("season", "rnd", F.lit("qualifying").alias("session"), "series", "entity", F.col("q_position").alias("position"))
    files.land(rows, path)
    files.land(quali, path)
    return path


@query(
    "season_scan",
    sql(
        """SELECT season, rnd, session, count(*) AS n, cast(sum(position * entity) AS bigint) AS checksum FROM (
  SELECT season, rnd, 'race' AS session, entity, position FROM results UNION ALL SELECT season, rnd, 'qualifying', entity, q_position FROM quali)
WHERE season IN (1996, 1997) AND rnd <= 10 OR season = 1998 AND session = 'race' OR rnd = 17 AND session = 'qualifying' GROUP BY ALL""",
        RESULTS,
        QUALI,
    ),
)
def season_scan(spark, sf):
    """Seasons up to a round, one session kind of a season, and one session; all by partition."""
    path = _landed_results(spark, sf)
    parts = [files.load(spark, path, season=s, max_round=10) for s in (1996, 1997)]
    parts.append(files.load(spark, path, season=1998, sessions=["race"]))
    parts.append(files.lookup(files.load(spark, path, rounds=[17]), session="qualifying").where("season < 1996 or season > 1998"))
    rows = files.merge_history(parts)
    out = rows.groupBy("season", "rnd", "session").agg(F.count("*").alias("n"), F.sum(F.col("position") * F.col("entity")).alias("checksum"))
    return shown(out)


@query(
    "history_merge",
    sql("SELECT season, count(*) AS n, count(points) AS with_points, count(q_position) AS with_places FROM (SELECT season, points, NULL AS q_position FROM results UNION ALL SELECT season, NULL, q_position FROM quali) GROUP BY ALL", RESULTS, QUALI),
)
def history_merge(spark, sf):
    """Yearly tables with different columns as one."""
    parts = [star.results(spark, sf).select("season", "points"), star.qualifying(spark, sf).select("q_position", "season")]
    rows = files.merge_history(parts)
    return shown(rows.groupBy("season").agg(F.count("*").alias("n"), F.count("points").alias("with_points"), F.count("q_position").alias("with_places")))


@query(
    "source_preference",
    sql(
        """SELECT season, rnd, CASE WHEN rnd % 3 = 0 THEN 'live' WHEN rnd % 3 = 1 THEN 'cache' ELSE 'archive' END AS source, count(*) AS n FROM results GROUP BY ALL""",
        RESULTS,
    ),
)
def source_preference(spark, sf):
    """Three sources that cover different rounds; each session comes from the first that has it."""
    rows = star.results(spark, sf).select("season", "rnd", F.lit("race").alias("session"), "entity")
    live, cache = rows.where("rnd % 3 = 0"), rows.where("rnd % 3 < 2")
    named = [part.withColumn("source", F.lit(n)) for n, part in (("live", live), ("cache", cache), ("archive", rows))]
    return shown(files.prefer_source(named).groupBy("season", "rnd", "source").agg(F.count("*").alias("n")))


STAGE_LIST = ["pre_fp1", "after_fp1", "after_fp2", "After_Sprint", "after_sprint_qualifying", "after_qualifying", "before_race", "post_race", "later", None]
_TARGETS = f"""t AS (SELECT DISTINCT scope, season, rnd, rnd % 4 = 2 AS is_sprint, {str(STAGE_LIST).replace("None", "NULL")}[cast((scope + season + rnd) % 10 AS int) + 1] AS stage FROM landed),
c AS (SELECT *, CASE lower(coalesce(stage, 'after_qualifying')) WHEN 'after_sprint' THEN 'after_sprint_race' ELSE lower(coalesce(stage, 'after_qualifying')) END AS st FROM t)"""


def _targets(spark, sf):
    t = landed_files(spark, sf).select("scope", "season", "rnd").distinct()
    place = ((F.col("scope") + F.col("season") + F.col("rnd")) % 10 + 1).cast("int")
    return t.withColumns({"is_sprint": F.col("rnd") % 4 == 2, "stage": F.element_at(F.array(*[F.lit(s) for s in STAGE_LIST]), place)})


@query(
    "weekend_scan",
    f"""WITH {LANDED}, {_TARGETS}
SELECT l.scope, l.season, l.rnd, c.stage, l.session, count(*) AS n FROM landed l JOIN c USING (scope, season, rnd)
WHERE CASE WHEN is_sprint THEN CASE st WHEN 'after_fp1' THEN session = 'fp1' WHEN 'after_sprint_qualifying' THEN session = 'fp1' WHEN 'after_sprint_race' THEN session = 'fp1'
    WHEN 'after_qualifying' THEN session IN ('fp1', 'qualifying') WHEN 'before_race' THEN session IN ('fp1', 'qualifying') WHEN 'post_race' THEN session IN ('fp1', 'qualifying', 'race') ELSE false END
  ELSE CASE st WHEN 'after_fp1' THEN session = 'fp1' WHEN 'after_fp2' THEN session IN ('fp1', 'fp2') WHEN 'after_qualifying' THEN session <> 'race' WHEN 'before_race' THEN session <> 'race'
    WHEN 'post_race' THEN true ELSE false END END GROUP BY ALL""",
)
def weekend_scan(spark, sf):
    """What each weekend's forecast may see, by its format and stage; invalid stages see nothing."""
    seen = calendar.weekend_sessions(landed_files(spark, sf), _targets(spark, sf), ["scope", "season", "rnd"], strict=False)
    return shown(seen.groupBy("scope", "season", "rnd", "stage", "session").agg(F.count("*").alias("n")))


@query(
    "stage_errors",
    f"""WITH {LANDED}, {_TARGETS}
SELECT scope, season, rnd, stage, CASE WHEN st = 'later' THEN 'unknown stage' WHEN is_sprint THEN 'stage is invalid for a sprint weekend' ELSE 'stage is invalid for a standard weekend' END AS error
FROM c WHERE st = 'later' OR (is_sprint AND st IN ('after_fp2', 'after_fp3')) OR (NOT is_sprint AND st LIKE 'after_sprint%')""",
)
def stage_errors(spark, sf):
    return calendar.stage_errors(_targets(spark, sf)).select("scope", "season", "rnd", "stage", "error")


@query(
    "practice_sprint_scan",
    f"""WITH {LANDED} SELECT season, rnd, session, count(*) AS n FROM landed WHERE session IN ('fp1', 'fp2', 'fp3') AND (rnd % 4 <> 2 OR session = 'fp1') GROUP BY ALL""",
)
def practice_sprint_scan(spark, sf):
    """Practice of every weekend as its format has it."""
    rows = landed_files(spark, sf)
    sprints = rows.where("rnd % 4 = 2").select("scope", "season", "rnd").distinct()
    kept = calendar.practice_and_sprint(rows, sprints, ["scope", "season", "rnd"])
    return shown(kept.groupBy("season", "rnd", "session").agg(F.count("*").alias("n")))


@query(
    "round_resolution",
    f"""WITH {LANDED}, t AS (SELECT DISTINCT scope, season, rnd FROM landed)
SELECT scope, season, rnd, CASE WHEN rnd % 3 = 0 THEN rnd + 100 WHEN rnd % 3 = 1 THEN rnd + 200 WHEN scope % 2 = 0 THEN rnd END AS resolved FROM t""",
)
def round_resolution(spark, sf):
    """A round from the argument, else from a supplied map, else from the configuration."""
    t = landed_files(spark, sf).select("scope", "season", "rnd").distinct()
    explicit, supplied = F.when(F.col("rnd") % 3 == 0, F.col("rnd") + 100), F.when(F.col("rnd") % 3 <= 1, F.col("rnd") + 200)
    configured = F.when(F.col("scope") % 2 == 0, F.col("rnd"))
    return shown(t.withColumn("resolved", calendar.next_round(explicit, supplied, configured)))


# Grids ---------------------------------------------------------------------------------------------


_SOURCES = """src AS (
  SELECT series, rnd, entity, 1 AS pr, 'official_manifest' AS source, CASE WHEN rnd % 2 = 0 THEN grid_slot ELSE greatest(grid_slot - 1, 1) END AS slot FROM results WHERE rnd % 6 = 0 OR rnd % 6 = 3
  UNION ALL SELECT series, rnd, entity, 2, 'f1_website', position FROM results WHERE rnd % 4 = 1
  UNION ALL SELECT series, rnd, entity, 3, 'openf1_api', 21 - grid_slot FROM results WHERE rnd % 5 = 2
  UNION ALL SELECT series, rnd, entity, 4, 'algorithmic_fallback', q_position FROM quali WHERE rnd % 7 <> 0
  UNION ALL SELECT series, rnd, entity, 5, 'historical_race_results', position FROM results WHERE rnd <> 7),
v AS (SELECT series, rnd, source, pr FROM src GROUP BY ALL HAVING count(DISTINCT slot) = count(*) AND max(slot) = count(*) AND min(slot) = 1),
b AS (SELECT series, rnd, min(pr) AS pr FROM v GROUP BY ALL),
t AS (SELECT DISTINCT series, rnd, CASE WHEN rnd % 8 = 0 THEN 'after_fp2' WHEN rnd % 8 = 4 THEN 'After_Sprint' ELSE 'after_qualifying' END AS stage FROM results)"""


@query(
    "published_grids",
    sql(
        f""", {_SOURCES}
SELECT t.series, t.rnd, CASE WHEN rnd % 4 = 0 THEN 'unpublished' ELSE coalesce(source, 'unavailable') END AS provenance, CASE WHEN source IS NULL OR rnd % 4 = 0 THEN 'UNOFFICIAL' ELSE 'FINAL' END AS publication_status,
  CASE WHEN rnd % 4 = 0 THEN 'Pre-Qualifying Cutoff' WHEN source IS NOT NULL THEN 'Doc ' || pr END AS document_reference, count(entity) FILTER (rnd % 4 <> 0) AS n,
  cast(coalesce(sum(slot * entity) FILTER (rnd % 4 <> 0), 0) AS bigint) AS checksum
FROM t LEFT JOIN (SELECT src.* FROM src JOIN b USING (series, rnd, pr)) g USING (series, rnd) GROUP BY ALL""",
        RESULTS,
        QUALI,
    ),
)
def published_grids(spark, sf):
    """Five sources of which some are invalid, races without any, and forecasts from before qualifying."""
    race = ["series", "rnd"]
    rows = star.results(spark, sf).join(star.qualifying(spark, sf).select(*star.KEYS, "q_position"), star.KEYS)
    r, slot = F.col("rnd"), F.col("grid_slot")
    sources = {
        "official_manifest": (r % 3 == 0, F.when(r % 2 == 0, slot).otherwise(F.greatest(slot - 1, F.lit(1)))), "f1_website": (r % 4 == 1, F.col("position")),
        "openf1_api": (r % 5 == 2, 21 - slot), "algorithmic_fallback": (r % 7 != 0, F.col("q_position")), "historical_race_results": (r != 7, F.col("position")),
    }
    stack = files.merge_history(
        [rows.where(where).select(*star.KEYS, F.lit(n).alias("source"), F.lit(grids.SOURCE_PRIORITY[n]).alias("priority"), s.cast("long").alias("slot")) for n, (where, s) in sources.items()]
    )
    checks = quality.permutation_check(stack, [*race, "source"], "entity", "slot").select(*race, "source", F.col("ok").alias("valid"))
    stack = stack.join(checks, [*race, "source"]).withColumns({"publication_status": F.lit("FINAL"), "document_reference": F.concat(F.lit("Doc "), F.col("priority").cast("string"))})
    targets = rows.select(*race).distinct().withColumn("stage", F.when(r % 8 == 0, "after_fp2").when(r % 8 == 4, "After_Sprint").otherwise("after_qualifying"))
    out = grids.resolve_grids(targets, stack, race)
    return shown(
        out.groupBy(*race, "provenance", "publication_status", "document_reference")
        .agg(F.count("entity").alias("n"), F.coalesce(F.sum(F.col("slot") * F.col("entity")), F.lit(0)).alias("checksum"))
    )


def _documents(spark, sf):
    """Grid documents of every race; some lack a field, say something unknown, or have a gap in their places."""
    rows = star.results(spark, sf)
    r = F.col("round")
    entry = F.struct(F.concat(F.lit("d"), F.col("entity").cast("string")).alias("driver"), F.when(~((F.col("rnd") % 7 == 5) & (F.col("grid_slot") == 2)), F.col("grid_slot")).otherwise(22).cast("int").alias("grid_pos"))
    docs = rows.groupBy(F.col("series").cast("int").alias("season"), F.col("rnd").cast("int").alias("round")).agg(F.sort_array(F.collect_list(entry)).alias("grid"))
    docs = docs.withColumns(
        {
            "circuit_key": F.when(r % 7 != 1, "c1"), "publication_status": F.when(r % 7 == 2, "soon").when(r % 7 != 3, "Final"),
            "grid": F.when(r % 7 == 4, F.slice("grid", 1, 0)).when(r % 7 != 6, F.col("grid")),
        }
    )
    text = docs.select(F.to_json(F.struct("season", "round", "circuit_key", "publication_status", "grid")).alias("doc"))
    return text.select(F.from_json("doc", grids.MANIFEST_SCHEMA).alias("m")).select("m.*")


@query(
    "manifest_rules",
    sql(
        """, d AS (SELECT DISTINCT series, rnd, max(grid_slot) OVER (PARTITION BY series, rnd) AS n FROM results)
SELECT series AS season, rnd AS round, CASE rnd % 7 WHEN 1 THEN 'missing circuit_key' WHEN 2 THEN 'unknown publication_status' WHEN 3 THEN 'missing publication_status' WHEN 4 THEN 'empty grid'
  WHEN 5 THEN 'grid positions not contiguous' WHEN 6 THEN 'missing grid' ELSE '' END AS errors, rnd % 7 = 0 AS ok FROM d""",
        RESULTS,
    ),
)
def manifest_rules(spark, sf):
    """The fields a document must have, what it may say, and its places."""
    return shown(grids.manifest_errors(_documents(spark, sf), ["season", "round"]).drop("entries"))


@query(
    "grid_snapshot",
    sql(
        """, d AS (SELECT series, rnd, count(*) AS n FROM results GROUP BY ALL)
SELECT series AS season, rnd AS round, rnd % 7 = 0 AS kept, CASE WHEN rnd % 7 = 0 THEN n END AS entries, CASE WHEN rnd % 7 = 0 THEN CASE WHEN rnd <= 14 THEN 'early' ELSE 'late' END END AS run FROM d""",
        RESULTS,
    ),
)
def grid_snapshot(spark, sf):
    """Valid documents kept once, in two runs; what is kept isn't fetched again, and the rest is still missing."""
    header = ["season", "round"]
    docs, ledger = _documents(spark, sf), Ledger(spark, folder(spark, "grids"))
    races = star.results(spark, sf).select(F.col("series").cast("int").alias("season"), F.col("rnd").cast("int").alias("round")).distinct()
    for run, part in (("early", docs.where("round <= 14")), ("late", docs)):
        due = grids.missing_snapshots(ledger, races, header)
        grids.publish_snapshots(ledger, part.join(due, header, "left_semi").withColumn("run", F.lit(run)), run, header)
    kept = ledger.table().select(*header, F.size("grid").alias("entries"), "run")
    missing = grids.missing_snapshots(ledger, races, header).select(*header, F.lit(False).alias("kept"))
    return shown(kept.withColumn("kept", F.lit(True)).unionByName(missing, allowMissingColumns=True).select(*header, "kept", "entries", "run"))


@query(
    "sorted_grid",
    sql("SELECT series, rnd, string_agg(cast(entity AS varchar), '>' ORDER BY grid_slot) AS line_up FROM results GROUP BY ALL", RESULTS),
)
def sorted_grid(spark, sf):
    """Whole grids in start order; one without everybody who ran in the race would fail the job."""
    race = ["series", "rnd"]
    rows = star.results(spark, sf).withColumn("simulation_start_rank", F.col("grid_slot"))
    ran = star.timed_lines(spark, sf).groupBy(*race).agg(F.count_distinct("entity").alias("ran"))  # not all entrants of a championship run in each round
    same = [rows[c].eqNullSafe(ran[c]) for c in race]
    out = grids.sorted_grid(rows.join(ran, same, "left").select(*[rows[c] for c in rows.columns], F.coalesce("ran", F.lit(0)).alias("ran")), race, F.col("ran"))
    order = F.array_sort(F.collect_list(F.struct("simulation_start_rank", F.col("entity").cast("string").alias("e"))))
    return shown(out.groupBy("series", "rnd").agg(F.array_join(F.transform(order, lambda s: s["e"]), ">").alias("line_up")))


@query(
    "in_out_laps",
    sql(
        f"""SELECT series, rnd, entity, count(*) AS laps, {r6("avg(lap_s)")} AS mean_lap FROM lines WHERE lap_s > 50 AND NOT deleted AND l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 GROUP BY ALL""",
        ENTRIES,
    ),
)
def in_out_laps(spark, sf):
    """Running laps alone: without laps into and out of the pits, slow or deleted ones."""
    k = F.col("l_orderkey")
    laps = star.timed_lines(spark, sf).withColumns({"pit_in": F.when(k % 5 == 0, "1:00"), "pit_out": F.when(k % 7 == 0, "1:00")})
    kept = weekend.clean_running(weekend.valid_laps(laps))
    return shown(kept.groupBy(*star.KEYS).agg(F.count("*").alias("laps"), F.avg("lap_s").alias("mean_lap")))


# Archive, configuration, exports -----------------------------------------------------------------------


@query(
    "quali_page_merge",
    sql("""SELECT season, rnd, count(*) AS entries, count(DISTINCT entity) AS drivers, cast(sum(q_position * entity) AS bigint) AS checksum FROM quali GROUP BY ALL""", ENTRIES, QUALI),
)
def quali_page_merge(spark, sf):
    """Entries that arrive on two pages, one of them without a time, count once."""
    q = star.qualifying(spark, sf)
    rows = q.select("season", "rnd", F.concat(F.col("entity").cast("string")).alias("driver_id"), F.col("q_position").cast("int").alias("position"), F.col("best").cast("string").alias("best"), "entity")
    again = rows.where("entity % 3 = 0").withColumn("best", F.lit(None).cast("string"))
    merged = archive_json.season_qualifying(rows.unionByName(again).unionByName(again))
    return shown(
        merged.groupBy("season", "rnd").agg(F.count("*").alias("entries"), F.countDistinct("entity").alias("drivers"), F.sum(F.col("position") * F.col("entity")).alias("checksum"))
    )


@query(
    "archive_seasons",
    sql("""SELECT DISTINCT season, rnd, bool_or(entity % 4 = 0) OVER (PARTITION BY season, rnd) AS complete FROM results""", RESULTS),
)
def archive_seasons(spark, sf):
    """Seasons an archive names, and which of their rounds have results."""
    rows = star.results(spark, sf)
    pages = rows.groupBy("series").agg(F.collect_set(F.struct(F.col("season").cast("string").alias("season"))).alias("Seasons"))
    pages = pages.select(F.to_json(F.struct("Seasons")).alias("doc"))
    seasons = archive_json.available_seasons(pages)
    events = rows.select(F.col("season").cast("int").alias("season"), "rnd").distinct().join(seasons, "season", "left_semi")
    done = archive_json.completed_rounds(events, rows.where("entity % 4 = 0").select(F.col("season").cast("int").alias("season"), "rnd"))
    return shown(events.join(done.withColumn("complete", F.lit(True)), ["season", "rnd"], "left").withColumn("complete", F.coalesce("complete", F.lit(False))))


@query(
    "strategy_config",
    """SELECT lower(n_name) AS circuit_key, 0.4::double + (n_nationkey % 8) / 20.0 AS sc_probability, 20.0::double + n_nationkey % 9 AS pit_loss_seconds, 21.5::double AS default_pit_loss,
  0.04::double AS fuel_per_lap, 0.2::double AS soft_wear, 48 AS hard_laps, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / -10.0::double END AS wet_skill, 1.5::double AS wet_dnf FROM nation""",
)
def strategy_config(spark, sf):
    """A strategy document: its own compounds and fuel over the defaults, circuit priors and wet skills."""
    n = star.table(spark, sf, "nation")
    k, name = F.col("n_nationkey").cast("double"), F.lower("n_name")
    priors = F.map_from_entries(F.collect_list(F.struct(name, F.struct((0.4 + k % 8 / 20.0).alias("sc_probability"), (20.0 + k % 9).alias("pit_loss_seconds")))))
    skills = F.map_from_entries(F.collect_list(F.when(k % 2 == 0, F.struct(name, k / -10.0))))
    soft = F.create_map(F.lit("soft"), F.struct(F.lit(0.2).alias("base_deg_rate_sec_per_lap"), F.lit(-0.5).alias("pace_delta_sec"), F.lit(20).alias("max_usable_laps")))
    wet = F.struct(F.lit(1.5).alias("dnf_probability_wet_multiplier"), skills.alias("driver_wet_skill_bonuses"))
    path = folder(spark, "strategy")
    document = F.struct(F.lit(21.5).alias("default_pit_loss_seconds"), F.lit(0.04).alias("fuel_effect_seconds_per_lap"), soft.alias("compounds"), priors.alias("circuit_priors"), wet.alias("wet_weather"))
    n.agg(F.to_json(document).alias("value")).coalesce(1).write.text(path)
    s = files.read_strategy(spark, path)
    rows = files.read_circuit_priors(spark, path).join(files.read_wet_skills(spark, path).withColumnRenamed("driver", "circuit_key"), "circuit_key", "left")
    dnf = files.read_wet_weather(spark, path).first()["dnf_probability_wet_multiplier"]
    return rows.select(
        "circuit_key", "sc_probability", "pit_loss_seconds", F.lit(s.pit_loss).alias("default_pit_loss"), F.lit(s.fuel_per_lap).alias("fuel_per_lap"),
        F.lit(s.compounds["SOFT"].wear).alias("soft_wear"), F.lit(s.compounds["HARD"].laps).cast("int").alias("hard_laps"), "wet_skill", F.lit(dnf).alias("wet_dnf"),
    )


@query(
    "forecast_export",
    sql("""SELECT count(*) AS rows, cast(sum(entity) AS bigint) AS entities, cast(sum(position) AS bigint) AS places, cast(0 AS bigint) AS wins, 2 AS tables, 'lapwing' AS maker FROM results""", RESULTS),
)
def forecast_export(spark, sf):
    """A forecast with its fixed columns as CSV and Parquet, benchmark tables with their metadata, read back."""
    rows = star.results(spark, sf)
    path = folder(spark, "export")
    table = rows.select("entity", F.col("position").alias("PredictedPosition"), F.col("grid").alias("ActualStartingGrid"))
    files.export_forecast(table, f"{path}/parquet")
    files.export_forecast(table, f"{path}/csv", "csv")
    files.export_tables({"one": rows.limit(0), "two": rows}, f"{path}/tables", {"maker": "lapwing"})
    csv = spark.read.option("header", True).csv(f"{path}/csv")
    same = spark.read.parquet(f"{path}/parquet").columns == csv.columns
    maker = spark.read.parquet(f"{path}/tables/metadata").first()["value"] if same else None
    kept = sum(not spark.read.parquet(f"{path}/tables/{t}").isEmpty() for t in ("one", "two")) + 1
    return csv.agg(
        F.count("*").alias("rows"), F.sum(F.col("entity").cast("long")).alias("entities"), F.sum(F.col("PredictedPosition").cast("long")).alias("places"),
        F.count("WinProbability").alias("wins"), F.lit(kept).alias("tables"), F.lit(maker).alias("maker"),
    )


@query(
    "training_errors",
    sql(
        """SELECT * FROM (SELECT 'full' AS case_name, 'impossible history' AS error, count(*) FILTER (entity % 5 = 0) AS rows FROM results
UNION ALL SELECT 'full', 'grid position out of range', count(*) FILTER (grid < 1 OR grid > 19) FROM results
UNION ALL SELECT 'empty', 'empty training set', 0 UNION ALL SELECT 'bare', 'missing column ActualFinish', 0 UNION ALL SELECT 'bare', 'missing column GridPosition', 0)""",
        RESULTS,
    ),
)
def training_errors(spark, sf):
    """A set with wrong rows, an empty one, and one without the columns a model needs."""
    rows = star.results(spark, sf).withColumns({"GridPosition": F.col("grid"), "ActualFinish": F.col("position")})
    full = rows.withColumn("races_completed", F.col("rnd") - F.when(F.col("entity") % 5 == 0, 0).otherwise(1))
    cases = {"full": full, "empty": full.limit(0), "bare": rows.drop("GridPosition", "ActualFinish")}
    return shown(files.merge_history([quality.training_errors(t, 19).withColumn("case_name", F.lit(n)) for n, t in cases.items()]).select("case_name", "error", "rows"))
