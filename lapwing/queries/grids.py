"""Starting grids, manifests, pages, rosters and archive documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapwing.operators import grids, quality, roster
from lapwing.queries.registry import query, r6, shown
from lapwing.queries.views import QUALI, RESULTS, sql
from lapwing.sources import archive_json, star

RACE = ["series", "rnd"]


def full(spark, sf):
    return star.with_qualifying(star.with_results(star.entries(spark, sf)))


# penalties of one entrant, as several rows
PENALTIES = """
pens AS (
  SELECT series, rnd, entity, 5 AS places, 'GRID_DROP' AS kind, false AS perm FROM results WHERE (entity * 3 + rnd) % 9 = 0
  UNION ALL SELECT series, rnd, entity, 10, 'GRID_DROP', false FROM results WHERE (entity * 3 + rnd) % 9 IN (1, 0) AND (entity + rnd) % 2 = 0
  UNION ALL SELECT series, rnd, entity, 3, 'GRID_DROP', false FROM results WHERE (entity + rnd) % 5 = 2
  UNION ALL SELECT series, rnd, entity, 0, 'BACK_OF_GRID', false FROM results WHERE (entity * 2 + rnd) % 23 = 0
  UNION ALL SELECT series, rnd, entity, 0, 'PIT_LANE', false FROM results WHERE (entity + rnd * 5) % 29 = 0
  UNION ALL SELECT series, rnd, entity, 0, 'DSQ', true FROM results WHERE (entity * 5 + rnd * 2) % 31 = 0
  UNION ALL SELECT series, rnd, entity, 0, 'DNS', false FROM results WHERE (entity + rnd * 3) % 37 = 0)"""

GRID_SQL = """
pen AS (SELECT series, rnd, entity, sum(places) AS p, bool_or(kind = 'PIT_LANE') AS pit, bool_or(kind = 'BACK_OF_GRID') OR sum(places) >= 15 AS bog,
          bool_or(kind = 'DSQ') AS perm, bool_or(kind = 'DNS') AS dns FROM pens GROUP BY ALL),
g AS (
  SELECT r.series, r.rnd, r.entity, q_position AS q, coalesce(p, 0) AS p, coalesce(dns, false) OR coalesce(status = 'Did not start', false) AS dns,
    coalesce(status = 'Disqualified', false) AS dsq, coalesce(pit, false) OR r.grid = 0 AS pit, coalesce(perm, false) AS perm, coalesce(bog, false) AS bog
  FROM results r JOIN quali USING (series, rnd, entity) LEFT JOIN pen USING (series, rnd, entity)),
k AS (SELECT *, CASE WHEN dns OR dsq THEN 9 WHEN pit THEN 3 WHEN perm THEN 2 WHEN bog THEN 1 ELSE 0 END AS grp FROM g),
-- the pairwise rule, applied as written: count who lines up ahead
ahead AS (
  SELECT a.series, a.rnd, a.entity, count(b.entity) AS n FROM k a LEFT JOIN k b ON a.series = b.series AND a.rnd = b.rnd AND a.entity <> b.entity AND b.grp < 9
    AND (b.grp < a.grp OR (b.grp = a.grp AND CASE
      WHEN a.grp > 0 OR (a.p = 0 AND b.p = 0) THEN b.q < a.q
      WHEN a.p > 0 AND b.p = 0 THEN a.q + a.p >= b.q
      WHEN a.p = 0 AND b.p > 0 THEN NOT (b.q + b.p >= a.q)
      ELSE (b.q + b.p < a.q + a.p) OR (b.q + b.p = a.q + a.p AND b.q < a.q) END))
  WHERE a.grp < 9 GROUP BY ALL),
total AS (SELECT series, rnd, count(*) AS n_start FROM k WHERE grp < 9 GROUP BY ALL),
resolved AS (
  SELECT k.*, n + 1 AS rank, n_start FROM k LEFT JOIN ahead USING (series, rnd, entity) LEFT JOIN total USING (series, rnd))"""


def penalty_rows(rows):
    e, r = F.col("entity"), F.col("rnd")
    specs = [
        ((e * 3 + r) % 9 == 0, "GRID_DROP", 5, False),
        (((e * 3 + r) % 9).isin(0, 1) & ((e + r) % 2 == 0), "GRID_DROP", 10, False),
        ((e + r) % 5 == 2, "GRID_DROP", 3, False),
        ((e * 2 + r) % 23 == 0, "BACK_OF_GRID", 0, False),
        ((e + r * 5) % 29 == 0, "PIT_LANE", 0, False),
        ((e * 5 + r * 2) % 31 == 0, "DSQ", 0, True),
        ((e + r * 3) % 37 == 0, "DNS", 0, False),
    ]
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(k).alias("penalty_type"), F.lit(p).alias("places"), F.lit(a).alias("permitted_to_start"))) for c, k, p, a in specs])
    )
    return rows.select(*RACE, F.col("entity").alias("driver"), F.explode(found).alias("x")).select(*RACE, "driver", "x.*")


def resolved_grid(spark, sf):
    rows = full(spark, sf)
    entrants = rows.select(
        *RACE, F.col("entity").alias("driver"), "team", "q_position", F.col("best").alias("tie_time"), "status",
        (F.col("grid") == 0).alias("is_pit_lane"),
    )
    return grids.resolve_grid(entrants, penalty_rows(rows), RACE)


@query(
    "grid_after_penalties",
    sql(
        f"""SELECT series, rnd, entity AS driver, CASE WHEN grp < 3 THEN rank END AS actual_grid, CASE WHEN grp < 9 THEN rank END AS start_rank,
  cast(grp = 3 AS bigint) AS is_pit_lane_start, CASE WHEN grp = 9 AND dns THEN 'DNS' WHEN grp = 9 THEN 'DSQ' WHEN grp = 3 THEN 'PIT_LANE' WHEN p > 0 OR grp > 0 THEN 'PENALIZED' ELSE 'CLASSIFIED' END AS status,
  cast(CASE WHEN grp < 9 THEN p ELSE 0 END AS bigint) AS places, CASE WHEN grp < 9 THEN rank - q ELSE 0 END AS delta,
  {r6("CASE WHEN grp < 9 THEN (rank - 1) / greatest(n_start - 1, 1) END")} AS grid_norm FROM resolved""",
        RESULTS,
        QUALI,
        PENALTIES,
        GRID_SQL,
    ),
)
def grid_after_penalties(spark, sf):
    out = resolved_grid(spark, sf)
    return shown(
        out.select(
            *RACE, "driver", F.col("ActualStartingGrid").alias("actual_grid"), F.col("simulation_start_rank").alias("start_rank"),
            "is_pit_lane_start", F.col("StartingGridStatus").alias("status"), F.col("grid_penalty_places").alias("places"),
            F.col("grid_vs_quali_delta").alias("delta"), "grid_norm",
        )
    )


@query(
    "grid_permutation_check",
    sql(
        """SELECT series, rnd, count(*) AS entrants, count(DISTINCT entity) AS unique_entrants,
  list(grid ORDER BY grid) = range(1, count(*) + 1) AS is_permutation, count(*) = 20 AS size_ok,
  list(grid ORDER BY grid) = range(1, count(*) + 1) AND count(*) = 20 AS ok FROM results GROUP BY ALL""",
        RESULTS,
    ),
)
def grid_permutation_check(spark, sf):
    return shown(quality.permutation_check(star.results(spark, sf), RACE, "entity", "grid", F.lit(20)))


@query(
    "pit_lane_ranks",
    sql(
        f"""SELECT series, rnd, entity, {r6('''CASE WHEN grid = 0 THEN max(CASE WHEN grid > 0 THEN grid END) OVER (PARTITION BY series, rnd)
  + sum(cast(grid = 0 AS int)) OVER (PARTITION BY series, rnd ORDER BY entity) ELSE grid END''')} AS start_rank FROM results""",
        RESULTS,
    ),
)
def pit_lane_ranks(spark, sf):
    rows = star.results(spark, sf).withColumn("pit", (F.col("grid") == 0).cast("int"))
    rows = rows.withColumn("slot", F.when(F.col("grid") > 0, F.col("grid")))
    return shown(grids.start_ranks(rows, RACE, "slot", "pit").select(*star.KEYS, "start_rank"))


@query(
    "grid_source_priority",
    sql(
        """, src AS (
  SELECT series, rnd, entity, 1 AS pr, 'official_manifest' AS source, CASE WHEN rnd % 2 = 0 THEN grid_slot ELSE greatest(grid_slot - 1, 1) END AS slot FROM results WHERE rnd % 3 = 0
  UNION ALL SELECT series, rnd, entity, 4, 'algorithmic_fallback', q_position FROM quali WHERE rnd % 5 <> 0
  UNION ALL SELECT series, rnd, entity, 5, 'historical_race_results', position FROM results),
v AS (SELECT series, rnd, source, pr FROM src GROUP BY ALL HAVING count(DISTINCT slot) = count(*) AND max(slot) = count(*) AND min(slot) = 1),
b AS (SELECT series, rnd, min(pr) AS pr FROM v GROUP BY ALL)
SELECT src.series, src.rnd, source, CASE source WHEN 'official_manifest' THEN 'FIA Official Final Starting Grid (Doc 7)'
   WHEN 'algorithmic_fallback' THEN 'Algorithmic Provisional Grid (FIA Art 42.3)' ELSE 'Historical Race Results Starting Grid (Doc 7)' END AS display,
  count(*) AS n, cast(sum(slot * entity) AS bigint) AS checksum FROM src JOIN b USING (series, rnd, pr) GROUP BY ALL""",
        RESULTS,
        QUALI,
    ),
)
def grid_source_priority(spark, sf):
    rows = full(spark, sf)
    dup = F.when(F.col("rnd") % 2 == 0, F.col("grid_slot")).otherwise(F.greatest(F.col("grid_slot") - 1, F.lit(1)))
    # a source that does not cover a round has no slots there, which makes it invalid
    sources = [
        ("official_manifest", F.when(F.col("rnd") % 3 == 0, dup)),
        ("algorithmic_fallback", F.when(F.col("rnd") % 5 != 0, F.col("q_position"))),
        ("historical_race_results", F.col("position")),
    ]
    stack = None
    for name, slot in sources:
        part = rows.select(*star.KEYS, F.lit(name).alias("source"), F.lit(grids.SOURCE_PRIORITY[name]).alias("priority"), slot.cast("long").alias("slot"))
        stack = part if stack is None else stack.unionByName(part)
    checks = quality.permutation_check(stack, RACE + ["source"], "entity", "slot").select(*RACE, "source", F.col("ok").alias("valid"))
    best = grids.pick_source(stack.join(checks, RACE + ["source"]), RACE)
    text = grids.provenance_text(F.col("source"), F.lit("FINAL"), F.lit("Doc 7"), F.lit(None).cast("string"))
    out = best.groupBy(*RACE, "source", text.alias("display")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("slot") * F.col("entity")).alias("checksum"))
    return shown(out)


@query(
    "shared_car_grid",
    sql(
        f""", c AS (SELECT series, rnd, entity, team, CASE WHEN rnd % 3 = 0 THEN team ELSE entity + 100000000 END AS car,
    CASE WHEN rnd % 3 = 0 THEN team % 10 + 1 ELSE grid END AS g FROM results),
k AS (SELECT series, rnd, car, g, count(*) AS n, string_agg('D' || entity, ' / ' ORDER BY 'D' || entity) AS driver, string_agg('D' || entity, ',' ORDER BY 'D' || entity) AS shared_drivers FROM c GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY series, rnd) AS cars FROM k)
SELECT series, rnd, cast(car AS varchar) AS car_key, driver, {r6("CASE WHEN g > 0 THEN g END")} AS actual_grid, {r6("CASE WHEN g > 0 THEN g ELSE cars END")} AS start_rank,
  cast(g <= 0 AS bigint) AS is_pit_lane_start, n > 1 AS is_shared_drive, n = 1 AS is_starter_resolved, shared_drivers,
  {r6("((CASE WHEN g > 0 THEN g ELSE cars END) - 1) / (cars - 1)")} AS grid_norm FROM f""",
        RESULTS,
    ),
)
def shared_car_grid(spark, sf):
    r3 = F.col("rnd") % 3 == 0
    rows = star.results(spark, sf).select(
        *RACE,
        F.when(r3, F.col("team")).otherwise(F.col("entity") + 100_000_000).alias("car"),
        F.when(r3, F.col("team") % 10 + 1).otherwise(F.col("grid")).alias("grid"),
        F.concat(F.lit("d"), F.col("entity").cast("string")).alias("driver"),
        F.col("team").cast("string").alias("team"),
    )
    out = grids.shared_car_grid(rows, RACE)
    return shown(
        out.select(
            *RACE, "car_key", "driver", F.col("ActualStartingGrid").alias("actual_grid"), F.col("simulation_start_rank").alias("start_rank"),
            "is_pit_lane_start", "is_shared_drive", "is_starter_resolved", "shared_drivers", "grid_norm",
        )
    )


@query(
    "driver_participations",
    sql(
        """, c AS (SELECT series, rnd, entity, CASE WHEN rnd % 3 = 0 THEN team ELSE entity + 100000000 END AS car, CASE WHEN rnd % 3 = 0 THEN team % 10 + 1 ELSE grid END AS g FROM results)
SELECT series, rnd, entity, CASE WHEN count(*) OVER (PARTITION BY series, rnd, car, g) > 1 THEN 'shared_unresolved' ELSE 'solo_starter' END AS role FROM c""",
        RESULTS,
    ),
)
def driver_participations(spark, sf):
    r3 = F.col("rnd") % 3 == 0
    rows = star.results(spark, sf).select(
        *star.KEYS, F.when(r3, F.col("team")).otherwise(F.col("entity") + 100_000_000).alias("car"),
        F.when(r3, F.col("team") % 10 + 1).otherwise(F.col("grid")).alias("grid"),
    )
    return shown(grids.participations(rows, RACE).select(*star.KEYS, "role"))


def manifest_docs(spark, sf):
    """Manifest documents written from the results, some fields left out on purpose."""
    rows = full(spark, sf)
    pit = F.col("grid") == 0
    entry = F.struct(
        F.concat(F.lit(" d"), F.col("entity").cast("string")).alias("driver"),
        F.when(F.col("entity") % 4 != 0, F.concat(F.lit("T"), F.col("team").cast("string"))).alias("team"),
        F.col("q_position").cast("int").alias("qualifying_pos"),
        F.when(~pit, F.col("grid_slot").cast("int")).alias("grid_pos"),
        F.when(pit, F.lit(1)).alias("is_pit_lane_start"),
    )
    header = [F.col("series").cast("int").alias("season"), F.col("rnd").cast("int").alias("round"), F.lit("c1").alias("circuit_key")]
    body = F.struct(*header, F.lit("FINAL").alias("publication_status"), F.lit("Doc 7").alias("document_reference"), F.col("grid"))
    docs = rows.groupBy(*RACE).agg(F.sort_array(F.collect_list(entry)).alias("grid"))
    text = docs.select(F.to_json(body).alias("doc"))
    return text.select(F.from_json("doc", grids.MANIFEST_SCHEMA).alias("m")).select("m.*")


@query(
    "manifest_flatten",
    sql(
        f""", m AS (SELECT r.series, r.rnd, r.entity, r.team, grid, grid_slot, q_position, count(*) OVER (PARTITION BY r.series, r.rnd) AS n FROM results r JOIN quali USING (series, rnd, entity)),
x AS (SELECT *, CASE WHEN grid > 0 THEN grid_slot ELSE n END AS rank FROM m)
SELECT series AS season, rnd AS round, 'D' || entity AS driver, CASE WHEN entity % 4 <> 0 THEN 'T' || team ELSE 'Unknown' END AS team,
  {r6("q_position")} AS q, {r6("CASE WHEN grid > 0 THEN grid_slot END")} AS grid, {r6("rank")} AS start_rank, cast(grid = 0 AS bigint) AS is_pit_lane_start,
  CASE WHEN grid = 0 THEN 'PIT_LANE' ELSE 'CLASSIFIED' END AS status, CASE WHEN grid > 0 THEN grid_slot - q_position ELSE 0 END AS delta, {r6("(rank - 1) / (n - 1)")} AS grid_norm FROM x""",
        RESULTS,
        QUALI,
    ),
)
def manifest_flatten(spark, sf):
    flat = grids.flatten_manifests(manifest_docs(spark, sf))
    return shown(
        flat.select(
            "season", "round", "driver", "team", F.col("QualifyingPosition").alias("q"), F.col("ActualStartingGrid").alias("grid"),
            F.col("simulation_start_rank").alias("start_rank"), "is_pit_lane_start", F.col("StartingGridStatus").alias("status"),
            F.col("grid_vs_quali_delta").alias("delta"), "grid_norm",
        )
    )


@query(
    "manifest_validation",
    sql(
        """SELECT series AS season, rnd AS round, count(*) AS entries,
  CASE WHEN max(CASE WHEN grid > 0 THEN grid_slot END) <> count(*) FILTER (grid > 0) THEN 'grid positions not contiguous' ELSE '' END AS errors,
  max(CASE WHEN grid > 0 THEN grid_slot END) = count(*) FILTER (grid > 0) AS ok FROM results GROUP BY ALL""",
        RESULTS,
    ),
)
def manifest_validation(spark, sf):
    return shown(grids.manifest_errors(manifest_docs(spark, sf)).drop("circuit_key"))


@query(
    "manifest_build",
    sql(
        """, s AS (SELECT *, row_number() OVER (PARTITION BY series, rnd ORDER BY grid_slot) AS k FROM results)
SELECT series, rnd, count(*) AS entries, string_agg('D' || entity, '>' ORDER BY k) AS line_up FROM s GROUP BY ALL""",
        RESULTS,
    ),
)
def manifest_build(spark, sf):
    rows = star.results(spark, sf).select(
        *RACE,
        F.col("grid_slot").cast("int").alias("simulation_start_rank"),
        F.concat(F.lit("D"), F.col("entity").cast("string")).alias("driver"),
        F.col("team").cast("string").alias("team"),
        F.lit(None).cast("int").alias("qualifying_pos"),
        F.col("grid_slot").cast("int").alias("grid_pos"),
        F.lit(0).alias("is_pit_lane_start"),
        F.lit("CLASSIFIED").alias("status"),
    )
    docs = grids.build_manifests(rows, RACE)
    parsed = F.from_json("document", f"grid array<{grids._struct(grids.ENTRY_SCHEMA)}>")["grid"]
    return shown(docs.select(*RACE, F.size(parsed).alias("entries"), F.array_join(F.transform(parsed, lambda e: e["driver"]), ">").alias("line_up")))


@query(
    "api_snapshot_flatten",
    sql(
        f""", n AS (SELECT r.series, r.rnd, entity, r.grid, grid_slot, q_position, count(*) OVER (PARTITION BY r.series, r.rnd) AS n,
    CASE WHEN entity % 3 = 0 THEN 'Q' || entity WHEN entity % 3 = 1 THEN 'F' || entity WHEN entity % 2 = 0 THEN 'C' || entity ELSE 'D' || entity END AS driver,
    CASE WHEN entity % 3 = 0 THEN 'qt' WHEN entity % 3 = 1 THEN 'ft' WHEN entity % 2 = 0 THEN 'ct' ELSE 'Unknown' END AS team FROM results r JOIN quali USING (series, rnd, entity)),
x AS (SELECT *, CASE WHEN grid > 0 THEN grid_slot END AS g, CASE WHEN grid > 0 THEN grid_slot ELSE n END AS rank,
    coalesce(CASE WHEN entity % 3 = 0 THEN q_position END, CASE WHEN grid > 0 THEN grid_slot END) AS q FROM n)
SELECT series, rnd, driver, team, {r6("q")} AS q, {r6("g")} AS grid, {r6("rank")} AS start_rank, cast(grid = 0 AS bigint) AS is_pit_lane_start,
  CASE WHEN grid = 0 THEN 'PIT_LANE' WHEN g > q THEN 'PENALIZED' ELSE 'CLASSIFIED' END AS status, cast(coalesce(coalesce(g, rank) - q, 0) AS bigint) AS delta FROM x""",
        RESULTS,
        QUALI,
    ),
)
def api_snapshot_flatten(spark, sf):
    rows = full(spark, sf)
    e = F.col("entity")
    tag = lambda p: F.concat(F.lit(p), e.cast("string"))
    slot = F.struct(F.when(F.col("grid") > 0, F.col("grid_slot").cast("int")).alias("position"), e.cast("int").alias("driver_number"))
    person = F.when(e % 3 == 1, F.struct(e.cast("int").alias("driver_number"), tag("f").alias("name_acronym"), F.lit("ft").alias("team_name")))
    docs = rows.groupBy(*RACE).agg(F.sort_array(F.collect_list(slot)).alias("grid"), F.array_compact(F.collect_list(person)).alias("drivers"))
    text = docs.select(*RACE, F.to_json(F.struct("grid", "drivers")).alias("doc"))
    snaps = text.select(*RACE, F.from_json("doc", grids.API_SCHEMA).alias("s")).select(*RACE, "s.grid", "s.drivers")
    known = lambda c: F.when(e % 3 == 0, c)
    quali = rows.select(
        *RACE, e.alias("number"), known(tag("q")).alias("driver"), known(F.lit("qt")).alias("team"), "q_position"
    )
    s = star.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("number"))
    listed = F.col("number") % 2 == 0
    catalogue = s.select(
        "number",
        F.when(listed, F.concat(F.lit("C"), F.col("number").cast("string"))).alias("driver"),
        F.when(listed, F.lit("ct")).alias("team"),
    )
    flat = grids.flatten_api_grid(snaps, quali, catalogue, RACE)
    return shown(
        flat.select(
            *RACE, "driver", "team", F.col("QualifyingPosition").alias("q"), F.col("ActualStartingGrid").alias("grid"),
            F.col("simulation_start_rank").alias("start_rank"), "is_pit_lane_start", F.col("StartingGridStatus").alias("status"),
            F.col("grid_vs_quali_delta").alias("delta"),
        )
    )


@query(
    "html_rows",
    """SELECT page_id, line - 1 AS line, trim(regexp_replace(items[line], '<[^>]+>', '', 'g')) AS text
FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM pages), unnest(range(1, len(items) + 1)) u(line)""",
)
def html_rows(spark, sf):
    return shown(grids.page_items(star.table(spark, sf, "pages"), ["page_id"], "li"))


@query(
    "grid_page_parse",
    sql(
        f""", c AS (SELECT *, count(*) OVER (PARTITION BY series, rnd) AS n, grid = 0 OR entity % 20 = rnd % 20 AS pit FROM results),
r AS (SELECT *, row_number() OVER (PARTITION BY series, rnd ORDER BY pit, CASE WHEN NOT pit THEN grid_slot END NULLS LAST, entity) AS rank FROM c)
SELECT series, rnd, chr(cast(65 + entity % 20 AS int)) || 'XY' AS driver, 'Name ' || entity || ' Jr' AS full_name, cast(entity AS varchar) AS number, 'T' || team AS team,
  CASE WHEN NOT pit THEN grid_slot END AS grid_pos, rank AS start_rank, cast(pit AS bigint) AS is_pit_lane_start, {r6("(rank - 1) / (n - 1)")} AS grid_norm FROM r""",
        RESULTS,
    ),
)
def grid_page_parse(spark, sf):
    rows = star.results(spark, sf)
    e = F.col("entity").cast("string")
    code = F.concat(F.char(F.lit(65) + F.col("entity") % 20), F.lit("XY"))
    slot = F.when(F.col("grid") == 0, "PL").otherwise(F.col("grid_slot").cast("string"))
    line = F.concat(F.lit("<tr class='r'>\n<td>"), slot, F.lit("</td><td>"), e, F.lit("</td><td><b>Name "), e, F.lit(" Jr</b><i>"), code,
                    F.lit("</i></td><td> T"), F.col("team").cast("string"), F.lit("</td></tr>"))
    noted = F.max(F.when(F.col("entity") % 20 == F.col("rnd") % 20, F.concat(F.lit("Name "), e, F.lit(" Jr started from the PIT LANE"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity", line.alias("l")))), lambda x: x["l"]), "\n")
    pages = rows.groupBy(*RACE).agg(body.alias("body"), noted.alias("note")).select(
        *RACE, F.concat(F.lit("<html><TABLE><tr><th>Pos</th><th>No</th><th>Driver</th><th>Team</th></tr>"), "body", F.lit("</table><p>Note - "),
                        F.coalesce("note", F.lit("none")), F.lit(" OUR PARTNERS x</p></html>")).alias("html")
    )
    out = grids.parse_grid_pages(pages, RACE)
    return shown(out.withColumnRenamed("simulation_start_rank", "start_rank"))


@query(
    "roster_resolve",
    sql(
        """, l AS (SELECT series, entity, team, entity % 20 AS k FROM results WHERE rnd = 28),
prac AS (SELECT * FROM l WHERE series % 4 = 2 OR k < 9),
cand AS (
  SELECT series, entity, team, 1 AS p, 'official_entry_list' AS source, 'verified' AS confidence FROM l WHERE series % 4 = 0 AND k <> 3
  UNION ALL SELECT series, entity, team, 3, 'qualifying', 'high' FROM l WHERE CASE WHEN series % 4 = 1 THEN k <= 15 ELSE k <> 7 END
  UNION ALL SELECT series, entity, team, 4, 'practice', 'high' FROM prac
  UNION ALL SELECT DISTINCT series, entity, team, 5, 'season_pool', 'provisional' FROM results WHERE rnd < 28),
n AS (SELECT series, p, count(*) AS n FROM cand GROUP BY ALL),
best AS (SELECT series, min(p) AS b FROM n WHERE (p = 1 AND n >= 18) OR (p = 3 AND series % 4 <> 2 AND n >= 18) OR (p = 4 AND n >= 20) OR p = 5 GROUP BY series)
SELECT series, entity AS driver, team, source, confidence FROM cand JOIN best USING (series)
WHERE (p = b AND NOT (p = 5 AND entity IN (SELECT entity FROM prac))) OR (b = 5 AND p = 4)""",
        RESULTS,
    ),
)
def roster_resolve(spark, sf):
    rows = star.results(spark, sf)
    k, s4 = F.col("entity") % 20, F.col("series") % 4
    last = rows.where(F.col("rnd") == 28).select("series", "team", F.col("entity").alias("driver"), k.alias("k"), s4.alias("s4"))
    prior = rows.where(F.col("rnd") < 28).select(
        "series", "team", F.col("entity").alias("driver"), F.col("rnd").alias("rnd_seen"), F.lit(0).alias("kind"), F.col("entity").alias("ordinal")
    )
    pool = roster.season_pool(prior, ["series"]).select("series", "team", "driver", F.lit("season_pool").alias("source"))
    seats = lambda cond, name: last.where(cond).select("series", "team", "driver", F.lit(name).alias("source"))
    c4, ck = F.col("s4"), F.col("k")
    candidates = (
        seats((c4 == 0) & (ck != 3), "official_entry_list")
        .unionByName(seats(F.when(c4 == 1, ck <= 15).otherwise(ck != 7), "qualifying"))
        .unionByName(seats((c4 == 2) | (ck < 9), "practice"))
        .unionByName(pool)
    )
    races = rows.select("series").distinct().select(
        "series", F.lit(20).alias("expected"), F.when(F.col("series") % 4 == 2, "after_fp1").otherwise("after_qualifying").alias("stage")
    )
    return shown(roster.resolve_roster(candidates, races, ["series"]))


# archive documents ---------------------------------------------------------------------------------


def result_pages(spark, sf):
    """Archive result pages written from the results: one document per race and half field, one entry repeated."""
    rows = star.archive(star.entries(spark, sf))
    e = F.col("entity").cast("string")
    text = lambda c: F.col(c).cast("string")
    entry = F.struct(
        F.when(F.col("position_text").rlike("^\\d+$"), text("position")).alias("position"),
        F.col("position_text").alias("positionText"),
        e.alias("number"),
        text("grid").alias("grid"),
        F.when(F.col("entity") % 5 != 0, F.lit("57")).otherwise("n/a").alias("laps"),
        text("points").alias("points"),
        F.col("status").alias("status"),
        F.struct(e.alias("driverId"), F.when(F.col("entity") % 3 == 0, F.lit("Ann")).alias("givenName"), F.concat(F.lit("F"), e).alias("familyName")).alias("Driver"),
        F.struct(F.col("constructor").alias("constructorId")).alias("Constructor"),
    )
    half = F.when(F.col("entity") % 20 < 10, 0).otherwise(1)
    pages = rows.withColumn("page", F.explode(F.when(F.col("entity") % 20 == 9, F.array(F.lit(0), F.lit(1))).otherwise(F.array(half))))
    docs = pages.groupBy("series", "season", "rnd", "page").agg(F.sort_array(F.collect_list(entry)).alias("Results"))
    race = F.struct(text("season").alias("season"), (F.col("rnd") + F.col("series") * 100).cast("string").alias("round"), F.col("Results"))
    return docs.select(F.to_json(F.struct(F.array(race).alias("Races"))).alias("doc"))


@query(
    "archive_results_parse",
    sql(
        f""", a AS (SELECT series, season - 3 AS season, rnd + series * 100 AS rnd, entity, team, grid, points, coalesce(status, 'Unknown') AS status,
    CASE WHEN status IN ('Engine', 'Collision') THEN 'R' WHEN status = 'Did not start' THEN 'W' WHEN status = 'Disqualified' THEN 'D' WHEN status = 'NC' THEN 'N' ELSE cast(position AS varchar) END AS position_text FROM results),
b AS (SELECT *, TRY_CAST(position_text AS bigint) AS position FROM a)
SELECT season, rnd, cast(entity AS varchar) AS driver_id, position, position_text,
  CASE WHEN entity % 3 = 0 THEN 'Ann F' || entity ELSE 'F' || entity END AS driver_name, 'Team ' || team AS constructor_name, CASE WHEN grid > 0 THEN grid END AS grid,
  CASE WHEN grid > 0 AND position > 0 THEN grid - position END AS positions_gained, cast(CASE WHEN entity % 5 <> 0 THEN 57 ELSE 0 END AS bigint) AS laps, {r6("points")} AS points, status,
  row_number() OVER (PARTITION BY season, rnd ORDER BY CASE WHEN grid > 0 THEN grid END NULLS LAST, cast(entity AS varchar)) AS start_order,
  CASE WHEN grid > 0 THEN 'Grid P' || grid ELSE 'Unclassified / Non-standard Grid Position (0)' END AS grid_status FROM b""",
        RESULTS,
    ),
)
def archive_results_parse(spark, sf):
    rows = archive_json.season_classifications(archive_json.race_results(result_pages(spark, sf)))
    lines = archive_json.starting_grids(rows).select("season", "rnd", "driver_id", "start_order", "grid_status")
    out = rows.join(lines, ["season", "rnd", "driver_id"])
    return shown(
        out.select(
            "season", "rnd", "driver_id", "position", "position_text", "driver_name", "constructor_name", "grid", "positions_gained",
            "laps", "points", "status", "start_order", "grid_status",
        )
    )


_QTEXT = "printf('%d:%02d.%03d', {0} // 60000, ({0} // 1000) % 60, {0} % 1000)"
_QDOC_SQL = f"""
qd AS (SELECT series, season - 3 AS season, rnd + series * 100 AS rnd, entity, team, q_position AS pos, cast(floor(q1 * 1000) AS bigint) AS m1,
    cast(floor(q2 * 1000) AS bigint) AS m2, CASE WHEN q_position <= 10 THEN cast(floor(q3 * 1000) AS bigint) END AS m3 FROM quali),
qb AS (SELECT *, coalesce(m3, m2, m1) AS ms FROM qd),
qp AS (SELECT *, max(CASE WHEN pos = 1 THEN ms END) OVER (PARTITION BY season, rnd) AS pole FROM qb)"""


def quali_docs(spark, sf):
    rows = star.archive(star.entries(spark, sf))
    e = F.col("entity").cast("string")

    def clock(c):
        ms = F.floor(F.col(c) * 1000)
        return F.when(F.col(c).isNotNull(), F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000))

    return rows.select(
        "series", "season", (F.col("rnd") + F.col("series") * 100).alias("rnd"), F.col("q_position").cast("string").alias("position"), e.alias("e"),
        F.col("constructor"), clock("q1").alias("Q1"), clock("q2").alias("Q2"),
        F.when(F.col("q_position") <= 10, clock("q3")).alias("Q3"),
    )


@query(
    "archive_quali_parse",
    sql(
        f"""SELECT season, rnd, cast(entity AS varchar) AS driver_id, pos AS position, 'Team ' || team AS constructor_name, {_QTEXT.format("ms")} AS best,
  CASE WHEN pos > 1 AND ms >= pole THEN printf('+%.3f', (ms - pole) / 1000.0) END AS gap_to_pole, 'Qualifying Best Lap (QB)' AS session_format, 'QB' AS session_code
FROM qp WHERE season >= 1994""",
        RESULTS,
        QUALI,
        _QDOC_SQL,
    ),
)
def archive_quali_parse(spark, sf):
    rows = quali_docs(spark, sf)
    entry = F.struct(
        "position",
        F.struct(F.col("e").alias("driverId")).alias("Driver"),
        F.struct(F.lit("x").alias("constructorId"), F.col("constructor").alias("name")).alias("Constructor"),
        "Q1",
        "Q2",
        "Q3",
    )
    docs = rows.groupBy("season", "rnd").agg(F.sort_array(F.collect_list(entry)).alias("QualifyingResults"))
    race = F.struct(F.col("season").cast("string").alias("season"), F.col("rnd").cast("string").alias("round"), F.col("QualifyingResults"))
    pages = docs.select(F.to_json(F.struct(F.array(race).alias("Races"))).alias("doc"))
    out = archive_json.qualifying_results(pages)
    return shown(out.select("season", "rnd", "driver_id", "position", "constructor_name", "best", "gap_to_pole", "session_format", "session_code"))


@query(
    "archive_alt_quali_parse",
    sql(
        f"""SELECT season, rnd, cast(entity AS varchar) AS driver_id, pos AS position, {_QTEXT.format("ms")} AS best,
  CASE WHEN pos > 1 AND ms >= pole THEN printf('+%.3f', (ms - pole) / 1000.0) END AS gap_to_pole,
  CASE rnd % 4 WHEN 0 THEN 'Qualifying Aggregate (QA)' WHEN 1 THEN 'Qualifying Shootout Order (QO)' WHEN 2 THEN 'Qualifying Best Lap (QB)'
    ELSE CASE WHEN m3 IS NOT NULL OR m2 IS NOT NULL THEN 'Knockout' ELSE 'Single Session' END END AS session_format FROM qp""",
        RESULTS,
        QUALI,
        _QDOC_SQL,
    ),
)
def archive_alt_quali_parse(spark, sf):
    rows = quali_docs(spark, sf)
    part = lambda q: F.when(F.col(q).isNotNull(), F.struct(F.col(q).alias("time"))).alias(q)
    entry = F.struct("position", F.struct(F.col("e").alias("id")).alias("driver"), F.struct(part("Q1"), part("Q2"), part("Q3")).alias("components"))
    r4 = F.col("rnd") % 4
    kind = F.when(r4 == 0, "qa").when(r4 == 1, "QO").when(r4 == 2, "QB")
    docs = rows.groupBy("season", "rnd").agg(F.sort_array(F.collect_list(entry)).alias("results"))
    text = docs.select(F.to_json(F.struct("season", F.col("rnd").alias("round"), kind.alias("session_type"), "results")).alias("doc"))
    parsed = text.select(F.from_json("doc", archive_json.ALT_QUALIFYING_SCHEMA).alias("d")).select("d.*")
    out = archive_json.alt_qualifying_results(parsed)
    return shown(out.select("season", "rnd", "driver_id", "position", "best", "gap_to_pole", "session_format"))


@query(
    "archive_calendar_parse",
    """WITH ev AS (SELECT o_custkey // 60 AS scope, year(o_orderdate) AS season, month(o_orderdate) AS rnd, min(o_orderdate) AS d FROM orders GROUP BY ALL)
SELECT season, rnd + scope * 100 AS rnd, CASE WHEN rnd % 6 = 0 THEN 'Round ' || (rnd + scope * 100) ELSE 'GP ' || rnd END AS event_name, 'c' || (rnd % 5) AS circuit_id,
  CASE WHEN rnd % 7 = 0 THEN 'Date Unknown' WHEN d < TIMESTAMP '1998-06-15' THEN 'Scheduled (Past Date)' ELSE 'Upcoming' END AS status_label FROM ev""",
)
def archive_calendar_parse(spark, sf):
    o = star.table(spark, sf, "orders")
    ev = o.groupBy(F.floor(F.col("o_custkey") / 60).cast("long").alias("scope"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("m")).agg(
        F.min("o_orderdate").alias("d")
    )
    r = F.col("m")
    race = F.struct(
        F.col("season").cast("string").alias("season"),
        (r + F.col("scope") * 100).cast("string").alias("round"),
        F.when(r % 6 != 0, F.concat(F.lit("GP "), r.cast("string"))).alias("raceName"),
        F.when(r % 7 != 0, F.date_format("d", "yyyy-MM-dd")).alias("date"),
        F.struct(F.concat(F.lit("c"), (r % 5).cast("string")).alias("circuitId")).alias("Circuit"),
    )
    pages = ev.groupBy("scope", "season").agg(F.to_json(F.struct(F.collect_list(race).alias("Races"))).alias("doc"))
    out = archive_json.calendar(pages, F.lit("1998-06-15 12:00:00").cast("timestamp"))
    return shown(out.select("season", "rnd", "event_name", "circuit_id", "status_label"))


@query(
    "archive_circuits_parse",
    """SELECT 's' || s_suppkey AS circuit_id, s_name AS name, n_name AS locality, r_name AS country,
  (floor(CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END * 1e6 + 0.5000123) / 1e6) AS latitude
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def archive_circuits_parse(spark, sf):
    s = star.table(spark, sf, "supplier")
    n = star.table(spark, sf, "nation")
    r = star.table(spark, sf, "region")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    place = F.struct(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("circuitId"),
        F.col("s_name").alias("circuitName"),
        F.struct(
            F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal").cast("string")).otherwise("north").alias("lat"),
            F.col("n_name").alias("locality"),
            F.col("r_name").alias("country"),
        ).alias("Location"),
    )
    pages = rows.select(F.to_json(F.struct(F.array(place, place).alias("Circuits"))).alias("doc"))
    return shown(archive_json.circuits(pages).drop("longitude"))
