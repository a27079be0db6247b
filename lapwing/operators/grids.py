"""Starting grids: penalties, sources, manifests and shared cars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.numbers import position_norm
from lapwing.functions.status import count_if
from lapwing.operators.quality import keep_first
from lapwing.sources.ledger import Ledger, State, new_rows

BACK_OF_GRID_PLACES = 15
UNKNOWN_POSITION = 999.0

PENALTY_SCHEMA = "driver string, penalty_type string, places int, reason string, article string, permitted_to_start boolean"

ENTRY_SCHEMA = (
    "driver string, team string, qualifying_pos int, grid_pos int, simulation_start_rank int, is_pit_lane_start int, "
    "status string, grid_penalty_places int, grid_vs_quali_delta int, grid_norm double"
)
def _struct(ddl: str) -> str:
    return "struct<" + ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(",")) + ">"


MANIFEST_SCHEMA = (
    "season int, round int, circuit_key string, circuit_name string, publication_status string, "
    f"document_reference string, published_timestamp string, stewards_notes array<string>, grid array<{_struct(ENTRY_SCHEMA)}>"
)

API_SCHEMA = (
    "season int, round int, circuit_key string, meeting_key int, session_key int, publication_status string, "
    "grid array<struct<position:int,driver_number:int,lap_duration:double,is_pit_lane_start:int>>, "
    "drivers array<struct<driver_number:int,name_acronym:string,team_name:string>>"
)


def penalty_totals(penalties: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Penalty rows to one row per entrant: places and the flags they imply.

    Rows need penalty_type, places, and optionally reason, article and
    permitted_to_start.  Fifteen or more places in total mean back of grid; a
    negative number of places means pit lane.
    """
    kind = F.upper("penalty_type")
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in penalties.columns else F.lit("")
    allowed = F.coalesce(F.col("permitted_to_start"), F.lit(False)) if "permitted_to_start" in penalties.columns else F.lit(False)
    allowed = allowed | text("reason").contains("permitted") | text("article").contains("art 39.4")
    pit = (kind == "PIT_LANE") | (F.col("places") < 0)
    back = ~pit & (kind == "BACK_OF_GRID")
    any_true = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    total = F.sum("places")
    return penalties.groupBy(*keys).agg(
        total.alias("places"),
        any_true(pit).alias("p_pit"),
        (any_true(back) | (total >= BACK_OF_GRID_PLACES)).alias("p_back"),
        any_true(kind == "DNS").alias("p_dns"),
        any_true((kind == "DSQ") & ~allowed).alias("p_dsq"),
        any_true((kind == "DSQ") & allowed).alias("p_permitted"),
    )


def resolve_grid(entrants: DataFrame, penalties: DataFrame | None, race: Sequence[str]) -> DataFrame:
    """The starting grid after penalties, one row per entrant.

    ``entrants`` has (race, driver, q_position) and optionally tie_time, status,
    is_pit_lane and permitted_to_start.  The main group is ordered by
    ``(q_position + places, penalised, q_position, tie_time)``: a penalised car
    lines up behind anyone at or ahead of its target.  Back-of-grid cars follow,
    then cars excluded from qualifying but allowed to start, then the pit lane.
    """
    race = list(race)
    keys = race + ["driver"]
    blank = {"places": "long", "p_pit": "boolean", "p_back": "boolean", "p_dns": "boolean", "p_dsq": "boolean", "p_permitted": "boolean"}
    if penalties is None:
        rows = entrants.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()})
    else:
        rows = entrants.join(penalty_totals(penalties, keys), keys, "left")
    has = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in rows.columns else F.lit(False)
    st = F.upper(F.coalesce(F.col("status"), F.lit(""))) if "status" in rows.columns else F.lit("")
    dsq_word = st.isin("DSQ", "DISQUALIFIED")
    dns = st.isin("DNS", "DID NOT START") | has("p_dns")
    permitted = (dsq_word & has("permitted_to_start")) | has("p_permitted")
    dsq = (dsq_word & ~has("permitted_to_start")) | has("p_dsq")
    pit = has("is_pit_lane") | has("p_pit")
    group = (
        F.when(dns | dsq, 9).when(pit, 3).when(permitted, 2).when(has("p_back"), 1).otherwise(0)
    )
    q = F.coalesce(F.col("q_position").cast("double"), F.lit(UNKNOWN_POSITION))
    tie = F.coalesce(F.col("tie_time"), F.lit(float("inf"))) if "tie_time" in rows.columns else F.lit(float("inf"))
    places = F.coalesce("places", F.lit(0))
    rows = rows.withColumns({"_g": group, "_q": q, "_t": tie, "_p": places, "_dns": dns})
    main = F.col("_g") == 0
    target = F.when(main, F.col("_q") + F.greatest(F.col("_p"), F.lit(0))).otherwise(F.col("_q"))
    late = F.when(main & (F.col("_p") > 0), 1).otherwise(0)
    line = Window.partitionBy(*race).orderBy("_g", target, late, "_q", "_t", "driver")
    starters = F.sum((F.col("_g") < 9).cast("long")).over(Window.partitionBy(*race))
    rows = rows.withColumn("_rank", F.row_number().over(line).cast("long")).withColumn("_n", starters)
    rank = F.when(F.col("_g") < 9, F.col("_rank"))
    on_grid = F.col("_g") < 3
    status = (
        F.when((F.col("_g") == 9) & F.col("_dns"), "DNS")
        .when(F.col("_g") == 9, "DSQ")
        .when(F.col("_g") == 3, "PIT_LANE")
        .when((F.col("_p") > 0) | F.col("_g").isin(1, 2), "PENALIZED")
        .otherwise("CLASSIFIED")
    )
    assessed = F.when(F.col("_g") < 9, F.col("_p")).otherwise(F.lit(0)).cast("long")
    delta = F.when(rank.isNotNull() & F.col("q_position").isNotNull(), rank - F.col("q_position")).otherwise(F.lit(0))
    out = rows.withColumns(
        {
            "ActualStartingGrid": F.when(on_grid, F.col("_rank")),
            "simulation_start_rank": rank,
            "is_pit_lane_start": (F.col("_g") == 3).cast("long"),
            "StartingGridStatus": status,
            "grid_penalty_places": assessed,
            "grid_vs_quali_delta": delta.cast("long"),
            "grid_norm": F.when(rank.isNotNull(), position_norm(rank, F.col("_n"))),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")], *blank)


def flatten_manifests(manifests: DataFrame, header: Sequence[str] = ("season", "round", "circuit_key")) -> DataFrame:
    """Manifest rows (one JSON document each, parsed) to one row per entry with defaults filled in."""
    n = F.size("grid")
    rows = manifests.select(*header, "publication_status", "document_reference", n.alias("_n"), F.explode("grid").alias("e"))
    grid = F.col("e.grid_pos").cast("double")
    q = F.col("e.qualifying_pos").cast("double")
    rank = F.coalesce(F.col("e.simulation_start_rank").cast("double"), grid, F.col("_n").cast("double"))
    pit = F.coalesce(F.col("e.is_pit_lane_start"), grid.isNull().cast("int"))
    given = F.coalesce("e.grid_vs_quali_delta", F.lit(0))
    return rows.select(
        *header,
        F.upper(F.trim("e.driver")).alias("driver"),
        F.coalesce("e.team", F.lit("Unknown")).alias("team"),
        q.alias("QualifyingPosition"),
        grid.alias("ActualStartingGrid"),
        rank.alias("simulation_start_rank"),
        pit.cast("long").alias("is_pit_lane_start"),
        F.coalesce("e.status", F.when(pit == 1, "PIT_LANE").otherwise("CLASSIFIED")).alias("StartingGridStatus"),
        F.coalesce("e.grid_penalty_places", F.lit(0)).cast("long").alias("grid_penalty_places"),
        F.when((given == 0) & grid.isNotNull() & q.isNotNull(), grid - q).otherwise(given).cast("long").alias("grid_vs_quali_delta"),
        F.coalesce("e.grid_norm", position_norm(rank, F.col("_n"))).alias("grid_norm"),
        "publication_status",
        "document_reference",
    )


def build_manifests(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    """Grid rows to one document per header, entries in start order; a race is a small group by construction."""
    entry = F.struct("simulation_start_rank", "driver", "team", "qualifying_pos", "grid_pos", "is_pit_lane_start", "status")
    ordered = F.array_sort(F.collect_list(entry))
    return rows.groupBy(*header).agg(ordered.alias("grid")).withColumn("document", F.to_json(F.struct(*header, "grid")))


# Fields a manifest must have, and what it may say of its publication.
REQUIRED = ("season", "round", "circuit_key", "publication_status", "grid")
PUBLICATION = ("FINAL", "PROVISIONAL", "UNOFFICIAL")


def manifest_errors(manifests: DataFrame, header: Sequence[str] = ("season", "round", "circuit_key")) -> DataFrame:
    """One row per document with its violations as sorted text (empty when valid)."""
    missing = [F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED if c in manifests.columns]
    absent = [F.lit(f"missing {c}") for c in REQUIRED if c not in manifests.columns]
    status = F.upper(F.trim("publication_status"))
    unknown = [F.when(~status.isin(*PUBLICATION), "unknown publication_status")] if "publication_status" in manifests.columns else []
    top = F.array_join(F.array_compact(F.array(*absent, *missing, *unknown)), "; ")
    rows = manifests.select(*header, F.nullif(top, F.lit("")).alias("_top"), F.col("grid").isNull().alias("_none"), F.explode_outer("grid").alias("e"))
    pit = F.coalesce("e.is_pit_lane_start", F.lit(0)) == 1
    grid, rank = F.col("e.grid_pos"), F.col("e.simulation_start_rank")
    driver = F.upper(F.trim("e.driver"))
    phys = F.when(~pit, grid)
    agg = rows.groupBy(*header).agg(
        F.first("_top").alias("_top"),
        F.max("_none").alias("_none"),
        F.count("e").alias("_n"),
        count_if(F.col("e").isNotNull() & (F.coalesce(driver, F.lit("")) == "")).alias("_nameless"),
        (F.count(driver) - F.countDistinct(driver)).alias("_dup"),
        count_if(pit & grid.isNotNull()).alias("_pit_grid"),
        count_if(
            F.col("e").isNotNull() & ~pit & grid.isNull() & ~F.upper(F.coalesce("e.status", F.lit(""))).isin("DNS", "DSQ")
        ).alias("_no_grid"),
        F.count(phys).alias("_pn"), F.countDistinct(phys).alias("_pd"), F.min(phys).alias("_pl"), F.max(phys).alias("_ph"),
        F.count(rank).alias("_rn"), F.countDistinct(rank).alias("_rd"), F.min(rank).alias("_rl"), F.max(rank).alias("_rh"),
    )
    broken = lambda p: (F.col(f"_{p}n") > 0) & ~(
        (F.col(f"_{p}d") == F.col(f"_{p}n")) & (F.col(f"_{p}l") == 1) & (F.col(f"_{p}h") == F.col(f"_{p}n"))
    )
    found = F.array(
        F.col("_top"),
        F.when((F.col("_n") == 0) & ~F.col("_none"), "empty grid"),
        F.when(F.col("_nameless") > 0, "entry without driver"),
        F.when(F.col("_dup") > 0, "duplicate driver"),
        F.when(F.col("_pit_grid") > 0, "pit-lane starter with grid position"),
        F.when(F.col("_no_grid") > 0, "starter without grid position"),
        F.when(broken("p"), "grid positions not contiguous"),
        F.when(broken("r"), "start ranks not contiguous"),
    )
    errors = F.array_join(F.array_compact(found), "; ")
    return agg.select(*header, F.col("_n").alias("entries"), errors.alias("errors"), (errors == "").alias("ok"))


def flatten_api_grid(
    snapshots: DataFrame, quali: DataFrame, catalogue: DataFrame, race: Sequence[str]
) -> DataFrame:
    """API snapshot rows to grid rows; a car number resolves by qualifying, then the feed, then the catalogue.

    ``quali`` has (race, number, driver, team, q_position); ``catalogue`` has (number, driver, team).
    """
    race = list(race)
    rows = snapshots.select(*race, F.size("grid").alias("_n"), F.explode("grid").alias("e")).select(
        *race, "_n", F.col("e.driver_number").cast("long").alias("number"), F.col("e.position").cast("double").alias("pos"),
        F.coalesce("e.is_pit_lane_start", F.lit(0)).alias("_flag"),
    )
    feed = snapshots.select(*race, F.explode("drivers").alias("d")).select(
        *race, F.col("d.driver_number").cast("long").alias("number"), F.upper(F.trim("d.name_acronym")).alias("f_driver"),
        F.trim("d.team_name").alias("f_team"),
    )
    q = quali.select(*race, "number", F.upper(F.trim("driver")).alias("q_driver"), F.trim("team").alias("q_team"))
    c = catalogue.select("number", F.col("driver").alias("c_driver"), F.col("team").alias("c_team"))
    named = rows.join(q, race + ["number"], "left").join(feed, race + ["number"], "left").join(c, "number", "left")
    named = named.withColumn(
        "driver", F.coalesce("q_driver", "f_driver", "c_driver", F.concat(F.lit("D"), F.col("number").cast("string")))
    ).withColumn("team", F.coalesce("q_team", "f_team", "c_team", F.lit("Unknown")))
    places = quali.select(*race, F.upper(F.trim("driver")).alias("driver"), F.col("q_position").cast("double").alias("_q"))
    joined = named.join(places, race + ["driver"], "left")
    pit = F.col("pos").isNull() | (F.col("_flag") == 1)
    grid = F.when(~pit, F.col("pos"))
    rank = F.coalesce("pos", F.col("_n").cast("double"))
    qpos = F.coalesce("_q", "pos")
    delta = F.coalesce(F.coalesce(grid, rank) - qpos, F.lit(0.0)).cast("long")
    return joined.select(
        *race, "driver", "team", qpos.alias("QualifyingPosition"), grid.alias("ActualStartingGrid"),
        rank.alias("simulation_start_rank"), pit.cast("long").alias("is_pit_lane_start"),
        F.when(pit, "PIT_LANE").when(grid > qpos, "PENALIZED").otherwise("CLASSIFIED").alias("StartingGridStatus"),
        F.greatest(delta, F.lit(0)).alias("grid_penalty_places"), delta.alias("grid_vs_quali_delta"),
        position_norm(rank, F.col("_n")).alias("grid_norm"),
    )


def pick_source(candidates: DataFrame, race: Sequence[str]) -> DataFrame:
    """Keeps, per race, the rows of the valid source with the lowest priority number.

    ``candidates`` stacks all sources with ``priority`` and ``valid`` columns.
    """
    best = candidates.where("valid").groupBy(*race).agg(F.min("priority").alias("priority"))
    return candidates.where("valid").join(best, [*race, "priority"])


# Source order and the stages at which a grid can exist.
SOURCE_PRIORITY = {
    "official_manifest": 1,
    "f1_website": 2,
    "openf1_api": 3,
    "algorithmic_fallback": 4,
    "historical_race_results": 5,
}


# Stages at which no grid can have been published.
BEFORE_QUALIFYING = ("pre_fp1", "after_fp1", "after_fp2", "after_fp3", "after_sprint_qualifying", "after_sprint_race", "after_sprint")


def resolve_grids(targets: DataFrame, candidates: DataFrame, race: Sequence[str]) -> DataFrame:
    """The grid of each target race at its ``stage``, with ``provenance``, ``publication_status`` and ``document_reference``.

    ``candidates`` stacks all sources as in :func:`pick_source`, with ``source``, and optionally the last two.  Before
    qualifying no source counts: the race comes back as one row without entrants, unpublished.  So does a race that
    no source is valid for, as unavailable.
    """
    race = list(race)
    early = F.lower(F.trim(F.coalesce("stage", F.lit("after_qualifying")))).isin(*BEFORE_QUALIFYING)
    wanted = targets.select(*race, "stage", early.alias("_early"))
    own = [c for c in candidates.columns if c not in (*race, "priority", "valid", "publication_status", "document_reference", "source")]
    have = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("string")
    best = pick_source(candidates, race).select(*race, *own, "source", have("publication_status").alias("_pub"), have("document_reference").alias("_doc"))
    rows = wanted.where(~F.col("_early")).join(best, race, "left").unionByName(wanted.where("_early"), allowMissingColumns=True)
    none = F.when(F.col("_early"), "unpublished").otherwise("unavailable")
    return rows.select(
        *race, "stage", *own, F.coalesce("source", none).alias("provenance"),
        F.coalesce("_pub", F.when(F.col("source").isNull(), "UNOFFICIAL")).alias("publication_status"),
        F.when(F.col("_early"), "Pre-Qualifying Cutoff").otherwise(F.col("_doc")).alias("document_reference"),
    )


def publish_snapshots(ledger: Ledger, fetched: DataFrame, run: str, header: Sequence[str] = ("season", "round", "circuit_key")) -> State:
    """Keeps fetched grid documents that pass :func:`manifest_errors` and aren't kept yet; all of a run or none of it.

    Of several valid documents of a race the one with the smallest text is kept.  A race once kept is never fetched again:
    ask :func:`missing_snapshots` first.
    """
    state = ledger.state()
    good = manifest_errors(fetched, header).where("ok").select(*header)
    valid = keep_first(fetched.join(good, list(header), "left_semi"), list(header), [F.to_json(F.struct(*fetched.columns))])
    fresh = new_rows(valid, ledger.table(state), header)
    return ledger.publish(state, fresh, [ledger.stage(fresh, run)])


def missing_snapshots(ledger: Ledger, races: DataFrame, header: Sequence[str] = ("season", "round", "circuit_key")) -> DataFrame:
    """The races without a kept grid document."""
    return new_rows(races, ledger.table(), header)


def provenance_text(provenance: Column, publication: Column, reference: Column, stage: Column) -> Column:
    """Display text for where a grid came from."""
    p = F.lower(provenance)
    suffix = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit(" ("), reference, F.lit(")"))).otherwise("")
    kind = F.when(F.upper(publication) == "FINAL", "Final").otherwise("Provisional")
    return (
        F.when(p.isin("official_manifest", "fia_official"), F.concat(F.lit("FIA Official "), kind, F.lit(" Starting Grid"), suffix))
        .when(p == "f1_website", "F1 Published Starting Grid")
        .when(p == "openf1_api", F.concat(F.lit("OpenF1 Published Starting Grid"), suffix))
        .when(p.isin("algorithmic_fallback", "algorithmic_provisional"), "Algorithmic Provisional Grid (FIA Art 42.3)")
        .when(p.isin("historical_race_results", "race_results_derived"), F.concat(F.lit("Historical Race Results Starting Grid"), suffix))
        .when(
            p == "unpublished",
            F.concat(F.lit("Provisional Predicted Grid (Pre-Qualifying Stage: "), F.coalesce(stage, F.lit("pre-qualifying")), F.lit(")")),
        )
        .otherwise("Starting Grid Unavailable")
    )


def shared_car_grid(rows: DataFrame, race: Sequence[str]) -> DataFrame:
    """One row per (car, start slot); drivers who shared a car are listed in name order.

    ``rows`` has (race, car, grid, driver, team[, starting_driver]).  A car with
    several drivers and no recorded starter stays unresolved.
    """
    race = list(race)
    has_starter = "starting_driver" in rows.columns
    starter = F.max(F.when(F.col("starting_driver").isNotNull(), F.upper(F.trim("driver")))) if has_starter else F.lit(None).cast("string")
    car = F.coalesce(F.col("car").cast("string"), F.concat(F.lit("grid_"), F.col("grid").cast("string")))
    cars = (
        rows.withColumn("car_key", car)
        .groupBy(*race, "car_key", "grid")
        .agg(
            F.sort_array(F.collect_set(F.upper(F.trim("driver")))).alias("drivers"),
            F.count(F.lit(1)).alias("n_rows"),
            F.max("team").alias("team"),
            starter.alias("_starter"),
        )
    )
    field = F.count(F.lit(1)).over(Window.partitionBy(*race))
    shared = F.col("n_rows") > 1
    pit = F.coalesce(F.col("grid") <= 0, F.lit(True))
    slot = F.when(~pit, F.col("grid").cast("double"))
    named = F.when(~shared, F.element_at("drivers", 1)).otherwise(F.coalesce("_starter", F.array_join("drivers", " / ")))
    cars = cars.withColumn("_n", field).withColumn("simulation_start_rank", F.coalesce(slot, F.col("_n").cast("double")))
    return cars.select(
        *race, "car_key", named.alias("driver"), "team", slot.alias("ActualStartingGrid"), "simulation_start_rank",
        pit.cast("long").alias("is_pit_lane_start"), F.when(pit, "PIT_LANE").otherwise("CLASSIFIED").alias("StartingGridStatus"),
        position_norm(F.col("simulation_start_rank"), F.col("_n")).alias("grid_norm"), shared.alias("is_shared_drive"),
        (~shared | F.col("_starter").isNotNull()).alias("is_starter_resolved"), F.array_join("drivers", ",").alias("shared_drivers"),
    )


def participations(rows: DataFrame, race: Sequence[str]) -> DataFrame:
    """One row per driver with the part they played in the car."""
    car = F.coalesce(F.col("car").cast("string"), F.concat(F.lit("grid_"), F.col("grid").cast("string")))
    shared = F.count(F.lit(1)).over(Window.partitionBy(*race, "car_key", "grid")) > 1
    return rows.withColumn("car_key", car).withColumn("is_shared_drive", shared).withColumn(
        "role", F.when(F.col("is_shared_drive"), "shared_unresolved").otherwise("solo_starter")
    )


def start_ranks(rows: DataFrame, race: Sequence[str], grid: str, pit: str, default: float = 12.0) -> DataFrame:
    """Adds ``start_rank``: the slot, with pit-lane starters placed after the last slot in entity order."""
    field = Window.partitionBy(*race)
    is_pit = F.coalesce(F.col(pit) == 1, F.lit(False))
    last = F.coalesce(F.max(F.col(grid)).over(field), F.lit(20.0))
    nth = F.sum(is_pit.cast("int")).over(field.orderBy("entity").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(
        "start_rank", F.when(is_pit, last + nth).otherwise(F.coalesce(F.col(grid).cast("double"), F.lit(default)))
    )


def sorted_grid(resolved: DataFrame, race: Sequence[str], expected: int | Column) -> DataFrame:
    """Start order with a size check that fails the job instead of returning a short grid."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*race))
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    message = F.concat(F.lit("grid has "), n.cast("string"), F.lit(" entrants, expected "), expected.cast("string"))
    checked = F.when(n == expected, F.col("simulation_start_rank")).otherwise(F.raise_error(message).cast("long"))
    return resolved.withColumn("simulation_start_rank", checked).orderBy(*race, "simulation_start_rank")


# Page tables --------------------------------------------------------------------------------------

PIT_WORDS = ("PL", "PIT", "PIT LANE", "PITLANE")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def first_table_rows(html: Column) -> Column:
    """Rows of the first table, as an array of arrays of cell texts."""
    table = F.regexp_extract(html, r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), strip_tags)
    return F.transform(rows, cells)


def stewards_note(html: Column) -> Column:
    """Text of the note that follows the table, cut at the page footer."""
    after = F.substring_index(html, "</table>", -1)
    plain = F.regexp_replace(after, "<[^>]+>", " ")
    note = F.trim(F.regexp_extract(plain, r"(?i)Note\s*-\s*([^\n\r<]+)", 1))
    note = F.trim(F.substring_index(note, "OUR PARTNERS", 1))
    return F.when(html.contains("</table>") & (note != ""), note)


def parse_grid_pages(pages: DataFrame, page: Sequence[str], html: str = "html") -> DataFrame:
    """Published grid pages to grid rows; the header row and short rows are dropped."""
    page = list(page)
    rows = pages.select(*page, stewards_note(F.col(html)).alias("_note"), F.posexplode(first_table_rows(F.col(html))).alias("line", "c"))
    rows = rows.where((F.col("line") > 0) & (F.size("c") >= 4))
    cell = lambda i: F.trim(F.get("c", F.lit(i)))
    who = F.trim(F.regexp_replace(cell(2), " ", " "))
    code = F.regexp_extract(who, "([A-Z]{3})$", 1)
    name = F.when(code != "", F.trim(F.expr("substring(_who, 1, length(_who) - 3)"))).otherwise(F.col("_who"))
    rows = rows.withColumn("_who", who).withColumn("full_name", name)
    noted = F.coalesce(
        F.lower("_note").contains("pit lane") & (F.instr(F.lower("_note"), F.lower("full_name")) > 0), F.lit(False)
    )
    slot = cell(0).try_cast("int")
    pit = F.upper(cell(0)).isin(*PIT_WORDS) | noted | slot.isNull()
    rows = rows.withColumn("is_pit_lane_start", pit.cast("long")).withColumn("grid_pos", F.when(~pit, slot))
    line = Window.partitionBy(*page).orderBy("is_pit_lane_start", F.col("grid_pos").asc_nulls_last(), "line")
    n = F.count(F.lit(1)).over(Window.partitionBy(*page))
    rows = rows.withColumn("simulation_start_rank", F.row_number().over(line).cast("long"))
    return rows.select(
        *page, F.when(code != "", code).otherwise(F.upper(F.substring("_who", 1, 3))).alias("driver"), "full_name",
        cell(1).alias("number"), cell(3).alias("team"), "grid_pos", "simulation_start_rank", "is_pit_lane_start",
        position_norm(F.col("simulation_start_rank"), n).alias("grid_norm"),
    )


def page_items(pages: DataFrame, page: Sequence[str], tag: str, html: str = "html") -> DataFrame:
    """Texts of every ``tag`` element on a page, numbered in page order, without a shuffle."""
    found = F.regexp_extract_all(F.col(html), F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select(*page, F.posexplode(F.transform(found, strip_tags)).alias("line", "text"))
