"""Scalar functions over whole columns: times, statuses, names, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import names, numbers, status, timing
from lapwing.operators import circuits
from lapwing.queries.registry import query, r6, shown
from lapwing.sources import star

# One text per code; both engines build the same list, each in its own way.
STATUS_TEXTS = (
    "Finished", "+1 Lap", "Lapped", " finished ", "Did not start", "DNS", "Withdrew", "Disqualified", "DSQ",
    "Excluded", "NC", "Not classified", "Engine", "Collision damage", "Gearbox", "Power Unit", "Out of fuel",
    "Retired", "Illness", "", None, "+2 Laps", "Failed to qualify", "Accident",
)
POSITION_TEXTS = ("1", "2", "3", "11", "R", "D", "W", "F", "N", "DNQ", None)


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


def _pick(values, code):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (code % len(values) + 1).cast("int"))


STATUS_CTE = f"""
st AS (SELECT o_orderkey AS k, list_extract({_sql_list(STATUS_TEXTS)}, cast(o_orderkey % 24 AS int) + 1) AS s,
         list_extract({_sql_list(POSITION_TEXTS)}, cast(o_custkey % 11 AS int) + 1) AS pt, o_totalprice FROM orders),
cl AS (SELECT *, CASE
    WHEN trim(coalesce(s, '')) = '' THEN 'UNKNOWN'
    WHEN trim(lower(s)) IN ('finished', 'lapped') OR s LIKE '+%' THEN 'FINISHED'
    WHEN s IN ('Did not start', 'DNS', 'Withdrew') THEN 'DNS'
    WHEN s IN ('Disqualified', 'DSQ', 'Excluded') THEN 'DSQ' WHEN s IN ('NC', 'Not classified') THEN 'NC'
    WHEN s IN ('Engine', 'Collision damage', 'Gearbox', 'Power Unit', 'Out of fuel', 'Retired', 'Accident') THEN 'RETIRED'
    ELSE 'UNKNOWN' END AS cls FROM st)"""


def _status_rows(spark, sf):
    orders = star.table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("k"),
        _pick(STATUS_TEXTS, F.col("o_orderkey")).alias("s"),
        _pick(POSITION_TEXTS, F.col("o_custkey")).alias("pt"),
    )


@query(
    "status_classify",
    "WITH "
    + STATUS_CTE
    + """ SELECT cls AS status_class, coalesce(s, '-') AS status, count(*) AS n,
  count(*) FILTER (cls = 'RETIRED') AS dnf, count(*) FILTER (cls IN ('RETIRED', 'DNS', 'DSQ', 'NC')) AS dnf_all,
  count(*) FILTER (cls = 'FINISHED') AS finished, count(*) FILTER (cls = 'DNS') AS dns, count(*) FILTER (cls = 'DSQ') AS dsq,
  count(*) FILTER (cls = 'NC') AS nc FROM cl GROUP BY ALL""",
)
def status_classify(spark, sf):
    s = F.col("s")
    rows = _status_rows(spark, sf)
    return rows.groupBy(status.classify(s).alias("status_class"), F.coalesce(s, F.lit("-")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        status.count_if(status.is_dnf(s)).alias("dnf"),
        status.count_if(status.is_dnf(s, True, True, True)).alias("dnf_all"),
        status.count_if(status.is_classified_finish(s)).alias("finished"),
        status.count_if(status.is_dns(s)).alias("dns"),
        status.count_if(status.is_dsq(s)).alias("dsq"),
        status.count_if(status.is_nc(s)).alias("nc"),
    )


@query(
    "archive_status_flags",
    "WITH "
    + STATUS_CTE
    + """, f AS (SELECT coalesce(pt, '-') AS position_text, coalesce(s, 'Unknown') AS s,
  coalesce(pt IN ('W', 'F', 'N', 'DNQ'), false) OR coalesce(s IN ('Did not start', 'Withdrew', 'Failed to qualify'), false) AS non_start,
  coalesce(s IN ('Finished', 'Lapped') OR s LIKE '+%', false) AS running,
  coalesce(pt IN ('1', '2', '3', '11'), false) AS numeric_pos,
  coalesce(pt = 'D', false) OR coalesce(s IN ('Disqualified', 'Excluded'), false) AS dsq FROM st)
SELECT position_text, count(*) AS n, count(*) FILTER (non_start) AS non_start, count(*) FILTER (running) AS running_finish,
  count(*) FILTER (running OR numeric_pos) AS classified, count(*) FILTER (dsq) AS disqualified,
  count(*) FILTER (NOT running AND NOT non_start AND NOT dsq) AS retired FROM f GROUP BY ALL""",
)
def archive_status_flags(spark, sf):
    flags = status.archive_flags(F.col("s"), F.col("pt"))
    return (
        _status_rows(spark, sf)
        .groupBy(F.coalesce("pt", F.lit("-")).alias("position_text"))
        .agg(F.count(F.lit(1)).alias("n"), *[status.count_if(c).alias(n) for n, c in flags.items()])
    )


@query(
    "status_rates",
    "WITH "
    + STATUS_CTE
    + f""", d AS (SELECT o_custkey % 100 AS entity, cls FROM cl JOIN orders ON k = o_orderkey),
g AS (SELECT entity, count(*) FILTER (cls <> 'UNKNOWN') AS e, count(*) FILTER (cls NOT IN ('UNKNOWN', 'DNS')) AS st,
  count(*) FILTER (cls = 'DNS') AS dns, count(*) FILTER (cls = 'DSQ') AS dsq, count(*) FILTER (cls = 'RETIRED') AS ret,
  count(*) FILTER (cls = 'NC') AS nc, count(*) AS n FROM d GROUP BY ALL)
SELECT entity, n AS races_completed, {r6("CASE WHEN e > 0 THEN dns / e ELSE 0 END")} AS driver_dns_rate,
  {r6("CASE WHEN st > 0 THEN ret / st ELSE 0 END")} AS driver_dnf_rate, {r6("CASE WHEN e > 0 THEN dsq / e ELSE 0 END")} AS driver_dsq_rate,
  {r6("CASE WHEN st > 0 THEN nc / st ELSE 0 END")} AS driver_nc_rate FROM g""",
)
def status_rates(spark, sf):
    orders = star.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("entity"), status.classify(_pick(STATUS_TEXTS, F.col("o_orderkey"))).alias("cls")
    )
    n = lambda name: status.count_if(F.col("cls") == name)
    e = F.count(F.lit(1)) - n("UNKNOWN")
    starts = F.greatest(e - n("DNS"), F.lit(0))
    return shown(
        orders.groupBy("entity").agg(
            F.count(F.lit(1)).alias("races_completed"),
            numbers.ratio(n("DNS"), e).alias("driver_dns_rate"),
            numbers.ratio(n("RETIRED"), starts).alias("driver_dnf_rate"),
            numbers.ratio(n("DSQ"), e).alias("driver_dsq_rate"),
            numbers.ratio(n("NC"), starts).alias("driver_nc_rate"),
        )
    )


# lap times as text, one form per line number
_TIMES_SQL = """
ms AS (SELECT l_orderkey, l_suppkey AS entity, l_linenumber AS ln,
         cast(floor((60.0 + l_extendedprice / l_quantity / 100.0) * 1000) AS bigint) AS ms FROM lineitem),
txt AS (SELECT *, CASE ln
    WHEN 1 THEN printf('0 days 00:%02d:%02d.%03d000', ms // 60000, (ms // 1000) % 60, ms % 1000)
    WHEN 2 THEN printf('%d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000)
    WHEN 3 THEN printf('0:%02d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000)
    WHEN 4 THEN printf(' %d.%03d ', ms // 1000, ms % 1000)
    WHEN 5 THEN CASE WHEN ms % 2 = 0 THEN 'NaT' ELSE 'DNF' END
    WHEN 6 THEN '-12.5' ELSE CASE WHEN ms % 3 = 0 THEN NULL ELSE 'no time' END END AS t FROM ms)"""


def _times(spark, sf):
    li = star.timed_lines(spark, sf)
    ms = F.floor(F.col("lap_s") * 1000)
    rows = li.select("entity", F.col("l_linenumber").alias("ln"), ms.alias("ms"))
    m, s, f = F.floor(F.col("ms") / 60000), F.floor(F.col("ms") / 1000) % 60, F.col("ms") % 1000
    text = (
        F.when(F.col("ln") == 1, F.format_string("0 days 00:%02d:%02d.%03d000", m, s, f))
        .when(F.col("ln") == 2, F.format_string("%d:%02d.%03d", m, s, f))
        .when(F.col("ln") == 3, F.format_string("0:%02d:%02d.%03d", m, s, f))
        .when(F.col("ln") == 4, F.format_string(" %d.%03d ", F.floor(F.col("ms") / 1000), f))
        .when(F.col("ln") == 5, F.when(F.col("ms") % 2 == 0, "NaT").otherwise("DNF"))
        .when(F.col("ln") == 6, "-12.5")
        .otherwise(F.when(F.col("ms") % 3 != 0, "no time"))
    )
    return rows.withColumn("t", text)


@query(
    "laptime_parse",
    "WITH "
    + _TIMES_SQL
    + f""" SELECT entity, cast(ln AS bigint) AS ln, count(*) AS n, count(*) FILTER (ln <= 4) AS parsed,
  cast(sum(CASE WHEN ln <= 4 THEN ms END) AS bigint) AS total_ms, {r6("min(CASE WHEN ln <= 4 THEN ms / 1000.0 END)")} AS best_s
FROM txt GROUP BY ALL""",
)
def laptime_parse(spark, sf):
    rows = _times(spark, sf).withColumn("sec", timing.seconds(F.col("t")))
    return shown(
        rows.groupBy("entity", F.col("ln").cast("long").alias("ln")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count("sec").alias("parsed"),
            F.sum(F.rint(F.col("sec") * 1000).cast("long")).alias("total_ms"),
            F.min("sec").alias("best_s"),
        )
    )


@query(
    "laptime_tie_break",
    "WITH "
    + _TIMES_SQL
    + f""", b AS (SELECT entity, l_orderkey % 50 AS heat, max(CASE WHEN ln = 3 THEN ms END) AS q3, max(CASE WHEN ln = 2 THEN ms END) AS q2,
    max(CASE WHEN ln = 1 THEN ms END) AS q1 FROM txt GROUP BY ALL)
SELECT entity, heat, {r6("coalesce(q3, q2, q1) / 1000.0")} AS best_s, coalesce(q3, q2, q1) IS NULL AS no_time FROM b""",
)
def laptime_tie_break(spark, sf):
    li = star.timed_lines(spark, sf).select("entity", (F.col("l_orderkey") % 50).alias("heat"), F.col("l_linenumber").alias("ln"),
                                            F.floor(F.col("lap_s") * 1000).alias("ms"))
    best = li.groupBy("entity", "heat").agg(*[F.max(F.when(F.col("ln") == n, F.col("ms"))).alias(f"m{n}") for n in (1, 2, 3)])
    m = lambda c: F.floor(F.col(c) / 60000)
    s = lambda c: F.floor(F.col(c) / 1000) % 60
    f = lambda c: F.col(c) % 1000
    q1 = F.when(F.col("m1").isNotNull(), F.format_string("0 days 00:%02d:%02d.%03d000", m("m1"), s("m1"), f("m1")))
    q2 = F.when(F.col("m2").isNotNull(), F.format_string("%d:%02d.%03d", m("m2"), s("m2"), f("m2")))
    q3 = F.when(F.col("m3").isNotNull(), F.format_string("0:%02d:%02d.%03d", m("m3"), s("m3"), f("m3")))
    out = best.withColumn("b", timing.best_for_tie_break(q3, q2, q1))
    none = F.col("b") == float("inf")
    return shown(out.select("entity", "heat", F.when(~none, F.col("b")).alias("best_s"), none.alias("no_time")))


@query(
    "laptime_format",
    """WITH ms AS (SELECT l_suppkey AS entity, l_linenumber AS ln,
         min(60.0 + l_extendedprice / l_quantity / 100.0) AS s FROM lineitem GROUP BY ALL),
v AS (SELECT entity, ln, CASE WHEN ln = 7 THEN -s ELSE floor(s * 1000) / 1000 END AS s FROM ms)
SELECT entity, cast(ln AS bigint) AS ln, CASE WHEN s > 0 THEN printf('%d:%06.3f', cast(floor(s / 60) AS int), s - floor(s / 60) * 60) ELSE 'No Time' END AS lap_text FROM v""",
)
def laptime_format(spark, sf):
    rows = star.timed_lines(spark, sf).groupBy("entity", F.col("l_linenumber").alias("ln")).agg(F.min("lap_s").alias("s"))
    value = F.when(F.col("ln") == 7, -F.col("s")).otherwise(F.floor(F.col("s") * 1000) / 1000)
    return rows.select("entity", F.col("ln").cast("long").alias("ln"), timing.lap_text(value).alias("lap_text"))


@query(
    "gap_to_pole_text",
    """WITH best AS (SELECT l_suppkey // 20 AS series, l_suppkey AS entity, year(l_shipdate) AS season,
    min(cast(floor((60.0 + l_extendedprice / l_quantity / 100.0) * 1000) AS bigint)) AS ms FROM lineitem GROUP BY ALL),
p AS (SELECT *, min(ms) OVER (PARTITION BY series, season) AS pole FROM best)
SELECT series, season, entity, ms AS best_ms, printf('+%.3f', (ms - pole) / 1000.0) AS gap FROM p""",
)
def gap_to_pole_text(spark, sf):
    best = star.timed_lines(spark, sf).groupBy("series", "season", "entity").agg(F.min(F.floor(F.col("lap_s") * 1000)).alias("ms"))
    text = F.format_string("%d:%02d.%03d", F.floor(F.col("ms") / 60000), F.floor(F.col("ms") / 1000) % 60, F.col("ms") % 1000)
    rows = best.withColumn("text", text)
    pole = rows.groupBy("series", "season").agg(F.min_by("text", "ms").alias("pole"))
    return rows.join(pole, ["series", "season"]).select(
        "series", "season", "entity", timing.millis(F.col("text")).alias("best_ms"), timing.gap_text(F.col("pole"), F.col("text")).alias("gap")
    )


@query(
    "name_normalise",
    """WITH d AS (SELECT n_nationkey AS ord, 'N' || lpad(cast(n_nationkey AS varchar), 2, '0') AS code, upper(replace(n_name, '_', ' ')) AS full_name FROM nation),
raw AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 5
   WHEN 0 THEN ' n' || lpad(cast(c_nationkey AS varchar), 2, '0') WHEN 1 THEN 'Nation ' || c_nationkey
   WHEN 2 THEN cast(c_nationkey AS varchar) || ' ' WHEN 3 THEN lower(c_mktsegment) ELSE c_name END AS name, c_nationkey FROM customer),
hit AS (SELECT raw.*, CASE WHEN c_custkey % 5 <= 2 THEN 'N' || lpad(cast(c_nationkey AS varchar), 2, '0') ELSE upper(trim(name)) END AS code FROM raw)
SELECT code, count(*) AS n, min(c_custkey) AS first_key FROM hit GROUP BY ALL""",
)
def name_normalise(spark, sf):
    nation = star.table(spark, sf, "nation")
    directory = nation.select(
        F.format_string("N%02d", "n_nationkey").alias("code"), F.translate("n_name", "_", " ").alias("full_name"),
        F.col("n_nationkey").alias("ordinal"),
    )
    c = star.table(spark, sf, "customer")
    kind = F.col("c_custkey") % 5
    name = (
        F.when(kind == 0, F.format_string(" n%02d", "c_nationkey"))
        .when(kind == 1, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")))
        .when(kind == 2, F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")))
        .when(kind == 3, F.lower("c_mktsegment"))
        .otherwise(F.col("c_name"))
    )
    rows = names.normalise_entities(c.select("c_custkey", name.alias("raw")), "raw", directory, "code")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


@query(
    "identifier_coalesce",
    """WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE upper(c_mktsegment) END AS a,
  CASE c_custkey % 3 WHEN 0 THEN 'None' ELSE ' ' || c_mktsegment || ' ' END AS b, c_name AS c FROM customer)
SELECT CASE WHEN c_custkey % 4 = 3 THEN a WHEN c_custkey % 3 <> 0 THEN trim(b) ELSE regexp_extract(c, '^[A-Za-z]+') END AS identifier,
  count(*) AS n FROM r GROUP BY ALL""",
)
def identifier_coalesce(spark, sf):
    c = star.table(spark, sf, "customer")
    k = F.col("c_custkey")
    a = F.when(k % 4 == 0, "  ").when(k % 4 == 1, "nan").when(k % 4 == 3, F.upper("c_mktsegment"))
    b = F.when(k % 3 == 0, "None").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    word = F.regexp_extract("c_name", "^[A-Za-z]+", 0)
    return c.groupBy(names.clean_identifier(a, b, word).alias("identifier")).agg(F.count(F.lit(1)).alias("n"))


TEAM_ALIASES = {"AUTOMOBILE": "Auto Works", "BUILDING": "Builders", "MACHINERY": "Builders"}


@query(
    "team_normalise",
    """SELECT CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Auto Works'
    WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Builders' ELSE c_mktsegment END AS team, count(*) AS n FROM customer GROUP BY ALL""",
)
def team_normalise(spark, sf):
    c = star.table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 14 == 0, F.lit("NaN")).when(F.col("c_custkey") % 7 != 0, F.concat(F.lower("c_mktsegment"), F.lit(" ")))
    kept = F.when(F.upper(F.trim(raw)).isin(*TEAM_ALIASES), raw).otherwise(F.when(raw.isNotNull() & (raw != "NaN"), F.upper(raw)).otherwise(raw))
    return c.groupBy(names.team_name(kept, TEAM_ALIASES).alias("team")).agg(F.count(F.lit(1)).alias("n"))


SESSION_TEXTS = ("FP1", "Practice 2", "free-practice 3", "Sprint_Shootout", "SQ", "sprint", "Quali", "Race", "Warm Up", "", None)
SESSION_KEYS = ("fp1", "fp2", "fp3", "sprint_qualifying", "sprint_qualifying", "sprint_race", "qualifying", "race", "warm_up", "", "")


@query(
    "session_normalise",
    f"""SELECT list_extract({_sql_list(SESSION_KEYS)}, cast(event_id % 11 AS int) + 1) AS session, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def session_normalise(spark, sf):
    ev = star.table(spark, sf, "events")
    raw = _pick(SESSION_TEXTS, F.col("event_id"))
    return ev.groupBy(names.session_name(raw).alias("session"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "circuit_key_match",
    """WITH c AS (SELECT c_custkey, c_nationkey AS k, c_custkey % 7 AS form FROM customer),
m AS (SELECT c_custkey, CASE form WHEN 0 THEN 'c' || k WHEN 1 THEN CASE WHEN k = 7 THEN 'c3' END WHEN 2 THEN 'c' || k WHEN 3 THEN 'c' || k
   WHEN 4 THEN 'c' || k WHEN 5 THEN 'c' || k END AS circuit FROM c)
SELECT coalesce(circuit, '-') AS circuit, count(*) AS n, min(c_custkey) AS first_key FROM m GROUP BY ALL""",
)
def circuit_key_match(spark, sf):
    k = F.col("n_nationkey").cast("string")
    dim = star.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("ordinal"),
        F.concat(F.lit("c"), k).alias("key"),
        F.concat(F.lit("Grand Prix "), k, F.lit(" Town")).alias("display_name"),
        F.concat(F.lit("Ring "), k, F.lit(" Arena")).alias("circuit_name"),
        F.array(F.concat(F.lit("Pat "), k, F.lit(" End"))).alias("patterns"),
    )
    c = star.table(spark, sf, "customer")
    form, n = F.col("c_custkey") % 7, F.col("c_nationkey").cast("string")
    raw = (
        F.when(form == 0, F.concat(F.lit(" C"), n))
        .when(form == 1, F.when(F.col("c_nationkey") == 7, "Old-Track").otherwise("nowhere"))
        .when(form == 2, F.concat(F.lit("grand_prix_"), n, F.lit("_town")))
        .when(form == 3, F.concat(F.lit("RING "), n, F.lit(" arena")))
        .when(form == 4, F.concat(F.lit("The Grand Prix "), n, F.lit(" Town 2026")))
        .when(form == 5, F.concat(F.lit("Big pat "), n, F.lit(" end race")))
    )
    aliases = spark.createDataFrame([("old_track", "c3")], "alias string, key string")
    rows = circuits.add_circuit_key(c.select("c_custkey", raw.alias("event")), ["event"], dim, aliases, "circuit")
    return rows.groupBy(F.coalesce("circuit", F.lit("-")).alias("circuit")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


@query(
    "circuit_names_large",
    """WITH dim AS (
  SELECT p_partkey AS place, 'p' || p_partkey AS key, lower(p_name) AS shown, lower(p_type || ' ' || p_partkey) AS course,
    [lower(p_brand || ' ' || p_size), 'lot ' || p_partkey] AS pats FROM part),
ev AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'P' || (o_custkey % 3000) WHEN 1 THEN 'the ' || p_name || ' round' WHEN 2 THEN replace(p_type, ' ', '_') || '_' || p_partkey
    WHEN 3 THEN 'Big ' || upper(p_brand) || ' ' || (o_custkey % 60) WHEN 4 THEN o_orderpriority END AS name,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Lot ' || (o_custkey % 5000) || ' end' END AS place_name
  FROM orders JOIN part ON p_partkey = (o_custkey * 7 + o_orderkey) % (SELECT max(p_partkey) + 1 FROM part)),
ids AS (SELECT DISTINCT unnest([name, place_name]) AS id FROM ev),
r AS (SELECT id, replace(replace(lower(trim(id)), '-', '_'), ' ', '_') AS slug, trim(replace(lower(trim(id)), '_', ' ')) AS spaced FROM ids WHERE trim(id) <> ''),
hit AS (
  SELECT id, 1 AS tier, 0 AS place, key FROM r JOIN dim ON slug = key
  UNION ALL SELECT id, 3, place, key FROM r JOIN dim ON contains(spaced, shown) OR spaced = course OR slug = replace(course, ' ', '_') OR spaced IN (pats[1], pats[2]) OR slug IN (replace(pats[1], ' ', '_'), replace(pats[2], ' ', '_'))
  UNION ALL SELECT id, 4, place, key FROM r JOIN dim ON contains(spaced, pats[1]) OR contains(spaced, pats[2]) OR contains(slug, pats[1]) OR contains(slug, pats[2])),
best AS (SELECT id, arg_min(key, tier * 1000000000::BIGINT + place) AS key FROM hit GROUP BY id)
SELECT o_orderkey, coalesce(a.key, b.key) AS circuit FROM ev LEFT JOIN best a ON a.id = name LEFT JOIN best b ON b.id = place_name""",
)
def circuit_names_large(spark, sf):
    """As many circuits as parts: shared patterns, names inside texts, a second column where the first says nothing."""
    p, o = star.table(spark, sf, "part"), star.table(spark, sf, "orders")
    number = F.col("p_partkey").cast("string")
    dim = p.select(
        F.col("p_partkey").alias("ordinal"), F.concat(F.lit("p"), number).alias("key"), F.col("p_name").alias("display_name"),
        F.concat_ws(" ", "p_type", number).alias("circuit_name"),
        F.array(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")), F.concat(F.lit("Lot "), number)).alias("patterns"),
    )
    last = p.agg(F.max("p_partkey").alias("last")).first()["last"]
    rows = o.join(p, F.col("p_partkey") == (F.col("o_custkey") * 7 + F.col("o_orderkey")) % (last + 1))
    form, text = F.col("o_orderkey") % 5, lambda c: c.cast("string")
    name = (
        F.when(form == 0, F.concat(F.lit("P"), text(F.col("o_custkey") % 3000)))
        .when(form == 1, F.concat(F.lit("the "), "p_name", F.lit(" round")))
        .when(form == 2, F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), number))
        .when(form == 3, F.concat(F.lit("Big "), F.upper("p_brand"), F.lit(" "), text(F.col("o_custkey") % 60)))
        .otherwise(F.col("o_orderpriority"))
    )
    place = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Lot "), text(F.col("o_custkey") % 5000), F.lit(" end")))
    events = rows.select("o_orderkey", name.alias("name"), place.alias("place"))
    return circuits.add_circuit_key(events, ["name", "place"], dim, None, "circuit").select("o_orderkey", "circuit")


@query(
    "grid_interpret",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN cast(o_custkey % 25 AS varchar) WHEN 1 THEN '0' WHEN 2 THEN '-3'
   WHEN 3 THEN 'PL' WHEN 4 THEN ' ' ELSE NULL END AS g, o_custkey % 25 AS v FROM orders),
x AS (SELECT CASE WHEN o_orderkey % 6 = 0 AND v > 0 THEN v END AS grid,
  CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN v > 0 THEN 'Grid P' || v ELSE 'Unclassified / Non-standard Grid Position (0)' END
    WHEN 1 THEN 'Unclassified / Non-standard Grid Position (0)' WHEN 2 THEN 'Non-standard Grid Position (-3)'
    WHEN 3 THEN 'Non-numeric Grid Position (PL)' ELSE 'Grid position unrecorded' END AS note, o_orderkey FROM r)
SELECT grid, note, CASE WHEN grid <= 2 THEN 'front_row' WHEN grid <= 5 THEN 'top_5' WHEN grid <= 10 THEN 'points_zone'
   WHEN grid <= 16 THEN 'midfield' WHEN grid IS NOT NULL THEN 'backmarkers' END AS bucket,
  count(*) AS n, cast(sum(CASE WHEN grid > 0 AND o_orderkey % 20 > 0 THEN grid - o_orderkey % 20 END) AS bigint) AS gained FROM x GROUP BY ALL""",
)
def grid_interpret(spark, sf):
    o = star.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, (F.col("o_custkey") % 25).cast("string")).when(k == 1, "0").when(k == 2, "-3").when(k == 3, "PL").when(k == 4, " ")
    )
    rows = o.select("o_orderkey", numbers.interpret_grid(raw).alias("g")).select("o_orderkey", "g.grid", "g.note")
    gained = numbers.positions_gained(F.col("grid"), F.col("o_orderkey") % 20)
    return shown(
        rows.groupBy("grid", "note", numbers.grid_bucket(F.col("grid")).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(gained).alias("gained")
        )
    )


@query(
    "era_rules",
    """WITH y AS (SELECT 1950 + o_orderkey % 80 AS yr, o_custkey % 2 = 0 AS two FROM orders)
SELECT yr, two, cast(CASE WHEN yr >= 2026 THEN 22 WHEN yr >= 2017 THEN 20 WHEN yr >= 2013 THEN 22 WHEN yr >= 2010 THEN 24 ELSE 20 END AS bigint) AS field,
  CASE WHEN yr >= 2006 THEN 'Knockout' WHEN yr = 2005 AND two THEN 'Qualifying Aggregate (QA)' WHEN yr >= 2003 THEN 'Single Lap Shootout (QO/QB)'
    WHEN yr >= 1994 THEN 'Qualifying Best Lap (QB)' ELSE 'Pre-1994 Archive' END AS format,
  CASE WHEN yr >= 2006 THEN 'Q' WHEN yr = 2005 AND two THEN 'QA' ELSE 'QB' END AS code, count(*) AS n FROM y GROUP BY ALL""",
)
def era_rules(spark, sf):
    o = star.table(spark, sf, "orders").select((F.lit(1950) + F.col("o_orderkey") % 80).alias("yr"), (F.col("o_custkey") % 2 == 0).alias("two"))
    counted = o.groupBy("yr", "two").agg(F.count(F.lit(1)).alias("n"))
    fmt = numbers.qualifying_format(F.col("yr"), F.col("two"))
    return shown(counted.select("yr", "two", numbers.expected_field(F.col("yr")).alias("field"), fmt["format"].alias("format"), fmt["code"].alias("code"), "n"))


@query(
    "event_status",
    """WITH e AS (SELECT o_orderkey % 6 AS form, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate FROM orders)
SELECT form, CASE WHEN form = 0 THEN 'Advisory: Likely Cancelled' WHEN form IN (1, 2) THEN 'Date Unknown'
    WHEN o_orderdate < TIMESTAMP '1998-06-15' OR (o_orderdate = TIMESTAMP '1998-06-15' AND form = 4) THEN 'Scheduled (Past Date)'
    ELSE 'Upcoming' END AS status, count(*) AS n FROM e GROUP BY ALL""",
)
def event_status(spark, sf):
    o = star.table(spark, sf, "orders")
    form, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(form == 0, "Old GP [Cancelled]").otherwise("Old GP")
    date = F.when(form == 1, F.lit(None)).when(form == 2, "1998-13-45").otherwise(day)
    clock = F.when(form == 4, "05:00:00Z").when(form == 5, "14:00:00Z")
    now = F.lit("1998-06-15 12:00:00").cast("timestamp")
    return o.groupBy(form.alias("form"), numbers.event_status(name, date, clock, now).alias("status")).agg(F.count(F.lit(1)).alias("n"))
