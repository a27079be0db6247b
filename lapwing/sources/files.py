"""File sources and sinks: tolerant CSV, landed sessions, manifests, configuration, exports."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.functions.names import session_name
from lapwing.functions.timing import number, seconds
from lapwing.operators.grids import MANIFEST_SCHEMA
from lapwing.operators.pit_plans import Compound, Strategy
from lapwing.schema import FORECAST_COLUMNS, LAP_ALIASES, SESSION_ALIASES

FILE_NAME = r"(\d{4})_round_(\d+)_([a-z0-9_]+)\.csv"
PARTITIONS = ["season", "rnd", "session"]


# A record may hold line breaks and a field commas, inside quotes; a quote that is never closed stands for itself.
_RECORD = r'(?:[^"\r\n]++|"[^"]*+"|")++'
_FIELD = r',((?:[^",]++|"[^"]*+"|")*+)'


def csv_fields(record: Column) -> Column:
    """Fields of a CSV record, however many it has; an empty field without quotes is null."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))
    quoted = lambda f: f.rlike(r'(?s)^".*"$') & (F.length(f) > 1)
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda f: F.when(quoted(f), inner(f)).when(f != "", f))


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files whose headers differ, to (file, line, cells) with ``cells`` a map of header to text.

    Session files hold tens to hundreds of rows, so one file is one record here.
    An empty file, a header without rows, or a row without its commas simply
    yields no cells; nothing fails.  Any number of columns is read, and quoted
    fields may hold line breaks.  Paths may be globs.
    """
    whole = spark.read.text(paths, wholetext=True)
    records = F.regexp_extract_all(F.regexp_replace("value", "\ufeff", ""), F.lit(_RECORD), F.lit(0))
    lines = whole.select(F.input_file_name().alias("file"), F.filter(records, lambda r: F.trim(r) != "").alias("l"))
    header = csv_fields(F.get("l", F.lit(0)))
    rows = lines.where(F.size("l") > 0).select("file", header.alias("h"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("line", "text"))
    rows = rows.withColumn("v", F.slice(csv_fields(F.col("text")), F.lit(1), F.size("h")))
    names = F.transform("h", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    # a header may repeat a name; the first column of that name counts
    pairs = F.filter(
        F.arrays_zip(names.alias("k"), F.col("v").alias("v"), F.sequence(F.lit(1), F.size("h")).alias("i")),
        lambda p: F.array_position(names, p["k"]) == p["i"],
    )
    kv = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    return rows.select("file", F.col("line").cast("long").alias("line"), kv.alias("cells"))


LARGE_FILE = 4 << 20  # bytes from which a file is read in pieces
HEADER_BYTES = 1 << 20
HEADERS_AT_ONCE = 16


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, size`` of all files; nothing is read."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a file, by Spark's own file system classes, so from any store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"), HEADER_BYTES)
        return (reader.readLine() or "").removeprefix("\ufeff")
    finally:
        stream.close()


def read_large_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Large files of one header, whose names ``columns`` gives, to the same (file, line, cells) shape.

    Splittable, unlike :func:`read_csv`: a file makes as many tasks as it has pieces.  A short row keeps the cells it has.
    ``line`` orders rows inside a file.  A quoted field may hold commas, not line breaks.
    """
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", enforceSchema=True, escape='"').csv(paths)
    first = {c.strip(): i for i, c in reversed(list(enumerate(columns)))}  # of equal names the first column counts
    kv = F.create_map(*[x for c, i in sorted(first.items(), key=lambda x: x[1]) for x in (F.lit(c), F.col(f"c{i}"))])
    # grows along the file: pieces in order, and rows in order inside a piece of at most 2**26 rows
    at = F.shiftleft("_metadata.file_block_start", 26) + F.monotonically_increasing_id() % (1 << 26)
    return rows.select(F.input_file_name().alias("file"), at.alias("line"), kv.alias("cells"))


def scan_csv(spark: SparkSession, paths: str | Sequence[str], large: int = LARGE_FILE) -> DataFrame:
    """CSV files of any sizes and headers, to (file, line, cells).

    Files below ``large`` bytes are read whole, as :func:`read_csv` does.  Larger ones are grouped by their header line, and
    each group is one splittable reader.  The driver sees sizes, and the headers of large files: one short read each.
    """
    sizes = [(r["file"], r["size"]) for r in list_files(spark, paths).where(F.col("size") > 0).toLocalIterator()]
    small, long = [f for f, n in sizes if n < large], [f for f, n in sizes if n >= large]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(partial(_first_line, spark), long))
    groups: dict[str, list[str]] = {}
    for file, header in zip(long, headers):
        groups.setdefault(header.rstrip("\r"), []).append(file)
    parts = [read_csv(spark, small)] if small else []
    for header, files in groups.items():
        parts.append(read_large_csv(spark, files, [c or "" for c in next(csv.reader([header]), [])]))
    if not parts:
        return spark.createDataFrame([], "file string, line long, cells map<string,string>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cast(text: Column, kind: str) -> Column:
    if kind == "double":
        return number(text)
    if kind == "int":
        return number(text).cast("int")
    if kind == "seconds":
        return seconds(text)
    if kind == "boolean":
        return F.when(F.lower(F.trim(text)).isin("true", "1", "1.0"), True).when(F.lower(F.trim(text)).isin("false", "0", "0.0"), False)
    bare = F.trim(text)
    return F.when((bare != "") & ~F.lower(bare).isin("nan", "none", "nat"), bare)


def canonical(cells: DataFrame, aliases: dict) -> DataFrame:
    """Canonical columns: the first alias that holds a usable value."""
    picked = {
        name: F.coalesce(*[_cast(F.try_element_at("cells", F.lit(a)), kind) for a in sources]) for name, (kind, sources) in aliases.items()
    }
    return cells.withColumns(picked).drop("cells")


def with_file_keys(rows: DataFrame) -> DataFrame:
    """Season, round and session from the file name; the session folds synonyms."""
    part = lambda i: F.regexp_extract("file", FILE_NAME, i)
    return rows.withColumns(
        {
            "season": part(1).try_cast("int"),
            "rnd": part(2).try_cast("int"),
            "session": session_name(F.translate(part(3), "_", " ")),
        }
    )


def read_sessions(spark: SparkSession, paths: str | Sequence[str], max_round: int | None = None) -> DataFrame:
    """Race, qualifying and sprint files."""
    rows = with_file_keys(canonical(scan_csv(spark, paths), SESSION_ALIASES))
    return rows if max_round is None else rows.where(F.col("rnd") <= max_round)


def read_laps(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Practice lap files; a missing stint or compound gets the neutral value."""
    rows = with_file_keys(canonical(scan_csv(spark, paths), LAP_ALIASES))
    return rows.withColumn("stint", F.coalesce("stint", F.lit(1.0))).withColumn("compound", F.coalesce(F.upper("compound"), F.lit("UNKNOWN")))


def prefer_source(parts: Sequence[DataFrame], keys: Sequence[str] = PARTITIONS) -> DataFrame:
    """Stacks sources in order of preference and keeps, per key, only the first source that has it."""
    stack = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_priority", F.lit(i))
        stack = tagged if stack is None else stack.unionByName(tagged, allowMissingColumns=True)
    best = stack.groupBy(*keys).agg(F.min("_priority").alias("_best"))
    return stack.join(best, list(keys)).where(F.col("_priority") == F.col("_best")).drop("_priority", "_best")


def land(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Session table in Parquet, one folder per season, round and session."""
    rows.repartition(*PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def load(
    spark: SparkSession,
    path: str,
    season: int | None = None,
    rounds: Sequence[int] | None = None,
    sessions: Sequence[str] | None = None,
    max_round: int | None = None,
) -> DataFrame:
    """Landed sessions; the filters are on partition columns, so other folders are not listed."""
    df = spark.read.parquet(path)
    if season is not None:
        df = df.where(F.col("season") == season)
    if rounds is not None:
        df = df.where(F.col("rnd").isin(*rounds))
    if sessions is not None:
        df = df.where(F.col("session").isin(*sessions))
    if max_round is not None:
        df = df.where(F.col("rnd") <= max_round)
    return df


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Point lookup: one session, one round or one circuit's history, by equality on its keys."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def merge_history(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of yearly tables whose columns differ."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_manifests(spark: SparkSession, path: str, circuit: str | None = None) -> DataFrame:
    """Manifest documents, one per file; optionally only those of a circuit."""
    df = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return df if circuit is None else df.where(F.lower(F.trim("circuit_key")) == circuit.lower().strip())


def write_manifests(documents: DataFrame, path: str, header: Sequence[str]) -> None:
    """One JSON document per line."""
    documents.select(*header, "grid").write.mode("errorifexists").json(path)


TRACKS_SCHEMA = (
    "tracks map<string,struct<display_name:string,circuit_name:string,country:string,event_name_patterns:array<string>,"
    "round_2026:int,circuit_type:string,track_length_km:double,straightness:double,speed_bias:double,overtaking_ease:double,"
    "historical_data_available:boolean,historical_years:array<int>,sprint_weekend_2026:boolean,known_penalties_2026:map<string,int>>>"
)
STRATEGY_SCHEMA = (
    "default_pit_loss_seconds double, stationary_stop_seconds double, sc_pit_loss_discount double, vsc_pit_loss_discount double, "
    "fuel_effect_seconds_per_lap double, nominal_fuel_laps int, "
    "compounds map<string,struct<base_deg_rate_sec_per_lap:double,pace_delta_sec:double,max_usable_laps:int>>, "
    "circuit_priors map<string,struct<sc_probability:double,vsc_probability:double,red_flag_probability:double,"
    "pit_loss_seconds:double,deg_multiplier:double>>, "
    "wet_weather struct<intermediate_rain_threshold:double,heavy_rain_threshold:double,pace_variance_dry:double,"
    "pace_variance_intermediate:double,pace_variance_heavy_wet:double,sc_probability_wet_multiplier:double,"
    "dnf_probability_wet_multiplier:double,driver_wet_skill_bonuses:map<string,double>>"
)


def _strategy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", STRATEGY_SCHEMA).alias("s")).select("s.*")


def read_strategy(spark: SparkSession, path: str) -> Strategy:
    """The constants of a strategy configuration (one document); what it leaves out keeps its default."""
    row = _strategy(spark, path).first()
    plain = Strategy()
    if row is None:
        return plain
    compounds = {k: Compound(v["base_deg_rate_sec_per_lap"], v["pace_delta_sec"], v["max_usable_laps"]) for k, v in (row["compounds"] or {}).items()}
    either = lambda value, default: default if value is None else value
    return Strategy(
        pit_loss=either(row["default_pit_loss_seconds"], plain.pit_loss),
        fuel_per_lap=either(row["fuel_effect_seconds_per_lap"], plain.fuel_per_lap),
        compounds=plain.compounds | {k.upper(): c for k, c in compounds.items()},
    )


def read_wet_weather(spark: SparkSession, path: str) -> DataFrame:
    """Wet-weather settings: one row of thresholds and factors, with the drivers' skills as a map."""
    return _strategy(spark, path).select("wet_weather.*")


def read_wet_skills(spark: SparkSession, path: str) -> DataFrame:
    """``driver, wet_skill``: seconds an entrant gains in the wet."""
    return _strategy(spark, path).select(F.explode("wet_weather.driver_wet_skill_bonuses").alias("driver", "wet_skill"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Circuit configuration to one row per circuit, in configuration order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", TRACKS_SCHEMA)["tracks"].alias("t"))
    rows = rows.select(F.posexplode(F.map_entries("t")).alias("ordinal", "e"))
    out = rows.select("ordinal", F.col("e.key").alias("key"), F.col("e.value").alias("v")).select("ordinal", "key", "v.*")
    return out.withColumnRenamed("event_name_patterns", "patterns")


def read_circuit_priors(spark: SparkSession, path: str) -> DataFrame:
    """Strategy configuration to one row of priors per circuit."""
    return _strategy(spark, path).select(F.explode("circuit_priors").alias("circuit_key", "v")).select("circuit_key", "v.*")


def event_round(events: DataFrame, tracks: DataFrame, track: str, configured: str = "round_2026") -> DataFrame:
    """Events that belong to a circuit: configured round, else a pattern in the name, else in the location.

    Only the best tier that matches anything is kept, in each season.  The circuit is one row of configuration, read first.
    """
    row = tracks.where(F.col("key") == track.lower().strip()).select(F.col(configured), "patterns").first()
    if row is None:
        return events.limit(0)
    patterns = [p.lower().strip() for p in row[1] or [] if p and p.strip()]
    has = lambda c: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), p)) if patterns else F.lit(False)
    tier = F.when(F.col("rnd") == F.lit(row[0]), 1).when(has("event_name"), 2).when(has("location"), 3)
    first = Window.partitionBy("season").orderBy("_tier", "rnd")
    ranked = events.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    return ranked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r", "_tier")


def export_forecast(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Forecast table with its fixed column order; absent columns are written as nulls."""
    cols = [F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in FORECAST_COLUMNS]
    writer = table.select(*cols).write.mode("errorifexists")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def export_tables(tables: dict[str, DataFrame], path: str, metadata: dict[str, str] | None = None) -> None:
    """Benchmark tables, one folder each, with a metadata table."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    if metadata and tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame(list(metadata.items()), "key string, value string").write.mode("errorifexists").parquet(f"{path}/metadata")
