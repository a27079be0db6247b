"""Circuit names: any identifier to its canonical key, over circuit tables of any size.

Four tiers decide, the first that holds: the key itself; an alias; in the table's order, a name equal to the identifier or
a display name inside it; in the table's order, a pattern inside it.  Equal names are an equi-join.  For names inside an
identifier, each name is listed under its rarest run of letters and identifiers are cut into such runs: the join meets only
names that share one, checks them, and keeps the least (tier, place).  Every distinct identifier is resolved once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 6  # letters of a run; shorter names are listed whole


def _slug(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def _spaced(c: Column) -> Column:
    return F.trim(F.translate(F.lower(F.trim(c)), "_", " "))


def _low(c: Column) -> Column:
    return F.lower(F.trim(c))


def _rule(tier: int, place: Column, key: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), place.cast("long").alias("place"), key.alias("key"))


def _forms(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Both ways an identifier is read: with spaces, and as a slug."""
    both = F.array(F.struct(F.lit("spaced").alias("form"), _spaced(text).alias("read")), F.struct(F.lit("slug").alias("form"), _slug(text).alias("read")))
    return rows.select(*keep, F.inline(both))


def _runs(text: Column, length: Column) -> Column:
    """All distinct runs of a length inside a text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, length)))


def _names(circuits: DataFrame, aliases: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Names to equal and names to hold, as ``form, name, rule``; of rules for one name the first is kept."""
    rows = circuits.select("ordinal", "key", _low(F.col("display_name")).alias("shown"), _low(F.col("circuit_name")).alias("course"), F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))
    patterns = rows.select("ordinal", "key", F.explode("patterns").alias("name")).withColumn("name", _low(F.col("name"))).where("name <> ''")
    called = rows.select("ordinal", "key", F.explode(F.array("shown", "course")).alias("name")).where("name <> ''").unionByName(patterns)
    equal = rows.select(F.lit("slug").alias("form"), F.col("key").alias("name"), _rule(1, F.lit(0), F.col("key")).alias("rule"))
    if aliases is not None:
        known = aliases.join(rows.select("key").distinct(), "key")
        equal = equal.unionByName(known.select(F.lit("slug").alias("form"), F.col("alias").alias("name"), _rule(2, F.lit(0), F.col("key")).alias("rule")))
    own = _rule(3, F.col("ordinal"), F.col("key"))
    for form, name in (("spaced", F.col("name")), ("slug", F.translate("name", " ", "_"))):
        equal = equal.unionByName(called.select(F.lit(form).alias("form"), name.alias("name"), own.alias("rule")))
    held = rows.where("shown <> ''").select(F.lit("spaced").alias("form"), F.col("shown").alias("name"), own.alias("rule"))
    late = _rule(4, F.col("ordinal"), F.col("key")).alias("rule")
    for form in ("spaced", "slug"):
        held = held.unionByName(patterns.select(F.lit(form).alias("form"), "name", late))
    first = lambda df: df.groupBy("form", "name").agg(F.min("rule").alias("rule"))
    return first(equal), first(held)


def resolve(identifiers: DataFrame, circuits: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``identifier, key`` of the distinct non-empty values of the only column, where a tier holds.

    ``circuits`` has ordinal, key, display_name, circuit_name and patterns; ``aliases`` has alias (a slug) and key, and counts
    only where its key is in the table.
    """
    texts = identifiers.toDF("identifier").where(F.trim("identifier") != "").distinct()
    equal, held = _names(circuits, aliases)
    read = _forms(texts, F.col("identifier"), "identifier")
    exact = read.join(equal, (read["form"] == equal["form"]) & (read["read"] == equal["name"])).select("identifier", "rule")

    runs = held.withColumn("run", F.explode(_runs(F.col("name"), F.least(F.length("name"), F.lit(RUN)))))
    common = runs.groupBy("form", "run").agg(F.count("*").alias("n"))
    listed = runs.join(common, ["form", "run"]).groupBy("form", "name").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.first("rule").alias("rule"))
    lengths = [r[0] for r in listed.select(F.length("run")).distinct().collect()]  # at most RUN numbers
    parts = F.flatten(F.array(*[F.when(F.length("read") >= n, _runs(F.col("read"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in lengths]))
    cut = read.select("identifier", "form", "read", F.explode(parts).alias("run")) if lengths else read.select("identifier", "form", "read", F.lit("").alias("run"))
    inside = cut.join(listed, ["form", "run"]).where(F.contains("read", "name")).select("identifier", "rule")
    best = exact.unionByName(inside).groupBy("identifier").agg(F.min("rule").alias("rule"))
    return best.select("identifier", F.col("rule.key").alias("key"))


def add_circuit_key(
    df: DataFrame, columns: Sequence[str], circuits: DataFrame, aliases: DataFrame | None = None, out: str = "circuit_key"
) -> DataFrame:
    """Adds the key of the first of ``columns`` that resolves (event name, location, country, ...); null if none does."""
    texts = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("identifier"))
    found = resolve(texts, circuits, aliases)
    kept = df
    for i, c in enumerate(columns):
        kept = kept.join(found.select(F.col("identifier").alias(f"_i{i}"), F.col("key").alias(f"_k{i}")), F.col(c).cast("string") == F.col(f"_i{i}"), "left")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.coalesce(*[f"_k{i}" for i in range(len(columns))]).alias(out))
