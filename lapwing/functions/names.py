"""Entity names: entrants, teams and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Session synonyms.
SESSION_NAMES = {
    "fp1": "fp1",
    "practice 1": "fp1",
    "free practice 1": "fp1",
    "fp2": "fp2",
    "practice 2": "fp2",
    "free practice 2": "fp2",
    "fp3": "fp3",
    "practice 3": "fp3",
    "free practice 3": "fp3",
    "sprint qualifying": "sprint_qualifying",
    "sprint shootout": "sprint_qualifying",
    "sq": "sprint_qualifying",
    "sprint": "sprint_race",
    "sprint race": "sprint_race",
    "qualifying": "qualifying",
    "quali": "qualifying",
    "race": "race",
}

BLANK_WORDS = ("NAN", "NONE")
SERVICE_PREFIXES = ("SC", "MC", "FM", "TC")
SERVICE_NAMES = ("SAFETY CAR", "MEDICAL CAR", "TEST CAR")
SERVICE_BROADCAST = SERVICE_NAMES + ("COURSE CAR",)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def session_name(raw: Column) -> Column:
    """Synonym lookup on the folded name; unknown names become snake case."""
    clean = F.translate(F.lower(F.trim(raw)), "-", " ")
    hit = F.try_element_at(_map(SESSION_NAMES), F.translate(clean, "_", " "))
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(F.coalesce(hit, F.translate(clean, " ", "_")))


def clean_identifier(*candidates: Column) -> Column:
    """First identifier that is not blank or a null word."""
    usable = [F.when((F.trim(c) != "") & ~F.upper(F.trim(c)).isin(*BLANK_WORDS), F.trim(c)) for c in candidates]
    return F.coalesce(*usable, F.lit(""))


def normalise_entities(df: DataFrame, column: str, directory: DataFrame, out: str) -> DataFrame:
    """Code for a code, full name or surname; anything else stays, upper-cased.

    ``directory`` has (code, full_name).  Where two people share an alias the
    later code in the directory's order wins; pass an ``ordinal`` to say so.
    """
    order = F.col("ordinal") if "ordinal" in directory.columns else F.lit(0)
    base = directory.select(
        F.upper("code").alias("_code"), F.upper(F.trim("full_name")).alias("_full"), order.alias("_ord")
    )
    words = F.split("_full", r"\s+")
    aliases = base.select(
        F.explode(
            F.array_distinct(
                F.filter(
                    F.array("_code", "_full", F.when(F.size(words) >= 2, F.element_at(words, -1))),
                    lambda a: a.isNotNull(),
                )
            )
        ).alias("_alias"),
        "_code",
        "_ord",
    )
    lookup = aliases.groupBy("_alias").agg(F.max_by("_code", F.struct("_ord", "_code")).alias("_hit"))
    key = F.upper(F.trim(F.col(column).cast("string")))
    return (
        df.withColumn("_alias", key)
        .join(lookup, "_alias", "left")
        .withColumn(out, F.coalesce("_hit", "_alias"))
        .drop("_alias", "_hit")
    )


def team_name(raw: Column, aliases: dict[str, str]) -> Column:
    """Canonical team for an alias; blank becomes ``Unknown``; other names stay as written."""
    bare = F.trim(raw)
    blank = bare.isNull() | F.lower(bare).isin("nan", "none", "")
    hit = F.try_element_at(_map(aliases), F.upper(bare)) if aliases else F.lit(None).cast("string")
    return F.when(blank, "Unknown").otherwise(F.coalesce(hit, bare))


def is_service_vehicle(code: Column, broadcast: Column, full: Column, team: Column, number: Column) -> Column:
    """Safety, medical and test cars that appear in a classification."""
    c, b, f = (F.upper(F.trim(F.coalesce(x, F.lit("")))) for x in (code, broadcast, full))
    prefix = "|".join(SERVICE_PREFIXES)
    by_code = c.isin(*SERVICE_PREFIXES) | (c.rlike(f"^({prefix})") & (F.length(c) <= 4) & c.rlike(r"\d"))
    no_team = team.isNull() | F.lower(F.trim(team)).isin("nan", "none", "", "null")
    return (
        by_code
        | b.rlike("|".join(SERVICE_BROADCAST))
        | f.rlike("|".join(SERVICE_NAMES))
        | ((f == "NONE NONE") & no_team)
        | F.coalesce(no_team & (number > 100), F.lit(False))
    )
