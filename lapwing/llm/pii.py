"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are the spans of strict patterns (the base) and of wider ones: e-mail addresses written out with (at) and
(dot), telephone numbers without a country code, card numbers of 13 to 15 digits, IPv6 addresses.  Five labelers vote yes,
no or nothing on each: a pattern labeler, a gazetteer of domains, calling codes, issuers and reserved address blocks, two
context labelers (words before the span; what it touches) and one on the variety of its digits.

Expectation-maximisation turns the votes into each labeler's reliability and each vote pattern's chance of being right.
It runs on counts of vote patterns over the whole corpus: 4 kinds times 3**5 patterns at most.  A logistic regression
(Spark ML) is then trained on these chances as soft labels, and decides about the wider candidates: those of chance
``THRESHOLD`` or more are added.  Base spans stay whatever it says.

A match of a base pattern that fails its check (address part over 255, digit count, Luhn) is dropped and isn't tried
again; a wider candidate that touches a base span is dropped too.  Overlaps of different kinds stay.
Null texts count as empty; empty texts have no span.  Places are code points, ends exclusive.  Repeated rows give equal
rows.  Without any candidate nothing is trained and there are no spans.  All of it is column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
ROUNDS = 30

# The base patterns.  Runs that can only be matched from their first character are guarded and possessive,
# which changes no match but keeps the time proportional to the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+-])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}+(?![0-9-])",
    "phone": r"(?<![0-9+.)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
WIDE_NEEDS = {"email": r"(?i)[(\[]at[)\]]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}[\x20-][0-9]{6}", "phone": r"[0-9]{3}[.-][0-9]{4}"}
# Gazetteers and cue words.
DOMAINS = r"(?i)(com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|pt|se|jp|cn|br|in|au|ca)$"
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(0|10|127|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|2[3-5][0-9])\."
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
CUES = r"(?i)(e-?mail|mailto|contact|write|phone|tel|call|mobile|fax|card|visa|credit|account|address|host|login)[^A-Za-z]*$"
COUNTER = r"(?i)(version|order|invoice|isbn|issn|ref|page|chapter|item|serial|price|total)[^A-Za-z]*$|[$€£%#]\s*$"

_EMPTY = "array<struct<kind:int,start:int,end:int,base:boolean,good:boolean,votes:array<int>>>"


def _matches(text: Column, pattern: str, needed: Column | None) -> Column:
    """``hit, start, end`` of all matches: gaps and matches alternate, so running lengths give the places."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    none = F.array().cast("array<struct<hit:string,start:int,end:int>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(pair["hit"].alias("hit"), start.alias("start"), end.alias("end"))
        return F.when(pair["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.array_append(state["out"], found).alias("out")))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return found if needed is None else F.when(needed, found).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(F.substring(part(p), 1, 3).cast("int") <= 255))
    count = F.length(_digits(hit))
    if kind == "phone":
        return (count >= 8) & (count <= 15)
    return F.when((count >= 16) & (count <= 19), _luhn(_digits(hit))).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, text: Column, hit: Column, start: Column, end: Column, base: bool, good: Column) -> Column:
    before = F.substring(text, F.greatest(start - 29, F.lit(1)), F.least(start, F.lit(30)))
    touching = F.concat(F.substring(text, start, F.when(start > 0, 1).otherwise(0)), F.substring(text, end + 1, F.lit(1)))
    shape = _vote(F.lit(base) & good, ~good)
    if kind == "email":
        known = _vote(hit.rlike(DOMAINS), ~hit.rlike(r"[A-Za-z]{2,}$"))
        variety = _vote(F.length(hit) >= 8, F.length(hit) < 6)
    elif kind == "ip":
        known = _vote(hit.contains(".") & ~hit.rlike(RESERVED), hit.rlike(r"^(0|127|255)\.|^[0:]+$"))
        variety = _vote(F.size(F.array_distinct(F.split(hit, r"[.:]"))) >= 3, F.size(F.array_distinct(F.split(hit, r"[.:]"))) == 1)
    else:
        digits = _digits(hit)
        known = _vote(digits.rlike(ISSUERS), ~digits.rlike("^[2-6]")) if kind == "card" else _vote(hit.rlike(CALLING) | hit.rlike(r"^\(?[2-9][0-9]{2}"), hit.rlike(r"^\(?[01]|^\+0"))
        kinds = F.size(F.array_distinct(F.split(digits, "")))
        variety = _vote(kinds >= 4, kinds <= 2)
    return F.array(shape, known, _vote(before.rlike(CUES), before.rlike(COUNTER)), _vote(~touching.rlike(r"[\p{L}0-9_]"), touching.rlike("[0-9_]")), variety)


def _candidate(text: Column, number: int, base: bool) -> Callable[[Column], Column]:
    kind = KINDS[number]

    def row(m: Column) -> Column:
        if base:
            good = _valid(kind, m["hit"])
        else:
            good = _luhn(_digits(m["hit"])) if kind == "card" else F.lit(True)
        votes = _votes(kind, text, m["hit"], m["start"], m["end"], base, good)
        return F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(base).alias("base"), good.alias("good"), votes.alias("votes"))

    return row


def candidates(text: Column) -> Column:
    """All candidates of a text: ``kind, start, end, base, good, votes``."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    for number, kind in enumerate(KINDS):
        need = NEEDS[kind]
        gate = text.contains(need) if need else text.rlike("[0-9]")
        if kind == "ip":
            gate = text.rlike(r"[0-9]\.[0-9]")

        sides = ((BASE[kind], gate, True), (WIDE[kind], text.rlike(WIDE_NEEDS[kind]), False))
        for pattern, needed, base in sides:
            parts.append(F.transform(_matches(text, pattern, needed), _candidate(text, number, base)))
    return F.concat(*parts).cast(_EMPTY)


def _unspoiled(found: Column) -> Column:
    """Good candidates; wider ones only where they touch no base span."""

    def apart(c: Column) -> Column:
        return ~F.exists(found, lambda b: b["base"] & b["good"] & (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return F.filter(found, lambda c: c["good"] & F.when(c["base"], True).otherwise(apart(c)))


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Chance of being right for each kind and vote pattern, from ``(kind, votes, count)``.

    Each labeler has a chance of a yes on right and on wrong spans where it votes, shared by all kinds; no vote is no
    evidence.  Each kind has its share of right spans.  Starts from the majority, one vote ahead, and smooths counts by one.
    """
    if not patterns:
        return {}
    width = len(patterns[0][1])
    chance = [1 / (1 + math.exp(-(sum(v) + 0.5))) for _, v, _ in patterns]
    for _ in range(ROUNDS):
        table = [[{-1: 1.0, 1: 1.0} for _ in range(width)] for _ in range(2)]
        share = {k: [1.0, 1.0] for k, _, _ in patterns}
        for (kind, votes, n), p in zip(patterns, chance):
            for side, weight in ((0, n * (1 - p)), (1, n * p)):
                share[kind][side] += weight
                for j, x in enumerate(votes):
                    if x:
                        table[side][j][x] += weight
        logs = [[{x: math.log(t[x] / sum(t.values())) for x in t} for t in side] for side in table]
        new = []
        for kind, votes, _ in patterns:
            score = [math.log(share[kind][s]) + sum(logs[s][j][x] for j, x in enumerate(votes) if x) for s in (0, 1)]
            new.append(1 / (1 + math.exp(max(-60.0, min(60.0, score[0] - score[1])))))
        chance = new
    return {(k, v): p for (k, v, _), p in zip(patterns, chance)}


def train(docs: DataFrame) -> list[float]:
    """Weights of the span classifier: the bias, one for each kind, one for each labeler.  Empty without candidates."""
    spark = docs.sparkSession
    spans = docs.select(F.explode(_unspoiled(candidates(F.col("text")))).alias("s"))
    counted = spans.groupBy("s.kind", "s.votes").count().orderBy("kind", "votes").collect()  # 4 * 3**5 rows at most
    patterns = [(r["kind"], tuple(r["votes"]), r["count"]) for r in counted]
    chance = expectation_maximisation(patterns)
    if not chance:
        return []
    rows = []
    for kind, votes, n in patterns:
        x = [1.0 if k == kind else 0.0 for k in range(len(KINDS))] + [float(v) for v in votes]
        p = chance[kind, votes]
        rows += [(x, 1.0, n * p + 1e-6), (x, 0.0, n * (1 - p) + 1e-6)]
    soft = spark.createDataFrame(rows, "x array<double>, label double, weight double").select(array_to_vector("x").alias("features"), "label", "weight")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(soft.coalesce(1))
    return [float(model.intercept), *[float(v) for v in model.coefficients]]


def spans(text: Column, weights: list[float]) -> Column:
    """Base spans and the wider ones that the classifier takes: ``kind, start, end, base``, by kind, then start."""
    found = _unspoiled(candidates(text))
    if not weights:
        return F.filter(found, lambda c: c["base"])
    own = F.array(*[F.lit(w) for w in weights[1 : 1 + len(KINDS)]])
    of_votes = F.array(*[F.lit(w) for w in weights[1 + len(KINDS) :]])

    def chance(c: Column) -> Column:
        points = F.aggregate(F.zip_with(of_votes, c["votes"], lambda w, v: w * v), F.lit(weights[0]), lambda s, x: s + x)
        return 1 / (1 + F.exp(-(points + F.element_at(own, c["kind"] + 1))))

    return F.array_sort(F.filter(found, lambda c: F.when(c["base"], True).otherwise(chance(c) >= THRESHOLD)))


def find(docs: DataFrame, weights: list[float]) -> DataFrame:
    """``doc_id, spans`` of every row; spans are ``kind, start, end, base``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans(F.col("text"), weights).alias("spans"))


def redact(docs: DataFrame, weights: list[float]) -> DataFrame:
    """The rows of ``docs``, with all columns: spans are replaced by ``[KIND]``; of overlapping spans the first stays
    and the text up to the last end goes.  Null texts stay null; a column ``n_chars`` is set to the new length."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(text: Column, found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

        def step(state: Column, c: Column) -> Column:
            fresh = c["start"] >= state["at"]
            piece = F.concat(F.substring(text, state["at"] + 1, c["start"] - state["at"]), F.element_at(labels, c["kind"] + 1))
            pieces = F.when(fresh, F.array_append(state["out"], piece)).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], c["end"]).alias("at"), pieces.alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("row"), spans(F.col("text"), weights).alias("spans"))
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(cut(F.col("row.text"), F.col("spans")))
    marked = marked.select("row", text.alias("clean"))
    columns = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == "text":
            own = F.col("clean")
        elif c == "n_chars":
            own = F.when(F.col("clean").eqNullSafe(F.col("row.text")), own).otherwise(F.length("clean").cast(docs.schema[c].dataType))
        columns.append(own.alias(c))
    return marked.select(*columns)
