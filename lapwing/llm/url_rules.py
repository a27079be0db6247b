"""URL filtering by association rules.

Spark's FP-growth mines combinations of URL tokens that go with a blocked label; rules of enough support and confidence are
kept, a rule that says no more than a shorter one is dropped.  Rules are indexed by their rarest token: a URL looks up its
own tokens in this inverted index and only the rules found there are compared as a whole.  Stated rules for a host and a
path go before: a rule fits its host and all its subdomains if the path begins with the rule's; the longest wins.

Tokens that occur in exactly the same labelled URLs are mined as one, their smallest, and those of all labelled URLs not at
all: a rule with such a token says no more than the rule without it, and n of them would make 2**n combinations.

Tokens: every label of the host with its place from the right, every part of the path (numbers as ``#``), the file
ending, names of query parameters, the scheme.  A label is ``block`` for a page whose label row says toxic or of no quality.
Each distinct URL is judged once.  The host stands between the first ``://`` and ``/``, ``?`` or ``#``, in lower case; a URL that
is null or has no ``://`` has an empty host and path, fits no stated rule, and is judged by its tokens.  Without labels, or
without blocked ones, nothing is mined and nothing is blocked by the method.  Repeated rows give equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.scratch import Scratch

BLOCK = "=block"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    url = F.coalesce(url, F.lit(""))
    labels = F.reverse(F.split(host_of(url), r"\."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    names = F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda p: p != "")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    found = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(names, lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "(?s)^([^=]*)", 1))),
        F.array(F.concat(F.lit("end:"), F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)), F.concat(F.lit("scheme:"), scheme)),
    )
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"^[a-z0-9]+:$")))


def _apart(rows: DataFrame) -> DataFrame:
    """``x`` of tokens worth mining, from rows ``k, t``: one of those that always come together, none that is everywhere.

    A token's rows are summed up as a count and two sums of hashes, which are equal for equal sets of rows only, but for a
    chance of 2**-100.
    """
    mark = lambda seed: F.sum(F.xxhash64("k", F.lit(seed)).cast("decimal(38,0)"))
    where = rows.select("k", F.explode("t").alias("x")).groupBy("x").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b"))
    whole = rows.agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b"))
    return where.join(whole, ["n", "a", "b"], "leftanti").groupBy("n", "a", "b").agg(F.min("x").alias("x")).select("x")


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = 0.5, lift: float = 1.2) -> DataFrame:
    """Rules for blocking: ``items, confidence, support, key``; ``key`` is the rarest of the items."""
    spark = pages.sparkSession
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(bad).alias("bad"))
    rows = pages.select(F.col("page_id").cast("long").alias("k"), tokens_of(F.col("url")).alias("t")).join(marks, "k")
    scratch = Scratch(spark, "urls")
    # a page whose number repeats is as many rows; each gets a key of its own
    rows = scratch.keep(rows.select(F.struct("k", F.monotonically_increasing_id()).alias("k"), "t", "bad"))
    kept = rows.select("k", "bad", F.explode_outer("t").alias("x")).join(_apart(rows).withColumn("kept", F.lit(True)), "x", "left")
    kept = kept.groupBy("k").agg(F.first("bad").alias("bad"), F.collect_list(F.when(F.col("kept"), F.col("x"))).alias("t"))  # a URL's tokens
    items = F.when(F.col("bad"), F.concat("t", F.array(F.lit(BLOCK)))).otherwise(F.col("t"))
    rows = scratch.keep(kept.select(items.alias("items")).where("size(items) > 0"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).where(F.col("lift") >= lift)
    found = scratch.keep(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support"))
    # A rule is of no use if dropping one item leaves a rule of the same confidence or more.
    shorter = found.select(F.col("items").alias("less"), F.col("confidence").alias("c"))
    each = found.select("items", "confidence", F.explode("items").alias("x")).where("size(items) > 1")
    each = each.withColumn("less", F.array_remove("items", F.col("x")))
    idle = each.join(shorter, "less").where("c >= confidence").select("items").distinct()
    found = found.join(idle, "items", "leftanti")
    often = rows.select(F.explode("items").alias("x")).groupBy("x").count()
    keyed = found.select("items", F.explode("items").alias("x")).join(often, "x")
    keyed = keyed.groupBy("items").agg(F.min(F.struct("count", "x")).alias("m")).select("items", F.col("m.x").alias("key"))
    return scratch.keep(found.join(keyed, "items"))


def judge(pages: DataFrame, rules: DataFrame, stated: tuple[Rule, ...] = ()) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of every row; confidence is that of the best mined rule."""
    urls = pages.select("url").where("url is not null").distinct().withColumn("tokens", tokens_of(F.col("url")))
    probes = urls.select("url", "tokens", F.explode("tokens").alias("key"))
    hits = probes.join(rules.select("key", "items", "confidence"), "key").where(F.size(F.array_except("items", "tokens")) == 0)
    blocked = hits.groupBy("url").agg(F.max("confidence").alias("confidence"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.join(blocked, "url", "left")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    for r in sorted(stated, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "confidence")
