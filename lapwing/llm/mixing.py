"""Mixing sources to target weights by Pareto order sampling.

A source's rate is its target over its size, in words; it says how often each of its documents is wanted.  The whole part
of the rate is taken of every document with certainty.  For the rest every document draws a uniform number ``u`` from a
hash of its content and is ranked by its odds over its inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``; documents are
taken in this order while they fit into the words still wanted.  So that a source's sample has a fixed size in words, the
words that are then missing are filled by up to ``CLOSERS`` later documents, each the largest that fits, and by one that
doesn't fit if it comes nearer.

The cut in the order of a source isn't found by sorting it.  Ranks fall into cells; sums of cells say in which cell the cut
is, and only that cell's documents are cut again, twice, until a handful is sorted.  Sums are combined before they are
shuffled, so a source with a third of all documents costs what any other costs.

Sizes count words ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have size 0 and are taken with 0 words.  A null source is a
source.  Documents that repeat a number, source and text are told apart by an ordinal, and each draws for itself; which of the
rows gets which ordinal doesn't change the rows of the result.  A table without words has targets of 0.  Other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.scratch import Scratch

MOST_COPIES = 3
CELLS = 4096
CLOSERS = 16


def word_count(text: Column) -> Column:
    words = F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0).cast("long")


def targets(sizes: DataFrame, scratch: Scratch, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh 1, 2, 3 and so on in turn and share all words by weight; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight among the others until none is above.
    A source stops where its size per weight is smallest, so the stops are found by one running sum in that order.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    # One row a source: the numbering and the running sums are over sources, not documents.
    s = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    run = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The share per weight if all sources before this one stop.  It stops too if its share would pass its cap.
    s = s.withColumn("share", (F.col("all") - F.col("capped")) / (F.col("weights") - F.col("gone")))
    s = s.withColumn("stops", F.col("share") * F.col("weight") > F.col("cap"))
    level = F.min(F.when(~F.col("stops"), F.struct("ratio", "gone", "share"))).over(everything)["share"]
    s = s.withColumn("level", level)
    target = F.when(F.col("stops") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return scratch.keep(s.select("source", "source_size", target.alias("target")))


def _cut(rows: DataFrame, cell: Column) -> DataFrame:
    """For each source: the first cell in which the running sum of words passes what is wanted, and the words before it."""
    sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("until", F.sum("words").over(run)).where("until > wanted")
    first = sums.groupBy("source").agg(F.min(F.struct("cell", (F.col("until") - F.col("words")).alias("before"))).alias("x"))
    return first.select(F.col("source").alias("s"), F.col("x.cell").alias("cut"), F.col("x.before").alias("before"))


def _content() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))


def _draw(seed: int) -> Column:
    return (F.pmod(F.xxhash64("content", "ordinal", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _repeated(rows: DataFrame) -> DataFrame:
    """``content`` of rows that occur more than once."""
    return rows.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")


def _with_ordinals(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``ordinal``: 1, and for repeated content 1, 2, 3 and so on.

    Rows carry the ``part`` they were read in.  Repeated ones are numbered inside their part, and parts are shifted by
    the counts of the parts before them, so that no task gets all rows of a content.
    """
    marked = rows.join(repeated.withColumn("again", F.lit(True)), "content", "left")
    counts = marked.where("again").groupBy("content", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("content", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("content", "part").orderBy(F.lit(0))
    numbered = marked.where("again").withColumn("k", F.row_number().over(inside)).join(counts, ["content", "part"])
    numbered = numbered.select(*rows.columns, (F.col("k") + F.col("shift")).cast("long").alias("ordinal"))
    return marked.where("again is null").select(*rows.columns, F.lit(1).cast("long").alias("ordinal")).unionByName(numbered)


def _place(p: Column, u: Column) -> Column:
    """The rank of a document, squeezed into 0 to 1 so that cells of equal width hold bounded parts of the order."""
    rank = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, rank / (1 + rank)).otherwise(F.lit(1.0))


def rules(docs: DataFrame, seed: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One row a source (``s``): size, target, whole copies, inclusion chance, the cut in its order, and the closers.

    Also all documents with their sizes and draws, and the contents that occur more than once (None if none does).
    """
    sized = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _content().alias("content"), F.spark_partition_id().alias("part")))
    repeated = scratch.keep(_repeated(sized))
    if repeated.isEmpty():
        repeated, sized = None, sized.withColumn("ordinal", F.lit(1).cast("long"))
    else:
        sized = scratch.keep(_with_ordinals(sized, repeated))
    sized = sized.select("doc_id", "source", "size", _draw(seed).alias("u"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    goal = goal.withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goal = goal.withColumnRenamed("source", "s").drop("rate")
    same = F.col("source").eqNullSafe(F.col("s"))
    rows = sized.where("size > 0").join(goal.where("p > 0"), same).drop("s")
    rows = scratch.keep(rows.select("source", "size", "doc_id", "wanted", _place(F.col("p"), F.col("u")).alias("place")))

    coarse = F.least(F.floor(F.col("place") * CELLS), F.lit(CELLS - 1)).cast("int")
    inside = rows.join(_cut(rows, coarse), same & (coarse == F.col("cut")))
    inside = scratch.keep(inside.withColumn("wanted", F.col("wanted") - F.col("before")).drop("s", "before").withColumnRenamed("cut", "outer"))
    fine = F.least(F.floor((F.col("place") * CELLS - F.col("outer")) * CELLS), F.lit(CELLS - 1)).cast("int")
    last = inside.join(_cut(inside, fine), same & (fine == F.col("cut")))
    last = last.withColumn("wanted", F.col("wanted") - F.col("before"))
    run = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("until", F.sum("size").over(run)).where("until > wanted")
    last = last.groupBy("source").agg(F.min(F.struct("place", "doc_id", "until", "size", "wanted")).alias("x"))
    gap = F.col("x.wanted") - (F.col("x.until") - F.col("x.size"))
    cut = scratch.keep(last.select(F.col("source").alias("s"), F.col("x.place").alias("at"), F.col("x.doc_id").alias("last_id"), gap.alias("gap")))

    # What is still missing is closed by documents after the cut: their sizes from the largest down, as many of each as
    # fit, and at the end one of the smallest that doesn't, if that comes nearer.
    left = rows.join(cut, same).where(~_before_cut() & (F.col("size") < 2 * F.col("gap"))).select("s", "size", "place", "doc_id", "gap")
    sizes = left.groupBy("s", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    # as many as a text has words, at most
    sizes = sizes.groupBy("s").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    none = F.array().cast("array<struct<size:bigint,k:bigint>>")

    def fill(state: Column, x: Column) -> Column:
        k = F.least(F.floor(state["gap"] / x["size"]), x["n"], F.lit(CLOSERS) - state["used"])
        more = F.array_append(state["out"], F.struct(x["size"].alias("size"), k.alias("k")))
        return F.struct((state["gap"] - k * x["size"]).alias("gap"), (state["used"] + k).alias("used"), F.when(k > 0, more).otherwise(state["out"]).alias("out"))

    start = F.struct(F.col("gap").cast("double").alias("gap"), F.lit(0).cast("bigint").alias("used"), none.alias("out"))
    sizes = sizes.withColumn("x", F.aggregate("sizes", start, fill))
    free = F.filter("sizes", lambda z: (z["size"] > F.col("x.gap")) & (z["size"] < 2 * F.col("x.gap")) & ~F.exists("x.out", lambda t: t["size"] == z["size"]))
    last_one = F.transform(F.slice(F.sort_array(free), 1, 1), lambda z: F.struct(z["size"].alias("size"), F.lit(1).cast("bigint").alias("k")))
    chosen = sizes.select(F.col("s").alias("c"), F.explode(F.concat("x.out", last_one)).alias("x")).select("c", F.col("x.size").alias("z"), "x.k")
    chosen = scratch.keep(chosen)  # CLOSERS + 1 rows a source at most
    first = Window.partitionBy("s", "size").orderBy("place", "doc_id")
    taken = left.join(chosen, F.col("s").eqNullSafe(F.col("c")) & (F.col("size") == F.col("z")))
    taken = taken.withColumn("at", F.row_number().over(first)).where((F.col("at") <= CLOSERS) & (F.col("at") <= F.col("k")))
    closers = taken.groupBy(F.col("s").alias("c")).agg(F.collect_list("place").alias("closers"))
    out = goal.join(cut.withColumnRenamed("s", "t").drop("gap"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t", "wanted")
    return scratch.keep(out.join(closers, F.col("s").eqNullSafe(F.col("c")), "left").drop("c")), sized, repeated


def _before_cut() -> Column:
    tie = (F.col("place") == F.col("at")) & (F.col("doc_id") < F.col("last_id"))
    return F.coalesce((F.col("place") < F.col("at")) | tie, F.lit(False))


def _copies(most: int) -> Column:
    more = F.col("at").isNull() | _before_cut() | F.coalesce(F.array_contains("closers", F.col("place")), F.lit(False))
    extra = F.when((F.col("p") > 0) & more, 1).otherwise(0)
    return F.when(F.col("size") > 0, F.least(F.col("whole") + extra, F.lit(most))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = 42, most: int = MOST_COPIES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``."""
    rule, sized, _ = rules(docs, seed, most, Scratch(docs.sparkSession, "mix"))
    rows = sized.join(rule, F.col("source").eqNullSafe(F.col("s"))).withColumn("place", _place(F.col("p"), F.col("u")))
    rows = rows.withColumn("copies", _copies(most))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_taken(docs: DataFrame, seed: int = 42, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all columns, as often as they are taken.

    Documents meet their source's rule where they are; they are only shuffled if the table of sources is too large to
    be sent to them.
    """
    rule, _, repeated = rules(docs, seed, most, Scratch(docs.sparkSession, "mix"))
    own = ("doc_id", "source", "text")
    rows = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("doc_id", "source", "row", word_count(F.col("text")).alias("size"), _content().alias("content"), F.spark_partition_id().alias("part"))
    rows = rows.withColumn("ordinal", F.lit(1).cast("long")) if repeated is None else _with_ordinals(rows, repeated)
    rows = rows.select("doc_id", "source", "row", "size", _draw(seed).alias("u"))
    rows = rows.join(rule, F.col("source").eqNullSafe(F.col("s"))).withColumn("place", _place(F.col("p"), F.col("u")))
    rows = rows.withColumn("copies", _copies(most)).where("copies > 0")
    return rows.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
