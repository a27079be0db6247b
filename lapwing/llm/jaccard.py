"""Self-join of documents by the Jaccard similarity of their word shingles.

Rare-first prefix filtering: shingles are ordered from rare to frequent; two sets that reach the threshold share one
among their first ``n - ceil(t n) + 1``, so only these are joined.  Length, positional and suffix filters thin out the
candidates and every remaining pair is compared once, on whole sets.  The suffix filter cuts the hash range into parts and
keeps for each whether it holds an odd number of the set's shingles, the set's mark: a shingle that is in one set only
turns one part, so two sets differ in at least as many shingles as their marks differ in parts.  A mark has 512 parts
up to 1,000 shingles, four times as many up to 4,000, and so on; marks of different length aren't compared.

* Documents with equal sets are one node (a 64-bit signature of the set), however many copies there are.
* Frequencies come from all documents, in a fixed number of hashed cells; any order gives right results, a rarer-first
  one gives fewer candidates.
* First every node is compared with one node of each of its prefix lists (a star).  What that links is one component.
  Then lists that still hold more than one component are joined, for pairs of different components only: a pair
  inside a component can't change the result.  So a large group of near copies isn't expanded into pairs.

Null, empty and white-space texts have no shingle and link with nothing.  A text of fewer words than a shingle has its
whole sequence as its one shingle.  Rows that repeat a ``doc_id`` are documents of their own that share a number; the
number is the smallest of a group if any of its rows has it.  A null ``doc_id`` is allowed: its text is compared as any
other's, the smallest non-null number is the group's.  Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import words
from lapwing.llm.scratch import Scratch, components, over_batches

CELL_BITS = 18  # cells of the frequency table: 2**18 numbers, whatever the corpus
SHORT_MARK = 8  # the 64-bit numbers of a mark that prefix rows carry
BROADCAST_IDS = 2_000_000  # numbers of documents up to which a list of them is sent to all executors

_HEADS = "doc_id bigint, n bigint, node bigint, prefix array<bigint>, mark array<bigint>"


@dataclass(frozen=True)
class Rule:
    """``width`` words a shingle; linked when 100 * intersection >= ``percent`` * union."""

    width: int = 5
    percent: int = 80


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and where each row's begin."""
    w = words.split(column)
    values, begin = w.shingles(width)
    n = np.diff(w.rows)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        factors = words.seeded(2, width) | np.uint64(1)
        whole = np.array([(w.hashes[w.rows[r] : w.rows[r + 1]] * factors[: n[r]]).sum() + np.uint64(n[r]) for r in short], dtype=np.uint64)
        values = np.insert(values, begin[short], words.mix(whole))
        extra = np.zeros(len(n), dtype=np.int64)
        extra[short] = 1
        begin = begin + np.concatenate(([0], np.cumsum(extra)))
    return words.distinct_per_row(values, begin)


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One number for each set."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words.mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return words.mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64))


def mark_of(values: np.ndarray) -> np.ndarray:
    """For each part of the hash range whether an odd number of the set's shingles lies in it, 64 parts a number."""
    bits = 9
    while len(values) >= 1000 << (bits - 9):
        bits += 2
    odd = np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def cell_counts(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Number of documents with a shingle in each cell of the hash range, over all documents; ``2**CELL_BITS`` numbers."""

    def count(batches):
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            values, _ = shingle_sets(batch.column(0), rule.width)
            total += np.bincount((values >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        cells = np.flatnonzero(total)
        for part in np.array_split(cells, max(1, len(cells) // 65_536)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    found = docs.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def heads(docs: DataFrame, rule: Rule, counts) -> DataFrame:
    """For each row: set size, signature, prefix from rare to frequent, mark."""

    def head(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, begin = shingle_sets(batch.column(1), rule.width)
        frequency = counts.value[(values >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        n = np.diff(begin)
        length = np.where(n > 0, n - (rule.percent * n + 99) // 100 + 1, 0)
        prefix = [
            values[lo:hi][np.argsort(frequency[lo:hi], kind="stable")[:p]]
            for lo, hi, p in zip(begin[:-1].tolist(), begin[1:].tolist(), length.tolist())
            if p
        ]
        marks = [mark_of(values[lo:hi]) for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist())]
        marks_begin = np.concatenate(([0], np.cumsum([len(m) for m in marks])))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n.astype(np.int64)),
                pa.array(signatures(values, begin).astype(np.int64)),
                words.long_lists(np.concatenate(prefix) if prefix else values[:0], np.concatenate(([0], np.cumsum(length)))),
                words.long_lists(np.concatenate(marks), marks_begin),
            ],
            names=["doc_id", "n", "node", "prefix", "mark"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over_batches(head), _HEADS)


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``node, items, to`` for ``text, to``: a document's set with the nodes that it is to be compared with."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, begin = shingle_sets(batch.column(0), rule.width)
        return pa.RecordBatch.from_arrays(
            [pa.array(signatures(values, begin).astype(np.int64)), words.long_lists(values, begin), batch.column(1)], names=["node", "items", "to"]
        )

    return docs.select("text", "to").mapInArrow(over_batches(sets), "node bigint, items array<bigint>, to bigint")


def _near(rule: Rule, na: str, nb: str, same_size: str, apart: str) -> str:
    """Length and suffix filters, as a condition; ``apart`` is the number of parts in which the marks differ."""
    length = f"100 * least({na}, {nb}) >= {rule.percent} * greatest({na}, {nb})"
    return f"{length} and (not ({same_size}) or {100 + rule.percent} * ({apart}) <= {100 - rule.percent} * ({na} + {nb}))"


def _filtered(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("mark").alias("ma"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("mark").alias("mb"))
    apart = "aggregate(zip_with(ma, mb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return pairs.join(a, "a").join(b, "b").where(_near(rule, "na", "nb", "size(ma) = size(mb)", apart)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose whole sets reach the threshold.  ``pairs`` is a kept table.

    The set of ``a`` travels once for each of its pairs and that of ``b`` once; they meet at ``b``.
    """
    ids = nodes.select("node", F.col("doc_id").alias("id"))
    left = pairs.join(ids, F.col("a") == F.col("node")).select("id", "node", F.col("b").alias("to"))
    right = pairs.select("b").distinct().join(ids, F.col("b") == F.col("node")).select("id", "node", F.col("node").alias("to"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sent(routes: DataFrame) -> DataFrame:
        if routes.count() <= BROADCAST_IDS:
            routes = F.broadcast(routes)
        found = texts.join(routes, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "node", "to")
        sets = _sets(found.select("text", "to"), rule)
        return sets

    a = sent(left).select(F.col("node").alias("a"), F.col("items").alias("ia"), F.col("to").alias("b"))
    b = sent(right).where("node = to").select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = a.join(b, "b").withColumn("common", F.size(F.array_intersect("ia", "ib")))
    near = both.where(f"100 * common >= {rule.percent} * (size(ia) + size(ib) - common)").select("a", "b")
    # Rows that repeat a number but not its text bring sets that weren't asked for.
    return near.distinct().join(pairs, ["a", "b"], "leftsemi")


def groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    counts = spark.sparkContext.broadcast(cell_counts(docs, rule))
    whole = scratch.keep(heads(docs, rule, counts))
    heavy = scratch.keep(
        whole.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"), F.first("mark").alias("mark"))
    )
    rows = scratch.keep(whole.select("doc_id", "n", "node"))
    scratch.drop(whole)
    entries = heavy.select("node", F.posexplode("prefix").alias("place", "gram"))
    lists = entries.groupBy("gram").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    shared = scratch.keep(entries.join(lists.select("gram", "pivot"), "gram"))

    nodes = scratch.keep(heavy.drop("prefix"))
    scratch.drop(heavy)

    stars = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = scratch.keep(_filtered(stars, nodes, rule))
    links = scratch.keep(_verified(stars, docs, nodes, rule))
    found = scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))

    held = shared.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("pivot")
    mixed = held.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    short = [F.size("mark").alias("wide"), *[F.element_at("mark", i + 1).alias(f"m{i}") for i in range(SHORT_MARK)]]
    held = scratch.keep(held.join(mixed, "gram").join(nodes.select("node", "n", *short), "node"))
    a, b = held.alias("a"), held.alias("b")  # the same rows twice: shuffled once
    rest = f"{100 + rule.percent} * least(a.n - a.place, b.n - b.place) >= {rule.percent} * (a.n + b.n)"
    apart = " + ".join(f"bit_count(a.m{i} ^ b.m{i})" for i in range(SHORT_MARK))
    more = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.root") < F.col("b.root")))
    more = more.where(rest).where(_near(rule, "a.n", "b.n", "a.wide = b.wide", apart))
    more = more.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    tried = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = scratch.keep(_filtered(more.join(tried, ["a", "b"], "leftanti"), nodes, rule))
    scratch.drop(shared, held)
    if not more.isEmpty():
        cross = scratch.keep(_verified(more, docs, nodes, rule))
        if not cross.isEmpty():
            joined = cross.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
            found = scratch.keep(components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))

    placed = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = scratch.keep(placed.join(least, "root").select("node", "component_id"))
    return (
        rows.join(label, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` whose number is their group's smallest, with all columns; repeated rows of that number
    give one.  Rows without a number stay."""
    columns = docs.columns
    away = groups(docs, rule).groupBy("doc_id").agg(F.min("component_id").alias("_first"), F.count("*").alias("_times"))
    away = away.where("doc_id is not null and (doc_id <> _first or _times > 1)")
    marked = docs.alias("d").join(away.alias("w"), F.col("d.doc_id").cast("long") == F.col("w.doc_id"), "left")
    kept = marked.where("w._first is null or w._first = w.doc_id")
    single = kept.where("w._first is null").select(*[F.col(f"d.`{c}`") for c in columns])
    many = kept.where("w._first is not null").select(F.struct(*[F.col(f"d.`{c}`") for c in columns]).alias("r"))
    many = many.groupBy(F.col("r.doc_id").alias("k")).agg(F.min("r").alias("r")).select("r.*")
    return single.unionByName(many)
