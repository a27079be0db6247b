"""The best documents for each item of a query set, by a hybrid of term-at-a-time and document-at-a-time scoring.

One pass over the texts keeps, for each document, its length and the counts of terms that any item asks for, and writes
them to the shared folder.  Counts of documents and terms come from that table.  Then every task turns its rows into
shards of postings (``SHARD`` documents or ``POSTINGS`` postings at most) and answers every item over each shard:

1. the item's short lists are summed term at a time into one list of documents and partial scores, which from then on is
   one more iterator with a known bound;
2. this iterator and the long lists are merged document at a time, range by range.  Iterators whose bounds together stay
   below the score to beat only serve look-ups; a range whose bounds can't reach that score is skipped unread.

The score to beat is carried from shard to shard, so a task returns at most ``k`` rows an item; a last window takes the
best of all tasks.  Nothing but the items, their terms' counts and the results leaves the tasks.  Items are taken in
blocks of ``ITEM_BYTES`` of text (one longer item is a block), so what is broadcast is bounded; each block is a pass.

Defined results: null texts and texts without a term are no documents; an item without a term, or whose terms occur
nowhere, has no rows.  A repeated row is a document of its own, a repeated item an item of its own.  Equal scores go by
ascending number, null last.  Empty tables give no rows.  Other columns of either table are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.scratch import Scratch, over_batches
from lapwing.llm.words import column_bytes

SHARD = 1 << 16
POSTINGS = 2_000_000
RANGE = 2_048
# A list is short if it holds at most one document in so many.
SPARSE = 32
ITEM_BYTES = 4 << 20
_LAST = np.iinfo(np.int64).max

# What a byte counts as: itself inside a term (A-Z lower-cased), else a space.
_AS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_AS).split()


@dataclass
class Block:
    """Some items: numbers, and for each the terms it asks for (by place in ``vocabulary``) and how often."""

    items: list[int | None]
    asked: list[dict[int, int]]
    vocabulary: dict[bytes, int]


def blocks(items: DataFrame) -> Iterator[Block]:
    block, size = Block([], [], {}), 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        found = Counter(terms(row[1].encode()))
        if size and size + len(row[1]) > ITEM_BYTES:
            yield block
            block, size = Block([], [], {}), 0
        size += len(row[1])
        if found:
            block.items.append(row[0])
            block.asked.append({block.vocabulary.setdefault(t, len(block.vocabulary)): c for t, c in found.items()})
    if block.items:
        yield block


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` of every document with a term: its length, and the asked terms it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = column_bytes(batch.column(1))
        known = sent.value
        n, term, tf, begin = [], [], [], [0]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found = terms(data[lo:hi].tobytes())
            n.append(len(found))
            for t, c in Counter(found).items():
                if (place := known.get(t)) is not None:
                    term.append(place)
                    tf.append(c)
            begin.append(len(term))
        lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(v, t)) for v, t in ((term, pa.int32()), (tf, pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(over_batches(run), "doc_id bigint, n bigint, term array<int>, tf array<bigint>").where("n > 0")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Best:
    """The best ``k`` of one item so far, best first: scores, numbers, and rank keys of the numbers (null last)."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    def least(self) -> int:
        """What a new document has to reach; equal scores still go by number."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > 4 * self.k:  # ties with the kth stay
            keep = score >= np.partition(score, -self.k)[-self.k]
            score, doc = score[keep], doc[keep]
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Shard:
    """Posting lists of some documents, which are numbered by ascending ``doc_id``."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, begin: np.ndarray, term: np.ndarray, tf: np.ndarray, factor):
        """``factor(term, tf, n)`` gives the points of postings; ``begin`` is where each document's postings begin."""
        order = np.argsort(doc, kind="stable")
        self.doc = doc[order]
        place = np.empty(len(doc), dtype=np.int32)
        place[order] = np.arange(len(doc), dtype=np.int32)
        row = np.repeat(np.arange(len(doc)), np.diff(begin))
        points = factor(term, tf, n[row])
        at = place[row]
        order = np.lexsort((at, term))
        self.at, self.points, term = at[order], points[order], term[order]
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.ranges = np.arange(0, len(doc) + RANGE, RANGE)
        self._edges: dict[int, tuple] = {}

    def _list(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        i = self.place.get(term)
        return None if i is None else (self.at[self.first[i] : self.first[i + 1]], self.points[self.first[i] : self.first[i + 1]])

    def _cut(self, at: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each range of documents begins in a list, and the most points in each range."""
        edge = np.searchsorted(at, self.ranges)
        most = np.zeros(len(self.ranges) - 1, dtype=np.int64)
        held = np.flatnonzero(edge[1:] > edge[:-1])
        if len(held):
            most[held] = np.maximum.reduceat(points, edge[held])
        return edge, most

    def answer(self, asked: dict[int, int], best: Best) -> None:
        short, long = [], []
        for term, times in asked.items():
            if (found := self._list(term)) is not None:
                if len(found[0]) * SPARSE <= len(self.doc):
                    short.append((found[0], found[1] * times))
                else:
                    if term not in self._edges:
                        self._edges[term] = self._cut(*found)
                    edge, most = self._edges[term]
                    long.append((*found, times, edge, most * times))
        lists = long
        if short:  # term at a time
            at, back = np.unique(np.concatenate([s[0] for s in short]), return_inverse=True)
            total = np.zeros(len(at), dtype=np.int64)
            np.add.at(total, back, np.concatenate([s[1] for s in short]))
            lists = [*long, (at, total, 1, *self._cut(at, total))]
        if not lists:
            return
        # Any k documents' whole scores bound what the kth must have: take those of the best sums.
        least = best.least()
        if short:
            lead = at[np.argsort(-total, kind="stable")[: best.k]]
            whole = sum(self._look(l, lead, 0, len(l[0])) for l in lists)
            if len(lead) == best.k:
                least = max(least, int(whole.min()))
        # Weakest first: what stays below the score to beat with all weaker ones needs no visit of its own.
        lists.sort(key=lambda l: int(l[4].max()))
        most = np.stack([l[4] for l in lists])
        reach = np.cumsum(most, axis=0)
        for r in np.flatnonzero(reach[-1] >= least).tolist():
            least = max(least, best.least())
            if reach[-1, r] < least:
                continue
            head = int(np.searchsorted(reach[:, r], least))  # lists before it are only looked up
            drivers = [l for l in lists[head:] if l[3][r + 1] > l[3][r]]
            found = np.unique(np.concatenate([l[0][l[3][r] : l[3][r + 1]] for l in drivers]))
            score = np.zeros(len(found), dtype=np.int64)
            for l in drivers:
                inside = slice(l[3][r], l[3][r + 1])
                score[np.searchsorted(found, l[0][inside])] += l[1][inside] * l[2]
            for j in range(head - 1, -1, -1):
                keep = score + reach[j, r] >= least
                found, score = found[keep], score[keep]
                if not len(found):
                    break
                score += self._look(lists[j], found, lists[j][3][r], lists[j][3][r + 1])
            keep = score >= least
            if keep.any():
                best.add(score[keep], self.doc[found[keep]])

    @staticmethod
    def _look(l: tuple, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Points of documents ``at`` in a piece of a list."""
        if lo == hi:
            return np.zeros(len(at), dtype=np.int64)
        i = np.minimum(np.searchsorted(l[0][lo:hi], at), hi - lo - 1) + lo
        return np.where(l[0][i] == at, l[1][i] * l[2], 0)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += len(batch.column("term").flatten())
        if rows >= SHARD or size >= POSTINGS:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def search_block(counted: DataFrame, block: Block, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's best ``k`` documents of every item, ``item`` being its place in the block."""
    context = counted.sparkSession.sparkContext
    documents, length = counted.agg(F.count("*"), F.sum("n")).first()
    holding = {r[0]: r[1] for r in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()}
    weights = np.zeros(len(block.vocabulary), dtype=np.int64)
    for term, held in holding.items():  # as many as the block has terms
        weights[term] = weight(documents, held)
    sent = context.broadcast((block.asked, weights, documents, length or 1))

    def run(batches):
        asked, weights, documents, length = sent.value

        def factor(term, tf, n):
            m = 25 + 75 * n * documents // length
            return weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))

        best = [Best(k) for _ in asked]
        for table in _shards(batches):
            table = table.combine_chunks()
            doc = table["doc_id"].fill_null(_LAST).to_numpy()
            term, tf = table["term"].combine_chunks(), table["tf"].combine_chunks()
            begin = np.concatenate(([0], np.cumsum(term.value_lengths().to_numpy())))
            shard = Shard(doc, table["n"].to_numpy(), begin, term.flatten().to_numpy(), tf.flatten().to_numpy(), factor)
            for terms_of, own in zip(asked, best):
                shard.answer(terms_of, own)
        rows = [len(b.doc) for b in best]
        if sum(rows):
            doc = np.concatenate([b.doc for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), rows)), pa.array(doc, mask=doc == _LAST), pa.array(np.concatenate([b.score for b in best]))],
                names=["item", "doc_id", "score"],
            )

    return counted.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 of every item."""
    scratch = Scratch(spark, "search")
    found = []
    for block in blocks(items):
        counted = scratch.keep(count_terms(docs, block.vocabulary))
        numbers = spark.createDataFrame(list(enumerate(block.items)), "item bigint, item_id bigint")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = search_block(counted, block, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        kept = scratch.keep(top.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score"))
        scratch.drop(counted)
        found.append(kept)
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
