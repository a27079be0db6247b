"""Hard negatives by Fagin's threshold algorithm: rows of another label that come close to an anchor's positives.

Every task cuts its rows into shards of ``SHARD`` rows and sorts each dimension of a shard once.  For an anchor the sorted
lists are read from the end its component's sign asks for, ``FIRST`` entries of each list, then twice as many, and so on
(sorted access); each row met is scored by its whole integer inner product (random access).  The sum over dimensions of
the anchor's component times the last value read is the threshold: no unread row scores more.  Reading stops once the
threshold is strictly below the score to beat, so a tie is never missed.

Positives and negatives are two passes.  The first reads lists of the anchor's label alone and stops below the last
positive's score.  The second knows every positive's score, hence the window of scores its negatives must fall in, and
stops once the threshold is strictly below each window's last score, or below the window itself.  What a shard found is
carried to the next, so a task returns at most the best of all its shards; a last window takes the best of all tasks.

Anchors are the stated queries.  They are written once to the shared folder and taken in blocks of about ``ANCHORS``, which
is what is broadcast; rows are read from their table by every pass and never shuffled, and nothing is gathered by label.

Defined results: rows with a null number, label or vector, or with a null or non-finite component take no part; neither do
rows with a component beyond ``LIMIT`` after scaling, whose products 64 bits can't hold.  Rows meet only anchors of the
same length.  Of rows that repeat an anchor's number the least (label, vector) is the anchor, and none of them is its
positive or negative.  Repeated rows otherwise are rows of their own: they take places of their own, and a repeated
positive has one window.  Equal scores go by ascending number.  An anchor without positives has no rows, nor has one whose
windows are empty, as all windows of negative scores are.  Empty tables give no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from lapwing.llm.scratch import Scratch

SHARD = 1 << 14
FIRST = 32
ANCHORS = 1_000
LIMIT = 1 << 27
_UNREAD = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Window:
    """How many positives an anchor has and negatives a positive, and between which percentages of the positive's score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def candidates(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part: components scaled and rounded down to whole numbers."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LIMIT))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.when(fits, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))).alias("x"),
    ).where("vec_id is not null and label is not null and x is not null")


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length: their places and their components."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    begin = np.concatenate(([0], np.cumsum(lengths)))
    out = []
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        at = begin[rows][:, None] + np.arange(d)
        out.append((rows, flat[at].astype(np.int64)))
    return out


class Lists:
    """Rows with their dimensions sorted: ``order[j]`` holds the rows by ascending component ``j``, ties by number."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[by], labels[by], x[by]
        self.doubles, self.most = self.x.astype(np.float64), int(np.abs(x).max(initial=0))
        self.order = np.argsort(self.x.T, axis=1, kind="stable").astype(np.int32)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        # Sums of products of doubles are exact while they stay below 2**53, and faster.
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.doubles[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Rows met for the first time, and the threshold below them; the depth doubles from step to step."""
        m = len(self.ids)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        fresh = np.ones(m, dtype=bool)
        lo, depth = 0, FIRST
        while lo < m:
            hi = min(lo + depth, m)
            met = np.zeros(m, dtype=bool)
            met[self.order[up, lo:hi].ravel()] = True
            met[self.order[down, m - hi : m - lo].ravel()] = True
            if hi == m:
                met[:] = True  # all lists are read; rows that only zero components would show are met, too
            rows = np.flatnonzero(met & fresh)
            fresh[rows] = False
            last = self.x[self.order[up, hi - 1], up] @ anchor[up] + self.x[self.order[down, m - hi], down] @ anchor[down]
            yield rows, int(last) if fresh.any() else _UNREAD
            lo, depth = hi, 2 * depth


class Top:
    """The best ``k`` scores so far with their numbers; equal scores by ascending number."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else _UNREAD

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:  # ties with the kth stay
            keep = score >= np.partition(score, -self.k)[-self.k]
            score, ids = score[keep], ids[keep]
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def nearest(lists: Lists, anchor: np.ndarray, own: int, top: Top) -> None:
    """The best rows of the lists, without those numbered ``own``."""
    for rows, threshold in lists.read(anchor):
        rows = rows[lists.ids[rows] != own]
        top.add(lists.scores(rows, anchor), lists.ids[rows])
        if threshold < top.least() or threshold == _UNREAD:
            return


def negatives(lists: Lists, anchor: np.ndarray, own: int, label: int, bounds: list[tuple[int, int]], tops: list[Top]) -> None:
    """For each window of scores (both ends in it), the best rows inside it of another label."""
    for rows, threshold in lists.read(anchor):
        rows = rows[(lists.labels[rows] != label) & (lists.ids[rows] != own)]
        score = lists.scores(rows, anchor)
        for (low, high), top in zip(bounds, tops):
            inside = (score >= max(low, top.least())) & (score <= high)
            if inside.any():
                top.add(score[inside], lists.ids[rows[inside]])
        if threshold == _UNREAD or all(threshold < max(low, top.least()) for (low, _), top in zip(bounds, tops)):
            return


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            held.append(batch.slice(at, SHARD))
            rows += held[-1].num_rows
            if rows >= SHARD:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(table: pa.Table) -> Iterator[tuple[int, Lists]]:
    ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
    for rows, x in _matrix(table["x"].combine_chunks()):
        yield x.shape[1], Lists(ids[rows], labels[rows], x)


def _best(found: DataFrame, keys: list[str], score: str, number: str, k: int) -> DataFrame:
    order = Over.partitionBy(*keys).orderBy(F.desc(score), number)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, anchors: list[tuple], k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        tops = [Top(k) for _ in sent.value]
        for table in _shards(batches):
            for d, lists in _lists(table):
                of_label = {int(l): np.flatnonzero(lists.labels == l) for l in np.unique(lists.labels)}
                for l, at in of_label.items():
                    own = Lists(lists.ids[at], lists.labels[at], lists.x[at])
                    for (number, label, x), top in zip(sent.value, tops):
                        if label == l and len(x) == d:
                            nearest(own, x, number, top)
        size = [len(t.ids) for t in tops]
        if sum(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([a[0] for a in sent.value]), size)), pa.array(np.concatenate([t.ids for t in tops])), pa.array(np.concatenate([t.score for t in tops]))],
                names=["anchor_id", "positive_id", "positive_score"],
            )

    found = rows.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint")
    return _best(found, ["anchor_id"], "positive_score", "positive_id", k)


def _negatives(rows: DataFrame, anchors: list[tuple], positives: dict[int, list[tuple[int, int]]], rule: Window) -> DataFrame:
    wanted = [(a, positives[a[0]]) for a in anchors if a[0] in positives]
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        held = [
            ([(-(-rule.low * s // 100), rule.high * s // 100) for _, s in own], [Top(rule.negatives) for _ in own])
            for _, own in sent.value
        ]
        for table in _shards(batches):
            for d, lists in _lists(table):
                for ((number, label, x), _), (bounds, tops) in zip(sent.value, held):
                    if len(x) == d:
                        negatives(lists, x, number, label, bounds, tops)
        out = [
            (a[0], positive, s, top.ids, top.score)
            for (a, own), (_, tops) in zip(sent.value, held)
            for (positive, s), top in zip(own, tops)
            if len(top.ids)
        ]
        if out:
            size = [len(o[3]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(np.repeat(np.array([o[i] for o in out]), size)) for i in range(3)],
                    *[pa.array(np.concatenate([o[i] for o in out])) for i in (3, 4)],
                ],
                names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
            )

    found = rows.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return _best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", rule.negatives)


def mine(spark: SparkSession, rows: DataFrame, anchors: DataFrame, rule: Window = Window()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``candidates``-like tables."""
    scratch = Scratch(spark, "negatives")
    queries = scratch.keep(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.label", "a.x"))
    blocks = -(-queries.count() // ANCHORS)
    found = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about ANCHORS rows
        block = [(i, l, np.array(x, dtype=np.int64)) for i, l, x in zip(*(own[c].to_pylist() for c in ("vec_id", "label", "x")))]
        positives: dict[int, list[tuple[int, int]]] = {}
        for r in _positives(rows, block, rule.positives).select("anchor_id", "positive_id", "positive_score").distinct().collect():
            positives.setdefault(r[0], []).append((r[1], r[2]))
        found.append(scratch.keep(_negatives(rows, block, positives, rule)))
    if not found:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
