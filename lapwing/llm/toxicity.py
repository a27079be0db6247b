"""Toxicity scores: logistic regression over hashed words, word pairs and skip-grams, fitted by FTRL-proximal.

A feature is a cell of a hashed range of ``2**BITS``; it is present in a text or not.  FTRL-proximal keeps two numbers for
each cell: its learning rate falls with the squared gradients the cell has seen, and an L1 term leaves cells at exactly
zero until the evidence is strong.  What is sent to executors is the list of cells that aren't zero.

The model is learned from at most ``SAMPLE`` labelled rows, chosen by a hash of their number.  The sample is dealt to
shards of about ``SHARD`` rows, which are learned side by side; a cell's numbers become the mean of those shards
that have met it.  A
shard's rows are bounded by the sample, so no task's work grows with the corpus.

A text without words (null, empty, white space) has no feature: its score is the bias alone.  Repeated rows and labels
count as often as they occur; of labels that disagree on a number, the higher is taken.  Without labels of both kinds
every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import words
from lapwing.llm.scratch import over_batches

BITS = 20
HALF = 1 << (BITS - 1)
PAIR = 0.4
SAMPLE = 16_000
SHARD = 4_000
_U = np.uint64


@dataclass(frozen=True)
class Fit:
    """``alpha`` and ``beta``: learning rate; ``l1``, ``l2``: penalties; ``passes`` over the sample."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    passes: int = 5


def features(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Cells of single words, neighbours, and words one or two apart; and the row of each.

    The first half of the range holds single words, which count 1; the other half holds pairs, which count ``PAIR``.
    """
    row = w.row_of_word()
    h = words.mix(w.hashes ^ _U(7))
    cells, rows = [(h >> _U(65 - BITS)).astype(np.int32)], [row]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = words.mix(w.hashes[:-gap] * _U(0xD6E8FEB86659FD93) + w.hashes[gap:] + _U(gap))
            cells.append((pair[same] >> _U(65 - BITS)).astype(np.int32) + np.int32(HALF))
            rows.append(row[gap:][same])
    return np.concatenate(cells), np.concatenate(rows)


def weights(z: np.ndarray, n: np.ndarray, fit: Fit) -> np.ndarray:
    rate = (fit.beta + np.sqrt(n)) / fit.alpha + fit.l2
    return np.where(np.abs(z) <= fit.l1, 0.0, (np.sign(z) * fit.l1 - z) / rate)


def learn_shard(texts: pa.Array, labels: np.ndarray, z: np.ndarray, n: np.ndarray, fit: Fit) -> None:
    """One pass over a shard's rows; changes ``z`` and ``n``.  The last cell is the bias, which has no penalty."""
    for at in range(0, len(texts), 500):
        w = words.split(texts.slice(at, 500))
        cell, row = features(w)
        order = np.argsort(row, kind="stable")
        cell, row = cell[order], row[order]
        begin = np.searchsorted(row, np.arange(len(w.rows)))
        for i, y in enumerate(labels[at : at + 500]):
            x = np.append(np.unique(cell[begin[i] : begin[i + 1]]), 1 << BITS)
            own_z, own_n = z[x], n[x]
            rate = (fit.beta + np.sqrt(own_n)) / fit.alpha + fit.l2
            value = np.where(np.abs(own_z) <= fit.l1, 0.0, (np.sign(own_z) * fit.l1 - own_z) / rate)
            value[-1] = -own_z[-1] / rate[-1]
            size = np.where((x >= HALF) & (x < 1 << BITS), PAIR, 1.0)
            g = size * (1 / (1 + np.exp(-np.clip((value * size).sum(), -35, 35))) - y)
            z[x] = own_z + g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / fit.alpha * value
            n[x] = own_n + g * g


@dataclass
class Model:
    cells: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not hasattr(self, "_dense"):
            self._dense = np.zeros(1 << BITS)
            self._dense[self.cells] = self.values
            self._dense[HALF:] *= PAIR
            self._known = self._dense != 0
        w = words.split(column)
        cell, row = features(w)
        heavy = self._known[cell]
        key = np.unique(row[heavy].astype(np.int64) << BITS | cell[heavy])
        points = self.bias + np.bincount(key >> BITS, weights=self._dense[key & ((1 << BITS) - 1)], minlength=len(w.rows) - 1)
        return 1 / (1 + np.exp(-np.clip(points, -35, 35)))

    def __getstate__(self):
        return {"cells": self.cells, "values": self.values, "bias": self.bias}


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from ``doc_id, text`` and ``doc_id, toxic``."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    total, toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not total or toxic in (0, total):
        share = (toxic or 0) / total if total else 0.0
        return Model(np.empty(0, dtype=np.int64), np.empty(0), float(np.log(max(share, 1e-15) / max(1 - share, 1e-15))))
    if total > SAMPLE:
        part = F.pmod(F.xxhash64("doc_id", F.lit("ftrl")), F.lit(1_000_000))
        labels = labels.where(part < int(1_000_000 * SAMPLE / total))
    # At most SAMPLE rows of two numbers, so they may be sent to every task: the documents aren't shuffled.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels), "doc_id")
    rows = rows.where("text is not null").select(F.xxhash64("doc_id", F.lit("order")).alias("place"), "text", "toxic")
    shards = -(-min(total, SAMPLE) // SHARD)
    rows = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartition(shards, "shard")
    rows = rows.sortWithinPartitions("shard", "place", "text")
    rows = rows.select("text", "toxic", "shard")

    def shard(batches):
        held = list(batches)  # the rows of a few shards
        if not held:
            return
        table = pa.Table.from_batches(held)
        for k in np.unique(table["shard"].to_numpy()).tolist():
            own = table.filter(pa.array(table["shard"].to_numpy() == k)).combine_chunks()
            z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
            for _ in range(fit.passes):
                learn_shard(own["text"].chunk(0), own["toxic"].to_numpy(), z, n, fit)
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(z[cell]), pa.array(n[cell])], names=["cell", "z", "n"])

    state = rows.mapInArrow(shard, "cell bigint, z double, n double").groupBy("cell").agg(F.avg("z").alias("z"), F.avg("n").alias("n"))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    # Only cells that the mean leaves over the L1 bound, and the bias, come to the driver.
    found = state.where((F.abs("z") > fit.l1) | (F.col("cell") == 1 << BITS)).toArrow()
    z[found["cell"].to_numpy()], n[found["cell"].to_numpy()] = found["z"].to_numpy(), found["n"].to_numpy()
    w = weights(z, n, fit)
    cells = np.flatnonzero(w[:-1])
    bias = float(-z[-1] / ((fit.beta + np.sqrt(n[-1])) / fit.alpha + fit.l2))
    return Model(cells, w[cells], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over_batches(run), "doc_id bigint, score double")
