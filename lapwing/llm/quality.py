"""Quality scores by compression: a text is like the kind of text whose zstandard dictionary makes it smaller.

Two dictionaries of one size are built from blocks of labelled good and bad texts.  A text is cut into blocks of
``BLOCK`` bytes, so that a long one can't become its own dictionary, and every block is compressed with both.  The
difference of the summed sizes, divided by the text's bytes (plus ``EVEN``, which calms very short texts), goes through
a logistic curve.  How small both make the text moves the curve: monotonous texts leave little to differ in.  The curve
is fitted to labelled texts that the dictionaries haven't seen: the labelled texts are halved by content, and each half
is measured with dictionaries of the other half.

Learned from a bounded sample: at most about ``ROWS`` labels of a kind, chosen by a hash of their number, and of their
texts at most ``BLOCKS`` different blocks of a kind and ``MEASURED`` differences.  All texts are scored whole.

Null and empty texts have no block: the difference is 0 and the score the curve's value there.  Repeated rows are
scored alike; equal blocks enter a dictionary once.  Of labels that disagree on a number the higher is taken; null
labels and numbers teach nothing.  Without labels of both kinds every score is the share of good ones, or 0 without any.
Columns other than ``doc_id``, ``text`` and ``quality`` are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.scratch import over_batches
from lapwing.llm.words import column_bytes

BLOCK = 1024
EVEN = 50
LEVEL = 3
DICTIONARY = 1 << 18
ROWS = 8_000
BLOCKS = 4_000
MEASURED = 20_000
_SCALE = 1_000_000


def build(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """Two dictionaries of about one size: trained ones, or the blocks themselves where there are few."""
    least = min(sum(map(len, good)), sum(map(len, bad)))
    if least < 4 * DICTIONARY:
        size = min(least, DICTIONARY)
        return b"".join(good)[-size:], b"".join(bad)[-size:]
    return tuple(zstandard.train_dictionary(DICTIONARY, kind, level=LEVEL).as_bytes() for kind in (good, bad))


class Measure:
    """Differences of compressed sizes; the compressors are made anew in every process."""

    def __init__(self, good: bytes, bad: bytes):
        self.dictionaries = good, bad
        self._compress = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_compress": None}

    def _ready(self):
        plain = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self._compress = []
        for raw in self.dictionaries:
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(compression_params=plain)
            self._compress.append(zstandard.ZstdCompressor(dict_data=known, compression_params=plain).compress)
        return self._compress

    def differences(self, column: pa.Array) -> np.ndarray:
        """For every text, per byte of it: bytes that the good dictionary saves over the bad one; bytes both save."""
        good, bad = self._compress or self._ready()
        data, offsets = column_bytes(column)
        data = memoryview(data.tobytes())
        out = np.zeros((2, len(offsets) - 1))
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            saved = both = 0
            for at in range(lo, hi, BLOCK):
                piece = data[at : min(at + BLOCK, hi)]
                small, smaller = len(bad(piece)), len(good(piece))
                saved += small - smaller
                both += 2 * len(piece) - small - smaller
            out[:, i] = saved / (hi - lo + EVEN), max(both, 0) / (hi - lo + EVEN)
        return out


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Bias and slopes of a weighted logistic regression, by Newton steps, slightly shrunk."""
    scale = np.append(1.0, np.maximum(np.sqrt(np.average(x * x, axis=1, weights=weight)), 1e-12))
    design = np.vstack([np.ones(x.shape[1]), x]) / scale[:, None]
    weight = weight * (len(y) / weight.sum())
    shrink = np.append(1e-9, np.full(len(x), 0.01))
    at = np.zeros(len(design))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ design, -35, 35)))
        slope = design @ (weight * (y - p)) - shrink * at
        step = np.linalg.solve((design * (weight * p * (1 - p))) @ design.T + np.diag(shrink), slope)
        at += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return at / scale


@dataclass
class Model:
    measure: Measure | None
    bias: float
    slopes: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.measure.differences(column) if self.measure else np.zeros((len(self.slopes), len(column)))
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slopes @ x, -35, 35)))


def _always(share: float) -> Model:
    return Model(None, float(np.clip(np.log(max(share, 1e-15) / max(1 - share, 1e-15)), -35, 35)), np.zeros(2))


def _sampled_labels(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """At most about ``ROWS`` labels of a kind, and how many there are of each."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("quality") > 0).cast("int").alias("good"))
    )
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(_SCALE))
    bound = [int(_SCALE * min(1.0, ROWS / counts.get(k, 1))) for k in (0, 1)]
    return known.where(place < F.when(F.col("good") == 1, bound[1]).otherwise(bound[0])), counts


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    data, offsets = column_bytes(batch.column(0))
    data, pieces, row = data.tobytes(), [], []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(lo, hi, BLOCK):
            pieces.append(data[at : min(at + BLOCK, hi)])
            row.append(i)
    other = batch.select([1, 2]).take(pa.array(row, type=pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(pieces, type=pa.binary()), *other.columns], names=["block", "good", "half"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``doc_id, text`` and ``doc_id, quality``."""
    labels, counts = _sampled_labels(labels)
    total = sum(counts.values())
    if len(counts) < 2:
        return _always(counts.get(1, 0) / total if total else 0.0)
    # At most about 2 * ROWS rows of two numbers, so every task may have them: the texts aren't shuffled.
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(labels), "doc_id")
        .select("text", "good", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int").alias("half"))
    )
    size = F.octet_length(F.coalesce("text", F.lit("")))
    made = {r["good"]: (r["n"], r["blocks"]) for r in rows.groupBy("good").agg(F.count("*").alias("n"), F.sum(F.ceil(size / BLOCK)).alias("blocks")).collect()}
    if len(made) < 2 or not all(blocks for _, blocks in made.values()):
        return _always(counts.get(1, 0) / total)
    share = F.when(F.col("good") == 1, F.lit(BLOCKS / made[1][1])).otherwise(F.lit(BLOCKS / made[0][1]))
    blocks = rows.mapInArrow(over_batches(_blocks), "block binary, good int, half int")
    blocks = blocks.withColumn("place", F.xxhash64("block", F.lit("block")))
    # Copies share a place: the aggregate keeps one of them, on the map side already.
    blocks = blocks.where(F.pmod("place", F.lit(_SCALE)) < F.lit(_SCALE) * share)
    blocks = blocks.groupBy("good", "place").agg(F.min("block").alias("block"), F.min("half").alias("half"))
    found = {}
    for kind in (0, 1):
        taken = blocks.where(F.col("good") == kind).orderBy("place").limit(BLOCKS).toArrow()
        found[kind] = list(zip(taken["block"].to_pylist(), taken["half"].to_pylist()))

    def measure(*halves: int) -> Measure:
        return Measure(*build(*[[b for b, h in found[kind] if h in halves] for kind in (1, 0)]))

    each = measure(1), measure(0)  # a half's texts are measured with the other half's dictionaries
    sent = docs.sparkSession.sparkContext.broadcast(each)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([m.differences(batch.column(0)) for m in sent.value])
        half = batch.column(2).to_numpy()
        saved, both = x[half, :, np.arange(len(half))].T
        return pa.RecordBatch.from_arrays([pa.array(saved), pa.array(both), batch.column(1)], names=["saved", "both", "good"])

    spread = rows.withColumn("place", F.xxhash64("text", F.lit("curve")))
    seen = sum(n for n, _ in made.values())
    if seen > MEASURED:
        spread = spread.where(F.pmod("place", F.lit(_SCALE)) < int(_SCALE * MEASURED / seen))
    seen = spread.select("text", "good", "half").mapInArrow(over_batches(measured), "saved double, both double, good int").limit(2 * MEASURED).toArrow()
    x, y = np.stack([seen["saved"].to_numpy(), seen["both"].to_numpy()]), seen["good"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return _always(counts[1] / total)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    bias, *slopes = curve(x, y, weight)
    return Model(measure(0, 1), float(bias), np.array(slopes))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, higher for likelier good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over_batches(run), "doc_id bigint, score double")
