"""Language identification: known words first, then ever shorter character n-grams.

A word's score in a language is the logarithm of its smoothed relative frequency there.  A word the model doesn't know
is scored by its longest known character n-grams: where no n-gram of the longest size is known at a place, the next
shorter size is tried, down to single characters.  A text's scores are sums over its words; the best language wins.

The model is learned from a bounded sample of labelled rows, chosen by a hash of number and text, so that reruns agree.
Sample and tables are shared out by language: each language has an equal share of about ``SAMPLE`` rows, ``WORDS`` words and
``GRAMS`` n-grams (``LEAST_SHARE`` of each at least), its own most frequent ones, however rare it is among all rows.  Relative
frequencies are mixed with an equal chance for every word, so what a language doesn't know costs it the same everywhere.

A word of the model is a maximal run of letters, in lower case.  A text that is null or has no letter is ``und`` with
score 0.  Without any labelled text every text is ``und``.  Ties go to the language whose name is smaller.
Repeated rows count as often as they occur.  ``lang``, ``source`` and ``doc_id`` are never read by a prediction.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm import words
from lapwing.llm.scratch import Scratch, over_batches

SAMPLE = 32_000  # rows that the model is learned from, all languages together
WORDS = 100_000  # words that the model knows
GRAMS = 60_000  # character n-grams that it knows
LEAST_SHARE = 2_000
UNIFORM = 0.1  # weight of the equal chance
LONGEST = 5
REMEMBERED = 100_000  # words whose scores a task remembers
_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # rows of the table
    grams: dict[str, int]
    table: np.ndarray
    floor: float = -20.0
    memory: dict[int, np.ndarray] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray:
        """Longest known n-grams from left to right; a place where none is known counts with the floor."""
        padded, at = f" {word} ", 0
        total = np.zeros(len(self.languages))
        while at < len(padded):
            for n in range(min(LONGEST, len(padded) - at), 0, -1):
                if (known := self.grams.get(padded[at : at + n])) is not None:
                    total += self.table[known]
                    at += n
                    break
            else:
                total += self.floor
                at += 1
        return total

    def token(self, token: str) -> np.ndarray:
        """Scores of what stands between two white spaces, and the number of its words."""
        out = np.zeros(len(self.languages) + 1)
        for word in _LETTERS.findall(token.lower()):
            known = self.words.get(word)
            out[:-1] += self.unseen(word) if known is None else self.table[known]
            out[-1] += 1
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Sums over the words of each row; the last column counts the words."""
        w = words.split(column)
        size = len(self.languages) + 1
        distinct, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        table = np.zeros((len(distinct), size))
        raw = w.data.tobytes()
        for i, (h, k) in enumerate(zip(distinct.tolist(), first.tolist())):
            known = self.memory.get(h)
            if known is None:
                known = self.memory[h] = self.token(raw[w.starts[k] : w.ends[k]].decode())
            table[i] = known
        out = np.zeros((len(w.rows) - 1, size))
        filled = np.flatnonzero(np.diff(w.rows))
        if len(filled):
            out[filled] = np.add.reduceat(table[inverse], w.rows[filled], axis=0)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        s = self.scores(column)
        spoken = (s[:, -1] > 0) & (len(self.languages) > 0)
        if not self.languages:
            return ["und"] * len(s), np.zeros(len(s))
        points = s[:, :-1]
        best = points.argmax(axis=1)
        chance = 1 / np.exp(np.minimum(points - points.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, spoken)], np.where(spoken, chance, 0.0)


def learn(rows: DataFrame) -> Model:
    """A model from columns ``doc_id, text, lang``: labelled rows with a text, a bounded number of each language."""
    labelled = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0), dtype=np.float32))

    def share(of: int) -> int:
        return max(of // len(sizes), LEAST_SHARE)

    if max(sizes.values()) > share(SAMPLE):
        rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, share(SAMPLE) / n))])
        part = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
        labelled = labelled.where(part < rates[F.col("lang")])

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, 1, x) for x in _LETTERS.findall(text.lower()))
                if len(found) > 500_000:
                    yield _counted(found)
                    found.clear()
        if found:
            yield _counted(found)

    found = labelled.select("text", "lang").mapInArrow(count, "lang string, n bigint, word string")
    found = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = Scratch(rows.sparkSession, "langid").keep(found)  # read twice: counted words of the sample
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= share(WORDS)).select("word").distinct()
    known = found.join(best, "word").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    by_word = {r["word"]: r["by"] for r in known.toLocalIterator()}  # about WORDS rows
    by_word = dict(sorted(by_word.items()))
    languages = sorted({x for by in by_word.values() for x in by})
    width, place = len(languages), {x: i for i, x in enumerate(languages)}
    number: dict[str, int] = {}
    tally = array("i")  # one row of counts a gram
    for word, by in by_word.items():
        own = [place[lang] for lang in by]
        for g in _grams(word):
            i = number.setdefault(g, len(number))
            if i * width == len(tally):
                tally.extend([0] * width)
            for j in own:  # each distinct word counts once, so that frequent words don't decide about unseen ones
                tally[i * width + j] += 1
    counts = np.array(tally, dtype=np.int64).reshape(len(number), width)
    names = np.array(list(number), dtype=object)
    del number, tally
    chosen: set[int] = set()
    for j in range(width):
        held = np.flatnonzero(counts[:, j])
        low = np.partition(counts[held, j], -share(GRAMS))[-share(GRAMS)] if len(held) > share(GRAMS) else 0
        above, level = held[counts[held, j] > low], held[counts[held, j] == low]
        chosen.update(above.tolist())
        chosen.update(sorted(level.tolist(), key=lambda i: names[i])[: share(GRAMS) - len(above)] if low else level.tolist())
    grams = {g: {languages[j]: int(counts[i, j]) for j in np.flatnonzero(counts[i])} for g, i in sorted((names[i], i) for i in chosen)}
    del counts, names
    by_size: dict[int, Counter] = {n: Counter() for n in range(1, LONGEST + 1)}
    for g, by in grams.items():
        by_size[len(g)].update(by)
    spoken = Counter()
    for by in by_word.values():
        spoken.update(by)

    def logs(by, of, kinds: int) -> np.ndarray:
        return np.array([math.log((1 - UNIFORM) * by.get(x, 0) / max(of[x], 1) + UNIFORM / kinds) for x in languages])

    kinds = Counter(map(len, grams))
    often = [(w, by) for w, by in by_word.items() if sum(by.values()) > 1]
    table = [logs(by, spoken, len(by_word)) for _, by in often] + [logs(by, by_size[len(g)], kinds[len(g)]) for g, by in grams.items()]
    return Model(
        languages,
        {w: i for i, (w, _) in enumerate(often)},
        {g: i + len(often) for i, g in enumerate(grams)},
        np.array(table, dtype=np.float32).reshape(len(table), len(languages)),
    )


def _counted(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys]), pa.array(list(found.values()), type=pa.int64()), pa.array([k[2] for k in keys])],
        names=["lang", "n", "word"],
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, chance = sent.value.predict(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(chance)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over_batches(run), "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is known with a chance of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, chance = sent.value.predict(batch.column(at))
        return batch.filter(pa.array((chance >= least) & (np.array(names) != "und")))

    return docs.mapInArrow(over_batches(run), docs.schema)
