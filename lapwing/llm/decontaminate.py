"""Passages of documents within a small edit distance of a benchmark item.

Distances count words (inserted, dropped or replaced).  An item of ``n`` words is found where some stretch of a document
is at most ``floor(rate * n)`` words away, so 20 % of the words may be edited.

1. CGK random-walk embedding: a walk copies a window's word, and a random bit that depends on the step and the word says
   whether it moves on.  Two windows a few edits apart fall into step again, so their edit distance becomes a small
   Hamming distance of the walks.
2. Bit-sampling LSH: a few places of a walk make a key; many keys from several independent walks reach the recall.
   Items are cut into windows at every offset, documents at a stride, for each class of item sizes.
3. Every item that shares a key with a window is compared with the stretch around it by exact edit distance.

Walks are costly, so windows that can't match are left out first: a stretch within ``d`` edits of an item of ``n`` words
shares ``n - 2 - 3 d`` of the item's three-word runs with it.  The runs of a size class of items are a bitmap of fixed size; windows
around which fewer runs are found aren't walked.  This drops no match, it is a bound.

Windows fit whole into a document, so what stands at its end and is shorter than a window, such as a document that is an
item with words left out, is compared directly: with every item of whose runs enough are found there.  Items of fewer than
``SMALL`` words aren't walked either: one edit leaves one of an item's halves as it is, and every place of a half is compared.

Items are handled in blocks of at most ``BLOCK_WORDS`` words, so what is sent to executors has a fixed bound and any
number of items works.  Documents are only mapped: nothing is shuffled and a hot passage costs what any other costs.

Null and empty texts match nothing.  Items under five words must match exactly, down to a single word.  Items with null ``item_id`` are left out.  Repeated items and documents each give their
rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import words

RUN = 3  # words of a run
MAP_BITS = 22  # the bitmap of a size class's runs has 2**22 bits
BLOCK_WORDS = 500_000  # words of the items that are compared at once
SMALL = 8  # items of fewer words are found by their halves
FUZZY_FROM = 5  # items of fewer words must match exactly
_U = np.uint64


@dataclass(frozen=True)
class Search:
    """``rate``: edits for each word of an item.  ``walks`` walks give ``samples`` keys of ``places`` places each.

    At 20 % edits two walks agree in about half of their places, so a five-place key is shared with probability 0.03,
    one of 32 with 0.64; a passage has several windows, and fewer edits give far more.
    """

    rate: float = 0.2
    walks: int = 4
    samples: int = 8
    places: int = 5

    def edits(self, n: int) -> int:
        return int(n * self.rate) if n >= FUZZY_FROM else 0


def _size_class(n: int) -> int:
    """The least size of an item's class: sizes grow by a quarter."""
    low = 3
    while (up := max(low + 1, low * 5 // 4)) <= n:
        low = up
    return low


def _stride(low: int) -> int:
    return max(1, low // 6)


def _keys(hashes: np.ndarray, starts: np.ndarray, width: int, search: Search) -> np.ndarray:
    """LSH keys of windows, one row a window: each of ``walks`` walks of ``3 * width`` steps is sampled."""
    steps = 3 * width
    out = np.empty((len(starts), search.walks * search.samples), dtype=_U)
    for walk in range(search.walks):
        place = words.seeded(100 + walk, search.samples * search.places) % _U(steps)
        place = place.astype(np.int64).reshape(search.samples, search.places)
        used = {int(p): [tuple(x) for x in np.argwhere(place == p)] for p in np.unique(place)}
        key = np.zeros((search.samples, len(starts)), dtype=_U)
        factors = words.seeded(200, search.places) | _U(1)
        at = np.zeros(len(starts), dtype=np.int64)
        for step in range(max(used) + 1):
            if step % 64 == 0:
                bits = words.mix(hashes ^ words.seeded(300 + 50 * walk + step // 64, 1)[0])
            inside = at < width
            where = np.where(inside, starts + at, 0)
            for sample, k in used.get(step, ()):
                key[sample] += np.where(inside, hashes[where], _U(0)) * factors[k]
            at += inside & ((bits[where] >> _U(step % 64)) & _U(1)).astype(bool)
        tag = words.seeded(400 + walk, search.samples)[:, None] ^ _U(width)
        out[:, walk * search.samples : (walk + 1) * search.samples] = words.mix(key + tag).T
    return out


def nearest_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of ``item`` to a stretch of ``text``, and the stretch; the first and shortest on ties."""
    m = len(text)
    row = np.zeros(m + 1, dtype=np.int64)
    begin = np.arange(m + 1)
    place = np.arange(m + 1)
    for i, word in enumerate(item.tolist(), 1):
        best = row + 1
        source = begin
        diagonal = row[:-1] + (text != word)
        take = diagonal <= best[1:]
        best = np.concatenate((best[:1], np.where(take, diagonal, best[1:])))
        source = np.concatenate((source[:1], np.where(take, begin[:-1], source[1:])))
        # Dropping words of the text: a running minimum of distance minus place.
        slid = best - place
        low = np.minimum.accumulate(slid)
        last = np.maximum.accumulate(np.where(slid == low, place, 0))
        row, begin = low + place, source[last]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


class Items:
    """Items of a block, their runs, and their windows by key."""

    def __init__(self, ids: list[int], texts: list[str], search: Search):
        w = words.split(pa.array(texts, type=pa.large_string()))
        self.ids, self.search = ids, search
        self.words = [w.hashes[w.rows[i] : w.rows[i + 1]] for i in range(len(ids))]
        self.sorted = [np.unique(x) for x in self.words]
        runs, begin = w.shingles(RUN)
        self.bitmaps = {}
        by_class: dict[int, list[int]] = {}
        for i, x in enumerate(self.words):
            if len(x) >= SMALL:
                by_class.setdefault(_size_class(len(x)), []).append(i)
        self.halves = self._halves(w)
        self.classes, self.runs = {}, {}
        for low, own in sorted(by_class.items()):
            width = low - _stride(low) + 1
            starts = [w.rows[i] + np.arange(len(self.words[i]) - width + 1) for i in own]
            owner = np.repeat(own, [len(s) for s in starts])
            keys = _keys(w.hashes, np.concatenate(starts), width, search)
            flat, whose = keys.ravel(), np.repeat(owner, keys.shape[1])
            order = np.lexsort((whose, flat))
            flat, whose = flat[order], whose[order]
            fresh = np.ones(len(flat), dtype=bool)
            fresh[1:] = (flat[1:] != flat[:-1]) | (whose[1:] != whose[:-1])
            longest = max(len(self.words[i]) for i in own)
            least = min(len(self.words[i]) - (RUN - 1) - RUN * search.edits(len(self.words[i])) for i in own)
            own_runs = np.concatenate([runs[begin[i] : begin[i + 1]] for i in own])
            order = np.argsort(own_runs, kind="stable")
            self.runs[low] = own_runs[order], np.repeat(own, [begin[i + 1] - begin[i] for i in own])[order]
            bits = own_runs >> _U(64 - MAP_BITS)
            self.bitmaps[low] = np.zeros(1 << MAP_BITS, dtype=bool)
            self.bitmaps[low][bits.astype(np.int64)] = True
            self.classes[low] = (width, longest, max(least, 1), flat[fresh], whose[fresh])

    def _halves(self, w: words.Words) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sorted hashes of the halves of small items by size, with item and place; the whole item where no edit is allowed."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(self.words):
            n = len(x)
            if 0 < n < SMALL:
                edges = [0, n // 2, n] if self.search.edits(n) else [0, n]
                for a, b in zip(edges, edges[1:]):
                    found.setdefault(b - a, []).append((i, a))
        out = {}
        for size, own in found.items():
            h, begin = w.shingles(size)
            item, place = np.array(own).T
            key = h[begin[item] + place]
            order = np.argsort(key, kind="stable")
            out[size] = key[order], item[order], place[order]
        return out

    def _small(self, w: words.Words) -> Iterator[tuple[int, int, int, int]]:
        """``(row, item, from, to)`` of the places around each half of a small item."""
        for size, (key, item, place) in sorted(self.halves.items()):
            h, begin = w.shingles(size)
            lo, hi = np.searchsorted(key, h, side="left"), np.searchsorted(key, h, side="right")
            at = np.flatnonzero(hi > lo)
            row = np.searchsorted(begin, at, side="right") - 1
            done = set()
            for r, p, a, b in zip(row.tolist(), (at - begin[row] + w.rows[row]).tolist(), lo[at].tolist(), hi[at].tolist()):
                for k in range(a, b):
                    i = int(item[k])
                    edits, n = self.search.edits(len(self.words[i])), len(self.words[i])
                    if edits == 0:
                        if (r, i) in done:
                            continue  # the first place is the match
                        done.add((r, i))
                    start = p - int(place[k])
                    yield r, i, max(start - edits, int(w.rows[r])), min(start + n + edits, int(w.rows[r + 1]))

    def _ends(self, w: words.Words, hit: np.ndarray, run_at: np.ndarray, low: int) -> Iterator[tuple[int, int, int, int]]:
        """``(row, item, from, to)`` of row ends in which enough of an item's runs are found."""
        _, longest, least, _, _ = self.classes[low]
        total = np.concatenate(([0], np.cumsum(hit)))
        end = w.rows[1:]
        start = np.maximum(w.rows[:-1], end - longest - self.search.edits(longest))
        runs, whose = self.runs[low]
        for row in np.flatnonzero(total[end] - total[start] > 0).tolist():
            a, b = int(start[row]), int(end[row])
            there = np.unique(run_at[a:b][hit[a:b]])
            lo, hi = np.searchsorted(runs, there, side="left"), np.searchsorted(runs, there, side="right")
            if (hi - lo).sum() < least:
                continue
            items, times = np.unique(np.concatenate([whose[x:y] for x, y in zip(lo.tolist(), hi.tolist())]), return_counts=True)
            for item, count in zip(items.tolist(), times.tolist()):
                n = len(self.words[item])
                edits = self.search.edits(n)
                if count >= n - (RUN - 1) - RUN * edits:
                    yield row, item, max(a, b - n - edits), b

    def _windows(self, w: words.Words, hit: np.ndarray, low: int) -> np.ndarray:
        """Starts of this class's windows around which enough runs are found."""
        width, longest, least, _, _ = self.classes[low]
        reach = longest + self.search.edits(longest)
        total = np.concatenate(([0], np.cumsum(hit)))
        near = np.flatnonzero(hit)
        if not len(near):
            return near
        # Only windows that begin within reach of a found run can be near one.
        flag = np.zeros(len(hit) + 1, dtype=np.int64)
        np.add.at(flag, np.maximum(near - reach, 0), 1)
        np.add.at(flag, np.minimum(near + 1, len(hit)), -1)
        start = np.flatnonzero(np.cumsum(flag[:-1]) > 0)
        row = np.searchsorted(w.rows, start, side="right") - 1
        start = start[((start - w.rows[row]) % _stride(low) == 0) & (start + width <= w.rows[row + 1])]
        row = np.searchsorted(w.rows, start, side="right") - 1
        lo, hi = np.maximum(start - reach, w.rows[row]), np.minimum(start + reach, w.rows[row + 1])
        return start[total[hi] - total[lo] >= least]

    def find(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """``(row, item index, start word, end word, distance)`` of the best stretch for each row and item."""
        w = words.split(column)
        runs, begin = w.shingles(RUN)
        n = np.diff(begin)
        first = np.repeat(w.rows[:-1] - begin[:-1], n) + np.arange(len(runs))
        bit = (runs >> _U(64 - MAP_BITS)).astype(np.int64)
        run_at = np.zeros(len(w.hashes), dtype=_U)
        run_at[first] = runs
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def compare(row: int, item: int, lo: int, hi: int) -> None:
            x = self.words[item]
            known = best.get((row, item))
            if known is not None and known[0] == 0:
                return
            # A stretch within d edits holds all but d of the item's words.
            if self._shared(item, w.hashes[lo:hi]) < len(x) - self.search.edits(len(x)):
                return
            distance, a, b = nearest_stretch(x, w.hashes[lo:hi])
            if distance <= self.search.edits(len(x)):
                new = (distance, lo + a - int(w.rows[row]), lo + b - int(w.rows[row]))
                best[row, item] = new if known is None else min(known, new)

        for found in self._small(w):
            compare(*found)
        for low in self.classes:
            hit = np.zeros(len(w.hashes), dtype=bool)
            hit[first] = self.bitmaps[low][bit]
            starts = self._windows(w, hit, low)
            for at in range(0, len(starts), 20_000):
                for found in sorted(self._candidates(w, starts[at : at + 20_000], low)):
                    compare(*found)
            for found in self._ends(w, hit, run_at, low):
                compare(*found)
        return [(r, i, s, e, d) for (r, i), (d, s, e) in sorted(best.items())]

    def _shared(self, item: int, text: np.ndarray) -> int:
        """At least as many of the item's words as a stretch can hold: those that occur in it."""
        own = self.sorted[item]
        at = np.minimum(np.searchsorted(own, text), len(own) - 1)
        seen = np.zeros(len(own), dtype=bool)
        seen[at[own[at] == text]] = True
        return int(seen.sum()) + len(self.words[item]) - len(own)

    def _candidates(self, w: words.Words, starts: np.ndarray, low: int) -> set[tuple[int, int, int, int]]:
        width, longest, _, flat, whose = self.classes[low]
        covered = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + width, -1)
        covered = np.cumsum(covered[:-1]) > 0
        keys = _keys(w.hashes[covered], (np.cumsum(covered) - 1)[starts], width, self.search)
        lo = np.searchsorted(flat, keys.ravel(), side="left")
        hi = np.searchsorted(flat, keys.ravel(), side="right")
        found = np.flatnonzero(hi > lo)
        window = found // keys.shape[1]
        times = hi[found] - lo[found]
        whom = whose[np.repeat(lo[found] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
        pairs = np.unique(np.repeat(window, times).astype(np.int64) * len(self.ids) + whom)
        begin = starts[pairs // len(self.ids)]
        rows = np.searchsorted(w.rows, begin, side="right") - 1
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for start, item, row in zip(begin.tolist(), (pairs % len(self.ids)).tolist(), rows.tolist()):
            reach = len(self.words[item]) + self.search.edits(len(self.words[item]))
            a, b = max(start - reach, int(w.rows[row])), min(start + reach, int(w.rows[row + 1]))
            own = out.setdefault((row, item), [])
            if own and a <= own[-1][1] and b - own[-1][0] <= 8 * reach:
                own[-1] = (own[-1][0], b)  # overlapping stretches are compared at once, up to a bounded length
            else:
                own.append((a, b))
        return {(row, item, a, b) for (row, item), own in out.items() for a, b in own}


def blocks(items: DataFrame, search: Search) -> Iterator[Items]:
    """The items in blocks of bounded size, read one block at a time."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in rows.toLocalIterator():
        n = len(row["text"].split())
        if ids and size + n > BLOCK_WORDS:
            yield Items(ids, texts, search)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Items(ids, texts, search)


def matches(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """``doc_id, item_id, start_word, end_word, distance``: the best stretch of each document for each item found."""
    schema = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, distance bigint"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for block in blocks(items, search):
        sent = spark.sparkContext.broadcast(block)

        def search_batches(batches, sent=sent):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = sent.value.find(batch.column(1))
                if found:
                    columns = [[ids[r] for r, *_ in found], [sent.value.ids[i] for _, i, *_ in found], *[[x[k] for x in found] for k in (2, 3, 4)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "item_id", "start_word", "end_word", "distance"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search_batches, schema)
        out = out.unionByName(part)
    return out


def drop_matching(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no item is found."""
    at = docs.columns.index("text")
    for block in blocks(items, search):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, sent=sent):
            for batch in batches:
                stays = np.ones(batch.num_rows, dtype=bool)
                stays[[r for r, *_ in sent.value.find(batch.column(at))]] = False
                if stays.any():
                    yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
