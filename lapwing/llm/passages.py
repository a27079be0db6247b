"""Fuzzy passages that repeat across documents, by collinear chaining of shared word k-mers.

1. Seeds: of every ``WINDOW`` neighbouring k-mers the one with the smallest hash, so two equal stretches of
   ``K + WINDOW - 1`` words share a seed wherever they stand.
2. Each seed is linked with its first document (the smallest ``doc_id`` that has it), not with all others: a passage in
   a third of all documents gives one link a document, and no link between different texts is lost, since both are
   linked with the first.  Seeds and links are shuffled as packed arrays by bucket, and a bucket is sorted in its task.  A seed
   that many documents of one batch have is linked inside the batch, with the first of them, which alone goes on: hot seeds
   don't gather.  A place is linked with all places that the seed has in its first document.  Up to ``PLACES`` are told one by one; of
   more only where runs of links begin and end is worked out, so texts full of the same lines don't make every product.
3. Runs: links that follow each other on one diagonal.  A run counts if it has links that share no word, or if another run of the two
   documents that shares no word with it is within ``NEAR`` words on nearly the same diagonal.
   Chains: a Fenwick tree over places in the first document finds for each run the best run before it in both, with a cost for
   the gaps.  A run alone is a chain too.  The runs of two documents are taken up by one task at once: its memory grows with their number.
4. Chains are aligned word by word: along diagonals between matches, then ``REACH`` words outwards from both ends.  An alignment is cut where its words agree too little; what is left are pieces that agree enough each.  Pieces of
   one document that touch are one passage, whichever document they came from first; a passage's equal words are those that
   are equal in any of its pieces, and if that is too few in all, it is cut again.

A passage has ``least`` words or more of which ``same`` percent agree.  It is reported for every document but the first that
has it, with a document before it as ``first_id``.  Null and empty texts and those of fewer than ``K`` words have no seed.  Rows that repeat a ``doc_id`` count as one
document, with places as in the row they come from; rows without a ``doc_id`` are left out.  Passages that repeat inside
one document only aren't reported.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import words
from lapwing.llm.scratch import Scratch, over_batches

K = 4
WINDOW = 2
PLACES = 4  # places of a seed in its first document that are told one by one; more are told as a list
LEAST = 50
SAME = 70
GAP_COST = 0.05  # points for each word that a chain skips, on either side; a match brings K
NEAR = 64
DRIFT = 16
REACH = 48  # words that an alignment goes beyond a chain, at most
OFTEN = 32  # documents of one batch from which a seed is linked inside the batch
BUCKET_BYTES = 8 << 20  # text whose seeds share a bucket: about a million
LEAST_BUCKETS = 16
BLOCK = 64  # words of a block that is fetched for alignment
BROADCAST_IDS = 2_000_000
KNOWN, KNOWN_WORDS = 50_000, 500  # comparisons on one diagonal whose pieces a task keeps, and of how many words at most
COMPARED = 1 << 20  # words that are compared at once, or one chain


def seeds_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word place and hash of each seed of a column."""
    w = words.split(column)
    h, begin = w.shingles(K)
    n = np.diff(begin)
    chosen = []
    if len(h) >= WINDOW:
        low = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
        row = np.repeat(np.arange(len(n)), n)
        inside = row[: len(low)] == row[WINDOW - 1 :]
        chosen.append(np.unique(low[inside]))
    short = np.flatnonzero((n > 0) & (n < WINDOW))
    chosen.append(np.array([begin[r] + h[begin[r] : begin[r + 1]].argmin() for r in short], dtype=np.int64))
    at = np.sort(np.concatenate(chosen)) if chosen else np.empty(0, dtype=np.int64)
    row = np.searchsorted(begin, at, side="right") - 1
    return row, at - begin[row], h[at]


def _packed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row a bucket, with each column's values of that bucket as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, dtype=np.int64)
    arrays = [pa.array(bucket[begin].astype(np.int32))]
    for c in columns:
        data = np.ascontiguousarray(c[order])
        ends = np.append(begin, len(data)) * data.itemsize
        arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *names])


def _unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _pairs(seed: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> list[pa.RecordBatch]:
    """Links of every other document of a seed with all places of the seed in its first one, by bucket of the two documents.

    Up to ``PLACES`` places are links ``doc, first, x, y``.  More are told once a bucket as ``seed, first, y``, and the places
    that ask for them as ``seed, doc, first, x``: their product is never made, see :func:`many_runs`.
    """
    if not len(seed):
        return []
    order = np.argsort(seed, kind="stable")  # a document's places come in order
    seed, doc, place = seed[order], doc[order], place[order]
    new = np.concatenate(([True], seed[1:] != seed[:-1]))
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(doc, np.flatnonzero(new))[group]
    own = doc == first
    home = np.flatnonzero(own)
    count = np.bincount(group[home])  # every group has its first document
    begin = np.cumsum(count) - count
    other = np.flatnonzero(~own)
    to = buckets + _of_pair(doc[other], first[other], buckets)
    few = count[group[other]] <= PLACES

    def places(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[groups]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return n, place[home[np.repeat(begin[groups], n) + nth]]

    n, y = places(group[other[few]])
    at = np.repeat(other[few], n)
    parts = [_packed(np.repeat(to[few], n), [doc[at], first[at], place[at], y], _LINKS)]
    if not few.all():
        at = other[~few]
        parts.append(_packed(to[~few], [seed[at], doc[at], first[at], place[at]], _ASKED))
        told = np.unique(group[at] * (2 * buckets) + to[~few])
        groups, told = told // (2 * buckets), told % (2 * buckets)
        n, y = places(groups)
        at = np.repeat(home[begin[groups]], n)
        parts.append(_packed(np.repeat(told, n), [seed[at], first[at], y], _TOLD))
    return parts


_SEEDS, _LINKS = ["seed", "doc", "place"], ["doc", "first", "x", "y"]
_ASKED, _TOLD = ["seed", "doc", "first", "x"], ["seed", "first", "y"]


def links(docs: DataFrame, buckets: int) -> DataFrame:
    """Links as bytes by bucket of their pair of documents: ``bucket, seed, doc, first, x, y``, see :func:`_pairs`.

    Seeds go to the bucket of their hash.  A seed of more than ``OFTEN`` documents of one batch is linked inside the batch, with the
    first of these, and only that one goes on: a seed of a third of all documents is a few rows a batch.
    """

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, place, h = seeds_of(batch.column(1))
        doc = batch.column(0).to_numpy()[row]
        place = place.astype(np.int32)
        # whether a seed is frequent here: its distinct documents
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order]
        new = np.concatenate(([True], hs[1:] != hs[:-1])) if len(hs) else np.empty(0, dtype=bool)
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= ds[1:] != ds[:-1]
        often = np.bincount(group, weights=fresh)[group] > OFTEN if len(hs) else new
        lead = ds == np.minimum.reduceat(ds, np.flatnonzero(new))[group] if len(hs) else new
        sent = order[~often | lead]
        local = order[often]
        bucket = (h[sent] % np.uint64(buckets)).astype(np.int64)
        parts = [_packed(bucket, [(h[sent] >> np.uint64(16)).astype(np.uint64), doc[sent], place[sent]], _SEEDS)]
        if len(local):
            parts += _pairs(h[local] >> np.uint64(16), doc[local], place[local], buckets)
        return _rows(parts)

    def match(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return pa.Table.from_batches([_rows([table])])
        seed, doc, place = (_unpacked(table, n, k) for n, k in zip(_SEEDS, (np.uint64, np.int64, np.int32)))
        return pa.Table.from_batches([_rows(_pairs(seed, doc, place, buckets))])

    schema = "bucket int, seed binary, doc binary, place binary, first binary, x binary, y binary"
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(over_batches(gather), schema).groupBy("bucket").applyInArrow(match, schema).select("bucket", "seed", *_LINKS)


def _pair_key(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    return words.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64))


def _of_pair(doc: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    return (_pair_key(doc, first) % np.uint64(buckets)).astype(np.int64)


def _rows(parts: list) -> pa.RecordBatch:
    """Rows of seeds and of links under one schema."""
    names = ["bucket", "seed", "doc", "place", "first", "x", "y"]
    columns = [[] for _ in names]
    for part in parts:
        for n, c in zip(names, columns):
            own = part.column(n) if n in part.schema.names else pa.nulls(part.num_rows, pa.binary())
            c.extend(own.chunks if isinstance(own, pa.ChunkedArray) else [own])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=names)


def chain(x: np.ndarray, y: np.ndarray, least: int = 2) -> list[np.ndarray]:
    """Chains of ``least`` matches ``(x, y)``, sorted by x and then y, as index arrays; each match is in one chain at most."""
    return [own for own in chain_runs(x, y, x, np.ones(len(x), dtype=np.int64)) if len(own) >= least]


def _crossing(key: np.ndarray, code: np.ndarray, other: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ``(i, j)`` of the same key, ``key[i] == other[j]``, but of different codes, ``code[i] != codes[j]``."""
    order = np.lexsort((codes, other))
    other, codes = other[order], codes[order]
    lo, hi = np.searchsorted(other, key, side="left"), np.searchsorted(other, key, side="right")
    head = np.flatnonzero(np.concatenate(([True], (other[1:] != other[:-1]) | (codes[1:] != codes[:-1]))))
    tail = np.append(head[1:], len(other))
    both = words.mix(other[head] ^ words.mix(codes[head]))
    by = np.argsort(both)
    mine = words.mix(key ^ words.mix(code))
    at = by[np.minimum(np.searchsorted(both[by], mine), len(by) - 1)]
    equal = both[at] == mine
    skip, on = np.where(equal, head[at], hi), np.where(equal, tail[at], hi)
    before = skip - lo
    n = before + hi - on
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = np.repeat(np.arange(len(key)), n)
    return i, order[np.where(nth < before[i], lo[i] + nth, on[i] + nth - before[i])]


def _sides_of(group: np.ndarray, place: np.ndarray, seed: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """What is just before and just after each place, sorted by group and place: the seed there and how far, or ``none``."""
    gap = np.diff(place)
    near = (group[1:] == group[:-1]) & (gap <= WINDOW)
    before, after = np.full(len(place), none, dtype=np.uint64), np.full(len(place), none, dtype=np.uint64)
    before[1:][near] = words.mix(seed[:-1] * np.uint64(8) + gap.astype(np.uint64))[near]
    after[:-1][near] = words.mix(seed[1:] * np.uint64(8) + gap.astype(np.uint64))[near]
    return before, after


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether a row has the values of the one before it."""
    out = np.ones(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        out &= c[1:] == c[:-1]
    return np.concatenate(([False], out))[: len(columns[0])]


def many_runs(asked: tuple, told: tuple) -> tuple[np.ndarray, ...]:
    """Runs ``doc, first, x, y, last x, links`` of all links of ``asked`` (seed, doc, first, x) with ``told`` (seed, first, y).

    Equal words before two places of a seed mean equal seeds before them, so a run begins where the seeds before differ and ends
    where the seeds after do.  Only beginnings and ends are made; on a diagonal they take turns.
    """
    seed, doc, first, x = asked
    order = np.lexsort((seed, x, first, doc))
    order = order[~_same(seed[order], doc[order], first[order], x[order])]
    seed, doc, first, x = seed[order], doc[order], first[order], x[order]
    ts, tf, ty = told
    order = np.lexsort((ts, ty, tf))  # a list can come from a batch and from a bucket
    order = order[~_same(ts[order], tf[order], ty[order])]
    ts, tf, ty = ts[order], tf[order], ty[order]
    pair = np.cumsum(~_same(doc, first))
    before, after = _sides_of(pair, x, seed, 1)
    their_before, their_after = _sides_of(tf, ty, ts, 2)
    # different texts under one number can have two seeds at one place: what is before and after isn't known, each link is a run
    mixed = np.isin(pair, pair[_same(pair, x)]) | np.isin(first, tf[_same(tf, ty)])
    before[mixed] = after[mixed] = 1
    key, their_key = _pair_key(seed, first), _pair_key(ts, tf)
    i, j = _crossing(key, before, their_key, their_before)
    order = np.lexsort((x[i], x[i] - ty[j], pair[i]))
    i, j = i[order], j[order]
    k, m = _crossing(key, after, their_key, their_after)
    k = k[np.lexsort((x[k], x[k] - ty[m], pair[k]))]
    return doc[i], first[i], x[i], ty[j], x[k], np.where(mixed[i], 1, k - i + 1)


def merged(doc, first, x, y, end, n) -> tuple[np.ndarray, ...]:
    """Runs whose words touch on one diagonal as one: ``pair, doc, first, x, y, last x, links``, ordered by pair and x."""
    order = np.lexsort((x, x - y, first, doc))
    doc, first, x, y, end, n = (c[order] for c in (doc, first, x, y, end, n))
    on = _same(doc, first, x - y)
    on[1:] &= x[1:] - end[:-1] <= K
    head = np.flatnonzero(~on)
    if len(head):
        end, n = np.maximum.reduceat(end, head), np.add.reduceat(n, head)
    doc, first, x, y = doc[head], first[head], x[head], y[head]
    pair = np.cumsum(~_same(doc, first))
    order = np.lexsort((y, x, pair))
    return tuple(c[order] for c in (pair, doc, first, x, y, end, n))


def supported(pair: np.ndarray, x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which runs have links that share no word, or a run of their pair near them that shares no word, on nearly the same diagonal."""
    found = end - x >= K
    n = np.where(found, (end - x) // (NEAR // 2) + 2, 1)  # a long run is seen by its ends and places between
    run = np.repeat(np.arange(len(x)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(x[run] + nth * (NEAR // 2), end[run])
    d = (x - y)[run]
    for shift in (0, DRIFT):  # nearly equal diagonals share a band in one of two ways to cut them
        band = (d + shift) // (2 * DRIFT)
        order = np.lexsort((at, band, pair[run]))
        r, p, b, a, diagonal = run[order], pair[run][order], band[order], at[order], d[order]
        for side in (1, -1):
            live = np.flatnonzero(~found[r])
            k = 0
            while len(live):
                k += 1
                live = live[(live + side * k >= 0) & (live + side * k < len(r))]
                to = live + side * k
                apart = np.abs(a[to] - a[live])
                close = (p[to] == p[live]) & (b[to] == b[live]) & (apart <= NEAR)
                live, to, apart = live[close], to[close], apart[close]
                good = (apart >= K) & (np.abs(diagonal[to] - diagonal[live]) <= DRIFT)
                found[r[live[good]]] = True
                live = live[~good]
    return found


def chain_runs(x: np.ndarray, y: np.ndarray, end: np.ndarray, links: np.ndarray) -> list[np.ndarray]:
    """Chains of runs (first place in both, last x, links), sorted by x, as index arrays; each run is in one chain.

    A link scores ``K`` points; words that are skipped, on either side, cost ``GAP_COST`` each.
    """
    n = len(x)
    if n == 1:
        return [np.arange(1)]
    x, y, end = x.astype(np.int64), y.astype(np.int64), end.astype(np.int64)
    last = y + end - x
    order = np.unique(last)
    low, rank = np.searchsorted(order, y).tolist(), (np.searchsorted(order, last) + 1).tolist()
    size = len(order)
    value, index = [-1e18] * (size + 1), [-1] * (size + 1)
    own = (K * links - GAP_COST * 2 * (end - x)).tolist()
    start, stop = (GAP_COST * (x + y)).tolist(), (GAP_COST * (end + last)).tolist()
    score, parent = [0.0] * n, [-1] * n
    # at one place beginnings come before ends: what follows a run begins after it
    for e in np.lexsort((np.repeat([0, 1], n), np.concatenate((x, end)))).tolist():
        if e < n:
            best, source, r = -1e18, -1, low[e]
            while r > 0:
                if value[r] > best:
                    best, source = value[r], index[r]
                r -= r & -r
            gain = best - start[e]
            score[e], parent[e] = (own[e] + gain, source) if source >= 0 and gain > 0 else (own[e], -1)
        else:
            i = e - n
            v, r = score[i] + stop[i], rank[i]
            while r <= size:
                if v > value[r]:
                    value[r], index[r] = v, i
                r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        taken = []
        while i >= 0 and not used[i]:
            used[i] = True
            taken.append(i)
            i = parent[i]
        if taken:
            out.append(np.array(taken[::-1]))
    return out


def chains(linked: DataFrame) -> DataFrame:
    """One row for each two documents that have chains, from the links of :func:`links`: ``pair_id, doc_id, first_id``, in ``xs`` and
    ``ys`` the first and the last place of each run of all chains, in ``ends`` where each chain ends there, and the blocks of words
    that their alignment needs."""

    kinds = {"seed": np.uint64, "doc": np.int64, "first": np.int64, "x": np.int32, "y": np.int32}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        def without(absent: str, *names: str) -> tuple[np.ndarray, ...]:
            rows = table.filter(pc.is_null(table[absent]))
            return tuple(_unpacked(rows, n, kinds[n]) for n in names)

        doc, first, x, y = without("seed", *_LINKS)
        asked, told = without("y", *_ASKED), without("doc", *_TOLD)
        all_runs = [(doc, first, x, y, x, np.ones(len(x), dtype=np.int64))]
        if len(asked[0]):
            all_runs.append(many_runs(asked, told))
        pair, doc, first, x, y, end, n = merged(*(np.concatenate(c) for c in zip(*all_runs)))
        near = supported(pair, x, y, end)
        pair, doc, first, x, y, end, n = (c[near] for c in (pair, doc, first, x, y, end, n))
        edges = (np.flatnonzero(np.diff(pair)) + 1).tolist()
        rows: list[tuple] = []
        for lo, hi in zip([0, *edges], [*edges, len(doc)]):
            if lo < hi:
                found = chain_runs(x[lo:hi], y[lo:hi], end[lo:hi], n[lo:hi])
                own = np.concatenate(found) + lo
                xs = np.stack((x[own], end[own]), axis=1).ravel()
                ys = xs - np.repeat(x[own] - y[own], 2)
                ends = 2 * np.cumsum([len(c) for c in found])
                rows.append((f"{doc[lo]}:{first[lo]}", doc[lo], first[lo], xs, ys, ends, _blocks(xs, ends), _blocks(ys, ends)))
        return pa.Table.from_batches([_chain_batch(rows)])

    return linked.groupBy("bucket").applyInArrow(run, f"pair_id string, doc_id bigint, first_id bigint, {', '.join(f'{n} array<int>' for n in _LISTS)}")


_LISTS = ["xs", "ys", "ends", "blocks", "first_blocks"]


def _around(places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last block of what the alignment of each chain reads."""
    begin = np.concatenate(([0], ends[:-1]))
    return np.maximum(places[begin] - REACH, 0) // BLOCK, (places[ends - 1] + K + REACH) // BLOCK


def _blocks(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lo, hi = _around(places, ends)
    n = hi - lo + 1
    return np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    none = [np.empty(0, dtype=np.int32)]
    lists = []
    for i in range(3, 8):
        begin = pa.array(np.concatenate(([0], np.cumsum([len(r[i]) for r in rows]))).astype(np.int32))
        lists.append(pa.ListArray.from_arrays(begin, pa.array(np.concatenate([*(r[i] for r in rows), *none]).astype(np.int32))))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.int64()), pa.array([r[2] for r in rows], type=pa.int64()), *lists],
        names=["pair_id", "doc_id", "first_id", *_LISTS],
    )


def _word_blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, block, items``: the words (hashes) of the wanted blocks; ``wanted`` has distinct ``doc_id, block``."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list("block").alias("blocks"))  # as many as the document has, at most
    if lists.count() <= BROADCAST_IDS:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lists.select("doc_id")), "doc_id", "leftsemi")
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(lists, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words.split(batch.column(1))
        h = w.hashes.astype(np.uint32).view(np.int32)
        ids, number, items = [], [], []
        for doc, lo, hi, blocks in zip(batch.column(0).to_pylist(), w.rows[:-1].tolist(), w.rows[1:].tolist(), batch.column(2).to_pylist()):
            for b in blocks:
                if lo + b * BLOCK < hi:
                    ids.append(doc)
                    number.append(b)
                    items.append(h[lo + b * BLOCK : min(lo + (b + 1) * BLOCK, hi)])
        if not ids:
            return None
        begin = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array(number, type=pa.int32()), pa.ListArray.from_arrays(pa.array(begin), pa.array(np.concatenate(items)))],
            names=["doc_id", "block", "items"],
        )

    found = texts.select("doc_id", "text", "blocks").mapInArrow(over_batches(run), "doc_id bigint, block int, items array<int>")
    return found.groupBy("doc_id", "block").agg(F.first("items").alias("items"))  # rows may repeat a number


def _side(column: pa.Array, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of all rows, and of each chain of ``row`` with blocks ``lo`` to ``hi``: from where to where, and the place of the first one."""
    begin, items = column.offsets.to_numpy(), column.values.field(1)
    number = column.values.field(0).to_numpy().astype(np.int64)[begin[0] : begin[-1]]
    number |= np.repeat(np.arange(len(column)) << 32, np.diff(begin))
    at = items.offsets.to_numpy().astype(np.int64)[begin[0] :]
    to = np.searchsorted(number, row << 32 | hi, side="right")  # a text can end before its last block
    return items.values.to_numpy(), at[np.searchsorted(number, row << 32 | lo)], at[to], lo * BLOCK


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the words that are equal along a chain, both ascending."""
    us, vs = [], []

    def along(x: int, y: int, n: int) -> None:
        at = np.flatnonzero(a[x : x + n] == b[y : y + n])
        us.append(x + at)
        vs.append(y + at)

    x0, y0 = int(xs[0]), int(ys[0])
    px, py = x0, y0
    # matches in a row on one diagonal are one long match
    turns = np.flatnonzero(np.diff(xs - ys)) + 1
    heads, tails = np.concatenate(([0], turns)), np.concatenate((turns, [len(xs)])) - 1
    for x, y, size in zip(xs[heads].tolist(), ys[heads].tolist(), (xs[tails] - xs[heads] + K).tolist()):
        if x < px or y < py:  # it overlaps the match before it
            skip = max(px - x, py - y)
            x, y = x + skip, y + skip
            end = x + max(0, size - skip)
        else:
            # Words between matches: up to some word on the diagonal of the one before, then on that of the next.
            n = min(x - px, y - py)
            if n:
                before = np.concatenate(([0], np.cumsum(a[px : px + n] == b[py : py + n])))
                after = np.concatenate(([0], np.cumsum(a[x - n : x] == b[y - n : y])))
                turn = int((before - after).argmax())
                along(px, py, turn)
                along(x - n + turn, y - n + turn, n - turn)
            end = x + size
        n = max(0, min(end, len(a)) - x)
        along(x, y, n)
        px, py = max(px, x + n), max(py, y + n)
    n = min(REACH, x0, y0)
    along(x0 - n, y0 - n, n)
    us.insert(0, us.pop())
    vs.insert(0, vs.pop())
    along(px, py, max(0, min(REACH, len(a) - px, len(b) - py)))
    return np.concatenate(us).astype(np.int64), np.concatenate(vs).astype(np.int64)


def cut(x: np.ndarray, y: np.ndarray, least: int, same: int) -> list[tuple[int, int]]:
    """Pieces ``(from, to)`` of ascending equal places ``(x, y)`` of which ``same`` percent or more agree, apart and in order.

    An equal word scores ``100 - same``, a different one ``-same``.  Words that agree too little part what is before and
    after them: in each group of maximal scoring stretches (Ruzzo and Tompa) of two equal words or more, at most ``REACH``
    words apart, and then in what is left, the longest stretch of ``least`` words that passes is taken, again and again until
    there is none.  Maximal scoring stretches outside of these are given too, though they are shorter.
    """
    if not len(x):
        return []
    gap = np.maximum(np.diff(x), np.diff(y)) - 1
    end = np.cumsum(np.concatenate(([100 - same], 100 - same - same * gap)))  # score up to and with each place
    begin = end - (100 - same)
    first = np.concatenate(([0], np.flatnonzero(gap > 0) + 1))
    last = np.concatenate((first[1:], [len(x)])) - 1
    stack: list[tuple[int, int, int, int, int]] = []  # from, to, score before, score after, entry that begins lower
    for i, j in zip(first.tolist(), last.tolist()):
        low, high = int(begin[i]), int(end[j])
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= high:
                break
            i, low = stack[k][0], stack[k][2]
            before = stack[k][4]
            del stack[k:]
            k = before
        stack.append((i, j, low, high, k))
    groups: list[list[int]] = []
    for i, j, *_ in stack:
        if j > i:  # one word alone may agree by chance
            if groups and max(x[i] - x[groups[-1][1] - 1], y[i] - y[groups[-1][1] - 1]) <= REACH:
                groups[-1][1] = j + 1
            else:
                groups.append([i, j + 1])

    def longest(lo: int, hi: int) -> None:
        rest = [(lo, hi)]
        while rest:
            lo, hi = rest.pop()
            if lo >= hi or x[hi - 1] - x[lo] + 1 < least:
                continue
            low = np.minimum.accumulate(begin[lo:hi])
            i = lo + np.searchsorted(-low, -end[lo:hi], side="left")  # the first place from which a stretch up to here passes
            n = x[lo:hi] - x[i] + 1
            j = int(n.argmax())
            if n[j] >= least:
                out.append((int(i[j]), lo + j + 1))
                rest += [(lo, int(i[j])), (lo + j + 1, hi)]

    out: list[tuple[int, int]] = []
    for i, j in groups:
        longest(i, j)
    own = sorted(out)
    for i, j in zip([0, *[j for _, j in own]], [*[i for i, _ in own], len(x)]):
        longest(i, j)
    taken = np.zeros(len(x) + 1, dtype=np.int64)
    for i, j in out:
        taken[i + 1 : j + 1] = 1
    taken = np.cumsum(taken)
    out += [(i, j + 1) for i, j, *_ in stack if taken[j + 1] == taken[i]]
    return sorted(out)


def _aligned(batch: pa.RecordBatch, least: int, same: int, known: dict[bytes, list[tuple[int, int, bytes]]]) -> Iterator[tuple]:
    """Pieces of the chains of a batch.  ``known`` has the pieces of what was compared on one diagonal before."""
    doc_ids, first_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    xs, ys, ends = (batch.column(i) for i in (2, 3, 4))
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends.offsets.to_numpy()))
    until = xs.offsets.to_numpy()[row] + ends.flatten().to_numpy()  # in the values of all rows
    at = np.concatenate((xs.offsets.to_numpy()[:1], until[:-1]))
    xs, ys = xs.values.to_numpy().astype(np.int64), ys.values.to_numpy().astype(np.int64)[ys.offsets[0].as_py() :]
    xs, at, until = xs[at[0] :], at - at[0], until - at[0]
    wa, from_a, to_a, base_a = _side(batch.column(5), row, *_around(xs, until))
    wb, from_b, to_b, base_b = _side(batch.column(6), row, *_around(ys, until))
    # A chain on one diagonal is compared along it, as in align.
    d = xs - ys
    straight = np.minimum.reduceat(d, at) == np.maximum.reduceat(d, at)
    x, y, end = xs[at] - base_a, ys[at] - base_b, xs[until - 1] + K - base_a
    size_a, size_b = to_a - from_a, to_b - from_b
    before = np.minimum(np.minimum(x, y), REACH)
    end = np.maximum(np.minimum(end, size_a), x)
    end = end + np.maximum(0, np.minimum(np.minimum(size_a - end, size_b - (y + end - x)), REACH))
    x, y = x - before, y - before
    n = np.where(straight, end - x, 0)

    def pieces(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        for lo, hi in cut(x, y, least, same):
            if hi - lo >= K:
                own = np.zeros(x[hi - 1] - x[lo] + 1, dtype=bool)
                own[x[lo:hi] - x[lo]] = True
                yield int(x[lo]), int(x[hi - 1]) + 1, int(y[lo]), int(y[hi - 1]) + 1, np.packbits(own).tobytes()

    total = np.cumsum(n)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + COMPARED, side="right")))
        size = n[lo:hi]
        begin = np.concatenate(([0], np.cumsum(size)))
        nth = np.arange(begin[-1])
        equal = wa[nth + np.repeat((from_a + x)[lo:hi] - begin[:-1], size)] == wb[nth + np.repeat((from_b + y)[lo:hi] - begin[:-1], size)]
        compared, begin = equal.tobytes(), begin.tolist()
        first_x, first_y = (x + base_a)[lo:hi].tolist(), (y + base_b)[lo:hi].tolist()
        for i, (r, one) in enumerate(zip(row[lo:hi].tolist(), straight[lo:hi].tolist())):
            doc, first = doc_ids[r], first_ids[r]
            if one:
                key = compared[begin[i] : begin[i + 1]]
                found = known.get(key)
                if found is None:
                    places = np.flatnonzero(equal[begin[i] : begin[i + 1]])
                    found = [(s, e, bits) for s, e, _, _, bits in pieces(places, places)]
                    if len(key) <= KNOWN_WORDS:
                        known[key] = found
                ox, oy = first_x[i], first_y[i]
                for s, e, bits in found:
                    yield doc, first, ox + s, ox + e, oy + s, oy + e, bits
            else:
                c = lo + i
                oa, ob, own = int(base_a[c]), int(base_b[c]), slice(at[c], until[c])
                for s, e, fs, fe, bits in pieces(*align(wa[from_a[c] : to_a[c]], wb[from_b[c] : to_b[c]], xs[own] - oa, ys[own] - ob)):
                    yield doc, first, s + oa, e + oa, fs + ob, fe + ob, bits
        lo = hi


def repeats(docs: DataFrame, least: int = LEAST, same: int = SAME) -> DataFrame:
    """``doc_id, start_word, end_word, first_id, first_start, first_end, equal_words``: one row a passage and document.

    ``first_id`` and its places are those of the longest stretch of the passage.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    linked = scratch.keep(chains(links(docs, max(LEAST_BUCKETS, size // BUCKET_BYTES))))

    left = linked.select("pair_id", "doc_id", F.explode("blocks").alias("block"))
    right = linked.select("pair_id", F.col("first_id").alias("doc_id"), F.explode("first_blocks").alias("block"))
    fetched = scratch.keep(_word_blocks(docs, left.unionByName(right).select("doc_id", "block").distinct()))

    def side(rows: DataFrame, name: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("block", "items")))  # as many blocks as the document has, at most
        return rows.join(fetched, ["doc_id", "block"]).groupBy("pair_id").agg(own.alias(name))

    both = linked.drop("blocks", "first_blocks").join(side(left, "a"), "pair_id").join(side(right, "b"), "pair_id")
    schema = "doc_id bigint, first_id bigint, s int, e int, fs int, fe int, equal binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[tuple[int, int, bytes]]] = {}
        for batch in batches:
            if batch.num_rows and (rows := list(_aligned(batch, least, same, known))):
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "first_id", "s", "e", "fs", "fe", "equal"])
            if len(known) > KNOWN:
                known.clear()

    aligned = both.select("doc_id", "first_id", "xs", "ys", "ends", "a", "b").mapInArrow(run, schema)
    return _joined(aligned, least, same)


def join(pieces: list[dict], least: int, same: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(start, end, first_id, first_start, first_end, equal words)`` of the passages that a document's pieces make."""
    out = []
    pieces = sorted(pieces, key=lambda p: (p["s"], p["e"], p["first_id"], p["fs"]))
    at = 0
    while at < len(pieces):
        s, e, to = pieces[at]["s"], pieces[at]["e"], at + 1
        while to < len(pieces) and pieces[to]["s"] <= e:
            e = max(e, pieces[to]["e"])
            to += 1
        own, at = pieces[at:to], to
        if e - s < least:
            continue
        equal = np.zeros(e - s, dtype=bool)
        for p in own:
            n = p["e"] - p["s"]
            equal[p["s"] - s : p["e"] - s] |= np.unpackbits(np.frombuffer(p["equal"], dtype=np.uint8), count=n).astype(bool)
        x = np.flatnonzero(equal)
        spans = [(0, len(x))] if len(x) * 100 >= same * (e - s) else cut(x, x, least, same)
        for i, j in spans:
            lo, hi = int(x[i]) + s, int(x[j - 1]) + 1 + s
            if hi - lo >= least:
                top = max(own, key=lambda p: (min(hi, p["e"]) - max(lo, p["s"]), -p["s"], -p["first_id"]))
                out.append((lo, hi, top["first_id"], top["fs"], top["fe"], j - i))
    return out


def _joined(aligned: DataFrame, least: int, same: int) -> DataFrame:
    """Pieces of a document that touch become one passage.  A document's pieces are at most as many as its seeds."""
    rows = aligned.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "first_id", "fs", "fe", "equal")).alias("all"))
    names = ["doc_id", "start_word", "end_word", "first_id", "first_start", "first_end", "equal_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(doc, *p) for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in join(own, least, same)]
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found)], names=names)

    return rows.mapInArrow(over_batches(run), ", ".join(f"{n} bigint" for n in names))
