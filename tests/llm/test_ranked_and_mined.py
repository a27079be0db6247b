"""Compression scores, ranked search and hard negatives against brute force, held-out rows and odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapwing.llm import hard_negatives, quality, queries, ranked_search
from lapwing.llm.scratch import prepare

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def spark(spark):
    return prepare(spark)


# quality


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES["op11_quality"](spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([r.predicted == 0 for r in held if r.quality == 0]) > 0.8
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.95
    assert abs(np.mean([r.score for r in held]) - np.mean([r.quality for r in held])) < 0.05


def test_quality_learns_only_from_given_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    turned = labels.withColumn("quality", F.when(part == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.learn(docs, t.where(part != 1))).collect() for t in (labels, turned))
    assert sorted(a) == sorted(b)


def test_whole_texts_are_measured_in_blocks():
    rng = np.random.default_rng(5)
    good = [" ".join(f"a{x}" for x in rng.integers(0, 500, 150)).encode() for _ in range(40)]
    bad = [" ".join(f"z{x}" for x in rng.integers(0, 500, 150)).encode() for _ in range(40)]
    m = quality.Measure(*quality.build(good, bad))
    long = b" ".join(good[:5] + bad[5:40])
    saved, both = m.differences(pa.array([good[0].decode(), bad[0].decode(), long.decode(), "", None]))
    assert saved[0] > 0 > saved[1] and saved[2] < 0 and saved[3] == saved[4] == both[3] == 0
    compress = m._compress
    pieces = [long[i : i + quality.BLOCK] for i in range(0, len(long), quality.BLOCK)]
    assert saved[2] == sum(len(compress[1](p)) - len(compress[0](p)) for p in pieces) / (len(long) + quality.EVEN)


def test_curve_recovers_its_own_slopes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 20_000)) * np.array([[1.0], [0.01]])
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + 2 * x[0] - 100 * x[1])))).astype(float)
    assert np.allclose(quality.curve(x, y, np.ones(20_000)), [0.5, 2, -100], rtol=0.15)


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 0.1, "a"), (1, "good words here", 0.1, "a"), (2, "bad!! bad!! bad!!", None, None), (3, None, 1.0, "b"),
         (4, "", 1.0, "b"), (None, "no number", 1.0, "b"), (5, "good " * 100_000, 1.0, "b")],
        "doc_id long, text string, score double, good string",
    )
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    both = [(1, 1), (2, 0), (2, 0), (3, 1), (None, 0), (5, None)]
    for rows, want in [(both, None), ([(1, 1)], 1.0), ([(2, 0)], 0.0), ([], 0.0), ([(3, 1), (4, 0)], 0.5)]:
        out = quality.score(docs, quality.learn(docs, label(rows))).collect()
        assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (3, 4)}) == 1
        if want is not None:
            assert all(abs(r.score - want) < 1e-9 for r in out)
    empty = docs.limit(0)
    assert quality.score(empty, quality.learn(empty, label(both))).count() == 0


# ranked search


def ranked(docs, items, k=10):
    """Brute force: every document is scored for every item."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in held:
            m = 25 + 75 * n * n_docs // length
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(TERM.findall(fold(text))).items()
                if t in c
            )
            if s > 0:
                found.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def same(found, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("shard,sparse,range_size", [(1 << 16, 32, 2048), (64, 4, 16), (50, 1, 7), (64, 10_000, 8)])
def test_search_by_brute_force(spark, monkeypatch, shard, sparse, range_size):
    """With all lists short, all long, and both; several shards and ranges; ties; repeated terms."""
    for name, value in (("SHARD", shard), ("SPARSE", sparse), ("RANGE", range_size)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(f"T{int(x)}" for x in rng.zipf(1.3, n) % 300)
    docs = [(int(i), draw(rng.integers(1, 60))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)]
    items = [(i, draw(rng.integers(1, 30))) for i in range(25)]
    score = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    counted_by = []
    for block in ranked_search.blocks(spark.createDataFrame(items, "item_id long, text string")):
        rows = [r.asDict() for r in ranked_search.count_terms(score, block.vocabulary).collect()]
        begin = np.concatenate(([0], np.cumsum([len(r["term"]) for r in rows])))
        n = np.array([r["n"] for r in rows])
        documents, length = len(rows), int(n.sum())
        term, tf = (np.concatenate([np.array(r[c], dtype=np.int64) for r in rows]) for c in ("term", "tf"))
        w = np.array([ranked_search.weight(documents, max(1, int((term == t).sum()))) for t in range(len(block.vocabulary))])
        factor = lambda t, f, size: w[t] * (10**9 * f // (1000 * f + 8 * (25 + 75 * size * documents // length)))
        best = [ranked_search.Best(10) for _ in block.items]
        doc = np.array([r["doc_id"] for r in rows])
        for lo in range(0, len(rows), shard):  # shards one after another, as a task takes them
            own = slice(lo, min(lo + shard, len(rows)))
            inside = slice(begin[own.start], begin[own.stop])
            s = ranked_search.Shard(doc[own], n[own], begin[own.start : own.stop + 1] - begin[own.start], term[inside], tf[inside], factor)
            for asked, b in zip(block.asked, best):
                s.answer(asked, b)
        counted_by += [(item, rank, int(d), int(x)) for item, b in zip(block.items, best) for rank, (d, x) in enumerate(zip(b.doc, b.score), 1)]
    want = ranked(docs, items)
    same(counted_by, want)
    same(ranked_search.search(spark, score, spark.createDataFrame(items, "item_id long, text string")).collect(), want)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 300)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(6).collect()]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(ranked_search.blocks(table))) > 2
    same(ranked_search.search(spark, spark.createDataFrame(docs, "doc_id long, text string"), table).collect(), ranked(docs, items))


def test_search_odd_tables(spark):
    docs = [(1, "Red fox"), (1, "Red fox"), (None, "red fox"), (2, None), (3, ""), (4, "\x00 -- \x7f"), (5, "ÉTÉ été 7up fox_red"), (6, "fox " * 200_000)]
    items = [(1, "fox RED red"), (1, "été"), (None, "7up"), (2, None), (3, ""), (4, "!?"), (5, "absent"), (6, "ÉTÉ")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, score string")
    i = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, term string")
    same(ranked_search.search(spark, d, i).collect(), ranked(docs, items))
    assert ranked_search.search(spark, d.limit(0), i).count() == ranked_search.search(spark, d, i.limit(0)).count() == 0


# hard negatives


def mined(rows, rule, anchors):
    rows = [(i, l, x) for i, l, x in rows if i is not None and l is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    rows = [(i, l, [math.floor(256 * float(np.float32(c))) for c in x]) for i, l, x in rows]
    first = {}
    for r in rows:
        if r[0] in anchors and (r[0] not in first or (r[1], r[2]) < first[r[0]][1:]):
            first[r[0]] = r
    out = set()
    for a, label, v in first.values():
        score = [(-sum(p * q for p, q in zip(v, x)), i, l) for i, l, x in rows if i != a and len(x) == len(v)]
        for s, p, _ in sorted(t for t in score if t[2] == label)[: rule.positives]:
            near = sorted(t for t in score if t[2] != label and rule.low * -s <= 100 * -t[0] <= rule.high * -s)
            out |= {(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(near[: rule.negatives], 1)}
    return out


@pytest.fixture(scope="module")
def tied():
    """Rows from few directions: many ties, near copies under other labels."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(6, 8))
    rows = []
    for i in range(600):
        x = centre[i % 6] * (1 + i % 3) / 3 + rng.normal(size=8) * (0.3 if i % 2 else 0)
        rows.append((i, int(rng.integers(0, 4)), (x / 4).astype(np.float32).tolist()))
    return rows


RULE = hard_negatives.Window(4, 6, 30, 90)


def test_negatives_by_brute_force(spark, tied):
    table = hard_negatives.candidates(spark.createDataFrame(tied, "vec_id long, label int, embedding array<float>").repartition(3), F.col("label"))
    got = [tuple(r) for r in hard_negatives.mine(spark, table, table.where("vec_id % 20 = 0"), RULE).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(tied, RULE, set(range(0, 600, 20)))


@pytest.mark.parametrize("shard,first", [(600, 32), (37, 2), (200, 1), (600, 1)])
def test_negatives_from_shard_to_shard(tied, monkeypatch, shard, first):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    ids, labels = np.array([r[0] for r in tied]), np.array([r[1] for r in tied])
    x = np.floor(256 * np.array([r[2] for r in tied], dtype=np.float32).astype(float)).astype(np.int64)
    got, read = set(), 0
    parts = [np.arange(lo, min(lo + shard, 600)) for lo in range(0, 600, shard)]
    lists = [hard_negatives.Lists(ids[p], labels[p], x[p]) for p in parts]
    of_label = [[hard_negatives.Lists(ids[p][labels[p] == l], labels[p][labels[p] == l], x[p][labels[p] == l]) for p in parts] for l in range(4)]
    for a in range(0, 600, 20):
        top = hard_negatives.Top(RULE.positives)
        for own in of_label[labels[a]]:
            hard_negatives.nearest(own, x[a], a, top)
        bounds = [(-(-RULE.low * int(s) // 100), RULE.high * int(s) // 100) for s in top.score]
        tops = [hard_negatives.Top(RULE.negatives) for _ in bounds]
        for own in lists:
            hard_negatives.negatives(own, x[a], a, labels[a], bounds, tops)
        for positive, s, t in zip(top.ids.tolist(), top.score.tolist(), tops):
            got |= {(a, positive, rank, n, s, m) for rank, (n, m) in enumerate(zip(t.ids.tolist(), t.score.tolist()), 1)}
    assert got == mined(tied, RULE, set(range(0, 600, 20)))


def test_thresholds_bound_what_is_unread():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (300, 5))
    lists = hard_negatives.Lists(np.arange(300), np.zeros(300, dtype=int), x)
    anchor = np.array([3, -2, 0, 7, -1])
    seen, stops = np.zeros(300, dtype=bool), 0
    for rows, threshold in lists.read(anchor):
        assert not seen[rows].any()
        seen[rows] = True
        assert seen.all() or (lists.x[~seen] @ anchor).max() <= threshold
        stops += not seen.all()
    assert seen.all() and stops > 1


def test_negatives_in_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    table = hard_negatives.candidates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), F.col("label"))
    got = {tuple(r) for r in hard_negatives.mine(spark, table, table.where("vec_id % 25 = 0")).collect()}
    assert got == mined(rows, hard_negatives.Window(), set(range(0, 200, 25)))


def test_negatives_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 2, [float(i % 5), 1.0, -0.5]) for i in range(30)]
    rows = good + [
        (7, 1, [2.0, 1.0, -0.5]), (9, 1, [4.0, 1.0, -0.5]), (0, 0, [9.0, 9.0, 9.0]), (40, None, [1.0, 1.0, 1.0]), (41, 0, None), (42, 1, [1.0, None, 1.0]),
        (43, 1, [nan, 1.0, 1.0]), (44, 0, [inf, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (50, 1, [1.0, 1.0]), (60, 0, [1.0]), (70, 0, []), (80, 1, []), (90, 0, [0.0, 0.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, rank int, x int")
    own = hard_negatives.candidates(table, F.col("label"))
    got = {tuple(r) for r in hard_negatives.mine(spark, own, own.where("vec_id % 10 = 0")).collect()}
    assert got == mined(rows, hard_negatives.Window(), {0, 10, 20, 50, 60, 70, 80, 90})
    none = hard_negatives.candidates(table.limit(0), F.col("label"))
    assert hard_negatives.mine(spark, none, none).count() == hard_negatives.mine(spark, own, none).count() == 0
