"""The training-data operators against brute force, planted cases and odd tables."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm import chroma, decontaminate, html_text, jaccard, langid, mixing, passages, pii, queries, toxicity, url_rules, words
from lapwing.llm.scratch import prepare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def spark(spark):
    return prepare(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, and columns named like those the operators make."""
    text = "the quick brown fox jumps over the lazy dog and runs away from it, " * 3
    rows = [
        (1, text, "en", "a", 5, 1, "x"),
        (1, text, "en", "a", 5, 1, "x"),
        (2, text, "en", None, 5, None, None),
        (3, None, "en", "a", None, 2, "y"),
        (4, "", None, "b", 0, 2, "y"),
        (5, " \t\n ", "en", "b", 3, 2, "y"),
        (None, text + "more words", "en", "b", 3, 2, "y"),
        (6, "mail me at joe@example.com or +1 (743) 555-3824 now", None, None, 9, 3, "z"),
        (7, "word " * 60_000, "en", "c", 9, 3, "z"),
        (8, "12345 67890 !!", "en", "c", 9, 3, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, size string")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_are_those_of_the_pattern(docs):
    texts = [r.text for r in docs.collect()] + [None, "", "  a ", "Ünï\x0bcode x", "q" * 2_000_000 + " r"]
    w = words.split(pa.array(texts))
    assert np.diff(w.rows).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert w.hashes[w.rows[-2] : w.rows[-1]][1] == words.split(pa.array(["R"])).hashes[0]


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90), jaccard.Rule(5, 80)])
def test_jaccard_groups(docs, rule):
    sets = {}
    for r in docs.collect():
        w, k = WORD.findall(folded(r.text)), rule.width
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= rule.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs, rule).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in ids}
    assert {r.doc_id for r in jaccard.keep_one(docs, rule).collect()} == {i for i in ids if top(i) == i}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(t - 9 if t > 9 else t for t in twice) % 10 == 0
    return True


def test_personal_data(spark, docs):
    more = ["a@b.c_d@e.f x..y@z.co.uk 1.2.3.4.5 001.2.3.4 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 é𝒳 joe (at) mail (dot) com", None, "", "+49 30 1234567 a@b a@.b 🙂x@y.z", "a@b" + ".c" * 20_000]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra)
    found = pii.find(table, pii.train(table)).collect()
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    for r in found:
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], texts[r.doc_id]) if valid(k, m.group())]
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base] == want
    assert any(not s.base for r in found for s in r.spans if r.doc_id == 10**6 + 1)


def test_personal_data_query(spark):
    rows = queries.QUERIES["op1_personal_data"](spark, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.base_sha256 == empty) == (r.n_email + r.n_ip + r.n_card + r.n_phone == 0) for r in rows)


def test_expectation_maximisation_weighs_labelers():
    chance = pii.expectation_maximisation([(0, (1, 1, 1), 90), (0, (-1, -1, 1), 60), (0, (1, 1, -1), 10)])
    assert chance[0, (1, 1, 1)] > 0.9 and chance[0, (-1, -1, 1)] < 0.1 and chance[0, (1, 1, -1)] > 0.5


def test_redaction(spark):
    table = spark.createDataFrame([(1, "to a@b.co, 1.2.3.4!", 19), (2, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(table, []).collect()}
    assert got == {1: ("to [EMAIL], [IP]!", 17), 2: (None, 0)}


def test_toxicity_held_out(spark):
    rows = queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    pos, neg = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([p > n for p in pos for n in neg]) > 0.93
    assert sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(neg)


def test_html_cases():
    page = "<body><header>Top</header><div><div class='content'><h1>T &lt;x&gt;</h1><p>One, two, three, four words go here and on.<br>More<p>Second paragraph, with a comma and such text.<ul><li>item a<li>item b</ul><div class=comments><p>Nice, very nice, I really like it all.</div></div><div class=sidebar><p>side, side, side, side text here</div></div><form>f</form>"
    want = ["T <x>", "One, two, three, four words go here and on. More", "Second paragraph, with a comma and such text.", "item a", "item b"]
    assert html_text.main_text(page) == "\n\n".join(want)
    for bad in ("", None, "<div>", "<!-- <p>x</p>", "<script>a<b</script>"):
        assert html_text.main_text(bad) == ""


_PROSE = "".join(f"<p>Paragraph {i} of the article, with commas, and of a length that counts as prose for the scoring.</p>" for i in range(4))


@pytest.mark.parametrize(
    "attributes",
    ['class="content with-sidebar"', 'class="no-sidebar"', 'class="post has-comments"', 'class="article-body social-share-enabled"', 'class="story promo-free"',
     'class="wrapper page-with-header"', 'id="main" class="widget-area-right"', 'class="related-work"', 'class="banner"'],
)
def test_names_that_only_mention_other_parts_keep_the_article(attributes):
    junk = "<div class='site-footer'><p>All rights reserved, here, there, and everywhere, by all of us and some others.</p></div>"
    page = f"<html><body><div {attributes}>{_PROSE}</div>{'' if 'banner' in attributes else junk}</body></html>"
    assert html_text.main_text(page).count("Paragraph") == 4 and "rights" not in html_text.main_text(page)


@pytest.mark.parametrize("name", ["comments", "comment-list", "user-comments", "ad-slot", "top-ad", "cookie-notice", "related-posts", "social-links", "sidebar left", "site-footer", "newsletter-form"])
def test_named_parts_are_left_out(name):
    inner = _PROSE.replace("Paragraph", "Remark") if "comment" in name or name in ("ad-slot", "top-ad") else "<a href=x>One more story, with a title, that is linked from here</a> <a href=y>Another one</a>"
    text = html_text.main_text(f"<article><h1>T</h1>{_PROSE}<div class='{name}'>{inner}</div></article>")
    assert text.count("Paragraph") == 4 and "Remark" not in text and "story" not in text


def test_html_time_is_in_proportion():
    import time

    def spent(n):
        pages = ["<p>x " + "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<p>xx" * n, "<ul><li>a" * n + "</ul>" * n]
        start = time.perf_counter()
        for page in pages:
            html_text.main_text(page)
        return time.perf_counter() - start

    spent(500)
    assert spent(16_000) < 8 * spent(4_000)


def test_html_odd_pages(spark):
    long = "<article>" + "<p>Word, word, and a few more words for a paragraph of some length.</p>" * 5_000
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (None, None, None, "x"), (2, "u", "", None), (3, "u", "<p>a</p>" * 2, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and sorted(r.text.count("Word") for r in got) == [0, 0, 0, 5_000, 5_000]
    assert {r.page_id: r.text for r in got}[3] == "a\n\na" and html_text.extract(pages.limit(0)).count() == 0


def test_html_articles(spark):
    from html import unescape

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_raw_elements_end_where_they_do_after_letters_that_grow():
    text = "\u0130stanbul, \u0130zmir ve di\u011fer \u015fehirler. " * 6
    tail = "The text after the script is part of the page, too, and must be kept."
    page = f"<html><body><article><p>{text}</p><SCRIPT>var a = '<p>no</p>';</Script>b <p>{tail}</p></article></body></html>"
    assert html_text.main_text(page) == "\n\n".join([" ".join(text.split()), "b", tail])


def test_passages_planted(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage, rows = word(60), []
    for i in range(30):
        body, own = word(200), list(passage)
        if i % 2:
            own[20] = "edited"
        rows.append((i, " ".join(body[:90] + own + body[90:] if i % 3 == 0 else body)))
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == list(range(3, 30, 3))
    assert all(r.first_id == 0 and abs(r.start_word - 90) <= 2 and abs(r.end_word - 150) <= 2 for r in found)


@pytest.mark.parametrize("sizes", [(60, 400, 60), (200, 300, 200), (60, 90, 60, 5000, 80)])
def test_passages_far_apart_are_all_found(spark, sizes):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30_000, n)]
    same = [word(n) for n in sizes[::2]]
    texts = []
    for _ in range(2):
        text = word(30) + same[0]
        for n, own in zip(sizes[1::2], same[1:]):
            text += word(n) + own
        texts.append(text + word(30))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    begin = 30 + np.concatenate(([0], np.cumsum(sizes)[1::2]))
    want = [(1, b, b + n, 0, b, b + n, n) for b, n in zip(begin.tolist(), sizes[::2])]
    assert sorted(tuple(r) for r in found) == want


def test_passages_many_places_of_a_seed(spark):
    """Every seed of the passage stands six times in its first document before the passage does."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    noise = iter(f"n{i}" for i in range(10_000))
    first = []
    for _ in range(6):
        for at in rng.permutation(np.arange(0, 55, 5)).tolist():
            first += passage[at : at + 10] + [next(noise) for _ in range(70)]
    start = len(first)
    rows = [first + passage, [next(noise) for _ in range(100)] + passage + [next(noise) for _ in range(100)]]
    found = passages.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 100, 160, 0, start, start + 60, 60)]


def test_passages_runs_of_many_places_are_all_links():
    rng = np.random.default_rng(1)
    lines = [[f"w{rng.integers(30)}" for _ in range(rng.integers(3, 9))] for _ in range(5)]
    texts = [" ".join(w for _ in range(60) for w in lines[rng.integers(5)]) for _ in range(4)]
    row, place, seed = passages.seeds_of(pa.array(texts))
    row, place = row.astype(np.int64), place.astype(np.int32)
    for overlaid in (False, True):  # two texts under one number have two seeds at a place
        home = row <= overlaid
        both = np.intersect1d(seed[home], seed[~home])
        asked, told = ~home & np.isin(seed, both), home & np.isin(seed, both)
        links = (seed[asked], row[asked], np.zeros(asked.sum(), dtype=np.int64), place[asked])
        doc, _, x, y, end, n = passages.many_runs(links, (seed[told], np.zeros(told.sum(), dtype=np.int64), place[told]))
        want = {(d, p, q) for s, d, p in zip(seed[asked], row[asked], place[asked]) for q in place[told & (seed == s)]}
        got = [(d, p, q + p - o) for d, o, q, e in zip(doc, x, y, end) for p in place[asked & (row == d)] if o <= p <= e]
        assert set(got) == want and len(got) == n.sum()
        assert overlaid or len(x) < len(want) / 2


def test_passages_with_many_edits(spark):
    rng = np.random.default_rng(14)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30_000, n)]
    rows = []
    for t in range(60):
        own = word(50)
        edited = list(own)
        for at in np.arange(3, 49, 5) if t % 2 else rng.choice(np.arange(1, 49), 15, replace=False):
            edited[at] = f"x{t}"
        rows += [(2 * t, " ".join(word(60) + own + word(60))), (2 * t + 1, " ".join(word(40) + edited + word(70)))]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id % 2 and r.first_id == r.doc_id - 1 and r.start_word <= 45 and r.end_word >= 85 for r in found)
    assert len({r.doc_id for r in found}) >= 57


def test_passage_of_pieces_from_two_first_documents(spark):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30_000, n)]
    a, b = word(35), word(35)
    rows = [word(50) + a + word(50), word(50) + b + word(50), word(50) + a + b + word(50)]
    found = passages.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.equal_words) for r in found] == [(2, 50, 120, 70)]


def test_cut_leaves_no_passage_out():
    rng = np.random.default_rng(13)
    for _ in range(200):
        equal = rng.random(160) < rng.choice([0.05, 0.6, 0.7, 0.8, 1.0], 8).repeat(20)
        x = np.flatnonzero(equal)
        spans = [(int(x[i]), int(x[j - 1]) + 1) for i, j in passages.cut(x, x, 50, 70)]
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert all(equal[a:b].sum() * 100 >= 70 * (b - a) for a, b in spans)
        free = np.ones(160, dtype=bool)
        for a, b in spans:
            if b - a >= 50:
                free[a:b] = False
        for i in x:
            for j in x[x >= i + 49]:
                assert not free[i : j + 1].all() or equal[i : j + 1].sum() * 100 < 70 * (j + 1 - i)


def test_chain_finds_collinear_matches():
    x, y = np.array([1, 5, 9, 9, 14]), np.array([11, 15, 3, 19, 24])
    assert [c.tolist() for c in passages.chain(x, y)] == [[0, 1, 3, 4]]


def test_url_rules(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?y=1"), (2, "http://example.net"), (3, "https://b.example.com/de/1#f"), (4, None), (5, "no scheme"), (6, "x://fooexample.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "items array<string>, confidence double, support double, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, none, queries.STATED).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("example.net", "", None, "allow"),
        3: ("b.example.com", "/de/1", "example.com/de/", "block"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("fooexample.com", "/de/", None, "allow"),
    }


def test_mined_rules_match_by_brute_force(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, 1 if i % 2 else 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels)
    listed = [set(r.items) for r in rules.collect()]
    assert {"path:spam"} in listed
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: "block" if any(x <= t for x in listed) else "allow" for i, t in tokens.items()}


def test_tokens_that_always_come_together_are_mined_as_one(spark):
    """Sixteen parameters would make 65,536 combinations each with and without what all URLs share."""
    many = "&".join(f"p{i}=1" for i in range(16))
    pages = spark.createDataFrame([(i, f"http://h.org/{'x' if i % 3 else 'y'}/?{many if i % 2 else 'q=1'}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels)
    assert [r["items"] for r in rules.collect()] == [["query:p0"]]
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(200)}


def test_url_odd_tables(spark):
    rows = [(1, None, "x"), (1, "http://a.org/spam", None), (1, "http://a.org/spam", "x"), (None, "http://b.org/ok", "x"), (2, "", "x"), (3, "http://" + "c/" * 5_000, "x"), (4, "http://b.org/ok", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    labels = spark.createDataFrame([(1, 1, 1, "x"), (1, None, None, "x"), (None, 0, 1, "x"), (3, 1, 0, "x"), (4, 1, 0, "x")], "doc_id long, quality int, toxic int, host string")
    for table, marks in ((pages, labels), (pages.limit(0), labels), (pages, labels.limit(0))):
        out = url_rules.judge(table, url_rules.mine(table, marks), queries.STATED).collect()
        assert len(out) == table.count() and all(r.verdict in ("allow", "block") for r in out)
        if table is pages and marks is labels:
            assert {r.page_id: r.verdict for r in out if r.path == "/spam"} == {1: "block"} and all(r.verdict == "allow" for r in out if r.path == "/ok")
        elif marks is not labels:
            assert all(r.verdict == "allow" for r in out)


def offsets_by_rule(a, b):
    """Every offset at which two fingerprints align by the rule."""
    found = {}
    for offset in range(-len(a) + chroma.LEAST, len(b) - chroma.LEAST + 1):
        share, n = chroma.wrong_bits(a, b, offset)
        if share <= chroma.WRONG and n >= chroma.LEAST:
            found[offset] = share
    return found


def test_chroma_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.125, (12, 64))
    vectors = [(i, (base[i % 12] + rng.normal(0, 0.008, 64) * (i >= 12)).tolist()) for i in range(60)] + [(60, None), (61, [0.1])]
    media = chroma.recordings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    p = chroma.fingerprints(media)
    got = {r.rec_id: r for r in chroma.search(p, F.col("rec_id") % 20 == 0).collect()}
    assert len(got) == 62 and got[60].n_frames == got[61].n_frames == 0
    prints = {r.rec_id: np.array(r.prints, dtype=np.int32).view(np.uint32) for r in p.collect()}
    want = {(i, q) for i in range(60) for q in (0, 20, 40) if q != i and offsets_by_rule(prints[i], prints[q])}
    found = {(i, m.query_id) for i, r in got.items() for m in r.matches}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) >= 10
    assert all(r.n_links == len(r.matches) and (not r.matches or (r.best_id, r.best_wrong) == (r.matches[0].query_id, r.matches[0].wrong)) for r in got.values())


@pytest.mark.parametrize("noise,share", [(0, 1.0), (3000, 1.0), (3000, 0.7), (3500, 0.8), (4000, 0.7)])
def test_chroma_recall_at_the_limits_of_the_rule(spark, noise, share):
    """Noisy and partly overlapping copies: of the pairs that the rule accepts, nine of ten are found."""
    rng = np.random.default_rng(noise + int(10 * share))
    vectors = [(2 * i, rng.normal(0, 0.125, 64).tolist()) for i in range(40)]
    clean = chroma.recordings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    rows = []
    for r in clean:
        pcm = np.frombuffer(r.samples, dtype="<i2").astype(float)
        part = pcm[int(len(pcm) * (1 - share)) :] + rng.normal(0, noise, len(pcm) - int(len(pcm) * (1 - share)))
        rows += [(r.rec_id, bytes(r.samples)), (r.rec_id + 1, np.clip(part, -32768, 32767).astype("<i2").tobytes())]
    p = chroma.fingerprints(spark.createDataFrame(rows, "rec_id long, samples binary"))
    prints = {r.rec_id: np.array(r.prints, dtype=np.int32).view(np.uint32) for r in p.collect()}
    want = {i + 1 for i in range(0, 80, 2) if offsets_by_rule(prints[i + 1], prints[i])}
    got = chroma.search(p, F.col("rec_id") % 2 == 0).collect()
    found = {r.rec_id for r in got if r.rec_id % 2 and any(m.query_id == r.rec_id - 1 for m in r.matches)}
    assert len(found & want) >= 0.9 * len(want)


def prints_of(vectors, noise=0, share=1.0, seed=0):
    rng, out = np.random.default_rng(seed), []
    for v in vectors:
        pcm = chroma.render(v).astype(float)
        part = pcm[int(len(pcm) * (1 - share)) :]
        out.append(chroma.fingerprint(np.clip(part + rng.normal(0, noise, len(part)), -32768, 32767).astype("<i2")))
    return out


def test_chroma_looks_at_few_offsets_of_unlike_recordings(monkeypatch):
    """A query and a row that have nothing in common meet at few offsets by chance: their product grows with the square."""
    made = prints_of(np.random.default_rng(11).normal(0, 0.125, (820, 64)))
    index, looked, glance = chroma.Index([(i, i, 1) for i in range(800)], made[:800]), [], chroma.Index._glance
    monkeypatch.setattr(chroma.Index, "_glance", lambda self, own, query, offset: looked.append(len(query)) or glance(self, own, query, offset))
    for own in made[800:]:
        index.align(own)
    assert 0 < sum(looked) < 12 * 800 * 20


def test_chroma_recall_of_noisy_pieces_among_others():
    vectors = np.random.default_rng(12).normal(0, 0.125, (60, 64))
    clean, noisy = prints_of(vectors), prints_of(vectors, 4000, 0.65, seed=13)
    index = chroma.Index([(i, i, 1) for i in range(60)], clean)
    want = {(i, q): offsets_by_rule(own, clean[q]) for i, own in enumerate(noisy) for q in range(60)}
    want = {k: v for k, v in want.items() if v}
    found = {(i, q): (share, o) for i, own in enumerate(noisy) for share, q, o in index.align(own)}
    assert len(want) >= 40 and found.keys() <= want.keys() and len(found) >= 0.98 * len(want)
    assert all(share == min(want[k].values()) and want[k][o] == share for k, (share, o) in found.items())


def test_chroma_rows_of_other_lengths_and_small_steps(monkeypatch):
    rng = np.random.default_rng(14)
    vectors = [rng.normal(0, 0.125, n) for n in (3, 12, 48, 64, 64, 90)]
    made = prints_of(vectors)
    index = chroma.Index([(i, i, 1) for i in range(6)], made)
    whole = chroma.fingerprint(np.concatenate([chroma.render(v) for v in vectors]))  # longer than all queries
    rows = [whole, made[0], made[1], made[5][20:], made[0][:0]]
    got = [sorted(index.align(own)) for own in rows]
    want = [{q: found for q, p in enumerate(made) if (found := offsets_by_rule(own, p))} for own in rows]
    assert set(want[0]) == {2, 3, 4, 5} and [{q for _, q, _ in g} for g in got] == [set(w) for w in want]
    assert all(share == min(w[q].values()) for g, w in zip(got, want) for share, q, _ in g)
    monkeypatch.setattr(chroma, "CELLS", 20)  # few hits at a time
    assert [sorted(index.align(own)) for own in rows] == got
    assert chroma.Index([(0, 0, 1)], [made[0]]).align(whole) == []


def test_chroma_blocks_are_bounded_in_frames(spark, monkeypatch):
    media = chroma.recordings(spark.createDataFrame([(i, np.random.default_rng(i).normal(0, 0.125, 64).tolist()) for i in range(10)], "vec_id long, embedding array<double>"))
    p = chroma.fingerprints(media)
    monkeypatch.setattr(chroma, "FRAMES", 300)
    assert [len(block.ids) for block in chroma._blocks(p)] == [3, 3, 3, 1]
    assert chroma.search(p.unionByName(p.withColumn("rec_id", F.col("rec_id") + 10)), F.col("rec_id") < 10).where("n_links = 1").count() == 10


def test_chroma_links_all_queries_and_equal_ones_as_a_class(spark):
    rng = np.random.default_rng(5)
    vector = rng.normal(0, 0.125, 64)
    vectors = [(i, vector.tolist()) for i in (0, 20, 40, 7)] + [(60, (vector + rng.normal(0, 0.004, 64)).tolist()), (7, vector.tolist()), (None, vector.tolist())]
    table = spark.createDataFrame([(*v, 1.0) for v in vectors], "vec_id long, embedding array<double>, wrong double")
    p = chroma.fingerprints(chroma.recordings(table))
    got = {r.rec_id: r for r in chroma.search(p, F.col("rec_id") % 20 == 0).collect()}
    assert [(m.query_id, m.queries) for m in got[7].matches] == [(0, 3), (60, 1)] and got[7].n_links == 4
    assert (got[0].matches[0].query_id, got[0].matches[0].queries) == (40, 2) and (got[20].matches[0].query_id, got[20].n_links) == (0, 3)
    assert [(m.query_id, m.queries) for m in got[60].matches] == [(0, 3)]
    assert chroma.search(p.limit(0), F.col("rec_id") % 20 == 0).count() == 0 and chroma.search(p, F.lit(False)).where("n_links > 0").count() == 0


def test_mixing_reaches_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        assert r.size == len(WORD.findall(text[r.doc_id])) and r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    size = {s: sum(r.size for r in x) for s, x in by.items()}
    want, free, left = {}, {s: 1 + i % 3 for i, s in enumerate(sorted(by))}, float(total)
    while free:
        share = left / sum(free.values())
        over = [s for s, w in free.items() if share * w > 3 * size[s]]
        for s in over or list(free):
            want[s] = 3.0 * size[s] if over else share * free[s]
            if over:
                left -= want[s]
            del free[s]
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s]) and x[0].source_size == size[s]
        assert abs(sum(r.taken for r in x) - want[s]) <= 0.1 * want[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.repeat_taken(docs).count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_rows_are_split_at_the_cut(spark, parts):
    """Two sources of a thousand and of ten rows that repeat number, source and text; one of other rows."""
    rows = [(1, "one two three four five", "a")] * 500 + [(2, "x y z v w", "a")] * 500 + [(3, "p q", "b")] * 10 + [(i, "w " * (i % 7 + 1), "c") for i in range(100, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = mixing.mix(docs).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 6 and all(r.taken <= 3 * r.size for r in own)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mixing.repeat_taken(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {i: n for i in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == i))}


def test_rare_languages_are_learned(spark):
    """One language has five thousand times the rows of another."""
    rng = np.random.default_rng(3)
    name = lambda letters, k: "".join(letters[int(x)] for x in rng.integers(0, len(letters), k))
    words_of = {"aa": [name("abcdefgh", 6) for _ in range(30_000)], "zz": [name("stuvwxyz", 6) for _ in range(60)]}
    text = lambda lang, n: " ".join(words_of[lang][int(x)] for x in rng.integers(0, len(words_of[lang]), n))
    rows = [(i, text("aa", 12), "aa") for i in range(20_000)] + [(30_000 + i, text("zz", 12), "zz") for i in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert model.languages == ["aa", "zz"]
    names, _ = model.predict(pa.array([text("zz", 8), text("aa", 8), "ab", "zy xw"]))
    assert names == ["zz", "aa", "aa", "zz"]


def test_decontamination_by_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs, items).collect()}
    of = lambda t: words.split(pa.array([t])).hashes
    want, search = {}, decontaminate.Search()
    texts = [(r.doc_id, of(r.text)) for r in docs.collect()]
    for item in items.collect():
        x = of(item.text)
        for doc, text in texts:
            if len(np.intersect1d(x, text)) >= 0.6 * len(np.unique(x)):
                distance = decontaminate.nearest_stretch(x, text)[0]
                if distance <= search.edits(len(x)):
                    want[doc, item.item_id] = distance
    assert want and got == want


def test_decontamination_finds_shortened_and_short_items():
    rng = np.random.default_rng(21)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30_000, n)]
    texts, docs, want = [], [], []
    for n, left in [(8, 7), (10, 8), (10, 9), (12, 10), (18, 15), (51, 41), (51, 42), (51, 43)]:
        for before in (0, 30):
            own = word(n)
            gone = set(rng.choice(n, n - left, replace=False).tolist())
            want.append((len(docs), len(texts), n - left))
            texts.append(" ".join(own))
            docs.append(" ".join(word(before) + [x for k, x in enumerate(own) if k not in gone]))
    for n in (1, 2, 3, 4, 5, 6, 7):
        for k in range(n):
            own = word(n)
            edited = list(own)
            if n >= 5:
                edited[k : k + 1] = [["x"], [], [own[k], "x"]][k % 3]
            inserted = n >= 5 and k == n - 1 and k % 3 == 2  # after the last word: no edit
            want.append((len(docs), len(texts), 0 if n < 5 or inserted else 1))
            texts.append(" ".join(own))
            docs.append(" ".join(word(20) + edited + word(20)))
    found = decontaminate.Items(list(range(len(texts))), texts, decontaminate.Search()).find(pa.array(docs))
    assert {(r, i): d for r, i, _, _, d in found if r == i} == {(r, i): d for r, i, d in want}


def test_nearest_stretch_by_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 9))
        d, s, e = decontaminate.nearest_stretch(a, b)
        assert d == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == distance(a, b[s:e])


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.QUERIES["op10_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_odd_tables(spark, odd):
    empty = odd.limit(0)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    groups = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.groups(odd, jaccard.Rule(3, 90)).collect()}
    assert groups[2, 14] == 1 and groups[3, 0] == 3
    kept = [r.doc_id for r in jaccard.keep_one(odd).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 3, 4, 5, None, 6, 7, 8]))
    assert {r.doc_id for r in decontaminate.matches(odd, items).collect()} == {1, 2, None}
    clean = decontaminate.drop_matching(odd, items)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 7, 8}
    assert pii.redact(odd, pii.train(odd)).columns == odd.columns
    mixed = mixing.repeat_taken(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    model = langid.learn(odd)
    assert {r.doc_id for r in langid.predict(odd, model).collect() if r.lang_pred == "und"} == {3, 4, 5, 8}
    passages.repeats(odd).collect()
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, labels)).count() == odd.count()
    for table in (empty,):
        assert jaccard.groups(table).count() == jaccard.keep_one(table).count() == passages.repeats(table).count() == 0
        assert pii.find(table, pii.train(table)).count() == mixing.mix(table).count() == 0
        assert decontaminate.matches(table, items).count() == langid.predict(table, langid.learn(table)).count() == 0
        assert decontaminate.matches(odd, items.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES[:1]}
    assert kept["language"].count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and out.count() > 0


def test_stages_keep_what_brute_force_keeps(spark, docs):
    """Each stage on the whole table: its decisions row by row."""
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, docs, SF).collect()
    # language: all labelled held-out rows of a known language stay, texts without a letter go
    kept = {r.doc_id for r in run("language")}
    assert kept == {r.doc_id for r in rows if r.text and re.search(r"[^\W\d_]", r.text)}
    # near duplicates: the smallest number of each group
    sets = {}
    for r in rows:
        w = WORD.findall(folded(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids, least = sorted(sets), {i: i for i in sets}
    links = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if (both := len(sets[i] & sets[j])) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    for _ in ids:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert sorted(r.doc_id for r in run("near_duplicates")) == [i for i in ids if least[i] == i]
    # decontamination: documents with a whole item go, those without any word of an item stay
    items = [tuple(WORD.findall(folded(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held, words_of_items = set(), {w for item in items for w in item}
    for r in rows:
        w = tuple(WORD.findall(folded(r.text)))
        if any(w[i : i + len(item)] == item for item in items for i in range(len(w) - len(item) + 1)):
            held.add(r.doc_id)
    kept = {r.doc_id for r in run("decontamination")}
    assert not kept & held and kept >= {r.doc_id for r in rows if not words_of_items & set(WORD.findall(folded(r.text)))}
    # personal data: every document stays, without any address, card or number of the base patterns
    clean = {r.doc_id: r.text for r in run("personal_data")}
    assert clean.keys() == {r.doc_id for r in rows} and not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t or "") for t in clean.values())
    # mixing: as often as the mix says
    counts = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    found = {}
    for r in run("mixing"):
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == counts


def test_nothing_else_imports_the_folder():
    here = Path(__file__).resolve().parents[2]
    for path in (here / "lapwing").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lapwing.llm" not in path.read_text()
