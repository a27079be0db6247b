"""One registered query for each operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import (
    chroma,
    decontaminate,
    hard_negatives,
    html_text,
    jaccard,
    langid,
    mixing,
    passages,
    pii,
    quality,
    ranked_search,
    toxicity,
    url_rules,
)
from lapwing.llm.scratch import Scratch, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Stated rules for hosts and paths.
STATED = (
    url_rules.Rule("net", "/", "block"),
    url_rules.Rule("example.net", "/en/", "allow"),
    url_rules.Rule("example.com", "/de/", "block"),
    url_rules.Rule("org", "/fr/", "allow"),
)
_WORD = r"[^\x20\x09-\x0D]+"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def written(c):
        return F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))

    def counted(number: int):
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == number))).cast("long")

    base = F.array_join(F.transform(F.filter("spans", lambda c: c["base"]), written), ",")
    return found.select(
        "doc_id",
        *[counted(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(_part(5) != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, learned))
    return scored.select("doc_id", (_part(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), jaccard.Rule(width=3, percent=90))


ORACLE_SQL["op3_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.m AS component_id
FROM n JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) c USING (doc_id)
"""


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_rules.mine(pages, table(spark, sf_dir, "labels"))
    return url_rules.judge(pages, rules, STATED)


@query
def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = chroma.recordings(table(spark, sf_dir, "embeddings"))
    prints = Scratch(spark, "chroma").keep(chroma.fingerprints(media))
    return chroma.search(prints, F.col("rec_id") % 20 == 0)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(_part(3) != 1))
    return langid.predict(docs, model).withColumn("held_out", _part(3) == 1)


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(_part(3) != 1)
    scored = quality.score(docs, quality.learn(docs, learned))
    return scored.select("doc_id", (_part(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL["op12_ranked_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS t
  FROM documents),
q AS (
  SELECT item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
n AS (SELECT place, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
scored AS (
  SELECT a.item_id, n.doc_id, n.place,
    sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * whole.docs) // whole.terms))))::BIGINT AS score
  FROM asked a JOIN tf USING (term) JOIN w USING (term) JOIN n USING (place), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.candidates(
        table(spark, sf_dir, "embeddings"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")),
    )
    return hard_negatives.mine(spark, rows, rows.where("vec_id % 100 = 0"), hard_negatives.Window(positives=5, negatives=10, low=30, high=90))


ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
