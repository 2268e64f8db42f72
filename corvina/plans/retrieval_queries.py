"""Vector, n-gram and lexical retrieval over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.functions import vectors as V
from corvina.operators import retrieval as R
from corvina.plans.views import ENTRIES_SQL, entries
from corvina.registry import register
from corvina.session import cut_lineage, table

#: The vectors are nearly independent: a threshold of 0.2 fills the result lists.
THRESHOLD = 0.2
#: The stated queries: rows whose id is divisible by it, against all rows.
EVERY = 50

_SCORES = f"""v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT q.id AS qid, v.id, v.label, list_cosine_similarity(v.e, q.e) AS sim FROM v, v AS q WHERE q.id % {EVERY} = 0 AND list_cosine_similarity(v.e, q.e) >= {THRESHOLD})"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def _queries(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "embedding")


def _scored(spark: SparkSession, d: str, most: int | None, keep=None, slack: float = 0.0) -> DataFrame:
    v = _vectors(spark, d)
    return R.vector_scores(v if keep is None else v.where(keep), _queries(v), THRESHOLD, most, slack)


def _top(rows: str, k: int, score: str = "sim") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, id) AS rn FROM {rows} QUALIFY rn <= {k}"


@register("j01_vector_topk", f"WITH {_SCORES}, t AS ({_top('scored', 10)}) SELECT qid, id, label, CAST(rn AS INT) AS rn FROM t")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(_scored(spark, d, 10), 10, ["qid"]).select("qid", "id", "label", "rn")


@register("j02_single_vector", f"WITH {_SCORES}, t AS ({_top('scored', 20)}) SELECT id, label FROM t WHERE qid = 0")
def single_vector(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    scored = R.vector_scores(v, v.where("id = 0").select(F.col("id").alias("qid"), "embedding"), THRESHOLD, 20)
    return scored.orderBy(F.desc("sim"), "id").limit(20).select("id", "label")


@register("o09_filtered", f"WITH {_SCORES}, c AS ({_top('scored', 25)}), t AS ({_top('(SELECT qid, id, label, sim FROM c WHERE label IN (1, 3, 5))', 5)}) SELECT qid, id, CAST(rn AS INT) AS rn FROM t")
def filtered(spark: SparkSession, d: str) -> DataFrame:
    return R.filtered(_scored(spark, d, 25), F.col("label").isin(1, 3, 5), 5).select("qid", "id", "rn")


@register("f09_prefiltered", f"WITH {_SCORES}, t AS ({_top('(SELECT * FROM scored WHERE label IN (1, 3, 5))', 5)}) SELECT qid, id, CAST(rn AS INT) AS rn FROM t")
def prefiltered(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(_scored(spark, d, 5, F.col("label").isin(1, 3, 5)), 5, ["qid"]).select("qid", "id", "rn")


@register("o06_boosted", f"""WITH {_SCORES}, c AS ({_top('scored', 20)}), b AS (SELECT qid, id, sim * (CASE WHEN id % 400 < 30 THEN CAST(1.1 AS DOUBLE) ELSE 1 END) * (CASE WHEN label > 5 THEN CAST(1.05 AS DOUBLE) ELSE 1 END) AS boosted FROM c),
t AS ({_top('b', 10, 'boosted')}) SELECT qid, id, CAST(rn AS INT) AS rn FROM t""")
def boosted(spark: SparkSession, d: str) -> DataFrame:
    return R.boosted(_scored(spark, d, 20), F.col("id") % 400 < 30, F.col("label") > 5, 10).select("qid", "id", "rn")


@register("o07_relevance", f"""WITH {_SCORES}, s AS (SELECT qid, id, CAST(0.7 AS DOUBLE) * sim + CAST(0.2 AS DOUBLE) * (label / CAST(10 AS DOUBLE)) + CAST(0.1 AS DOUBLE) * (CASE WHEN id % 400 <= 30 THEN 1 WHEN id % 400 <= 90 THEN CAST(0.8 AS DOUBLE) WHEN id % 400 <= 180 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END) AS relevance FROM scored),
t AS ({_top('s', 10, 'relevance')}) SELECT qid, id, CAST(rn AS INT) AS rn FROM t""")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    # what isn't similarity makes up 0.3 of a relevance of which similarity makes up 0.7
    scored = _scored(spark, d, 10, slack=0.3 / 0.7 + 1e-9).withColumn("relevance", R.relevance(F.col("sim"), F.col("label") / 10.0, F.col("id") % 400))
    return R.top_k(scored, 10, ["qid"], "relevance").select("qid", "id", "rn")


@register("j17_diverse")
def diverse(spark: SparkSession, d: str) -> DataFrame:
    near = R.top_k(_scored(spark, d, 50), 50, ["qid"]).select("qid", "id", "sim")
    return R.diverse(near.join(_vectors(spark, d).select("id", "embedding"), "id"), 0.3, 5).select("qid", "id", "rn")


@register("a38_norms", "SELECT label, count(*) AS n, count(*) FILTER (abs(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) - 1) < 1e-3) AS n_unit FROM embeddings GROUP BY label")
def norms(spark: SparkSession, d: str) -> DataFrame:
    length = V.norm(V.doubles(F.col("embedding")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.abs(length - 1) < 1e-3, 1)).alias("n_unit"))


_W = r"\p{L}\p{N}\p{M}_"
_GRAMS = r"""list_distinct(list_concat(list_concat(list_transform(w, lambda x: '{' || x || '}'), list_transform(range(1, len(w)), lambda i: '{' || w[i] || ',' || w[i + 1] || '}')), list_transform(range(1, len(w) - 1), lambda i: '{' || w[i] || ',' || w[i + 1] || ',' || w[i + 2] || '}')))"""
_WORDS = rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^{_W}\s]', '', 'g'), '\s+'), lambda x: x <> '')"
_MATCHES = f"""q0 AS (SELECT item_id AS qid, {_WORDS} AS w FROM benchmark), q1 AS (SELECT qid, {_GRAMS} AS grams FROM q0), q AS (SELECT qid, len(grams) AS n_query, unnest(grams) AS gram FROM q1),
d0 AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), d AS (SELECT id, unnest({_GRAMS}) AS gram FROM d0),
matches AS (SELECT qid, id, count(*) AS shared, max(n_query) AS n_query FROM q JOIN d USING (gram) GROUP BY qid, id)"""


def _matches(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return R.ngram_matches(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), queries, threshold)


@register("j03_ngram_search", f"WITH {_MATCHES} SELECT qid, id, shared, n_query FROM matches WHERE shared / CAST(n_query AS DOUBLE) >= 0.9")
def ngram_search(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.9).select("qid", "id", "shared", F.col("n_query").cast("long").alias("n_query"))


@register("q01_cascade", f"""WITH {_MATCHES}, {_SCORES}, s1 AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared / CAST(n_query AS DOUBLE) DESC, id) AS rn FROM matches WHERE shared / CAST(n_query AS DOUBLE) >= 0.9) WHERE rn <= 3),
s2 AS (SELECT qid, id FROM ({_top('(SELECT * FROM scored WHERE label = 2)', 5)})), s3 AS (SELECT qid, id FROM ({_top('scored', 5)})),
u AS (SELECT qid, id, 1 AS stage FROM s1 UNION ALL SELECT qid, id, 2 FROM s2 UNION ALL SELECT qid, id, 3 FROM s3) SELECT qid, id, stage FROM u QUALIFY stage = min(stage) OVER (PARTITION BY qid)""")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """Each stage is asked only what the ones before it have left without an answer."""
    v = _vectors(spark, d)
    exact = cut_lineage(R.top_k(_matches(spark, d, 0.9).withColumnRenamed("share", "sim"), 3, ["qid"]))
    rest = _queries(v).join(exact.select("qid").distinct(), "qid", "left_anti")
    labelled = cut_lineage(R.top_k(R.vector_scores(v.where("label = 2"), rest, THRESHOLD, 5), 5, ["qid"]))
    rest = rest.join(labelled.select("qid").distinct(), "qid", "left_anti")
    return R.cascade([exact, labelled, R.top_k(R.vector_scores(v, rest, THRESHOLD, 5), 5, ["qid"])]).select("qid", "id", "stage")


@register("j04_lexical")
def lexical(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d).withColumn("keywords", F.array_join(T.entry_keywords(F.col("question")), " "))
    queries = rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("question").alias("text"))
    return R.top_k(R.lexical_scores(rows, queries, most=5), 5, ["qid"]).select("qid", "id", "rn")


@register("j16_overlap", f"""WITH {_SCORES}, t AS ({_top('scored', 5)}), w AS (SELECT qid, id, list_distinct(list_transform(string_split_regex(trim(lower(text)), '\\s+'), lambda x: x)) AS words FROM t JOIN documents ON doc_id = id),
p AS (SELECT a.qid, len(list_intersect(a.words, b.words)) / CAST(len(list_distinct(list_concat(a.words, b.words))) AS DOUBLE) AS j FROM w a JOIN w b ON a.qid = b.qid AND a.id < b.id)
SELECT qid, count(*) AS n_pairs, CASE WHEN avg(j) > 0.7 THEN 'high' WHEN avg(j) > 0.4 THEN 'medium' ELSE 'low' END AS overlap FROM p GROUP BY qid""")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(T.words(F.lower("text")))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("words"))
    near = R.top_k(_scored(spark, d, 5), 5, ["qid"]).select("qid", "id").join(texts, "id")
    return R.overlap_class(near).select("qid", "n_pairs", "overlap")


@register("q03_answers", f"WITH {_SCORES}, t AS ({_top('scored', 3)}) SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS answer, CASE WHEN count(*) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM t JOIN documents ON doc_id = id GROUP BY qid")
def answers(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    near = R.top_k(_scored(spark, d, 3), 3, ["qid"]).join(texts, "id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "answer"))), lambda x: x["answer"]), "\n\n")
    return near.groupBy("qid").agg(joined.alias("answer"), F.lit(1.0).alias("confidence"))
