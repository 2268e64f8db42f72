"""Entities, forms, answers, alerts, lookups, rankings and documents of other formats over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import answers as N
from corvina.functions import lexicons as L
from corvina.functions import text as T
from corvina.functions import vectors as V
from corvina.operators import analytics, extraction, retrieval
from corvina.plans.analytics_queries import _ALERTS, _HALVES, _alerts
from corvina.plans.retrieval_queries import _SCORES, _scored, _top
from corvina.plans.text_queries import _LINES, _W
from corvina.plans.views import AS_OF, ENTRIES_SQL, FEEDBACK_SQL, LOG_SQL, entries, feedback, matcher_keywords_sql, query_log, quoted, rewritten_sql, stem_sql
from corvina.registry import register
from corvina.session import scratch_folder, table
from corvina.sources import docx, store


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# --- texts ---

_ENTITY_COUNTS = ", ".join("len(list_distinct(list_concat(" + ", ".join([f"regexp_extract_all(text, '(?i){p}')" for p in patterns] + ["[]::VARCHAR[]"]) + f"))) AS n_{kind}" for kind, patterns in L.ENTITIES.items())


@register("t24_all_entities", f"SELECT doc_id, {_ENTITY_COUNTS} FROM documents")
def all_entities(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", N.entities(F.col("text")).alias("e"))
    return found.select("doc_id", *[F.size(F.col("e")[kind]).cast("long").alias(f"n_{kind}") for kind in L.ENTITIES])


@register("t02_squeezed", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def squeezed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.squeeze(F.col("text")).cast("binary")).alias("digest"))


@register("t04_questions", rf"""WITH l AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, contains(text, '?') OR coalesce(w[1] IN ({quoted(L.QUESTION_STARTERS)}), false) AS asked FROM l""")
def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.looks_asked(F.col("text")).alias("asked"))


_BOTH_WORDS = rf"""{ENTRIES_SQL}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(question), '[{_W}]+')) AS q, list_distinct(regexp_extract_all(lower(answer), '[{_W}]+')) AS a FROM entries)"""


def _both_words(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", F.array_distinct(T.tokens(F.col("question"))).alias("q"), F.array_distinct(T.tokens(F.col("answer"))).alias("a"))


@register("t07_containment", f"WITH {_BOTH_WORDS} SELECT id, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / CAST(len(q) AS DOUBLE) END AS share FROM w")
def containment(spark: SparkSession, d: str) -> DataFrame:
    return _both_words(spark, d).select("id", T.containment(F.col("q"), F.col("a")).alias("share"))


@register("u02_word_sets", f"WITH {_BOTH_WORDS} SELECT id, len(list_distinct(list_concat(q, a))) AS n_union, len(list_intersect(q, a)) AS n_both, CASE WHEN len(q) + len(a) = 0 THEN 0 ELSE len(list_intersect(q, a)) / CAST(len(list_distinct(list_concat(q, a))) AS DOUBLE) END AS jaccard FROM w")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    q, a = F.col("q"), F.col("a")
    return _both_words(spark, d).select("id", F.size(F.array_union(q, a)).cast("long").alias("n_union"), F.size(F.array_intersect(q, a)).cast("long").alias("n_both"), T.jaccard(q, a).alias("jaccard"))


@register("u07_common_keywords", rf"""WITH {ENTRIES_SQL}, k AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(question), '[{_W}]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(L.QUERY_STOP)}))) AS q, list_distinct(list_filter(regexp_extract_all(lower(answer), '[{_W}]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(L.QUERY_STOP)}))) AS a FROM entries)
SELECT id, array_to_string(list_sort(list_intersect(q, a)), ',') AS common FROM k""")
def common_keywords(spark: SparkSession, d: str) -> DataFrame:
    common = F.array_intersect(T.query_keywords(F.col("question")), T.query_keywords(F.col("answer")))
    return entries(spark, d).select("id", F.array_join(F.array_sort(common), ",").alias("common"))


@register("t09_stems", rf"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{_W}]+')) AS word FROM documents) SELECT word, {stem_sql('word')} AS stem FROM w")
def stems(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@register("t10_matcher_keywords", f"SELECT conv_id, turn, array_to_string(list_sort({matcher_keywords_sql('text')}), ' ') AS keywords FROM conversations")
def matcher_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.matcher_keywords(F.col("text"))), " ").alias("keywords"))


@register("t14_plain_grammar", f"""WITH g AS (SELECT conv_id, turn, {rewritten_sql('trim(text)', L.PLAIN_GRAMMAR)} AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[.?!]$') THEN t WHEN {' OR '.join(f"contains(lower(t), '{w}')" for w in L.ASKING_ANYWHERE)} THEN t || '?' ELSE t || '.' END AS formal FROM g""")
def plain_grammar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", N.plain_grammar(F.col("text")).alias("formal"))


@register("t22_question_type", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{name}'" for name, p in L.QUESTION_TYPES.items()) + " END AS kind FROM conversations")
def question_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_type(F.col("text")).alias("kind"))


def _hits_sql(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words)


def _class_sql(table_: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in known) + f" THEN '{name}'" for name, known in table_.items()) + f" ELSE '{default}' END"


_LOW = f"{FEEDBACK_SQL}, c AS (SELECT *, lower(comment) AS low FROM feedback)"


@register("t41_sentiment", f"WITH {_LOW} SELECT query_id, CASE WHEN {_hits_sql(L.POSITIVE)} > {_hits_sql(L.NEGATIVE)} THEN 'positive' WHEN {_hits_sql(L.NEGATIVE)} > {_hits_sql(L.POSITIVE)} THEN 'negative' ELSE 'neutral' END AS sentiment FROM c")
def sentiments(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).select("query_id", T.sentiment(F.col("comment")).alias("sentiment"))


@register("t42_feedback_category", f"WITH {_LOW} SELECT query_id, CASE WHEN rating >= 4 THEN {_class_sql(L.PRAISE, 'general_satisfaction')} WHEN rating <= 2 THEN {_class_sql(L.COMPLAINTS, 'general_dissatisfaction')} ELSE 'neutral_feedback' END AS label FROM c")
def feedback_categories(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).select("query_id", T.feedback_category(F.col("rating"), F.col("comment")).alias("label"))


# --- forms and answers ---


@register("f21_form_errors", f"""WITH {ENTRIES_SQL}, e AS (SELECT id, list_filter([CASE WHEN length(trim(question)) = 0 THEN 'question_empty' WHEN length(trim(question)) < {N.QUESTION_LENGTH} THEN 'question_short' END,
  CASE WHEN length(trim(answer)) = 0 THEN 'answer_empty' WHEN length(trim(answer)) < {N.ANSWER_LENGTH} THEN 'answer_short' END,
  CASE WHEN len(list_filter(string_split(answer, ','), lambda k: trim(k, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> '')) > {N.KEYWORDS} THEN 'keywords_many' END], lambda x: x IS NOT NULL) AS e FROM entries) SELECT id, array_to_string(e, ',') AS errors FROM e""")
def form_errors(spark: SparkSession, d: str) -> DataFrame:
    # the answer's commas stand in for a field of keywords
    return entries(spark, d).select("id", F.array_join(N.form_errors(F.col("question"), F.col("answer"), F.col("answer")), ",").alias("errors"))


@register("f23_keyword_list", f"WITH {ENTRIES_SQL}, k AS (SELECT id, list_filter(list_transform(string_split(answer, ','), lambda k: trim(k, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda k: k <> '') AS k FROM entries) SELECT id, len(k) AS n_keywords, md5(array_to_string(k, '|')) AS digest FROM k")
def keyword_list(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", N.keyword_list(F.col("answer")).alias("k")).select("id", F.size("k").cast("long").alias("n_keywords"), F.md5(F.array_join("k", "|").cast("binary")).alias("digest"))


@register("t46_response_type", f"WITH {LOG_SQL} SELECT query_id, CASE WHEN k > 5 AND cents >= 35000 THEN 'semantic_match' WHEN k > 5 AND cents >= 15000 THEN 'partial_match' ELSE 'fallback' END AS response_type FROM log")
def response_types(spark: SparkSession, d: str) -> DataFrame:
    log = query_log(spark, d)
    # whole numbers decide alike in any engine: 0.7 and 0.3 of 50,000 units
    confidence = F.when(F.col("cents") >= 35000, 0.7).when(F.col("cents") >= 15000, 0.3).otherwise(0.0)
    return log.select("query_id", N.response_type(confidence, F.greatest(F.col("k") - 5, F.lit(0))).alias("response_type"))


@register("f12_confident", f"WITH {ENTRIES_SQL} SELECT id FROM entries WHERE confidence >= 0.75")
def confident(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(F.col("confidence") >= 0.75).select("id")


@register("f11_similar_enough", f"WITH {_SCORES} SELECT qid, id FROM scored WHERE sim >= 0.3")
def similar_enough(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, None).where("sim >= 0.3").select("qid", "id")


@register("w01_ranks", f"WITH {_SCORES}, t AS ({_top('scored', 5)}) SELECT qid, id, CAST(rn AS INT) AS rn FROM t")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_scored(spark, d, 5), 5, ["qid"]).select("qid", "id", "rn")


@register("m02_unit_vectors", "SELECT vec_id, abs(sqrt(list_sum(list_transform(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))), lambda x: x * x))) - 1) < 1e-9 AS is_unit FROM embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    length = V.norm(V.unit(V.doubles(F.col("embedding"))))
    return table(spark, d, "embeddings").select("vec_id", (F.abs(length - 1) < 1e-9).alias("is_unit"))


# --- users' first and last rows, latest rows, orders ---

_ENDS = f"{FEEDBACK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, query_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query_id DESC) AS down FROM feedback)"


@register("w02_first_last", f"WITH {_ENDS} SELECT user_id, max(rating) FILTER (up = 1) AS first_rating, max(rating) FILTER (down = 1) AS last_rating FROM r GROUP BY user_id")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    ends = analytics.first_last(feedback(spark, d), ["user_id"], ["ts", "query_id"], "rating", 1)
    return ends.select("user_id", F.col("first")[0].alias("first_rating"), F.col("last")[0].alias("last_rating"))


@register("w03_first_last_three", f"WITH {_ENDS} SELECT user_id, array_to_string(list(rating ORDER BY up) FILTER (up <= 3), ',') AS first_three, array_to_string(list(rating ORDER BY down DESC) FILTER (down <= 3), ',') AS last_three FROM r GROUP BY user_id")
def first_last_three(spark: SparkSession, d: str) -> DataFrame:
    ends = analytics.first_last(feedback(spark, d), ["user_id"], ["ts", "query_id"], "rating", 3)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(f"{c}_three")
    return ends.select("user_id", text("first"), text("last"))


@register("w08_latest", f"WITH {LOG_SQL} SELECT intent, arg_max(query_id, (ts, query_id)) AS query_id FROM log GROUP BY intent")
def latest(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).groupBy("intent").agg(F.max_by("query_id", F.struct("ts", "query_id")).alias("query_id"))


@register("w09_last_fifty", f"WITH {LOG_SQL} SELECT intent, query_id FROM log QUALIFY row_number() OVER (PARTITION BY intent ORDER BY ts DESC, query_id DESC) <= 50")
def last_fifty(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(query_log(spark, d), ["intent"], [F.desc("ts"), F.desc("query_id")], 50).select("intent", "query_id")


@register("o03_two_keys", f"WITH {LOG_SQL}, u AS (SELECT user_id, max(ts) AS last_at, min(ts) AS first_at FROM log GROUP BY user_id) SELECT user_id, CAST(row_number() OVER (ORDER BY last_at DESC, first_at DESC, user_id) AS INT) AS place FROM u ORDER BY last_at DESC, first_at DESC, user_id LIMIT 100")
def two_keys(spark: SparkSession, d: str) -> DataFrame:
    users = query_log(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_at"), F.min("ts").alias("first_at"))
    page = users.orderBy(F.desc("last_at"), F.desc("first_at"), "user_id").limit(100)
    # numbered behind the limit: no more rows than a page
    return page.select("user_id", F.row_number().over(Window.orderBy(F.desc("last_at"), F.desc("first_at"), "user_id")).alias("place"))


@register("o04_most_common", f"WITH {LOG_SQL} SELECT user_id, count(*) AS n FROM log GROUP BY user_id ORDER BY n DESC, min(query_id) LIMIT 10")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    counts = query_log(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.min("query_id").alias("first_id"))
    return counts.orderBy(F.desc("n"), "first_id").limit(10).select("user_id", "n")


# --- alerts, ages, lookups ---


@register("f16_recent_alerts", f"WITH {LOG_SQL}, {_ALERTS} SELECT query_id, component, metric, severity FROM alerts WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30'")
def recent_alerts(spark: SparkSession, d: str) -> DataFrame:
    to = F.lit("2024-01-30").cast("timestamp")
    return _alerts(spark, d).where((F.col("ts") >= to - F.expr("interval 24 hours")) & (F.col("ts") <= to)).select("query_id", "component", "metric", "severity")


@register("f16_severities", f"WITH {LOG_SQL}, {_ALERTS} SELECT component, severity, count(*) AS n FROM alerts GROUP BY ALL")
def severities(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).groupBy("component", "severity").agg(F.count("*").alias("n"))


@register("d01_recency", f"WITH {ENTRIES_SQL} SELECT id, date_diff('day', updated_on, DATE '{AS_OF[:10]}') AS age_days, CASE WHEN date_diff('day', updated_on, DATE '{AS_OF[:10]}') <= 30 THEN 10 WHEN date_diff('day', updated_on, DATE '{AS_OF[:10]}') <= 90 THEN 8 WHEN date_diff('day', updated_on, DATE '{AS_OF[:10]}') <= 180 THEN 6 ELSE 4 END AS tenths FROM entries")
def recency(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit(AS_OF[:10]).cast("date"), "updated_on").cast("long")
    return entries(spark, d).select("id", age.alias("age_days")).select("*", F.when(F.col("age_days") <= 30, 10).when(F.col("age_days") <= 90, 8).when(F.col("age_days") <= 180, 6).otherwise(4).alias("tenths"))


@register("d02_periods", f"WITH {LOG_SQL} SELECT intent, " + ", ".join(f"count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL {n} {unit} AND ts <= TIMESTAMP '2024-01-30') AS {name}" for name, n, unit in [("last_quarter_hour", 15, "MINUTE"), ("last_hour", 1, "HOUR"), ("last_day", 1, "DAY"), ("last_week", 7, "DAY"), ("last_month", 30, "DAY")]) + " FROM log GROUP BY intent")
def periods(spark: SparkSession, d: str) -> DataFrame:
    to = F.lit("2024-01-30").cast("timestamp")
    since = lambda span, name: F.count(F.when((F.col("ts") >= to - F.expr(f"interval {span}")) & (F.col("ts") <= to), 1)).alias(name)
    return query_log(spark, d).groupBy("intent").agg(since("15 minutes", "last_quarter_hour"), since("1 hour", "last_hour"), since("1 day", "last_day"), since("7 days", "last_week"), since("30 days", "last_month"))


@register("d03_hours", f"WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM log GROUP BY ALL")
def hours(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@register("d05_iso", f"WITH {LOG_SQL} SELECT query_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS written FROM log")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """Written and read again: rows whose time doesn't come back in whole seconds would be missing."""
    rows = query_log(spark, d).withColumn("written", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.where(F.to_timestamp("written") == F.date_trunc("second", "ts")).select("query_id", "written")


@register("src20_lookups", f"WITH {ENTRIES_SQL} SELECT e.id, category FROM entries e JOIN labels l ON e.id = l.doc_id WHERE quality = 1")
def lookups(spark: SparkSession, d: str) -> DataFrame:
    """Entries by a list of ids that comes as a table."""
    wanted = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return entries(spark, d).join(wanted, "id", "left_semi").select("id", "category")


@register("sink04_test_results", f"WITH {LOG_SQL} SELECT 'speed' AS test_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM log GROUP BY ALL")
def test_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of a test's arms, written in two appends and read back by arm."""
    path = scratch_folder(spark, "tests")
    rows = query_log(spark, d).select(F.lit("speed").alias("test_id"), F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("arm"), "user_id", "ts", "k", "query_id")
    for rest in (0, 1):
        rows.where(F.col("query_id") % 2 == rest).write.mode("append").partitionBy("test_id", "arm").parquet(path)
    return spark.read.parquet(path).groupBy("test_id", "arm").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# --- documents of another format ---


@register("src02_docx", f"WITH {_LINES} SELECT doc_id, CAST(idx AS INT) AS idx, text FROM lines")
def docx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Word files, made and unpacked in tasks: their paragraphs are the documents' lines."""
    made = docx.packed(_docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text"), "path", "text")
    found = docx.read(made).where("kind = 'paragraph'")
    return found.select(F.regexp_extract("path", r"^(\d+)\.docx$", 1).cast("long").alias("doc_id"), "idx", "text")


@register("src01_judged_files", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'extension' WHEN text = '' THEN 'empty' ELSE '' END AS errors FROM documents")
def judged_files(spark: SparkSession, d: str) -> DataFrame:
    """Names and sizes as a directory scan gives them: every fifth file has another extension."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".DOCX"))
    rows = _docs(spark, d).select("doc_id", name.alias("path"), F.octet_length("text").cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    return docx.judged(rows).select(F.regexp_extract("path", r"^(\d+)\.", 1).cast("long").alias("doc_id"), F.array_join("errors", ",").alias("errors"))


# --- windows over keys, histories, exports ---


@register("w04_halves", f"WITH {LOG_SQL}, " + _HALVES.format(by="intent", rows="log", v="k", least=10, step=1))
def halves(spark: SparkSession, d: str) -> DataFrame:
    return analytics.half_split(query_log(spark, d), ["intent"], ["ts", "query_id"], "k", 1, 10, analytics.BUCKET)


@register("w05_ends", f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY ts, query_id) AS rn, count(*) OVER (PARTITION BY intent) AS n FROM log)
SELECT intent, max(n) AS n, sum(k) FILTER (rn <= least(5, n // 3)) / CAST(nullif(count(*) FILTER (rn <= least(5, n // 3)), 0) AS DOUBLE) AS head_mean,
  sum(k) FILTER (rn > n - least(5, n // 3)) / CAST(nullif(count(*) FILTER (rn > n - least(5, n // 3)), 0) AS DOUBLE) AS tail_mean FROM r GROUP BY intent""")
def ends(spark: SparkSession, d: str) -> DataFrame:
    return analytics.head_tail(query_log(spark, d), ["intent"], ["ts", "query_id"], "k")


@register("w10_prefix_sums", f"WITH {_LINES} SELECT doc_id, CAST(idx AS INT) AS idx, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM lines")
def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return extraction.paragraphs(_docs(spark, d)).select("doc_id", "idx", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("chars_before"))


@register("w11_next_rows", f"WITH {_LINES}, n AS (SELECT doc_id, idx, lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS following FROM lines) SELECT doc_id, CAST(idx AS INT) AS idx, md5(following) AS digest FROM n WHERE following IS NOT NULL")
def next_rows(spark: SparkSession, d: str) -> DataFrame:
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    rows = extraction.paragraphs(_docs(spark, d)).withColumn("following", following)
    return rows.where("following is not null").select("doc_id", "idx", F.md5(F.col("following").cast("binary")).alias("digest"))


@register("w13_last_values", f"WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query_id DESC) AS rn FROM log) SELECT user_id, array_to_string(list(k ORDER BY rn DESC), ',') AS last_values FROM r WHERE rn <= 10 GROUP BY user_id")
def last_values(spark: SparkSession, d: str) -> DataFrame:
    found = analytics.first_last(query_log(spark, d), ["user_id"], ["ts", "query_id"], "k", 10)
    return found.select("user_id", F.array_join(F.col("last").cast("array<string>"), ",").alias("last_values"))


@register("w14_newest_ten", f"WITH {LOG_SQL} SELECT user_id, query_id FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query_id DESC) <= 10")
def newest_ten(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(query_log(spark, d), ["user_id"], [F.desc("ts"), F.desc("query_id")], 10).select("user_id", "query_id")


@register("o02_reversed_ties", f"WITH {ENTRIES_SQL}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, id DESC) AS rn FROM entries) SELECT category, id, CAST(rn AS INT) AS rn FROM r WHERE rn <= 5")
def reversed_ties(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("confidence"), F.desc("id")))
    return entries(spark, d).select("category", "id", place.alias("rn")).where("rn <= 5")


@register("o05_most_confident", f"WITH {ENTRIES_SQL} SELECT id FROM entries ORDER BY confidence DESC, id LIMIT 50")
def most_confident(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).orderBy(F.desc("confidence"), "id").limit(50).select("id")


@register("f07_between", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' GROUP BY o_orderpriority")
def between(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, d, "orders").where(day.between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-12-31").cast("timestamp")))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@register("d04_delays", "SELECT o_orderkey, CAST(epoch(max(l_shipdate)) - epoch(max(o_orderdate)) AS BIGINT) AS seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def delays(spark: SparkSession, d: str) -> DataFrame:
    """How long an order waits for its last shipment."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    return table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", (second("shipped") - second("o_orderdate")).alias("seconds"))


@register("r01_arrays", rf"WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[{_W}]+')) AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(w)[1:5], '|') AS first_five, list_has_any(w, ['help', 'the', 'und']) AS has_any, list_sort(w)[1] AS first_word FROM w")
def arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sort_array(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    return rows.select("conv_id", "turn", F.array_join(F.slice("w", 1, 5), "|").alias("first_five"), F.arrays_overlap("w", F.array(F.lit("help"), F.lit("the"), F.lit("und"))).alias("has_any"), F.get("w", F.lit(0)).alias("first_word"))


@register("r02_counters", rf"WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[{_W}]+')) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT conv_id, count(*) AS n_words, max(n) AS most, min(word) FILTER (n = m) AS word FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS m FROM c) GROUP BY conv_id")
def counters(spark: SparkSession, d: str) -> DataFrame:
    """A counter of words for each conversation: its size, its largest item and that item's word."""
    words = table(spark, d, "conversations").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("conv_id", "word").agg(F.count("*").alias("n"))
    return counts.groupBy("conv_id").agg(F.count("*").alias("n_words"), F.max("n").alias("most"), F.min_by("word", F.struct(-F.col("n"), "word")).alias("word"))


@register("src26_last_thousand", f"WITH {FEEDBACK_SQL} SELECT query_id, rating FROM feedback ORDER BY ts DESC, query_id DESC LIMIT 1000")
def last_thousand(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).orderBy(F.desc("ts"), F.desc("query_id")).limit(1000).select("query_id", "rating")


@register("src27_alert_history", f"WITH {LOG_SQL}, {_ALERTS} SELECT query_id, metric FROM alerts WHERE ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY")
def alert_history(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the last thirty days, written as JSON and read again."""
    path = scratch_folder(spark, "alerts")
    rows = _alerts(spark, d).where(F.col("ts") >= F.lit("2024-02-20").cast("timestamp") - F.expr("interval 30 days"))
    rows.select("query_id", "metric").write.json(path)
    return spark.read.schema("query_id long, metric string").json(path)


@register("sink02_analytics_export", f"WITH {LOG_SQL} SELECT intent, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM log GROUP BY intent")
def analytics_export(spark: SparkSession, d: str) -> DataFrame:
    """Figures by intent, exported as JSON and read again."""
    path = scratch_folder(spark, "analytics")
    query_log(spark, d).groupBy("intent").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).write.json(path)
    return spark.read.schema("intent string, n long, cents long").json(path)


@register("j18_named_intents", "SELECT event_id AS query_id, CASE event_type WHEN 'click' THEN 'followed' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'solved' WHEN 'error' THEN 'failed' ELSE 'other' END AS outcome FROM events")
def named_intents(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary join: the dictionary is part of the plan, so nothing is shuffled."""
    known = {"click": "followed", "view": "read", "purchase": "solved", "error": "failed"}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("outcome"))
