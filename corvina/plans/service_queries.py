"""Operation of the service over the test tables: reports, alerts, answers, learning, versions, governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T
from corvina.functions import understanding as N
from corvina.functions import vectors as V
from corvina.operators import retrieval as R
from corvina.operators import service as S
from corvina.plans.analytics_queries import CONFIDENCE_SQL, _alerts, _ALERTS, confidence
from corvina.plans.retrieval_queries import _SCORES, THRESHOLD, _queries, _scored, _top, _vectors
from corvina.plans.views import AS_OF, ENTRIES_SQL, FEEDBACK_SQL, LOG_SQL, WORD_CLASS, entries, feedback, matcher_keywords_sql, query_log, quoted, rewritten_sql
from corvina.registry import register
from corvina.session import table
from corvina.sources import store

_SECONDS = "k / CAST(20 AS DOUBLE)"


def seconds():
    return F.col("k") / 20.0


def _n(condition):
    return F.count(F.when(condition, 1))


# --- reports ---


@register("a01_system_analytics", f"""WITH {LOG_SQL}, r AS (SELECT * FROM log WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY), {_ALERTS.replace("FROM log", "FROM r")}
SELECT (SELECT count(*) FROM r) AS n_queries, (SELECT sum(cents) / (count(*) * CAST(50000 AS DOUBLE)) FROM r) AS mean_confidence, (SELECT count(DISTINCT user_id) FROM r) AS n_users,
  (SELECT count(*) FROM documents) AS n_entries, (SELECT count(DISTINCT source) FROM documents) AS n_sources, (SELECT count(*) FROM alerts) AS n_alerts""")
def system_analytics(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(AS_OF).cast("timestamp") - F.expr("interval 15 days")
    recent = query_log(spark, d).where(F.col("ts") >= since)
    log = recent.agg(F.count("*").alias("n_queries"), (F.sum("cents") / (F.count("*") * F.lit(50000.0))).alias("mean_confidence"), F.count_distinct("user_id").alias("n_users"))
    docs = table(spark, d, "documents").agg(F.count("*").alias("n_entries"), F.count_distinct("source").alias("n_sources"))
    raised = _alerts(spark, d).where(F.col("ts") >= since).agg(F.count("*").alias("n_alerts"))
    return log.crossJoin(docs).crossJoin(raised)  # one row each


@register("a06_top_entries", "SELECT l_partkey AS id, count(*) AS n_matches FROM lineitem GROUP BY l_partkey ORDER BY n_matches DESC, id LIMIT 10")
def top_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n_matches")).orderBy(F.desc("n_matches"), "id").limit(10)


@register("a10_performance", f"""WITH {LOG_SQL}, c AS (SELECT intent, {CONFIDENCE_SQL} AS c, {_SECONDS} AS s FROM log) SELECT intent, count(*) AS n, min(c) AS least, max(c) AS most, count(*) FILTER (c > 0.5) / CAST(count(*) AS DOUBLE) AS success_rate,
  count(*) FILTER (c > 0.8) / CAST(count(*) AS DOUBLE) AS high_rate, count(*) FILTER (c < 0.3) / CAST(count(*) AS DOUBLE) AS failure_rate, count(*) FILTER (c > 0.8) AS n_high, count(*) FILTER (c >= 0.5 AND c <= 0.8) AS n_medium, count(*) FILTER (c < 0.5) AS n_low, max(s) AS slowest FROM c GROUP BY intent""")
def performance(spark: SparkSession, d: str) -> DataFrame:
    return S.performance(query_log(spark, d), confidence(), seconds(), ["intent"])


@register("a13_confident_topics", f"WITH {LOG_SQL} SELECT intent, k % 10 AS topic, count(*) AS n, count(*) FILTER ({CONFIDENCE_SQL} > 0.7) AS n_confident FROM log GROUP BY ALL")
def confident_topics(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).groupBy("intent", (F.col("k") % 10).alias("topic")).agg(F.count("*").alias("n"), _n(confidence() > 0.7).alias("n_confident"))


@register("a15_failures", "SELECT substr(props, 1, 50) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def failures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").groupBy(F.substring("props", 1, 50).alias("error")).agg(F.count("*").alias("n"))


@register("a16_error_patterns", "SELECT substr(props, 1, 50) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL ORDER BY n DESC, error LIMIT 10")
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return failures(spark, d).orderBy(F.desc("n"), "error").limit(10)


@register("a20_comments", f"WITH {FEEDBACK_SQL} SELECT rating, count(*) AS n, count(*) FILTER (length(comment) > 0) AS n_commented, sum(length(comment)) / CAST(count(*) AS DOUBLE) AS mean_length, count(*) FILTER (length(comment) > 50) AS n_detailed FROM feedback GROUP BY rating")
def comments(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("comment")
    return feedback(spark, d).groupBy("rating").agg(F.count("*").alias("n"), _n(size > 0).alias("n_commented"), (F.sum(size) / F.count("*")).alias("mean_length"), _n(size > 50).alias("n_detailed"))


@register("a25_user_days", f"WITH {FEEDBACK_SQL} SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(rating) AS BIGINT) AS total FROM feedback GROUP BY ALL")
def user_days(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@register("a29_alert_report", f"WITH {LOG_SQL}, {_ALERTS} SELECT component, severity, count(*) AS n, count(*) FILTER (query_id % 3 = 0) / CAST(count(*) AS DOUBLE) AS resolution_rate FROM alerts GROUP BY ALL")
def alert_report(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).groupBy("component", "severity").agg(F.count("*").alias("n"), S.share(F.col("query_id") % 3 == 0).alias("resolution_rate"))


@register("a30_advice", f"""WITH {LOG_SQL}, u AS (SELECT user_id, sum(cents) / (count(*) * CAST(50000 AS DOUBLE)) AS c, sum(k) / CAST(count(*) AS DOUBLE) / 20 AS s, count(*) FILTER ({CONFIDENCE_SQL} < 0.5) / CAST(count(*) AS DOUBLE) AS low, count(*) FILTER (intent = 'error') / CAST(count(*) AS DOUBLE) AS e, count(*) FILTER (k > 95) AS a FROM log GROUP BY user_id)
SELECT user_id, array_to_string(list_filter([CASE WHEN c < 0.6 THEN 'improve_confidence' END, CASE WHEN s > 2 THEN 'speed_up' END, CASE WHEN low > 0.2 THEN 'extend_entries' END, CASE WHEN e > 0.05 THEN 'fix_errors' END, CASE WHEN a > 5 THEN 'look_into_alerts' END], lambda x: x IS NOT NULL), ',') AS advice FROM u""")
def advice(spark: SparkSession, d: str) -> DataFrame:
    one = query_log(spark, d).groupBy("user_id").agg((F.sum("cents") / (F.count("*") * F.lit(50000.0))).alias("mean_confidence"), (F.sum("k") / F.count("*") / 20).alias("mean_seconds"), S.share(confidence() < 0.5).alias("low_share"), S.share(F.col("intent") == "error").alias("error_rate"), _n(F.col("k") > 95).alias("n_alerts"))
    return S.advice(one).select("user_id", F.array_join("advice", ",").alias("advice"))


@register("a32_session_stats", f"""WITH {LOG_SQL}, u AS (SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM log GROUP BY user_id) SELECT count(*) AS n_sessions, count(*) FILTER (last_at >= TIMESTAMP '2024-01-30') AS n_active, CAST(sum(n) AS BIGINT) AS n_interactions,
  sum(CAST(epoch(last_at) AS BIGINT) - CAST(epoch(first_at) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 60 AS mean_minutes FROM u""")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    users = query_log(spark, d).groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))
    # whole seconds, as the oracle rounds its epochs
    second = lambda c: F.round(F.unix_micros(c) / 1e6).cast("long")
    return users.agg(F.count("*").alias("n_sessions"), _n(F.col("last_at") >= F.lit("2024-01-30").cast("timestamp")).alias("n_active"), F.sum("n").alias("n_interactions"), (F.sum(second("last_at") - second("first_at")) / F.count("*") / 60).alias("mean_minutes"))


@register("a33_session_means", f"WITH {LOG_SQL} SELECT user_id, count(*) AS total_interactions, count(*) FILTER ({CONFIDENCE_SQL} >= 0.5) AS successful, sum(cents) / (count(*) * CAST(50000 AS DOUBLE)) AS average_confidence, count(*) FILTER ({CONFIDENCE_SQL} >= 0.5) / CAST(count(*) AS DOUBLE) AS success_rate FROM log GROUP BY user_id")
def session_means(spark: SparkSession, d: str) -> DataFrame:
    good = confidence() >= 0.5
    return query_log(spark, d).groupBy("user_id").agg(F.count("*").alias("total_interactions"), _n(good).alias("successful"), (F.sum("cents") / (F.count("*") * F.lit(50000.0))).alias("average_confidence"), S.share(good).alias("success_rate"))


@register("a39_similarity_stats", f"WITH {_SCORES} SELECT qid, count(*) AS n, count(*) FILTER (sim >= 0.25) AS n_above, arg_max(id, (sim, -id)) AS best_id FROM scored GROUP BY qid")
def similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.similarity_counts(v, _queries(v), THRESHOLD, 0.25)


@register("a41_store_stats", "SELECT label, count(*) AS n_vectors, CAST(sum(len(embedding) * 4 + 1024) AS BIGINT) AS n_bytes, max(len(embedding)) AS dimension FROM embeddings GROUP BY label")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n_vectors"), F.sum((F.size("embedding") * 4 + 1024).cast("long")).alias("n_bytes"), F.max(F.size("embedding").cast("long")).alias("dimension"))


@register("a43_improvement_counts", f"""WITH {LOG_SQL} SELECT intent AS strategy, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS n_week, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS n_month, count(*) AS n FROM log GROUP BY intent""")
def improvement_counts(spark: SparkSession, d: str) -> DataFrame:
    since = lambda days: F.col("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr(f"interval {days} days")
    return query_log(spark, d).groupBy(F.col("intent").alias("strategy")).agg(_n(since(7)).alias("n_week"), _n(since(30)).alias("n_month"), F.count("*").alias("n"))


@register("a44_status_tiers", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS n_errors, CASE WHEN count(*) FILTER (event_type = 'error') > 50 THEN 'degraded' WHEN count(*) FILTER (event_type = 'error') > 10 THEN 'warning' ELSE 'healthy' END AS status FROM events GROUP BY ALL")
def status_tiers(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(_n(F.col("event_type") == "error").alias("n_errors"))
    return daily.withColumn("status", F.when(F.col("n_errors") > 50, "degraded").when(F.col("n_errors") > 10, "warning").otherwise("healthy"))


_W = r"\p{L}\p{N}\p{M}_"


@register("a45_keyword_frequency", rf"""WITH w AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '[{_W}]+'), lambda w: length(w) > 3)) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL)
SELECT source, word, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INT) AS rn FROM c QUALIFY rn <= 10""")
def keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_counts(table(spark, d, "documents"), "source", "text", 10)


@register("a46_conversation_patterns", r"""WITH w AS (SELECT conv_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, turn FROM conversations WHERE role = 'user')
SELECT conv_id, count(*) AS n_queries, sum(n) / CAST(count(*) AS DOUBLE) AS mean_words, CASE WHEN sum(n) / CAST(count(*) AS DOUBLE) > 15 THEN 'detailed' WHEN sum(n) / CAST(count(*) AS DOUBLE) < 5 THEN 'brief' ELSE 'medium' END AS preference FROM w GROUP BY conv_id""")
def conversation_patterns(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.size(T.words(F.col("text"))).alias("n"))
    mean = F.sum("n") / F.count("*")
    out = words.groupBy("conv_id").agg(F.count("*").alias("n_queries"), mean.alias("mean_words"))
    return out.withColumn("preference", F.when(F.col("mean_words") > 15, "detailed").when(F.col("mean_words") < 5, "brief").otherwise("medium"))


@register("src14_ingestion_stats", f"WITH {ENTRIES_SQL} SELECT category AS document, count(*) AS n_entries, count(*) FILTER (answer <> '') AS n_ok, count(*) FILTER (answer = '') AS n_failed, 100 * count(*) FILTER (answer <> '') / CAST(count(*) AS DOUBLE) AS percent FROM entries GROUP BY category")
def ingestion_stats(spark: SparkSession, d: str) -> DataFrame:
    told = F.col("answer") != ""
    return entries(spark, d).groupBy(F.col("category").alias("document")).agg(F.count("*").alias("n_entries"), _n(told).alias("n_ok"), _n(~told).alias("n_failed"), (100 * _n(told) / F.count("*")).alias("percent"))


# --- monitoring ---


@register("x03_stale_components", f"WITH {LOG_SQL}, l AS (SELECT user_id, max(ts) AS last_at FROM log GROUP BY user_id) SELECT user_id, CAST(floor(epoch(TIMESTAMP '2024-01-31')) AS BIGINT) - CAST(floor(epoch(last_at)) AS BIGINT) AS silent_seconds FROM l WHERE CAST(floor(epoch(TIMESTAMP '2024-01-31')) AS BIGINT) - CAST(floor(epoch(last_at)) AS BIGINT) > 300")
def stale_components(spark: SparkSession, d: str) -> DataFrame:
    return S.stale(query_log(spark, d), "user_id", "ts", "2024-01-31").select("user_id", "silent_seconds")


@register("x05_health_alerts", f"""WITH {LOG_SQL} SELECT query_id, 'error_rate' AS metric, CASE WHEN k > 60 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity FROM log WHERE k > 20 UNION ALL SELECT query_id, 'status', 'HIGH' FROM log WHERE intent = 'error'""")
def health_alerts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("intent") == "error", "unhealthy").otherwise("healthy")
    return S.health_alerts(query_log(spark, d), F.col("k") / 400.0, status).select("query_id", "metric", "severity")


@register("x06_busy_windows", f"""WITH {LOG_SQL}, w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(m AS BIGINT)) AS window_start, k FROM log, range(5) AS r(m)) SELECT window_start, count(*) AS n, sum(k) / CAST(count(*) AS DOUBLE) / 20 AS mean_seconds FROM w GROUP BY window_start HAVING count(*) > 1 AND sum(k) / CAST(count(*) AS DOUBLE) / 20 > 3""")
def busy_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = query_log(spark, d).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n"), (F.sum("k") / F.count("*") / 20).alias("mean_seconds"))
    return rows.where("n > 1 and mean_seconds > 3").select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "mean_seconds")


@register("x08_resolved", f"""WITH {LOG_SQL}, a AS (SELECT query_id, user_id, ts AS raised_at FROM log WHERE intent = 'error'), r AS (SELECT user_id, ts AS resolved_at FROM log WHERE intent = 'signup')
SELECT query_id, min(resolved_at) AS resolved_at FROM a LEFT JOIN r ON a.user_id = r.user_id AND resolved_at >= raised_at GROUP BY query_id""")
def resolved(spark: SparkSession, d: str) -> DataFrame:
    log = query_log(spark, d)
    raised = log.where("intent = 'error'").select("query_id", "user_id", F.col("ts").alias("raised_at"))
    closed = log.where("intent = 'signup'").select("user_id", F.col("ts").alias("resolved_at"))
    return S.resolved(raised, closed, ["user_id"]).select("query_id", F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"))


@register("x11_expired_sessions", f"WITH {LOG_SQL}, s AS (SELECT user_id, min(ts) AS created_at, max(ts) AS last_at FROM log GROUP BY user_id) SELECT user_id, created_at + INTERVAL 1 DAY < TIMESTAMP '2024-01-05' AS expired, last_at > created_at + INTERVAL 1 DAY AS used_after FROM s")
def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = query_log(spark, d).groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_at"))
    ends = F.col("created_at") + F.expr("interval 1 day")
    return s.select("user_id", (ends < F.lit("2024-01-05").cast("timestamp")).alias("expired"), (F.col("last_at") > ends).alias("used_after"))


@register("g01_audit", "SELECT event_type, CASE WHEN event_type = 'error' THEN 'HIGH' WHEN event_type = 'signup' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def audit(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "signup", "MEDIUM").otherwise("LOW")
    return table(spark, d, "events").groupBy("event_type", severity.alias("severity"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


# --- filters, joins, sets ---


@register("f08_composite_filter", f"WITH {ENTRIES_SQL} SELECT id FROM entries WHERE audience IN ('de', 'any') AND intent IN ('process', 'information', 'any') AND condition IN ('urgent', 'default') AND confidence >= 0.2")
def composite_filter(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(S.composite_filter("de", "general", "process", "urgent", 0.2)).select("id")


@register("f10_keyword_filter", "SELECT item_id FROM benchmark WHERE len(list_intersect(string_split_regex(lower(text), '\\s+'), ['the', 'and'])) > 0")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").withColumn("keywords", F.split("text", r"\s+"))
    return rows.where(S.composite_filter(keywords=["The", "AND"])).select("item_id")


@register("f13_feedback_of", f"WITH {FEEDBACK_SQL}, {LOG_SQL.replace('log AS', 'own AS')} SELECT f.query_id, f.rating, o.intent FROM feedback f JOIN own o ON f.query_id = o.query_id WHERE f.user_id = 7")
def feedback_of(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).where("user_id = 7").join(query_log(spark, d).select("query_id", "intent"), "query_id").select("query_id", "rating", "intent")


@register("f19_query_errors", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN length(trim(text)) = 1 THEN 'short' END, CASE WHEN length(trim(text)) > 1000 THEN 'long' END, CASE WHEN regexp_matches(text, '[<>{}\[\]\\]') THEN 'characters' END, CASE WHEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) > 100 THEN 'words' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def query_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(S.query_errors(F.col("text")), ",").alias("errors"))


@register("f22_display", "SELECT doc_id, n_chars / CAST(1048576 AS DOUBLE) AS megabytes, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM documents")
def display(spark: SparkSession, d: str) -> DataFrame:
    short = F.when(F.length("text") > 50, F.concat(F.substring("text", 1, 50), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1048576.0).alias("megabytes"), short.alias("shown"))


@register("j08_documents_without", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def documents_without(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@register("u03_keyword_union", rf"WITH p AS (SELECT item_id, list_distinct(list_concat(regexp_extract_all(lower(text), '[{_W}]+'), [lower(text)])) AS words FROM benchmark) SELECT item_id, len(words) AS n FROM p")
def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_union(T.tokens(F.col("text")), F.array(F.lower("text")))).cast("long").alias("n"))


@register("u06_not_in_target", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def not_in_target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id").distinct()).distinct()


@register("src17_delete_ids", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_ids(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return store.remove(state, table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


@register("src24_migrate", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def migrate(spark: SparkSession, d: str) -> DataFrame:
    """What a second store still lacks: entries by document first, then remaining ids."""
    there = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label").join(there, "id", "left_anti")


@register("sink03_feedback_export", f"WITH {FEEDBACK_SQL} SELECT query_id, user_id, rating FROM feedback")
def feedback_export(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).drop("comment", "ts")


@register("sink06_dumps", r"""SELECT doc_id, len(regexp_extract_all(text, 'Q:')) > 1 OR length(text) > 1000 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100)) > 10 AS dumped FROM documents""")
def dumps(spark: SparkSession, d: str) -> DataFrame:
    from corvina.operators.quality import looks_dumped

    return table(spark, d, "documents").select("doc_id", looks_dumped(F.col("text")).alias("dumped"))


# --- vectors, hashes, encryption ---


@register("m01_cosine", "SELECT a.vec_id, b.vec_id AS other_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0 AS alike FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("a").alias("b"))
    return v.join(nxt, "vec_id").select("vec_id", "other_id", (V.cosine(F.col("a"), F.col("b")) > 0).alias("alike"))


@register("m03_composite_vector", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * CAST(0.5 AS DOUBLE) + b.e[i] * CAST(0.4 AS DOUBLE)) AS s FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS largest, s[1] > 0 AS positive FROM p""")
def composite_vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = v.join(nxt, "vec_id").select("vec_id", V.weighted([F.col("a"), F.col("b"), F.lit(None).cast("array<double>")], [0.5, 0.4, 0.1]).alias("c"))
    return both.select("vec_id", (F.array_position("c", F.array_max("c")) - 1).cast("int").alias("largest"), (F.get("c", F.lit(0)) > 0).alias("positive"))


@register("m04_embedding_text", f"WITH {ENTRIES_SQL} SELECT id, md5('Question: ' || question || ' Answer: ' || answer || ' Keywords: ' || category) AS digest FROM entries")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Answer: "), "answer"), F.concat(F.lit("Keywords: "), "category"))
    return entries(spark, d).select("id", F.md5(text.cast("binary")).alias("digest"))


@register("c01_encryption", "SELECT c_custkey, c_name, false AS readable_with_another_key FROM customer")
def encryption(spark: SparkSession, d: str) -> DataFrame:
    """Names encrypted and decrypted again. The key here is a test's; a real one comes from the caller."""
    key, other = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210")
    hidden = table(spark, d, "customer").select("c_custkey", S.encrypted(F.col("c_name"), key).alias("hidden"))
    return hidden.select("c_custkey", S.decrypted(F.col("hidden"), key).alias("c_name"), S.decrypted(F.col("hidden"), other).isNotNull().alias("readable_with_another_key"))


@register("c02_seems_encrypted", "SELECT c_custkey, c_custkey % 2 = 0 AS seems FROM customer")
def seems_encrypted(spark: SparkSession, d: str) -> DataFrame:
    """Every second name is put as url-safe base64 of its 64-digit hash."""
    coded = F.translate(F.base64(F.sha2("c_name", 256).cast("binary")), "+/", "-_")
    value = F.when(F.col("c_custkey") % 2 == 0, coded).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.seems_encrypted(value).alias("seems"))


@register("c03_ids", f"WITH {FEEDBACK_SQL} SELECT query_id, 'fb_' || strftime(ts, '%Y%m%d%H%M%S') || '_' || CAST(user_id AS VARCHAR) AS feedback_id, 'v_' || substr(md5(CAST(query_id AS VARCHAR)), 1, 8) AS version_id FROM feedback")
def ids(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    return feedback(spark, d).select("query_id", F.concat(F.lit("fb_"), stamp, F.lit("_"), F.col("user_id").cast("string")).alias("feedback_id"), F.concat(F.lit("v_"), F.substring(F.md5(F.col("query_id").cast("string").cast("binary")), 1, 8)).alias("version_id"))


# --- queries understood ---


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@register("t15_contractions", f"SELECT conv_id, turn, {rewritten_sql('text', L.CONTRACTIONS)} AS text FROM conversations WHERE role = 'user'")
def contractions(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", T.expand_contractions(F.col("text")).alias("text"))


@register("t21_mixed_language")
def mixed_language(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d).withColumn("l", N.language(F.col("text")))
    return rows.select("conv_id", "turn", N.normalize_mixed(F.col("text"), F.col("l.mixed")).alias("normalized"), N.marked_foreign(F.col("text"), F.col("l.lang")).alias("marked"))


@register("t26_modifiers", "SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){'|'.join(patterns)}') THEN '{name}' END" for name, patterns in L.MODIFIERS.items()) + "], lambda m: m IS NOT NULL), ',') AS modifiers FROM conversations WHERE role = 'user'")
def modifiers(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", F.array_join(T.modifiers(F.col("text")), ",").alias("modifiers"))


@register("t27_expansions")
def expansions(spark: SparkSession, d: str) -> DataFrame:
    every = F.concat(N.variations(F.col("text")), N.template_variations(F.col("text")), N.casual_variations(F.col("text")))
    return _asked(spark, d).select("conv_id", "turn", F.posexplode(F.array_distinct(every)).alias("place", "expansion"))


@register("t28_components")
def components(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", N.query_components(F.col("text"), F.lit("any")).alias("c")).select("conv_id", "turn", "c.*")


@register("t30_preprocess")
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Language, grammar, typos of the table, intent, key, confidence and n-grams of every query."""
    rows = _asked(spark, d).withColumn("l", N.language(F.col("text"))).withColumn("formal", T.formal_grammar(F.col("text"))).withColumn("fixed", T.fix_typos(F.col("formal")))
    rows = rows.withColumn("i", T.intent_of(F.col("fixed.text"))).withColumn("grams", T.ngrams(F.col("fixed.text")))
    sure = N.processing_confidence(F.col("l.confidence"), F.col("i.confidence"), F.col("fixed.confidence"), F.size(T.words(F.col("text"))))
    return rows.select("conv_id", "turn", "l.lang", F.col("fixed.text").alias("corrected"), "i.intent", F.size("grams").alias("n_grams"), sure.alias("confidence"))


_FLAG = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(low, w))) > 0"


@register("t32_follow_up", f"WITH q AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_FLAG(L.FOLLOW_UP)} AS has_indicators, {_FLAG(L.CONTINUED)} AS has_continuations, {_FLAG(L.REFERENCES)} AS has_references FROM q")
def follow_up(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", N.follow_up(F.col("text")).alias("f")).select("conv_id", "turn", "f.has_indicators", "f.has_continuations", "f.has_references")


@register("t32_resolved")
def resolved_follow_up(spark: SparkSession, d: str) -> DataFrame:
    """Each query with the references to the one before it resolved, and expanded in its context."""
    rows = _asked(spark, d).withColumn("keys", T.query_keywords(F.col("text"), 5))
    rows = rows.withColumn("before", F.lag("keys").over(Window.partitionBy("conv_id").orderBy("turn")))
    known = F.coalesce("before", F.array().cast("array<string>"))
    resolved_ = F.when(F.col("before").isNull(), F.col("text")).otherwise(N.resolve_follow_up(F.col("text"), known, F.get(known, F.lit(0))))
    return rows.select("conv_id", "turn", resolved_.alias("resolved"), F.size(N.context_expansions(F.col("text"), F.get(known, F.lit(0)), F.slice(known, 1, 2))).alias("n_expansions"))


@register("t36_strip_prefix", r"""WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, x FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents))
SELECT doc_id, CAST(i - 1 AS INT) AS idx, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(x), '^[^\p{L}\p{N}\p{M}_\s]+', '')), '^[0-9]+[.)\s\-]*', '')), '^[^\p{L}\p{N}\p{M}_\s]+', '')) AS stripped FROM l""")
def strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "x")).select("doc_id", "idx", T.strip_prefix(F.col("x")).alias("stripped"))


@register("t44_explanation", f"""WITH {ENTRIES_SQL}, k AS (SELECT e.id, {matcher_keywords_sql('b.text')} AS own, list_distinct(list_concat({matcher_keywords_sql('e.question')}, {matcher_keywords_sql('e.category')})) AS known FROM entries e JOIN benchmark b ON e.id = b.item_id)
SELECT id, array_to_string(list_sort(list_intersect(own, known)), ',') AS matched, CASE WHEN len(own) = 0 THEN 0 ELSE len(list_intersect(own, known)) / CAST(len(own) AS DOUBLE) END AS overlap FROM k""")
def explanation(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d).select("id", F.col("question").alias("text"), "category")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("asked"))
    return rows.join(asked, "id").select("id", S.match_explanation(F.col("asked"), F.col("text"), F.col("category")).alias("e")).select("id", F.array_join("e.matched", ",").alias("matched"), "e.overlap")


@register("t47_client_address", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '10.0.0.' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS address FROM customer")
def client_address(spark: SparkSession, d: str) -> DataFrame:
    from corvina.operators.quality import client_address as address

    forwarded = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("c_custkey").cast("string"), F.lit(", 192.168.0.1")))
    return table(spark, d, "customer").select("c_custkey", address(forwarded, F.col("c_name")).alias("address"))


# --- answers, learning, versions ---


@register("q04_answers", f"""WITH {_SCORES}, t AS ({_top('scored', 3)}), a AS (SELECT qid, rn, text AS answer FROM t JOIN documents ON doc_id = id WHERE trim(text) <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rn) AS i, count(*) OVER (PARTITION BY qid) AS n FROM a),
g AS (SELECT qid, max(n) AS n, CASE WHEN max(n) = 1 THEN max(answer) ELSE string_agg('Source ' || CAST(i AS VARCHAR) || ': ' || answer, chr(10) || chr(10) ORDER BY rn) END AS answer FROM n GROUP BY qid)
SELECT q.vec_id AS qid, md5(coalesce(g.answer, 'No entry answers: ' || CAST(q.vec_id AS VARCHAR))) AS digest, CASE WHEN n IS NULL THEN 'fallback' WHEN n = 1 THEN 'direct' ELSE 'synthesis' END AS method, CAST(coalesce(n, 0) AS INT) AS n_sources FROM embeddings q LEFT JOIN g ON q.vec_id = g.qid WHERE q.vec_id % 50 = 0""")
def branching_answers(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    near = R.top_k(_scored(spark, d, 3), 3, ["qid"]).select("qid", "id", "rn").join(texts, "id")
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").cast("string").alias("text"))
    return S.answers(near, asked).select("qid", F.md5(F.col("answer").cast("binary")).alias("digest"), "method", "n_sources")


@register("m07_answer_confidence", f"WITH {LOG_SQL} SELECT query_id, least(CAST(1 AS DOUBLE), CASE WHEN k % 4 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END + CASE WHEN k % 4 > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN cents > 25000 THEN CAST(0.05 AS DOUBLE) ELSE 0 END + CASE WHEN k % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS confidence FROM log")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    sources = F.col("k") % 4 > 0
    text = F.when(F.col("cents") > 25000, F.repeat(F.lit("x"), 60)).otherwise(F.lit("x"))
    method = F.when(sources, "rag").otherwise("direct")
    return query_log(spark, d).select("query_id", S.answer_confidence(F.when(sources, 0.9).otherwise(0.1), method, text, F.col("k") % 2 == 0).alias("confidence"))


@register("t45_prompts", f"""WITH {ENTRIES_SQL} SELECT id, md5('Question:' || chr(10) || question || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN trim(answer) = '' THEN '[none]' ELSE answer END || chr(10) || chr(10) || 'Answer from the context; say so if it isn''t there.') AS digest FROM entries""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", F.md5(S.prompt(F.col("question"), F.col("answer")).cast("binary")).alias("digest"))


@register("q10_learning", rf"""WITH {ENTRIES_SQL}, k AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(question), '[{WORD_CLASS}]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({quoted(L.EXTRACT_STOP)}))) AS every, list_filter(regexp_extract_all(lower(question), '[{WORD_CLASS}]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({quoted(L.EXTRACT_STOP)})) AS w FROM entries),
own AS (SELECT id, list_transform(list_sort(list_transform(every, lambda x: {{'at': list_position(w, x), 'word': x}}))[1:10], lambda x: x.word) AS keywords FROM k),
new AS (SELECT item_id AS id, list_sort({matcher_keywords_sql('text')}) AS words FROM benchmark),
both_lists AS (SELECT own.id, list_concat(keywords, list_filter(coalesce(words, []), lambda x: NOT list_contains(keywords, x))) AS keywords FROM own LEFT JOIN new ON own.id = new.id)
SELECT id, CAST(len(keywords) AS INT) AS n_keywords, array_to_string(keywords, ',') AS keywords FROM both_lists""")
def learning(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages stand for queries that the entry with their id answered well."""
    rows = entries(spark, d).select("id", T.entry_keywords(F.col("question")).alias("keywords"))
    praised = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return S.learn_keywords(rows, praised).select("id", F.size("keywords").alias("n_keywords"), F.array_join("keywords", ",").alias("keywords"))


@register("q11_match_increments", "SELECT p_partkey AS id, CAST(p_size + coalesce(n, 0) AS BIGINT) AS query_matches, last_matched FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last_matched FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey")
def match_increments(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_matched"))
    return table(spark, d, "part").join(more, "p_partkey", "left").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.coalesce("n", F.lit(0))).cast("long").alias("query_matches"), "last_matched")


_VERSIONS = "v AS (SELECT s_suppkey AS version_id, s_acctbal AS created_at, s_suppkey % 3 = 0 AS is_active FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, version_id DESC) AS rn FROM v)"


@register("i03_versions", f"WITH {_VERSIONS} SELECT version_id, rn = (SELECT min(rn) FROM r WHERE is_active) AS is_current, rn <= 10 AS kept FROM r")
def versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("version_id"), F.col("s_acctbal").alias("created_at"), (F.col("s_suppkey") % 3 == 0).alias("is_active"))
    return S.with_versions(rows, 10).select("version_id", "is_current", "kept")


@register("i04_overdue_tests", "SELECT o_orderkey AS test_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL 14 DAY < TIMESTAMP '1998-01-01' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'planned' END AS status FROM orders")
def overdue_tests(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "orders").select(F.col("o_orderkey").alias("test_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("planned").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(14).alias("days"))
    return S.overdue_tests(tests, "1998-01-01").select("test_id", "status")
