"""Analytics over the query log, feedback and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.operators import analytics as A
from corvina.operators import experiments as E
from corvina.operators import feedback as B
from corvina.operators import quality as Y
from corvina.plans.views import FEEDBACK_SQL, LOG_SQL, feedback, query_log
from corvina.registry import register
from corvina.session import table

def confidence():
    return F.col("cents") / F.lit(50000.0)


CONFIDENCE_SQL = "(cents / CAST(50000 AS DOUBLE))"


@register("a02_by_intent", f"WITH {LOG_SQL} SELECT intent, count(*) AS n, sum(cents) / (count(*) * CAST(50000 AS DOUBLE)) AS mean_confidence FROM log GROUP BY intent ORDER BY n DESC, intent LIMIT 10")
def by_intent(spark: SparkSession, d: str) -> DataFrame:
    out = query_log(spark, d).groupBy("intent").agg(F.count("*").alias("n"), (F.sum("cents") / (F.count("*") * F.lit(50000.0))).alias("mean_confidence"))
    return out.orderBy(F.desc("n"), "intent").limit(10)


@register("a03_success_rate", f"""WITH {LOG_SQL} SELECT count(*) AS n, count(*) FILTER ({CONFIDENCE_SQL} >= 0.5) AS n_success, count(*) FILTER ({CONFIDENCE_SQL} > 0.8) AS n_high, count(*) FILTER ({CONFIDENCE_SQL} < 0.3) AS n_failed,
  sum(k) / CAST(count(*) AS DOUBLE) / 20 AS mean_seconds, count(*) FILTER ({CONFIDENCE_SQL} >= 0.5) / CAST(count(*) AS DOUBLE) AS success_rate FROM log""")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    c = confidence()
    out = query_log(spark, d).agg(F.count("*").alias("n"), n(c >= 0.5).alias("n_success"), n(c > 0.8).alias("n_high"), n(c < 0.3).alias("n_failed"), (F.sum("k") / F.count("*") / 20).alias("mean_seconds"))
    return out.withColumn("success_rate", F.col("n_success") / F.col("n"))


@register("a04_rating_histogram", f"WITH {FEEDBACK_SQL} SELECT rating, count(*) AS n FROM feedback GROUP BY rating")
def rating_histogram(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).groupBy("rating").agg(F.count("*").alias("n"))


@register("a05_health", f"""WITH {LOG_SQL} SELECT intent AS component, count(*) FILTER ({CONFIDENCE_SQL} < 0.05) AS n_critical, count(*) FILTER ({CONFIDENCE_SQL} < 0.3) AS n_high,
  CASE WHEN count(*) FILTER ({CONFIDENCE_SQL} < 0.05) > 110 THEN 'critical' WHEN count(*) FILTER ({CONFIDENCE_SQL} < 0.3) > 600 THEN 'degraded' ELSE 'healthy' END AS status FROM log GROUP BY intent""")
def health(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    out = query_log(spark, d).groupBy(F.col("intent").alias("component")).agg(n(confidence() < 0.05).alias("n_critical"), n(confidence() < 0.3).alias("n_high"))
    return out.withColumn("status", F.when(F.col("n_critical") > 110, "critical").when(F.col("n_high") > 600, "degraded").otherwise("healthy"))


@register("a07_buckets", f"WITH {LOG_SQL} SELECT intent, CASE WHEN {CONFIDENCE_SQL} > 0.8 THEN 'high' WHEN {CONFIDENCE_SQL} >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM log GROUP BY ALL")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).groupBy("intent", A.confidence_bucket(confidence()).alias("bucket")).agg(F.count("*").alias("n"))


@register("a08_trending_words", r"""WITH w AS (SELECT unnest(string_split_regex(lower(text), '\s+')) AS word FROM conversations WHERE role = 'user') SELECT word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def trending_words(spark: SparkSession, d: str) -> DataFrame:

    words = table(spark, d, "conversations").where("role = 'user'").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where(F.length("word") > 3)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@register("a09_by_hour", f"WITH {LOG_SQL} SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM log GROUP BY ALL")
def by_hour(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


_HALVES = """r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts, query_id) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}),
h AS (SELECT {by}, max(n) AS n, sum({v}) FILTER (rn <= n // 2) / CAST(count(*) FILTER (rn <= n // 2) AS DOUBLE) AS first_mean, sum({v}) FILTER (rn > n // 2) / CAST(count(*) FILTER (rn > n // 2) AS DOUBLE) AS second_mean FROM r GROUP BY {by})
SELECT {by}, n, first_mean, second_mean, CASE WHEN n < {least} THEN 'insufficient_data' WHEN second_mean - first_mean > {step} THEN 'improving' WHEN second_mean - first_mean < -{step} THEN 'declining' ELSE 'stable' END AS trend FROM h"""


@register("a11_confidence_trend", f"WITH {LOG_SQL}, " + _HALVES.format(by="user_id", rows="log", v="cents", least=10, step=2500))
def confidence_trend(spark: SparkSession, d: str) -> DataFrame:
    return A.half_split(query_log(spark, d), ["user_id"], ["ts", "query_id"], "cents", 2500, 10)


@register("a12_completeness", f"WITH {LOG_SQL} SELECT intent, count(*) AS n, count(*) FILTER (k > 0) / CAST(count(*) AS DOUBLE) AS with_time, count(*) FILTER (cents > 100) / CAST(count(*) AS DOUBLE) AS with_confidence FROM log GROUP BY intent")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.count(F.when(c, 1)) / F.count("*")
    return query_log(spark, d).groupBy("intent").agg(F.count("*").alias("n"), share(F.col("k") > 0).alias("with_time"), share(F.col("cents") > 100).alias("with_confidence"))


@register("a14_event_severity", """SELECT CASE WHEN event_type LIKE '%error%' THEN 'high' WHEN event_type LIKE '%sign%' THEN 'medium' ELSE 'low' END AS severity, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL""")
def event_severity(spark: SparkSession, d: str) -> DataFrame:

    low = F.lower("event_type")
    severity = F.when(low.contains("error"), "high").when(low.contains("sign"), "medium").otherwise("low")
    return table(spark, d, "events").groupBy(severity.alias("severity"), "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@register("a26_head_tail", f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, query_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM log)
SELECT user_id, max(n) AS n, sum(cents) FILTER (rn <= least(5, n // 3)) / CAST(nullif(count(*) FILTER (rn <= least(5, n // 3)), 0) AS DOUBLE) AS head_mean,
  sum(cents) FILTER (rn > n - least(5, n // 3)) / CAST(nullif(count(*) FILTER (rn > n - least(5, n // 3)), 0) AS DOUBLE) AS tail_mean FROM r GROUP BY user_id""")
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    return A.head_tail(query_log(spark, d), ["user_id"], ["ts", "query_id"], "cents")


@register("a27_order_statistics", f"""WITH {LOG_SQL}, l AS (SELECT intent, list_sort(list(cents)) AS v FROM log GROUP BY intent)
SELECT intent, len(v) AS n, v[len(v) // 2 + 1] AS upper_median, CASE WHEN len(v) > 20 THEN v[CAST(floor(len(v) * CAST(0.95 AS DOUBLE)) AS INT) + 1] ELSE v[len(v)] END AS p95, v[1] AS least, v[len(v)] AS most FROM l""")
def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.order_statistics(query_log(spark, d), ["intent"], "cents")


@register("a28_latest_status", f"WITH {LOG_SQL} SELECT intent AS component, arg_max(cents, (ts, query_id)) AS latest, max(k) AS slowest, count(*) AS n FROM log GROUP BY intent")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).groupBy(F.col("intent").alias("component")).agg(F.max_by("cents", F.struct("ts", "query_id")).alias("latest"), F.max("k").alias("slowest"), F.count("*").alias("n"))


@register("a42_smoothed", f"WITH {LOG_SQL}, l AS (SELECT user_id, list(k ORDER BY query_id) AS v FROM log GROUP BY user_id) SELECT user_id, list_reduce(list_transform(v, lambda x: CAST(x AS DOUBLE)), lambda s, x: CASE WHEN s = 0 THEN x ELSE s * (1 - CAST(0.1 AS DOUBLE)) + x * CAST(0.1 AS DOUBLE) END) AS ema FROM l")
def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return A.smoothed(query_log(spark, d), ["user_id"], "query_id", "k")


@register("w06_moving_mean", f"""WITH {LOG_SQL} SELECT query_id, count(*) OVER w AS n_window, CAST(sum(cents) OVER w AS BIGINT) AS sum_window FROM log WINDOW w AS (PARTITION BY intent ORDER BY ts, query_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def moving_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.moving(query_log(spark, d).select("intent", "ts", "query_id", "cents"), ["intent"], ["ts", "query_id"], "cents").select("query_id", "n_window", "sum_window")


@register("w07_trailing_minutes", f"""WITH {LOG_SQL} SELECT query_id, count(*) OVER w AS n_window, CAST(sum(k) OVER w AS BIGINT) AS sum_window FROM log WINDOW w AS (PARTITION BY intent ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)""")
def trailing_minutes(spark: SparkSession, d: str) -> DataFrame:
    return A.trailing(query_log(spark, d).select("intent", "ts", "query_id", "k"), ["intent"], "ts", "k").select("query_id", "n_window", "sum_window")


@register("w12_streaks", f"""WITH {LOG_SQL}, i AS (SELECT *, sum(CASE WHEN {CONFIDENCE_SQL} < 0.3 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, query_id) AS island FROM log),
s AS (SELECT query_id, CASE WHEN {CONFIDENCE_SQL} < 0.3 THEN CAST(sum(CASE WHEN {CONFIDENCE_SQL} < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, query_id) AS BIGINT) ELSE 0 END AS streak FROM i)
SELECT query_id, streak, CASE WHEN streak = 0 THEN 'answered' WHEN streak = 1 THEN 'first_miss' WHEN streak = 2 THEN 'second_miss' ELSE 'escalate' END AS tier FROM s""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return A.streaks(query_log(spark, d).select("user_id", "ts", "query_id", "cents"), ["user_id"], ["ts", "query_id"], confidence() < 0.3).select("query_id", "streak", "tier")


_ALERTS = f"""alerts AS (SELECT query_id, intent AS component, ts, 'confidence' AS metric, CASE WHEN {CONFIDENCE_SQL} < 0.3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {CONFIDENCE_SQL} AS current_value FROM log WHERE {CONFIDENCE_SQL} < 0.5
  UNION ALL SELECT query_id, intent, ts, 'response_time', 'HIGH', k / CAST(20 AS DOUBLE) FROM log WHERE k / CAST(20 AS DOUBLE) > 4.8)"""


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    log = query_log(spark, d).select("query_id", F.col("intent").alias("component"), "ts", "cents", "k")
    # the log's slowest answers take 4.95 s: the limit of 5 s is moved to 4.8
    return A.quality_alerts(log, confidence(), F.when(F.col("k") / 20.0 > 4.8, F.col("k") / 20.0 + 0.2)).withColumn("current_value", F.when(F.col("metric") == "response_time", F.col("k") / 20.0).otherwise(F.col("current_value")))


@register("x04_alerts", f"WITH {LOG_SQL}, {_ALERTS} SELECT query_id, component, metric, severity, current_value FROM alerts")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).select("query_id", "component", "metric", "severity", "current_value")


@register("x07_alert_runs", f"""WITH {LOG_SQL}, {_ALERTS}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM alerts WINDOW w AS (PARTITION BY component, metric ORDER BY ts, query_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY component, metric ORDER BY ts, query_id) AS alert_no FROM n)
SELECT component, metric, CAST(alert_no AS BIGINT) AS alert_no, count(*) AS n_raised, arg_max(current_value, (ts, query_id)) AS current_value FROM g GROUP BY component, metric, alert_no""")
def alert_runs(spark: SparkSession, d: str) -> DataFrame:
    return A.deduplicated_alerts(_alerts(spark, d), ["component", "metric"], ["ts", "query_id"], 600, "ts").drop("first_at", "last_at")


@register("x10_sessions", f"""WITH {LOG_SQL}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM log),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM n) SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_interactions FROM g GROUP BY user_id, session_no""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return A.sessions(query_log(spark, d), ["user_id"], "ts").select("user_id", "session_no", "n_interactions")


_LABELLED = """f AS (SELECT *, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN rating >= 4 THEN CASE WHEN regexp_matches(low, 'fast|quick|speed') THEN 'performance_praise' WHEN regexp_matches(low, 'accurate|correct|right') THEN 'accuracy_praise' ELSE 'general_satisfaction' END
    WHEN rating <= 2 THEN CASE WHEN regexp_matches(low, 'slow|timeout|wait') THEN 'performance_complaint' WHEN regexp_matches(low, 'wrong|incorrect|bad') THEN 'accuracy_complaint' WHEN regexp_matches(low, 'confusing|unclear|hard') THEN 'usability_complaint' ELSE 'general_dissatisfaction' END
    ELSE 'neutral_feedback' END AS feedback_category FROM (SELECT *, lower(comment) AS low,
    len(list_filter(['good', 'great', 'excellent', 'helpful', 'accurate', 'fast', 'perfect', 'love', 'amazing'], lambda w: contains(lower(comment), w))) AS good,
    len(list_filter(['bad', 'terrible', 'wrong', 'slow', 'useless', 'hate', 'awful', 'poor', 'disappointing'], lambda w: contains(lower(comment), w))) AS bad FROM feedback))"""


@register("a17_feedback_summary", f"""WITH {FEEDBACK_SQL}, {_LABELLED}, s AS (SELECT count(*) AS n, CAST(sum(rating) AS BIGINT) AS s1, CAST(sum(rating * rating) AS BIGINT) AS s2, count(DISTINCT user_id) AS n_users, count(*) FILTER (sentiment = 'positive') AS n_positive,
  count(*) FILTER (sentiment = 'neutral') AS n_neutral, count(*) FILTER (sentiment = 'negative') AS n_negative, count(*) FILTER (length(comment) > 20) AS n_detailed FROM f)
SELECT n, s1 / CAST(n AS DOUBLE) AS mean_rating, sqrt((s2 * n - s1 * s1) / CAST(n * n AS DOUBLE)) AS std_rating, n_users, n_positive, n_neutral, n_negative, n_detailed FROM s""")
def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.summary(feedback(spark, d))


@register("a18_feedback_categories", f"WITH {FEEDBACK_SQL}, {_LABELLED} SELECT feedback_category, sentiment, count(*) AS n FROM f GROUP BY ALL")
def feedback_categories(spark: SparkSession, d: str) -> DataFrame:
    return B.labelled(feedback(spark, d)).groupBy("feedback_category", "sentiment").agg(F.count("*").alias("n"))


@register("a19_feedback_trend", f"WITH {FEEDBACK_SQL}, " + _HALVES.format(by="user_id", rows="feedback", v="rating", least=5, step="0.2"))
def feedback_trend(spark: SparkSession, d: str) -> DataFrame:
    return A.half_split(feedback(spark, d), ["user_id"], ["ts", "query_id"], "rating", 0.2, 5)


@register("a21_themes", rf"""WITH {FEEDBACK_SQL}, w AS (SELECT unnest(string_split_regex(lower(comment), '\s+')) AS word FROM feedback), c AS (SELECT word, count(*) AS n FROM w
  WHERE length(word) > 3 AND word NOT IN ('this', 'that', 'with', 'from', 'they', 'were', 'been', 'have', 'will') GROUP BY word ORDER BY n DESC, word LIMIT 5) SELECT * FROM c WHERE n > 1""")
def themes(spark: SparkSession, d: str) -> DataFrame:
    return B.themes(feedback(spark, d))


@register("a22_opportunities", f"""WITH {FEEDBACK_SQL}, {_LABELLED}, t AS (SELECT count(*) AS total, count(*) FILTER (sentiment = 'negative') AS neg FROM f),
c AS (SELECT feedback_category, count(*) AS n FROM f WHERE feedback_category LIKE '%complaint' OR feedback_category = 'general_dissatisfaction' GROUP BY ALL ORDER BY n DESC, feedback_category LIMIT 3)
SELECT feedback_category, n, CASE WHEN n > 0.1 * total THEN 'high' ELSE 'medium' END AS priority FROM c, t UNION ALL SELECT 'negative_sentiment', neg, 'high' FROM t WHERE neg > 0.2 * total""")
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    return B.opportunities(feedback(spark, d))


@register("a23_satisfaction", f"""WITH {FEEDBACK_SQL}, u AS (SELECT user_id, count(*) AS n, arg_min(rating, (ts, query_id)) AS first_rating, arg_max(rating, (ts, query_id)) AS last_rating FROM feedback GROUP BY user_id HAVING count(*) >= 2)
SELECT *, CASE WHEN last_rating - first_rating > 0.5 THEN 'improving' WHEN last_rating - first_rating < -0.5 THEN 'declining' ELSE 'stable' END AS trend FROM u""")
def satisfaction(spark: SparkSession, d: str) -> DataFrame:
    return B.satisfaction(feedback(spark, d))


@register("a24_user_summary", f"""WITH {FEEDBACK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, query_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query_id DESC) AS down FROM feedback)
SELECT user_id, count(*) AS n, CAST(sum(rating) AS BIGINT) AS total, min(rating) AS least, max(rating) AS most, sum(rating) FILTER (up <= 3) / CAST(count(*) FILTER (up <= 3) AS DOUBLE) AS first_three, sum(rating) FILTER (down <= 3) / CAST(count(*) FILTER (down <= 3) AS DOUBLE) AS last_three FROM r GROUP BY user_id""")
def user_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.user_summary(feedback(spark, d))


_BUCKET = "CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || '_' || 'test_a'), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"


@register("m08_assignment", f"SELECT user_id, {_BUCKET} AS bucket, CASE WHEN {_BUCKET} < 0.5 THEN 'treatment' ELSE 'control' END AS grp FROM (SELECT DISTINCT user_id FROM events)")
def assignment(spark: SparkSession, d: str) -> DataFrame:

    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", E.bucket(F.col("user_id"), F.lit("test_a")).alias("bucket"), E.group_of(F.col("user_id"), F.lit("test_a")).alias("grp"))


_RESULTS = f"""results AS (SELECT intent AS test_id, CASE WHEN {_BUCKET} < 0.5 THEN 'treatment' ELSE 'control' END AS grp, metric, v AS value FROM log, LATERAL (VALUES ('confidence', cents), ('response_time', CAST(k AS BIGINT))) AS m(metric, v)),
compared AS (SELECT test_id, metric, count(*) FILTER (grp = 'control') AS n_control, count(*) FILTER (grp = 'treatment') AS n_treatment, sum(value) FILTER (grp = 'control') / CAST(count(*) FILTER (grp = 'control') AS DOUBLE) AS control_mean,
  sum(value) FILTER (grp = 'treatment') / CAST(count(*) FILTER (grp = 'treatment') AS DOUBLE) AS treatment_mean FROM results GROUP BY ALL),
gains AS (SELECT *, CASE WHEN control_mean > 0 THEN (treatment_mean - control_mean) / control_mean * 100 ELSE 0 END AS improvement FROM compared)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    log = query_log(spark, d)
    pair = F.explode(F.array(F.struct(F.lit("confidence").alias("metric"), F.col("cents").alias("value")), F.struct(F.lit("response_time").alias("metric"), F.col("k").cast("long").alias("value"))))
    return log.select(F.col("intent").alias("test_id"), E.group_of(F.col("user_id"), F.lit("test_a")).alias("grp"), pair.alias("m")).select("test_id", "grp", "m.*")


@register("a31_ab_test", f"WITH {LOG_SQL}, {_RESULTS} SELECT *, abs(improvement) > 5 AS significant FROM gains")
def ab_test(spark: SparkSession, d: str) -> DataFrame:
    return E.compare(_results(spark, d))


@register("a31_ab_decision", f"""WITH {LOG_SQL}, {_RESULTS}, g AS (SELECT test_id, count(*) FILTER (improvement > 5) AS n_positive, count(*) AS n_metrics FROM gains GROUP BY test_id)
SELECT *, CASE WHEN n_positive >= 2 THEN 'implement_treatment' WHEN n_positive = 1 THEN 'continue_testing' ELSE 'keep_control' END AS decision FROM g""")
def ab_decision(spark: SparkSession, d: str) -> DataFrame:
    return E.decide(E.compare(_results(spark, d)))


@register("g02_failed_logins", """WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS failures FROM events)
SELECT event_id, CAST(failures AS BIGINT) AS failures, CASE WHEN failures >= 5 THEN 'critical' WHEN failures >= 3 THEN 'high' ELSE 'medium' END AS severity FROM e WHERE event_type = 'error'""")
def failed_logins(spark: SparkSession, d: str) -> DataFrame:

    window = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("failures", F.sum((F.col("event_type") == "error").cast("int")).over(window)).where("event_type = 'error'")
    return rows.select("event_id", "failures", F.when(F.col("failures") >= 5, "critical").when(F.col("failures") >= 3, "high").otherwise("medium").alias("severity"))


@register("m06_response_quality", """WITH a AS (SELECT conv_id, turn, text, length(trim(text)) AS n, turn % 4 AS sources, turn % 3 = 0 AS ctx, turn % 5 = 0 AS fb FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, CAST((turn * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf FROM a)
SELECT conv_id, turn, CASE WHEN sources = 0 THEN CAST(0.3 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), conf + least(CAST(0.2 AS DOUBLE), CAST(0.05 AS DOUBLE) * sources) + CASE WHEN ctx THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END - CASE WHEN fb THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) END AS relevance,
  CASE WHEN n < 20 THEN CAST(0.2 AS DOUBLE) WHEN n < 50 THEN CAST(0.5 AS DOUBLE) WHEN n < 200 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS completeness, CASE WHEN conf >= 0.7 THEN 'semantic' WHEN conf >= 0.3 THEN 'partial' ELSE 'fallback' END AS response_type,
  length(text) > 1000 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100)) > 10 OR len(regexp_extract_all(text, 'Q:')) > 1 AS dumped FROM s""")
def response_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumn("conf", F.col("turn") * 37 % 100 / F.lit(100.0))
    turn = F.col("turn")
    return rows.select(
        "conv_id", "turn", Y.relevance(F.col("conf"), turn % 4, turn % 3 == 0, turn % 5 == 0).alias("relevance"), Y.completeness(F.col("text")).alias("completeness"),
        Y.response_type(F.col("conf")).alias("response_type"), Y.looks_dumped(F.col("text")).alias("dumped"),
    )


@register("x12_retraining", f"""WITH {LOG_SQL}, s AS (SELECT user_id, count(*) AS n, sum(cents) / (count(*) * CAST(50000 AS DOUBLE)) AS conf, sum(k % 5 + 1) / CAST(count(*) AS DOUBLE) AS rating FROM log GROUP BY user_id)
SELECT user_id, n, CASE WHEN n >= 100 THEN CASE WHEN conf < 0.6 THEN 'low_confidence' WHEN rating < 3 THEN 'low_satisfaction' END END AS reason FROM s""")
def retraining(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    out = query_log(spark, d).groupBy("user_id").agg(n.alias("n"), (F.sum("cents") / (n * F.lit(50000.0))).alias("conf"), (F.sum(F.col("k") % 5 + 1) / n).alias("rating"))
    return out.select("user_id", "n", Y.needs_retraining(F.col("n"), F.col("conf"), F.col("rating")).alias("reason"))


@register("x13_long_sessions", f"""WITH {LOG_SQL}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 240 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM n), s AS (SELECT user_id, session_no, count(*) AS n, max(ts) - min(ts) > INTERVAL 8 HOUR AS too_long FROM g GROUP BY user_id, session_no)
SELECT user_id, count(*) AS n_sessions, count(*) FILTER (too_long) AS n_too_long, max(n) AS most FROM s GROUP BY user_id""")
def long_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = A.sessions(query_log(spark, d), ["user_id"], "ts", 240)
    too_long = F.unix_micros("last_activity") - F.unix_micros("started_at") > 8 * 3_600_000_000
    return found.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.count(F.when(too_long, 1)).alias("n_too_long"), F.max("n_interactions").alias("most"))


@register("x09_retention", f"WITH {LOG_SQL} SELECT intent, count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 15 DAY GROUP BY intent")
def retention(spark: SparkSession, d: str) -> DataFrame:
    recent = query_log(spark, d).where(F.col("ts") >= F.lit("2024-02-01").cast("timestamp") - F.expr("interval 15 days"))
    return recent.groupBy("intent").agg(F.count("*").alias("n"))


@register("a31_welch")
def welch(spark: SparkSession, d: str) -> DataFrame:
    return E.welch(_results(spark, d)).select("test_id", "metric", "n_control", "n_treatment")
