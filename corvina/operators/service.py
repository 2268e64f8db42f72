"""Operation of a question-and-answer service: reports, alerts, answers, learning and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.operators.analytics import confidence_bucket


def share(condition: Column) -> Column:
    return F.count(F.when(condition, 1)) / F.count("*")


def performance(log: DataFrame, confidence: Column, seconds: Column, by: list[str]) -> DataFrame:
    """Per group, in one pass: how many answers, their least and largest confidence, the shares of
    successful (over 0.5), high and failed ones, of each confidence class, and the slowest."""
    bucket = confidence_bucket(confidence)
    classes = [F.count(F.when(bucket == name, 1)).alias(f"n_{name}") for name in ("high", "medium", "low")]
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.min(confidence).alias("least"), F.max(confidence).alias("most"), share(confidence > 0.5).alias("success_rate"), share(confidence > 0.8).alias("high_rate"), share(confidence < 0.3).alias("failure_rate"), *classes, F.max(seconds).alias("slowest"))


def advice(one: DataFrame) -> DataFrame:
    """An array advice for each row (mean_confidence, mean_seconds, low_share, error_rate, n_alerts)."""
    rules = [("improve_confidence", F.col("mean_confidence") < 0.6), ("speed_up", F.col("mean_seconds") > 2.0), ("extend_entries", F.col("low_share") > 0.2), ("fix_errors", F.col("error_rate") > 0.05), ("look_into_alerts", F.col("n_alerts") > 5)]
    return one.withColumn("advice", F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules])))


def health_alerts(rows: DataFrame, error_rate: Column, status: Column) -> DataFrame:
    """One row per alert: error rate over 0.15 (CRITICAL) or 0.05 (MEDIUM), status unhealthy (HIGH)."""
    alert = lambda metric, severity: F.struct(F.lit(metric).alias("metric"), severity.alias("severity"))
    found = F.array(F.when(error_rate > 0.05, alert("error_rate", F.when(error_rate > 0.15, "CRITICAL").otherwise("MEDIUM"))), F.when(status == "unhealthy", alert("status", F.lit("HIGH"))))
    return rows.withColumn("_a", F.explode(F.array_compact(found))).select("*", "_a.*").drop("_a")


def stale(rows: DataFrame, by: str, ts: str, as_of: str, minutes: int = 5) -> DataFrame:
    """Keys without a row in the last ``minutes`` before ``as_of``, and how long they have been silent."""
    last = rows.groupBy(by).agg(F.max(ts).alias("last_at"))
    silent = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last_at")
    return last.withColumn("silent_seconds", silent).where(F.col("silent_seconds") > 60 * minutes)


def busy_and_slow(rows: DataFrame, ts: str, seconds: Column, n: int, limit: float, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding windows with more than ``n`` answers whose mean time is over the limit."""
    grouped = rows.groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("n"), (F.sum(seconds) / F.count("*")).alias("mean_seconds"))
    return grouped.where((F.col("n") > n) & (F.col("mean_seconds") > limit)).select(F.col("window.start").alias("window_start"), "n", "mean_seconds")


def resolved(alerts: DataFrame, resolutions: DataFrame, by: list[str]) -> DataFrame:
    """Alerts (by, raised_at) with resolved_at: the first resolution of their key at or after they were
    raised. Both are put in one order per key, so that no alert meets all resolutions of its key."""
    a = alerts.withColumn("_at", F.col("raised_at")).withColumn("_r", F.lit(None).cast("timestamp"))
    r = resolutions.select(*by, F.col("resolved_at").alias("_at"), F.col("resolved_at").alias("_r"))
    later = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("_r").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(r, allowMissingColumns=True).withColumn("resolved_at", F.last("_r", ignorenulls=True).over(later))
    return both.where("raised_at is not null").drop("_at", "_r")


def answers(found: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, answer, method, confidence, n_sources for every query (qid, text) from its retrieved rows (qid,
    rn, answer): the one answer, several with their numbers, or that there is none."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("rn", "answer"))), lambda x: x["answer"])
    grouped = found.where("answer is not null and trim(answer) <> ''").groupBy("qid").agg(told.alias("told"))
    n = F.coalesce(F.size("told"), F.lit(0))
    several = F.array_join(F.transform("told", lambda x, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(": "), x)), "\n\n")
    out = queries.join(grouped, "qid", "left").withColumn("n_sources", F.when(F.col("told").isNull(), 0).otherwise(n))
    text = F.when(F.col("n_sources") == 0, F.concat(F.lit("No entry answers: "), F.col("text"))).when(F.col("n_sources") == 1, F.get("told", F.lit(0))).otherwise(several)
    method = F.when(F.col("n_sources") == 0, "fallback").when(F.col("n_sources") == 1, "direct").otherwise("synthesis")
    return out.select("qid", text.alias("answer"), method.alias("method"), F.when(F.col("n_sources") == 0, 0.1).otherwise(0.9).alias("basic"), "n_sources")


def answer_confidence(basic: Column, method: Column, text: Column, used_context: Column) -> Column:
    """The basic confidence, 0.1 more for retrieval, 0.05 for over 50 characters, 0.1 for context, at most 1."""
    return F.least(F.lit(1.0), basic + F.when(method == "rag", 0.1).otherwise(0.0) + F.when(F.length(text) > 50, 0.05).otherwise(0.0) + F.when(used_context, 0.1).otherwise(0.0))


def prompt(question: Column, context: Column) -> Column:
    """The text that a language model would be given: the question, the context, and how to use it."""
    known = F.when(F.coalesce(F.trim(context), F.lit("")) == "", "[none]").otherwise(context)
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nContext:\n"), known, F.lit("\n\nAnswer from the context; say so if it isn't there."))


def learn_keywords(entries: DataFrame, praised: DataFrame) -> DataFrame:
    """``entries`` (id, keywords as an array) with the keywords of queries (id, text) that were answered well
    by them added behind, each once."""
    new = praised.select("id", F.explode(T.matcher_keywords(F.col("text"))).alias("word")).distinct()
    learnt = new.groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("_new"))
    added = F.array_except(F.coalesce("_new", F.array().cast("array<string>")), F.transform("keywords", F.lower))
    return entries.join(learnt, "id", "left").withColumn("keywords", F.concat("keywords", added)).drop("_new")


def match_explanation(query: Column, question: Column, keywords: Column) -> Column:
    """A struct matched (keywords in common) and overlap of a query and an entry."""
    own, known = T.matcher_keywords(query), F.array_union(T.matcher_keywords(question), T.matcher_keywords(keywords))
    return F.struct(F.sort_array(F.array_intersect(own, known)).alias("matched"), T.containment(own, known).alias("overlap"))


def seems_encrypted(value: Column) -> Column:
    """Over 80 characters of url-safe base64 that hold 60 bytes or more, and neither an address nor a name."""
    address = value.contains("@") & value.contains(".") & (F.length(value) < 100)
    name = F.regexp_replace(value, "[ '-]", "").rlike(r"^\p{L}+$") & (F.length(value) < 100)
    value = F.regexp_replace(value, "[\\r\\n]", "")
    coded = value.rlike("^[A-Za-z0-9_-]+={0,2}$") & (F.length(value) % 4 == 0) & (F.floor(F.length(F.regexp_replace(value, "=", "")) * 6 / 8) >= 60)
    return F.coalesce(~address & ~name & coded & (F.length(value) > 80), F.lit(False))


def encrypted(value: Column, key: Column) -> Column:
    """AES-GCM under the key (16, 24 or 32 bytes), as base64; null for null."""
    return F.base64(F.aes_encrypt(value.cast("binary"), key))


def decrypted(value: Column, key: Column) -> Column:
    """The text of ``encrypted``; null for what isn't one, or under another key."""
    return F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), key).cast("string")


def composite_filter(audience: str | None = None, category: str | None = None, intent: str | None = None, condition: str | None = None, confidence: float | None = None, keywords: list[str] | None = None) -> Column:
    """Entries that a filter lets through. Wildcards (any; general; information, any, all; *, default)
    filter nothing, and entries' own wildcards pass every filter but that of the category."""
    keep = F.lit(True)
    if audience and audience != "any":
        keep = keep & F.col("audience").isin(audience, "any")
    if category and category != "general":
        keep = keep & (F.col("category") == category)
    if intent and intent not in ("information", "any", "all"):
        keep = keep & F.col("intent").isin(intent, "information", "any")
    if condition and condition not in ("*", "default"):
        keep = keep & F.col("condition").isin(condition, "default")
    if confidence:
        keep = keep & (F.col("confidence") >= confidence)
    if keywords:
        keep = keep & F.arrays_overlap(F.transform("keywords", F.lower), F.array(*[F.lit(w.lower()) for w in keywords]))
    return keep


def query_errors(text: Column) -> Column:
    """What is wrong with a query, as an array: empty, short, long, odd characters, many words."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.array_compact(F.array(F.when(n == 0, "empty"), F.when((n > 0) & (n < 2), "short"), F.when(n > 1000, "long"), F.when(text.rlike(r"[<>{}\[\]\\]"), "characters"), F.when(F.size(T.words(text)) > 100, "words")))


def keyword_counts(rows: DataFrame, by: str, text: str, k: int) -> DataFrame:
    """Per group, the k most frequent keywords of its texts, ties to the word that sorts first."""
    words = rows.select(by, F.explode(F.filter(T.tokens(F.col(text)), lambda w: F.length(w) > 3)).alias("word"))
    counts = words.groupBy(by, "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rn", place).where(F.col("rn") <= k)


def with_versions(versions: DataFrame, keep: int) -> DataFrame:
    """Versions (version_id, created_at, is_active) with is_current, the newest active one, and kept: whether
    they are among the newest ``keep``."""
    place = F.struct("created_at", "version_id")
    # two values and at most ``keep`` rows, found by partial aggregates and sorts: no task has all versions
    edge = versions.orderBy(F.desc("created_at"), F.desc("version_id")).limit(keep).agg(F.min(place).alias("_edge"))
    first = versions.where("is_active").agg(F.max(place).alias("_first"))
    both = versions.join(F.broadcast(edge), how="cross").join(F.broadcast(first), how="cross")
    return both.select(*versions.columns, F.coalesce(place == F.col("_first"), F.lit(False)).alias("is_current"), F.coalesce(place >= F.col("_edge"), F.lit(False)).alias("kept"))


def rolled_back(versions: DataFrame, to: str) -> DataFrame:
    """A row that records the step from the current version to an older one: from_version, to_version."""
    current = with_versions(versions, 1).where("is_current").select(F.col("version_id").alias("from_version"))
    target = versions.where(F.col("version_id") == to).select(F.col("version_id").alias("to_version"))
    return current.crossJoin(target)


def overdue_tests(tests: DataFrame, as_of: str) -> DataFrame:
    """A/B tests (test_id, status, started_at, days) with status completed where a running one is past its end."""
    ends = F.unix_seconds("started_at") + F.col("days") * 86400
    return tests.withColumn("status", F.when((F.col("status") == "running") & (ends < F.unix_seconds(F.lit(as_of).cast("timestamp"))), "completed").otherwise(F.col("status")))
