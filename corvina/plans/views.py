"""The tables that queries run on, as a knowledge base, a query log and conversations see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T
from corvina.session import table

#: "Now" of every query: the clock is an argument, never the machine's.
AS_OF = "2024-02-01 00:00:00"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: the first sentence asks, the rest answers."""
    first = F.regexp_extract("text", r"^([^.!?\n]*[.!?]?)", 1)
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.btrim(first).alias("question"),
        F.btrim(F.substring("text", F.length(first) + 1, F.length("text"))).alias("answer"),
        F.col("source").alias("category"),
        F.col("lang").alias("audience"),
        F.when(F.col("doc_id") % 4 == 0, "info").when(F.col("doc_id") % 4 == 1, "process").otherwise("policy").alias("intent"),
        F.when(F.col("doc_id") % 5 == 0, "urgent").otherwise("default").alias("condition"),
        (F.col("n_chars") % 100 / 100.0).alias("confidence"),
        F.date_sub(F.to_date(F.lit(AS_OF)), (F.col("doc_id") % 400).cast("int")).alias("updated_on"),
    )


ENTRIES_SQL = rf"""
entries AS (SELECT doc_id AS id, trim(regexp_extract(text, '^([^.!?\n]*[.!?]?)', 1)) AS question,
  trim(substr(text, length(regexp_extract(text, '^([^.!?\n]*[.!?]?)', 1)) + 1)) AS answer, source AS category, lang AS audience,
  CASE doc_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'process' ELSE 'policy' END AS intent,
  CASE WHEN doc_id % 5 = 0 THEN 'urgent' ELSE 'default' END AS condition,
  CAST(n_chars % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, DATE '2024-02-01' - CAST(doc_id % 400 AS INT) AS updated_on FROM documents)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answered queries. ``cents`` is the confidence in units of 1/50000, ``k`` the
    response time in units of 50 ms: sums of whole numbers come out alike in any order."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), "user_id", F.col("event_type").alias("intent"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"), k.alias("k")
    )


LOG_SQL = r"""
log AS (SELECT event_id AS query_id, user_id, event_type AS intent, ts, CAST(round(value * 100) AS BIGINT) AS cents, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views as ratings 1 to 5 with a comment drawn from a fixed list."""
    comments = ["Excellent and fast", "Good answer", "Too slow", "Completely wrong", "Confusing page", "Average", "Helpful and accurate response", "Bad, I had to wait"]
    log = query_log(spark, sf_dir).where(F.col("intent").isin("purchase", "view"))
    comment = F.element_at(F.array(*map(F.lit, comments)), (F.col("query_id") % 8 + 1).cast("int"))
    return log.select("query_id", "user_id", "ts", (F.col("k") % 5 + 1).alias("rating"), comment.alias("comment"))


FEEDBACK_SQL = (
    LOG_SQL
    + """,
feedback AS (SELECT query_id, user_id, ts, k % 5 + 1 AS rating, ['Excellent and fast', 'Good answer', 'Too slow', 'Completely wrong', 'Confusing page', 'Average',
  'Helpful and accurate response', 'Bad, I had to wait'][CAST(query_id % 8 + 1 AS INT)] AS comment FROM log WHERE intent IN ('purchase', 'view'))"""
)

# --- oracles of text functions that several queries share ---

#: Letters, digits and what belongs to words, as a class of characters.
WORD_CLASS = r"\p{L}\p{N}\p{M}_"


def quoted(words: list[str]) -> str:
    return "'" + "', '".join(word.replace("'", "''") for word in words) + "'"


def stem_sql(word: str) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{s}') AND length({word}) >= {len(s) + 3} THEN CASE WHEN ends_with(left({word}, -{len(s)}), 'at') THEN left({word}, -{len(s)}) || 'e' ELSE left({word}, -{len(s)}) END" for s in L.SUFFIXES)
    return f"CASE {cases} ELSE {word} END"


def matcher_keywords_sql(text: str) -> str:
    kept = rf"list_filter(string_split_regex(lower({text}), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(L.MATCHER_STOP)}))"
    return f"list_distinct(list_concat({kept}, list_transform({kept}, lambda x: {stem_sql('x')})))"


def rewritten_sql(text: str, rules: list[tuple[str, str]]) -> str:
    """Rules applied one after the other, without regard to case."""
    for pattern, into in rules:
        pattern = pattern.replace(r"(\w+)", f"([{WORD_CLASS}]+)").replace("'", "''")
        into = into.replace("$", chr(92)).replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{into}', 'gi')"
    return text
