"""Filters, joins, rankings and reports over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.plans.views import ENTRIES_SQL, LOG_SQL, entries, query_log
from corvina.registry import register
from corvina.session import table
from corvina.sources import store


@register("f01_search_text", f"WITH {ENTRIES_SQL} SELECT id, category FROM entries WHERE lower(question) LIKE '%the%' OR lower(answer) LIKE '%tion of%'")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(F.lower("question").contains("the") | F.lower("answer").contains("tion of")).select("id", "category")


@register("f02_list_entries", f"WITH {ENTRIES_SQL} SELECT id, question FROM entries WHERE category = 'src3' AND (lower(question) LIKE '%an%' OR lower(answer) LIKE '%an%') ORDER BY confidence DESC, id LIMIT 20")
def list_entries(spark: SparkSession, d: str) -> DataFrame:
    found = entries(spark, d).where((F.col("category") == "src3") & (F.lower("question").contains("an") | F.lower("answer").contains("an")))
    return found.orderBy(F.desc("confidence"), "id").limit(20).select("id", "question")


@register("f03_list_documents", "SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).crossJoin(F.broadcast(total))


@register("f04_admin_filter", f"WITH {ENTRIES_SQL} SELECT id, length(answer) AS answer_length FROM entries WHERE length(answer) >= 500 AND question <> '' AND audience = 'de' ORDER BY length(answer) DESC, id LIMIT 25")
def admin_filter(spark: SparkSession, d: str) -> DataFrame:
    found = entries(spark, d).where((F.length("answer") >= 500) & (F.col("question") != "") & (F.col("audience") == "de"))
    return found.select("id", F.length("answer").alias("answer_length")).orderBy(F.desc("answer_length"), "id").limit(25)


@register("f05_history_between", "SELECT c.c_custkey, o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE lower(c_name) LIKE '%1%' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def history_between(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    recent = table(spark, d, "orders").where(day.between(F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date")))
    users = table(spark, d, "customer").where(F.lower("c_name").contains("1"))
    return users.join(recent, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@register("f06_log_range", f"WITH {LOG_SQL} SELECT query_id, intent, cents FROM log WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def log_range(spark: SparkSession, d: str) -> DataFrame:
    return query_log(spark, d).where((F.col("ts") >= "2024-01-10") & (F.col("ts") <= "2024-01-12")).select("query_id", "intent", "cents")


@register("f17_recommendations", """SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END AS priority_rank,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS age_days FROM orders WHERE o_orderstatus = 'O' ORDER BY priority_rank DESC, o_totalprice DESC, o_orderkey LIMIT 100""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    rank = F.when(first == "1", 4).when(first == "2", 3).when(first == "3", 2).otherwise(1)
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").withColumn("priority_rank", rank)
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")).cast("long")
    return rows.orderBy(F.desc("priority_rank"), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "priority_rank", age.alias("age_days"))


@register("j05_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def inner(spark: SparkSession, d: str) -> DataFrame:
    # nation has 25 rows by definition of the schema
    nations = table(spark, d, "nation").where("n_regionkey = 2")
    users = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(users, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@register("j06_left_outer", """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, a.turn AS answer_turn, length(a.text) AS answer_length FROM u LEFT JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1""")
def left_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn")
    answered = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("answer_turn"), F.length("text").cast("long").alias("answer_length"))
    return asked.join(answered, ["conv_id", "turn"], "left")


@register("j07_unanswered", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unanswered(spark: SparkSession, d: str) -> DataFrame:
    placed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(placed, "c_custkey", "left_anti").select("c_custkey", "c_name")


@register("j09_known_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def known_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return table(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "lang")


@register("j10_match_counts", "SELECT p_partkey, count(*) AS query_matches, max(l_shipdate) AS last_matched FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def match_counts(spark: SparkSession, d: str) -> DataFrame:
    # counted before the join: the bridge shrinks to a row per entry on the map side
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("query_matches"), F.max("l_shipdate").alias("last_matched"))
    return table(spark, d, "part").select("p_partkey").join(counts, "p_partkey")


@register("j11_activity", """SELECT c_custkey, count(DISTINCT o_orderkey) AS n_requests, count(l_linenumber) AS n_responses, max(o_orderdate) AS last_request
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def activity(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    placed = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate").join(lines, "o_orderkey", "left")
    per_user = placed.groupBy("c_custkey").agg(F.count("*").alias("n_requests"), F.sum(F.coalesce("n", F.lit(0))).alias("n_responses"), F.max("o_orderdate").alias("last_request"))
    out = table(spark, d, "customer").select("c_custkey").join(per_user, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_responses", F.lit(0)).alias("n_responses"), "last_request")


@register("j21_latest_request", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def latest_request(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@register("a34_dashboard", """SELECT (SELECT count(*) FROM customer) AS n_users, (SELECT count(*) FROM orders) AS n_requests, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_answered,
  (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS n_recent, (SELECT count(DISTINCT l_orderkey) FROM lineitem) * 100 / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS response_rate""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").agg(F.count("*").alias("n_users"))
    asked = table(spark, d, "orders").agg(F.count("*").alias("n_requests"), F.count(F.when(F.col("o_orderdate") >= "1998-01-01", 1)).alias("n_recent"))
    answered = table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n_answered"))
    one = users.crossJoin(asked).crossJoin(answered)  # one row each
    return one.withColumn("response_rate", F.col("n_answered") * 100 / F.col("n_requests"))


@register("a35_daily_timeline", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)")
def daily_timeline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@register("a36_conversation_stats", """WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered FROM conversations GROUP BY conv_id)
SELECT count(*) AS n_sessions, CAST(sum(asked) AS BIGINT) AS n_requests, CAST(sum(answered) AS BIGINT) AS n_responses, sum(answered) * 100 / CAST(sum(asked) AS DOUBLE) AS response_rate FROM s""")
def conversation_stats(spark: SparkSession, d: str) -> DataFrame:
    role = lambda x: F.count(F.when(F.col("role") == x, 1))
    per = table(spark, d, "conversations").groupBy("conv_id").agg(role("user").alias("asked"), role("assistant").alias("answered"))
    out = per.agg(F.count("*").alias("n_sessions"), F.sum("asked").alias("n_requests"), F.sum("answered").alias("n_responses"))
    return out.withColumn("response_rate", F.col("n_responses") * 100 / F.col("n_requests"))


@register("a37_entry_stats", f"""WITH {ENTRIES_SQL} SELECT category, count(*) AS n, count(*) FILTER (question <> '') AS n_with_question, CAST(sum(length(answer)) AS BIGINT) AS answer_chars, count(DISTINCT audience) AS n_audiences FROM entries GROUP BY category""")
def entry_stats(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(F.col("question") != "", 1)).alias("n_with_question"), F.sum(F.length("answer")).alias("answer_chars"), F.count_distinct("audience").alias("n_audiences"))


@register("a40_cube_categories", f"WITH {ENTRIES_SQL} SELECT audience, intent, count(*) AS n FROM entries GROUP BY CUBE (audience, intent)")
def cube_categories(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).cube("audience", "intent").agg(F.count("*").alias("n"))


@register("o10_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 20 OFFSET 40")
def page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.desc("c_name"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@register("w15_page_of_groups", "SELECT c_nationkey, c_custkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn BETWEEN 6 AND 10")
def page_of_groups(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").withColumn("rn", place.cast("long")).where(F.col("rn").between(6, 10)).select("c_nationkey", "c_custkey", "rn")


@register("u01_union_distinct", "SELECT lower(lang) AS name FROM documents UNION SELECT lower(role) FROM conversations")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lower("lang").alias("name")).union(table(spark, d, "conversations").select(F.lower("role"))).distinct()


@register("src10_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@register("src11_changed_documents", "SELECT doc_id AS document FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.md5(F.col("text").cast("binary")).alias("hash"))
    # the state lacks every third document and has an older version of every seventh
    state = docs.where("document % 3 <> 0").withColumn("hash", F.when(F.col("document") % 7 == 0, "old").otherwise(F.col("hash")))
    return store.changed(docs, state).select("document")


_VECTORS = "v AS (SELECT vec_id AS id, vec_id % 40 AS document, label, embedding FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 40).alias("document"), "label", "embedding")


@register("src15_upsert", f"WITH {_VECTORS} SELECT id, document, label FROM v WHERE document >= 10 UNION ALL SELECT id + 1000000, document, label FROM v WHERE document < 10 AND id % 2 = 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    new = v.where("document < 10").withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding"))).withColumn("id", F.col("id") + 1000000)
    return store.upsert(v, new).select("id", "document", "label")


@register("src16_update", f"WITH {_VECTORS} SELECT id, CASE WHEN id % 5 = 0 THEN -1 ELSE label END AS label FROM v")
def update(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    changes = v.where("id % 5 = 0").select("id", F.lit(-1).alias("label")).union(spark.range(1).select(F.lit(-99).cast("long").alias("id"), F.lit(7).alias("label")))
    return store.update(v, changes, "label").select("id", "label")


@register("src18_remove_document", f"WITH {_VECTORS} SELECT document, count(*) AS n FROM v WHERE document NOT IN (3, 4) GROUP BY document")
def remove_document(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.range(3, 5).select(F.col("id").alias("document"))
    return store.remove(_vectors(spark, d), gone, "document").groupBy("document").agg(F.count("*").alias("n"))


@register("src25_last_values", f"WITH {LOG_SQL} SELECT intent, query_id FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY ts DESC, query_id DESC) AS rn FROM log) WHERE rn <= 100")
def last_values(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(query_log(spark, d).select("intent", "ts", "query_id"), ["intent"], [F.desc("ts"), F.desc("query_id")], 100).select("intent", "query_id")


@register("sink01_export", f"WITH {ENTRIES_SQL} SELECT id, length(question) AS question_length, length(answer) AS answer_length FROM entries")
def export(spark: SparkSession, d: str) -> DataFrame:
    rows = store.export_rows(entries(spark, d).withColumn("keywords", F.array().cast("array<string>")))
    return rows.select("id", F.col("question_length").cast("long").alias("question_length"), F.col("answer_length").cast("long").alias("answer_length"))


@register("sink05_merge", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_suppkey <= 5")
def merge(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    source = target.where("id % 2 = 0").withColumn("name", F.upper("name")).unionByName(target.where("id <= 5").withColumn("id", F.col("id") + 1000000))
    return store.merge(target, source, "id")


@register("r03_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
