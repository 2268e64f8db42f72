"""Temporal URL lists: every capture is judged by the list entries that were active when it was fetched.

Dated entries (a host or domain is listed or delisted at a time) become validity intervals per
pattern. A capture's host gives its candidate patterns: itself and its parent domains, as many rows
as it has labels. An as-of equi-join on the pattern finds the interval that holds the fetch time.
Intervals of a pattern don't overlap, so a capture has at most one row per label after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import cut_lineage, small_side


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and a leading www.; null if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^www\.", ""), r"\.$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, at least two labels each (a host of one label: itself)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNotNull(), tails)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: open) from entries (pattern, category, action
    'add' or 'remove', at). An entry holds until the pattern's next one. Of entries of one pattern
    and time the removal counts, then the smaller category; rows with a null pattern or time, or
    another action, are void."""
    dated = entries.where("pattern is not null and at is not null and action in ('add', 'remove')")
    one = dated.groupBy("pattern", "at").agg(F.max("action").alias("action"), F.min("category").alias("category"))
    following = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    spans = one.withColumn("valid_to", following).where("action = 'add'")
    return spans.select("pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """A row for each row of ``captures`` (url, fetched_at and any other columns, which stay) with n_active
    (patterns of the host that were listed at fetched_at), blocked, pattern (the longest of them, null
    if none), category, listed_at; columns of these names are replaced. Rows with the same id, or
    without one, are judged one by one. A capture with a null url or time, or no host in its url, meets
    no entry and isn't blocked. Both ends of an interval: valid_from <= fetched_at < valid_to.

    Captures are written once, so that their row numbers hold. Intervals are broadcast if they are few."""
    added = ["n_active", "blocked", "pattern", "category", "listed_at"]
    rows = cut_lineage(captures.select(F.struct(*[captures[c] for c in captures.columns if c not in added]).alias("row"), F.monotonically_increasing_id().alias("_row")))
    named = rows.select("_row", F.col("row.fetched_at").alias("fetched_at"), F.explode(domains_of(url_host(F.col("row.url")))).alias("domain"))
    spans = small_side(cut_lineage(intervals.select("pattern", "category", "valid_from", "valid_to"))).alias("i")
    active = (named["domain"] == F.col("i.pattern")) & (F.col("i.valid_from") <= named["fetched_at"]) & (F.col("i.valid_to").isNull() | (named["fetched_at"] < F.col("i.valid_to")))
    hits = named.join(spans, active).groupBy("_row").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("pattern").alias("n"), "pattern", "category", "valid_from")).alias("hit"))
    n_active = F.coalesce("n_active", F.lit(0)).alias("n_active")
    return rows.join(hits, "_row", "left").select("row.*", n_active, F.col("hit").isNotNull().alias("blocked"), F.col("hit.pattern").alias("pattern"), F.col("hit.category").alias("category"), F.col("hit.valid_from").alias("listed_at"))


# --- the query: `pages` has neither fetch times nor a list, so both are derived from its own rows ---

DAYS = 360
EPOCH = 1704067200


def _code(tag: str, text: Column) -> Column:
    """The first 32 bits of md5 of the tag and the text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(tag), text.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def _day(tag: str, text: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + _code(tag, text) % DAYS * 86400)


def page_captures(pages: DataFrame) -> DataFrame:
    """Each page's fetch time: noon of a day of 2024 that a hash of its id gives."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", (_day("fetch:", F.col("page_id")) + F.expr("interval 12 hours")).alias("fetched_at"))


def page_list(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts and domains of ``pages``: of those that a hash picks, a third,
    each is listed on one day, delisted on another and, every second one, listed again."""
    names = pages.select(F.explode(domains_of(url_host(F.col("url")))).alias("pattern")).distinct()
    names = names.withColumn("code", _code("list:", F.col("pattern"))).where("code % 3 = 0")
    kind = F.element_at(F.array(F.lit("ads"), F.lit("malware"), F.lit("spam")), (F.floor(F.col("code") / 3) % 3 + 1).cast("int"))
    entry = lambda tag, action: F.struct(F.lit(action).alias("action"), _day(tag, F.col("pattern")).alias("at"))
    twice = F.array(entry("a:", "add"), entry("b:", "remove"))
    entries = F.when(F.col("code") % 2 == 0, F.array_append(twice, entry("c:", "add"))).otherwise(twice)
    return names.select("pattern", kind.alias("category"), F.explode(entries).alias("e")).select("pattern", "category", "e.*")


def _sql_code(tag: str, text: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}' || CAST({text} AS VARCHAR)), 1, 8) AS BIGINT)"


def _sql_day(tag: str, text: str) -> str:
    return f"(TIMESTAMP '2024-01-01' + to_days(CAST({_sql_code(tag, text)} % {DAYS} AS INT)))"


ORACLE = rf"""
WITH named AS (SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', ''), '\.$', ''), '') AS host FROM pages),
domains AS (SELECT page_id, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain FROM named),
names AS (SELECT * FROM (SELECT DISTINCT domain AS pattern, {_sql_code("list:", "domain")} AS code FROM domains) WHERE code % 3 = 0),
entries AS (SELECT pattern, code, 'add' AS action, {_sql_day("a:", "pattern")} AS "at" FROM names UNION ALL SELECT pattern, code, 'remove', {_sql_day("b:", "pattern")} FROM names
  UNION ALL SELECT pattern, code, 'add', {_sql_day("c:", "pattern")} FROM names WHERE code % 2 = 0),
dated AS (SELECT pattern, "at", max(action) AS action, ['ads', 'malware', 'spam'][CAST(any_value(code) // 3 % 3 + 1 AS INT)] AS category FROM entries GROUP BY pattern, "at"),
states AS (SELECT *, length(pattern) AS n FROM dated),
captures AS (SELECT d.page_id AS capture_id, domain, {_sql_day("fetch:", "d.page_id")} + INTERVAL 12 HOUR AS fetched_at FROM domains d),
met AS (SELECT c.capture_id, s.* FROM captures c ASOF JOIN states s ON c.domain = s.pattern AND c.fetched_at >= s."at"),
hits AS (SELECT capture_id, count(*) AS n_active, arg_max(pattern, n) AS pattern, arg_max(category, n) AS category, strftime(arg_max("at", n), '%Y-%m-%d') AS listed_on FROM met WHERE action = 'add' GROUP BY capture_id)
SELECT p.page_id AS capture_id, coalesce(n_active, 0) AS n_active, coalesce(n_active, 0) > 0 AS blocked, pattern, category, listed_on FROM pages p LEFT JOIN hits h ON p.page_id = h.capture_id
"""
