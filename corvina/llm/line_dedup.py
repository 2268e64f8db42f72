"""Site-relative line frequency: a line on more than a given share of its host's pages is boilerplate.

Built-in functions only. Lines travel as two 64-bit hashes with their host; counts are combined
before the shuffle, so neither a hot host nor a very common line gathers in one task. Texts move
once, by page, when the dropped lines are joined back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut_lineage, small_side

#: A line on more than this share of the host's pages is dropped,
RATIO = 0.02
#: if it is on at least this many of them.
MIN_PAGES = 3
BLANK = " \t\r\x0b\f"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def page_lines(pages: DataFrame, page: str, host: str, text: str) -> DataFrame:
    """page, host, line (hashes): each page's distinct lines, trimmed, without blank ones."""
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), _trimmed))
    return pages.select(F.col(page).alias("page"), F.col(host).alias("host"), F.explode(lines).alias("line")).where("line <> ''").withColumn("line", _hashes(F.col("line")))


def boilerplate_lines(lines: DataFrame, pages: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """host, line, n_pages, host_pages: lines on more than ``ratio`` of their host's pages. A page is
    a row, also one without a text; null is a host like any other."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages")).alias("t")
    found = counts.join(totals, counts["host"].eqNullSafe(F.col("t.host"))).where(F.col("n_pages") > ratio * F.col("host_pages"))
    return found.select(counts["host"], "line", "n_pages", "host_pages")


def drop_boilerplate(pages: DataFrame, page: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, spare_whole: bool = False) -> DataFrame:
    """``pages`` with ``text`` cleaned, and n_lines, n_dropped (long) in a struct ``line_dedup``.

    Lines end at a line feed and are compared without surrounding blanks. A page that has nothing
    but boilerplate becomes an empty text, or one of its blank lines; with ``spare_whole`` it stays as it
    is (a page that its host repeats often, left to a stage that looks for copies). A null text stays
    null, with no lines. Rows with the same page id are cleaned alike; a null id is one like any other.
    """
    lines = page_lines(pages, page, host, text)
    # very common lines are hot keys by nature: their short list is broadcast if it is counted to be short
    flagged = small_side(cut_lineage(boilerplate_lines(lines, pages, host, ratio, min_pages))).alias("f")
    hits = lines.join(flagged, lines["host"].eqNullSafe(F.col("f.host")) & (lines["line"] == F.col("f.line")))
    hits = hits.groupBy(lines["page"], lines["host"]).agg(F.collect_set(lines["line"]).alias("_drop")).alias("h")
    packed = pages.select(F.struct("*").alias("row"), F.col(page).alias("page"), F.col(host).alias("host"))
    # hits have a row for each key at most and are the smaller side: hashed, so that texts needn't be sorted
    hits = hits.hint("shuffle_hash")
    both = packed.join(hits, packed["page"].eqNullSafe(F.col("h.page")) & packed["host"].eqNullSafe(F.col("h.host")), "left")
    # texts are split behind the join, so that they move once
    both = both.select("row", F.split(F.col("row")[text], "\n").alias("_lines"), "_drop")
    filled = lambda line: _trimmed(line) != ""
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda line: ~F.array_contains(F.col("_drop"), _hashes(_trimmed(line)))))
    both = both.select("row", "_lines", kept.alias("_kept"))
    n_lines, n_kept = F.size(F.filter("_lines", filled)), F.size(F.filter("_kept", filled))
    both = both.select("row", "_kept", F.when(F.col("_lines").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("_lines").isNull(), 0).otherwise(n_kept).cast("long").alias("n_kept"))
    if spare_whole:
        both = both.withColumn("n_kept", F.when(F.col("n_kept") == 0, F.col("n_lines")).otherwise(F.col("n_kept")))
    clean = F.when(F.col("n_kept") == F.col("n_lines"), F.col(f"row.{text}")).otherwise(F.array_join("_kept", "\n"))
    counts = F.struct("n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_dropped")).alias("line_dedup")
    return both.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns], counts)


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, source, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, l AS raw, i
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
counts AS (SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM lines WHERE line <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
flagged AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n_pages >= {MIN_PAGES} AND n_pages > CAST({RATIO} AS DOUBLE) * host_pages),
marked AS (SELECT l.*, f.line IS NOT NULL AS bad FROM lines l LEFT JOIN flagged f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line),
pages AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (line <> '' AND bad) AS n_bad, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT bad) AS clean FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_dropped, CASE WHEN n_bad > 0 THEN coalesce(clean, '') ELSE d.text END AS text
FROM documents d LEFT JOIN pages p ON d.doc_id = p.doc_id
"""
