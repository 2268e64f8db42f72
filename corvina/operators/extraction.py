"""Question and answer extraction from lines and paragraphs, and validation of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, idx (from 0, among those that stay), text: lines that aren't blank, trimmed."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(lines).alias("idx", "text"))


def structure(lines: DataFrame) -> DataFrame:
    """Adds is_header (upper case over three characters, a final colon under 100, or numbered under
    100), is_item (bullet or numbering) and section: the number of headers up to the line."""
    t = F.col("text")
    upper = (t == F.upper(t)) & (F.lower(t) != F.upper(t)) & (F.length(t) > 3)
    header = upper | (t.endswith(":") & (F.length(t) < 100)) | (t.rlike(r"^\d+\.\s+\p{Lu}") & (F.length(t) < 100))
    item = t.rlike(r"^[•\-\*]\s+") | t.rlike(r"^\d+[\.\)]\s+")
    out = lines.withColumn("is_header", header).withColumn("is_item", item)
    window = Window.partitionBy("doc_id").orderBy("idx")
    return out.withColumn("section", F.sum(F.col("is_header").cast("int")).over(window))


def place_in_sections(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Each (doc_id, idx) of ``points`` that is a line of ``lines`` with its section: an equi-join on the line, since
    ``structure`` has numbered the sections line by line already."""
    return points.join(structure(lines).select("doc_id", "idx", "section"), ["doc_id", "idx"])


def adjacent_pairs(lines: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, idx, question, answer, confidence: a line and the next one, if the mean of their
    likenesses is at least ``least``. Scanning down, an accepted pair uses up both lines: of a run of
    lines that could each begin a pair, the first, third, ... do."""
    window = Window.partitionBy("doc_id").orderBy("idx")
    # each line is judged once, before the shuffle: what is like an answer belongs to the line in front
    judged = lines.withColumn("ask", T.question_likeness(F.col("text"))).withColumn("tell", T.answer_likeness(F.col("text")))
    pairs = judged.withColumn("answer", F.lead("text").over(window)).withColumn("confidence", (F.col("ask") + F.lead("tell").over(window)) / 2)
    pairs = pairs.withColumn("ok", F.coalesce((F.col("ask") >= least) & (F.col("confidence") >= least), F.lit(False)))
    breaks = pairs.withColumn("run", F.sum((~F.col("ok")).cast("int")).over(window))
    nth = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("idx"))
    return breaks.where("ok").withColumn("nth", nth).where(F.col("nth") % 2 == 1).select("doc_id", "idx", F.col("text").alias("question"), "answer", "confidence")


def question_blocks(lines: DataFrame, is_question: Column) -> DataFrame:
    """doc_id, block, question, answer: every question line with the lines up to the next one."""
    window = Window.partitionBy("doc_id").orderBy("idx")
    numbered = lines.withColumn("q", is_question).withColumn("block", F.sum(F.col("q").cast("int")).over(window)).where("block > 0")
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("q"), F.struct("idx", "text")))), lambda x: F.regexp_replace(x["text"], r"(?i)^a\s*[:.]\s*", "")), "\n")
    question = F.regexp_replace(F.max(F.when(F.col("q"), F.col("text"))), r"(?i)^q\s*[:.]\s*", "")
    return numbered.groupBy("doc_id", "block").agg(question.alias("question"), answer.alias("answer"))


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, table_idx, row_idx, cell_idx, text of HTML tables."""
    each = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    tables = pages.select("page_id", F.posexplode(each(F.col("html"), "table")).alias("table_idx", "t"))
    rows = tables.select("page_id", "table_idx", F.posexplode(each(F.col("t"), "tr")).alias("row_idx", "r"))
    cells = F.regexp_extract_all(F.col("r"), F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1))
    return rows.select("page_id", "table_idx", "row_idx", F.posexplode(cells).alias("cell_idx", "c")).withColumn("text", T.squeeze(F.regexp_replace("c", "<[^>]*>", " "))).drop("c")


def list_items(pages: DataFrame) -> DataFrame:
    """page_id, idx, text of HTML list items."""
    items = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"), F.lit(1))
    return pages.select("page_id", F.posexplode(items).alias("idx", "c")).withColumn("text", T.squeeze(F.regexp_replace("c", "<[^>]*>", " "))).drop("c")


def table_pairs(cells: DataFrame) -> DataFrame:
    """page_id, table_idx, row_idx, question, answer from tables of two rows or more. The header names
    the columns by substrings, the last fitting one of each kind; without such a header a table of two
    columns is read in the direction with the larger summed likenesses."""
    low = F.lower("text")
    asks = low.contains("question") | low.contains("q") | low.contains("query") | low.contains("ask")
    answers = ~asks & (low.contains("answer") | low.contains("a") | low.contains("response") | low.contains("solution"))
    head = cells.where("row_idx = 0").groupBy("page_id", "table_idx").agg(F.max(F.when(asks, F.col("cell_idx"))).alias("q_col"), F.max(F.when(answers, F.col("cell_idx"))).alias("a_col"))
    shape = cells.groupBy("page_id", "table_idx").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("cell_idx") + 1).alias("n_cols"))
    known = shape.join(head, ["page_id", "table_idx"], "left").where("n_rows >= 2")
    rows = cells.groupBy("page_id", "table_idx", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("cell_idx", "text"))).alias("row"))
    both = rows.join(known, ["page_id", "table_idx"])
    named = F.col("q_col").isNotNull() & F.col("a_col").isNotNull()
    at = lambda c: F.try_element_at("row", c)
    zero, one = at(F.lit(0)), at(F.lit(1))
    forward = T.question_likeness(zero) + T.answer_likeness(one) >= T.question_likeness(one) + T.answer_likeness(zero)
    question = F.when(named, at(F.col("q_col"))).when(forward, zero).otherwise(one)
    answer = F.when(named, at(F.col("a_col"))).when(forward, one).otherwise(zero)
    out = both.where((named & (F.col("row_idx") > 0)) | (~named & (F.col("n_cols") == 2))).select("page_id", "table_idx", "row_idx", question.alias("question"), answer.alias("answer"))
    return out.where((F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))


def entry_errors(question: Column, answer: Column, confidence: Column) -> Column:
    """What makes an entry invalid: missing or short texts, a confidence outside 0 to 1."""
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    return F.array_compact(F.array(
        F.when(q == "", "question_missing"), F.when((q != "") & (F.length(q) < 5), "question_short"), F.when(a == "", "answer_missing"),
        F.when((a != "") & (F.length(a) < 10), "answer_short"), F.when((confidence < 0) | (confidence > 1), "confidence_range"),
    ))


def validate(entries: DataFrame) -> DataFrame:
    """id, errors, warnings, is_valid of entries (id, question, answer, category, confidence,
    keywords, source)."""
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    placeholder = lambda c: T._any(F.lower(c), L.PLACEHOLDERS)
    asked = F.lower(q).rlike(L.QUESTION_SIGNS[0]) | F.lower(q).rlike(L.QUESTION_SIGNS[1])
    errors = entry_errors(F.col("question"), F.col("answer"), F.col("confidence"))
    warnings = F.array_compact(F.array(
        F.when(F.length(q) > 500, "question_long"), F.when((q != "") & ~asked, "question_form"), F.when(placeholder(q), "question_placeholder"),
        F.when(F.length(a) > 2000, "answer_long"), F.when(placeholder(a), "answer_placeholder"), F.when(F.trim(F.coalesce("category", F.lit(""))) == "", "category_missing"),
        F.when(F.size("keywords") == 0, "keywords_missing").when(F.size("keywords") > 20, "keywords_many"),
    ))
    return entries.select("id", errors.alias("errors"), warnings.alias("warnings")).withColumn("is_valid", F.size("errors") == 0)
