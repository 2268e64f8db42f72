"""Question and answer entries of whole pages: candidates from table rows, list items and paragraphs in one relation,
of which overlapping ones are settled by confidence, and what is left is cleaned, labelled and validated."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.operators import extraction
from corvina.session import cut_lineage

#: A candidate's confidence is the mean of how far it looks like a question and an answer; it must reach
LEAST = 0.3
#: and counts for less if both stand in one paragraph.
ONE_PARAGRAPH = 0.8
GENERAL = "General"
_BLOCK = r"p|li|h[1-6]|tr"
CANDIDATE = "starts_at int, ends_before int, kind string, question string, answer string, confidence double"


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, idx, kind (paragraph, item, heading or row), text, cells of pages (page_id, html), in the order
    of the page. A block ends at its own end tag, or where the next one begins if it is never closed."""
    pieces = F.split("html", rf"(?i)(?=<(?:{_BLOCK})[\s>])")
    rows = pages.select("page_id", F.posexplode(pieces).alias("idx", "piece"))
    rows = rows.withColumn("tag", F.lower(F.regexp_extract("piece", rf"(?i)^<({_BLOCK})[\s>]", 1))).where("tag <> ''")
    inner = F.regexp_extract("piece", rf"(?is)^<({_BLOCK})(?:\s[^>]*)?>(.*?)(?:</\1\s*>|$)", 2)
    plain = lambda c: T.squeeze(F.regexp_replace(c, r"(?s)<[^>]*>", " "))
    kind = F.when(F.col("tag") == "p", "paragraph").when(F.col("tag") == "li", "item").when(F.col("tag") == "tr", "row").otherwise("heading")
    cells = F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"), F.lit(1)), plain)
    return rows.select("page_id", "idx", kind.alias("kind"), plain(inner).alias("text"), cells.alias("cells"))


def scored(rows: DataFrame) -> DataFrame:
    """Blocks with ask and tell: how far the text of an item or a paragraph looks like a question and an answer. They are
    written once, since every kind of pair and the headings read them."""
    pairs = F.col("kind").isin("item", "paragraph") & (F.col("text") != "")
    likeness = lambda of: F.when(pairs, of(F.col("text")))
    return cut_lineage(rows.withColumn("ask", likeness(T.question_likeness)).withColumn("tell", likeness(T.answer_likeness)))


def _of_rows(rows: DataFrame) -> DataFrame:
    """Rows of two cells or more: the first two, read in the direction that looks more like question and answer."""
    one, other = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    ahead = (T.question_likeness(one) + T.answer_likeness(other)) / 2
    back = (T.question_likeness(other) + T.answer_likeness(one)) / 2
    rows = rows.where((F.col("kind") == "row") & (F.size("cells") >= 2) & (one != "") & (other != "")).withColumn("forward", ahead >= back)
    pick = lambda yes, no: F.when(F.col("forward"), yes).otherwise(no)
    return rows.select("page_id", F.col("idx").alias("starts_at"), (F.col("idx") + 1).alias("ends_before"), F.lit("table").alias("kind"), pick(one, other).alias("question"), pick(other, one).alias("answer"), F.greatest(ahead, back).alias("confidence"))


def _adjacent(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """Neighbours of one kind: any block of it with the next one of the page."""
    own = rows.where((F.col("kind") == kind) & (F.col("text") != ""))
    window = Window.partitionBy("page_id").orderBy("idx")
    following = F.lead(F.struct("text", "idx", "tell")).over(window)
    own = own.withColumn("next", following).where("next is not null")
    confidence = (F.col("ask") + F.col("next.tell")) / 2
    return own.select("page_id", F.col("idx").alias("starts_at"), (F.col("next.idx") + 1).cast("int").alias("ends_before"), F.lit(name).alias("kind"), F.col("text").alias("question"), F.col("next.text").alias("answer"), confidence.alias("confidence"))


def _of_one(rows: DataFrame) -> DataFrame:
    """Paragraphs that ask and go on to answer."""
    question, answer = (F.btrim(F.regexp_extract("text", r"(?s)^(.*?\?)\s+(\S.*)$", k)) for k in (1, 2))
    own = rows.where((F.col("kind") == "paragraph") & F.contains("text", F.lit("?"))).select("page_id", F.col("idx").alias("starts_at"), (F.col("idx") + 1).alias("ends_before"), F.lit("single").alias("kind"), question.alias("question"), answer.alias("answer"))
    confidence = ONE_PARAGRAPH * (T.question_likeness(F.col("question")) + T.answer_likeness(F.col("answer"))) / 2
    return own.where("question <> '' and answer <> ''").withColumn("confidence", confidence)


def candidates(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id and CANDIDATE: all pairs that blocks, as ``scored`` gives them, offer, whether or not they overlap."""
    every = [_of_rows(rows), _adjacent(rows, "item", "list"), _adjacent(rows, "paragraph", "paragraph"), _of_one(rows)]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    # a single paragraph's confidence is compared before it is lowered
    return out.where(F.col("confidence") >= F.when(F.col("kind") == "single", ONE_PARAGRAPH * least).otherwise(least))


def settle(found: list[dict]) -> list[dict]:
    """Those of a page's candidates that stay: the most confident first, then the earlier, shorter and by
    kind first, each unless it overlaps one that has stayed. Ends are kept sorted, so a page of n
    candidates takes n log n comparisons."""
    order = sorted(found, key=lambda c: (-c["confidence"], c["starts_at"], c["ends_before"], c["kind"]))
    starts: list[int] = []
    ends: list[int] = []
    stay = []
    for c in order:
        at = bisect.bisect_right(starts, c["starts_at"])
        if (at and ends[at - 1] > c["starts_at"]) or (at < len(starts) and starts[at] < c["ends_before"]):
            continue
        starts.insert(at, c["starts_at"])
        ends.insert(at, c["ends_before"])
        stay.append(c)
    return stay


def settled(found: DataFrame) -> DataFrame:
    """page_id and CANDIDATE of the candidates that stay. A page's candidates are as many as its blocks."""
    fields = [field.split()[0] for field in CANDIDATE.split(", ")]

    def choose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([settle([dict(c) for c in page]) for page in pages], dtype=object)

    lists = found.groupBy("page_id").agg(F.collect_list(F.struct(*fields)).alias("c"))
    kept = F.pandas_udf(choose, f"array<struct<{', '.join(field.replace(' ', ':') for field in CANDIDATE.split(', '))}>>")("c")
    return lists.select("page_id", F.explode(kept).alias("c")).select("page_id", "c.*")


def entries(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """Entries of pages (page_id, html): id, page_id, starts_at, kind, question, answer, category, audience, intent,
    condition, confidence, keywords, those that ``extraction.validate`` finds valid.

    Texts are cleaned of blanks, the category comes from the heading above, and the id from the page, the
    place and the question, so that another run gives the same. Equal entries of a page count once,
    the first of them. A page without html has none."""
    rows = scored(blocks(pages.where("html is not null")))
    window = Window.partitionBy("page_id").orderBy("idx")
    heading = F.last(F.when((F.col("kind") == "heading") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(window)
    sections = rows.select("page_id", F.col("idx").alias("starts_at"), F.coalesce(heading, F.lit(GENERAL)).alias("section"))
    stay = settled(candidates(rows, least)).withColumn("question", T.squeeze(F.col("question"))).withColumn("answer", T.squeeze(F.col("answer")))
    first = stay.where("question <> '' and answer <> ''").groupBy("page_id", "question", "answer").agg(F.min(F.struct("starts_at", "kind", "confidence")).alias("f"))
    placed = first.select("page_id", "question", "answer", "f.*").join(sections, ["page_id", "starts_at"])
    labelled = placed.withColumn("m", T.entry_metadata(F.col("question"), F.col("answer"), F.col("section")))
    entry_id = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), F.col("starts_at").cast("string"), "question"), 256)
    out = labelled.select(entry_id.alias("id"), "page_id", "starts_at", "kind", "question", "answer", F.col("section").alias("category"), "m.audience", "m.intent", "m.condition", "confidence", T.ngrams(F.col("question")).alias("keywords"))
    return out.where(_valid(out))


def _valid(rows: DataFrame) -> Column:
    return F.size(extraction.entry_errors(F.col("question"), F.col("answer"), F.col("confidence"))) == 0
