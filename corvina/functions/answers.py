"""Small rules about answers, forms and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T

BLANKS = " \t\n\r\x0b\f"
#: Form rules: fewest characters of a question and an answer, most keywords, and how many are made where none is given.
QUESTION_LENGTH, ANSWER_LENGTH, KEYWORDS, MADE_KEYWORDS = 10, 20, 20, 8


def response_type(confidence: Column, n_sources: Column) -> Column:
    """semantic_match from 0.7, partial_match from 0.3, both with a source; else fallback."""
    found = n_sources > 0
    return F.when(found & (confidence >= 0.7), "semantic_match").when(found & (confidence >= 0.3), "partial_match").otherwise("fallback")


def entities(text: Column) -> Column:
    """A map of the kinds of entities to the distinct ones in the text, in the order in which their patterns find
    them; kinds without any have an empty list."""
    pairs = []
    for kind, patterns in L.ENTITIES.items():
        found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + pattern), F.lit(0)) for pattern in patterns]
        pairs += [F.lit(kind), F.array_distinct(F.concat(*found))]
    return F.create_map(*pairs)


def keyword_list(keywords: Column) -> Column:
    """Keywords between commas, trimmed, without empty ones."""
    trimmed = F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda k: F.btrim(k, F.lit(BLANKS)))
    return F.filter(trimmed, lambda k: k != "")


def form_errors(question: Column, answer: Column, keywords: Column) -> Column:
    """What a form of an entry is refused for."""
    q, a = F.length(F.btrim(F.coalesce(question, F.lit("")))), F.length(F.btrim(F.coalesce(answer, F.lit(""))))
    return F.array_compact(F.array(
        F.when(q == 0, "question_empty").when(q < QUESTION_LENGTH, "question_short"),
        F.when(a == 0, "answer_empty").when(a < ANSWER_LENGTH, "answer_short"),
        F.when(F.size(keyword_list(keywords)) > KEYWORDS, "keywords_many"),
    ))


def form_keywords(keywords: Column, question: Column, answer: Column) -> Column:
    """The given keywords, cleaned, or the first ones of question and answer where none is given."""
    own = keyword_list(keywords)
    made = F.slice(T.entry_keywords(F.concat_ws(" ", question, answer)), 1, MADE_KEYWORDS)
    return F.array_join(F.when(F.size(own) > 0, own).otherwise(made), ", ")


def plain_grammar(query: Column) -> Column:
    """The shorter set of rewrites of informal grammar, in its order, and a mark at the end: ? if a word that asks
    occurs anywhere, else a full stop."""
    out = F.btrim(query)
    for pattern, replacement in L.PLAIN_GRAMMAR:
        out = F.regexp_replace(out, "(?iU)" + pattern, replacement)
    asks = T._any(F.lower(out), L.ASKING_ANYWHERE)
    return F.when(out.rlike(r"[.?!]$"), out).otherwise(F.concat(out, F.when(asks, "?").otherwise(".")))
