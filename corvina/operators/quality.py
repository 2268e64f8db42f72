"""Quality of responses and of a store, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relevance(confidence: Column, n_sources: Column, used_context: Column, fallback: Column) -> Column:
    """0.3 without sources; else confidence + up to 0.2 for sources + 0.1 for context - 0.2 for a fallback."""
    score = confidence + F.least(F.lit(0.2), 0.05 * n_sources) + F.when(used_context, 0.1).otherwise(0.0) - F.when(fallback, 0.2).otherwise(0.0)
    return F.when(n_sources == 0, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def completeness(text: Column) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < 20, 0.2).when(n < 50, 0.5).when(n < 200, 0.8).otherwise(1.0)


def coherence(text: Column, cites_source: Column) -> Column:
    score = 0.5 + F.when(F.size(F.split(text, r"\.")) > 1, 0.2).otherwise(0.0) + F.when(cites_source, 0.2).otherwise(0.0) - F.when(F.length(text) < 30, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def attribution(n_cited: Column, n_sources: Column) -> Column:
    return F.when(n_sources == 0, 0.0).otherwise(F.least(F.lit(1.0), n_cited / n_sources))


def response_type(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "semantic").when(confidence >= 0.3, "partial").otherwise("fallback")


def looks_dumped(text: Column) -> Column:
    """A raw piece of a document instead of an answer: several Q:, over 1000 characters, or more than
    ten lines over 100."""
    long_lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(x) > 100))
    return (F.regexp_count(text, F.lit("Q:")) > 1) | (F.length(text) > 1000) | (long_lines > 10)


def client_address(forwarded: Column, remote: Column) -> Column:
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(remote)


def needs_retraining(n_queries: Column, mean_confidence: Column, mean_rating: Column) -> Column:
    """Why a model should be trained again, or null: 100 queries at least, then low confidence, then low ratings."""
    return F.when(n_queries >= 100, F.when(mean_confidence < 0.6, "low_confidence").when(mean_rating < 3.0, "low_satisfaction"))
