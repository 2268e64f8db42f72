"""Ambiguity, language and context on known queries."""

import pytest
from pyspark.sql import functions as F

from corvina.functions import understanding as N


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "q string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "query, kind",
    [("How do I fix it?", "pronoun_ambiguity"), ("help", "incomplete_query"), ("How do I reset my password and what are the security requirements?", "multiple_intent"), ("I have an issue with something", "vague_terms")],
)
def test_ambiguity(spark, query, kind):
    assert kind in one(spark, N.ambiguity(F.col("q"), F.lit(False)), query)["types"]


@pytest.mark.parametrize("text, lang", [("What is the meaning of this and that?", "en"), ("der Hund und die Katze sind in das Haus", "de"), ("это не так", "ru"), ("zzz qqq", "en"), ("", "en")])
def test_language(spark, text, lang):
    assert one(spark, N.language(F.col("q")), text)["lang"] == lang


def test_pronouns(spark):
    assert one(spark, N.resolve_pronouns(F.col("q"), F.array(F.lit("password"), F.lit("login"))), "how do I reset it with them") == "how do I reset password with password and login"
    assert one(spark, N.resolve_pronouns(F.col("q"), F.array().cast("array<string>")), "fix it") == "fix it"
