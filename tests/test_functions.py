"""Text functions on the known inputs of the domain."""

import random

import pytest
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.functions import vectors as V
from corvina.operators import extraction


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'array<double>' if isinstance(values[n], list) else 'int' if isinstance(values[n], int) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("query, intent", [("What is machine learning?", "definition"), ("How do I reset my password?", "instruction"), ("I have a problem with my account", "problem"), ("Can you help me with this?", "help"), ("Tell me about your services", "information")])
def test_intent(spark, query, intent):
    assert one(spark, T.intent_of(F.col("q")), q=query)["intent"] == intent


@pytest.mark.parametrize("query, part", [("need help with login", "need a help"), ("you going to fix this", "you are going"), ("what about password reset", "what is password"), ("this broken", "this is broken"), ("wanna know more", "want to know")])
def test_grammar(spark, query, part):
    assert part in one(spark, T.formal_grammar(F.col("q")), q=query).lower()


@pytest.mark.parametrize("word, right", [("teh", "the"), ("adn", "and"), ("waht", "what"), ("recieve", "receive"), ("seperate", "separate"), ("definately", "definitely"), ("dont", "don't"), ("u", "you")])
def test_typos(spark, word, right):
    assert one(spark, T.fix_typos(F.col("q")), q=word)["text"] == right


@pytest.mark.parametrize(
    "rating, comment, category",
    [(5, "Fast and accurate response", "performance_praise"), (4, "Correct answer provided", "accuracy_praise"), (5, "Good system overall", "general_satisfaction"), (2, "Too slow to respond", "performance_complaint"),
     (1, "Wrong information given", "accuracy_complaint"), (2, "Confusing interface", "usability_complaint"), (1, "Not satisfied", "general_dissatisfaction"), (3, "Average response", "neutral_feedback")],
)
def test_feedback_category(spark, rating, comment, category):
    assert one(spark, T.feedback_category(F.col("r"), F.col("c")), r=rating, c=comment) == category


@pytest.mark.parametrize("comment, mood", [("Great job! Excellent and amazing response!", "positive"), ("Terrible and awful response, very bad!", "negative"), ("The system provided information.", "neutral")])
def test_sentiment(spark, comment, mood):
    assert one(spark, T.sentiment(F.col("c")), c=comment) == mood


def test_cosine(spark):
    q, faq = [0.15, 0.25, 0.35, 0.45, 0.55], [0.2, 0.3, 0.4, 0.5, 0.6]
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=q, b=faq) == pytest.approx(0.999024865687, abs=1e-12)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0


def test_ngrams(spark):
    assert set(one(spark, T.ngrams(F.col("q")), q="Hello, big World")) == {"{hello}", "{big}", "{world}", "{hello,big}", "{big,world}", "{hello,big,world}"}
    assert one(spark, T.ngrams(F.col("q")), q="") == []


def test_greedy_pairs(spark):
    """The window form equals the scan that uses up both lines of an accepted pair."""
    lines = ["What is it?", "It is a thing that helps.", "How does it work?", "What now?", "You can use it every day.", "plain", "Why?", "No."]
    random.seed(3)
    docs = [(i, "\n".join(random.choices(lines, k=random.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["idx"]) for r in extraction.adjacent_pairs(extraction.paragraphs(df)).collect()}
    scored = {r["t"]: (r["q"], r["a"]) for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", T.question_likeness(F.col("t")).alias("q"), T.answer_likeness(F.col("t")).alias("a")).collect()}
    expected = set()
    for doc, text in docs:
        own, i = [x for x in text.split("\n") if x.strip()], 0
        while i + 1 < len(own):
            q, a = scored[own[i]][0], scored[own[i + 1]][1]
            if q >= 0.3 and (q + a) / 2 >= 0.3:
                expected.add((doc, i))
                i += 2
            else:
                i += 1
    assert got == expected
