"""Query forms, answers, learning, monitoring and versions on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvina.functions import understanding as N
from corvina.functions import vectors as V
from corvina.operators import service as S


def column(spark, expression, **values):
    kinds = {str: "string", bool: "boolean", int: "int", list: "array<string>"}
    schema = ", ".join(f"{name} {kinds[type(value)] if value is not None else 'string'}" for name, value in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first()["x"]


def test_variations(spark):
    q = F.col("q")
    assert column(spark, N.variations(q), q="How do I reset my password?")[:3] == ["How do I reset my password?", "how to How do I reset my password?", "instructions for How do I reset my password?"]
    definition = column(spark, N.variations(q), q="What is machine learning?")
    assert definition[0] == "What is machine learning?" and not any(x.startswith("define") for x in definition)
    templates = column(spark, N.template_variations(q), q="What is machine learning?")
    assert "what is machine" in templates and "define What is machine learning?" in templates and len(templates) == 6 * 4
    assert column(spark, N.casual_variations(q), q="reset password")[-2:] == ["reset", "password"]


def test_follow_up(spark):
    q = F.col("q")
    flags = column(spark, N.follow_up(q), q="What about this?")
    assert flags["has_indicators"] and flags["has_references"] and flags["confidence"] == 0.8
    assert not column(spark, N.follow_up(q), q="How big?")["is_follow_up"]
    resolve = lambda **v: column(spark, N.resolve_follow_up(q, F.col("k"), F.col("t")), **v)
    assert resolve(q="how do i fix it", k=["printer", "paper"], t="") == "how do i fix printer"
    assert resolve(q="use it", k=[], t="") == "use the topic" and resolve(q="do they work", k=["a1", "b1"], t="x") == "do a1 and b1 work"
    assert resolve(q="more please", k=[], t="refunds") == "more please regarding refunds"
    expansions = column(spark, N.context_expansions(q, F.col("t"), F.col("k")), q="cost", t="refunds", k=["late"])
    assert expansions == ["cost refunds", "refunds cost", "how does cost relate to refunds", "cost late"]


def test_components_and_languages(spark):
    assert column(spark, N.query_components(F.col("q"), F.lit(None).cast("string")), q="What is my salary?")["category"] == "payroll"
    assert column(spark, N.marked_foreign(F.col("q"), F.lit("de")), q="wo") == "[de] wo"
    assert column(spark, N.normalize_mixed(F.col("q"), F.lit(True)), q="WHAT  ist das") == "what ist das"


def test_answers(spark):
    found = spark.createDataFrame([(1, 1, "one"), (2, 2, "b"), (2, 1, "a"), (3, 1, "  "), (4, 1, None)], "qid long, rn int, answer string")
    asked = spark.createDataFrame([(i, f"q{i}") for i in range(1, 6)], "qid long, text string")
    got = {r["qid"]: (r["answer"], r["method"]) for r in S.answers(found, asked).collect()}
    assert got[1] == ("one", "direct") and got[2] == ("Source 1: a\n\nSource 2: b", "synthesis")
    assert {got[i][1] for i in (3, 4, 5)} == {"fallback"}


def test_learning(spark):
    rows = spark.createDataFrame([(1, ["Password"]), (2, []), (3, ["x"])], "id long, keywords array<string>")
    praised = spark.createDataFrame([(1, "reset my password"), (1, "reset password"), (2, "order status")], "id long, text string")
    got = {r["id"]: r["keywords"] for r in S.learn_keywords(rows, praised).collect()}
    assert got[1][0] == "Password" and "reset" in got[1] and got[1].count("password") == 0 and {"order", "status"} <= set(got[2]) and got[3] == ["x"]


def test_resolved_alerts(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    alerts = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(10)), ("b", 3, at(0))], "k string, i int, raised_at timestamp")
    closed = spark.createDataFrame([("a", at(5)), ("a", at(10)), ("c", at(1))], "k string, resolved_at timestamp")
    got = {r["i"]: r["resolved_at"] for r in S.resolved(alerts, closed, ["k"]).collect()}
    assert got == {1: at(5), 2: at(10), 3: None}


def test_versions(spark):
    rows = spark.createDataFrame([("v1", 1, True), ("v2", 2, True), ("v3", 3, False)], "version_id string, created_at int, is_active boolean")
    got = {r["version_id"]: (r["is_current"], r["kept"]) for r in S.with_versions(rows, 2).collect()}
    assert got == {"v1": (False, False), "v2": (True, True), "v3": (False, True)}
    assert tuple(S.rolled_back(rows, "v1").first()) == ("v2", "v1")


def test_weighted_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], None)], "a array<double>, b array<double>, c array<double>")
    got = df.select(V.weighted([F.col("a"), F.col("b"), F.col("c")], [0.5, 0.4, 0.1]).alias("v")).first()["v"]
    assert got == pytest.approx([0.5 / 0.41**0.5, 0.4 / 0.41**0.5])


def test_encryption(spark):
    key, other = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210")
    assert column(spark, S.decrypted(S.encrypted(F.col("t"), key), key), t="secret text") == "secret text"
    assert column(spark, S.decrypted(S.encrypted(F.col("t"), key), other), t="secret text") is None and column(spark, S.decrypted(F.col("t"), key), t="not coded!") is None


def test_filters(spark):
    rows = spark.createDataFrame([(1, "any", "a", "info", "default", 0.9, ["AI"]), (2, "staff", "b", "any", "urgent", 0.4, ["x"])], "id int, audience string, category string, intent string, condition string, confidence double, keywords array<string>")
    ids = lambda **k: [r["id"] for r in rows.where(S.composite_filter(**k)).orderBy("id").collect()]
    assert ids() == [1, 2] and ids(audience="staff") == [1, 2] and ids(audience="guest") == [1] and ids(category="a") == [1]
    assert ids(intent="process") == [2] and ids(condition="urgent") == [1, 2] and ids(confidence=0.5) == [1] and ids(keywords=["ai"]) == [1] and ids(category="general", confidence=0) == [1, 2]
