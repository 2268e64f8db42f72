"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns: a defined result for each."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvina.llm import bag_minhash, language_crf, line_dedup, piece_codec, quality_model, repetition, rp_forest, secrets, source_mix, url_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
LONG = " ".join(f"word{i % 977} und{i}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0, 0.5, "x"),
    (2, "", None, None, 0, None, None),
    (3, "the cat sat on the mat and looked at the dog in the garden of the house by the sea", "en", "a", 90, 0.1, "y"),
    (3, "the cat sat on the mat and looked at the dog in the garden of the house by the sea", "en", "a", 90, 0.1, "y"),
    (4, "der hund lief durch den garten und sah die katze auf der matte liegen und schlafen", "de", "b", 90, 0.1, "y"),
    (None, "the dog ran through the garden and saw the cat", "en", "b", 46, 0.2, "z"),
    (5, "\n\n \t\n", "en", "a", 5, 0.0, ""),
    (6, LONG, "en", "b", len(LONG), 1.0, "long"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://www.a.example.com/x", 5), (2, None, 5), (3, "no url", 5), (4, "https://u@b.example.com:80/", None), (5, "http://a.example.com", 20), (6, "http://example.com", 10)], "capture_id long, url string, t long")
    captures = captures.withColumn("fetched_at", F.timestamp_seconds("t"))
    entries = spark.createDataFrame([("example.com", "spam", "add", 4), ("example.com", "spam", "remove", 10), ("a.example.com", "ads", "add", 5), ("a.example.com", "ads", "add", 15), (None, "x", "add", 1), ("b.example.com", "x", "other", 1)], "pattern string, category string, action string, t long")
    intervals = url_lists.validity_intervals(entries.withColumn("at", F.timestamp_seconds("t")))
    got = {r["capture_id"]: (r["n_active"], r["pattern"]) for r in url_lists.judge_captures(captures, intervals).collect()}
    assert got == {1: (2, "a.example.com"), 2: (0, None), 3: (0, None), 4: (0, None), 5: (1, "a.example.com"), 6: (0, None)}
    assert url_lists.judge_captures(captures.limit(0), intervals).count() == 0


def test_line_dedup(spark, none):
    rows = [(i, f"menu\nown line {i}\n menu \n", "h") for i in range(5)] + [(9, "menu", "h"), (10, "menu\nx", "other"), (11, None, "h"), (12, "menu", None)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"]) for r in line_dedup.drop_boilerplate(pages).collect()}
    assert got[0] == ("own line 0\n", 3, 2)
    assert got[9] == ("", 1, 1) and got[10][0] == "menu\nx" and got[11] == (None, 0, 0) and got[12][0] == "menu"
    assert line_dedup.drop_boilerplate(none).count() == 0


def test_repetition(docs, none):
    got = {r["doc_id"]: r for r in repetition.judge_documents(docs).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[6]["n_words"] == 60_000 and got[6]["kept"]
    assert repetition.judge_documents(none).count() == 0


def test_secrets(docs, none):
    got = {r["doc_id"]: r for r in secrets.scan_documents(docs).collect()}
    assert got[1]["spans"] == "" and got[6]["n_hex"] == 0
    assert secrets.scan_documents(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 1), (6, 0), (7, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert [r["score"] for r in quality_model.classify(docs, labels.limit(0)).collect()] == [0.5] * len(ROWS)
    assert quality_model.classify(none, labels).count() == 0


def test_language(docs, none):
    got = {r["doc_id"]: r for r in language_crf.identify(docs).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in got.values()} <= {"und", "en", "de"}
    assert language_crf.identify(none).count() == 0


def test_forest(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(i, [2.0, 2.0, 2.0]) for i in range(200, 260)] + [(200, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rp_forest.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 200}
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 200] == [(i, 0.0) for i in range(201, 211)]
    assert rp_forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_codec(docs, none):
    coded = piece_codec.encode_documents(docs, piece_codec.Codec(docs), ("doc_id", "score"))
    got = {r["doc_id"]: r for r in coded.collect()}
    assert all(r["lossless"] for r in got.values()) and got[1]["ids"] is None and got[2]["n_pieces"] == 0
    assert piece_codec.encode_documents(none, piece_codec.Codec(none)).count() == 0


def test_near_duplicates(docs, none):
    got = [(r["doc_id"], r["class_id"]) for r in bag_minhash.near_duplicate_classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (None, None), (5, 5), (6, 6)], key=str)
    assert bag_minhash.near_duplicate_classes(none).count() == 0


def test_mix(docs, none):
    sizes = source_mix.sized(docs)
    got = source_mix.mix(sizes, source_mix.plan_mix(sizes)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["n_copies"] <= 2 for r in got)
    assert source_mix.plan_mix(source_mix.sized(none)).count() == 0


def test_pipeline_stages(spark, docs, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, "").columns) == set(docs.columns)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted([r[0] for r in kept], key=str) == sorted([1, 2, 3, 4, 5, 6, None], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
