"""Store, documents, streams and order-dependent operators on small fixtures."""

import datetime as dt
import zipfile
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.operators import analytics, dedupe, experiments, frequent, links, retrieval, typos
from corvina.plans import text_queries
from corvina.sources import docx, store
from corvina.streaming import monitors


def test_post_filter_differs_from_pre_filter(spark):
    rows = [(1, i, float(100 - i), i >= 10) for i in range(20)]
    scored = spark.createDataFrame(rows, "qid long, id long, sim double, ok boolean")
    assert retrieval.filtered(scored, F.col("ok"), 1).count() == 0
    assert retrieval.top_k(scored.where("ok"), 1, ["qid"]).first()["id"] == 10


def test_half_split_puts_the_odd_row_behind(spark):
    rows = [(1, i, v) for i, v in enumerate([2, 2, 3, 4, 4])]
    got = analytics.half_split(spark.createDataFrame(rows, "u int, i int, v int"), ["u"], ["i"], "v", 0.2, 5).first()
    assert (got["first_mean"], got["trend"]) == (2.0, "improving")


def test_order_statistics(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, 10)], "g int, v long")
    got = analytics.order_statistics(df, ["g"], "v").first()
    assert (got["upper_median"], got["p95"]) == (3, 10)


def test_buckets(spark):
    df = spark.createDataFrame([("user_1",), ("user_2",), ("user_3",)], "u string")
    got = [round(r["b"], 10) for r in df.select(experiments.bucket(F.col("u"), F.lit("test_a")).alias("b")).collect()]
    assert got == [0.6667940768, 0.6262139045, 0.4353438218]


def test_store(spark, tmp_path):
    state = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "id long, document string, embedding array<double>")
    new = spark.createDataFrame([(3, "a", [3.0]), (4, "a", None)], state.schema)
    after = store.upsert(state, new)
    assert sorted(r["id"] for r in after.collect()) == [2, 3]
    path = str(tmp_path / "kb")
    store.write(after, path, "document")
    store.backup(spark, path, "v1")
    store.write(state.where("id = 1"), path)
    store.restore(spark, path, "v1")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    text = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body>{text("What is it?")}<w:tbl><w:tr><w:tc>{text("Q")}</w:tc><w:tc>{text("A")}</w:tc></w:tr></w:tbl>{text("")}</w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "bad.docx").write_bytes(b"not a zip file")
    rows = docx.read(docx.files(spark, str(tmp_path))).collect()
    assert sorted((r["kind"], r["text"]) for r in rows if r["kind"] != "error") == [("cell", "A"), ("cell", "Q"), ("paragraph", "What is it?")]
    assert [r["kind"] for r in rows if r["error"]] == ["error"]


def test_similar_entries(spark):
    rows = [(1, "how do i reset my password", "Use the form."), (2, "how do i reset my passwords", "Other text here"), (3, "something else entirely", "use  the FORM."), (4, "oak 12", None), (5, "oak 13", ""), (6, None, None), (7, "unlike all", "nothing of the kind")]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    got = {r["id"]: (r["class_id"], r["other_id"], r["component"], r["kind"]) for r in dedupe.similar(df).collect()}
    assert got == {1: (1, 3, "answer", "exact"), 2: (1, 1, "question", "exact"), 3: (1, 1, "answer", "exact"), 4: (4, 5, "question", "similar"), 5: (4, 4, "question", "similar")}
    assert dedupe.similar(df.limit(0)).count() == 0


def test_links_in_bands_of_any_size(spark, monkeypatch):
    """Every pair of a band that is alike ends in one class, with bands larger than a block."""
    monkeypatch.setattr(links, "BLOCK", 4)
    groups = {i: i % 7 for i in range(40)}
    bands = spark.createDataFrame([(i, 1) for i in groups], "id long, band long")
    marks = spark.createDataFrame([(i, bytes([g] * 8)) for i, g in groups.items()], "id long, marks binary")
    same = lambda pairs: pairs.where("a % 7 = b % 7")
    roots = {r["id"]: r["root"] for r in links.components(links.linked(bands, marks, same, 0.5)).collect()}
    assert roots == groups


def test_vector_blocks(spark, monkeypatch):
    """Blocks of a few rows give the cosines of all pairs; odd vectors match nothing."""
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(size=4)], f"n{i}") for i in range(20)] + [(50, [1.0, 2.0], "short"), (51, None, "null"), (52, [0.0] * 4, "zero")]
    rows += [(60 + i, rows[0][1], "copy") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, name string")
    queries = df.where("id % 5 = 0").select(F.col("id").alias("qid"), "embedding")
    got = {(r["qid"], r["id"]): (r["sim"], r["name"]) for r in retrieval.vector_scores(df, queries, 0.1).collect()}
    usable = {i: np.array(v) for i, v, _ in rows if v and any(v)}
    expected = {}
    for q in [i for i in usable if i % 5 == 0]:
        for i, v in usable.items():
            if len(v) == len(usable[q]) and (s := float(v @ usable[q] / np.linalg.norm(v) / np.linalg.norm(usable[q]))) >= 0.1:
                expected[q, i] = s
    assert got.keys() == expected.keys() and all(abs(got[k][0] - expected[k]) < 1e-12 for k in expected)
    most = retrieval.top_k(retrieval.vector_scores(df, queries, 0.1, 4), 4, ["qid"]).select("qid", "id", "rn").collect()
    assert sorted(most) == sorted(retrieval.top_k(retrieval.vector_scores(df, queries, 0.1), 4, ["qid"]).select("qid", "id", "rn").collect())


def test_lexical_scores(spark):
    """The sums over common words equal the set formulas."""
    rows = [(1, "How do I reset my password?", "password reset account"), (2, "Change the login settings", "login"), (3, "Where is my order", ""), (4, "reset the login password please", "password login help")]
    entries = spark.createDataFrame(rows, "id long, question string, keywords string")
    queries = spark.createDataFrame([(9, "reset password"), (8, "login problem"), (7, "")], "qid long, text string")
    got = {(r["qid"], r["id"]): r["plain"] for r in retrieval.lexical_scores(entries, queries, 0.2).collect()}
    words = {r["k"]: (set(r["w"]), set(r["x"])) for r in entries.select(F.col("question").alias("t")).union(entries.select("keywords")).union(queries.select("text")).select(F.col("t").alias("k"), T.matcher_keywords(F.lower(T.matcher_form(F.col("t")))).alias("w"), T.expand_synonyms(T.matcher_keywords(F.lower(T.matcher_form(F.col("t"))))).alias("x")).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for (qid, i), plain in got.items():
        question, keys = next((q, k) for j, q, k in rows if j == i)
        own, wide = words[{9: "reset password", 8: "login problem"}[qid]]
        asked = {r for r in entries.where(f"id = {i}").select(T.matcher_keywords(F.col("question")).alias("w")).first()["w"]}
        keyed = {r for r in entries.where(f"id = {i}").select(T.matcher_keywords(F.col("keywords")).alias("w")).first()["w"]}
        every = spark.createDataFrame([(sorted(asked | keyed),)], "w array<string>").select(T.expand_synonyms(F.col("w")).alias("x")).first()["x"]
        share = len(wide & (asked | keyed)) / len(wide) if keyed else 0.0
        assert abs(plain - (0.3 * share + 0.4 * jaccard(own, asked) + 0.2 * jaccard(wide, set(every)))) < 1e-12
    assert {(9, 1), (9, 4)} <= got.keys()


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 100), ("c", 7), ("d", 7), ("e", 1)], "word string, n long")
    taken = [frequent.most_frequent(counts, most) for most in (1, 2, 3, 4, 9)]
    # the list is always filled; of the words of the last count those with the smallest hashes are taken
    first, third = taken[0], taken[2][2:]
    assert first in (["a"], ["b"]) and third in (["c"], ["d"])
    assert taken[1:] == [["a", "b"], ["a", "b", *third], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    many = spark.range(3000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), (F.col("id") % 3 + 7).alias("n"))
    some = frequent.most_frequent(many, 1500)
    assert len(some) == len(set(some)) == 1500 and some[:1000] == sorted(f"w{i}" for i in range(2, 3000, 3)) and {int(w[1:]) % 3 for w in some[1000:]} == {1}
    assert frequent.most_frequent(counts.limit(0), 5) == []


def test_typos_against_a_dictionary(spark):
    known = ["payment", "shipping", "order", "account", "grass", "moving"]
    rows = spark.createDataFrame([(1, "Teh paymnet for my ordr"), (2, "grasss muving"), (3, ""), (4, None), (1, "Teh paymnet for my ordr")], "id long, text string")
    got = sorted([(r["id"], r["fixed"], r["n_fixed"], r["confidence"]) for r in typos.fix_texts(rows, [*known, "for", "my"]).collect()], key=str)
    assert got == sorted([(1, "The payment for my order", 3, 0.7), (1, "The payment for my order", 3, 0.7), (2, "grass moving", 2, 0.5), (3, "", 0, 1.0), (4, None, 0, 1.0)], key=str)
    assert typos.repaired("hellooo", {"hello"}) == "hello" and typos.repaired("yyes", {"yes"}) == "yes" and typos.repaired("balll", {"bal"}) == "ball"
    plain = typos.Dictionary(known)
    for word in ["paymant", "shiping", "acount", "zzzz", "o", "mvoing"]:
        ratios = {w: SequenceMatcher(None, word, w).ratio() for w in known if abs(len(w) - len(word)) <= 2}
        best = max(ratios.values(), default=0)
        want = next(w for w in sorted(ratios, key=lambda w: (len(w), w)) if ratios[w] == best) if len(word) > 1 and best > 0.7 else None
        assert plain.closest([word, "x", word]) == [want and (want, best), None, want and (want, best)]
    assert typos.correction_confidence("a", "a") == 1.0 and typos.correction_confidence("teh cat", "the cat") < 1


def test_similar_words_like_all_pairs(spark):
    """Every unknown word of a whole table against every word of the dictionary, one by one."""
    words, known = text_queries._unknown_words(spark, "/root/testdata/sf0.001")
    got = {r["word"]: (r["closest"], r["ratio"]) for r in typos.similar_words(words, known).collect()}
    want = {}
    for (word,) in words.collect():
        best = (0.7, 0, "")
        for other in known:
            if len(word) > 1 and abs(len(other) - len(word)) <= 2:
                matcher = SequenceMatcher(None, word, other)
                if matcher.real_quick_ratio() >= best[0] and matcher.quick_ratio() >= best[0] and (ratio := matcher.ratio()) >= best[0] and (ratio > best[0] or (best[2] and (len(other), other) < best[1:])):
                    best = (ratio, len(other), other)
        if best[2]:
            want[word] = (best[2], best[0])
    assert got == want and len(want) > 100


def test_bounds_of_similar_words():
    random = np.random.default_rng(6)
    letters = list("aabbcdeéü日") + ["ß", "z"]
    known = ["".join(random.choice(letters, random.integers(1, 90))) for _ in range(300)] + ["a" * 200]
    words = ["".join(random.choice(letters, random.integers(1, 90))) for _ in range(80)] + ["a" * 199, "", "b" * 70]
    own = typos.Dictionary(known)
    for word, found in zip(words, own.closest(words), strict=True):
        ratios = sorted((-SequenceMatcher(None, word, w).ratio(), len(w), w) for w in set(known) if abs(len(w) - len(word)) <= 2)
        assert found == ((ratios[0][2], -ratios[0][0]) if len(word) > 1 and ratios and -ratios[0][0] > 0.7 else None)


def test_windows_with_carry_over(spark):
    """Buckets give what one window over all of a key's rows gives."""
    random = np.random.default_rng(2)
    rows = [(int(random.integers(2)), i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(random.integers(40_000))), int(random.integers(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, ts timestamp, v long")
    both = lambda out: sorted((r["i"], r["n_window"], r["sum_window"]) for r in out.collect())
    whole = Window.partitionBy("k").orderBy("ts", "i").rowsBetween(-9, 0)
    for bucket in (60, 3600, 10**6):
        assert both(analytics.moving(df, ["k"], ["ts", "i"], "v", 10, bucket)) == both(df.withColumn("n_window", F.count("v").over(whole)).withColumn("sum_window", F.sum("v").over(whole)))
        near = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-300_000_000, 0)
        assert both(analytics.trailing(df, ["k"], "ts", "v", 300, bucket)) == both(df.withColumn("n_window", F.count("v").over(near)).withColumn("sum_window", F.sum("v").over(near)))
    alerts = df.withColumn("current_value", F.col("v"))
    runs = lambda bucket: sorted(map(tuple, analytics.deduplicated_alerts(alerts, ["k"], ["ts", "i"], 300, "ts", bucket).collect()))
    assert runs(60) == runs(3600) == runs(10**6) and len(runs(60)) > 4


def test_stream_alerts_once(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("api", "confidence", "HIGH", at(0)), ("api", "confidence", "HIGH", at(5)), ("db", "time", "LOW", at(6))]
    schema = "component string, metric string, severity string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = monitors.run_available(monitors.first_alerts(stream)).collect()
    assert sorted((r["component"], r["metric"]) for r in got) == [("api", "confidence"), ("db", "time")]
