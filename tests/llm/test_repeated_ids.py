"""Repeated and missing ids: every row has its result, and what rows of one id share is stated."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import bag_minhash, line_dedup, quality_model, rp_forest, source_mix, url_lists


def taken_by_source(docs):
    sizes = source_mix.sized(docs)
    rows = source_mix.mix(sizes, source_mix.plan_mix(sizes)).collect()
    taken, target, largest = collections.Counter(), {}, {}
    for r in rows:
        taken[r["source"]] += r["n_copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert 0 <= r["n_copies"] <= 2
    return len(rows), taken, target, largest


@pytest.mark.parametrize("kind", ["null", "one id", "one id and text", "null and one text", "many ids"])
def test_mix_reaches_its_target(spark, kind):
    ids = {"null": F.lit(None).cast("long"), "null and one text": F.lit(None).cast("long"), "many ids": F.col("id")}.get(kind, F.lit(7).cast("long"))
    word = F.lit("w") if "text" in kind else F.concat(F.lit("w"), F.col("id"))
    rows = spark.range(4000).repartition(7).select(ids.alias("doc_id"), F.when(F.col("id") % 4 < 3, "a").otherwise("b").alias("source"), F.repeat(F.concat(word, F.lit(" ")), 10).alias("text"))
    n, taken, target, largest = taken_by_source(rows)
    assert n == 4000 and all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_mix_ranks_like_brute_force(spark):
    """The sample is the front of the ranking, row by row, as far as rows fit."""
    rows = [(i % 50 if i % 7 else None, f"s{i % 3}", " ".join(["w"] * (1 + i * i % 23) + [str(i % 90)])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    sizes = source_mix.sized(docs)
    plan = source_mix.plan_mix(sizes, bins=64)
    placed = source_mix._ranked(sizes, plan, source_mix.CAP, source_mix.SEED).collect()
    got = collections.Counter((r["source"], r["doc_id"], r["size"], r["mark"], r["n_copies"]) for r in source_mix.mix(sizes, plan).collect())
    want = collections.Counter()
    for source in ("s0", "s1", "s2"):
        own = [r for r in placed if r["source"] == source]
        rest = own[0]["target"] - sum(int(r["copies"]) * r["size"] for r in own)
        order = sorted((r for r in own if r["rank"] is not None), key=lambda r: (r["rank"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["mark"]))
        ahead, more = 0, collections.Counter()
        for r in order:
            drawn = 2 * ahead + r["size"] <= 2 * rest
            ahead += r["size"]
            want[(source, r["doc_id"], r["size"], r["mark"], int(r["copies"]) + drawn)] += 1
        for r in own:
            if r["rank"] is None:
                want[(source, r["doc_id"], r["size"], r["mark"], int(r["copies"]))] += 1
    assert got == want


def test_neighbours_by_ids(spark):
    """One candidate with twelve near vectors takes one place; all others are found."""
    rows = [(0, [0.0, 1.0]), (100, [5.0, 5.0]), (100, [0.0, 1.1])] + [(1, [0.001 * k, 1.0]) for k in range(1, 13)] + [(k, [float(k), 2.0]) for k in range(2, 14)] + [(0, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit(1)).withColumn("node", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rp_forest.nearest(df, F.col("vec_id") % 100 == 0).collect()]
    want = []
    for query in (0, 100):
        own = [v for i, v in rows if i == query]
        best = {i: min(float(np.linalg.norm(np.subtract(v, q))) for j, v in rows if j == i for q in own) for i in {i for i, _ in rows if i != query}}
        want += [(query, rank, i, round(score, 9)) for rank, (score, i) in enumerate(sorted((s, i) for i, s in best.items())[:10], 1)]
    assert sorted(got) == want


def test_texts_of_one_id_belong_together(spark):
    a, b = " ".join(f"alpha{i}" for i in range(200)), " ".join(f"beta{i}" for i in range(200))
    rows = [(7, a), (9, a + " more"), (7, b), (3, b), (20, "something else that is quite alone here"), (None, a)]
    got = {(r["doc_id"], r["class_id"]) for r in bag_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (20, 20), (None, None)}


def test_every_capture_is_judged(spark):
    rows = [(1, "http://a.com/x", 5, "k1"), (1, "http://b.com", 5, "k2"), (None, "http://a.com", 5, "k3"), (None, "http://b.com", 50, "k4"), (1, "http://a.com/x", 5, "k1"), (2, None, 5, "k5")]
    captures = spark.createDataFrame(rows, "capture_id long, url string, t long, row string").withColumn("fetched_at", F.timestamp_seconds("t")).withColumn("pattern", F.lit("clash"))
    entries = spark.createDataFrame([("a.com", "spam", "add", 4)], "pattern string, category string, action string, t long")
    intervals = url_lists.validity_intervals(entries.withColumn("at", F.timestamp_seconds("t")))
    got = sorted((r["row"], r["blocked"], r["pattern"]) for r in url_lists.judge_captures(captures, intervals).collect())
    assert got == [("k1", True, "a.com"), ("k1", True, "a.com"), ("k2", False, None), ("k3", True, "a.com"), ("k4", False, None), ("k5", False, None)]


def test_lines_of_repeated_and_missing_ids(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    rows = [(1, "menu\na", "h"), (1, "menu\nb", "h"), (None, "menu\nc", "h"), (None, "menu", "h"), (5, long, "h"), (6, "menu", "h")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_boilerplate(pages).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "b"), (None, "c"), (None, ""), (5, long), (6, "")], key=str)
    spared = {r["text"] for r in line_dedup.drop_boilerplate(pages, spare_whole=True).collect()}
    assert spared == {"a", "b", "c", "menu", long}


def test_quality_gradient_by_differences():
    random = np.random.default_rng(3)
    vectors, output, weight = random.normal(size=(5, 4)), random.normal(size=(2, 4)), np.array([0.1, 0.2, 0.3, 0.25, 0.15])
    for label in (0, 1):
        _, of_vectors, of_output = quality_model.gradient(vectors, output, weight, label)
        for array, found in ((vectors, of_vectors), (output, of_output)):
            for place in itertools.product(*map(range, array.shape)):
                was, losses = array[place], []
                for step in (1e-6, -1e-6):
                    array[place] = was + step
                    losses.append(quality_model.gradient(vectors, output, weight, label)[0])
                array[place] = was
                assert found[place] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6)


def test_quality_scores_by_brute_force(spark):
    """Scores of a table, feature by feature, with words and n-grams cut out one by one."""
    random = np.random.default_rng(4)
    table = random.normal(size=quality_model.BUCKETS).astype(np.float32)
    mask = (1 << 32) - 1

    def spread(h):
        h = h * 0x9E3779B1 & mask
        return (h ^ h >> 15) & (quality_model.BUCKETS - 1)

    def brute(text):
        raw = [32] + [32 if b in (9, 10, 11, 12, 13, 32) else b for b in (text or "").encode()] + [32]
        words = bytes(raw).split(b" ")
        hashes = [sum(b * pow(0x01000193, (k & 63) + 1, 1 << 32) for k, b in enumerate(word)) & mask for word in words if word]
        buckets = [0]
        if hashes:
            buckets += [spread(h + 7 & mask) for h in hashes]
            for a, b in itertools.pairwise(hashes):
                buckets += [spread(((a * 31 + b & mask) * 0x85EBCA6B & mask) + 11 & mask)] + [1] * (a == b)
            for n in (2, 3, 4):
                for i in range(len(raw) - n + 1):
                    h = raw[i]
                    for b in raw[i + 1 : i + n]:
                        h = h * 0x01000193 + b & mask
                    buckets.append(spread(h + (n << 20) & mask))
        return 1 / (1 + np.exp(-float(np.mean([float(table[b]) for b in buckets]))))

    texts = [None, "", " \n", "a", "the the cat", "Ünï x  y\ty", "word " * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select("text", quality_model.quality_scores(F.col("text"), table, docs).alias("s")).collect()
    for r in got:
        assert r["s"] == pytest.approx(brute(r["text"]), rel=1e-6)


def test_contradicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)] + [(3, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (3, 0), (3, 0), (4, 2), (5, None)], "doc_id long, quality int")
    held = {i for i in range(8) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    got = quality_model.labelled_sample(docs, labels)
    assert sorted(got) == sorted((t, q) for i, t, q in [(0, "text 0", 1), (3, "another text", 0)] if i not in held)
