"""Versions, ingestion, synchronisation, change feeds, buffers, pages' entries and the index on small fixtures."""

import glob
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.operators import patterns, retrieval, vector_index
from corvina.sources import ingest, snapshots, sync
from corvina.streaming import buffers, feed, monitors

AS_OF = "2024-02-01 00:00:00"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    store = snapshots.Snapshots.create(spark, f"{tmp_path}/s")
    assert store.current() is None
    with pytest.raises(ValueError):
        store.read()
    one, two = (spark.createDataFrame(rows, "id long, v string") for rows in ([(1, "a"), (2, None), (2, None)], [(2, "b"), (3, "c")]))
    first, second = store.commit(one, "one"), store.commit(two)
    assert rows_of(store.read()) == [(2, "b"), (3, "c")] and rows_of(store.read(first)) == rows_of(one)
    folders = set(glob.glob(f"{tmp_path}/s/version=*"))
    store.rollback(first)
    assert rows_of(store.read()) == rows_of(one) and set(glob.glob(f"{tmp_path}/s/version=*")) == folders
    assert [r["action"] for r in store.log().orderBy("seq").collect()] == ["create", "commit", "commit", "rollback"]
    third = store.commit(two.limit(0))
    assert store.read().count() == 0 and store.verify(third)
    assert store.drop_old(2) == [first] and {r["version"] for r in store.versions().collect()} == {second, third}
    with pytest.raises(ValueError):
        store.rollback("no such version")


def test_a_job_that_dies_leaves_the_version(spark, tmp_path):
    store = snapshots.Snapshots.create(spark, f"{tmp_path}/s")
    rows = spark.range(100).withColumnRenamed("id", "k")
    first = store.commit(rows)
    dies = rows.select(F.when(F.col("k") < 90, F.col("k")).otherwise(F.raise_error(F.lit("half way"))).cast("long").alias("k"))
    with pytest.raises(Exception, match="half way"):
        store.commit(dies)
    assert store.current() == first and store.read().count() == 100
    # files of a version that are lost are noticed before it counts again
    second = store.commit(rows.limit(3))
    os.remove(glob.glob(f"{tmp_path}/s/version={first}/part-*")[0])
    with pytest.raises((ValueError, Exception)):
        store.rollback(first)
    assert store.current() == second


def test_difference_of_versions(spark):
    random.seed(1)
    old, new = ([(random.choice([None, *range(8)]), random.choice("ab")) for _ in range(n)] for n in (12, 14))
    got = {r["k"]: r["change"] for r in snapshots.difference(*(spark.createDataFrame(x, "k long, v string") for x in (old, new)), "k").collect()}
    of = lambda rows, k: sorted(v for i, v in rows if i == k)
    keys = {k for k, _ in old + new}
    assert got == {k: "added" if not of(old, k) else "removed" if not of(new, k) else "changed" for k in keys if of(old, k) != of(new, k)}


def test_applied_changes_leave_none(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "b"), (4, None), (5, "e"), (None, "x")], "id long, hash string")
    store = spark.createDataFrame([(1, "a", True, 0), (2, "old", True, 0), (5, "e", False, 3), (6, "f", True, 9), (4, None, False, 0), (None, "y", True, 0)], "id long, hash string, has_vector boolean, days int")
    store = store.withColumn("created_at", F.lit(AS_OF).cast("timestamp") - F.make_interval(days="days")).drop("days")
    change_set = sync.changes(source, store, AS_OF)
    assert rows_of(change_set.select("id", "action")) == [(1, "keep"), (2, "update"), (3, "insert"), (4, "keep"), (5, "embed"), (6, "delete")]
    done = sync.apply(change_set, source, store, AS_OF)
    again = sync.changes(source, done, AS_OF)
    assert {r["action"] for r in again.collect()} == {"keep"} and again.count() == 5
    assert {(r["reason"], r["n"]) for r in sync.report(change_set).collect()} == {("unchanged", 2), ("another text", 1), ("not in the store", 1), ("no vector", 1), ("not in the source", 1)}


PAGE = """<html><h1>Refunds</h1><table><tr><th>Question</th><th>Answer</th></tr><tr><td>How do I get a refund?</td><td>You can request a refund in your account settings.</td></tr></table>
<h2>Other</h2><ul><li>What is the policy?</li><li>The policy is that items are returned within thirty days.</li></ul><p>Where is the office? <p>The office is located in the main street, near the station.</p></html>"""


def test_entries_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>only one"), (5, PAGE)], "page_id long, html string").withColumn("kind", F.lit("clash"))
    got = patterns.entries(pages).where("page_id = 1").orderBy("starts_at").collect()
    assert [(r["kind"], r["question"], r["category"]) for r in got] == [("table", "How do I get a refund?", "Refunds"), ("list", "What is the policy?", "Other"), ("paragraph", "Where is the office?", "Other")]
    assert patterns.entries(pages).where("page_id in (2, 3, 4)").count() == 0 and patterns.entries(pages).where("page_id = 5").count() == 3
    again = patterns.entries(pages.repartition(3))
    assert rows_of(again.select("id")) == rows_of(patterns.entries(pages).select("id"))
    assert patterns.entries(pages.limit(0)).count() == 0


def test_conflicts_are_settled_like_brute_force():
    random.seed(2)
    for _ in range(300):
        found = []
        for _ in range(random.randint(0, 12)):
            start = random.randint(0, 12)
            found.append({"starts_at": start, "ends_before": start + random.randint(1, 4), "kind": random.choice("abc"), "question": "", "answer": "", "confidence": random.choice([0.3, 0.5, 0.9])})
        left, stay = list(found), []
        while left:
            best = min(left, key=lambda c: (-c["confidence"], c["starts_at"], c["ends_before"], c["kind"]))
            stay.append(best)
            left = [c for c in left if c["ends_before"] <= best["starts_at"] or best["ends_before"] <= c["starts_at"]]
        assert patterns.settle(found) == stay
        assert all(a["ends_before"] <= b["starts_at"] or b["ends_before"] <= a["starts_at"] for a, b in itertools.combinations(stay, 2))


def test_ingestion(spark, tmp_path):
    docs = [("a", PAGE), ("b", PAGE.replace("Refunds", "Returns")), ("b", PAGE.replace("Refunds", "Returns")), ("c", "<html><p>cut"), ("d", None), ("e", ""), (None, PAGE), (" ", PAGE), ("f", PAGE), ("f", PAGE + " "), ("g", "<p>nothing here</p>"), ("h", "x" * 2000)]
    incoming = spark.createDataFrame(docs, "document string, content string")
    job = ingest.Ingestion.create(spark, f"{tmp_path}/i")
    status = job.run(incoming, largest=1500)
    want = [("a", "ingested", "new", 3), ("b", "ingested", "new", 3), ("c", "invalid", "cut off", 0), ("d", "invalid", "no content", 0), ("e", "invalid", "no content", 0), ("f", "invalid", "several contents", 0), ("g", "ingested", "new", 0), ("h", "invalid", "too large", 0), (None, "invalid", "no name", 0), (" ", "invalid", "no name", 0)]
    assert rows_of(status) == sorted(want, key=str)
    assert job.entries.read().count() == 6
    # a second run skips all that was taken, and changes no version
    before = job.entries.current()
    again = job.run(incoming, largest=1500)
    assert {r["status"] for r in again.collect()} == {"skipped", "invalid"} and job.entries.current() == before
    # a changed document replaces its entries; force takes all again
    changed = job.run(spark.createDataFrame([("a", PAGE.replace("<li>", "<b>"))], "document string, content string"))
    assert rows_of(changed) == [("a", "ingested", "changed", 2)] and job.entries.read().count() == 5
    assert {r["status"] for r in job.run(incoming.where("document in ('b', 'g')"), force=True).collect()} == {"ingested"} and job.entries.read().count() == 5
    assert job.run(incoming.limit(0)).count() == 0


def test_ingestion_that_dies_between_its_commits(spark, tmp_path):
    incoming = spark.createDataFrame([("a", PAGE), ("b", PAGE)], "document string, content string")
    job = ingest.Ingestion.create(spark, f"{tmp_path}/i")
    commit, job.documents.commit = job.documents.commit, None
    with pytest.raises(TypeError):
        job.run(incoming)
    job.documents.commit = commit
    assert job.held().count() == 0 and job.entries.read().count() == 6
    assert {r["reason"] for r in job.run(incoming).collect()} == {"new"}
    assert job.entries.read().count() == 6 and job.held().count() == 2


def test_pages_of_one_address(spark, tmp_path):
    """Each page is a document of its own, as in the queries' SQL, though others have its address."""
    import duckdb

    from corvina import catalog

    pages = [(i, f"u{i % 7}", None if i == 9 else f"<html>{PAGE}{i}</html>") for i in range(30)]
    pages += [(30, "u1", "<html>cut"), (31, None, PAGE), (32, " ", PAGE), (33, "u1", PAGE + "\u0085"), (34, "u2", "<html\x0b" + PAGE[6:]), (34, "u2", "<html\x0b" + PAGE[6:])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("src12_ingest", "src13_batch"):
        assert rows_of(catalog.QUERIES[name](spark, str(tmp_path))) == sorted(duck.execute(catalog.ORACLES[name]).fetchall(), key=str)


def test_change_feed(spark, tmp_path):
    random.seed(3)
    schema = "id long, version long, op string, v string"
    changes = [(random.choice([None, *range(20)]), random.choice([None, *range(30)]), random.choice(["upsert", "upsert", "delete"]), random.choice("abc")) for _ in range(400)]
    batch = rows_of(feed.store_of(spark.createDataFrame(changes, schema)))
    # brute force: the highest version; of one version a deletion
    keys = {i for i, v, *_ in changes if i is not None and v is not None}
    top = {i: max(v for j, v, *_ in changes if j == i and v is not None) for i in keys}
    assert [r[:2] for r in batch] == sorted([(i, v) for i, v in top.items() if "delete" not in {op for j, w, op, _ in changes if (j, w) == (i, v)}], key=str)
    parts = [changes[i::7] for i in range(7)]
    for order in (range(7), reversed(range(7))):
        log = feed.Feed(spark, f"{tmp_path}/f{order}", schema)
        for number in order:
            log.write(spark.createDataFrame(parts[number], schema), number)
        log.write(spark.createDataFrame(parts[3], schema), 3)  # a micro-batch that is run again
        assert rows_of(log.entries()) == batch
    # a stream over files that arrive in two turns goes on where it ended
    log, files = feed.Feed(spark, f"{tmp_path}/s", schema), f"{tmp_path}/files"
    for part in (parts[:4], parts[4:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
        log.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(files))
    assert rows_of(log.entries()) == batch


def test_rolling_buffers(spark, tmp_path):
    """Late, tied and repeated rows, in any number of micro-batches, against the last rows of a sort."""
    random.seed(4)
    rows = [(random.choice(["a", "a", "a", "b", "c", None]), random.randint(0, 40), i, random.randint(-5, 5)) for i in range(300)]
    rows += random.sample(rows, 20)
    random.shuffle(rows)
    for i in range(0, len(rows), 80):
        part = spark.createDataFrame(rows[i : i + 80], "k string, s long, id long, value long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, id long, value long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = monitors.run_available(buffers.rolling(stream, "k", 25), "update", ("k",), f"{tmp_path}/out")
    want = []
    for k in "abc":
        last = sorted({(s, i, v) for name, s, i, v in rows if name == k})[-25:]
        values = [v for _, _, v in last]
        want.append((k, len(last), sum(values), min(values), max(values), last[0][1], last[-1][1]))
    assert rows_of(got) == want


def test_index(spark, tmp_path):
    """Clustered vectors: a few cells are enough, their partitions alone are read, adding touches no file."""
    generator = np.random.default_rng(5)
    centres = generator.normal(size=(20, 16))
    points = centres[generator.integers(0, 20, 1500)] + 0.15 * generator.normal(size=(1500, 16))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").cache()
    index = vector_index.VectorIndex.build(df.where("id % 10 <> 3 or id >= 2000"), f"{tmp_path}/x", cells=32)
    before = sorted(glob.glob(f"{tmp_path}/x/vectors/batch=0/**/*.parquet", recursive=True))
    for _ in range(2):  # a batch that is added again replaces itself
        index.add(df.where("id % 10 = 3 and id < 2000"), "1")
    assert sorted(glob.glob(f"{tmp_path}/x/vectors/batch=0/**/*.parquet", recursive=True)) == before
    assert index.vectors().count() == 1500
    queries = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    exact = retrieval.top_k(retrieval.vector_scores(df, queries, -1.0, 10), 10, ["qid"])
    assert vector_index.recall(index.search(queries, 10, probes=3), exact) >= 0.95
    assert vector_index.recall(index.search(queries, 10, probes=32), exact) == 1.0
    one = index.search(queries.where("qid = 0"), 10, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # an id that is added again counts with its last vector
    index.add(spark.createDataFrame([(7, (-points[7]).tolist())], "id long, embedding array<double>"), "2")
    found = index.search(df.where("id = 7").select(F.col("id").alias("qid"), "embedding"), 1500, probes=32)
    assert found.where("id = 7").first()["sim"] == pytest.approx(-1.0) and found.count() == 1500
    assert vector_index.VectorIndex(spark, f"{tmp_path}/x").search(queries, 3, keep=F.col("id") < 5, probes=32).where("id >= 5").count() == 0
    empty = vector_index.VectorIndex.build(df.limit(0), f"{tmp_path}/e")
    assert empty.search(queries, 3).count() == 0


def test_recall_of_the_registered_search(spark):
    import __spark_entry__

    known = __spark_entry__.queries()
    sf_dir = "/root/testdata/sf0.01"
    assert vector_index.recall(known["src22_indexed_topk"](spark, sf_dir), known["j01_vector_topk"](spark, sf_dir)) >= 0.9
