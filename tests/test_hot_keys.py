"""Operators over keys of which one has half of all rows, against one window over each key or plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvina.operators import analytics as A


@pytest.fixture(scope="module")
def events():
    random = np.random.default_rng(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(int(random.choice([1, 1, 1, 2, 3])) if i % 9 else None, i, start + dt.timedelta(minutes=int(random.integers(4000))), int(random.integers(0, 9)), bool(random.random() < 0.7)) for i in range(900)]
    return rows + [(7, 1000, start, 5, True), (8, 1001, start, 5, False)]


@pytest.fixture(scope="module")
def df(spark, events):
    return spark.createDataFrame(events, "u long, i long, ts timestamp, v long, bad boolean").repartition(6).cache()


def groups(events):
    for u in {row[0] for row in events}:
        yield u, sorted((row for row in events if row[0] == u), key=lambda row: (row[2], row[1]))


@pytest.mark.parametrize("bucket", [600, 86_400, 10**8])
def test_half_split(df, events, bucket):
    got = {r["u"]: (r["n"], r["first_mean"], r["second_mean"]) for r in A.half_split(df, ["u"], ["ts", "i"], "v", 0.2, 5, bucket).collect()}
    for u, rows in groups(events):
        half, v = len(rows) // 2, [row[3] for row in rows]
        assert got[u] == (len(v), sum(v[:half]) / half if half else None, sum(v[half:]) / (len(v) - half))


def test_head_and_tail(df, events):
    got = {r["u"]: (r["n"], r["head_mean"], r["tail_mean"]) for r in A.head_tail(df, ["u"], ["ts", "i"], "v").collect()}
    ends = {r["u"]: (r["first"], r["last"]) for r in A.first_last(df, ["u"], ["ts", "i"], "v", 3).collect()}
    for u, rows in groups(events):
        v, size = [row[3] for row in rows], min(5, len(rows) // 3)
        assert got[u] == ((len(v), sum(v[:size]) / size, sum(v[-size:]) / size) if size else (len(v), None, None))
        assert ends[u] == (v[:3], v[-3:])


def test_ends_are_cut_before_the_shuffle(df):
    plan = A.first_last(df, ["u"], ["ts", "i"], "v", 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 4


@pytest.mark.parametrize("bucket", [600, 86_400, 10**8])
def test_streaks(df, events, bucket):
    got = {r["i"]: r["streak"] for r in A.streaks(df, ["u"], ["ts", "i"], F.col("bad"), bucket).collect()}
    for _, rows in groups(events):
        streak = 0
        for row in rows:
            streak = streak + 1 if row[4] else 0
            assert got[row[1]] == streak


@pytest.mark.parametrize("bucket", [600, 86_400, 10**8])
def test_sessions(df, events, bucket):
    got = sorted(((r["u"], r["session_no"], r["started_at"], r["last_activity"], r["n_interactions"]) for r in A.sessions(df, ["u"], "ts", 30, bucket).collect()), key=str)
    want = []
    for u, rows in groups(events):
        no, last = 0, None
        for row in rows:
            if last is None or row[2] - last > dt.timedelta(minutes=30):
                no += 1
                want.append([u, no, row[2], row[2], 0])
            want[-1][3], want[-1][4], last = row[2], want[-1][4] + 1, row[2]
    assert got == sorted(map(tuple, want), key=str)


def test_smoothed(spark):
    """A long history gives the very double that folding all of it gives."""
    random = np.random.default_rng(9)
    rows = [(1, i, int(random.integers(0, 100))) for i in range(5000)] + [(2, 0, 0), (2, 1, 0), (2, 2, 4), (2, 3, 8), (3, 0, 0)]
    got = {r["u"]: r["ema"] for r in A.smoothed(spark.createDataFrame(rows, "u int, i int, v int"), ["u"], "i", "v").collect()}
    for u in (1, 2, 3):
        ema = 0.0
        for v in [v for w, _, v in rows if w == u]:
            ema = float(v) if ema == 0.0 else ema * (1 - 0.1) + v * 0.1
        assert got[u] == ema and math.isfinite(ema)


def test_runs_of_alerts(df):
    """The form with buckets against one window over all of a key's rows."""
    alerts = df.withColumn("current_value", F.col("v"))
    window = Window.partitionBy("u").orderBy("ts", "i")
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(window)) > 300_000_000, F.lit(True)).cast("int")
    plain = alerts.withColumn("new", new).withColumn("alert_no", F.sum("new").over(window)).groupBy("u", "alert_no").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.max_by("v", F.struct("ts", "i")).alias("v"))
    want = sorted(map(tuple, plain.collect()), key=str)
    for bucket in (60, 3600, 10**8):
        assert sorted(map(tuple, A.deduplicated_alerts(alerts, ["u"], ["ts", "i"], 300, "ts", bucket).collect()), key=str) == want
