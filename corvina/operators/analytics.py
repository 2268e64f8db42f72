"""Operational analytics: buckets, trends, order statistics, moving windows, streaks, alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence_bucket(confidence: Column) -> Column:
    """high over 0.8, medium from 0.5, low under that."""
    return F.when(confidence > 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


#: Seconds of a time bucket: windows over few keys are cut into buckets, with carry-over between them; those over
#: many keys, each with fewer rows, into longer ones.
BUCKET, DAY = 3600, 86_400


def _bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).alias("_bucket")


def _bucket_of(rows: DataFrame, column: str, size: int) -> Column:
    """The bucket of a time, or of a number."""
    return _bucket(column, size) if rows.schema[column].dataType.simpleString().startswith("timestamp") else F.floor(F.col(column) / size).alias("_bucket")


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has a row for each of the keys; null is one too."""
    named = right.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return left.join(named, same, "left").drop(*[f"_of_{c}" for c in keys])


def half_split(rows: DataFrame, by: list[str], order: list[str], value: str, step: float, least: int, bucket: int = DAY) -> DataFrame:
    """Per group: n, mean of ``value`` in the first n // 2 rows and in the rest, and their trend.

    Buckets of the first column of ``order`` are counted and summed up; only the bucket in which a group's
    half ends is ranked row by row, so no group's whole history is sorted."""
    narrow = rows.select(*by, *order, value, _bucket_of(rows, order[0], bucket))
    groups = Window.partitionBy(*by)
    parts = narrow.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    parts = parts.withColumn("_upto", F.sum("_n").over(groups.orderBy("_bucket"))).withColumn("n", F.sum("_n").over(groups))
    parts = parts.withColumn("_half", F.floor(F.col("n") / 2)).withColumn("_ahead", F.col("_upto") - F.col("_n"))
    edge = (F.col("_ahead") < F.col("_half")) & (F.col("_half") < F.col("_upto"))
    first = F.sum(F.when(F.col("_upto") <= F.col("_half"), F.col("_sum")))
    rest = F.sum(F.when(F.col("_ahead") >= F.col("_half"), F.col("_sum")))
    sums = parts.groupBy(*by).agg(F.max("n").alias("n"), F.max("_half").alias("_half"), first.alias("_first"), rest.alias("_rest"))
    cut = parts.where(edge).select(*by, F.col("_bucket").alias("_edge"), (F.col("_half") - F.col("_ahead")).alias("_take"))
    split = _with(narrow, cut, by).where(F.col("_bucket").eqNullSafe(F.col("_edge")))
    split = split.withColumn("_is_first", F.row_number().over(groups.orderBy(*order)) <= F.col("_take"))
    split = split.groupBy(*by).agg(F.sum(F.when(F.col("_is_first"), F.col(value))).alias("_first_edge"), F.sum(F.when(~F.col("_is_first"), F.col(value))).alias("_rest_edge"))
    both = _with(sums, split, by)
    plus = lambda x, y: F.coalesce(F.col(x) + F.col(y), x, y)
    mean = lambda x, y, n: F.when(n > 0, plus(x, y) / n)
    out = both.select(*by, "n", mean("_first", "_first_edge", F.col("_half")).alias("first_mean"), mean("_rest", "_rest_edge", F.col("n") - F.col("_half")).alias("second_mean"))
    move = F.col("second_mean") - F.col("first_mean")
    trend = F.when(F.col("n") < least, "insufficient_data").when(move > step, "improving").when(move < -step, "declining").otherwise("stable")
    return out.withColumn("trend", trend)


def first_last(rows: DataFrame, by: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """Per group: n and the first and last ``most`` values in order (arrays, both ascending). Each task cuts its
    part of a group down to as many rows from either end before the shuffle; nothing else is sorted."""
    narrow = rows.select(*by, F.struct(*order, F.col(value).alias("_value")).alias("_item"))

    def end(direction: Column, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(direction))
        cut = narrow.withColumn("_rn", place).where(F.col("_rn") <= most)
        return cut.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["_value"]).alias(name))

    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return _with(_with(n, end(F.col("_item").asc(), "first"), by), end(F.col("_item").desc(), "last"), by)


def head_tail(rows: DataFrame, by: list[str], order: list[str], value: str, most: int = 5) -> DataFrame:
    """Per group: means of the first and last min(most, n // 3) rows."""
    ends = first_last(rows, by, order, value, most).withColumn("_size", F.least(F.lit(most), F.floor(F.col("n") / 3)).cast("int"))
    head, tail = F.slice("first", 1, F.greatest("_size", F.lit(0))), F.slice("last", F.size("last") - F.col("_size") + 1, F.col("_size"))
    total = lambda part: F.aggregate(F.filter(part, lambda x: x.isNotNull()), F.lit(0).cast(rows.schema[value].dataType), lambda s, x: (s + x).cast(rows.schema[value].dataType))
    mean = lambda part: F.when(F.col("_size") > 0, total(part) / F.col("_size"))
    return ends.select(*by, "n", mean(head).alias("head_mean"), mean(tail).alias("tail_mean"))


def order_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: upper median sorted[n // 2] and p95, which is sorted[int(0.95 n)] for more than 20
    rows and the maximum else. Values are counted first, so a group is as long as its distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    window = Window.partitionBy(*by)
    cum = counts.withColumn("_upto", F.sum("_c").over(window.orderBy(value))).withColumn("n", F.sum("_c").over(window))
    at = lambda index: F.min(F.when(F.col("_upto") > index, F.col(value)))
    p95 = F.when(F.max("n") > 20, at(F.floor(F.col("n") * 0.95))).otherwise(F.max(value))
    return cum.groupBy(*by).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("upper_median"), p95.alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"))


def moving(rows: DataFrame, by: list[str], order: list[str], value: str, size: int = 10, bucket: int = BUCKET) -> DataFrame:
    """Adds n_window and sum_window over the trailing ``size`` rows. ``order``: a time column, then what
    breaks ties.

    A key's rows are cut into buckets of time, and every bucket gets the ``size`` - 1 rows before it, which
    are in the ends of as many buckets before it: no task sorts more than a bucket of a key."""
    own = rows.withColumn("_row", F.struct("*")).withColumn("_bucket", _bucket(order[0], bucket)).select(*by, *order, value, "_bucket", "_row")
    last = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*[F.desc(c) for c in order]))
    item = F.struct(*order, value)
    ends = own.withColumn("_rn", last).where(F.col("_rn") < size).groupBy(*by, "_bucket").agg(F.array_sort(F.collect_list(item)).alias("_end"))
    before = F.flatten(F.collect_list("_end").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(-(size - 1), -1)))
    carried = ends.withColumn("_c", before).select(*by, "_bucket", F.explode(F.slice("_c", F.greatest(F.lit(1), F.size("_c") - (size - 2)), size - 1)).alias("_i"))
    carried = carried.select(*by, *[F.col(f"_i.{c}").alias(c) for c in [*order, value]], "_bucket", F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    window = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(-(size - 1), 0)
    both = own.unionByName(carried).withColumn("n_window", F.count(value).over(window)).withColumn("sum_window", F.sum(value).over(window))
    return both.where("_row is not null").select("_row.*", "n_window", "sum_window")


def trailing(rows: DataFrame, by: list[str], ts: str, value: str, seconds: int = 300, bucket: int = BUCKET) -> DataFrame:
    """Adds n_window and sum_window over rows of the trailing seconds, both ends included. A key's rows
    are cut into buckets of time no shorter than that; a bucket's last rows are also put, for its first
    ones to see, into the next bucket."""
    bucket = max(bucket, seconds)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = rows.select(F.struct("*").alias("_row"), *by, F.col(value).alias("_value"), at.alias("_at"), _bucket(ts, bucket))
    follows = (F.col("_bucket") + 1) * (bucket * 1_000_000) - F.col("_at") <= seconds * 1_000_000
    place = F.when(follows, F.array("_bucket", F.col("_bucket") + 1)).otherwise(F.array("_bucket"))
    placed = own.withColumn("_own", F.col("_bucket")).withColumn("_bucket", F.explode(place))
    window = Window.partitionBy(*by, "_bucket").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = placed.withColumn("n_window", F.count("_value").over(window)).withColumn("sum_window", F.sum("_value").over(window))
    return out.where("_bucket = _own").select("_row.*", "n_window", "sum_window")


def streaks(rows: DataFrame, by: list[str], order: list[str], failed: Column, bucket: int = DAY) -> DataFrame:
    """Adds streak: how many failed rows end here without a success between, and the tier of the
    answer that goes with it. A key's rows are cut into buckets of the first column of ``order``; what a bucket
    needs is how many failed rows the ones before it end with, which a row for each bucket tells."""
    own = rows.select(F.struct("*").alias("_row"), *by, *order, failed.cast("int").alias("_failed"), _bucket_of(rows, order[0], bucket))
    own = own.withColumn("_island", F.sum(1 - F.col("_failed")).over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    own = own.withColumn("_run", F.sum("_failed").over(Window.partitionBy(*by, "_bucket", "_island").orderBy(*order)))
    islands = own.groupBy(*by, "_bucket", "_island").agg(F.sum("_failed").alias("_run"))
    ends = islands.groupBy(*by, "_bucket").agg(F.max_by("_run", "_island").alias("_end"), (F.max("_island") > 0).cast("int").alias("_broken"))
    buckets = Window.partitionBy(*by).orderBy("_bucket")
    ends = ends.withColumn("_since", F.sum("_broken").over(buckets))
    ends = ends.withColumn("_open", F.sum("_end").over(Window.partitionBy(*by, "_since").orderBy("_bucket")))
    ends = ends.select(*by, "_bucket", F.coalesce(F.lag("_open").over(buckets), F.lit(0)).alias("_carried"))
    out = _with(own, ends, [*by, "_bucket"])
    streak = F.when(F.col("_failed") == 1, F.col("_run") + F.when(F.col("_island") == 0, F.col("_carried")).otherwise(0)).otherwise(0)
    out = out.select("_row.*", streak.alias("streak"))
    return out.withColumn("tier", F.when(F.col("streak") == 0, "answered").when(F.col("streak") == 1, "first_miss").when(F.col("streak") == 2, "second_miss").otherwise("escalate"))


#: What is left of a row's weight behind this many later ones is under 1e-40, less than a double can tell.
VANISHED = 1e-40


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """Per group: exponential moving average in order, started by the first value that isn't 0.

    The fold is sequential, but a row's weight shrinks by 1 - alpha with each later one: only as many of a
    group's last rows are folded as can change a double (VANISHED), and each task keeps no more of them."""
    most = math.ceil(math.log(VANISHED) / math.log(1 - alpha))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    last = rows.select(*by, order, value).withColumn("_rn", place).where(F.col("_rn") <= most)
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    ema = F.aggregate(F.col("_v"), F.lit(0.0), lambda s, x: F.when(s == 0.0, x[value].cast("double")).otherwise(s * (1 - alpha) + x[value] * alpha))
    return last.groupBy(*by).agg(ordered.alias("_v")).withColumn("ema", ema).drop("_v")


def quality_alerts(rows: DataFrame, confidence: Column, response_time: Column) -> DataFrame:
    """One row per alert: confidence under 0.3 (HIGH) or 0.5 (MEDIUM), response time over 5 s (HIGH)."""
    alert = lambda metric, severity, value: F.struct(F.lit(metric).alias("metric"), severity.alias("severity"), value.alias("current_value"))
    found = F.array(
        F.when(confidence < 0.5, alert("confidence", F.when(confidence < 0.3, "HIGH").otherwise("MEDIUM"), confidence)),
        F.when(response_time > 5.0, alert("response_time", F.lit("HIGH"), response_time)),
    )
    return rows.withColumn("_alert", F.explode(F.array_compact(found))).select("*", "_alert.*").drop("_alert")


def _runs(rows: DataFrame, by: list[str], order: list[str], ts: str, gap_seconds: int, bucket: int, value: Column | None = None) -> DataFrame:
    """Rows of a key that follow each other within the gap, as one: _no (from 1), first_at, last_at, n, and the last
    ``value``. A key's rows are cut into buckets of time, in which runs are found and summed up; whether a bucket's
    first run goes on from the bucket before, and its number, come from a row for each bucket."""
    gap = gap_seconds * 1_000_000
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    placed = rows.select(*by, *dict.fromkeys([*order, ts]), (F.lit(None) if value is None else value).alias("_value"), _bucket(ts, bucket))
    fresh = F.coalesce(at(ts) - F.lag(at(ts)).over(inside) > gap, F.lit(True)).cast("int")
    last = F.max(F.struct(*order, "_value")).alias("_last_row")
    runs = placed.withColumn("_fresh", fresh).withColumn("_nth", F.sum("_fresh").over(inside))
    runs = runs.groupBy(*by, "_bucket", "_nth").agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("n"), last)
    buckets = Window.partitionBy(*by).orderBy("_bucket")
    ends = runs.groupBy(*by, "_bucket").agg(F.min("first_at").alias("_first"), F.max("last_at").alias("_last"), F.max("_nth").alias("_size"))
    goes_on = F.coalesce(at("_first") - F.lag(at("_last")).over(buckets) <= gap, F.lit(False)).cast("int")
    ends = ends.withColumn("_new", F.col("_size") - goes_on).withColumn("_upto", F.sum("_new").over(buckets))
    ends = ends.select(*by, "_bucket", (F.col("_upto") - F.col("_size")).alias("_ahead"))
    numbered = _with(runs, ends, [*by, "_bucket"]).withColumn("_no", F.col("_nth") + F.col("_ahead"))
    return numbered.groupBy(*by, "_no").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"), F.max("_last_row")["_value"].alias("value"))


def deduplicated_alerts(alerts: DataFrame, by: list[str], order: list[str], gap_seconds: int, ts: str, bucket: int = BUCKET) -> DataFrame:
    """Alerts of one key that follow each other within the gap are one: first and last time, how often
    it was raised, and the last value."""
    runs = _runs(alerts, by, order, ts, gap_seconds, bucket, F.col("current_value"))
    return runs.select(*by, F.col("_no").alias("alert_no"), "first_at", "last_at", F.col("n").alias("n_raised"), F.col("value").alias("current_value"))


def sessions(rows: DataFrame, by: list[str], ts: str, gap_minutes: int = 30, bucket: int = DAY) -> DataFrame:
    """Per key and session (no gap over ``gap_minutes``): start, end, n_interactions."""
    runs = _runs(rows, by, [ts], ts, gap_minutes * 60, bucket)
    return runs.select(*by, F.col("_no").alias("session_no"), F.col("first_at").alias("started_at"), F.col("last_at").alias("last_activity"), F.col("n").alias("n_interactions"))
