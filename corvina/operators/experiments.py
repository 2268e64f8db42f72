"""A/B tests: assignment by hash, group metrics, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(user: Column, test: Column) -> Column:
    """In [0, 1): the first 32 bits of md5(user_test)."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", user.cast("string"), test).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def group_of(user: Column, test: Column, split: float = 0.5) -> Column:
    return F.when(bucket(user, test) < split, "treatment").otherwise("control")


def compare(results: DataFrame) -> DataFrame:
    """Per test and metric: n and mean of both groups, improvement in percent (0 for a control mean
    that isn't positive), significance beyond 5 percent. ``results``: test_id, grp, metric, value."""
    side = lambda name: F.col("grp") == name
    mean = lambda name: F.sum(F.when(side(name), F.col("value"))) / F.count(F.when(side(name), 1))
    out = results.groupBy("test_id", "metric").agg(F.count(F.when(side("control"), 1)).alias("n_control"), F.count(F.when(side("treatment"), 1)).alias("n_treatment"), mean("control").alias("control_mean"), mean("treatment").alias("treatment_mean"))
    gain = F.when(F.col("control_mean") > 0, (F.col("treatment_mean") - F.col("control_mean")) / F.col("control_mean") * 100).otherwise(0.0)
    return out.withColumn("improvement", gain).withColumn("significant", F.abs("improvement") > 5)


def decide(compared: DataFrame) -> DataFrame:
    """Per test: implement with two metrics that improve significantly, continue with one."""
    good = F.count(F.when(F.col("significant") & (F.col("improvement") > 0), 1))
    out = compared.groupBy("test_id").agg(good.alias("n_positive"), F.count("*").alias("n_metrics"))
    return out.withColumn("decision", F.when(F.col("n_positive") >= 2, "implement_treatment").when(F.col("n_positive") == 1, "continue_testing").otherwise("keep_control"))


def welch(results: DataFrame) -> DataFrame:
    """Per test and metric: Welch's t statistic, an addition to the percent rule."""
    of = lambda name: F.when(F.col("grp") == name, F.col("value"))
    out = results.groupBy("test_id", "metric").agg(*[f(of(g)).alias(f"{n}_{g}") for g in ("control", "treatment") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    error = F.sqrt(F.col("var_control") / F.col("n_control") + F.col("var_treatment") / F.col("n_treatment"))
    return out.withColumn("t", (F.col("mean_treatment") - F.col("mean_control")) / F.nullif(error, F.lit(0.0)))
