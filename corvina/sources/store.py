"""The knowledge-base store as DataFrames: change detection, upserts, deletes, versions, exports.

A store is a Parquet folder with one row per entry (id, document, hash and any other columns). The
functions return the new state; ``write`` replaces only the partitions that it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changed(incoming: DataFrame, state: DataFrame, key: str = "document", digest: str = "hash") -> DataFrame:
    """Documents that the state doesn't hold with this hash."""
    return incoming.join(state.select(key, digest).distinct(), [key, digest], "left_anti")


def upsert(state: DataFrame, incoming: DataFrame, key: str = "document") -> DataFrame:
    """The state without the incoming documents' old entries, and their new ones that have a vector."""
    kept = state.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming.where("embedding is not null"), allowMissingColumns=True)


def update(state: DataFrame, updates: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``column`` replaced where ``updates`` (key, column) has a value; unknown keys are ignored."""
    new = updates.select(key, F.col(column).alias("_new"))
    return state.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def remove(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, by: list[str], order: list, keep: int = 1) -> DataFrame:
    """The newest ``keep`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def merge(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the source's values, or the target's for nulls."""
    t, s = target.alias("t"), source.alias("s")
    columns = [F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) for c in target.columns]
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full").select(*columns)


def write(state: DataFrame, path: str, partition: str | None = None) -> None:
    writer = state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def backup(spark: SparkSession, path: str, version: str) -> str:
    """Copies the store under ``<path>_versions/version=...`` and returns that path."""
    to = f"{path.rstrip('/')}_versions/version={version}"
    spark.read.parquet(path).write.mode("overwrite").parquet(to)
    return to


def restore(spark: SparkSession, path: str, version: str) -> None:
    spark.read.parquet(f"{path.rstrip('/')}_versions/version={version}").write.mode("overwrite").parquet(path)


def export_rows(entries: DataFrame) -> DataFrame:
    """Entries as exports show them: lengths and number of keywords beside the texts."""
    return entries.select("id", "question", "answer", F.array_join("keywords", ", ").alias("keywords"), F.length("question").alias("question_length"), F.length("answer").alias("answer_length"), F.size("keywords").alias("keyword_count"))


def export_csv(entries: DataFrame, path: str) -> None:
    export_rows(entries).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(entries: DataFrame, path: str) -> None:
    export_rows(entries).write.mode("overwrite").json(path)
