"""A change feed into a store of entries: each micro-batch's changes are written once, under its number, and the
store is what the last change of each key says.

Changes carry a version, so neither their order nor a micro-batch that is run again matters: running
one again replaces what it wrote, and of a key's changes the one with the highest version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_changes(changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The change with the highest version of each key; of one version, a deletion, then the larger hash of
    the row. Only one row a key and task is shuffled. A null key or version is no change."""
    rows = changes.where(F.col(key).isNotNull() & F.col(version).isNotNull())
    # of a struct and a hash the greatest is kept while rows stream by: no key's changes are gathered
    order = F.struct(F.col(version).alias("v"), (F.col("op") == "delete").alias("d"), F.xxhash64(*[F.col(c) for c in sorted(changes.columns)]).alias("h"))
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns]), order).alias("r"))
    return best.select("r.*")


def store_of(changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The entries that all ``changes`` (key, version, op: upsert or delete, ...) leave."""
    return last_changes(changes, key, version).where("op <> 'delete'").drop("op")


class Feed:
    """The log of a change feed in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "id", version: str = "version"):
        self.spark, self.folder, self.schema, self.key, self.version = spark, folder.rstrip("/"), schema, key, version
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/changes/batch=-1")

    def write(self, changes: DataFrame, number: int) -> None:
        """What ``foreachBatch`` calls: the last change of each key of a micro-batch, under its number."""
        last_changes(changes, self.key, self.version).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")

    def run(self, stream: DataFrame) -> None:
        """Takes all that a stream has, going on where the last run ended."""
        writer = stream.writeStream.foreachBatch(self.write).trigger(availableNow=True)
        writer.option("checkpointLocation", f"{self.folder}/checkpoint").start().awaitTermination()

    def changes(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.folder}/changes").drop("batch")

    def entries(self) -> DataFrame:
        return store_of(self.changes(), self.key, self.version)
