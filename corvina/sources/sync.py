"""Synchronising a store with its source: one change set, that is either reported or applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries without a vector wait so long before they are reported.
WAIT_DAYS = 1


def changes(source: DataFrame, store: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    """key, action, reason: what makes the store hold what the source holds.

    ``source``: key, hash; ``store``: key, hash, has_vector, created_at. An entry that the store lacks is
    inserted; one whose hash differs is updated, or embedded anew if it has had no vector for WAIT_DAYS;
    one that the source lacks is an orphan and deleted. Rows that share a key count once, by their largest
    hash; a null key is none. One full outer join, so a key meets its counterpart once."""
    s = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_s")).agg(F.max("hash").alias("s_hash"))
    t = store.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_t")).agg(F.max(F.struct("hash", "has_vector", "created_at")).alias("t"))
    both = s.join(t, F.col("_s") == F.col("_t"), "full")
    waits = ~F.coalesce("t.has_vector", F.lit(False)) & (F.col("t.created_at") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(WAIT_DAYS)))
    reason = (
        F.when(F.col("_t").isNull(), "not in the store")
        .when(F.col("_s").isNull(), "not in the source")
        .when(~F.col("s_hash").eqNullSafe(F.col("t.hash")), "another text")
        .when(waits, "no vector")
        .otherwise("unchanged")
    )
    action = F.create_map(*[F.lit(x) for x in ("not in the store", "insert", "not in the source", "delete", "another text", "update", "no vector", "embed", "unchanged", "keep")])
    return both.select(F.coalesce("_s", "_t").alias(key), reason.alias("reason")).select(key, action[F.col("reason")].alias("action"), "reason")


def report(change_set: DataFrame) -> DataFrame:
    """action, reason, n: what a dry run prints."""
    return change_set.groupBy("action", "reason").agg(F.count("*").alias("n"))


def apply(change_set: DataFrame, source: DataFrame, store: DataFrame, as_of: str, vector: Column | None = None, key: str = "id") -> DataFrame:
    """The store as the change set makes it: kept rows as they are, inserted, updated and embedded ones from
    the source, created now, with ``vector`` (an expression over the source's columns), orphans gone."""
    keep = change_set.where("action = 'keep'").select(key)
    fresh = change_set.where("action in ('insert', 'update', 'embed')").select(key)
    best = source.groupBy(key).agg(F.max_by(F.struct("*"), "hash").alias("_r")).select("_r.*")
    new = best.join(fresh, key, "left_semi").withColumn("created_at", F.lit(as_of).cast("timestamp")).withColumn("has_vector", F.lit(True))
    if vector is not None:
        new = new.withColumn("embedding", vector).withColumn("has_vector", F.col("embedding").isNotNull())
    return store.join(keep, key, "left_semi").unionByName(new, allowMissingColumns=True)
