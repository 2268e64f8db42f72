"""Ingestion of documents into a store: validated, compared with what is held, extracted, and written by key.

The job is incremental and can be run again at any point. A document that can't be taken becomes a row
that says why, never a failed task. Entries are committed before the documents' hashes, so a run that
dies in between does the same documents once more, and replaces what it has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import patterns
from corvina.session import cut_lineage
from corvina.sources.snapshots import Snapshots

#: Bytes of a document above which it is refused.
LARGEST = 50 << 20
DOCUMENTS = "document string, hash string, n_entries long"


def judged(incoming: DataFrame, held: DataFrame, largest: int = LARGEST, force: bool = False) -> DataFrame:
    """A row for each document of ``incoming`` (document, content): document, hash, status, reason.

    status: ``invalid`` (no document name, no content, too large, cut off before its end, or one name with several
    contents), ``skipped`` (``held`` (document, hash) has it with this hash, unless ``force``) or
    ``accepted``. Documents that come twice with the same content count once; rows without a name each
    have their own. Contents themselves are neither shuffled nor sorted here, only their hashes."""
    content = F.col("content")
    reason = (
        F.when(F.coalesce(F.btrim("document"), F.lit("")) == "", "no name")
        .when(F.coalesce(F.btrim(content), F.lit("")) == "", "no content")
        .when(F.octet_length(content) > largest, "too large")
        .when(content.rlike(r"(?i)<html[ \t\n\f\r>]") & ~content.rlike(r"(?i)</html[ \t\n\f\r]*>[ \t\n\f\r]*\z"), "cut off")
    )
    rows = incoming.select("document", F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256).alias("hash"), reason.alias("reason"))
    named = rows.where("reason is null or reason <> 'no name'")
    one = named.groupBy("document").agg(F.min("hash").alias("hash"), F.max("hash").alias("_other"), F.max("reason").alias("reason"))
    one = one.withColumn("reason", F.when(F.col("hash") != F.col("_other"), "several contents").otherwise(F.col("reason"))).drop("_other")
    both = one.unionByName(rows.where("reason = 'no name'"))
    known = held.groupBy(F.col("document").alias("_document")).agg(F.max("hash").alias("_hash"))
    both = both.join(known, F.col("document") == F.col("_document"), "left")
    unchanged = F.lit(not force) & F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    status = F.when(F.col("reason").isNotNull(), "invalid").when(unchanged, "skipped").otherwise("accepted")
    why = F.coalesce("reason", F.when(unchanged, "unchanged").when(F.col("_hash").isNull(), "new").otherwise("changed"))
    return both.select("document", "hash", status.alias("status"), why.alias("reason"))


def html_entries(accepted: DataFrame) -> DataFrame:
    """Entries of HTML documents (document, content), with their document."""
    found = patterns.entries(accepted.select(F.col("document").alias("page_id"), F.col("content").alias("html")))
    return found.withColumnRenamed("page_id", "document")


class Ingestion:
    """A store of documents and one of their entries, under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, extract: Callable[[DataFrame], DataFrame] = html_entries):
        self.spark, self.extract = spark, extract
        self.documents, self.entries = (Snapshots(spark, f"{folder.rstrip('/')}/{name}") for name in ("documents", "entries"))

    @staticmethod
    def create(spark: SparkSession, folder: str, extract: Callable[[DataFrame], DataFrame] = html_entries) -> Ingestion:
        for name in ("documents", "entries"):
            Snapshots.create(spark, f"{folder.rstrip('/')}/{name}")
        return Ingestion(spark, folder, extract)

    def held(self) -> DataFrame:
        return self.documents.read() if self.documents.current() else self.spark.createDataFrame([], DOCUMENTS)

    def run(self, incoming: DataFrame, force: bool = False, largest: int = LARGEST) -> DataFrame:
        """Takes ``incoming`` (document, content) and returns a row for each of its documents: document, status
        (invalid, skipped, ingested), reason, n_entries (0 but for ingested ones). A document without entries is
        held too, so that it isn't read again."""
        status = cut_lineage(judged(incoming, self.held(), largest, force))
        accepted = status.where("status = 'accepted'").select("document", "hash")
        if accepted.isEmpty():
            return status.withColumn("n_entries", F.lit(0).cast("long")).drop("hash")
        rows = incoming.select("document", "content").join(accepted.select("document"), "document", "left_semi")
        # copies of an accepted document are all alike
        found = cut_lineage(self.extract(rows).dropDuplicates(["id"]))
        entries = found
        if self.entries.current():
            entries = self.entries.read().join(accepted.select("document"), "document", "left_anti").unionByName(found)
        self.entries.commit(entries)
        sizes = found.groupBy("document").agg(F.count("*").alias("n"))
        now = accepted.join(sizes, "document", "left").select("document", "hash", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"))
        self.documents.commit(self.held().join(accepted.select("document"), "document", "left_anti").unionByName(now))
        out = status.join(now.select(F.col("document").alias("_d"), "n_entries"), (F.col("document") == F.col("_d")) & (F.col("status") == "accepted"), "left")
        return out.select("document", F.when(F.col("status") == "accepted", "ingested").otherwise(F.col("status")).alias("status"), "reason", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"))
