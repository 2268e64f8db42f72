"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maximal runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a measured table may be broadcast.
BROADCAST_ROWS = 100_000

#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that the cluster shares, so that a lost executor
    costs no recomputation from the start. Only a session on one machine (tests) may do without a
    configured folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith(("local[", "local*")) and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corvina-checkpoint-"))
    return df.checkpoint(eager=True)


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session sends no more than TEXT_ROWS rows at a time to Python: workers hold whole
    texts, and with thousands of them in a batch two workers' memory outgrows what the heap leaves."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else ``df`` for a shuffled join.
    ``df`` should be materialised, since it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def in_sample(key: Column, rows: int, total: int) -> Column:
    """Whether a row belongs to a sample of about ``rows`` of ``total``, chosen by its key's hash; all do if
    there are no more. Unlike a sorted limit, of which every task sends a whole sample to the driver, this
    sends a sample in all."""
    return F.lit(True) if total <= rows else F.pmod(F.xxhash64(key), F.lit(1 << 40)) < (rows << 40) // total
