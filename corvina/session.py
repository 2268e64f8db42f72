"""Session defaults used by the bench, the tests and interactive work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str, shuffle_partitions: int, **extra: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; ``extra`` overrides any default."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data directory; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only a session on one machine
    (tests) may do without: it gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith(("local[", "local*")) and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="corvina-")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation
    from the start."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int, least: int = 64, most: int = 10_000) -> DataFrame:
    """``df`` of so many rows, each of which costs much work in Python, over tasks of ``least`` to ``most``
    rows: tasks cut by bytes would have too many of them."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(rows // least, max(usual, rows // most))))
