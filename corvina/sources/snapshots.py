"""A store of whole versions: each is a Parquet folder that is written once, and a log says which one counts.

Nothing is ever changed in place. A version's rows are written, read again and summed up, and only
then does one small file in the log make it the current one; a job that dies before that leaves the store
as it was. Going back to a version adds a row to the log and copies nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "seq long, action string, version string, parent string, note string, n_rows long, checksum string"


def row_hash(rows: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])


def summed_up(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and the sum of their hashes, which doesn't depend on their order."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_hash(rows).cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return found["n"], str(int(found["h"]))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Snapshots:
    """Versions under a folder. One writer at a time is expected; of two that log at once one is told so."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(spark: SparkSession, path: str) -> Snapshots:
        """A new store without rows or versions."""
        store = Snapshots(spark, path)
        store._write((0, "create", None, None, "", 0, "0"))
        return store

    def _write(self, row: tuple) -> None:
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.path}/log")

    def _head(self) -> tuple[int, str | None]:
        """The last number of the log and the current version."""
        head = self.log().orderBy(F.desc("seq"), "version").first()
        return head["seq"], head["version"]

    def _append(self, seq: int, action: str, version: str | None, *rest) -> None:
        self._write((seq, action, version, *rest))
        if self._head() != (seq, version):
            raise RuntimeError(f"another writer has logged step {seq} of {self.path}")

    def current(self) -> str | None:
        return self._head()[1]

    def commit(self, rows: DataFrame, note: str = "") -> str:
        """Writes ``rows`` as a new version, checks what was written and makes it the current one."""
        seq, parent = self._head()
        version = f"{seq + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/version={version}")
        n, checksum = summed_up(self._rows(version))
        self._append(seq + 1, "commit", version, parent, note, n, checksum)
        return version

    def rollback(self, version: str) -> None:
        """Makes an earlier version the current one, if its rows are still those that were committed."""
        seq, parent = self._head()
        if not self.verify(version):
            raise ValueError(f"version {version} isn't what was committed")
        was = self._entry(version)
        self._append(seq + 1, "rollback", version, parent, "", was["n_rows"], was["checksum"])

    def _entry(self, version: str):
        found = self.log().where((F.col("action") == "commit") & (F.col("version") == version)).first()
        if found is None:
            raise ValueError(f"no version {version}")
        return found

    def verify(self, version: str) -> bool:
        was = self._entry(version)
        return summed_up(self._rows(version)) == (was["n_rows"], was["checksum"])

    def _rows(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def read(self, version: str | None = None) -> DataFrame:
        """Rows of a version, of the current one by default."""
        version = version or self.current()
        if version is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(version)

    def versions(self) -> DataFrame:
        """version, parent, note, n_rows, is_current: a row for each committed version that isn't dropped."""
        log, current = self.log(), self.current()
        dropped = log.where("action = 'drop'").select(F.col("note").alias("version"))
        kept = log.where("action = 'commit'").join(dropped, "version", "left_anti")
        return kept.select("version", "parent", "note", "n_rows", F.col("version").eqNullSafe(F.lit(current)).alias("is_current"))

    def drop_old(self, keep: int = 10) -> list[str]:
        """Deletes the versions behind the newest ``keep``, never the current one; their names."""
        names = [row["version"] for row in self.versions().where("not is_current").orderBy(F.desc("version")).limit(10_000).collect()]
        gone = names[max(0, keep - 1) :]
        for name in gone:
            seq, current = self._head()
            self._append(seq + 1, "drop", current, None, name, 0, "0")
            delete_folder(self.spark, f"{self.path}/version={name}")
        return gone


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: added, removed or changed rows between two versions, by key; columns of both count. Of
    rows that share a key (null is one like any other), the versions' numbers and sums are compared."""
    columns = sorted(set(old.columns) & set(new.columns))

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(*columns)
        return rows.groupBy(F.col(key).alias(f"_{name}")).agg(F.struct(F.count("*").alias("n"), F.sum(row_hash(rows).cast("decimal(20,0)")).alias("h")).alias(name))

    before, after = side(old, "before"), side(new, "after")
    both = before.join(after, F.col("_before").eqNullSafe(F.col("_after")), "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select(F.coalesce("_before", "_after").alias(key), change.alias("change")).where("change is not null")

