"""A persistent cosine index: vectors in cells around learned centres, one Parquet partition for each cell.

Centres come from spherical k-means over a bounded sample (SAMPLE, a parameter); every vector is assigned
to the nearest one, in tasks, and written to its cell's partition. A search assigns each query to its
nearest cells, reads the partitions of those only, and compares queries with the vectors of their
cells, block by block. New vectors are added as a batch of their own, without touching what is there;
a batch that is added again replaces itself, and an id that is added again counts in its last batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import vectors as V
from corvina.operators import retrieval
from corvina.session import cut_lineage

#: Vectors that centres are learned from, about, and of which each centre has this many at least.
SAMPLE, PER_CENTRE = 16_384, 8
STEPS = 10
#: Cells that a query looks into.
PROBES = 12
SEED = 11


def learn_centres(sample: np.ndarray, cells: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """[cells, dimension] unit centres of unit vectors by spherical k-means; fewer if there are fewer
    distinct vectors. A centre that loses all its vectors stays where it is."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(steps):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _nearest_cells(centres: np.ndarray, most: int):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            near = np.stack(batch.to_numpy()) @ centres.T
            yield pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :most].astype(np.int32)), dtype=object)

    return find


class VectorIndex:
    """An index in a shared folder: ``centres``, ``vectors/batch=.../cell=...`` and ``replaced``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.centres = np.array([row["centre"] for row in spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()])

    @staticmethod
    def build(rows: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """A new index of ``rows`` (id, embedding). By default it has about as many cells as the square root
        of the rows, and PER_CENTRE sampled rows for each at least. Rows without a usable vector, or of
        another dimension than most, are left out."""
        spark, folder = rows.sparkSession, folder.rstrip("/")
        usable = rows.select("id", V.doubles(F.col("embedding")).alias("embedding")).where(V.usable(F.col("embedding")))
        sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        total, size = (sizes[0]["count"], sizes[0]["size"]) if sizes else (0, 0)
        share = F.lit(True) if total <= sample else F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < (sample << 40) // max(1, total)
        # about ``sample`` rows, whose number is a parameter
        picked = sorted(tuple(row) for row in usable.where((F.size("embedding") == size) & share).collect())
        vectors = np.array([embedding for _, embedding in picked]).reshape(len(picked), size)
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        cells = cells or max(1, min(round(total**0.5), len(picked) // PER_CENTRE))
        centres = learn_centres(unit, cells) if len(unit) else np.zeros((0, 0))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        spark.createDataFrame([], "id long, embedding array<double>, batch string, cell int").write.partitionBy("batch", "cell").parquet(f"{folder}/vectors")
        spark.createDataFrame([], "id long, batch string").write.parquet(f"{folder}/replaced")
        index = VectorIndex(spark, folder)
        index.add(rows, "0")
        return index

    def _assigned(self, rows: DataFrame, most: int) -> DataFrame:
        """``rows`` (embedding and others) with ``cells``: the nearest ones of each usable vector."""
        if not len(self.centres):
            return rows.where("false").withColumn("cells", F.array().cast("array<int>"))
        usable = rows.withColumn("embedding", V.doubles(F.col("embedding"))).where(V.usable(F.col("embedding")) & (F.size("embedding") == self.centres.shape[1]))
        return usable.withColumn("cells", F.pandas_udf(_nearest_cells(self.centres, most), "array<int>")("embedding"))

    def vectors(self) -> DataFrame:
        """id, embedding, batch, cell as they are stored."""
        return self.spark.read.schema("id long, embedding array<double>, batch string, cell int").parquet(f"{self.folder}/vectors")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Adds ``rows`` (id, embedding) as a batch, whose names rise. Only the ids of earlier batches are read:
        those that come again are listed as replaced. Of rows that share an id in a batch one counts."""
        new = self._assigned(rows.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null").groupBy("id").agg(F.min("embedding").alias("embedding")), 1)
        new = new.select("id", "embedding", F.get("cells", F.lit(0)).alias("cell"))
        # each cell's rows go to a few files, those of a large cell to several
        new.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/vectors/batch={batch}")
        old = self.vectors().where(F.col("batch") < batch).select("id", "batch")
        again = old.join(self.vectors().where(F.col("batch") == batch).select("id"), "id", "left_semi")
        again.write.mode("overwrite").parquet(f"{self.folder}/replaced/by={batch}")

    def search(self, queries: DataFrame, k: int, threshold: float = -1.0, probes: int = PROBES, keep: Column | None = None) -> DataFrame:
        """qid, id, sim, rn: the k most alike vectors of each query (qid, embedding) among those of its
        ``probes`` nearest cells whose cosine is at least ``threshold``, ties to the smaller id. ``keep``: a
        condition on id, checked before vectors meet."""
        asked = cut_lineage(self._assigned(queries.select("qid", "embedding"), probes))
        asked = asked.select("qid", "embedding", F.explode("cells").alias("cell"))
        # the cells are no more than the sample is large; naming them prunes the partitions that are read
        named = [row["cell"] for row in asked.select("cell").distinct().collect()]
        held = self.vectors().where(F.col("cell").isin(named))
        replaced = self.spark.read.schema("id long, batch string").parquet(f"{self.folder}/replaced")
        if not replaced.isEmpty():
            held = held.join(replaced.select("id", "batch").distinct(), ["id", "batch"], "left_anti")
        held = (held if keep is None else held.where(keep)).select("id", "embedding", "cell")
        scored = retrieval.cell_scores(held, asked, threshold, k)
        return retrieval.top_k(scored, k, ["qid"])


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (qid, id) that ``found`` has."""
    total = exact.count()
    return found.select("qid", "id").join(exact.select("qid", "id"), ["qid", "id"]).count() / total if total else 1.0
