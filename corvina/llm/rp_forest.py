"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue.

A tree halves the vectors again and again across a hyperplane between two randomly drawn ones, moved
to the middle of the two sides it separates. The forest is fitted on a bounded sample (SAMPLE, a
parameter) and holds hyperplanes only; every vector is then indexed, a row for each tree's leaf. A
query walks all trees from one queue ordered by the squared margins it has crossed, until it has
opened LEAVES leaves. Leaves and the queries that opened them meet in bins, full leaves in several,
where candidates are ranked by exact distances in double precision.

Rows with the same vector are one node, which remembers the few smallest ids that any query can
need, so a very common vector neither fills a leaf nor lengthens a list. Lists are cut by ids, not by
nodes: an id with several near vectors takes one place.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import cut_lineage, in_sample

NEAREST = 10
TREES = 16
LEAVES = 480
#: Vectors that the forest is fitted on, about: those whose ids' hashes are small enough.
SAMPLE = 16384
LEAF_SIZE = 32
MEANS_STEPS, MEANS_SAMPLE = 5, 400
SEED = 7
#: Rows of a leaf that meet its queries at once, and rows of a bin.
LEAF_ROWS, BIN_ROWS = 4096, 20_000


class Forest:
    """Trees as arrays: a node has a hyperplane (normal, offset) and two children, or is a leaf (-1)."""

    def __init__(self, normals: np.ndarray, offsets: np.ndarray, children: np.ndarray, roots: np.ndarray):
        self.normals, self.offsets, self.children, self.roots = normals, offsets, children, roots

    def parts(self) -> tuple:
        return self.normals, self.offsets, self.children, self.roots

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """[vectors, trees]: the leaf that each vector lies in."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots.tolist()):
            todo = [(root, np.arange(len(vectors)))]
            while todo:
                at, rows = todo.pop()
                if not len(rows):
                    continue
                if self.children[at, 0] < 0:
                    out[rows, t] = at
                    continue
                right = vectors[rows] @ self.normals[at] >= self.offsets[at]
                todo += [(self.children[at, 0], rows[~right]), (self.children[at, 1], rows[right])]
        return out

    def opened(self, vector: np.ndarray, leaves: int) -> list[int]:
        """The leaves that a query opens, those of all trees in one order."""
        queue = [(0.0, root) for root in self.roots.tolist()]
        heapq.heapify(queue)
        margins = self.normals @ vector - self.offsets
        found: list[int] = []
        while queue and len(found) < leaves:
            crossed, at = heapq.heappop(queue)
            while (left := int(self.children[at, 0])) >= 0:
                right, margin = int(self.children[at, 1]), float(margins[at])
                near, far = (right, left) if margin >= 0 else (left, right)
                heapq.heappush(queue, (crossed + margin * margin, far))
                at = near
            found.append(at)
        return found


def fit(sample: np.ndarray, trees: int = TREES, leaf_size: int = LEAF_SIZE, seed: int = SEED) -> Forest:
    """A forest on the rows of ``sample``. A set that no drawn hyperplane divides stays one leaf."""
    random = np.random.default_rng(seed)
    normals, offsets, children, roots = [], [], [], []

    def node() -> int:
        normals.append(np.zeros(sample.shape[1]))
        offsets.append(0.0)
        children.append((-1, -1))
        return len(children) - 1

    for _ in range(trees):
        roots.append(node())
        todo = [(roots[-1], np.arange(len(sample)))]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= leaf_size:
                continue
            a, b = sample[random.choice(rows, 2, replace=False)]
            some = sample[rows if len(rows) <= MEANS_SAMPLE else random.choice(rows, MEANS_SAMPLE, replace=False)]
            for _ in range(MEANS_STEPS):
                nearer = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
                if nearer.all() or not nearer.any():
                    break
                a, b = some[nearer].mean(axis=0), some[~nearer].mean(axis=0)
            length = float(np.linalg.norm(a - b))
            if not length:
                continue
            normal = (a - b) / length
            offset = float((a + b) @ normal / 2)
            right = sample[rows] @ normal >= offset
            if right.all() or not right.any():
                continue
            normals[at], offsets[at], children[at] = normal, offset, (node(), node())
            todo += [(children[at][0], rows[~right]), (children[at][1], rows[right])]
    return Forest(np.array(normals), np.array(offsets), np.array(children), np.array(roots))


def usable(vector: Column) -> Column:
    """Neither null nor zero, with finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _index(forest, leaves: int):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Forest(*forest.value)
        for rows in batches:
            if not len(rows):
                continue
            vectors = np.stack(rows["vector"].to_numpy())
            rows["leaves"] = list(own.leaves_of(vectors))
            asks = rows["asks"].to_numpy()
            rows["opens"] = [own.opened(v, leaves) if ask else [] for v, ask in zip(vectors, asks, strict=True)]
            yield rows[["node", "vector", "ids", "leaves", "opens"]]

    return index


def _first_ids(ids: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the nearest NEAREST + 1 ids, each at its nearest, ties by id."""
    order, size = np.lexsort((ids, distance)), NEAREST + 1
    while True:
        first = np.unique(ids[order[:size]], return_index=True)[1]
        if len(first) > NEAREST or size >= len(order):
            return order[np.sort(first)[: NEAREST + 1]]
        size *= 4


def _nearest(key, base: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """The nearest ids of each query among the leaves of one bin that it has opened."""
    found = []
    if len(base) and len(asking):
        base = base.sort_values("leaf", kind="stable")
        vectors, ids, leaf = np.stack(base["vector"].to_numpy()), base["vec_id"].to_numpy(), base["leaf"].to_numpy()
        starts, ends = np.searchsorted(leaf, asking["opened"]), np.searchsorted(leaf, asking["opened"], side="right")
        for query, vector, start, end in zip(asking["asking"].to_numpy(), asking["sought"], starts, ends, strict=True):
            distance = np.sqrt(((vectors[start:end] - vector) ** 2).sum(axis=1))
            best = _first_ids(ids[start:end], distance)
            found.append(pd.DataFrame({"query": query, "vec_id": ids[start:end][best], "score": distance[best]}))
    if not found:
        return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64", "score": "float64"})
    out = pd.concat(found).sort_values(["query", "score", "vec_id"]).drop_duplicates(["query", "vec_id"])
    return out.groupby("query", sort=False).head(NEAREST + 1)


def nearest(vectors: DataFrame, is_query: Column, trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's NEAREST candidates found, nearest first, ties to
    the smaller id, among all rows but the query's own; all candidates if there are fewer.

    ``vectors``: vec_id, embedding; ``is_query``: a condition on vec_id. Rows that ``usable`` rejects,
    that have a null id or another dimension than most vectors take no part. Rows that share an id
    are one candidate with several vectors, as near as the nearest.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    mode = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if mode is None:
        return empty
    rows = rows.where(F.size("vector") == mode["n"]).distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    asks = rows.where(is_query).groupBy("vector").agg(F.lit(True).alias("asks"))
    nodes = rows.withColumn("place", place).where(F.col("place") <= NEAREST + 1).groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut_lineage(nodes.join(asks, "vector", "left").withColumn("asks", F.coalesce("asks", F.lit(False))))
    total = nodes.count()
    picked = sorted(nodes.select("node", "vector").where(in_sample(F.col("node"), sample, total)).collect())
    forest = vectors.sparkSession.sparkContext.broadcast(fit(np.array([row["vector"] for row in picked]), trees).parts())
    indexed = nodes.select("node", "vector", "ids", "asks").mapInPandas(_index(forest, leaves), "node long, vector array<double>, ids array<long>, leaves array<long>, opens array<long>")
    indexed = cut_lineage(indexed)
    base = indexed.select("node", "vector", "ids", F.explode("leaves").alias("leaf"))
    counts = base.groupBy("leaf").count().withColumn("parts", F.ceil(F.col("count") / LEAF_ROWS).cast("int"))
    bins = max(32, -(-total * trees // BIN_ROWS))
    # the counts have a row for each leaf of the fitted forest, whose size the sample bounds
    counts = F.broadcast(counts.select("leaf", "parts"))
    bin_of = F.pmod(F.xxhash64("leaf", "part"), F.lit(bins)).alias("bin")
    base = base.join(counts, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select(F.explode("ids").alias("vec_id"), "vector", "leaf", bin_of)
    asking = indexed.select("node", "vector", F.explode("opens").alias("leaf")).join(counts, "leaf")
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "vector", "leaf", bin_of)
    asking = asking.toDF("asking", "sought", "opened", "met")
    met = base.groupBy("bin").cogroup(asking.groupBy("met")).applyInPandas(_nearest, "query long, vec_id long, score double")
    met = met.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    # of a node's ids that ask each leaves out itself, so one more than asked for serves all of them
    near = met.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("place") <= NEAREST + 1)
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").join(nodes.select("vector", F.col("node").alias("query")), "vector").select("query_id", "query")
    out = asked.join(near.drop("place"), "query").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", final).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")
