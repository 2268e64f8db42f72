"""Classes of rows from links between them: connected components, and links found through bands.

Rows that share a band (a hash that similar rows are likely to share) are candidates. A band's rows are
first compared with one leader, then, where that leaves a band with several classes, with another, and
what still shares a band but no class meets in blocks of a fixed size. So a band of any size is worked
through without all of its pairs, and no candidate pair of different classes goes uncompared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import cut_lineage

#: Links that one task passes on: a step of a small graph doesn't write a file for each of many tasks.
TASK_EDGES = 100_000
#: Rows of a band that meet each other at once.
BLOCK = 1024
#: Rows of a block that meet the others at once, and pairs whose marks and codes are compared at once.
STRIP, PAIRS = 256, 16_384


class Bound(Protocol):
    """What rows' codes tell of which pairs could be confirmed at all: ``some`` of each row of one array with each of another,
    at little cost, and ``pairs`` of each row with that in its place."""

    def some(self, left: np.ndarray, right: np.ndarray) -> np.ndarray: ...

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray: ...


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id of its component) for every id of ``links`` (a, b), by alternating
    large and small stars.

    A step hangs each node's larger neighbours, then its smaller ones, under its smallest neighbour,
    until nothing changes: each component is then a star. Every step is written to the checkpoint
    folder. Only minima are aggregated, so a hub's neighbours are never gathered in one place.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before, tasks = now, now[0] // TASK_EDGES + 1
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").coalesce(tasks).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _meet(least: float, may_link: Bound | None) -> Callable:
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        key = ["band", "left", "right"]
        for batch in _and_none(batches):
            if batch is not None:
                waiting.append(batch)
            if not waiting:
                continue
            frame = pd.concat(waiting, ignore_index=True)
            keys = frame[key].to_numpy()
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            bounds = [0, *cuts] + ([len(frame)] if batch is None else [])
            found = []
            for start, end in zip(bounds, bounds[1:], strict=False):
                part = frame.iloc[start:end]
                marks = np.stack([np.frombuffer(x, np.uint8) for x in part["marks"]])
                codes = np.stack([np.frombuffer(x, "<u4") for x in part["codes"]]) if may_link else None
                ids, roots, side, other_side = part["id"].to_numpy(), part["root"].to_numpy(), part["is_left"].to_numpy(), part["is_right"].to_numpy()
                rows, columns = np.flatnonzero(side), np.flatnonzero(other_side)
                for k in range(0, len(rows) if len(columns) else 0, STRIP):
                    strip = rows[k : k + STRIP]
                    # each pair once, though both of its rows are on both sides
                    may = (roots[strip][:, None] != roots[columns]) & ~(other_side[strip][:, None] & side[columns] & (strip[:, None] >= columns))
                    if may_link and may.any():
                        may &= may_link.some(codes[strip], codes[columns])
                    left, right = np.nonzero(may)
                    left, right = strip[left], columns[right]
                    for at in range(0, len(left), PAIRS):
                        a, b = left[at : at + PAIRS], right[at : at + PAIRS]
                        alike = np.count_nonzero(marks[a] == marks[b], axis=1) / marks.shape[1] >= least
                        a, b = a[alike], b[alike]
                        if may_link:
                            may_pair = may_link.pairs(codes[a], codes[b])
                            a, b = a[may_pair], b[may_pair]
                        found.append(np.stack((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])), axis=1))
            waiting = [] if batch is None else [frame.iloc[bounds[-1] :]]
            pairs_found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pd.DataFrame(pairs_found, columns=["a", "b"]).astype("int64").drop_duplicates()

    return pairs


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _left_over(members: DataFrame, roots: DataFrame, marks: DataFrame, least: float, may_link: Bound | None) -> DataFrame:
    """Distinct pairs (a, b) that share a band of three rows or more but no class, of whose marks at
    least a share of ``least`` agrees, and that ``may_link`` doesn't rule out by their codes."""
    known = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = known.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = known.join(mixed, "band").join(marks, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block b meets the blocks from b on: as the left one of a pair those, as the right one the others
    place = lambda left, right, is_left, is_right: F.struct(left.alias("left"), right.alias("right"), is_left.alias("is_left"), is_right.alias("is_right"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    places = F.transform(every, lambda b: F.when(b == F.col("own"), place(b, b, F.lit(True), F.lit(True))).when(b > F.col("own"), place(F.col("own"), b, F.lit(True), F.lit(False))).otherwise(place(b, F.col("own"), F.lit(False), F.lit(True))))
    own = marks.columns[1:]
    met = rest.select("band", "id", "root", *own, F.explode(places).alias("p")).select("band", "p.*", "id", "root", *own)
    met = met.repartition("band", "left", "right").sortWithinPartitions("band", "left", "right")
    return met.mapInPandas(_meet(least, may_link), "a long, b long").distinct()


def linked(bands: DataFrame, marks: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float, may_link: Bound | None = None) -> DataFrame:
    """The links that ``verify`` confirms among pairs (a, b): enough of them to connect all that are
    candidates and alike. ``bands``: id, band; ``marks``: id, marks (bytes, of which similar rows share
    many), and, for ``may_link``, codes (as many 32-bit numbers in each row). Pairs of a band that it rules
    out by their codes never become rows."""
    shared = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut_lineage(bands.join(shared, "band"))
    links = cut_lineage(verify(members.where("leader < id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()))
    members = members.drop("leader")
    roots = cut_lineage(components(links))
    known = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = known.join(degrees, "id", "left")
    other = known.groupBy("band").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("id").alias("a"), F.col("root").alias("root_a"))).alias("l")).select("band", "l.a", "l.root_a")
    again = known.join(other, "band").where("root <> root_a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    links = cut_lineage(links.unionByName(verify(again)))
    roots = cut_lineage(components(links))
    return cut_lineage(links.unionByName(verify(_left_over(members, roots, marks, least, may_link))))
