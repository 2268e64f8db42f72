"""The most frequent of many counted words, as a list of bounded length on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import cut_lineage

#: Classes of counts to a doubling, and parts into which words of one count are dealt by their hashes.
STEPS, PARTS = 16, 1 << 16


def _whole(sizes: list[tuple[int, int]], room: int) -> tuple[list[int], int | None, int]:
    """Of (key, size) in order: the keys taken whole, the one that is taken in part, and the room left for it."""
    taken = []
    for key, size in sizes:
        if size > room:
            return taken, key if room else None, room
        taken.append(key)
        room -= size
    return taken, None, room


def most_frequent(counts: DataFrame, most: int) -> list[str]:
    """The words of ``counts`` (word, n), most frequent first, listed by code point within a count: the first
    ``most``, all if there are no more. Counts are put in classes, STEPS to a doubling, then looked at
    one by one in the class that fits in part; of the words of the last count those with the smallest hashes
    are taken. A row for each class, count of one class or part, and the words taken come to the
    driver, with a PARTS-th of the words of one count, whatever the number of words or tasks."""
    classed = cut_lineage(counts.select("word", "n", F.floor(F.log2("n") * STEPS).alias("class"), F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part")))
    sizes = lambda rows, key: [(row[key], row["count"]) for row in rows.groupBy(key).count().collect()]
    fetch = lambda rows, key, keys: rows.where(F.col(key).isin(keys)).select("word", "n").collect() if keys else []
    whole, edge, room = _whole(sorted(sizes(classed, "class"), reverse=True), most)
    found = classed.where(F.col("class") >= min(whole)).select("word", "n").collect() if whole else []
    if edge is not None:
        some = classed.where(F.col("class") == edge)
        whole, edge, room = _whole(sorted(sizes(some, "n"), reverse=True), room)
        found += fetch(some, "n", whole)
        if edge is not None:
            some = some.where(F.col("n") == edge)
            whole, edge, room = _whole(sorted(sizes(some, "part")), room)
            if whole:
                found += some.where(F.col("part") <= max(whole)).select("word", "n").collect()
            if edge is not None:
                found += sorted(some.where(F.col("part") == edge).select("word", "n").collect())[:room]
    return [row["word"] for row in sorted(found, key=lambda row: (-row["n"], row["word"]))]
