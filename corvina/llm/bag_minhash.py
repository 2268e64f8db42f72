"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and exact verification.

A document is the multiset of its five-word shingles. Each shingle has, for every dyadic weight
level its count reaches, an own Poisson process seeded by the shingle: points in order of time, each
with a place inside the level and a component of the signature. A component's value is the time of
the first point that falls to it under the count, so two documents agree in it with the probability
of their weighted Jaccard similarity. A document's processes stop once their times pass its largest
component, which keeps the work near (shingles + components x log components).

Rows with the same text are one node. Nodes that share a band are candidates. First every node is
compared with one leader of each of its bands (the smallest id, then the one with most links),
exactly, and linked nodes become classes. What is left are nodes that share a band but no class:
blocks of a band's nodes, of a fixed size at most, meet inside a task, which looks at a pair's
signatures, then at its hashed shingles, and passes on what reaches the similarity. So a band never
becomes all of its pairs, and no pair is dropped for its band's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut_lineage, short_batches, small_side
from corvina.operators.links import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Nodes of a band that meet each other at once; their pairs are compared
BLOCK = 512
#: by their shingles if so large a share of components agrees: five standard errors below the similarity.
AGREE = 0.64
#: Bytes of text whose signatures are drawn at once; a longer text is drawn alone.
CHUNK = 1 << 18
LEVELS = 40

_MULTIPLIER = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, 48-bit hash, count) of every distinct shingle, ordered by both. Words are
    runs of anything but ASCII blanks. A text of one to four words has one shingle, all its words."""
    if len(texts) > 1 << 16:
        raise ValueError("at most 65536 texts at once")
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    code = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(one) + 1 for one in raw], np.int64)
    space = _SPACE[code]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(code))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], dtype=np.uint64)))
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    text_of = np.searchsorted(np.cumsum(sizes), starts - 1, side="right")
    n_words = np.bincount(text_of, minlength=len(texts))
    hashed = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        shifted = np.zeros(len(words), np.uint64)
        shifted[: max(0, len(words) - k)] = words[k:]
        inside = np.zeros(len(words), bool)
        inside[: max(0, len(words) - k)] = text_of[k:] == text_of[: max(0, len(words) - k)]
        hashed = hashed * np.uint64(_MULTIPLIER) + np.where(inside, shifted, np.uint64(0))
        full = inside
    first = np.zeros(len(words), bool)
    first[np.cumsum(n_words)[n_words > 0] - n_words[n_words > 0]] = True
    used = full | (first & (n_words[text_of] < SHINGLE))
    key = np.sort((text_of[used].astype(np.uint64) << np.uint64(48)) | (_mix(hashed[used]) >> np.uint64(16)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    return (key[at] >> np.uint64(48)).astype(np.int64), key[at] & np.uint64((1 << 48) - 1), count


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """[n, size] times, from multisets as ``shingles`` gives them; infinite for an empty one."""
    top = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + (counts & (counts - 1) > 0) + 1
    # levels: (0, 1], (1, 2], (2, 4], (4, 8] ...; an element has those that begin under its count
    item = np.repeat(np.arange(len(counts)), top)
    level = np.arange(len(item)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1.0))
    width = np.where(level == 0, 1.0, low)
    text, weight = owner[item], counts[item].astype(np.float64)
    state = _mix(hashes[item] * np.uint64(LEVELS) + level.astype(np.uint64) + np.uint64(1))
    out = np.full(n * size, np.inf)
    time = np.zeros(len(item))
    while len(item):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        random = _mix(state)
        time = time - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        other = _mix(random ^ np.uint64(0xA0761D6478BD642F))
        place = low + width * ((other >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32
        hit = place <= weight
        component = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, (text * size + component)[hit], time[hit])
        open_ = time < out.reshape(n, size).max(axis=1)[text]
        item, state, time, text, weight, low, width = (x[open_] for x in (item, state, time, text, weight, low, width))
    return out.reshape(n, size)


def signature_rows(texts: list[str | None]) -> list[tuple[list[int] | None, bytes | None]]:
    """(hash of each band, marks) of each text: a byte of each component, then the bands' hashes. (None,
    None) without words."""
    out: list = [(None, None)] * len(texts)
    batch: list[int] = []
    length = 0
    for i in [*range(len(texts)), -1]:
        if batch and (i < 0 or length + len(texts[i] or "") > CHUNK or len(batch) == 1 << 12):
            times = signatures(*shingles([texts[k] for k in batch]), len(batch))
            bits = _mix(times.view(np.uint64))
            bands = np.zeros((len(batch), BANDS), np.uint64)
            for r in range(ROWS):
                bands = _mix(bands * np.uint64(_MULTIPLIER) + bits[:, r::ROWS])
            bands = bands ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for row, k in enumerate(batch):
                if np.isfinite(times[row, 0]):
                    out[k] = (bands[row].view(np.int64).tolist(), (bits[row] & np.uint64(255)).astype(np.uint8).tobytes() + bands[row].astype(">u8").tobytes())
            batch, length = [], 0
        if i >= 0 and texts[i]:
            batch.append(i)
            length += len(texts[i])
    return out


def _sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        # the marks' bands are put behind the bytes again where they are needed
        yield pd.DataFrame([(bands, marks and marks[:SIZE]) for bands, marks in signature_rows(list(texts))], columns=["bands", "bytes"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted hashes, counts)."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total > both else 0.0


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: tuple = (None, None)  # the left text of the row before: rows come sorted by it
    for rows in batches:
        found = []
        for a, b, left, right in zip(rows["a"], rows["b"], rows["left"], rows["right"], strict=True):
            if known[0] != left:
                known = (left, shingles([left])[1:])
            if (share := similarity(known[1], shingles([right])[1:])) >= SIMILARITY:
                found.append((a, b, share))
        yield pd.DataFrame(found, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, similarity of those ``pairs`` (a, b) whose texts reach SIMILARITY. Only the texts that
    pairs name are moved; they are spread by the smaller-grouped side, b."""
    pairs = cut_lineage(pairs)
    ids = small_side(cut_lineage(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()))
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return rows.sortWithinPartitions("a").mapInPandas(_verify, "a long, b long, similarity double")


def cells_of(text: str) -> bytes:
    """The multiset as a sorted set of 32-bit hashes: of each shingle and its number among equals."""
    _, hashes, counts = shingles([text])
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique((_mix(np.repeat(hashes, counts) * np.uint64(_MULTIPLIER) + number.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)).tobytes()


def _cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([cells_of(text) for text in texts], dtype=object)


def _close(rows: dict[str, np.ndarray], start: int, end: int) -> list[tuple[int, int]]:
    """Of the rows from start to end, a block of one band: pairs of a query and a node of another
    class that look similar enough. A pair counts in the first band that it shares, by the bands' whole
    hashes: the bytes of components that differ may agree by chance."""
    query = start + np.flatnonzero(rows["is_query"][start:end])
    node = start + np.flatnonzero(rows["is_node"][start:end])
    found: list[tuple[int, int]] = []
    if not len(query) or not len(node):
        return found
    band = rows["k"][start]
    marks = np.frombuffer(b"".join(rows["bytes"][node]), np.uint8).reshape(len(node), SIZE + 8 * BANDS)
    right, bands = np.ascontiguousarray(marks[:, :SIZE]), np.ascontiguousarray(marks[:, SIZE:]).view(np.uint64)
    ids, roots = rows["id"][node], rows["root"][node]
    cells = [np.frombuffer(one, np.uint32) for one in rows["cells"][node]]
    sizes = np.array([len(one) for one in cells])
    for i in query.tolist():
        mine = np.frombuffer(rows["cells"][i], np.uint32)
        same = right == np.frombuffer(rows["bytes"][i], np.uint8, SIZE)
        alike = np.minimum(sizes, len(mine)) >= SIMILARITY * np.maximum(sizes, len(mine))
        some = np.flatnonzero((same.mean(axis=1) >= AGREE) & (roots != rows["root"][i]) & alike)
        shared = bands[some, : band + 1] == np.frombuffer(rows["bytes"][i], np.uint64, band + 1, SIZE)
        some = some[shared[:, band] & ~shared[:, :band].any(axis=1)]
        if len(some):
            flat = np.concatenate([cells[j] for j in some])
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            # hashes of 32 bits may meet by chance, seldom more than once in a pair
            close = some[both + 1 >= SIMILARITY * (sizes[some] + len(mine)) / (1 + SIMILARITY)]
            found += [(min(rows["id"][i], j), max(rows["id"][i], j)) for j in ids[close].tolist()]
    return found


def _close_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks come sorted, one after another; one that a batch cuts waits for the next batch."""
    key = ["band", "block", "query_block"]
    waiting: list[pd.DataFrame] = []
    for batch in _and_none(batches):
        if batch is not None:
            waiting.append(batch)
            ends = batch[key].to_numpy()
            if len(batch) and (ends == ends[0]).all() and (len(waiting) == 1 or (waiting[0][key].iloc[-1].to_numpy() == ends[0]).all()):
                continue
        if not waiting:
            continue
        frame = pd.concat(waiting, ignore_index=True)
        keys = frame[key].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist()] + ([len(frame)] if batch is None else [])
        rows = {c: frame[c].to_numpy() for c in frame.columns}
        found = [pair for start, end in zip(bounds, bounds[1:], strict=False) for pair in _close(rows, start, end)]
        waiting = [] if batch is None else [frame.iloc[bounds[-1] :]]
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _leftover(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that share a band but no class and aren't known to be far apart. In a band
    of two the one pair has been compared already."""
    known = members.select("band", "k", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = known.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root"))["root"].alias("most")).where("roots > 1 and n > 2").drop("roots")
    rest = cut_lineage(known.join(mixed, "band"))
    ids = small_side(cut_lineage(rest.select("id").distinct()))
    cells = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").where("text is not null")
    cells = cells.select("id", F.pandas_udf(_cut, "binary")(F.col("text")).alias("cells"))
    hashes = F.unhex(F.array_join(F.transform("bands", lambda band: F.lpad(F.hex(band), 16, "0")), ""))
    rest = rest.join(cut_lineage(nodes.select("id", F.concat("bytes", hashes).alias("bytes")).join(cells, "id")), "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    minor = F.col("root") != F.col("most")
    place = lambda block, query_block, is_query, is_node: F.struct(block.alias("block"), query_block.alias("query_block"), is_query.alias("is_query"), is_node.alias("is_node"))
    yes, no = F.lit(True), F.lit(False)
    as_node = F.transform(every, lambda b: place(own, b, no, yes))
    as_query = F.when(minor, F.transform(every, lambda b: place(b, own, yes, no))).otherwise(F.array().cast("array<struct<block:int,query_block:int,is_query:boolean,is_node:boolean>>"))
    places = F.when(blocks == 1, F.array(place(own, own, minor, yes))).otherwise(F.concat(as_node, as_query))
    met = rest.select("band", "k", "id", "root", "bytes", "cells", F.explode(places).alias("p")).select("band", "p.*", "k", "id", "root", "bytes", "cells")
    met = met.repartition("band", "block", "query_block").sortWithinPartitions("band", "block", "query_block")
    return met.mapInPandas(_close_pairs, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for each row of ``docs`` (doc_id, text): class_id is the smallest id among
    the documents that links of SIMILARITY or more connect, its own for a document without any.

    Equal texts are linked, also empty ones. A null text is like no other; a null id gets no class.
    Rows that share an id are one document with several texts, which link what is like either of them.
    """
    signed = short_batches(docs).where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), F.pandas_udf(_sign, "bands array<long>, bytes binary")(F.col("text")).alias("s"))
    signed = cut_lineage(signed.select("doc_id", "same", "s.bands", "s.bytes"))
    firsts = signed.groupBy("same").agg(F.min("doc_id").alias("id"))
    nodes = signed.groupBy("same").agg(F.min(F.struct("doc_id", "bands", "bytes")).alias("r")).select(F.col("r.doc_id").alias("id"), "r.bands", "r.bytes")
    nodes = cut_lineage(nodes.where("bands is not null"))
    banded = nodes.select("id", F.posexplode("bands").alias("k", "band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut_lineage(banded.join(shared, "band"))
    links = cut_lineage(verified(members.where("leader < id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), docs))
    roots = cut_lineage(components(links))
    known = members.select("band", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = known.join(degrees, "id", "left")
    other = known.groupBy("band").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("id").alias("a"), F.col("root").alias("root_a"))).alias("l")).select("band", "l.a", "l.root_a")
    again = known.join(other, "band").where("root <> root_a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    links = cut_lineage(links.unionByName(verified(again, docs)))
    roots = cut_lineage(components(links))
    links = links.unionByName(cut_lineage(verified(_leftover(members, roots, nodes, docs), docs)))
    # an id with several texts is one document: their nodes belong together
    own = signed.join(firsts, "same").select("doc_id", "id")
    several = cut_lineage(own.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id", "low"))
    if not several.isEmpty():
        links = links.select("a", "b").unionByName(own.join(several, "doc_id").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    roots = cut_lineage(components(links))
    classes = firsts.join(roots, "id", "left").select("same", F.coalesce("root", "id").alias("class_id"))
    own = signed.select("doc_id", "same").join(classes, "same").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(own, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
