"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Byte offsets at which a token of A and one of B both end cut a text into groups; all A-B pairs of a
group are linked. The two lists of ends are merged in lockstep: a numpy state vector holds the A and B
pointers of all lanes of a batch, every step advances the pointer that lies behind (both, at a cut) in all
lanes at once, emits the groups that end there with their links, and drops lanes that are finished.
A lane is a document, or a part of LANE tokens of a longer one that begins at a common end, so that no
step serves a handful of lanes only.

How many documents link a pair of ids is counted over the whole corpus: tasks send each pair's count
once, and documents look up the frequent ones (HOT at most, so a bounded table) in their own task.
Only a document's rarer pairs meet their counts by a shuffled join, on keys none of which is frequent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import cut_lineage, short_batches

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: A tokens of a lane, about.
LANE = 256
#: Bytes of text whose lanes advance together.
GATHER = 1 << 22
#: Pairs of a group up to which its links are listed one by one; larger ones are summed up by id first.
LISTED = 4096
#: Pairs of ids that every task may look up in memory.
HOT = 1 << 16


def load_tokenizers(a_path: str = A_FILE, b_path: str = B_FILE) -> tuple[dict[bytes, int], bytes]:
    """Bytes and ids of A's entries, and B's model, to be shared with executors; read on the driver."""
    with open(a_path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # byte-level entries write a byte as one character: itself if it is printable, else one from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)).difference(plain)))}
    ids = model["vocab"]
    made = [ids["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    if made != sorted(made):
        raise ValueError("ids must rise in the order of the merges")
    with open(b_path, "rb") as file:
        return {bytes(byte_of[c] for c in token): i for token, i in ids.items()}, file.read()


class Pair:
    """Both tokenizers in a worker: ids and token lengths of texts."""

    def __init__(self, a_ids: dict[bytes, int], b_model: bytes):
        import sentencepiece
        import tiktoken

        # ids in the order of the merges are ranks (see load_tokenizers)
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=a_ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = [b""] * (max(a_ids.values()) + 1)
        for token, i in a_ids.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        decimal = lambda own, end: [b"%d%s" % (i, end) for i in range(len(own))]
        #: What writes an A token inside a group, its last one, a B token inside a group, and its last one.
        self.written = decimal(self.a_bytes, b",") + decimal(self.a_bytes, b"|") + decimal(self.b_bytes, b",") + decimal(self.b_bytes, b";")

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text; none where they don't give the text's bytes again. A covers every
        byte of any text, so only B's are looked at."""
        filled = [text or "" for text in texts]
        of_a = [self.a.encode_ordinary(" " + text) if text else [] for text in filled]
        of_b = self.b.encode(filled, num_threads=1) if filled else []
        for i, text in enumerate(filled):
            if not text or b"".join([self.b_bytes[x] for x in of_b[i]]) != (" " + text).encode():
                of_a[i], of_b[i] = [], []
        return of_a, of_b


def _lanes(a_end: np.ndarray, b_end: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and B tokens of lanes: documents' starts, and common ends near every LANE-th A token of a
    document, probed for in all of them at once. ``a_start``, ``b_start``: of documents with tokens."""
    sizes = np.diff(np.append(a_start, len(a_end)))
    more = np.maximum(0, sizes // LANE - 1)
    to = np.repeat(a_start + sizes, more)
    at = np.repeat(a_start, more) + LANE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    cuts_a, cuts_b = [a_start], [b_start]
    for _ in range(LANE):
        if not len(at):
            break
        where = np.searchsorted(b_end, a_end[at - 1])
        common = b_end[np.minimum(where, len(b_end) - 1)] == a_end[at - 1]
        cuts_a.append(at[common])
        cuts_b.append(where[common] + 1)
        at, to = at[~common] + 1, to[~common]
        inside = at < to
        at, to = at[inside], to[inside]
    first_a = np.concatenate(cuts_a)
    order = np.unique(first_a, return_index=True)[1]
    return first_a[order], np.concatenate(cuts_b)[order]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, linked A tokens, linked B tokens). The ends of all documents' tokens rise from one document
    to the next; both tokenizers end each document at the same place. ``a_start``, ``b_start``: first
    tokens of documents that have tokens. A group is a row (first A token, first B token, end of A, end of B);
    groups of more than LISTED pairs list no links."""
    lane_a, lane_b = _lanes(a_end, b_end, a_start, b_start)
    stop = np.append(lane_a[1:], len(a_end))
    i, j = lane_a.copy(), lane_b.copy()
    group_a, group_b = lane_a.copy(), lane_b.copy()
    empty = np.zeros(0, np.int64)
    groups: list[tuple] = [(empty,) * 4]
    links_a, links_b = [empty], [empty]
    while len(i):
        x, y = a_end[i], b_end[j]
        step_a, step_b = x <= y, y <= x
        i += step_a
        j += step_b
        cut = np.flatnonzero(step_a & step_b)
        if not len(cut):
            continue
        # the groups that end here, and their links
        first_a, first_b, end_a, end_b = group_a[cut], group_b[cut], i[cut], j[cut]
        groups.append((first_a, first_b, end_a, end_b))
        group_a[cut], group_b[cut] = end_a, end_b
        wide = end_b - first_b
        n = (end_a - first_a) * wide
        if (n > 1).any():
            some = n <= LISTED
            n, wide = n[some], wide[some]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, column = np.divmod(place, np.repeat(wide, n))
            first_a, first_b = np.repeat(first_a[some], n) + row, np.repeat(first_b[some], n) + column
        links_a.append(first_a)
        links_b.append(first_b)
        done = end_a == stop[cut]
        if done.any():
            live = np.ones(len(i), bool)
            live[cut[done]] = False
            i, j, group_a, group_b, stop = i[live], j[live], group_a[live], group_b[live], stop[live]
    out = np.stack([np.concatenate(column) for column in zip(*groups, strict=True)])
    return out[:, np.argsort(out[0])], np.concatenate(links_a), np.concatenate(links_b)


def _summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their weights, or how often each comes."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def align(texts: list[str | None], pair: Pair) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of each text: linked pairs of ids as
    A id * (B's vocabulary) + B id, ascending, packed (int64), and how often each is linked (int64)."""
    n_texts, width = len(texts), len(pair.b_bytes)
    of_a, of_b = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in own], np.int64) for own in (of_a, of_b))
    a, b = (np.array(list(chain.from_iterable(own)), np.int64) for own in (of_a, of_b))
    a_from, b_from = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    used = np.flatnonzero(n_a > 0)
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    groups, link_a, link_b = lockstep(a_end, b_end, a_from[used], b_from[used])
    # tokens in the order in which they are written: each group's A tokens, then its B tokens
    size_a, size_b = groups[2] - groups[0], groups[3] - groups[1]
    written = np.empty(len(a) + len(b), np.int64)
    last = np.zeros(len(a), bool)
    last[groups[2] - 1] = True
    written[np.arange(len(a)) + np.repeat(groups[1], size_a)] = a + last * len(pair.a_bytes)
    last = np.zeros(len(b), bool)
    last[groups[3] - 1] = True
    written[np.arange(len(b)) + np.repeat(groups[2], size_b)] = b + last * width + 2 * len(pair.a_bytes)
    # links: one by one, and those of large groups by distinct ids
    doc = np.repeat(np.arange(n_texts), n_a)
    keys, times = _summed((doc[link_a] << 40) + a[link_a] * width + b[link_b])
    for g in np.flatnonzero(size_a * size_b > LISTED).tolist():
        own_a, many_a = np.unique(a[groups[0, g] : groups[2, g]], return_counts=True)
        own_b, many_b = np.unique(b[groups[1, g] : groups[3, g]], return_counts=True)
        more = (doc[groups[0, g]] << 40) + own_a[:, None] * width + own_b
        keys, times = _summed(np.append(keys, more.ravel()), np.append(times, (many_a[:, None] * many_b).ravel()))
    group_doc = doc[groups[0]]
    n_groups, n_links = np.bincount(group_doc, minlength=n_texts), np.bincount(group_doc, size_a * size_b, minlength=n_texts).astype(np.int64)
    ends = np.searchsorted(keys, np.arange(1, n_texts + 1) << 40)
    keys = keys & ((1 << 40) - 1)
    codes, from_ = written.tolist(), (a_from + b_from).tolist()
    out, at = [], 0
    for k, end in enumerate(ends.tolist()):
        tokens = codes[from_[k] : from_[k] + int(n_a[k] + n_b[k])]
        text = b"".join([pair.written[x] for x in tokens])[:-1]
        out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(text).hexdigest() if tokens else "", keys[at:end].tobytes(), times[at:end].tobytes()))
        at = end
    return out


_PAIRS: dict = {}


def _pair(shared) -> Pair:
    """One per worker and two tokenizers."""
    paths, a_ids, b_model = shared.value
    if paths not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[paths] = Pair(a_ids, b_model)
    return _PAIRS[paths]


def aligned(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times (as in ``align``) for each row of
    ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(((a_path, b_path), *load_tokenizers(a_path, b_path)))
    longs = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("groups_sha256", T.StringType()), T.StructField("keys", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            start, size = 0, 0
            for end, text in enumerate(batch.column("_text"), 1):
                size += len(text.as_buffer() or b"")
                if size >= GATHER or end == batch.num_rows:
                    rows = align(batch.column("_text").slice(start, end - start).to_pylist(), pair)
                    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), *columns], names=schema.names)
                    start, size = end, 0

    return short_batches(docs).select("doc_id", F.col("text").alias("_text")).mapInArrow(work, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """key, a, n: how many rows hold each pair of ids linked. ``rows``: keys, as ``aligned`` gives them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch["keys"]), np.int64)
            held, n = _summed(held)
            known, sums = _summed(np.concatenate((known, held)), np.concatenate((sums, n)))
            if len(known) > 1 << 20:  # what one task adds up at a time
                yield pd.DataFrame({"key": known, "n": sums})
                known, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pd.DataFrame({"key": known, "n": sums})

    counts = rows.select("keys").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.select("key", F.floor(F.col("key") / width).alias("a"), "n")


def _frequent(counts: DataFrame, most: int) -> int:
    """A count from which on there are ``most`` pairs at most, by classes of counts (eighths of doublings)."""
    kind = F.floor(8 * F.log2(F.col("n").cast("double")))
    classes = counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("kind")).collect()
    total, least = 0, 1 << 62
    for row in classes:
        total += row["pairs"]
        if total > most:
            break
        least = row["n"]
    return least


def align_documents(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``
    (doc_id, text).

    A encodes the text behind a blank, B the text, to which it adds a blank itself; special tokens in
    texts are plain text. A text that is null, empty or doesn't come out of both tokens again has no
    tokens: zeros, and '' for the digest. A pair's count is the number of rows that hold it linked, so
    repeated rows count each; ``n_best`` are links whose count is the highest of their A id, ties too.
    """
    rows = cut_lineage(aligned(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()))
    width = _vocabulary(b_path)
    counts = cut_lineage(pair_counts(rows, width))
    # a row for each entry of A's vocabulary at most
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    counts = counts.join(best, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    least = _frequent(counts, hot)
    frequent = sorted(counts.where(F.col("n") >= least).collect())
    table = docs.sparkSession.sparkContext.broadcast(tuple(np.array([row[i] for row in frequent], np.int64) for i in range(3)))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, is_best = table.value
        for batch in batches:
            sums, bests, rest, rest_times = [], [], [], []
            for keys, times in zip(batch["keys"], batch["times"], strict=True):
                keys, times = np.frombuffer(keys, np.int64), np.frombuffer(times, np.int64)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                at, held = at[found], times[found]
                sums.append(int((n[at] * held).sum()))
                bests.append(int((is_best[at] * held).sum()))
                rest.append(keys[~found])
                rest_times.append(times[~found])
            yield pd.DataFrame({"_row": batch["_row"], "count_sum": sums, "n_best": bests, "keys": pd.Series(rest, dtype=object), "times": pd.Series(rest_times, dtype=object)})

    sums = cut_lineage(rows.where("n_links > 0").select("_row", "keys", "times").mapInPandas(look_up, "_row long, count_sum long, n_best long, keys array<long>, times array<long>"))
    rare = sums.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("link")).select("_row", F.col("link.keys").alias("key"), F.col("link.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least), "key")
    met = met.groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    total = sums.select("_row", "count_sum", "n_best").unionByName(met).groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.drop("keys", "times").join(total, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _vocabulary(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
