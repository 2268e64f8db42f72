"""Target-distribution importance resampling: documents are drawn by how much likelier a target corpus makes
their hashed words and word pairs, through Gumbel noise and a distributed quickselect.

Each feature (a run of one or two words) falls into one of BUCKETS buckets by its crc32. Two passes read
the texts: the first sums counts by bucket, of which a task sends one array at most; the second turns
the array of gains, by bucket, into a weight for each document. Checksums are drawn in numpy, a byte of all
words at a time; a pair's goes on from its first word's.

The draw never sorts what isn't drawn. Scores make composite keys (score, id, text, row) that no two rows
share. Each round takes a few random pivot keys among the rows still in question and counts, in one
aggregate, the rows before, at and behind each of them; the k-th key is a pivot in the end, and
only rows up to it are dealt out by ranges, sorted and numbered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut_lineage, short_batches

BUCKETS = 10_000
#: Share of the documents with MIN_WORDS words or more that is drawn, in hundredths.
PERCENT = 25
MIN_WORDS = 20
SEED = 7
#: Pivot keys of a round.
PIVOTS = 24
#: Bytes of text that are cut into words at once.
GATHER = 1 << 20
#: Longer words are summed up one by one.
LONG = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_ONES = np.uint32(0xFFFFFFFF)
#: Bytes of words, once A-Z are lowered: 0-9, a-z and all of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _after_words(state: np.ndarray, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[m, words] checksum registers once each word's bytes follow, a byte of all words at a time."""
    out = np.empty_like(state)
    long = np.flatnonzero(sizes > LONG)
    for i in long.tolist():
        word = code[starts[i] : starts[i] + sizes[i]].tobytes()
        out[:, i] = [zlib.crc32(word, int(x)) ^ 0xFFFFFFFF for x in ~state[:, i]]
    order = np.argsort(np.where(sizes > LONG, 0, -sizes).astype(np.int16), kind="stable")
    order = order[: len(order) - len(long)]
    open_ = np.cumsum(np.bincount(sizes[order], minlength=LONG + 1)[::-1])[::-1]
    state, at = state[:, order], starts[order]
    for k in range(LONG):
        m = int(open_[k + 1])
        if not m:
            break
        now = state[:, :m]
        state[:, :m] = (now >> np.uint32(8)) ^ _CRC[(now ^ code[at[:m] + k]) & np.uint32(255)]
    out[:, order] = state
    return out


def features(texts: list[bytes | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, index of its text, words of each text): words first, then pairs."""
    code = np.frombuffer((b" " + b" ".join([text or b"" for text in texts]) + b" ").lower(), np.uint8)
    word = _WORD[code]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum([len(text or b"") + 1 for text in texts])
    counts = np.diff(np.searchsorted(starts, ends, side="right"), prepend=0)
    owner = np.repeat(np.arange(len(texts)), counts)
    alone = _after_words(np.full((1, len(starts)), _ONES), code, starts, sizes)[0]
    blank = (alone >> np.uint32(8)) ^ _CRC[(alone ^ np.uint32(0x20)) & np.uint32(255)]
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    pairs = _after_words(blank[None, second - 1], code, starts[second], sizes[second])[0]
    crc = ~np.concatenate((alone, pairs))
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate((owner, owner[second])), counts


def _gathered(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about GATHER bytes each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= GATHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds up its own and sends them once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for start, end in _gathered(texts):
                total += np.bincount(features(texts[start:end], buckets)[0], minlength=buckets)
        (used,) = np.nonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    texts = short_batches(docs).where("text is not null").select(F.col("text").cast("binary").alias("text"))
    out = np.zeros(buckets, np.int64)
    # a row for each bucket, whose number is a parameter
    for row in texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source."""
    s, t = source.astype(np.float64) + 1, target.astype(np.float64) + 1
    n = len(source)
    ratio = (t * (float(source.sum()) + n)) / (s * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, text_hash for each row of ``docs`` (doc_id, text). The
    noise of a null id is that of an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for batch in batches:
            texts, parts = batch["text"].tolist(), []
            for start, end in _gathered(texts):
                bucket, owner, words = features(texts[start:end], len(gain))
                n = np.bincount(owner, minlength=end - start)
                # whole numbers far below 2**53
                total = np.bincount(owner, gain[bucket], minlength=end - start).astype(np.int64)
                parts.append(np.stack((words, n, np.where(n > 0, total // np.maximum(n, 1), 0))))
            words, n, weight = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text_hash": batch["text_hash"].array, "n_words": words, "n_features": n, "weight": weight})

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = short_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(weigh, "doc_id string, text_hash long, n_words long, n_features long, weight long")
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(noise, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(u)))
    return rows.select(F.col("doc_id").cast(doc_id), "n_words", "n_features", "weight", score.cast("long").alias("score"), "text_hash")


def kth(keys: DataFrame, order: list[str], k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple | None:
    """The k-th smallest (from 1) of the composite keys in the columns ``order``, none of which is null
    and no two of which are alike; null if there are fewer than k. ``keys`` is read once for each
    round's pivots and once for its counts, and should be materialised.

    What is left lies between two pivots, so a round divides it by about their number."""
    key = F.struct(*order)
    literal = lambda values: F.struct(*[F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in zip(order, values, strict=True)])
    left, want, turn = keys, k, 0
    low = high = None
    while k > 0:
        turn += 1
        drawn = left.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), *order)).limit(pivots).select(*order).collect()
        points = sorted(tuple(row) for row in drawn)
        if not points:
            return None
        counts = left.agg(*[F.count_if(key < literal(p)).alias(f"n{i}") for i, p in enumerate(points)]).first()
        before = [counts[f"n{i}"] for i in range(len(points))]
        for i, point in enumerate(points):
            if want == before[i] + 1:
                return point
            if want <= before[i]:
                high = point
                break
            low, done = point, before[i] + 1
        else:
            i = len(points)
            if len(points) < pivots:
                return None
        if i:
            want -= done
        left = keys
        if low is not None:
            left = left.where(key > literal(low))
        if high is not None:
            left = left.where(key < literal(high))
    return None


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (long, from 1) by the columns ``order``: dealt out by ranges, sorted in
    parallel, and counted on from the sizes of the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    part = F.shiftright("_id", 33)
    sizes = {row["part"]: row["n"] for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    ahead, offsets = 0, []
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(ahead)
        ahead += sizes.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), (part + 1).cast("int"))
    return placed.withColumn(name, offset + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of ``docs`` (doc_id, text); rank
    numbers the drawn rows by falling score, ties by rising id, and is null for others.

    ``target``: text. Texts that are null or have no word have no features and weight 0. Drawn are
    floor(percent / 100) of the rows with ``min_words`` words or more. Rows that share score and id
    follow by their texts' hashes; equal rows are drawn one by one. A null id comes behind the
    others of its score. Without rows nothing is drawn; an empty target smooths to even shares.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = scored(docs, gain, seed).withColumn("_row", F.monotonically_increasing_id())
    no_id = docs.schema["doc_id"].dataType
    rows = rows.select("*", (-F.col("score")).alias("_k1"), F.col("doc_id").isNull().alias("_k2"), F.coalesce("doc_id", F.lit("0").cast(no_id)).alias("_k3"))
    rows = cut_lineage(rows)
    order = ["_k1", "_k2", "_k3", "text_hash", "_row"]
    able = rows.where(F.col("n_words") >= min_words)
    last = kth(able.select(*order), order, able.count() * percent // 100, seed=seed)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    edge = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)])
    drawn = (F.col("n_words") >= min_words) & (F.struct(*order) <= edge)
    winners = numbered(rows.where(drawn).select(*out, *order), order, "rank")
    return winners.select(*out, "rank").unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def _sql_features(table: str, doc: str) -> str:
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""(SELECT row, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
      FROM (SELECT row_number() OVER () AS row, {doc} AS doc_id, coalesce({words}, []) AS w FROM {table}))"""


#: crc32 byte by byte over the distinct features, with a table of what eight zero bits do to each byte.
ORACLE = f"""
WITH bytes AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(0, 8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS step FROM range(0, 256) t(b)),
own AS MATERIALIZED {_sql_features("documents", "doc_id")},
sought AS MATERIALIZED {_sql_features("benchmark", "item_id")},
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM own UNION SELECT f FROM sought)),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, step[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) % {BUCKETS} AS bucket FROM features, bytes),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM sought JOIN hashed USING (f) GROUP BY bucket),
gains AS MATERIALIZED (SELECT b AS bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM own) + {BUCKETS} AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM sought) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM range(0, {BUCKETS}) r(b) LEFT JOIN s ON b = s.bucket LEFT JOIN t ON b = t.bucket),
weights AS (SELECT row, count(*) AS n_features, sum(gain) AS total FROM own JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row),
docs AS (SELECT row_number() OVER () AS row, doc_id FROM documents),
scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n_features), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise
  FROM docs LEFT JOIN weights USING (row)),
ranks AS (SELECT *, weight + noise AS score, (n_features + 1) // 2 >= {MIN_WORDS} AS able FROM scores),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM ranks)
SELECT doc_id, (n_features + 1) // 2 AS n_words, n_features, weight, score, CASE WHEN able AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
