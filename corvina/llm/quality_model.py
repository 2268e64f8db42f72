"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs, doubled words and character n-grams
(a bag, with a constant feature for empty texts), under a softmax over the labels, trained by stochastic gradient
descent in numpy. Training uses a bounded sample of labelled rows (SAMPLE, a parameter), balanced by
label through the learning rates. Since the output layer is linear in the mean, a trained model is
one number per bucket, the difference of the two logits, so scoring is a table look-up at every byte
of every whole text inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bucket_of, cut_lineage, in_sample

BUCKETS = 1 << 17
DIM = 12
EPOCHS = 8
#: Learning rates of the output layer and of the vectors.
RATE, VECTOR_RATE = 0.6, 20.0
#: Labelled rows that training may use, about: those whose ids' hashes are small enough.
SAMPLE = 3000
#: Lengths in bytes of the character n-grams.
GRAMS = (2, 3, 4)
HELD_OUT = (4, 2)
THRESHOLD = 0.7
SEED = 17

_MIX = np.uint32(0x9E3779B1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _spread(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def features(text: str | None) -> list[np.ndarray]:
    """Bucket arrays of a text: the constant, words, word pairs, doubled words, and n-grams that may touch
    a blank on each side."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
    out = [np.zeros(1, np.uint32)]
    space = _SPACE[raw]
    if space.all():
        return out
    code = np.where(space, np.uint8(32), raw).astype(np.uint32)
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    # a word's hash: its bytes times powers of an odd number, counted from its start
    at = np.arange(len(code), dtype=np.int64)
    place = np.zeros(len(code), np.int64)
    place[starts] = starts
    place = at - np.maximum.accumulate(place)
    powers = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)
    sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(np.where(space, np.uint32(0), code * powers[place & 63]), dtype=np.uint32)))
    words = sums[ends] - sums[starts]
    out.append(_spread(words + np.uint32(7)))
    pairs = words[:-1] * np.uint32(31) + words[1:]
    out.append(_spread(pairs * np.uint32(0x85EBCA6B) + np.uint32(11)))
    # a word said again tells more than which one it is: such pairs have one feature more, the same for all
    out.append(np.full(int((words[1:] == words[:-1]).sum()), 1, np.uint32))
    h = code
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in GRAMS:
            out.append(_spread(h + np.uint32(n << 20)))
    return out


def gradient(vectors: np.ndarray, output: np.ndarray, weight: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of the used vectors, gradient of the output layer) of one document: the negative
    logarithm of its label's softmax odds. ``vectors``: of its features; ``weight``: each one's share of them."""
    mean = weight @ vectors
    logits = output @ mean
    odds = np.exp(logits - logits.max())
    odds /= odds.sum()
    error = odds.copy()
    error[label] -= 1
    return -float(np.log(max(odds[label], 1e-30))), np.outer(weight, error @ output), np.outer(error, mean)


def train(rows: list[tuple[str | None, int]], seed: int = SEED) -> np.ndarray:
    """The logit difference (label 1 less label 0) per bucket, float32. Without both labels among the
    rows: all zeros, or a constant for the label there is. ``rows``: (text, label 0 or 1). The vectors and the
    output layer have rates of their own, as a vector's gradient holds its small share of the document."""
    random = np.random.default_rng(seed)
    vectors = (random.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM
    output = np.zeros((2, DIM), np.float32)
    share = np.bincount([label for _, label in rows], minlength=2)[:2] / max(1, len(rows))
    if not share.all():
        return np.full(BUCKETS, 4.0 * (share[1] - share[0]), np.float32)
    docs = []
    for text, label in rows:
        used, count = np.unique(np.concatenate(features(text)), return_counts=True)
        docs.append((used, (count / count.sum()).astype(np.float32), label))
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(docs)):
            used, weight, label = docs[i]
            rate = (1 - done / steps) * min(4.0, 0.5 / share[label])
            done += 1
            _, of_vectors, of_output = gradient(vectors[used], output, weight, label)
            output -= np.float32(rate * RATE) * of_output
            vectors[used] -= np.float32(rate * VECTOR_RATE) * of_vectors
    return vectors @ (output[1] - output[0])


def score(text: str | None, table: np.ndarray) -> float:
    """Probability of label 1."""
    total, count = 0.0, 0
    for buckets in features(text):
        total += float(table[buckets].sum(dtype=np.float64))
        count += len(buckets)
    return float(1 / (1 + np.exp(-np.clip(total / count, -60, 60))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, label: str = "quality") -> list[tuple[str | None, int]]:
    """About ``rows`` (text, label) of documents that aren't held out, all if there are fewer: labelled ids
    with small hashes, which are few enough to be broadcast to the scan that fetches their texts. Ids
    that are null or have contradicting labels, and labels that aren't 0 or 1, teach nothing."""
    modulus, rest = HELD_OUT
    known = labels.where(F.col(label).isin(0, 1) & (bucket_of(F.col("doc_id"), modulus) != rest))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    known = cut_lineage(known)
    picked = known.where(in_sample(F.col("doc_id"), rows, known.count())).select("doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(row["text"], row["label"]) for row in sorted(found, key=lambda row: row["doc_id"])]


def quality_scores(text: Column, table: np.ndarray, docs: DataFrame) -> Column:
    """Probability of label 1 for every whole text; a null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score(one, shared.value) for one in texts], dtype="float64")

    return F.pandas_udf(scores, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text). A null id is never
    held out. With no labelled rows at all every score is 0.5."""
    modulus, rest = HELD_OUT
    table = train(labelled_sample(docs, labels, rows))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), modulus) == rest, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_scores(F.col("text"), table, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
