"""Language identification with a linear-chain conditional random field over words.

Every word's emission sums learned weights of its hashed prefix, suffix, character n-grams and of
the word itself (the lexicon); learned transitions join the labels of neighbouring words.
Forward-backward gives each word's label odds within its whole text, code-switched or not, and a
text's language is the one with the largest expected share of its words.

A chain is as long as its text. To run many chains at once in numpy, a text is cut into blocks of
BLOCK words: each block's transfer matrix is built, messages pass from block to block through those
matrices, and then all blocks fill in their own words. The cut changes nothing in the result.

Training uses a bounded sample (DOCS_PER_LANGUAGE rows per language, fewer where the languages are so
many that SAMPLE rows don't hold that many of each, and SEQUENCES chains or more built from them,
parameters), in which segments of different languages follow each other. Every language of the
training rows is learned. Languages are a closed set, not documents: what grows with their number is
one weight for each feature bucket (of which there are fewer beyond WEIGHTS weights) and the cost of a
word, which is their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import bucket_of, short_batches

BUCKETS = 1 << 16
#: Weights from which on further languages share fewer buckets.
WEIGHTS = 1 << 24
BLOCK = 32
#: Languages up to which chains are cut into blocks; a transfer matrix has their square.
CUT = 32
#: Steps between two rescalings of messages, and the least a word's potential is of its largest.
RESCALE = 4
FLOOR = 1e-30
#: Bytes of text labelled at once; a longer text is labelled alone.
CHUNK = 1 << 18
#: Sampled rows of a language, and of all of them together (one of each at least).
DOCS_PER_LANGUAGE, SAMPLE = 150, 12_000
#: Chains to train on, and the least for each language.
SEQUENCES, SEQUENCES_PER_LANGUAGE = 1200, 20
LENGTH = 64
SWITCH = 0.3
EPOCHS = 4
BATCH = 60
RATE = 0.3
HELD_OUT = (3, 1)
UNKNOWN = "und"
SEED = 23

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, np.int64)
_LETTER[ord("a") : ord("z") + 1] = 1
_LETTER[128:] = 1
_ODD = np.uint32(0x01000193)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    """The upper bits of a mixed hash. Bucket 0 is that of no feature and weighs nothing."""
    return (((h + np.uint32(salt)) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.intp)


class Words:
    """The words of a buffer that starts and ends with a blank, and the buckets of their features."""

    def __init__(self, raw: np.ndarray):
        space = _SPACE[raw]
        code = np.where(space, np.uint8(32), raw).astype(np.uint32)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, ends = edge[::2], edge[1::2]
        self.lettered = np.add.reduceat(_LETTER[raw], self.starts) > 0 if len(self.starts) else np.zeros(0, bool)
        # n-grams by the byte they start at, from the blank before a word; none has a blank inside
        three = (code[:-2] * _ODD + code[1:-1]) * _ODD + code[2:]
        four = three[:-1] * _ODD + code[3:]
        grams = [_bucket(three, 4), _bucket(four, 5)]
        inside = space[1:-1]
        crossing = inside[:-1] | inside[1:]
        grams[0][inside], grams[1][crossing], four[crossing] = 0, 0, 0
        self.grams = [np.concatenate((g, np.zeros(len(code) - len(g), np.intp))) for g in grams]
        at = lambda i, ok: np.where(ok, code[np.clip(i, 0, len(code) - 1)], np.uint32(0))
        size, s, e = ends - self.starts, self.starts, ends
        prefix = (at(s, size > 0) * _ODD + at(s + 1, size > 1)) * _ODD + at(s + 2, size > 2)
        suffix = (at(e - 1, size > 0) * _ODD + at(e - 2, size > 1)) * _ODD + at(e - 3, size > 2)
        whole = np.add.reduceat(np.append(four, np.zeros(3, np.uint32)), s - 1, dtype=np.uint32) if len(s) else np.zeros(0, np.uint32)
        self.of_word = [_bucket(whole + prefix * np.uint32(31), 1), _bucket(prefix, 2), _bucket(suffix, 3)]

    def __len__(self) -> int:
        return len(self.starts)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """[words, languages]"""
        if not len(self):
            return np.zeros((0, weights.shape[1]))
        total = np.empty((weights.shape[1], len(self)))
        grams, of_word = self._within(self.grams, len(weights)), self._within(self.of_word, len(weights))
        for language, own in enumerate(np.ascontiguousarray(weights.T)):
            by_byte = own.take(grams[0])
            by_byte += own.take(grams[1])
            total[language] = np.add.reduceat(by_byte, self.starts - 1)
            for buckets in of_word:
                total[language] += own.take(buckets)
        return total.T

    @staticmethod
    def _within(buckets: list[np.ndarray], size: int) -> list[np.ndarray]:
        return buckets if size >= BUCKETS else [b & (size - 1) for b in buckets]

    def add(self, weights: np.ndarray, by_word: np.ndarray) -> None:
        """Adds ``by_word`` [words, languages] to each of the word's features."""
        for buckets in self._within(self.of_word, len(weights)):
            np.add.at(weights, buckets, by_word)
        owner = np.zeros(len(self.grams[0]), np.int64)
        owner[self.starts[1:] - 1] = 1
        owner = np.cumsum(owner)
        for buckets in self._within(self.grams, len(weights)):
            (used,) = np.nonzero(buckets)
            np.add.at(weights, buckets[used], by_word[owner[used]])
        weights[0] = 0


def buffer_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(blank-framed lower-case bytes of all texts, number of words of each)."""
    raw = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    return np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8), np.array([len(one.split()) for one in raw], np.int64)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """[words, languages]: each word's label odds, for chains of the given numbers of words that lie
    one after another in ``emissions`` (log scale, as are ``transitions``)."""
    n, size = emissions.shape
    psi = np.maximum(np.exp(emissions - emissions.max(axis=1, keepdims=True)), FLOOR)
    step = np.exp(transitions)
    blocks = -(-lengths // block)
    first_word = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    total = int(blocks.sum())
    chain = np.repeat(np.arange(len(lengths)), blocks)
    start = first_word[chain] + (np.arange(total) - first_block[chain]) * block
    held = np.minimum(block, first_word[chain] + lengths[chain] - start)
    by_size = np.argsort(-held, kind="stable")  # so the blocks with a word at step t come first
    live = [int(k) for k in (held[None, :] > np.arange(block)[:, None]).sum(axis=1)]
    begin = start[by_size]
    local = [psi[begin[:k] + t] for t, k in enumerate(live)]
    state, back = np.full((total, size), 1.0 / size), np.ones((total, size))
    slot = np.empty(total, np.int64)
    slot[by_size] = np.arange(total)
    order = np.argsort(-blocks, kind="stable")
    forward, backward = np.full((len(lengths), size), 1.0 / size), np.ones((len(lengths), size))
    across_blocks = int(blocks.max(initial=0))
    if across_blocks > 1:
        transfer = np.broadcast_to(np.eye(size), (total, size, size)).copy()
        for t, k in enumerate(live):
            moved = (transfer[:k].reshape(-1, size) @ step).reshape(k, size, size)
            np.multiply(moved, local[t][:, None, :], out=transfer[:k])
            if t % RESCALE == RESCALE - 1:
                transfer[:k] /= transfer[:k].max(axis=(1, 2), keepdims=True)
        transfer /= transfer.max(axis=(1, 2), keepdims=True)
    for j in range(across_blocks if across_blocks > 1 else 0):
        now = order[: int((blocks > j).sum())]
        at = slot[first_block[now] + j]
        state[at] = forward[now]
        forward[now] = _normal(np.einsum("ni,nij->nj", forward[now], transfer[at]))
        at = slot[first_block[now] + blocks[now] - 1 - j]
        back[at] = backward[now]
        backward[now] = _normal(np.einsum("nij,nj->ni", transfer[at], backward[now]))
    alphas = []
    for t, k in enumerate(live):
        np.multiply(state[:k] @ step, local[t], out=state[:k])
        if t % RESCALE == RESCALE - 1:
            state[:k] = _normal(state[:k])
        alphas.append(state[:k].copy())
    found, across = np.empty((n, size)), np.ascontiguousarray(step.T)
    for t in range(block - 1, -1, -1):
        k = live[t]
        found[begin[:k] + t] = alphas[t] * back[:k]
        back[:k] = (back[:k] * local[t]) @ across
        if t % RESCALE == 0:
            back[:k] = _normal(back[:k])
    return _normal(found)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def shares(self, texts: list[str]) -> np.ndarray:
        """[texts, languages]: expected shares of each text's lettered words; zeros without any."""
        raw, lengths = buffer_of(texts)
        words = Words(raw)
        block = BLOCK if len(self.languages) <= CUT else max(BLOCK, int(lengths.max(initial=0)))
        odds = marginals(words.emissions(self.weights), self.transitions, lengths, block) * words.lettered[:, None]
        sums = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(odds, axis=0)))
        ends = np.cumsum(lengths)
        totals = sums[ends] - sums[ends - lengths]
        return totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share) for each whole text; ties go to the language that sorts first. A text
        that is null or has no letter: ('und', 0.0)."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, text in enumerate(texts) if text and any(map(str.isalpha, text))] if self.languages else []
        batch: list[int] = []
        size, chunk = 0, CHUNK if len(self.languages) <= CUT else CHUNK * CUT // len(self.languages)
        for i in [*known, -1]:
            if batch and (i < 0 or size + len(texts[i]) > chunk):
                for k, share in zip(batch, self.shares([texts[j] for j in batch]), strict=True):
                    out[k] = (self.languages[int(share.argmax())], float(min(1.0, share.max())))
                batch, size = [], 0
            if i >= 0:
                batch.append(i)
                size += len(texts[i])
        return out


def train(rows: list[tuple[str, str]], seed: int = SEED, sequences: int = SEQUENCES) -> Model:
    """A model from (text, language) rows, by AdaGrad on the chains' log-likelihood."""
    random = np.random.default_rng(seed)
    by_language: dict[str, list[list[bytes]]] = {}
    for text, language in rows:
        if words := (text or "").lower().encode("utf-8", "surrogatepass").split():
            by_language.setdefault(language, []).append(words)
    languages = sorted(by_language)
    size = len(languages)
    buckets = BUCKETS
    while buckets * size > WEIGHTS and buckets > 1 << 10:
        buckets >>= 1
    weights, transitions = np.zeros((buckets, max(size, 1)), np.float32), np.zeros((size, size))
    if size < 2:
        return Model(languages, weights[:, :size], transitions)
    chains = []
    for _ in range(max(sequences, SEQUENCES_PER_LANGUAGE * size)):
        words: list[bytes] = []
        labels: list[int] = []
        label = int(random.integers(size))
        while len(words) < LENGTH:
            docs = by_language[languages[label]]
            doc = docs[int(random.integers(len(docs)))]
            n, at = int(random.integers(6, 25)), int(random.integers(len(doc)))
            words += doc[at : at + n]
            labels += [label] * len(doc[at : at + n])
            if random.random() < SWITCH:
                label = int(random.integers(size))
        chains.append((words[:LENGTH], labels[:LENGTH]))
    seen, seen_t = np.full(weights.shape, 1e-3, np.float32), np.full((size, size), 1e-3)
    for _ in range(EPOCHS):
        order = random.permutation(len(chains))
        for i in range(0, len(order), BATCH):
            part = [chains[k] for k in order[i : i + BATCH]]
            words = Words(np.frombuffer(b" " + b" ".join(b" ".join(w) for w, _ in part) + b" ", np.uint8))
            truth = np.array([y for _, y in part])
            odds, pairs = _chain_odds(words.emissions(weights).reshape(len(part), LENGTH, size), transitions)
            odds[np.arange(len(part))[:, None], np.arange(LENGTH)[None, :], truth] -= 1
            np.add.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), -1)
            slope = np.zeros_like(weights)
            words.add(slope, (odds.reshape(-1, size) / len(part)).astype(np.float32))
            pairs /= len(part)
            seen += slope * slope
            seen_t += pairs * pairs
            weights -= RATE * slope / np.sqrt(seen)
            transitions -= RATE * pairs / np.sqrt(seen_t)
    return Model(languages, weights, transitions)


def _chain_odds(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label odds [chains, words, languages] and expected label pairs, for chains of one length."""
    n, length, size = emissions.shape
    psi, step = np.maximum(np.exp(emissions - emissions.max(axis=2, keepdims=True)), FLOOR), np.exp(transitions)
    alphas, state = np.empty((length, n, size)), np.full((n, size), 1.0 / size)
    for t in range(length):
        state = alphas[t] = _normal((state @ step) * psi[:, t])
    odds, pairs, back = np.empty((n, length, size)), np.zeros((size, size)), np.ones((n, size))
    for t in range(length - 1, -1, -1):
        odds[:, t] = _normal(alphas[t] * back)
        if t:
            right = psi[:, t] * back
            whole = (alphas[t - 1] * (right @ step.T)).sum(axis=1, keepdims=True)
            pairs += step * ((alphas[t - 1] / whole).T @ right)
        back = _normal((back * psi[:, t]) @ step.T)
    return odds, pairs


def language_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, rows: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, language) of at most ``per_language`` rows of each language, those with the smallest
    hashes of their ids, held-out rows and null ids apart. With so many languages that ``rows`` doesn't
    hold that many of each, of all of them equally fewer, and one at least. Ids are picked first, so
    that only the sample's texts are fetched."""
    modulus, rest = HELD_OUT
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), modulus) != rest)).select("doc_id", "lang")
    languages = known.agg(F.count_distinct("lang").alias("n")).first()["n"]
    most = max(1, min(per_language, rows // max(languages, 1)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # ranks are cut at a constant, so that no task sorts a language
    picked = known.withColumn("place", place).where(F.col("place") <= most).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(picked.distinct()), ["doc_id", "lang"])
    found = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return [(row["text"], row["lang"]) for row in sorted(found, key=lambda row: (row["lang"], row["doc_id"]))]


RESULT = "lang_pred string, score double"


def language_of(text: Column, model: Model, docs: DataFrame) -> Column:
    """A struct lang_pred, score for every whole text."""
    shared = short_batches(docs).sparkSession.sparkContext.broadcast((model.languages, model.weights, model.transitions))

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame(own.predict(list(texts)), columns=["lang_pred", "score"])

    return F.pandas_udf(label, RESULT)(text)


def identify(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang). A null id is
    never held out. With no labelled row at all every text is 'und'."""
    modulus, rest = HELD_OUT
    model = train(language_sample(docs, per_language))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), modulus) == rest, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), language_of(F.col("text"), model, docs).alias("r"))
    return found.select("doc_id", "held_out", "r.*")
