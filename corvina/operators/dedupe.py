"""Duplicates among entries: by content hash, and by character ratio among candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions import ratios
from corvina.functions import signatures as S
from corvina.functions import text as T
from corvina.operators.links import components, linked
from corvina.session import cut_lineage, spread


def exact(entries: DataFrame) -> DataFrame:
    """id, first_id, component: entries whose question or answer another entry with a smaller id has.

    One link to the first of each group of equals, not all its pairs; hashes are aggregated before
    the join, and empty parts match nothing.
    """
    parts = entries.select("id", F.explode(F.map_from_arrays(F.array(F.lit("question"), F.lit("answer")), F.array("question", "answer"))).alias("component", "text"))
    hashed = parts.where(T.squeeze(F.col("text")) != "").select("id", "component", T.content_hash(F.col("text")).alias("hash"))
    first = hashed.groupBy("component", "hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(first, ["component", "hash"]).where("id <> first_id").select("id", "first_id", "component")


#: Components of a band and bands, of questions' runs of characters and of answers' runs of words.
CHARACTERS, WORDS, ROWS, BANDS = 4, 2, 3, 48
#: Questions of at most so many characters also have bands of two components from pairs of characters.
SHORT, PAIR_ROWS = 24, 2
#: Such short questions are also signed by their letters: components of a band, bands, and the share of the signature
#: that must agree. Texts of a ratio of 0.70 share 0.54 of their letters at least, whatever their order.
LETTER_ROWS, LETTER_BANDS, LETTERS_AGREE = 4, 64, 0.42
#: Bins of letters that a text's characters are counted in.
BINS = 64
#: Share of a signature that must agree for a pair that is left over in a band to be compared.
AGREE = {"question": 0.25, "answer": 0.15}


def _sign_question(text: str) -> tuple[np.ndarray, np.ndarray]:
    long_, pairs = S.minhash(S.character_grams(text, CHARACTERS), ROWS * BANDS, 1), S.minhash(S.character_grams(text, 2), PAIR_ROWS * BANDS, 3)
    bands = S.bands_of(long_, ROWS, 0)
    return np.concatenate((bands, S.bands_of(pairs, PAIR_ROWS, 1))) if len(text) <= SHORT else bands, np.concatenate((long_, pairs))


def _sign_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    signature = S.minhash(S.word_grams(text, WORDS), ROWS * BANDS, 2)
    return S.bands_of(signature, ROWS, 0), signature


def _sign_letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    signature = S.minhash(S.letters(text), LETTER_ROWS * LETTER_BANDS, 4)
    return S.bands_of(signature, LETTER_ROWS, 2), signature


def _sign(part: str):
    own = {"question": _sign_question, "answer": _sign_answer, "letters": _sign_letters}[part]

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            signed = [own(text) for text in texts]
            yield pd.DataFrame([(bands, (marks & np.uint64(255)).astype(np.uint8).tobytes()) for bands, marks in signed], columns=["bands", "marks"])

    return F.pandas_udf(sign, "bands array<long>, marks binary")


def _compare(threshold: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for a, b, left, right in rows[["a", "b", "left", "right"]].itertuples(index=False):
                if (ratio := ratios.ratio_from(left, right, threshold)) is not None:
                    found.append((a, b, ratio))
            yield pd.DataFrame(found, columns=["a", "b", "ratio"]).astype({"a": "int64", "b": "int64", "ratio": "float64"})

    return compare


class _LettersReach:
    """Of pairs of short texts those whose common letters, and then whose common letters in order, allow the ratio."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def some(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        total = (left != 0).sum(axis=1)[:, None] + (right != 0).sum(axis=1)
        return 2.0 * ratios.common_letters(left, right) / total >= self.threshold

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        total = (left != 0).sum(axis=1) + (right != 0).sum(axis=1)
        return 2.0 * ratios.subsequences(left, right) / total >= self.threshold


class _CountsReach(_LettersReach):
    """Of pairs of any texts those whose lengths, and then whose numbers of letters, allow the ratio."""

    def some(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = left.sum(axis=1, dtype=np.int64)[:, None], right.sum(axis=1, dtype=np.int64)
        return 2.0 * np.minimum(left, right) / (left + right) >= self.threshold

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        total = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64)
        return 2.0 * np.minimum(left, right).sum(axis=1, dtype=np.int64) / total >= self.threshold


def _may_reach(threshold: float) -> _LettersReach:
    return _LettersReach(threshold)


def _codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda text: ratios.codes(text, SHORT))


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda text: ratios.letter_counts(text, BINS))


def _part_links(rows: DataFrame, part: str, threshold: float) -> DataFrame:
    """a, b, ratio, component: links between the entries that have a text of this part first, and of
    every other entry with the first that has the same text."""
    texts = rows.where(F.col(part) != "").select("id", F.col(part).alias("text"), F.md5(F.col(part).cast("binary")).alias("same"))
    nodes = cut_lineage(texts.groupBy("same").agg(F.min(F.struct("id", "text")).alias("r")).select("same", "r.*"))
    signed = cut_lineage(nodes.select("id", _sign(part)("text").alias("s"), F.pandas_udf(_counts, "binary")("text").alias("codes")).select("id", "s.*", "codes"))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = nodes.select(F.col("id").alias("a"), F.col("text").alias("left")), nodes.select(F.col("id").alias("b"), F.col("text").alias("right"))
        pairs = cut_lineage(pairs)
        return spread(pairs.join(left, "a").join(right, "b"), pairs.count()).mapInPandas(_compare(threshold), "a long, b long, ratio double")

    links = linked(signed.select("id", F.explode("bands").alias("band")).distinct(), signed.select("id", "marks", "codes"), verify, AGREE[part], _CountsReach(threshold))
    if part == "question":
        short = nodes.where(F.length("text") <= SHORT).select("id", _sign("letters")("text").alias("s"), F.pandas_udf(_codes, "binary")("text").alias("codes"))
        short = cut_lineage(short.select("id", "s.*", "codes"))
        more = linked(short.select("id", F.explode("bands").alias("band")).distinct(), short.select("id", "marks", "codes"), verify, LETTERS_AGREE, _may_reach(threshold))
        links = links.unionByName(more).distinct()
    copies = texts.select(F.col("id").alias("b"), "same").join(nodes.select("same", F.col("id").alias("a")), "same").where("a <> b").select("a", "b", F.lit(1.0).alias("ratio"))
    return links.unionByName(copies).withColumn("component", F.lit(part))


def similar(entries: DataFrame, threshold: float = 0.70) -> DataFrame:
    """id, class_id, other_id, ratio, component, kind: entries (id, question, answer) whose questions or
    answers are alike by character ratio, the larger of the two counting.

    ``class_id`` is the smallest id that links connect an entry with; ``other_id`` is the entry of the
    strongest link found, ties to the smaller id; entries without a link have no row. Texts are compared
    whole, in lower case with white space squeezed; equal ones are one node, and empty ones match
    nothing.

    A ratio of characters has no exact index: a pair is a candidate if it shares a MinHash band of the
    questions' character runs or of the answers' word pairs, and candidates are compared as ``links``
    describes. A pair that shares no band is missed (the README says how many).
    """
    form = lambda c: T.squeeze(F.lower(F.coalesce(F.col(c), F.lit(""))))
    rows = cut_lineage(entries.where("id is not null").select("id", form("question").alias("question"), form("answer").alias("answer")))
    links = cut_lineage(_part_links(rows, "question", threshold).unionByName(_part_links(rows, "answer", threshold)))
    roots = components(links.select("a", "b")).select("id", F.col("root").alias("class_id"))
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other_id"), "ratio", "component").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other_id"), "ratio", "component"))
    best = ends.groupBy("id").agg(F.max(F.struct("ratio", (-F.col("other_id")).alias("least"), "component")).alias("l"))
    out = best.join(roots, "id").select("id", "class_id", (-F.col("l.least")).alias("other_id"), "l.ratio", "l.component")
    kind = F.when(F.col("ratio") >= 0.95, "exact").when(F.col("ratio") >= 0.85, "near_exact").otherwise("similar")
    return out.withColumn("kind", kind)
