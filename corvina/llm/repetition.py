"""Quality rules on repetition inside a document, from its suffix array over words.

The suffix array comes from prefix doubling in numpy; the ranks kept at each doubling give the
longest common prefixes of neighbouring suffixes. An interval of that array with a common prefix of
l words is a substring of l words found at each of its suffixes; the deepest interval that a suffix
lies in gives the longest repeat that starts there, so the union over suffixes of those spans is the
union over all maximal repeated substrings. Cost is n log n in a document's words, memory linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_WINDOW_SHARE = 0.30
#: Repeated substrings of at least so many words count,
REPEAT_WORDS = 5
#: and may cover this share of the words,
MAX_COVERED = 0.35
#: and none may be longer than this.
MAX_REPEAT = 100

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, n_spans long, base_failed boolean, kept boolean"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers from 0."""
    number = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, longest common prefix of each with the next one)."""
    n = len(ids)
    if n < 2:
        return np.arange(n), np.zeros(0, np.int64)
    levels, rank, step = [], ids, 1
    while True:
        levels.append(np.append(rank, -1))
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([False], np.diff(key[order]) != 0)))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1:
            break
    left, right, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][left] == levels[k][right]).astype(np.int64) << k
        left += same
        right += same
        common += same
    return order, common


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs again."""
    order, common = suffix_array(ids)
    out = np.zeros(len(ids), np.int64)
    if len(common):
        out[order] = np.maximum(np.append(common, 0), np.concatenate(([0], common)))
    return out


def union_of(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def document_repetition(text: str | None) -> tuple:
    """The fields of RESULT for one text; null and empty texts have no words and fail the base."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    longest = longest_repeats(word_ids(words))
    (windows,) = np.nonzero(longest >= WINDOW)
    in_windows = int(union_of(windows, np.full(len(windows), WINDOW), n).sum()) if len(windows) else 0
    (starts,) = np.nonzero(longest >= REPEAT_WORDS)
    covered, spans = 0, 0
    if len(starts):
        inside = union_of(starts, longest[starts], n)
        covered, spans = int(inside.sum()), int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum())
    top = int(longest.max()) if n else 0
    failed = n < MIN_WORDS or 100 * in_windows > 100 * MAX_WINDOW_SHARE * n
    kept = not failed and covered <= MAX_COVERED * n and top <= MAX_REPEAT
    return n, chars, symbols, dup_lines, in_windows, covered, top, spans, failed, kept


def _rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in RESULT.split(", ")]
    for texts in batches:
        yield pd.DataFrame([document_repetition(text) for text in texts], columns=names)


def repetition_rules(text: Column) -> Column:
    """A struct with the fields of RESULT for every text. ``kept``: long enough, few words in
    repeated 8-word windows, and repeated substrings within the covered share and longest length."""
    return F.pandas_udf(_rules, RESULT)(text)


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of RESULT, a row for each row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", repetition_rules(F.col("text")).alias("r")).select("doc_id", "r.*")
