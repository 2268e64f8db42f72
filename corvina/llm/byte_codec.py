"""Byte-level BPE encoding and decoding as tree reductions of a monoid.

A text is halved down to leaves, which are encoded as texts of their own; the encodings of neighbours
are then joined up the tree. Joining looks at a window around the boundary only. Its ends are cuts
that no match of the splitting pattern crosses whatever stands around them (CUT), so tokens outside
stay as they are: the window grows until such a cut is found on each side, and is encoded anew.
Where a long run of letters, digits or marks holds no cut, the whole run is one match, and the window
grows token by token: a sequence of tokens is the encoding of its bytes if every two neighbours are
that of theirs, so it ends where the tokens at its edges go with their neighbours outside.

Decoding halves the ids in the same way and concatenates bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import short_batches

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a leaf.
LEAF = 8192
#: Characters on each side in which a cut is looked for first.
WINDOW = 32
#: A window without a cut is encoded anew up to so many characters; beyond, its tokens are looked at.
RUN = 512
#: Tokens on each side of a boundary inside a run that are merged anew first.
EDGE = 4
#: Ids that are decoded at once.
DECODED = 4096

_MARK = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
#: Between these characters the pattern never matches across, and each side's matches are what they are
#: without the other: behind anything but a blank comes a blank, or the kind of character changes (an
#: apostrophe may belong to the letters behind it).
CUT = re.compile(rf"(?<=\S)(?=[\t\n\r ])|(?<=[A-Za-z])(?=[0-9{_MARK}'])|(?<=[0-9])(?=[A-Za-z{_MARK}'])|(?<=[{_MARK}])(?=[A-Za-z0-9])")


class Tokens:
    """A vocabulary: ``encode`` for whole texts, ``merge`` for the bytes of one match, bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        coder = tiktoken.Encoding("byte_codec", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.merge = coder.encode_ordinary, coder._encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]


def load_ranks(path: str = RANK_FILE) -> dict[bytes, int]:
    """Ranks by token, read on the driver and shared with the executors."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _last_cut(text: str, start: int, end: int) -> int:
    """The last cut between two places, or the first of them; looked for in growing windows."""
    width = WINDOW
    while True:
        at = max(start, end - width)
        found = -1
        for cut in CUT.finditer(text, at, end):  # a cut needs the character behind it inside
            found = cut.start()
        if found > start:
            return found
        if at == start:
            return start
        width *= 2


def _first_cut(text: str, start: int, end: int) -> int:
    """The first cut behind the first of two places, or the second."""
    width = WINDOW
    while True:
        to = min(end, start + width)
        # the left character of a cut must be inside, so the boundary itself is none
        cut = CUT.search(text, start + 1, min(end, to + 1))
        if cut and cut.start() < end:
            return cut.start()
        if to == end:
            return end
        width *= 2


def _one_match(run: str) -> bool:
    """Whether a run between two cuts is a single match of the pattern."""
    body = run[1:] if run[:1] == " " else run
    return body.isalpha() or (body.isascii() and (body.isdigit() or not any(c.isalnum() or c.isspace() for c in body)))


class Tree:
    """The monoid of encodings of substrings of one text: ids of a range of characters."""

    def __init__(self, tokens: Tokens, text: str):
        self.tokens, self.text = tokens, text

    def encode(self, leaf: int = LEAF) -> list[int]:
        text = self.text
        level = [(i, min(len(text), i + leaf), self.tokens.encode(text[i : i + leaf])) for i in range(0, len(text), leaf)]
        while len(level) > 1:
            joined = [self._join(*pair) for pair in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(joined) * 2 :]
        return level[0][2] if level else []

    def _join(self, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]]) -> tuple[int, int, list[int]]:
        """The encoding of both ranges as one. The left list is used up."""
        (start, middle, a), (_, end, b) = left, right
        first, last = _last_cut(self.text, start, middle), _first_cut(self.text, middle, end)
        before = self._tail(a, self.text[first:middle])
        behind = self._head(b, self.text[middle:last])
        run = self.text[first:last]
        if len(run) > RUN and _one_match(run):
            new = self._merge_run(a[before:], b[:behind])
        else:
            new = self.tokens.encode(run)
        a[before:] = new
        a += b[behind:]
        return start, end, a

    def _tail(self, ids: list[int], part: str) -> int:
        """How many ids come before those of the last characters."""
        left, i = len(part.encode()), len(ids)
        while left > 0:
            i -= 1
            left -= len(self.tokens.bytes_of[ids[i]])
        assert not left
        return i

    def _head(self, ids: list[int], part: str) -> int:
        """How many ids the first characters have."""
        left, i = len(part.encode()), 0
        while left > 0:
            left -= len(self.tokens.bytes_of[ids[i]])
            i += 1
        assert not left
        return i

    def _fit(self, one: int, other: int) -> bool:
        """Whether two tokens are the encoding of their bytes in one match."""
        return self.tokens.merge(self.tokens.bytes_of[one] + self.tokens.bytes_of[other]) == [one, other]

    def _merge_run(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of a match from those of its two parts: what lies around the boundary is merged
        anew, more and more of it, until its outermost tokens fit their neighbours."""
        if not a or not b or self._fit(a[-1], b[0]):
            return a + b
        size_of, width_a, width_b = self.tokens.bytes_of, EDGE, EDGE
        while True:
            kept_a, kept_b = a[:-width_a], b[width_b:]
            new = self.tokens.merge(b"".join([size_of[i] for i in (*a[-width_a:], *b[:width_b])]))
            good_a = not kept_a or self._fit(kept_a[-1], new[0])
            good_b = not kept_b or self._fit(new[-1], kept_b[0])
            if good_a and good_b:
                return kept_a + new + kept_b
            width_a, width_b = width_a * (1 + (not good_a)), width_b * (1 + (not good_b))


def encode(text: str | None, tokens: Tokens, leaf: int = LEAF) -> list[int]:
    """Ids of a whole text; none for a null or empty one."""
    return Tree(tokens, text).encode(leaf) if text else []


def decode(ids: list[int], tokens: Tokens, leaf: int = DECODED) -> bytes:
    if len(ids) <= leaf:
        return b"".join([tokens.bytes_of[i] for i in ids])
    half = len(ids) // 2
    return decode(ids[:half], tokens, leaf) + decode(ids[half:], tokens, leaf)


_TOKENS: dict = {}


def _tokens(shared) -> Tokens:
    """One per worker and vocabulary."""
    path, ranks = shared.value
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = Tokens(ranks)
    return _TOKENS[path]


class Codec:
    """Column functions for one rank file."""

    def __init__(self, docs: DataFrame, path: str = RANK_FILE):
        self.shared = docs.sparkSession.sparkContext.broadcast((path, load_ranks(path)))

    def encode(self, text: Column) -> Column:
        """Ids (array of int) of whole texts; null for null."""
        shared = self.shared

        def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = _tokens(shared)
            for texts in batches:
                yield pa.array([None if text is None else encode(text, tokens) for text in texts.to_pylist()], pa.list_(pa.int32()))

        return F.arrow_udf(encode_batches, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """Bytes (binary) of ids; null for null."""
        shared = self.shared

        def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = _tokens(shared)
            for rows in batches:
                yield pa.array([None if ids is None else decode(ids, tokens) for ids in rows.to_pylist()], pa.binary())

        return F.arrow_udf(decode_batches, "binary")(ids)


def encode_documents(docs: DataFrame, path: str = RANK_FILE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text): digests of
    the decimal ids, joined by blanks, and of the bytes that they decode to. A null text is an empty
    one. Rows are independent of each other, so repeated ids and texts each have their row."""
    shared = Codec(docs, path).shared
    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared)
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column("_text"):  # one whole text and its ids at a time
                ids = encode(text.as_py(), tokens)
                sizes.append(len(ids))
                of_ids.append(digest(b" ".join([tokens.decimal[i] for i in ids])))
                of_bytes.append(digest(decode(ids, tokens)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return short_batches(docs).select("doc_id", F.col("text").alias("_text")).mapInArrow(code, schema)
