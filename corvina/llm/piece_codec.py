"""SentencePiece encoding with seeded merge-dropout, and decoding.

The pieces and scores of a merge-type (BPE) model with byte fallback are read from a model file; no
tokenizer is trained. The encoder merges the best-scored neighbours first, as the model's own does,
but a candidate that comes up is skipped if a keyed hash of the seed, the document's id, the unit's
number in the text and the candidate's place in the unit falls under the dropout rate. The result
varies with the key, not with the machine or the run, and always decodes to the very text.

No piece has a blank behind another character, so merges never leave a unit (blanks and what follows
them up to the next blank or line end), and units are encoded one by one. Every occurrence of a unit
has draws of its own. What is remembered is how a unit merges: for a set of skipped steps a node has
the candidates that come up behind the last of them if none of those is skipped, and the resulting
pieces. An occurrence draws all candidates of its node at once and goes on, if one is skipped, to the
node that skips it too.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import short_batches

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 2024
#: Remembered nodes (about 0.6 KB each); beyond that the memory starts anew, with the same results.
REMEMBERED = 300_000
#: Steps of a unit that a node may skip; an occurrence that skips a later one is merged on its own.
STEPS = 64
#: Occurrences that draw at once, and characters of texts whose units are gathered for that, for each of them.
DRAWN, GATHER = 1 << 17, 8
#: Units of at most so many characters are merged together in numpy, by classes of length.
LENGTHS = (4, 8, 12, 20, 36)
#: Rows of a batch that are coded before they are sent on.
STEP = 256

BLANK = "▁"
#: Stands for the character that the model writes for a blank where the text itself has it.
LITERAL = "\0" + BLANK
UNIT = re.compile(r" *[^ \n\r\t]+| +|[\n\r\t]")
_MASK = (1 << 64) - 1
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))
NONE = 1 << 40


class Pieces:
    """A model's pieces: ranks of those that merges may make, ids, and the bytes that ids decode to."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.id_of = {piece: i for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == "normal"}
        # equal scores share a rank, so that the leftmost of them is merged first
        place = {score: i for i, score in enumerate(sorted({scores[i] for i in self.id_of.values()}, reverse=True))}
        self.rank = {piece: place[scores[i]] for piece, i in self.id_of.items()}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if kind == "byte" else piece.replace(BLANK, " ").encode() if kind == "normal" else b"")
        merges = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                if piece[:k] in self.id_of and piece[k:] in self.id_of:
                    merges[self.id_of[piece[:k]] * len(pieces) + self.id_of[piece[k:]]] = (self.rank[piece], i)
        #: Left and right ids as one number, ascending, and the rank and id of the piece they make.
        self.pairs = np.array(sorted(merges), np.int64)
        self.made = np.array([merges[pair] for pair in self.pairs.tolist()], np.int64).reshape(-1, 2)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1 and piece != BLANK:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")] = self.id_of.get(BLANK, -1)
        self.packed = "<u2" if len(pieces) <= 1 << 16 else "<u4"


def load_pieces(path: str = MODEL_FILE) -> tuple[list[str], list[float], list[str]]:
    """Pieces, scores and kinds of a model file, to be shared with executors; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "byte" if model.is_byte(i) else "normal" if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) else "other"
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids]


class Encoder:
    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED, remembered: int = REMEMBERED, drawn: int = DRAWN):
        self.pieces, self.seed, self.remembered, self.drawn = pieces, seed, remembered, drawn
        self.limit = int(dropout * (1 << 32))
        self._forget()

    def _forget(self) -> None:
        """Node 0 stands for occurrences that are merged on their own."""
        self.roots: dict[str, int] = {}
        self.units, self.packed = [""], [b""]
        #: Of each node: its skipped steps as bits, the first step behind them, its candidates' start and number.
        self.skips, self.base, self.start, self.size = np.zeros(1024, np.uint64), *(np.zeros(1024, np.int64) for _ in range(3))
        #: Of each candidate: its place in the unit, hashed, and the node that skips it (-1: not known yet).
        self.place, self.child, self.candidates = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), 0

    @property
    def known(self) -> list[dict[str, bytes]]:
        """The remembered units as they are without a skipped merge (key 0)."""
        return [{unit: self.packed[node] for unit, node in self.roots.items()}]

    def _keeps(self, key: int, start: int, middle: int, end: int) -> bool:
        """Whether the merge of [start, middle) and [middle, end) is made when it comes up."""
        h = (key + start * int(A) + middle * int(B) + end * int(C)) & _MASK
        h = ((h ^ (h >> 29)) * int(D)) & _MASK
        return (h >> 32) >= self.limit

    def _merge(self, symbols: list[str], keeps: Callable[[int, int, int, int], bool]) -> list[str]:
        """``keeps`` is asked with the step's number and the candidate's start, middle and end."""
        step, rank, n = -1, self.pieces.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i]
            if j < n and (r := rank.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (r, i, j, after[j]))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, j, end = heapq.heappop(agenda)
            if not symbols[i] or after[i] != j or j >= n or after[j] != end:
                continue
            step += 1
            if not keeps(step, i, j, end):
                continue
            symbols[i], symbols[j], after[i] = symbols[i] + symbols[j], "", end
            if end < n:
                before[end] = i
            propose(i)
            if before[i] >= 0:
                propose(before[i])
        return [symbol for symbol in symbols if symbol]

    def _keys(self, doc_ids: list[str | None], counts: np.ndarray) -> np.ndarray:
        """A key for each unit of documents of so many units: of the seed, the whole id and its number."""
        own = np.array([xxhash.xxh3_64_intdigest(doc_id or "", self.seed) for doc_id in doc_ids], np.uint64)
        number = np.arange(1, counts.sum() + 1) - np.repeat(np.cumsum(counts) - counts, counts)
        x = np.repeat(own, counts) + number.astype(np.uint64) * A
        x = (x ^ (x >> np.uint64(30))) * D
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) | np.uint64(1)

    def _cut(self, unit: str, keeps: Callable[[int, int, int, int], bool]) -> bytes:
        symbols = [BLANK if c == " " else LITERAL if c == BLANK else c for c in unit]
        ids: list[int] = []
        for symbol in self._merge(symbols, keeps):
            if (found := self.pieces.id_of.get(symbol)) is not None:
                ids.append(found)
            else:
                ids += [self.pieces.byte_ids[b] for b in (BLANK if symbol == LITERAL else symbol).encode("utf-8", "surrogatepass")]
        return np.array(ids, self.pieces.packed).tobytes()

    def unit(self, unit: str, key: int) -> bytes:
        """The packed ids of one unit of any length and with any characters; key 0 skips no merge."""
        return self._cut(unit, lambda _, *place: not (key and self.limit) or self._keeps(key, *place))

    def _path(self, unit: str, skips: int, base: int) -> tuple[bytes, list[int]]:
        """A node's packed ids and candidates, for a unit with any characters."""
        places: list[int] = []

        def keeps(step: int, start: int, middle: int, end: int) -> bool:
            if self.limit and step >= base:
                places.append((start * int(A) + middle * int(B) + end * int(C)) & _MASK)
            return step >= STEPS or not skips >> step & 1

        return self._cut(unit, keeps), places

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no such piece, or no right neighbour: -1) and ids of merges."""
        pieces = self.pieces
        pair = left.astype(np.int64) * len(pieces.bytes_of) + right
        at = np.minimum(np.searchsorted(pieces.pairs, pair), len(pieces.pairs) - 1)
        found = (pieces.pairs[at] == pair) & (right >= 0)
        return np.where(found, pieces.made[at, 0], NONE), pieces.made[at, 1]

    def _together(self, ids: np.ndarray, skips: np.ndarray, since: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(packed ids of all nodes, how many each has, candidates of all, how many each has) for units
        of known characters, a row each, with -1 behind their ends. The same agenda as ``_merge``, a
        step for all rows at a time."""
        n, width = ids.shape
        wide = width + 1  # a column of -1 behind the last character
        symbol = np.full((n, wide), -1, np.int64)
        symbol[:, :width] = ids
        symbol = symbol.ravel()
        after = np.broadcast_to(np.minimum(np.arange(1, wide + 1), width), (n, wide)).ravel().copy()
        before = np.broadcast_to(np.arange(-1, width), (n, wide)).ravel().copy()
        after[symbol < 0] = width
        rank, made = np.full(n * wide, NONE), np.zeros(n * wide, np.int64)
        (first,) = np.nonzero((symbol[:-1] >= 0) & (symbol[1:] >= 0))
        rank[first], made[first] = self._ranks(symbol[first], symbol[first + 1])
        size = (symbol.reshape(n, wide) >= 0).sum(axis=1)
        row, step = np.arange(n), -1
        owners, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(row):
            step += 1
            i = rank.reshape(n, wide)[row].argmin(axis=1)
            at = row * wide + i
            live = rank[at] < NONE
            row, i, at = row[live], i[live], at[live]
            j = after[at]
            beside = row * wide + j
            end = np.where(j < width, after[beside], width)
            if self.limit:
                stop = np.minimum(end, size[row]).astype(np.uint64)
                behind = step >= since[row]
                owners.append(row[behind])
                places.append((i.astype(np.uint64) * A + j.astype(np.uint64) * B + stop * C)[behind])
                keep = (skips[row] >> np.uint64(min(step, STEPS - 1))) & np.uint64(step < STEPS) == 0
                rank[at[~keep]] = NONE
                i, at, beside, end, own = i[keep], at[keep], beside[keep], end[keep], row[keep]
            else:
                own = row
            symbol[at], symbol[beside], rank[beside] = made[at], -1, NONE
            after[at] = end
            base = own * wide
            inside = end < width
            before[(base + end)[inside]] = i[inside]
            rank[at], made[at] = self._ranks(symbol[at], symbol[base + end])
            left = before[at]
            has = left >= 0
            left = (base + left)[has]
            rank[left], made[left] = self._ranks(symbol[left], symbol[at[has]])
        used = symbol >= 0
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return symbol[used].astype(self.pieces.packed).tobytes(), used.reshape(n, wide).sum(axis=1), np.concatenate(places)[order], np.bincount(owner, minlength=n)

    def _remember(self, units: list[str], packed: list[bytes], skips: np.ndarray, base: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first, n, m = len(self.packed), len(self.packed) + len(units), self.candidates + len(places)
        room = lambda array, size: array if size <= len(array) else np.concatenate((array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)))
        self.skips, self.base, self.start, self.size = (room(x, n) for x in (self.skips, self.base, self.start, self.size))
        self.place, self.child = room(self.place, m), room(self.child, m)
        self.skips[first:n], self.base[first:n], self.size[first:n] = skips, base, sizes
        self.start[first:n] = self.candidates + np.cumsum(sizes) - sizes
        self.place[self.candidates : m], self.child[self.candidates : m] = places, -1
        self.units += units
        self.packed += packed
        self.candidates = m
        return np.arange(first, n)

    def learn(self, units: list[str], skips: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Nodes of distinct units and skipped steps, ``base`` being the first step behind those."""
        nodes = np.zeros(len(units), np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = self.pieces.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = np.cumsum(sizes)
        strange = np.concatenate(([0], np.cumsum(codes < 0)))
        odd = strange[ends] - strange[ends - sizes] > 0
        for i in np.flatnonzero(odd).tolist():
            packed, places = self._path(units[i], int(skips[i]), int(base[i]))
            nodes[i] = self._remember([units[i]], [packed], skips[i : i + 1], base[i : i + 1], np.array(places, np.uint64), np.array([len(places)]))[0]
        least = 0
        for width in LENGTHS:
            some = np.flatnonzero(~odd & (sizes > least) & (sizes <= width))
            least = width
            if not len(some):
                continue
            column = np.arange(width)
            at = (ends - sizes)[some][:, None] + column
            ids = np.where(column < sizes[some][:, None], codes[np.minimum(at, len(codes) - 1)], -1)
            packed, counts, places, candidates = self._together(ids, skips[some], base[some])
            to = (np.cumsum(counts) * np.dtype(self.pieces.packed).itemsize).tolist()
            cut = [packed[start:end] for start, end in zip([0, *to], to, strict=False)]
            nodes[some] = self._remember([units[i] for i in some.tolist()], cut, skips[some], base[some], places, candidates)
        return nodes

    def _skip(self, at: np.ndarray) -> None:
        """Learns the nodes that skip the candidates at the given distinct positions."""
        owner = np.searchsorted(self.start[: len(self.packed)], at, side="right") - 1
        step = self.base[owner] + at - self.start[owner]
        late = step >= STEPS
        self.child[at[late]] = 0
        at, owner, step = at[~late], owner[~late], step[~late]
        if len(at):
            nodes = self.learn([self.units[i] for i in owner.tolist()], self.skips[owner] | (np.uint64(1) << step.astype(np.uint64)), step + 1)
            self.child[at] = nodes

    def _draw(self, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The last nodes of occurrences with the given roots and keys."""
        nodes = nodes.copy()
        open_ = np.flatnonzero(self.size[nodes])
        while len(open_):
            own = nodes[open_]
            sizes = self.size[own]
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) + np.repeat(self.start[own] - ends + sizes, sizes)
            h = np.repeat(keys[open_], sizes) + self.place[place]
            hit = np.flatnonzero((((h ^ (h >> np.uint64(29))) * D) >> np.uint64(32)) < self.limit)
            who = np.searchsorted(ends, hit, side="right")
            lead = np.append(True, who[1:] != who[:-1])[: len(who)]
            who, place = who[lead], place[hit[lead]]
            if len(new := np.unique(place[self.child[place] < 0])):
                self._skip(new)
            open_, found = open_[who], self.child[place]
            nodes[open_] = found
            open_ = open_[self.size[found] > 0]
        return nodes

    def _cuts(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Packed ids of each of the units, which may repeat."""
        if len(self.packed) >= self.remembered:
            self._forget()
        if new := [unit for unit in set(units).difference(self.roots) if len(unit) <= LENGTHS[-1]]:
            none = np.zeros(len(new), np.int64)
            self.roots.update(zip(new, self.learn(new, none.astype(np.uint64), none).tolist(), strict=True))
        nodes = self._draw(np.fromiter(map(self.roots.get, units, repeat(0)), np.int64, len(units)), keys)
        out = list(map(self.packed.__getitem__, nodes.tolist()))
        for i in np.flatnonzero(nodes == 0).tolist():
            out[i] = self.unit(units[i], int(keys[i]))
        return out

    def encode_all(self, texts: list[str | None], keys: list[str | None]) -> list[bytes | None]:
        """Packed ids of whole texts: none for an empty one, null for null."""
        out: list[bytes | None] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= GATHER * self.drawn):
                size += len(texts[to] or "")
                to += 1
            cut = [UNIT.findall(" " + text) if text else [] for text in texts[at:to]]
            counts = np.array([len(units) for units in cut], np.int64)
            own, units = self._keys(keys[at:to], counts), list(chain.from_iterable(cut))
            parts: list[bytes] = []
            for i in range(0, len(units), self.drawn):
                parts += self._cuts(units[i : i + self.drawn], own[i : i + self.drawn])
            ends = np.cumsum(counts).tolist()
            out += [None if text is None else b"".join(parts[start:end]) for text, start, end in zip(texts[at:to], [0, *ends], ends, strict=False)]
            at = to
        return out


def decode(packed: bytes, pieces: Pieces) -> str:
    """The text of packed ids: the blank that every encoding starts with is dropped."""
    raw = b"".join([pieces.bytes_of[i] for i in np.frombuffer(packed, pieces.packed).tolist()])
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_ENCODERS: dict = {}


def _encoder(shared, *options) -> Encoder:
    """One per worker, model and options: what it remembers serves all its tasks."""
    key = (shared.value[3], *options)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Pieces(*shared.value[:3]), *options)
    return _ENCODERS[key]


class Codec:
    """Column functions for one model. ``dropout`` 0 gives the model's own segmentation; ``remembered`` and
    ``drawn`` bound a worker's memory, at the price of merging and drawing more often, with the same results."""

    def __init__(self, docs: DataFrame, path: str = MODEL_FILE, dropout: float = DROPOUT, seed: int = SEED, remembered: int = REMEMBERED, drawn: int = DRAWN):
        self.shared = docs.sparkSession.sparkContext.broadcast((*load_pieces(path), path))
        self.options = (dropout, seed, remembered, drawn)

    def encode(self, text: Column, doc_id: Column) -> Column:
        """Packed ids (binary, little-endian unsigned) of whole texts. A null text has none (null); a
        null id is a key like any other."""
        shared, options = self.shared, self.options

        def encode_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            encoder = _encoder(shared, *options)
            for texts, keys in batches:
                yield pd.Series(encoder.encode_all(list(texts), list(keys)), dtype=object)

        return F.pandas_udf(encode_batches, "binary")(text, doc_id.cast("string"))

    def decode(self, packed: Column) -> Column:
        """Texts of packed ids; null for null."""
        shared, options = self.shared, self.options

        def decode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pieces = _encoder(shared, *options).pieces
            for rows in batches:
                yield pd.Series([None if row is None else decode(row, pieces) for row in rows], dtype=object)

        return F.pandas_udf(decode_batches, "string")(packed)

    def ids(self, packed: Column) -> Column:
        """Packed ids as an array of integers."""
        dtype = "<u2" if len(self.shared.value[0]) <= 1 << 16 else "<u4"

        def unpack_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield pd.Series([None if row is None else np.frombuffer(row, dtype).astype(np.int32) for row in rows], dtype=object)

        return F.pandas_udf(unpack_batches, "array<int>")(packed)

    def width(self) -> int:
        return 2 if len(self.shared.value[0]) <= 1 << 16 else 4


def encode_documents(docs: DataFrame, codec: Codec, keep: tuple[str, ...] = ("doc_id",), packed: bool = True) -> DataFrame:
    """The columns of ``keep``, ids (packed, or an array of integers), n_pieces, lossless for each row of
    ``docs`` (doc_id, text and what is kept). ``lossless``: the ids were decoded again, to the very
    text. A null text has null ids, no pieces, and is lossless. A batch is coded STEP rows at a time,
    in one worker, so that only its texts and a few rows' ids are in memory."""
    shared, options, width = codec.shared, codec.options, codec.width()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, *options)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = part.column("_text").to_pylist()
                found = encoder.encode_all(texts, part.column("_key").to_pylist())
                same = [text is None or decode(ids, encoder.pieces) == text for ids, text in zip(found, texts, strict=True)]
                counts = [len(ids or b"") // width for ids in found]
                ids = pa.array(found, pa.binary()) if packed else pa.array([None if x is None else np.frombuffer(x, encoder.pieces.packed).astype(np.int32) for x in found], pa.list_(pa.int32()))
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=[*keep, "ids", "n_pieces", "lossless"])

    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])
    return short_batches(docs).select(*keep, F.col("text").alias("_text"), F.col("doc_id").cast("string").alias("_key")).mapInArrow(code, schema)
