"""Secret scan: three patterns, and values in a credential's place that would be hard to guess.

How hard a value is to guess is the cheapest way to cut it into words, dates, repeats, keyboard
walks and brute-force spans (decimal logarithm of the guesses), found by dynamic programming over
its places. Dates, ranked words, repeats of any unit and walks are offered at every place and in every
length in which they fit. A value that names a credential and costs at least MIN_GUESSES is reported with
the kind ``guess`` where no pattern has it yet; words and walks used as placeholders cost less and aren't.

A word costs the logarithm of its rank, among frequent stems of passwords or among the corpus's own
words, which ``word_ranks`` counts over all documents: an everyday word in a credential's place is no
secret. Of the corpus, words of 3 to 24 letters (LETTERS) are ranked, the RANKED most frequent of those in
IN_DOCUMENTS documents or more; others are spelled out by brute force.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.frequent import most_frequent

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
HINTS = (b"passw", b"secret", b"token", b"api")
#: Decimal logarithm of the guesses from which a value counts as a secret, the largest alphabet, and the
#: length that the two imply: no shorter value can cost so much.
MIN_GUESSES, ALPHABET = 12.0, 95
SHORTEST = math.ceil(MIN_GUESSES / math.log10(ALPHABET))
NAMES = "pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?"
#: What names a credential, and the value that follows it.
CONTEXT = re.compile(rf"""({NAMES})["']?\x20*(?::=|=>|[:=])\x20*["']?([^\x00-\x20"'<>,;]{{{SHORTEST},}})""".encode(), re.IGNORECASE)
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential")
#: Each further segment multiplies the guesses: an attacker doesn't know the cut.
SEGMENT = 0.6

# Frequent stems of passwords and placeholders, most frequent first.
WORDS = """password pass admin user login welcome secret token key test example sample demo changeme
default root master guest hello love monkey dragon letmein access server database prod staging dev
local host your my the here insert value placeholder dummy none null true false string name mail
company summer winter spring autumn football baseball sunshine princess shadow super public private
client service account api app web data""".split()
#: Words of the corpus that are ranked, the most frequent ones, the fewest documents that each is in, and
#: its length.
RANKED, IN_DOCUMENTS, LETTERS = 30_000, 3, (3, 24)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {key: (x, y) for y, row in enumerate(ROWS) for x, key in enumerate(row)}
LEET = str.maketrans("4301$5@7", "aeolssat")
DATES = [
    (re.compile(r"(?:19|20)\d\d"), math.log10(120)),
    (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"), math.log10(120 * 366)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"), math.log10(120 * 366)),
]
#: Units that a repeat has at least, and keys of a walk.
TIMES = 3


class Ranks(dict):
    """What each word costs, from the corpus's words in their order: the stems' rank if it is better."""

    def __init__(self, words: list[str] = ()):
        super().__init__((word, math.log10(i + 2)) for i, word in enumerate(words))
        for i, word in enumerate(WORDS):
            self[word] = min(self.get(word, math.inf), math.log10(i + 2))
        self.longest = max(map(len, self))


STEMS = Ranks()


def _alphabet(value: str) -> float:
    size = 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    return math.log10(max(10, size + 33 * any(not c.isalnum() for c in value)))


def _common(value: str, i: int, j: int, backward: bool) -> int:
    """How many characters from i and j on (or before them) are the same, by growing slices."""
    most = i if backward else len(value) - j
    same = (lambda n: value[i - n : i] == value[j - n : j]) if backward else lambda n: value[i : i + n] == value[j : j + n]
    low, high = 0, 1
    while high <= most and same(high):
        low, high = high, 2 * high
    high = min(high, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if same(middle) else (low, middle)
    return low


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of every longest stretch that repeats a unit, no repeat itself, TIMES times or
    more. A stretch with that unit holds two multiples of it, from which it is extended both ways."""
    found: dict[tuple[int, int], list[int]] = {}
    for unit in range(1, len(value) // TIMES + 1):
        at = 0
        while at + unit < len(value):
            if value[at] == value[at + unit]:
                start, end = at - _common(value, at, at + unit, True), at + unit + _common(value, at, at + unit, False)
                units = found.setdefault((start, end), []) if end - start >= TIMES * unit else None
                if units is not None and not any(unit % known == 0 for known in units):
                    units.append(unit)
                at += max(1, (end - unit - at) // unit) * unit
            else:
                at += unit
    return [(start, end, unit) for (start, end), units in found.items() for unit in units]


def walks(value: str) -> list[tuple[int, int, int]]:
    """(start, end, 1) of every longest stretch of TIMES keys or more, each next to the one before."""
    out, start = [], 0
    for i in range(1, len(value) + 1):
        a, b = PLACE.get(value[i - 1]), PLACE.get(value[i]) if i < len(value) else None
        if a is None or b is None or a == b or max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 1:
            if i - start >= TIMES:
                out.append((start, i, 1))
            start = i
    return out


class Stretch:
    """Segments inside a stretch, any number of units long from TIMES on: a segment of n units costs
    ``fixed`` + ``each`` * n + log10(n). As the logarithm rises ever more slowly, a later start that is once
    no better than an earlier one stays so; few starts are left to look at."""

    def __init__(self, start: int, end: int, unit: int, fixed: float, each: float):
        self.start, self.end, self.unit, self.fixed, self.each = start, end, unit, fixed, each
        self.starts: list[list[tuple[int, float]]] = [[] for _ in range(unit)]

    def open(self, place: int, base: float) -> None:
        self.starts[place % self.unit].append((place, base))

    def best(self, place: int) -> float:
        least, kept = math.inf, []
        for start, base in self.starts[place % self.unit]:
            n = (place - start) // self.unit
            if n < TIMES:
                kept.append((start, base))
            elif (cost := base + self.fixed + self.each * n + math.log10(n)) < least:
                least = cost
                kept.append((start, base))
        self.starts[place % self.unit] = kept
        return least


def guess_cost(value: str, rank: Ranks = STEMS) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation needs; 0 for no characters."""
    n, per_char, lower = len(value), _alphabet(value), value.lower()
    lower = lower if len(lower) == n else value
    plain = lower.translate(LEET) if lower.isascii() else lower
    stretches = [Stretch(*run, run[2] * per_char, 0.0) for run in repeats(value)]
    stretches += [Stretch(*run, math.log10(len(PLACE)), 0.3) for run in walks(lower)]
    stretches.sort(key=lambda stretch: stretch.start, reverse=True)
    inside: list[Stretch] = []
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    brute = math.inf  # the cheapest cost before an open brute-force span, less what its start has cost
    for start in range(n + 1):
        while stretches and stretches[-1].start <= start:
            inside.append(stretches.pop())
        inside = [stretch for stretch in inside if stretch.end >= start]
        if start:
            best[start] = min(best[start], brute + start * per_char, *[stretch.best(start) for stretch in inside])
        if start == n:
            break
        base = best[start] + (SEGMENT if start else 0)
        brute = min(brute, base - start * per_char)
        for stretch in inside:
            stretch.open(start, base)

        def offer(end: int, cost: float, base: float = base) -> None:
            if base + cost < best[end]:
                best[end] = base + cost

        for pattern, cost in DATES:
            if m := pattern.match(value, start):
                offer(m.end(), cost)
        if value[start] in "_-.":
            offer(start + 1, math.log10(3))
        for end in range(start + 2, min(n, start + rank.longest) + 1):
            if (cost := rank.get(plain[start:end])) is not None:
                offer(end, cost + 0.3 * sum(a != b for a, b in zip(plain[start:end], value[start:end], strict=True)))
            if plain is not lower and (cost := rank.get(lower[start:end])) is not None:
                offer(end, cost + 0.3 * sum(a != b for a, b in zip(lower[start:end], value[start:end], strict=True)))
    return best[n]


def find_secrets(text: str | None, rank: Ranks = STEMS) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind's number, end) in code points, sorted, and the highest guess cost of a value in a
    credential's place (0 if there is none)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low, found, cost = raw.lower(), [], 0.0
    if any(hint in low for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LENGTH]
    if HEX_RUN in raw.translate(HEX_MASK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= HEX_LENGTH]
    if any(hint in low for hint in CONTEXT_HINTS):
        base = list(found)
        for m in CONTEXT.finditer(raw):
            start, end = m.span(2)
            guesses = guess_cost(raw[start:end].decode("utf-8", "replace"), rank)
            cost = max(cost, guesses)
            if guesses >= MIN_GUESSES and not any(a < end and start < b for a, _, b in base):
                found.append((start, 3, end))
    if found and len(raw) != len(text or ""):
        count = lambda at: len(raw[:at].decode("utf-8", "replace"))
        found = [(count(a), kind, count(b)) for a, kind, b in found]
    return sorted(found), cost


HEX_MASK = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(".") for i in range(256))
HEX_RUN = b"h" * HEX_LENGTH

RESULT = "n_assign long, n_access long, n_hex long, n_guess long, max_guess_log10 double, base_sha256 string, spans string"


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def word_ranks(docs: DataFrame, most: int = RANKED, at_least: int = IN_DOCUMENTS) -> list[str]:
    """The corpus's words by the number of documents they are in, as ``most_frequent`` takes them: ``most``
    at most, in ``at_least`` documents each. A word is a run of letters between blanks, with a mark behind it or
    without; what follows a credential's name isn't counted."""
    clean = F.regexp_replace(F.lower("text"), rf"""(?:{NAMES})["']?\x20*(?::=|=>|[:=])\x20*["']?[^\x00-\x20"'<>,;]+""", " ")
    pattern = rf"(?<![^\x00-\x20])\p{{L}}{{{LETTERS[0]},{LETTERS[1]}}}(?=[.,;:!?]?(?:[\x00-\x20]|$))"
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(pattern), F.lit(0)))).alias("word"))
    return most_frequent(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least), most)


def scan_secrets(text: Column, docs: DataFrame, words: list[str]) -> Column:
    """A struct with the fields of RESULT for every whole text; null is an empty text. ``spans``:
    kind:start:end, by start, then kind, in code points, end exclusive. ``words``: see ``word_ranks``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rank = Ranks(shared.value)
        names = [field.split()[0] for field in RESULT.split(", ")]
        for texts in batches:
            rows = []
            for text in texts:
                spans, cost = find_secrets(text, rank)
                kinds = [kind for _, kind, _ in spans]
                base = _named([span for span in spans if span[1] < 3])
                rows.append((*map(kinds.count, range(4)), cost, hashlib.sha256(base.encode()).hexdigest(), _named(spans)))
            yield pd.DataFrame(rows, columns=names)

    return F.pandas_udf(scan, RESULT)(text)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of RESULT, a row for each row of ``docs`` (doc_id, text), repeated ones too. The
    words that values are cut into are ranked over all of ``docs`` first."""
    return docs.select("doc_id", scan_secrets(F.col("text"), docs, word_ranks(docs)).alias("r")).select("doc_id", "r.*")
