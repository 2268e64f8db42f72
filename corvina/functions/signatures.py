"""MinHash signatures of texts, in numpy, for tasks that look for similar texts."""

from __future__ import annotations

import re
import zlib

import numpy as np


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def character_grams(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` characters; the whole of a shorter text is one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) <= size:
        return np.array([zlib.crc32(text.encode("utf-8", "surrogatepass"))], np.uint64) if text else np.zeros(0, np.uint64)
    hashed = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        hashed = hashed * np.uint64(0xD1342543DE82EF95) + codes[k : len(codes) - size + 1 + k]
    return np.unique(_mix(hashed))


def letters(text: str) -> np.ndarray:
    """Hashes of the characters with their numbers among equal ones, whatever their order: what two texts share of
    these is all that can match between them."""
    seen: dict[str, int] = {}
    out = np.empty(len(text), np.uint64)
    for i, c in enumerate(text):
        out[i] = (ord(c) << 16) + seen.get(c, 0)
        seen[c] = seen.get(c, 0) + 1
    return _mix(out)


def word_grams(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words; the whole of a shorter text is one."""
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"\w+", text)], np.uint64)
    if len(words) <= size:
        return character_grams(text, len(text)) if text else np.zeros(0, np.uint64)
    hashed = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        hashed = hashed * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - size + 1 + k]
    return np.unique(_mix(hashed))


def minhash(grams: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The least of ``size`` keyed hashes over the grams; zeros for none."""
    if not len(grams):
        return np.zeros(size, np.uint64)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    keys = _mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    for start in range(0, len(grams), 512):
        least = np.minimum(least, _mix(grams[start : start + 512, None] ^ keys[None, :]).min(axis=0))
    return least


def bands_of(signature: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A hash of each ``rows`` components, that of its place and the salt too."""
    parts = signature.reshape(-1, rows)
    hashed = np.arange(len(parts), dtype=np.uint64) + np.uint64(salt << 32)
    for k in range(rows):
        hashed = _mix(hashed * np.uint64(0xD1342543DE82EF95) + parts[:, k])
    return hashed.view(np.int64)
