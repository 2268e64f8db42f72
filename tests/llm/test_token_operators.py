"""Resampling to a target, byte-level coding and cross-tokenizer alignment, against brute force."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from corvina.llm import alignment, byte_codec, queries, target_resampling

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} und{i}" for i in range(20_000)) + "x" * 5000
DOCS = "doc_id long, text string, source string, keys string, score double, rank string"
PLAIN = "the cat sat on the mat and looked at the dog in the garden of the house by the sea"
ROWS = [(1, None), (2, ""), (3, PLAIN), (3, PLAIN), (4, "ein hund lief durch den garten " * 9), (None, PLAIN), (None, PLAIN + "!"), (5, "\n\n \t\n"), (6, LONG), (7, "<|endoftext|> </s> ▁x"), (8, "日本語😀'ré  don't\x00"), (9, PLAIN.upper())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, text, "a", "k", 0.5, "r") for i, text in ROWS], DOCS).cache()


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]]


def brute_resampling(rows, target):
    held = collections.Counter(b for _, text in rows for b in brute_features(text)[1])
    sought = collections.Counter(b for text in target for b in brute_features(text)[1])
    n_held, n_sought = sum(held.values()), sum(sought.values())
    gain = [math.floor(1000 * math.log((sought[b] + 1) * (n_held + 10000) / ((held[b] + 1) * (n_sought + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        n_words, buckets = brute_features(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n_words, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def test_resampling(spark, docs):
    target = ["the dog in the house", None, "", "garden of the cat"]
    got = target_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=50).collect()
    want = brute_resampling(ROWS, target)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r["rank"], r["doc_id"]) for r in drawn] == [(i + 1, r[0]) for i, r in enumerate(able[: len(able) * 50 // 100])]
    assert target_resampling.resample(docs.limit(0), docs.limit(0)).count() == 0
    assert all(r["rank"] is None for r in target_resampling.resample(docs.where("doc_id = 2"), docs).collect())


def test_resampled_repeats(spark):
    rows = [(7, PLAIN)] * 40 + [(None, PLAIN)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in target_resampling.resample(docs, docs).collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in got) == list(range(1, 12))


def test_long_words():
    texts = [b"x" * 100 + b" " + b"Y" * 70 + b" zz " + b"q" * 65, b"", None, b"one"]
    bucket, owner, counts = target_resampling.features(texts)
    for i, text in enumerate(texts):
        n, want = brute_features((text or b"").decode())
        assert counts[i] == n and sorted(bucket[owner == i].tolist()) == sorted(want)


def test_kth_key(spark):
    random.seed(3)
    rows = [(random.randint(0, 9), i) for i in range(500)]
    keys = spark.createDataFrame(rows, "a long, b long").cache()
    for k in (1, 2, 77, 250, 499, 500):
        assert target_resampling.kth(keys, ["a", "b"], k, pivots=3) == sorted(rows)[k - 1]
    assert target_resampling.kth(keys, ["a", "b"], 501) is None and target_resampling.kth(keys, ["a", "b"], 0) is None
    placed = target_resampling.numbered(keys.repartition(5), ["a", "b"], "place").collect()
    assert [(r["a"], r["b"]) for r in sorted(placed, key=lambda r: r["place"])] == sorted(rows)


@pytest.fixture(scope="module")
def tokens():
    return byte_codec.Tokens(byte_codec.load_ranks())


PARTS = ["hello", "World's", "'re", "  ", "\n\n", " \n ", "\t", "123", "4567890", "!!!", "...'", "'s", "don't", "aaaaaaaa", "日本語", "é", "ñandú", "\xa0", "　", "\x1c", "\x85", "😀", "'", "''", "'l", "l", "<|endoftext|>", " ", "ⅷ", "٣", "x", " x", "'v", "e", "_", "   ", "Ж"]


def test_tree_reduction(tokens):
    random.seed(4)
    for _ in range(800):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 40)))
        for leaf in (1, 3, 16):
            assert byte_codec.encode(text, tokens, leaf) == tokens.encode(text), text
    runs = ["abcdefghij" * 400, "日本語のテキスト" * 200, " " * 3000, "\n" * 3001 + "x", "é" * 3000 + "1", "x'" * 900, "".join(random.choice("!?.,;-'") for _ in range(3000)), "".join(random.choice("0123456789") for _ in range(3000)), " " + "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))]
    for text in runs:
        for leaf in (64, 300, 1500):
            ids = byte_codec.encode(text, tokens, leaf)
            assert ids == tokens.encode(text) and byte_codec.decode(ids, tokens, 50) == text.encode()


def test_byte_codec(docs, tokens):
    got = byte_codec.encode_documents(docs).collect()
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = [(i, len(tokens.encode(t or "")), digest(" ".join(map(str, tokens.encode(t or ""))).encode()), digest((t or "").encode())) for i, t in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_codec.encode_documents(docs.limit(0)).count() == 0
    codec = byte_codec.Codec(docs)
    back = docs.select("text", codec.decode(codec.encode(F.col("text"))).cast("string").alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)


def brute_alignment(rows, pair):
    """Groups from common ends, links from groups, counts over all rows."""
    split, held = [], []
    for _, text in rows:
        a, b = (pair.a.encode_ordinary(" " + text), pair.b.encode(text)) if text else ([], [])
        raw = b"".join(pair.b_bytes[i] for i in b)
        if not text or raw != (" " + text).encode() or b"".join(pair.a_bytes[i] for i in a) != raw:
            a, b = [], []
        ends = []
        for ids, own in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, found = 0, {}
            for n, i in enumerate(ids, 1):
                at += len(own[i])
                found[at] = n
            ends.append(found)
        groups, x, y = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            groups.append((a[x : ends[0][end]], b[y : ends[1][end]]))
            x, y = ends[0][end], ends[1][end]
        split.append((a, b, groups))
        held.append(collections.Counter((p, q) for left, right in groups for p in left for q in right))
    counts = collections.Counter(link for one in held for link in one)
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), (a, b, groups), links in zip(rows, split, held, strict=True):
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        n_best = sum(n for link, n in links.items() if counts[link] == best[link[0]])
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), n_best, sum(n * counts[link] for link, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.load_tokenizers())


def test_alignment(spark, docs, pair):
    want = sorted(brute_alignment(ROWS, pair), key=str)
    for hot in (alignment.HOT, 20, 0):
        assert sorted(map(tuple, alignment.align_documents(docs, hot=hot).collect()), key=str) == want
    assert alignment.align_documents(docs.limit(0)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_alignment(spark, SMALL).collect())) == sorted(brute_alignment(rows, pair))


def test_lanes_and_large_groups(pair, monkeypatch):
    random.seed(5)
    texts = ["".join(random.choice(["ab ", "é", "日本", "😀", " ", "1", " the ", "     "]) for _ in range(random.randint(0, 900))) for _ in range(12)] + ["", None, "a"]
    want = alignment.align(texts, pair)
    monkeypatch.setattr(alignment, "LANE", 8)
    monkeypatch.setattr(alignment, "LISTED", 6)
    assert alignment.align(texts, pair) == want


def test_a_is_the_file_of_the_other_library(pair):
    """A's file names a vocabulary for the tokenizers library; that library gives the same ids."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(alignment.A_FILE)
    own.encode_special_tokens = True
    kinds = collections.defaultdict(list)
    for c in map(chr, range(0x110000)):
        kinds[unicodedata.category(c)].append(c)
    del kinds["Cs"]
    random.seed(6)
    chars = [c for some in kinds.values() for c in random.sample(some, min(len(some), 400))]
    texts = [f"x{c}\n1{c}\n!{c}x\n {c}\n{c}{c}y\n" for c in chars] + [" " + text for _, text in ROWS if text]
    assert [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)] == pair.a.encode_ordinary_batch(texts, num_threads=1)
