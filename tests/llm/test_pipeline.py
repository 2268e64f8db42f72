"""The corpus pipeline on a small table against its stages in plain Python."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvina.llm import language_crf, piece_codec, source_mix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    random.seed(7)
    words = {"en": "the house garden water morning light river people always found little story under".split(), "de": "das haus garten wasser morgen licht fluss leute immer fand kleine geschichte unter".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(random.choice(words[lang]) for _ in range(random.randint(4, 12))) + f" {lang}{i}x{k}" for k in range(random.randint(2, 6))]
        if i % 4 == 0:
            lines.insert(0, "all rights reserved by this page")
        rows.append([i, "\n".join(lines), lang, f"s{i % 3}", 0])
    rows[30][1] = rows[9][1]  # a copy
    rows[40][1] = rows[13][1] + " more"  # a near copy
    rows[50][1] = "1234 5678 --- 99"  # no language
    rows[51][1] = ""
    rows[52][1] = None
    for i in (60, 63, 66, 69):  # repeated so often by its source that all its lines are boilerplate
        rows[i][1] = "the same little page\nof the same source here"
    for row in rows:
        row[4] = len(row[1] or "")
    return [tuple(row) for row in rows]


def keep_language(rows, model):
    found = model.predict([row[1] for row in rows])
    return [row for row, (lang, score) in zip(rows, found, strict=True) if lang != language_crf.UNKNOWN and score >= corpus_pipeline.LANGUAGE_SHARE]


def drop_lines(rows):
    trim = lambda line: line.strip(" \t\r\x0b\f")
    pages, counts = collections.Counter(row[3] for row in rows), collections.Counter()
    for row in rows:
        counts.update({(row[3], trim(line)) for line in row[1].split("\n") if trim(line)})
    out = []
    for row in rows:
        lines = row[1].split("\n")
        kept = [line for line in lines if not (counts[row[3], trim(line)] >= 3 and counts[row[3], trim(line)] > 0.02 * pages[row[3]])]
        text = "\n".join(kept) if any(map(trim, kept)) else row[1]
        out.append((row[0], text, row[2], row[3], len(text)))
    return out


def drop_copies(rows):
    def shingles(text):
        words = text.split()
        return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    bags, root = [shingles(row[1]) for row in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return [row for i, row in enumerate(rows) if root[i] == i]


def level(parts, total):
    """The level at which min(cap, weight * level) of (cap, weight) sums to the total; null beyond all caps."""
    parts = sorted(parts, key=lambda p: p[0] / p[1])
    for i, (cap, weight) in enumerate(parts):
        at = (total - sum(c for c, _ in parts[:i])) / sum(w for _, w in parts[i:])
        if at * weight <= cap:
            return at
    return None


def mix(rows):
    sizes = {row[0]: len(row[1].split()) for row in rows}
    sources = sorted({row[3] for row in rows})
    total = {s: sum(sizes[row[0]] for row in rows if row[3] == s) for s in sources}
    weights = {s: source_mix.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    top = level([(2 * total[s], weights[s]) for s in sources], 1.5 * sum(total.values()))
    out = []
    for s in sources:
        target = 2 * total[s] if top is None else min(2 * total[s], weights[s] * top)
        own = [row for row in rows if row[3] == s]
        bits = lambda row: sizes[row[0]].bit_length()
        by_bits = collections.Counter()
        for row in own:
            by_bits[bits(row)] += sizes[row[0]]
        theta = level([(2 * n, b * n) for b, n in by_bits.items()], target)
        copies = {row[0]: 2.0 if theta is None else min(2.0, theta * bits(row)) for row in own}
        rest = target - sum(int(copies[row[0]]) * sizes[row[0]] for row in own)
        order = []
        for row in own:
            if (p := copies[row[0]] % 1) > 0:
                u = (int(hashlib.md5(f"{source_mix.SEED}:{row[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = (u / (1 - u)) * ((1 - p) / p)
                order.append((q / (1 + q), row[0]))
        ahead, more = 0, set()
        for _, i in sorted(order):
            if 2 * ahead + sizes[i] <= 2 * rest:
                more.add(i)
            ahead += sizes[i]
        out += [row for row in own for _ in range(int(copies[row[0]]) + (row[0] in more))]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}"
    spark.createDataFrame(make_rows(), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_like_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = [lambda rows: keep_language(rows, language_crf.train(language_crf.language_sample(docs))), drop_lines, drop_copies, mix]
    rows, held = sorted(tuple(r) for r in docs.collect()), docs
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        rows = brute(rows)
        held = stage(spark, held, folder).cache()
        assert sorted(tuple(r) for r in held.collect()) == sorted(rows), name
    assert len(rows) > 100
    coded = corpus_pipeline.run(spark, folder)
    codec = piece_codec.Codec(coded)
    pieces = piece_codec.Pieces(*codec.shared.value[:3])
    got = []
    for r in coded.collect():
        text = b"".join(pieces.bytes_of[i] for i in r["ids"]).decode()
        assert r["lossless"] and r["n_pieces"] == len(r["ids"])
        got.append((r["doc_id"], text.removeprefix(" "), r["lang"], r["source"]))
    assert sorted(got) == sorted(row[:4] for row in rows)


def test_rows_of_one_id(spark):
    """Of an id's texts the same one stays in every run."""
    rows = [(1, f"first text number {i} of a document", "en", "a", i) for i in range(6)] + [(2, "another one", "en", "a", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    runs = {tuple(sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n).orderBy(F.rand(n)), "").collect()))) for n in (1, 3, 5)}
    assert len(runs) == 1 and [row[0] for row in runs.pop()] == [1, 2]
