"""Queries that SQL can't state, against plain-Python forms over all rows of the smallest tables."""

import collections
import itertools
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
import regex

from corvina import catalog
from corvina.functions import lexicons as L

DATA = "/root/testdata/sf0.001"
WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+")


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{DATA}/{name}.parquet").collect()]


def split(text):
    return regex.split(r"\s+", text.strip()) if text.strip() else []


def test_language(spark, tables):
    got = {(r["conv_id"], r["turn"]): (r["lang"], pytest.approx(r["confidence"]), r["mixed"]) for r in catalog.QUERIES["t20_language"](spark, DATA).collect()}
    for row in tables("conversations"):
        text = row["text"] or ""
        low, words, scores = text.lower(), WORD.findall(text.lower()), []
        for name, script in L.SCRIPTS.items():
            scores.append((0.8 * len(re.findall(script, text)) / len(text) if text else 0.0, name))
        for name, known in L.LANGUAGES.items():
            score = 0.0
            if words:
                hits = lambda key, words=words, known=known: sum(w in known[key] for w in words) / len(words)
                found = sum(len(regex.findall(p, low)) for p in known["patterns"])
                score = 0.6 * min(1.0, 0.7 * hits("common") + 0.3 * hits("asking") + min(found / len(words), 0.3))
            scores.append((score, name))
        best = max(scores, key=lambda s: s[0])
        want = (best[1], best[0]) if best[0] >= 0.2 else ("en", 0.3)
        lang, confidence, mixed = got[row["conv_id"], row["turn"]]
        assert (lang, mixed) == (want[0], sum(s > 0.2 for s, _ in scores) > 1) and want[1] == confidence


def test_intent(spark, tables):
    got = {(r["conv_id"], r["turn"]): (r["intent"], r["confidence"]) for r in catalog.QUERIES["t23_intent"](spark, DATA).collect()}
    rows = [row for row in tables("conversations") if (row["conv_id"], row["turn"]) in got]
    assert len(rows) == len(got)
    for row in rows:
        text = row["text"] or ""
        low, scores = text.lower(), {}
        kind = next((name for name, p in L.QUESTION_TYPES.items() if regex.search("(?i)" + p, text)), None)
        keys = {w for w in WORD.findall(low) if len(w) > 2 and w not in L.QUERY_STOP}
        for name, seed in L.INTENT_SEEDS.get(kind, {}).items():
            scores[name] = round(10 * seed)
        for name, phrases in L.INTENT_WORDS.items():
            hits = sum(3 + 2 * bool(keys & set(phrase.split())) for phrase in phrases if phrase in low)
            if hits:
                scores[name] = scores.get(name, 0) + min(hits, 10)
        if scores:
            name = max(scores, key=lambda n: scores[n])  # the first of equal ones, seeds before phrases
            want = (name, min(scores[name], 10) / 10)
        else:
            want = ("question", 0.5) if any(w in low for w in ("?", "what", "how", "where", "when", "who", "why")) else ("information", 0.3)
        assert got[row["conv_id"], row["turn"]] == want, text


def test_resolved_pronouns(spark, tables):
    got = {(r["conv_id"], r["turn"]): r["resolved"] for r in catalog.QUERIES["t31_with_context"](spark, DATA).collect()}
    asked = collections.defaultdict(list)
    for row in sorted(tables("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        if row["role"] == "user":
            asked[row["conv_id"]].append(row)
    assert len(got) == sum(map(len, asked.values()))
    for rows in asked.values():
        for i, row in enumerate(rows):
            keys = []
            for earlier in rows[max(0, i - 3) : i]:
                own = list(dict.fromkeys(w for w in WORD.findall(earlier["text"].lower()) if len(w) > 2 and w not in L.QUERY_STOP))[:2]
                keys += [w for w in own if w not in keys]
            text = row["text"]
            if keys:
                first, second = keys[0], (keys + keys[:1])[1] if len(keys) > 1 else keys[0]
                for word, into in (("it", first), ("this", first), ("that", second), ("they", f"{first} and {second}"), ("them", f"{first} and {second}")):
                    text = regex.sub(rf"(?i)\b{word}\b", lambda _, into=into: into, text)
            assert got[row["conv_id"], row["turn"]] == text


def test_diverse(spark, tables):
    got = collections.defaultdict(list)
    for r in sorted(catalog.QUERIES["j17_diverse"](spark, DATA).collect(), key=lambda r: r["rn"]):
        got[r["qid"]].append(r["id"])
    unit = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(np.array(r["embedding"], float)) for r in tables("embeddings")}
    for query in (i for i in unit if i % 50 == 0):
        near = sorted(((float(unit[query] @ v), i) for i, v in unit.items()), key=lambda x: (-x[0], x[1]))
        taken = []
        for _, i in [x for x in near if x[0] >= 0.2][:50]:
            if len(taken) < 5 and all(float(unit[i] @ unit[j]) <= 0.3 for j in taken):
                taken.append(i)
        assert got[query] == taken


def stem(word):
    for suffix in L.SUFFIXES:
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            bare = word[: -len(suffix)]
            return bare + "e" if bare.endswith("at") else bare
    return word


def matcher_keywords(text):
    return {k for w in split(text.lower()) if len(w) > 2 and w not in L.MATCHER_STOP for k in (w, stem(w))}


def test_lexical_search(spark):
    """Every query against every entry."""
    from pyspark.sql import functions as F

    from corvina.functions import text as T
    from corvina.plans.views import entries

    rows = [(r["id"], r["question"], " ".join(r["k"])) for r in entries(spark, DATA).select("id", "question", T.entry_keywords(F.col("question")).alias("k")).collect()]
    wide = lambda words: words | {other for w in words for other in L.SYNONYMS.get(w, [])}
    share = lambda both, a, b: len(both) / len(a | b) if a | b else 0.0
    want = []
    for qid, asked, _ in (row for row in rows if row[0] % 50 == 0):
        form = regex.sub(r"[^\p{L}\p{N}\p{M}_\s']", " ", " ".join(split(asked.lower()))).lower()
        own, found = matcher_keywords(form), []
        for i, question, keywords in rows:
            theirs, keys = matcher_keywords(question), matcher_keywords(keywords)
            every = theirs | keys
            plain = 0.3 * (len(wide(own) & every) / len(wide(own)) if keys and own else 0.0) + 0.4 * share(own & theirs, own, theirs) + 0.2 * share(wide(own) & wide(every), wide(own), wide(every))
            if plain > 0.19 and (score := plain + 0.1 * SequenceMatcher(None, form, question.lower()).ratio()) >= 0.3:
                found.append((-round(score, 12), i))
        want += [(qid, i, rn) for rn, (_, i) in enumerate(sorted(found)[:5], 1)]
    assert sorted((r["qid"], r["id"], r["rn"]) for r in catalog.QUERIES["j04_lexical"](spark, DATA).collect()) == sorted(want)


def test_similar_entries_meet_in_classes(spark):
    """Every pair of different texts of a ratio of 0.70 or more ends in one class."""
    from pyspark.sql import functions as F

    from corvina.functions import text as T
    from corvina.plans.views import entries

    form = lambda c: T.squeeze(F.lower(F.coalesce(F.col(c), F.lit("")))).alias(c)
    rows = entries(spark, DATA).select("id", form("question"), form("answer")).collect()
    classes = {r["id"]: r["class_id"] for r in catalog.QUERIES["j13_similar_questions"](spark, DATA).collect()}
    n = 0
    for part in ("question", "answer"):
        texts = {r[part]: r["id"] for r in rows if r[part]}
        for (a, i), (b, j) in itertools.combinations(texts.items(), 2):
            matcher = SequenceMatcher(None, a, b)
            if matcher.real_quick_ratio() >= 0.7 and matcher.quick_ratio() >= 0.7 and matcher.ratio() >= 0.7:
                n += 1
                assert classes[i] == classes[j]
    assert n > 5
