"""Ratios against difflib, and the bounds against plain counting."""

import random
from difflib import SequenceMatcher

import numpy as np

from corvina.functions import ratios


def _changed(rng, text, letters):
    out = list(text)
    for _ in range(rng.randint(0, max(1, len(out) // 4))):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 3)] = rng.choices(letters, k=rng.randint(0, 3))
    return "".join(out)


def test_ratios_are_those_of_difflib():
    rng, kept = random.Random(6), 0
    for n in range(1500):
        letters = rng.choice(["ab", "abcdefg ", "eeeeetttaaoinsrhlducmfw  .,YZQ0123456789é\U0001f600"])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 24, 150, 199, 200, 400, 900])))
        b = _changed(rng, a, letters) if n % 3 else "".join(rng.choices(letters, k=rng.choice([0, 3, 24, 200, 500])))
        want = SequenceMatcher(None, a, b).ratio()
        for least in (0.0, 0.5, 0.7, want):
            assert ratios.ratio_from(a, b, least) == (want if want >= least else None)
        kept += want >= 0.7
    assert 100 < kept < 1500


def test_long_texts():
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinsrhldcumfpgwybvk", k=rng.randint(2, 9))) for _ in range(500)]
    a = " ".join(rng.choices(words, k=1500))
    b = " ".join(w if rng.random() < 0.9 else rng.choice(words) for w in a.split())
    want = SequenceMatcher(None, a, b).ratio()
    assert ratios.ratio_from(a, b, 0.0) == want


def test_subsequences():
    rng = random.Random(8)
    pairs = [("".join(rng.choices("abcé\U0001f600 \0", k=rng.randint(0, 24))), "".join(rng.choices("abcé\U0001f600 \0", k=rng.randint(0, 24)))) for _ in range(300)]
    rows = [np.stack([np.frombuffer(ratios.codes(p[k], 24), "<u4") for p in pairs]) for k in (0, 1)]
    for (a, b), found in zip(pairs, ratios.subsequences(*rows).tolist(), strict=True):
        line = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, x in enumerate(b):
                new.append(line[j] + 1 if c == x else max(line[j + 1], new[j]))
            line = new
        assert found == line[-1] == ratios.subsequence(a, b)


def test_pairs_that_cannot_reach_the_ratio_never_become_rows():
    """Short texts that share a band: only those are compared whose letters in order allow the ratio."""
    import pandas as pd

    from corvina.operators import dedupe, links

    texts = ["abcdefgh", "abcdefgx", "hgfedcba", "xbcdefgh", "12345678", "12345679"]
    rows = [("band", 0, 0, True, True, i, i, b"\0" * 8, ratios.codes(t, 24)) for i, t in enumerate(texts)]
    frame = pd.DataFrame(rows, columns=["band", "left", "right", "is_left", "is_right", "id", "root", "marks", "codes"])
    found = pd.concat(links._meet(0.4, dedupe._may_reach(0.7))(iter([frame])))
    assert sorted(map(tuple, found.to_numpy().tolist())) == [(0, 1), (0, 3), (1, 3), (4, 5)]


def test_lexical_search_asks_for_no_ratio_that_cannot_count(spark):
    """The best of each query are the same with and without the cut at its last one."""
    from corvina.operators import retrieval

    rng = random.Random(9)
    words = ["alpha", "bravo", "carbon", "delta", "engine", "forest", "garden"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(120)]
    entries = spark.createDataFrame([(*r, r[1]) for r in rows], "id long, question string, keywords string")
    queries = spark.createDataFrame(rows[::20], "qid long, text string")
    every = retrieval.lexical_scores(entries, queries)
    some = retrieval.lexical_scores(entries, queries, most=3)
    best = [sorted(map(tuple, retrieval.top_k(x, 3, ["qid"]).select("qid", "id", "rn", "sim").collect())) for x in (every, some)]
    assert best[0] == best[1] and some.count() < every.count()


def test_long_texts_cost_little_more_than_their_length():
    """Texts of whose rare characters each pair once made a step: 10^9 of them here."""
    import time

    rng = random.Random(10)
    a, b = (" ".join("".join(rng.choices("eeeetttaaaoooiiinnnsssrrrhhhlllbcdfgkmpquvwxyz", k=rng.randint(2, 9))) for _ in range(60_000)) for _ in range(2))
    began = time.process_time()
    assert ratios.ratio_from(a, b, 0.7) is None
    assert time.process_time() - began < 20


def test_ratios_of_texts_with_long_runs_of_rare_characters():
    rng = random.Random(11)
    letters = "".join(chr(0x4E00 + k) for k in range(900))
    for n in range(20):
        a = "".join(rng.choices(letters, k=rng.choice([199, 300, 1500])))
        b = _changed(rng, a[n * 7 :] + a[: n * 7] if n % 3 else a, letters)
        want = SequenceMatcher(None, a, b).ratio()
        for least in (0.0, 0.7, want):
            assert ratios.ratio_from(a, b, least) == (want if want >= least else None)


def test_common_letters():
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcé\U0001f600 \0", k=rng.randint(1, 24))) for _ in range(40)]
    codes = np.stack([np.frombuffer(ratios.codes(t, 24), "<u4") for t in texts])
    found = ratios.common_letters(codes[:10], codes).tolist()
    assert found == [[sum(min(a.count(c), b.count(c)) for c in set(a)) for b in texts] for a in texts[:10]]


def test_pairs_of_longer_texts_that_cannot_reach_the_ratio_never_become_rows():
    import pandas as pd

    from corvina.operators import dedupe, links

    texts = ["abcde " * 20, "abcde " * 18, "vwxyz " * 20, "abcde " * 90]
    rows = [("band", 0, 0, True, True, i, i, b"\0" * 8, ratios.letter_counts(t, 64)) for i, t in enumerate(texts)]
    frame = pd.DataFrame(rows, columns=["band", "left", "right", "is_left", "is_right", "id", "root", "marks", "codes"])
    found = pd.concat(links._meet(0.4, dedupe._CountsReach(0.7))(iter([frame])))
    assert sorted(map(tuple, found.to_numpy().tolist())) == [(0, 1)]


def test_lexical_search_asks_once_for_texts_that_are_alike(spark, monkeypatch):
    """Copies of a few texts: the best of each query are those of all pairs, and few pairs are compared."""
    from corvina.operators import retrieval

    rng, compared = random.Random(13), []
    words = ["alpha", "bravo", "carbon", "delta", "engine", "forest", "garden", "harbour"]
    texts = [" ".join(rng.sample(words, k=rng.randint(2, 5))) for _ in range(12)]
    rows = [(i, rng.choice(texts)) for i in range(400)]
    entries = spark.createDataFrame([(*r, r[1]) for r in rows], "id long, question string, keywords string")
    queries = spark.createDataFrame(rows[::10], "qid long, text string")
    plain_spread = retrieval.spread
    monkeypatch.setattr(retrieval, "spread", lambda df, n: compared.append(n) or plain_spread(df, n))
    every = retrieval.lexical_scores(entries, queries)
    some = retrieval.lexical_scores(entries, queries, most=5)
    best = [sorted(map(tuple, retrieval.top_k(x, 5, ["qid"]).select("qid", "id", "rn", "sim").collect())) for x in (every, some)]
    assert best[0] == best[1] and len(best[0]) == 40 * 5
    assert sum(compared) <= 2 * 12 * 12
