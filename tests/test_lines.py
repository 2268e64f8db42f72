"""Lines of documents: judged once, and files read into frames of many."""

from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T
from corvina.operators import extraction
from corvina.sources import docx


def test_lines_are_judged_once_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "What is it?\nIt is the answer to this.\n\nHow?\nno")], "doc_id long, text string").repartition(2)
    pairs = extraction.adjacent_pairs(extraction.paragraphs(docs), 0.2)
    plan = pairs.select("doc_id", "idx", "confidence")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("Window")]
    # each sign occurs as often as the lists have it, below the windows
    assert "RLIKE" not in above and plan.count(L.ANSWER_SIGNS[1]) == 1 and plan.count(L.QUESTION_SIGNS[3]) == 1
    assert sorted((r["idx"], r["question"], r["answer"]) for r in pairs.collect()) == [(0, "What is it?", "It is the answer to this."), (2, "How?", "no")]


def test_likeness_of_odd_lines(spark):
    texts = ["   You  can\tgo ", "the", "You  cannot", "to", "", None, "what now?", " how", "it\x0bis", "yes" * 80, "Answer 1: no", "answer1", "a1.", "Isn't it"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.question_likeness(F.col("t")).alias("q"), T.answer_likeness(F.col("t")).alias("a")).collect()
    for r in got:
        low = (texts[r["i"]] or "").lower().strip()
        first, usual = (low.split() or [""])[0], " ".join(low.split()[:2]).startswith(tuple(L.ANSWER_STARTERS))
        n = len(texts[r["i"]] or "")
        sign = 0.4 * (low.startswith(("answer 1:", "a1.")))
        assert r["a"] == (0.0 if len(low) < 3 else min(1.0, round(sign + 0.2 * (not low.endswith("?")) + 0.2 * (n > 20) + 0.1 * (n > 50) + 0.1 * usual, 6)))
        assert (r["q"] >= 0.24) == (len(low) >= 3 and (first in L.INTERROGATIVES or low.startswith("is")))


def test_many_files_share_a_frame(spark):
    frame = docx._frame([("a", "x", "paragraph", None, None, 0, None, "t", None), ("b", "y", "error", None, None, None, None, None, "bad")])
    assert len(frame) == 2 and str(frame["idx"].dtype) == "Int32"
    texts = [(str(i) + ".docx", f"one {i}\n\x01\n\ttwo\x02 & <{i}>" if i % 7 else None) for i in range(5000)]
    found = docx.read(docx.packed(spark.createDataFrame(texts, "path string, text string").coalesce(1), "path", "text")).collect()
    assert sorted((r["path"], r["idx"], r["text"]) for r in found) == sorted((p, k, t) for p, x in texts if x for k, t in enumerate((x.split("\n")[0], f"two & <{p[:-5]}>")))
