"""Retrieval: vector, n-gram and lexical search, re-ranking, and the cascade over them.

A search takes a stated set of queries against all entries. Vectors meet in pairs of blocks, n-grams and
keywords by equi-joins on them; neither needs the query set to be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import ratios
from corvina.functions import text as T
from corvina.functions import vectors as V
from corvina.session import cut_lineage, spread

#: Rows of a block of vectors; two blocks are scored at once.
BLOCK = 1024
#: Query blocks up to which all of them are broadcast to the entries' blocks.
BROADCAST_BLOCKS = 16
#: Bins of letters that texts' characters are counted in.
BINS = 32
#: Bytes of an Arrow batch of pairs of blocks.
BATCH_BYTES = 64 << 20


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "sim", tie: str = "id") -> DataFrame:
    """The k rows with the highest score of each group, ties to the smaller ``tie``, with rank rn.
    Spark cuts each map task's groups to k before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie)))
    return scored.withColumn("rn", place).where(F.col("rn") <= k)


def _blocks(rows: DataFrame, names: tuple[str, str, str]) -> tuple[DataFrame, int]:
    """Rows with a usable vector in blocks of one dimension, about BLOCK in each: the dimension, the rows
    without their vectors, and all vectors one after another. And the number of blocks to expect."""
    dim, packed, flat = names
    rows = rows.withColumn("embedding", V.doubles(F.col("embedding"))).where(V.usable(F.col("embedding")))
    parts = max(1, -(-rows.count() // BLOCK))
    others = F.struct(*[c for c in rows.columns if c != "embedding"])
    placed = rows.select(F.size("embedding").alias(dim), others.alias("row"), "embedding", F.pmod(F.xxhash64("embedding"), F.lit(parts)).alias("part"))
    # a block of many equal vectors is cut by the rows' own hashes
    placed = placed.withColumn("part", F.pmod(F.xxhash64("part", F.hash("row")), F.lit(parts)))
    both = placed.groupBy(dim, "part").agg(F.collect_list(F.struct("row", "embedding")).alias("b"))
    return both.select(dim, F.col("b.row").alias(packed), F.flatten("b.embedding").alias(flat)), parts


def _cosines(threshold: float, most: int | None, slack: float = 0.0):
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for e_dim, left, q_dim, right in zip(*batch, strict=True):
                if e_dim != q_dim:
                    found.append((np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)))
                    continue
                e, q = left.reshape(-1, e_dim), right.reshape(-1, q_dim)
                # components are added in order, so equal vectors score alike wherever they stand
                sim, e_norm, q_norm = np.zeros((len(e), len(q))), np.zeros(len(e)), np.zeros(len(q))
                for d in range(e_dim):
                    sim += e[:, d, None] * q[None, :, d]
                    e_norm += e[:, d] * e[:, d]
                    q_norm += q[:, d] * q[:, d]
                sim = np.clip(sim / (np.sqrt(e_norm)[:, None] * np.sqrt(q_norm)[None, :]), -1, 1)
                keep = sim >= threshold
                if most is not None and len(e) > most:
                    keep &= sim >= np.partition(sim, len(e) - most, axis=0)[len(e) - most] - slack
                i, j = np.nonzero(keep)
                found.append((i.astype(np.int32), j.astype(np.int32), sim[i, j]))
            yield pd.DataFrame(found, columns=["i", "j", "sim"])

    return score


def vector_scores(entries: DataFrame, queries: DataFrame, threshold: float, most: int | None = None, slack: float = 0.0) -> DataFrame:
    """qid, the entry's columns and sim, where the cosine is at least the threshold. ``queries``: qid,
    embedding. With ``most`` given, only rows that can be among a query's ``most`` best are passed on, if what
    they are ranked by differs from the cosine by no more than ``slack`` in all.

    Entries and queries are packed into blocks, and each pair of blocks is scored in numpy, in double
    precision: the work is all pairs of the stated queries, the rows that leave a task are hits.
    Vectors that aren't usable, or of another dimension than the query's, match nothing.
    """
    session = entries.sparkSession
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    e, _ = _blocks(entries, ("e_dim", "e_rows", "e_flat"))
    q, parts = _blocks(queries.select("qid", "embedding"), ("q_dim", "q_rows", "q_flat"))
    pairs = e.crossJoin(F.broadcast(q) if parts <= BROADCAST_BLOCKS else q)
    hits = F.pandas_udf(_cosines(threshold, most, slack), "i array<int>, j array<int>, sim array<double>")("e_dim", "e_flat", "q_dim", "q_flat")
    pairs = pairs.select("e_rows", "q_rows", hits.alias("h"))
    named = F.transform(F.arrays_zip("h.i", "h.j", "h.sim"), lambda h: F.struct(F.get("q_rows", h["j"])["qid"].alias("qid"), F.get("e_rows", h["i"]).alias("row"), h["sim"].alias("sim")))
    return pairs.select(F.explode(named).alias("p")).select("p.qid", "p.row.*", "p.sim")


def _cell_blocks(rows: DataFrame, row: str, names: tuple[str, str, str]) -> DataFrame:
    """Rows (``row``, embedding, cell) packed by cell, about BLOCK in a block."""
    dim, packed, flat = names
    # a row for each cell, of which an index has a bounded number
    counts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    placed = rows.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64(row), F.col("parts")))
    both = placed.groupBy("cell", "part").agg(F.collect_list(F.struct(F.col(row), "embedding")).alias("b"))
    return both.select("cell", F.size(F.col("b.embedding")[0]).alias(dim), F.col(f"b.{row}").alias(packed), F.flatten("b.embedding").alias(flat))


def cell_scores(entries: DataFrame, queries: DataFrame, threshold: float, most: int) -> DataFrame:
    """qid, id, sim, where the cosine is at least the threshold, of entries (id, embedding, cell) and queries
    (qid, embedding, cell) that share a cell: of each block the ``most`` best rows of each query."""
    entries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    e = _cell_blocks(entries, "id", ("e_dim", "e_rows", "e_flat"))
    q = _cell_blocks(queries, "qid", ("q_dim", "q_rows", "q_flat"))
    hits = F.pandas_udf(_cosines(threshold, most), "i array<int>, j array<int>, sim array<double>")("e_dim", "e_flat", "q_dim", "q_flat")
    pairs = e.join(q, "cell").select("e_rows", "q_rows", hits.alias("h"))
    named = F.transform(F.arrays_zip("h.i", "h.j", "h.sim"), lambda h: F.struct(F.get("q_rows", h["j"]).alias("qid"), F.get("e_rows", h["i"]).alias("id"), h["sim"].alias("sim")))
    return pairs.select(F.explode(named).alias("p")).select("p.*")


def similarity_counts(entries: DataFrame, queries: DataFrame, threshold: float, above: float) -> DataFrame:
    """qid, n (entries whose cosine is at least the threshold), n_above, best_id (ties: the smaller id), for queries
    that any entry reaches. Pairs are counted inside their blocks: a row for each query and pair of blocks leaves a task."""
    session = entries.sparkSession
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    e, _ = _blocks(entries.select("id", "embedding"), ("e_dim", "e_rows", "e_flat"))
    q, parts = _blocks(queries.select("qid", "embedding"), ("q_dim", "q_rows", "q_flat"))
    pairs = e.crossJoin(F.broadcast(q) if parts <= BROADCAST_BLOCKS else q)
    scores = _cosines(threshold, None)

    def count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ids, qids, *rest in batches:
            out = []
            for own, asked, found in zip(ids, qids, next(scores(iter([tuple(rest)]))).itertuples(index=False), strict=True):
                own, rows = np.asarray(own), []
                for j in np.unique(found.j).tolist():
                    at = found.j == j
                    sim, entry = found.sim[at], own[found.i[at]]
                    best = np.lexsort((entry, -sim))[0]
                    rows.append({"qid": int(asked[j]), "n": int(at.sum()), "n_above": int((sim >= above).sum()), "sim": float(sim[best]), "id": int(entry[best])})
                out.append(rows)
            yield pd.Series(out, dtype=object)

    counted = F.pandas_udf(count, "array<struct<qid:bigint,n:bigint,n_above:bigint,sim:double,id:bigint>>")
    found = pairs.select(F.explode(counted(F.col("e_rows.id"), F.col("q_rows.qid"), "e_dim", "e_flat", "q_dim", "q_flat")).alias("c")).select("c.*")
    return found.groupBy("qid").agg(F.sum("n").alias("n"), F.sum("n_above").alias("n_above"), F.max_by("id", F.struct("sim", -F.col("id"))).alias("best_id"))


def filtered(scored: DataFrame, keep: Column, k: int, over_fetch: int = 5) -> DataFrame:
    """The first k of the best over_fetch * k rows of each query that pass ``keep``: rows behind those
    are not considered, even if fewer than k pass."""
    return top_k(top_k(scored, over_fetch * k, ["qid"]).where(keep), k, ["qid"])


def boosted(scored: DataFrame, recent: Column, confident: Column, k: int) -> DataFrame:
    """The best 2k rows of each query, ranked again with 1.1 for recent and 1.05 for confident ones."""
    near = top_k(scored, 2 * k, ["qid"])
    factor = F.when(recent, 1.1).otherwise(1.0) * F.when(confident, 1.05).otherwise(1.0)
    return top_k(near.withColumn("boosted", F.col("sim") * factor), k, ["qid"], "boosted")


def relevance(sim: Column, confidence: Column, age_days: Column) -> Column:
    recency = F.when(age_days <= 30, 1.0).when(age_days <= 90, 0.8).when(age_days <= 180, 0.6).otherwise(0.4)
    return 0.7 * sim + 0.2 * F.least(confidence, F.lit(1.0)) + 0.1 * recency


#: Rows up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 100_000


def _small(rows: DataFrame) -> DataFrame:
    """Materialised ``rows``, with a broadcast hint if they were counted to be few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _grams(entries: DataFrame, shortest: int) -> DataFrame:
    """id, gram: every n-gram of ``shortest`` to three words, as often as it comes. Words are put beside the next
    two, which keeps the work inside generated code."""
    w = F.col("w")
    rows = entries.select("id", T.plain_words(F.col("text")).alias("w"))
    rows = rows.select("id", F.explode(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"), F.slice(w, 3, F.size(w)).alias("c"))).alias("z"))
    written = [F.concat(F.lit("{"), *[x for c in "abc"[:n] for x in (F.lit(","), F.col(f"z.{c}"))][1:], F.lit("}")) for n in range(shortest, 4)]
    gram = written[0] if len(written) == 1 else F.explode(F.array_compact(F.array(*written)))
    return rows.select("id", gram.alias("gram")).where("gram is not null")


def ngram_matches(entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """qid, id, shared, n_query, share: entries that hold at least that share of a query's n-grams.

    Of a query's n-grams an entry may lack a few; one more than those, the longest, are enough to find all
    entries by: each has one of them at least. Entries are cut into n-grams of these lengths only, as a
    rule into triples, and meet them in an equi-join; what met is looked through for the others."""
    words = lambda gram: F.size(F.split(gram, ","))
    q = queries.select("qid", T.ngrams(F.col("text")).alias("grams")).where(F.size("grams") > 0).withColumn("n_query", F.size("grams"))
    longest = F.array_sort("grams", lambda x, y: F.when(words(x) != words(y), words(y) - words(x)).when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    lacking = F.floor((1.0 - threshold) * F.col("n_query") + 1e-9).cast("int")
    sought = cut_lineage(q.select("qid", F.explode(F.slice(longest, 1, lacking + 1)).alias("gram")))
    shortest = sought.agg(F.min(words(F.col("gram")))).first()[0] or 3
    e = _grams(entries, shortest)
    met = cut_lineage(e.join(_small(sought), "gram").select("qid", "id").distinct())
    # a text is written once for all its n-grams, with a blank around each word
    texts = entries.join(_small(met), "id").select("qid", "id", F.concat(F.lit(" "), F.array_join(T.plain_words(F.col("text")), " "), F.lit(" ")).alias("plain"))
    held = F.filter("grams", lambda gram: F.contains(F.col("plain"), F.translate(gram, "{,}", "   ")))
    out = texts.join(_small(cut_lineage(q)), "qid").select("qid", "id", F.size(held).cast("long").alias("shared"), "n_query")
    return out.withColumn("share", F.col("shared") / F.col("n_query")).where(F.col("share") >= threshold)


def lexical_scores(entries: DataFrame, queries: DataFrame, threshold: float = 0.3, most: int | None = None) -> DataFrame:
    """qid, id, plain, sim: 0.3 keyword share + 0.4 question overlap + 0.2 overlap with synonyms, over
    the entries' question and keywords, plus 0.1 character ratio by ``sequence_ratio`` where that can
    still decide: pairs that can't reach the threshold with a full ratio are left out before it.

    A score without the ratio needs a common word, so pairs come from an equi-join on words; sums over
    a pair's common words give all three overlaps, without either side's word lists. Queries, and entries, that are
    alike are one row until their pairs have a score.

    With ``most``, pairs that can't be among a query's best so many are left out too: those that stay below
    the score of so many others even with the largest ratio that their letters allow.
    """
    q = _alike(queries.withColumn("q_text", F.lower(T.matcher_form(F.col("text")))), "qid", ["q_text"], "query")
    q = cut_lineage(q.withColumn("own", T.matcher_keywords(F.col("q_text"))).withColumn("wide", T.expand_synonyms(F.col("own"))))
    e = _alike(entries, "id", ["question", "keywords"], "entry", most).withColumn("e_text", F.lower("question"))
    e = e.withColumn("own", T.matcher_keywords(F.col("question"))).withColumn("keys", T.matcher_keywords(F.col("keywords")))
    e = cut_lineage(e.drop("question", "keywords").withColumn("every", F.array_union("own", "keys")).withColumn("wide", T.expand_synonyms(F.col("every"))))
    has = lambda words: F.array_contains(words, F.col("word")).cast("int")
    q_words = q.select("query", F.size("own").alias("nq_own"), F.size("wide").alias("nq_wide"), "own", F.explode("wide").alias("word")).select("query", "nq_own", "nq_wide", "word", has("own").alias("q_own"))
    e_words = e.select("entry", F.size("own").alias("ne_own"), F.size("wide").alias("ne_wide"), F.size("keys").alias("ne_keys"), "own", "every", F.explode("wide").alias("word"))
    e_words = e_words.select("entry", "ne_own", "ne_wide", "ne_keys", "word", has("own").alias("e_own"), has("every").alias("e_every"))
    sizes = ["nq_own", "nq_wide", "ne_own", "ne_wide", "ne_keys"]
    common = q_words.join(e_words, "word").groupBy("query", "entry", *sizes).agg(F.sum("e_every").alias("every"), F.sum(F.col("q_own") * F.col("e_own")).alias("own"), F.count("*").alias("wide"))
    share = F.when(F.col("ne_keys") == 0, 0.0).otherwise(F.col("every") / F.col("nq_wide"))
    overlap = lambda both, a, b: F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(both) / (F.col(a) + F.col(b) - F.col(both)))
    plain = 0.3 * share + 0.4 * overlap("own", "nq_own", "ne_own") + 0.2 * overlap("wide", "nq_wide", "ne_wide")
    pairs = common.withColumn("plain", plain).where(F.col("plain") >= threshold - 0.1).select("query", "entry", "plain").withColumn("needed", F.lit(threshold))
    texts = lambda of: of.join(q.select("query", "q_text"), "query").join(e.select("entry", "e_text"), "entry")
    if most is not None:
        pairs = _worth_a_ratio(cut_lineage(pairs), q.select("query", "q_text"), e.select("entry", "e_text", F.size("ids").alias("n")), most)
    scored = _with_ratio(texts(pairs) if most is None else spread(texts(pairs), pairs.count()), threshold)
    scored = scored.join(q.select("query", F.explode("ids").alias("qid")), "query").join(e.select("entry", F.explode("ids").alias("id")), "entry")
    return scored.select("qid", "id", "plain", "sim")


def _alike(rows: DataFrame, key: str, texts: list[str], name: str, most: int | None = None) -> DataFrame:
    """A row with a number of its own for rows that are alike in ``texts``; ids: the ``most`` smallest of their keys, or all."""
    rows = rows.where(F.col(key).isNotNull()).select(key, *texts)
    if most is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*texts).orderBy(key))).where(F.col("place") <= most)
    return rows.groupBy(*texts).agg(F.collect_list(key).alias("ids")).withColumn(name, F.monotonically_increasing_id())


def _with_ratio(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (plain, needed, q_text, e_text) with sim, where that is the threshold or more; one below ``needed`` may be left out."""
    ratio = sequence_ratio(F.col("q_text"), F.col("e_text"), (F.col("needed") - F.col("plain") - 1e-9) / 0.1)
    return pairs.withColumn("sim", F.col("plain") + 0.1 * ratio).where(F.col("sim") >= threshold).drop("q_text", "e_text")


def _worth_a_ratio(pairs: DataFrame, q: DataFrame, e: DataFrame, most: int) -> DataFrame:
    """Pairs (query, entry, plain, needed) but those that can't be among a query's best, whatever their order; of an entry
    n count. First the score without a ratio of the best tells what is needed, then the scores of those that may be best."""
    pairs = cut_lineage(_needed(pairs.join(e.select("entry", "n"), "entry"), "plain", most, 0.1))
    counted = [of.select(of.columns[0], F.pandas_udf(_letters, "binary")(of.columns[1]).alias(side)) for of, side in ((q, "left"), (e, "right"))]
    bound = F.col("plain") + 0.1 * F.pandas_udf(_most_ratio, "double")("left", "right")
    pairs = pairs.join(cut_lineage(counted[0]), "query").join(cut_lineage(counted[1]), "entry").withColumn("bound", bound).drop("left", "right")
    pairs = cut_lineage(pairs.where(F.col("bound") >= F.col("needed") - 1e-9))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "entry"))
    first = cut_lineage(pairs.withColumn("place", place).where(F.col("place") <= 2 * most).drop("place"))
    first = spread(first.join(q, "query").join(e.select("entry", "e_text"), "entry"), first.count())
    best = cut_lineage(_with_ratio(first, 0.0).select("query", "entry", "n", "sim"))
    needed = _last(best, "sim", most)
    pairs = pairs.join(needed, "query", "left").withColumn("needed", F.greatest("needed", "last"))
    return cut_lineage(pairs.where(F.col("bound") >= F.col("needed") - 1e-9).select("query", "entry", "plain", "needed"))


def _last(pairs: DataFrame, score: str, most: int) -> DataFrame:
    """query, last: the score of the last of a query's best ``most``; none for a query that has fewer."""
    by = Window.partitionBy("query").orderBy(F.desc(score), "entry")
    best = pairs.select("query", "entry", "n", score, F.row_number().over(by).alias("place")).where(F.col("place") <= most)
    best = best.withColumn("so_many", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return best.where(F.col("so_many") >= most).groupBy("query").agg(F.max(score).alias("last"))


def _needed(pairs: DataFrame, score: str, most: int, slack: float) -> DataFrame:
    """Pairs but those that lie more than ``slack`` below the last of a query's best; that score is needed of the others."""
    # sums of doubles: a margin far above their error
    pairs = pairs.join(_last(pairs, score, most), "query", "left").withColumn("needed", F.greatest("needed", "last")).drop("last")
    return pairs.where(F.col(score) >= F.col("needed") - slack - 1e-9)


def _letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: ratios.letter_counts(text or "", BINS))


def _most_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The most that the ratio of two texts can be by their numbers of letters."""
    counts = [np.frombuffer(b"".join(side), "<u4").reshape(-1, BINS).astype(np.int64) for side in (left, right)]
    total = counts[0].sum(axis=1) + counts[1].sum(axis=1)
    return pd.Series(np.where(total > 0, 2.0 * np.minimum(*counts).sum(axis=1) / np.maximum(total, 1), 1.0))


def sequence_ratio(a: Column, b: Column, least: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts, as difflib has it, or null if it is below ``least``; no built-in
    function gives it."""

    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right, bound in batches:
            yield pd.Series([ratios.ratio_from(x or "", y or "", z) for x, y, z in zip(left, right, bound, strict=True)], dtype="float64")

    # so called, it isn't asked again by a filter that is pushed below the shuffle of its pairs
    return F.pandas_udf(found, "double").asNondeterministic()(a, b, least)


def diverse(candidates: DataFrame, limit: float = 0.8, k: int = 5) -> DataFrame:
    """qid, id, sim, rn: walking down a query's candidates (qid, id, sim, embedding), one is taken if
    its cosine to all taken ones is at most ``limit``, until k are. Give it candidates that `top_k`
    has cut: a query's candidates meet in one task."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sim", "id"], ascending=[False, True])
        matrix = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        taken: list[int] = []
        for i in range(len(matrix)):
            if len(taken) < k and (not taken or (matrix[taken] @ matrix[i]).max() <= limit):
                taken.append(i)
        out = rows.iloc[taken][["qid", "id", "sim"]]
        return out.assign(rn=np.arange(1, len(out) + 1, dtype=np.int32))

    return candidates.select("qid", "id", "sim", "embedding").groupBy("qid").applyInPandas(choose, "qid long, id long, sim double, rn int")


def cascade(stages: list[DataFrame]) -> DataFrame:
    """qid, id, sim, stage: for each query the rows of the first stage that found any."""
    tagged = [stage.select("qid", "id", F.col("sim").cast("double").alias("sim"), F.lit(i).alias("stage")) for i, stage in enumerate(stages, 1)]
    union = tagged[0]
    for one in tagged[1:]:
        union = union.unionByName(one)
    first = union.groupBy("qid").agg(F.min("stage").alias("stage"))
    return union.join(first, ["qid", "stage"]).select("qid", "id", "sim", "stage")


def overlap_class(retrieved: DataFrame) -> DataFrame:
    """qid, n_pairs, mean_overlap, overlap: mean Jaccard of word sets over the pairs of each query's
    retrieved rows (qid, id, words), at most k of them by construction of the retrieval."""
    other = retrieved.select("qid", F.col("id").alias("id2"), F.col("words").alias("words2"))
    pairs = retrieved.join(other, "qid").where("id < id2")
    means = pairs.withColumn("j", T.jaccard(F.col("words"), F.col("words2"))).groupBy("qid").agg(F.count("*").alias("n_pairs"), F.avg("j").alias("mean_overlap"))
    return means.withColumn("overlap", F.when(F.col("mean_overlap") > 0.7, "high").when(F.col("mean_overlap") > 0.4, "medium").otherwise("low"))
