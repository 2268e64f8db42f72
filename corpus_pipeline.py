"""The corpus pipeline: documents to tokens, in stages that each call one training-data operator.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of documents. Rejected and repeated documents go, boilerplate lines go, and
the mix repeats or leaves out documents, before what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import bag_minhash, language_crf, line_dedup, piece_codec, source_mix
from corvina.llm.common import cut_lineage, small_side

#: Least share of a document's words in its language.
LANGUAGE_SHARE = 0.4
#: Units that an encoding worker remembers and draws for at once: fewer than alone, as heaps have grown in the stages before.
REMEMBERED, DRAWN = 100_000, 1 << 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters of which one language has at least LANGUAGE_SHARE of the words."""
    model = language_crf.train(language_crf.language_sample(docs))
    found = docs.select(F.struct("*").alias("row"), language_crf.language_of(F.col("text"), model, docs).alias("found"))
    return found.where((F.col("found.lang_pred") != language_crf.UNKNOWN) & (F.col("found.score") >= LANGUAGE_SHARE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; n_chars is that of the text that stays. A document that its
    source repeats so often that all its lines are boilerplate is left to the near-duplicate stage."""
    cleaned = line_dedup.drop_boilerplate(docs, spare_whole=True)
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else cleaned[c] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates, and of rows with its
    id one. Rows without an id stay."""
    classes = bag_minhash.near_duplicate_classes(docs)
    gone = small_side(cut_lineage(classes.where("doc_id <> class_id").select("doc_id").distinct()))
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = cut_lineage(classes.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        # of rows with one id the same stays in every run
        first = F.min_by(F.struct(*docs.columns), F.struct(F.md5(F.col("text").cast("binary")), F.xxhash64(*docs.columns)))
        one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents, once, twice or not at all, to its target of words."""
    return source_mix.mix_documents(docs, source_mix.plan_mix(source_mix.sized(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids (array of piece ids), n_pieces, lossless."""
    return piece_codec.encode_documents(docs, piece_codec.Codec(docs, remembered=REMEMBERED, drawn=DRAWN), ("doc_id", "source", "lang"), packed=False)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The first stage's model can't be written in SQL; a test compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is materialised before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
