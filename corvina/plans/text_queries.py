"""Text functions and extraction over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T
from corvina.functions import understanding as N
from corvina.functions import vectors as V
from corvina.operators import dedupe, extraction, typos
from corvina.plans.views import ENTRIES_SQL, entries, quoted, rewritten_sql
from corvina.registry import register
from corvina.session import table

_W = r"\p{L}\p{N}\p{M}_"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source")


@register("t01_clean", rf"SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^{_W}\s.?!,;:\-()]', '', 'g') AS cleaned FROM documents")
def clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@register("t03_sentences", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS n_sentences FROM documents")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_STARTERS = "'" + "', '".join(L.QUESTION_STARTERS) + "'"


@register("t05_features", rf"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM documents)
SELECT doc_id, length(text) AS n_chars, len(words) AS n_words, CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS word_chars, contains(text, '?') OR coalesce(lower(words[1]) IN ({_STARTERS}), false) AS asked FROM w""")
def features(spark: SparkSession, d: str) -> DataFrame:
    own = T.words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(own).cast("long").alias("n_words"), F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"), T.looks_asked(F.col("text")).alias("asked"))


_NGRAMS = rf"""list_distinct(list_concat(list_concat(list_transform(w, lambda x: '{{' || x || '}}'), list_transform(range(1, len(w)), lambda i: '{{' || w[i] || ',' || w[i + 1] || '}}')), list_transform(range(1, len(w) - 1), lambda i: '{{' || w[i] || ',' || w[i + 1] || ',' || w[i + 2] || '}}')))"""
_PLAIN = rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^{_W}\s]', '', 'g'), '\s+'), lambda x: x <> '')"


@register("t06_ngrams", f"WITH p AS (SELECT item_id, {_PLAIN} AS w FROM benchmark) SELECT item_id, unnest({_NGRAMS}) AS gram FROM p")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(T.ngrams(F.col("text"))).alias("gram"))


@register("t08_matcher_form", rf"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^{_W}\s'']', ' ', 'g')) AS digest FROM documents")
def matcher_form(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.matcher_form(F.col("text")).cast("binary")).alias("digest"))


@register("t16_tokens", rf"SELECT doc_id, len(regexp_extract_all(lower(text), '[{_W}]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[{_W}]+'))) AS n_distinct FROM documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_distinct"))


_STOP = "'" + "', '".join(L.QUERY_STOP) + "'"


@register("t25_keywords", rf"SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[{_W}]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))) AS n_keywords FROM conversations")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.query_keywords(F.col("text"))).cast("long").alias("n_keywords"))


@register("t12_positional", "SELECT c_custkey, CASE WHEN length(c_name) = 0 THEN 0 ELSE list_sum(list_transform(range(1, 1 + least(length(c_name), length(c_mktsegment))), lambda i: CASE WHEN c_name[i] = c_mktsegment[i] THEN 1 ELSE 0 END)) / CAST(greatest(length(c_name), length(c_mktsegment)) AS DOUBLE) END AS sim FROM customer")
def positional(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.positional_similarity(F.col("c_name"), F.col("c_mktsegment")).alias("sim"))


@register("t23_intent")
def intent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", T.question_type(F.lower("text")).alias("question_type"), T.intent_of(F.col("text")).alias("i")).select("conv_id", "turn", "question_type", "i.*")


@register("t24_entities", r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b'))) AS n_phones, len(list_distinct(regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'))) AS n_dates FROM documents""")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    each = lambda p: F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long")
    return _docs(spark, d).select("doc_id", each(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b").alias("n_phones"), each(r"\b\d{4}-\d{2}-\d{2}\b").alias("n_dates"))


@register("t17_fix_typos")
def fix_typos(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary is that of the documents: the store's own words."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    fixed = typos.fix_texts(rows, typos.dictionary(_docs(spark, d)))
    return typos.with_confidence(fixed, "text", "fixed").drop("text")


def _unknown_words(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The words of user queries that the store's own words lack, and those."""
    known = typos.dictionary(_docs(spark, d))
    words = table(spark, d, "conversations").where("role = 'user'").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.join(spark.createDataFrame([(word,) for word in known], "word string"), "word", "left_anti"), known


@register("j20_similar_words")
def similar_words(spark: SparkSession, d: str) -> DataFrame:
    return typos.similar_words(*_unknown_words(spark, d))


_FRAGMENT = rf"CASE WHEN regexp_matches(t, '[.?!]$') THEN t WHEN lower(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')[1]) IN ({quoted(L.FRAGMENT_QUESTIONS)}) THEN t || '?' ELSE t || '.' END"


@register("t13_formal_grammar", rf"""WITH g AS (SELECT conv_id, turn, {rewritten_sql('trim(text)', L.INFORMAL)} AS t FROM conversations WHERE role = 'user'), m AS (SELECT conv_id, turn, {_FRAGMENT} AS t FROM g)
SELECT conv_id, turn, trim(regexp_replace(upper(substr(t, 1, 1)) || substr(t, 2), '\s+', ' ', 'g')) AS text FROM m""")
def formal_grammar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.formal_grammar(F.col("text")).alias("text"))


@register("t39_content_hash", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def _hits_sql(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words)


_CATEGORY = "CASE " + " ".join(f"WHEN n{i} = top AND top > 0 THEN '{name}'" for i, name in enumerate(L.CATEGORIES)) + " ELSE 'general' END"
_SCORES = ", ".join(f"{_hits_sql(words)} AS n{i}" for i, words in enumerate(L.CATEGORIES.values()))


@register("t40_category", f"WITH l AS (SELECT doc_id, lower(text) AS low FROM documents), s AS (SELECT doc_id, {_SCORES} FROM l), m AS (SELECT *, greatest({', '.join(f'n{i}' for i in range(len(L.CATEGORIES)))}) AS top FROM s) SELECT doc_id, {_CATEGORY} AS category FROM m")
def category(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.category_of(F.col("text"), F.lit("")).alias("category"))


def _any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _case_sql(rules: list[tuple[str, str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql(column, words)} THEN '{name}'" for name, column, words in rules) + f" ELSE '{default}' END"


@register(
    "t37_metadata",
    f"WITH {ENTRIES_SQL}, l AS (SELECT id, lower(concat_ws(' ', category, question, answer)) AS around, lower(question) AS asked FROM entries) SELECT id, "
    + _case_sql([(n, "around", w) for n, w in L.AUDIENCES.items()], "any") + " AS audience, "
    + _case_sql([(n, "asked" if only else "around", w) for n, w, only in L.ENTRY_INTENTS], "information") + " AS intent, "
    + _case_sql([(n, "around", w) for n, w in L.CONDITIONS.items()], "default") + " AS condition FROM l",
)
def metadata(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", T.entry_metadata(F.col("question"), F.col("answer"), F.col("category")).alias("m")).select("id", "m.audience", "m.intent", "m.condition")


@register("t43_composite_key", f"WITH {ENTRIES_SQL} SELECT id, lower(trim(audience)) || '::' || lower(trim(category)) || '::' || lower(trim(intent)) || '::' || lower(trim(condition)) AS composite_key FROM entries")
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", T.composite_key(F.col("audience"), F.col("category"), F.col("intent"), F.col("condition")).alias("composite_key"))


_LINES = r"""lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS idx, text FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS text FROM documents) WHERE text <> '')"""
_HEADER = r"((text = upper(text) AND lower(text) <> upper(text) AND length(text) > 3) OR (ends_with(text, ':') AND length(text) < 100) OR (regexp_matches(text, '^[0-9]+\.\s+\p{Lu}') AND length(text) < 100))"


@register("src03_paragraphs", f"WITH {_LINES} SELECT doc_id, idx, text FROM lines")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return extraction.paragraphs(_docs(spark, d))


@register("src05_structure", rf"WITH {_LINES} SELECT doc_id, idx, {_HEADER} AS is_header, regexp_matches(text, '^[•\-*]\s+') OR regexp_matches(text, '^[0-9]+[.)]\s+') AS is_item, CAST(sum(CASE WHEN {_HEADER} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS section FROM lines")
def structure(spark: SparkSession, d: str) -> DataFrame:
    return extraction.structure(extraction.paragraphs(_docs(spark, d))).drop("text")


@register("j14_sections", f"WITH {_LINES}, s AS (SELECT doc_id, idx, CAST(sum(CASE WHEN {_HEADER} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS section FROM lines) SELECT doc_id, idx, section FROM s")
def sections(spark: SparkSession, d: str) -> DataFrame:
    lines = extraction.paragraphs(_docs(spark, d))
    return extraction.place_in_sections(lines.select("doc_id", "idx"), lines)


_QUESTION = "CASE WHEN length(trim(t)) < 3 THEN 0 ELSE least((3 * (CAST(ends_with(lower(trim(t)), '?') AS INT) + CAST(regexp_matches(lower(trim(t)), '^(what|how|when|where|why|who|which|can|could|would|should|is|are|do|does|did)') AS INT) + CAST(regexp_matches(lower(trim(t)), '^(q[0-9]*|question\\s*[0-9]*|faq\\s*[0-9]*|query\\s*[0-9]*)[:.]') AS INT) + CAST(regexp_matches(lower(trim(t)), '^[0-9]+[\\x{FE0F}\\x{20E3}]*[:.\\-\\s]+') AS INT)) + CASE WHEN ends_with(lower(trim(t)), '?') THEN 4 ELSE 0 END + CASE WHEN regexp_extract(lower(trim(t)), '^\\S+') IN ('what','how','when','where','why','who','which','can','could','would','should') THEN 3 ELSE 0 END) * 100 * (CASE WHEN length(t) > 200 THEN 7 ELSE 10 END) * (CASE WHEN length(t) < 10 THEN 8 ELSE 10 END) / CAST(100000 AS DOUBLE), 1) END"


@register("t34_question_likeness", f"WITH {ENTRIES_SQL}, q AS (SELECT id, question AS t FROM entries) SELECT id, {_QUESTION} AS likeness FROM q")
def question_likeness(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", T.question_likeness(F.col("question")).alias("likeness"))


_LIKE_ANSWER = "CASE WHEN length(trim(a)) < 3 THEN 0 ELSE least((" + " + ".join(f"4 * CAST(regexp_matches(lower(trim(a)), '{sign}') AS INT)" for sign in L.ANSWER_SIGNS) + " + CASE WHEN ends_with(lower(trim(a)), '?') THEN 0 ELSE 2 END + CASE WHEN length(a) > 20 THEN 2 ELSE 0 END + CASE WHEN length(a) > 50 THEN 1 ELSE 0 END + CASE WHEN " + " OR ".join(f"starts_with(array_to_string(list_filter(string_split_regex(lower(trim(a)), '\\s+'), lambda w: w <> '')[1:2], ' '), '{start}')" for start in L.ANSWER_STARTERS) + " THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE), 1) END"


@register("j15_adjacent_pairs", f"""WITH {_LINES}, n AS (SELECT doc_id, idx, text AS t, lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS a FROM lines),
l AS (SELECT doc_id, idx, CAST({_QUESTION} AS DOUBLE) AS ask, CASE WHEN a IS NOT NULL THEN (CAST({_QUESTION} AS DOUBLE) + CAST({_LIKE_ANSWER} AS DOUBLE)) / 2 END AS confidence FROM n),
o AS (SELECT *, coalesce(ask >= 0.2 AND confidence >= 0.2, false) AS ok FROM l), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY idx) AS nth FROM r WHERE ok) SELECT doc_id, idx, confidence FROM p WHERE nth % 2 = 1""")
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return extraction.adjacent_pairs(extraction.paragraphs(_docs(spark, d)), 0.2).select("doc_id", "idx", "confidence")


@register("src09_question_blocks", rf"""WITH {_LINES}, b AS (SELECT *, regexp_matches(lower(text), '^(the|is|are)\b') AS q, sum(CASE WHEN regexp_matches(lower(text), '^(the|is|are)\b') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS block FROM lines)
SELECT doc_id, CAST(block AS BIGINT) AS block, regexp_replace(max(text) FILTER (q), '^q\s*[:.]\s*', '', 'i') AS question, coalesce(string_agg(regexp_replace(text, '^a\s*[:.]\s*', '', 'i'), chr(10) ORDER BY idx) FILTER (NOT q), '') AS answer FROM b WHERE block > 0 GROUP BY doc_id, block""")
def question_blocks(spark: SparkSession, d: str) -> DataFrame:
    # the documents hold no question marks: lines that begin with a function word stand for questions
    lines = extraction.paragraphs(_docs(spark, d))
    return extraction.question_blocks(lines, F.lower("text").rlike(r"^(the|is|are)\b"))


@register("src04_table_cells", r"""WITH t AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS table_idx, unnest(x) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?is)<table(?:\s[^>]*)?>(.*?)</table>', 1) AS x FROM pages)),
r AS (SELECT page_id, table_idx, generate_subscripts(x, 1) - 1 AS row_idx, unnest(x) AS r FROM (SELECT page_id, table_idx, regexp_extract_all(t, '(?is)<tr(?:\s[^>]*)?>(.*?)</tr>', 1) AS x FROM t)),
c AS (SELECT page_id, table_idx, row_idx, generate_subscripts(x, 1) - 1 AS cell_idx, unnest(x) AS c FROM (SELECT page_id, table_idx, row_idx, regexp_extract_all(r, '(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>', 1) AS x FROM r))
SELECT page_id, CAST(table_idx AS INT) AS table_idx, CAST(row_idx AS INT) AS row_idx, CAST(cell_idx AS INT) AS cell_idx, trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM c""")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return extraction.table_cells(table(spark, d, "pages"))


@register("src05_list_items", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS x FROM pages), i AS (SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS idx, unnest(x) AS c FROM l)
SELECT page_id, idx, trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM i""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    return extraction.list_items(table(spark, d, "pages"))


@register("f18_validate", f"""WITH {ENTRIES_SQL}, e AS (SELECT id, list_filter([CASE WHEN question = '' THEN 'question_missing' END, CASE WHEN question <> '' AND length(question) < 5 THEN 'question_short' END,
  CASE WHEN answer = '' THEN 'answer_missing' END, CASE WHEN answer <> '' AND length(answer) < 10 THEN 'answer_short' END], lambda x: x IS NOT NULL) AS errors FROM entries) SELECT id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS is_valid FROM e""")
def validate(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d).withColumn("keywords", T.entry_keywords(F.col("question")))
    return extraction.validate(rows).select("id", F.array_join("errors", ",").alias("errors"), "is_valid")


@register("f20_usable_vectors", "SELECT vec_id, len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE)) > 1e-8)) > 0 AS usable FROM embeddings")
def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.usable(V.doubles(F.col("embedding"))).alias("usable"))


@register("j12_exact_duplicates", rf"""WITH {ENTRIES_SQL}, p AS (SELECT id, 'question' AS component, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS t FROM entries UNION ALL SELECT id, 'answer', trim(regexp_replace(lower(answer), '\s+', ' ', 'g')) FROM entries),
f AS (SELECT component, t, min(id) AS first_id FROM p WHERE t <> '' GROUP BY component, t) SELECT p.id, f.first_id, p.component FROM p JOIN f ON p.component = f.component AND p.t = f.t WHERE p.id <> f.first_id""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.exact(entries(spark, d))


@register("j13_similar_questions")
def similar_questions(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.similar(entries(spark, d))


@register("t20_language")
def language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", N.language(F.col("text")).alias("l")).select("conv_id", "turn", "l.*")


_AMBIGUOUS = f"""u AS (SELECT conv_id, turn, lower(text) AS low, turn > min(turn) OVER (PARTITION BY conv_id) AS has_context FROM conversations WHERE role = 'user'),
c AS (SELECT *, regexp_matches(low, '\\b({'|'.join(L.PRONOUNS)})\\b') AND NOT has_context AS c1, len(list_filter(string_split_regex(low, '\\s+'), lambda w: w <> '')) <= 2 AS c2,
  len(list_filter({L.ASKING}, lambda w: contains(low, w))) > 1 OR len(list_filter({L.CONJUNCTIONS}, lambda w: contains(low, w))) > 0 AS c3,
  len(list_filter({L.CONTEXT_PHRASES}, lambda w: contains(low, w))) > 0 AND NOT has_context AS c4, len(list_filter({L.VAGUE}, lambda w: contains(low, w))) > 0 AS c5 FROM u)"""


@register("t33_ambiguity", f"""WITH {_AMBIGUOUS} SELECT conv_id, turn, concat_ws(',', CASE WHEN c1 THEN 'pronoun_ambiguity' END, CASE WHEN c2 THEN 'incomplete_query' END, CASE WHEN c3 THEN 'multiple_intent' END, CASE WHEN c4 THEN 'context_dependent' END, CASE WHEN c5 THEN 'vague_terms' END) AS types,
  CAST(least(1, CASE WHEN c1 THEN 0.7 ELSE 1 END, CASE WHEN c2 THEN 0.6 ELSE 1 END, CASE WHEN c3 THEN 0.8 ELSE 1 END, CASE WHEN c4 THEN 0.9 ELSE 1 END, CASE WHEN c5 THEN 0.6 ELSE 1 END) AS DOUBLE) AS confidence FROM c""")
def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    has_context = F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id"))
    rows = rows.withColumn("has_context", has_context)
    return rows.select("conv_id", "turn", N.ambiguity(F.col("text"), F.col("has_context")).alias("a")).select("conv_id", "turn", F.array_join("a.types", ",").alias("types"), "a.confidence")


@register("t31_with_context")
def with_context(spark: SparkSession, d: str) -> DataFrame:
    """Pronouns resolved by the keywords of the conversation's last three queries."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.slice(T.query_keywords(F.col("text")), 1, 2).alias("keys"))
    rows = rows.withColumn("context", F.array_distinct(F.flatten(F.collect_list("keys").over(before))))
    return rows.select("conv_id", "turn", N.resolve_pronouns(F.col("text"), F.col("context")).alias("resolved"))
