"""Language, ambiguity and confidence of incoming queries, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T


def language_scores(text: Column) -> Column:
    """An array of structs score, place, lang. A script counts 0.8 of its share of characters; words
    count 0.6 of: 0.7 of the share of common words, 0.3 of that of question words, and up to 0.3 for
    patterns."""
    low, own = F.lower(text), T.tokens(text)

    def scored(words: Column) -> Column:
        n = F.size(words)
        out = []
        for i, (name, known_of) in enumerate(L.LANGUAGES.items()):
            hits = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
            found = reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(f"(?iU){p}")) for p in known_of["patterns"]])
            score = hits(known_of["common"]) / n * 0.7 + hits(known_of["asking"]) / n * 0.3 + F.least(found / n, F.lit(0.3))
            out.append(F.struct(F.when(n > 0, F.least(score, F.lit(1.0)) * 0.6).otherwise(0.0).alias("score"), F.lit(-10 - i).alias("place"), F.lit(name).alias("lang")))
        return F.array(*out)

    scripts = [F.struct(F.when(F.length(text) > 0, F.regexp_count(text, F.lit(p)) / F.length(text) * 0.8).otherwise(0.0).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("lang")) for i, (name, p) in enumerate(L.SCRIPTS.items())]
    return F.concat(F.array(*scripts), T.bind(own, scored))


def language(text: Column) -> Column:
    """A struct lang, confidence, mixed: the highest score, the first of equal ones; (en, 0.3) if none
    reaches 0.2. ``mixed``: more than one language does."""

    def pick(scores: Column) -> Column:
        best = F.array_max(scores)
        sure = best["score"] >= 0.2
        return F.struct(F.when(sure, best["lang"]).otherwise("en").alias("lang"), F.when(sure, best["score"]).otherwise(0.3).alias("confidence"), (F.size(F.filter(scores, lambda s: s["score"] > 0.2)) > 1).alias("mixed"))

    return T.bind(language_scores(F.coalesce(text, F.lit(""))), pick)


def ambiguity(query: Column, has_context: Column) -> Column:
    """A struct types, confidence: which of five checks find the query ambiguous, and the least of
    their confidences (1 without any). The conjunction test looks for substrings, words or not."""
    low = F.lower(F.coalesce(query, F.lit("")))
    n_asking = T._hits(low, L.ASKING)
    checks = [
        ("pronoun_ambiguity", 0.7, low.rlike(rf"(?U)\b({'|'.join(L.PRONOUNS)})\b") & ~has_context),
        ("incomplete_query", 0.6, F.size(T.words(low)) <= 2),
        ("multiple_intent", 0.8, (n_asking > 1) | T._any(low, L.CONJUNCTIONS)),
        ("context_dependent", 0.9, T._any(low, L.CONTEXT_PHRASES) & ~has_context),
        ("vague_terms", 0.6, T._any(low, L.VAGUE)),
    ]
    types = F.array_compact(F.array(*[F.when(found, name) for name, _, found in checks]))
    least = F.least(F.lit(1.0), *[F.when(found, confidence).otherwise(1.0) for _, confidence, found in checks])
    return F.struct(types.alias("types"), least.alias("confidence"))


def processing_confidence(language_confidence: Column, intent_confidence: Column, typo_confidence: Column, n_words: Column) -> Column:
    """0.3 language + 0.4 intent + 0.2 typos + 0.1 for two words or more (0.06 for fewer), at most 1."""
    return F.least(F.lit(1.0), 0.3 * language_confidence + 0.4 * intent_confidence + 0.2 * typo_confidence + F.when(n_words >= 2, 0.1).otherwise(0.06))


def resolve_pronouns(query: Column, keywords: Column) -> Column:
    """it and this become the first keyword of the context, that the second (or first), they and them
    both, one after the other, so that what has been put in can be replaced again."""
    first, second = F.get(keywords, F.lit(0)), F.coalesce(F.get(keywords, F.lit(1)), F.get(keywords, F.lit(0)))
    into = {"it": first, "this": first, "that": second, "they": F.concat_ws(" and ", first, second), "them": F.concat_ws(" and ", first, second)}
    out = query
    for word, replacement in into.items():
        out = F.regexp_replace(out, F.lit(rf"(?iU)\b{word}\b"), F.coalesce(replacement, F.lit(word)))
    return F.when(F.size(keywords) > 0, out).otherwise(query)


def _filled(template: str, with_: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), with_, F.lit(after))


def _first_of_each(texts: Column) -> Column:
    """Of texts that are equal but for case, the first; nulls are left out."""

    def keep(found: Column, text: Column) -> Column:
        return F.when(text.isNull() | F.exists(found, lambda x: F.lower(x) == F.lower(text)), found).otherwise(F.array_append(found, text))

    return F.aggregate(texts, F.array().cast("array<string>"), keep)


def variations(query: Column) -> Column:
    """The query and forms of it that suit its intent: forms of instructions, definitions and problems, its
    first three keywords, and with a question mark where it asks without one. Distinct but for case."""
    low, keys = F.lower(query), T.query_keywords(query, 3)

    def forms(intent: Column) -> Column:
        name = intent["intent"]
        instruct, define, problem = name == "instruction", name == "definition", name == "problem"
        undefined = define & ~low.contains("what is") & ~low.contains("define")
        return _first_of_each(F.array(
            query,
            F.when(instruct & ~low.startswith("how to"), _filled("how to {}", query)), F.when(instruct, _filled("instructions for {}", query)), F.when(instruct, _filled("steps to {}", query)),
            F.when(undefined, _filled("what is {}", query)), F.when(undefined, _filled("define {}", query)),
            *[F.when(problem, _filled(form, query)) for form in ("fix {}", "solve {}", "troubleshoot {}")],
            F.when(F.size(keys) > 1, F.array_join(keys, " ")),
            F.when(T.question_type(low).isNotNull() & ~query.endswith("?"), F.concat(query, F.lit("?"))),
        ))

    return T.bind(T.intent_of(query), forms)


def template_variations(query: Column) -> Column:
    """The forms of the query's intent, each with its first three keywords one by one (or the query, if it
    has none) and with the whole query."""

    def forms(intent: Column) -> Column:
        out = F.array().cast("array<string>")
        for name, templates in L.TEMPLATES.items():
            out = F.when(intent["intent"] == name, F.flatten(F.array(*map(with_each, templates)))).otherwise(out)
        return out

    def with_each(template: str) -> Column:
        return F.transform(subjects, lambda subject: _filled(template, subject))

    keys = T.query_keywords(query, 3)
    subjects = F.array_append(F.when(F.size(keys) > 0, keys).otherwise(F.array(query)), query)
    return T.bind(T.intent_of(query), forms)


def casual_variations(query: Column) -> Column:
    """Casual forms of the query, then its first three keywords."""
    return F.concat(F.array(*[_filled(form, query) for form in L.CASUAL]), T.query_keywords(query, 3))


def context_expansions(query: Column, topic: Column, recent_keywords: Column) -> Column:
    """The query with the topic in three forms, and with each of the keywords of recent queries."""
    about = F.when(F.coalesce(topic, F.lit("")) != "", F.array(F.concat_ws(" ", query, topic), F.concat_ws(" ", topic, query), F.concat(F.lit("how does "), query, F.lit(" relate to "), topic)))
    return F.concat(F.coalesce(about, F.array().cast("array<string>")), F.transform(recent_keywords, lambda w: F.concat_ws(" ", query, w)))


def query_components(query: Column, audience: Column) -> Column:
    """A struct audience, category, intent, condition of a query, as the parts of entries' keys."""
    low = F.lower(query)

    def parts(intent: Column) -> Column:
        return F.struct(F.coalesce(audience, F.lit("any")).alias("audience"), T._first(low, L.QUERY_CATEGORIES, "general").alias("category"), intent["intent"].alias("intent"), F.lit("default").alias("condition"))

    return T.bind(T.intent_of(query), parts)


def follow_up(query: Column) -> Column:
    """A struct has_indicators, has_continuations, has_references, is_follow_up, confidence: by substrings."""
    low = F.lower(F.coalesce(query, F.lit("")))
    flags = [T._any(low, words) for words in (L.FOLLOW_UP, L.CONTINUED, L.REFERENCES)]
    return F.struct(*[f.alias(n) for f, n in zip(flags, ("has_indicators", "has_continuations", "has_references"), strict=True)], (flags[0] | flags[1] | flags[2]).alias("is_follow_up"), F.when(flags[0] | flags[1] | flags[2], 0.8).otherwise(0.0).alias("confidence"))


def resolve_follow_up(query: Column, keywords: Column, topic: Column) -> Column:
    """References replaced by the last query's keywords (or 'the topic' and the like without any), one
    after the other; the topic behind a query of four words at most."""
    first, none = F.get(keywords, F.lit(0)), F.size(keywords) == 0
    both = F.when(F.size(keywords) >= 2, F.concat_ws(" and ", F.get(keywords, F.lit(0)), F.get(keywords, F.lit(1))))
    into = {"it": F.when(none, "the topic").otherwise(first), "this": F.when(none, "this topic").otherwise(first), "that": F.when(none, "that topic").otherwise(first), "they": F.coalesce(both, F.lit("they")), "them": F.coalesce(both, F.lit("them"))}
    out = query
    for word, replacement in into.items():
        out = F.regexp_replace(out, F.lit(rf"(?iU)\b{word}\b"), replacement)
    return F.when((F.coalesce(topic, F.lit("")) != "") & (F.size(T.words(out)) <= 4), F.concat(out, F.lit(" regarding "), topic)).otherwise(out)


def normalize_mixed(text: Column, mixed: Column) -> Column:
    """A text of several languages, squeezed and with the English question words in lower case."""
    out = T.squeeze(text)
    for word in L.LANGUAGES["en"]["asking"]:
        out = F.regexp_replace(out, rf"(?iU)\b{word}\b", word)
    return F.when(mixed, out).otherwise(text)


def marked_foreign(text: Column, lang: Column) -> Column:
    """Texts that aren't English with their language in front: where a translation would be put in."""
    return F.when(lang == "en", text).otherwise(F.concat(F.lit("["), lang, F.lit("] "), text))
