"""Text functions: Column in, Column out, built-in expressions only.

Patterns that must treat letters of all languages alike carry (?U). None of the functions depends on
session settings. A null text gives null or, where a count or a list is asked for, what an empty text
gives.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions import lexicons as L


def _any(text: Column, words: list[str]) -> Column:
    """Whether any word is a substring."""
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def _hits(text: Column, words: list[str]) -> Column:
    """How many of the words are substrings."""
    return reduce(lambda a, b: a + b, [text.contains(word).cast("int") for word in words])


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(word) for word in words])


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space become a blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """White space squeezed, then characters other than letters, digits and .?!,;:-() dropped."""
    return F.regexp_replace(squeeze(text), r"(?U)[^\w\s.?!,;:\-()]", "")


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def sentences(text: Column) -> Column:
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def looks_asked(text: Column) -> Column:
    """Starts with a question word or has a question mark."""
    return F.coalesce(F.get(words(F.lower(text)), F.lit(0)).isin(L.QUESTION_STARTERS), F.lit(False)) | F.coalesce(text.contains("?"), F.lit(False))


def plain_words(text: Column) -> Column:
    """Words as n-grams have them: lower case, punctuation deleted."""
    return words(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def ngrams(text: Column, longest: int = 3, shortest: int = 1) -> Column:
    """The set of word n-grams, each written {w1,w2,w3}: lower case, punctuation deleted."""

    def of(plain: Column, n: int) -> Column:
        starts = F.when(F.size(plain) >= n, F.sequence(F.lit(1), F.size(plain) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit("{"), F.array_join(F.slice(plain, i, n), ","), F.lit("}")))

    return bind(plain_words(text), lambda w: F.array_distinct(F.concat(*[of(w, n) for n in range(shortest, longest + 1)])))


def containment(of: Column, within: Column) -> Column:
    """Share of the set ``of`` that is in ``within``; 0 for an empty one."""
    return F.when(F.size(of) == 0, 0.0).otherwise(F.size(F.array_intersect(of, within)) / F.size(of))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def matcher_form(text: Column) -> Column:
    """Lower case, squeezed, then punctuation but apostrophes turned into blanks (in this order)."""
    return F.regexp_replace(squeeze(F.lower(text)), r"(?U)[^\w\s']", " ")


def stem(word: Column) -> Column:
    """Without its longest suffix that leaves three letters; ...at becomes ...ate."""
    out = word
    for suffix in reversed(L.SUFFIXES):
        bare = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        bare = F.when(bare.endswith("at"), F.concat(bare, F.lit("e"))).otherwise(bare)
        out = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 3), bare).otherwise(out)
    return out


def matcher_keywords(text: Column) -> Column:
    """The set of words over two letters outside the stop list, and their stems."""
    kept = F.filter(words(F.lower(text)), lambda w: (F.length(w) > 2) & ~w.isin(L.MATCHER_STOP))
    return F.array_distinct(F.flatten(F.transform(kept, lambda w: F.array(w, stem(w)))))


def expand_synonyms(keywords: Column) -> Column:
    heads = F.create_map(*[x for head, others in L.SYNONYMS.items() for x in (F.lit(head), _texts(others))])
    return F.array_distinct(F.concat(keywords, F.flatten(F.transform(keywords, lambda w: F.coalesce(F.try_element_at(heads, w), F.array().cast("array<string>"))))))


def query_keywords(text: Column, most: int | None = None) -> Column:
    """Distinct tokens over two letters outside the stop list, in order."""
    kept = F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(L.QUERY_STOP)))
    return F.slice(kept, 1, most) if most else kept


def entry_keywords(text: Column) -> Column:
    """The first ten distinct ASCII words of three letters or more outside the stop list."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(L.EXTRACT_STOP))), 1, 10)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def _trimmed_low(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")


def question_likeness(text: Column) -> Column:
    """0 to 1: 0.3 for each sign, 0.4 for a final ?, 0.3 for a question word in front; less if over
    200 or under 10 characters."""

    def likeness(low: Column) -> Column:
        tenths = reduce(lambda a, b: a + b, [F.when(low.rlike(sign), 3).otherwise(0) for sign in L.QUESTION_SIGNS])
        asks = F.regexp_extract(low, r"(?U)^\S+", 0).isin(L.INTERROGATIVES)
        tenths = tenths + F.when(low.endswith("?"), 4).otherwise(0) + F.when(asks, 3).otherwise(0)
        hundredths = tenths * 100 * F.when(F.length(text) > 200, 7).otherwise(10) * F.when(F.length(text) < 10, 8).otherwise(10)
        return F.when(F.length(low) >= 3, F.least(hundredths / F.lit(100000.0), F.lit(1.0))).otherwise(0.0)

    return _once(_trimmed_low(text), likeness)


def answer_likeness(text: Column) -> Column:
    """0 to 1: 0.4 for each sign, 0.2 without a final ?, 0.2 and 0.1 over 20 and 50 characters, 0.1
    for a usual start."""
    starts = "^(?:" + "|".join(L.ANSWER_STARTERS) + ")"

    def likeness(low: Column) -> Column:
        tenths = reduce(lambda a, b: a + b, [F.when(low.rlike(sign), 4).otherwise(0) for sign in L.ANSWER_SIGNS])
        first = F.regexp_replace(F.regexp_extract(low, r"(?U)^\S+(?:\s+\S+)?", 0), r"(?U)\s+", " ")
        tenths = tenths + F.when(~low.endswith("?"), 2).otherwise(0) + F.when(F.length(text) > 20, 2).otherwise(0) + F.when(F.length(text) > 50, 1).otherwise(0) + F.when(first.rlike(starts), 1).otherwise(0)
        return F.when(F.length(low) >= 3, F.least(tenths / F.lit(10.0), F.lit(1.0))).otherwise(0.0)

    return _once(_trimmed_low(text), likeness)


def strip_prefix(text: Column) -> Column:
    """Without leading symbols, numbering, and symbols behind it."""
    out = F.btrim(F.regexp_replace(F.btrim(text), r"(?U)^[^\w\s]+", ""))
    out = F.btrim(F.regexp_replace(out, r"^\d+[\.\)\s\-]*", ""))
    return F.btrim(F.regexp_replace(out, r"(?U)^[^\w\s]+", ""))


def content_hash(text: Column) -> Column:
    return F.md5(squeeze(F.lower(F.coalesce(text, F.lit("")))).cast("binary"))


def _first(text: Column, table: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    for name, known in reversed(table.items()):
        out = F.when(_any(text, known), name).otherwise(out)
    return out


def category_of(text: Column, given: Column) -> Column:
    """A given category in lower case, unless it is empty or general; else the class with most words
    in the text, the first of those with as many, general without any."""
    low = F.lower(text)
    scored = F.array(*[F.struct(_hits(low, known).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, known) in enumerate(L.CATEGORIES.items())])
    best = F.array_max(scored)
    own = F.lower(given)
    return F.when((F.trim(given) != "") & (own != "general"), own).otherwise(F.when(best["n"] > 0, best["name"]).otherwise("general"))


def entry_metadata(question: Column, answer: Column, section: Column) -> Column:
    """A struct audience, category, intent, condition by substring rules."""
    around = F.lower(F.concat_ws(" ", section, question, answer))
    asked = F.lower(question)
    intent = F.lit("information")
    for name, known, only_question in reversed(L.ENTRY_INTENTS):
        intent = F.when(_any(asked if only_question else around, known), name).otherwise(intent)
    return F.struct(
        _first(around, L.AUDIENCES, "any").alias("audience"),
        _first(F.lower(section), L.SECTION_CATEGORIES, "general").alias("category"),
        intent.alias("intent"),
        _first(around, L.CONDITIONS, "default").alias("condition"),
    )


def composite_key(audience: Column, category: Column, intent: Column, condition: Column) -> Column:
    part = lambda c, default: F.lower(F.trim(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))))
    return F.concat_ws("::", part(audience, "any"), part(category, "general"), part(intent, "information"), part(condition, "default"))


def sentiment(comment: Column) -> Column:
    low = F.lower(F.coalesce(comment, F.lit("")))
    good, bad = _hits(low, L.POSITIVE), _hits(low, L.NEGATIVE)
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")


def feedback_category(rating: Column, comment: Column) -> Column:
    low = F.lower(F.coalesce(comment, F.lit("")))
    return F.when(rating >= 4, _first(low, L.PRAISE, "general_satisfaction")).when(rating <= 2, _first(low, L.COMPLAINTS, "general_dissatisfaction")).otherwise("neutral_feedback")


def question_type(query: Column) -> Column:
    """The first of eight families of question openings that occurs anywhere; null without any."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(L.QUESTION_TYPES.items()):
        out = F.when(query.rlike("(?iU)" + pattern), name).otherwise(out)
    return out


def intent_of(query: Column) -> Column:
    """A struct intent, confidence: seeds from the question type, 0.3 for each phrase that occurs and
    0.2 more if it has a keyword of the query, at most 1 for phrases; the first of equal ones wins."""
    low, kind, keys = F.lower(query), question_type(query), query_keywords(query)
    names = list(dict.fromkeys([name for seeds in L.INTENT_SEEDS.values() for name in seeds] + list(L.INTENT_WORDS)))
    scored = []
    for i, name in enumerate(names):
        seed = F.lit(0)
        for question, seeds in L.INTENT_SEEDS.items():
            if name in seeds:
                seed = F.when(kind == question, round(10 * seeds[name])).otherwise(seed)
        tenths = F.lit(0)
        for phrase in L.INTENT_WORDS.get(name, []):
            tenths = tenths + F.when(low.contains(phrase), 3 + F.when(F.arrays_overlap(keys, _texts(phrase.split())), 2).otherwise(0)).otherwise(0)
        # seeded intents come before the others in the order of insertion
        place = F.when(seed > 0, -i).otherwise(-100 - list(L.INTENT_WORDS).index(name) if name in L.INTENT_WORDS else -i)
        scored.append(F.struct((seed + F.least(tenths, F.lit(10))).alias("tenths"), place.alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    asked = _any(low, ["?", "what", "how", "where", "when", "who", "why"])
    return F.struct(
        F.when(best["tenths"] > 0, best["name"]).when(asked, "question").otherwise("information").alias("intent"),
        F.when(best["tenths"] > 0, F.least(best["tenths"], F.lit(10)) / 10.0).when(asked, 0.5).otherwise(0.3).alias("confidence"),
    )


def entities(query: Column) -> Column:
    """A map from kind to its distinct matches, without kinds that have none."""
    found = [F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(query, F.lit(f"(?iU){pattern}"), F.lit(0)) for pattern in patterns]))) for patterns in L.ENTITIES.values()]
    return F.map_filter(F.map_from_arrays(_texts(list(L.ENTITIES)), F.array(*found)), lambda _, v: F.size(v) > 0)


def modifiers(query: Column) -> Column:
    return F.array_compact(F.array(*[F.when(query.rlike("(?iU)" + "|".join(patterns)), name) for name, patterns in L.MODIFIERS.items()]))


def formal_grammar(query: Column) -> Column:
    """Informal phrases rewritten, a final stop or question mark, a capital in front, squeezed."""
    out = F.btrim(query)
    for pattern, into in L.INFORMAL:
        out = F.regexp_replace(out, f"(?iU){pattern}", into)
    first = F.lower(F.get(words(out), F.lit(0)))
    mark = F.when(out.rlike("[.?!]$"), "").when(first.isin(L.FRAGMENT_QUESTIONS), "?").otherwise(".")
    out = F.concat(out, mark)
    return squeeze(F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out))))


def expand_contractions(query: Column) -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, f"(?iU){rule[0]}", rule[1]), L.CONTRACTIONS, query)


def fix_typos(query: Column) -> Column:
    """A struct text, n_fixed, confidence: tokens replaced by the table of known typos; the
    confidence falls by half the share of replaced ones, to 0.1 at least."""
    table = F.create_map(*[F.lit(x) for pair in L.TYPOS.items() for x in pair])
    own = tokens(query)
    fixed = F.transform(own, lambda w: F.coalesce(F.try_element_at(table, w), w))
    n = F.size(F.filter(own, lambda w: F.map_contains_key(table, w)))
    text = F.array_join(fixed, " ")
    text = F.when(query.rlike("(?U)^\\p{Lu}"), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    return F.struct(text.alias("text"), n.alias("n_fixed"), F.when(F.size(own) == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - n / (2.0 * F.size(own)))).alias("confidence"))


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of places with the same character, of the longer text."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(same / longest)
