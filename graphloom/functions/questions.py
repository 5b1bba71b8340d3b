"""Question analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import strip


def intent(question: Column) -> Column:
    """First matching intent, ``fact`` when none matches."""
    q = F.lower(strip(question))
    out = None
    for name, phrases in fixed.INTENTS:
        hit = q.rlike(r"(?iU)\b(" + "|".join(phrases) + r")\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("fact")


def keywords(question: Column, limit: int = 10) -> Column:
    """Words of three or more characters that are not stop words, the first ``limit``, repeats kept."""
    tokens = F.regexp_extract_all(F.lower(strip(question)), F.lit(r"(?U)(\w+)"), 1)
    stop = F.array(*[F.lit(w) for w in fixed.QUESTION_STOP_WORDS])
    return F.slice(F.filter(tokens, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)), 1, limit)


def retrieval_mode(intent_: Column, has_entities: Column) -> Column:
    return F.when(has_entities | intent_.isin("reasoning", "comparison"), "hybrid").otherwise("vector")


def wanted_chunks(intent_: Column) -> Column:
    return F.when(intent_ == "summary", 10).when(intent_ == "comparison", 8).otherwise(5)


def expansions(question: Column, whole_words: bool = True) -> Column:
    """The question and at most two synonyms of the first table term in it.

    ``whole_words=False`` also finds a term inside a longer word.
    """
    q = F.lower(question)
    out = None
    for term, synonyms in fixed.SYNONYMS:
        hit = q.rlike(rf"(?U)\b{term}\b") if whole_words else q.contains(term)
        terms = F.array(question, *[F.lit(s) for s in synonyms[:2]])
        out = F.when(hit, terms) if out is None else out.when(hit, terms)
    return out.otherwise(F.array(question))
