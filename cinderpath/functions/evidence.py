"""Evidence scoring as columns: entities, relations, years, polarity, and the grounded score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs of relations; words of negation, contrast and confirmation.
VERBS = (
    "founded", "created", "established", "started", "played for", "worked at", "employed by", "member of", "married", "divorced", "born", "died",
    "surpassed", "exceeded", "broke", "set", "won", "lost", "defeated", "beat", "located in", "based in", "headquarters", "directed", "produced", "wrote",
    "composed", "invented", "discovered", "developed", "served as", "acted as", "known as", "설립", "창립", "출생", "사망", "수상", "기록",
)
NEGATIONS = (
    "not|no|never|none|neither|nor|nobody|nothing|nowhere|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|doesn't|don't|didn't|won't|wouldn't|can't|cannot|couldn't|"
    "shouldn't|shan't|mustn't|needn't|without|lack|lacking|lacks|lacked|deny|denies|denied|denying|refuse|refuses|refused|refusing|fail|fails|failed|failing|unable|impossible|unlikely"
)
CONTRASTS = "but|however|although|though|yet|despite|nevertheless|nonetheless|on the contrary|in contrast|conversely|instead|rather than|contrary to|unlike|whereas|while"
CONFIRMATIONS = (
    "confirmed|verified|proved|proven|established|indeed|certainly|definitely|clearly|obviously|correct|true|accurate|right|valid|supports?|confirms?|demonstrates?|shows?"
)


def entities(text: Column) -> Column:
    """Distinct capitalised phrases of over two letters, quoted strings, dates and years, and runs of Hangul."""
    phrases = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1), lambda m: F.length(m) > 2)
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)
    dates = F.regexp_extract_all(text, F.lit(r"\b(\d{4}|\d{1,2}/\d{1,2}/\d{4}|\w+\s+\d{1,2},?\s+\d{4})\b"), 1)
    hangul = F.regexp_extract_all(text, F.lit("([가-힣]{2,})"), 1)
    return F.array_distinct(F.transform(F.concat(phrases, quoted, dates, hangul), lambda x: F.lower(x)))


def entity_overlap(query: Column, text: Column) -> Column:
    return overlap(entities(query), entities(text))


def overlap(a: Column, b: Column) -> Column:
    """Of two lists of entities: what they share of all they have."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def relation_match(query: Column, text: Column) -> Column:
    """0.5 if the query names no relation; else 1 for a shared verb, 0.5 for any verb, 0 for none."""
    q, t = F.lower(query), F.lower(text)
    asked = reduce(lambda a, b: a | b, (F.contains(q, F.lit(v)) for v in VERBS))
    same = reduce(lambda a, b: a | b, (F.contains(q, F.lit(v)) & F.contains(t, F.lit(v)) for v in VERBS))
    other = reduce(lambda a, b: a | b, (F.contains(t, F.lit(v)) for v in VERBS))
    return F.when(~asked, 0.5).when(same, 1.0).when(other, 0.5).otherwise(0.0)


def verbs(text: Column) -> Column:
    """The verbs of relations that a text has."""
    return F.filter(F.array(*map(F.lit, VERBS)), lambda v: F.contains(F.lower(text), v))


def verb_match(asked: Column, told: Column) -> Column:
    """relation_match of the verbs of a query and a text."""
    return F.when(F.size(asked) == 0, 0.5).when(F.arrays_overlap(asked, told), 1.0).when(F.size(told) > 0, 0.5).otherwise(0.0)


def years(text: Column) -> Column:
    """The years from 1800 to 2099 that a text names as words."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d{2}|20[0-9]{2})\b"), 1), lambda y: y.cast("int"))


def year_alignment(query: Column, text: Column) -> Column:
    """Of the ranges of years: 1 if equal, 0.6 to 1 by overlap, 0.5 to 0.7 within five years, else falling to 0.1."""
    return ranges_alignment(years(query), years(text))


def ranges_alignment(q: Column, t: Column) -> Column:
    """year_alignment of the years of a query and a text."""
    q0, q1, t0, t1 = F.array_min(q), F.array_max(q), F.array_min(t), F.array_max(t)
    overlap = (F.least(q1, t1) - F.greatest(q0, t0) + 1) / (F.greatest(q1, t1) - F.least(q0, t0) + 1)
    apart = F.least(F.abs(q0 - t1), F.abs(q1 - t0))
    return (
        F.when(F.size(q) == 0, 0.5)
        .when(F.size(t) == 0, 0.4)
        .when((q0 == t0) & (q1 == t1), 1.0)
        .when((q0 <= t1) & (q1 >= t0), 0.6 + 0.4 * overlap)
        .when(apart <= 5, 0.5 + 0.2 * (5 - apart) / 5)
        .otherwise(F.greatest(F.lit(0.1), 0.4 - apart / 50))
    )


def _count(text: Column, words: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"\b({words})\b"))


def polarity(text: Column) -> Column:
    """POSITIVE, NEGATIVE, NEUTRAL or UNCERTAIN, by two indicators' lead."""
    no = _count(text, NEGATIONS)
    bad, good = no + _count(text, CONTRASTS), _count(text, CONFIRMATIONS)
    return F.when(bad > good + 1, "NEGATIVE").when(good > bad + 1, "POSITIVE").when((no == 0) & (good == 0), "NEUTRAL").otherwise("UNCERTAIN")


def contradiction(a: Column, b: Column) -> Column:
    """0.6 for opposite polarities, 0.5 if one of two texts alone speaks of a change, else 0."""
    x, y = polarity(a), polarity(b)
    change = lambda t: F.lower(t).rlike(r"\bno longer\b|\bused to\b|\bformerly\b")
    return F.when(((x == "POSITIVE") & (y == "NEGATIVE")) | ((x == "NEGATIVE") & (y == "POSITIVE")), 0.6).when(change(a) != change(b), 0.5).otherwise(0.0)


def evidence_class(overlap: Column, relation: Column) -> Column:
    return F.when((overlap >= 0.3) & (relation >= 0.8), "EXPLICIT").when((overlap >= 0.1) | (relation >= 0.5), "IMPLICIT").otherwise("INFERRED")


def grounded_score(overlap: Column, relation: Column, temporal: Column, answer: Column, pole: Column, penalty: Column | float = 0.0) -> Column:
    """Weights 0.35, 0.25, 0.20, 0.10, 0.10; a contradiction takes 0.3 of it at most."""
    adjust = F.when(pole == "NEGATIVE", 0.7).when(pole == "UNCERTAIN", 0.9).otherwise(1.0)
    base = overlap * 0.35 + relation * 0.25 + temporal * 0.20 + answer * 0.10 + adjust * 0.10
    return base * (1 - F.least(F.lit(0.3), F.lit(penalty) if isinstance(penalty, float) else penalty))


def answer_class(score: Column) -> Column:
    return F.when(score > 0.8, "confident").when(score > 0.6, "probable").when(score > 0.4, "uncertain").otherwise("insufficient")


# Parts of predicates that say little.
GENERIC = ("relates_to", "related", "associated", "connected", "linked")


def relation_weight(confidence: Column, n_chunks: Column, predicate: Column) -> Column:
    """0.4 of the confidence, 0.3 of the naming chunks (ten suffice), and 0.1 to 0.25 by how much the predicate says."""
    words = F.translate(F.lower(predicate), "_-", "  ")
    generic = reduce(lambda a, b: a | b, (F.contains(words, F.lit(g)) for g in GENERIC))
    says = F.when(generic, 0.1).when(F.length(predicate) > 3, 0.25).otherwise(0.15)
    named = F.least(F.greatest(F.coalesce(n_chunks, F.lit(1)), F.lit(1)) / 10.0, F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence * 0.4 + named * 0.3 + says))


def node_relevance(distance: Column, seed: bool = False) -> Column:
    """By hops from the topic: falls from 1 by 0.2 in a traversal, from 0.9 by 0.15 around seeds; 0.3 at least."""
    return F.greatest(F.lit(0.3), (0.9 - distance * 0.15) if seed else (1 - distance * 0.2))
