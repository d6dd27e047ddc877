"""Negation scopes and contradictions against nested loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cinderpath.functions import evidence as E
from cinderpath.operators import contradiction as C


def _polarity(text):
    count = lambda words, korean: len(re.findall(rf"\b({words})\b", text, re.I)) + len(re.findall(f"({korean})", text))
    n = count(E.NEGATIONS, C.KOREAN_NEGATIONS)
    bad = n + count(E.CONTRASTS, C.KOREAN_CONTRASTS) + count(C.CORRECTIONS, C.KOREAN_CORRECTIONS)
    good = count(E.CONFIRMATIONS, C.KOREAN_CONFIRMATIONS)
    return "NEGATIVE" if bad > good + 1 else "POSITIVE" if good > bad + 1 else "NEUTRAL" if n == 0 and good == 0 else "UNCERTAIN"


def _kind(a, b):
    p, q = _polarity(a), _polarity(b)
    if {p, q} == {"POSITIVE", "NEGATIVE"}:
        return 1
    number = lambda t: [(float(n.replace(",", "")), u.lower().rstrip("s")) for n, u in re.findall(C.NUMBERS, t)]
    if any(u == v and x != 0 and abs(x - y) / x > 0.2 for x, u in number(a) for y, v in number(b)):
        return 2
    change = lambda t: bool(re.search(rf"\b({C.CHANGES})\b", t, re.I))
    korean = lambda t: bool(re.search(C.KOREAN_NEGATIONS, t))
    return 3 if change(a) != change(b) or korean(a) != korean(b) else 0


@pytest.mark.parametrize("seed", range(3))
def test_contradictions_equal_nested_loops(spark, seed):
    rng = random.Random(seed)
    parts = ["was confirmed", "clearly true", "not", "never, however", "no longer", "used to be", "formerly", "없다", "하지만 잘못", "확인", "plain words"]
    number = lambda: rng.choice(["0", "1,000", "8", "10", "12", "9.6", "12.5", "1000", "1,201", "0.5"]) + rng.choice([" years", " Year", "%", " days", "km", " $", " dollars"])
    rows = []
    for i in range(70):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 3)) + [number() for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))])
        rows.append((rng.choice(["q1", "q1", "q2"]), i, rng.choice([text, text, text, rows[-1][2] if rows else text])))
    rows += [("q1", 100, None), ("q3", 101, "not never no 5 days"), (None, 102, "not never no"), (None, 103, "clearly true")]
    got = {r.id: r for r in C.contradictions(spark.createDataFrame(rows, "grp string, id int, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    kinds = {1: 0, 2: 0, 3: 0}
    for g, i, t in rows:
        n = {1: 0, 2: 0, 3: 0}
        for h, j, u in rows:
            if g is not None and g == h and i != j and t and u and (k := _kind(t, u)):
                n[k] += 1
                kinds[k] += 1
        assert (got[i].n_opposite, got[i].n_value, got[i].n_change) == (n[1], n[2], n[3]), (i, t)
        assert got[i].penalty == pytest.approx(0.06 * n[1] + 0.07 * n[2] + 0.05 * n[3])
    assert all(kinds.values())


def test_scopes_end_at_clauses(spark):
    text = "He is NOT here, but Ann isn't there however. 우리는 그것을 없다"
    at = text.index("없다")
    spans = sorted(tuple(r) for r in C.negations(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect())
    assert [(r[3], text[r[4] : r[5]], r[6]) for r in spans] == [("not", "NOT here", "here"), ("isn't", "isn't there ", "there"), ("없다", text[max(0, at - 50) : at + 2], text[max(0, at - 50) : at].strip())]


def test_mentions_in_scopes(spark):
    text = "not " + "x " * 100 + "Ada, Bob"
    spans = C.negations(spark.createDataFrame([(1, text)], "id int, text string"))
    mentions = spark.createDataFrame([(1, w, text.index(w), 3) for w in ("Ada", "Bob")] + [(2, "Ada", 5, 3)], "id int, mention string, at int, size int")
    assert [tuple(r) for r in C.negated_mentions(spans, mentions).collect()] == [(1, "Ada", 204, 3, 1)]


def test_adjusted_scores(spark):
    rows = [("q", 1, "clearly confirmed", "x", 0.8), ("q", 2, "the ship was not ever found, never seen, however", "was the ship ever found", 0.5), ("q", 3, "", None, 2.0), ("r", 4, "not", "a b", -1.0)]
    got = {r.id: r for r in C.adjusted(spark.createDataFrame(rows, "grp string, id int, text string, query string, score double")).collect()}
    assert got[1].adjusted == pytest.approx(0.8 * (1 - 0.06)) and got[1].supports and got[1].polarity_confidence == pytest.approx(0.8)
    assert got[2].adjusted == pytest.approx(0.5 * 0.85 * (1 - 0.06)) and not got[2].supports and got[2].polarity_confidence == pytest.approx(0.95)
    assert got[3].adjusted == 1.0 and got[4].adjusted == 0.0 and got[4].polarity == "UNCERTAIN"


def test_texts_are_scanned_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i % 3, i, f"it was not ever seen, never so in {i % 7} days", "was it ever seen", 0.5) for i in range(40)]
    kind = "grp int, id int, text string, query string, score double"
    assert C.adjusted(spark.createDataFrame(rows, kind).mapInArrow(counted, kind)).count() == len(rows)
    assert seen.value == len(rows)


def test_words_by_letter_are_the_words(spark):
    rng = random.Random(5)
    english, korean = (E.NEGATIONS, E.CONTRASTS, C.CORRECTIONS, E.CONFIRMATIONS, C.CHANGES), (C.KOREAN_NEGATIONS, C.KOREAN_CONTRASTS, C.KOREAN_CORRECTIONS, C.KOREAN_CONFIRMATIONS)
    words = [w for p in (*english, *korean) for w in p.replace("s?", "s").split("|")] + ["support", "ship", "no longer", "9", "used to be"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", "", "'", "_", "~"]) for _ in range(12)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in english:
        assert frame.where(F.regexp_count("text", F.lit(rf"\b({p})\b")) != F.regexp_count("text", F.lit(C._pattern(p)))).count() == 0
    for p in korean:
        assert frame.where(F.regexp_count("text", F.lit(f"({p})")) != F.regexp_count("text", F.lit(C._pattern(p, False)))).count() == 0
