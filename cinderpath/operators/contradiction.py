"""Negative evidence: spans of negations and their scopes, polarity, contradictions, and scores that take them into account.

Contradictions of an evidence with others of its group are counted, not listed: opposite polarities and changes by counts
of the few classes, values by a band join. Two evidences whose shared units all agree within a fifth are near each other
on a logarithmic scale, and only these are joined; all others that share a unit are known to conflict.
"""

from __future__ import annotations

import bisect
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import evidence as E
from .graph import cut

# Words of negation, contrast, correction and confirmation in Korean, of correction in English, what ends a
# negation's scope, and units of numbers.
KOREAN_NEGATIONS = (
    "아니다|아닙니다|아니에요|아니야|없다|없습니다|없어요|없어|못하다|못합니다|못해요|못해|안하다|안합니다|안해요|안해|않다|않습니다|않아요|않아|"
    "~지 않다|~지 않습니다|불가능|불가|거부|거절|결코|전혀|절대로|절대"
)
KOREAN_CONTRASTS = "하지만|그러나|그렇지만|반면|반대로|대신|오히려|달리|~와 달리|~에도 불구하고|그럼에도"
KOREAN_CORRECTIONS = "사실|실제로|정확히|올바르게|잘못|틀리게|부정확|오해|착각|더 이상|이전에는|예전에는|과거에는"
KOREAN_CONFIRMATIONS = "확인|검증|증명|입증|분명|확실|명확|올바|정확|맞다|사실|지지|보여"
CORRECTIONS = (
    "actually|in fact|in reality|correctly|the truth is|mistakenly|incorrectly|wrongly|false|untrue|inaccurate|misconception|myth|no longer|used to be|formerly|previously"
)
SCOPE_ENDS = r"[.!?,;:]|but|however|although"
CHANGES = "no longer|used to|formerly"
UNITS = ("year", "month", "day", "hour", "percent", "%", "dollar", "$", "million", "billion", "km", "mile", "kg", "pound")
NUMBERS = r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)\s*(years?|months?|days?|hours?|percent|%|dollars?|\$|million|billion|km|miles?|kg|pounds?)"
#: Characters of a Korean negation's scope, and of what is told of scopes.
BEFORE, TOLD, TOLD_BEFORE = 50, 100, 50
#: Characters of a bin of the interval join; steps of the logarithmic bins of values.
BIN, STEP = 64, math.log(1.5)

_SPANS = "start int, end int, word string, scope_start int, scope_end int, negated string"


def _scanner():
    """A function of a text: start, end, word, scope_start, scope_end, negated of each negation, the English ones first."""
    english, korean, ends = (re.compile(p, re.I) for p in (rf"\b({E.NEGATIONS})\b", f"({KOREAN_NEGATIONS})", SCOPE_ENDS))

    def spans(text: str):
        stops = [m.start() for m in ends.finditer(text)]
        for m in english.finditer(text):
            at = bisect.bisect_left(stops, m.end())
            end = stops[at] if at < len(stops) else len(text)
            yield m.start(), m.end(), m[0].lower(), m.start(), end, text[m.end() : end].strip()[:TOLD]
        for m in korean.finditer(text):
            start = max(0, m.start() - BEFORE)
            yield m.start(), m.end(), m[0], start, m.end(), text[start : m.start()].strip()[-TOLD_BEFORE:]

    return spans


def negations(texts: DataFrame) -> DataFrame:
    """id, start, end, word, scope_start, scope_end, negated of (id, text): every negation, its scope, and what it negates.

    An English negation covers what follows up to the next punctuation, `but`, `however` or `although`; a Korean one the
    50 characters before it. Places count characters from 0. Null texts have none.
    """
    kind = dict(texts.dtypes)["id"]

    def run(batches):
        spans = _scanner()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                for span in spans(text or ""):
                    for row, v in zip(rows, (i, *span), strict=True):
                        row.append(v)
            places = [pa.array(r, pa.int32()) for r in (rows[1], rows[2], rows[4], rows[5])]
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, places[0], places[1], pa.array(rows[3], pa.string()), places[2], places[3], pa.array(rows[6], pa.string())], ["id", "start", "end", "word", "scope_start", "scope_end", "negated"])

    return texts.select("id", F.col("text").cast("string")).mapInArrow(run, f"id {kind}, {_SPANS}")


@F.pandas_udf(ArrayType(StringType()))
def negated(texts: pd.Series) -> pd.Series:
    """What each negation of a text negates; null for a null text."""
    spans = _scanner()
    return texts.map(lambda t: None if t is None else [s[5] for s in spans(t)])


def negated_mentions(spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """id, mention, at, size, n: mentions (id, mention, at, size) that lie in scopes of negations, and in how many.

    An interval join: scopes and mentions meet in bins of BIN characters, each mention in the bin where it begins.
    """
    reach = spans.select("id", F.monotonically_increasing_id().alias("scope"), "scope_start", "scope_end")
    reach = reach.withColumn("bin", F.explode(F.sequence(F.floor(F.col("scope_start") / BIN), F.floor(F.col("scope_end") / BIN))))
    met = mentions.withColumn("bin", F.floor(F.col("at") / BIN)).join(reach, ["id", "bin"])
    return met.where("at >= scope_start and at + size <= scope_end").groupBy("id", "mention", "at", "size").agg(F.countDistinct("scope").alias("n"))


def _pattern(words: str, bound: bool = True) -> str:
    """A pattern of the alternatives in words, as whole words if bound. A place of a text is tried by its letter first, as
    each alternative begins with a letter of its own; those of one letter keep their order."""
    rests: dict[str, list[str]] = {}
    for w in words.split("|"):
        rests.setdefault(w[0], []).append(w[1:])
    any_of = "|".join(f"{a}(?:{'|'.join(r)})" for a, r in rests.items())
    return rf"(?=[{''.join(rests)}])\b(?:{any_of})\b" if bound else f"(?=[~가-힣])(?:{any_of})"


def _count(text: Column, words: str, korean: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(_pattern(words))) + F.regexp_count(text, F.lit(_pattern(korean, False)))


def polarity(rows: DataFrame) -> DataFrame:
    """rows (text) with n_negations, n_bad, n_good, polarity, polarity_confidence."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("n_negations", _count(text, E.NEGATIONS, KOREAN_NEGATIONS))
    rows = rows.withColumn("n_bad", F.col("n_negations") + _count(text, E.CONTRASTS, KOREAN_CONTRASTS) + _count(text, CORRECTIONS, KOREAN_CORRECTIONS))
    rows = rows.withColumn("n_good", _count(text, E.CONFIRMATIONS, KOREAN_CONFIRMATIONS))
    bad, good = F.col("n_bad"), F.col("n_good")
    kind = F.when(bad > good + 1, "NEGATIVE").when(good > bad + 1, "POSITIVE").when((F.col("n_negations") == 0) & (good == 0), "NEUTRAL").otherwise("UNCERTAIN")
    sure = lambda n: F.least(F.lit(0.95), 0.6 + n * 0.1)
    return rows.withColumn("polarity", kind).withColumn("polarity_confidence", F.when(F.col("polarity") == "NEGATIVE", sure(bad)).when(F.col("polarity") == "POSITIVE", sure(good)).when(F.col("polarity") == "NEUTRAL", 0.7).otherwise(0.5))


def with_values(rows: DataFrame) -> DataFrame:
    """rows (text) with `sets`: the numbers of a text by unit, in the order of UNITS: (place of the unit, distinct values in order).

    The text is scanned in a step of its own: inside of a lambda, or where it is used twice, it would be scanned anew each time.
    """
    part = lambda k: F.regexp_extract_all("text", F.lit(NUMBERS), k)
    rows = rows.withColumn("_numbers", part(1)).withColumn("_units", part(2))
    place = lambda u: (F.array_position(F.array(*map(F.lit, UNITS)), F.rtrim(F.lower(u), F.lit("s"))) - 1).cast("int")
    each = F.zip_with("_units", "_numbers", lambda u, x: F.struct(place(u).alias("i"), F.translate(x, ",", "").cast("double").alias("v")))
    rows = rows.withColumn("_each", F.array_sort(F.array_distinct(each)))
    own = lambda i: F.transform(F.filter("_each", lambda x: x["i"] == i), lambda x: x["v"])
    sets = F.transform(F.array_distinct(F.col("_each.i")), lambda i: F.struct(i.alias("i"), own(i).alias("v")))
    return rows.withColumn("sets", sets).drop("_numbers", "_units", "_each")


def _mask(sets: Column) -> Column:
    return F.aggregate(sets, F.lit(0), lambda m, x: m.bitwiseOR(F.pow(F.lit(2.0), x["i"]).cast("int")))


def _bin(v: Column) -> Column:
    return F.floor(F.log(v) / STEP)


def _apart(a: Column, values: Column) -> Column:
    """Whether one of the values is more than a fifth of a away from a; null if a is 0."""
    off = lambda v: F.abs(a - v) / F.nullif(a, F.lit(0.0)) > 0.2
    return off(F.array_min(values)) | off(F.array_max(values))


def _opposite(a: str, b: str) -> Column:
    return F.shiftright(a, 2) + F.shiftright(b, 2) == 1


def _differ(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(3) != 0


def _contradicted(rows: DataFrame) -> DataFrame:
    """rows (grp, id, text and others) of polarity(), without text, with n_opposite, n_value, n_change, penalty.

    Texts are told by their class (POSITIVE 0, NEGATIVE 4, others 8; 2 for a change, 1 for Korean negation), the `mask` of
    their units, and `asked`, the mask of units with values other than 0: only these can be a fifth away.
    """
    pole = F.when(F.col("polarity") == "POSITIVE", 0).when(F.col("polarity") == "NEGATIVE", 4).otherwise(8)
    change, korean = F.lower("text").rlike(_pattern(CHANGES)).cast("int"), F.col("text").rlike(_pattern(KOREAN_NEGATIONS, False)).cast("int")
    rows = with_values(rows).withColumn("klass", F.when((F.col("text") != "") & F.col("grp").isNotNull(), pole + change * 2 + korean)).drop("text")
    rows = cut(rows.withColumn("mask", _mask(F.col("sets"))).withColumn("asked", _mask(F.filter("sets", lambda x: F.exists(x["v"], lambda v: v != 0)))))
    told = rows.where("klass is not null")
    # What all texts of a kind have in common: the others by their classes, and those of them that share a unit.
    kind = ["grp", "klass", "mask", "asked"]
    kinds = told.groupBy(*kind).agg(F.count("*").alias("n"))
    others = kinds.select("grp", F.col("klass").alias("other"), F.col("mask").alias("theirs"), "n").groupBy("grp", "other", "theirs").agg(F.sum("n").alias("n"))
    n_of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    opposite, differ, sharing = _opposite("klass", "other"), _differ("klass", "other"), F.col("asked").bitwiseAND(F.col("theirs")) != 0
    common = kinds.drop("n").join(others, "grp").groupBy(*kind).agg(
        n_of(opposite).alias("n_opposite"), n_of(~opposite & differ).alias("differing"), n_of(~opposite & sharing).alias("sharing"), n_of(~opposite & differ & sharing).alias("differing_sharing")
    )
    # Of those that share a unit, all but the ones that agree in each shared unit are apart.
    signed = cut(told.where("mask <> 0").groupBy("grp", "klass", "sets", "mask", "asked").agg(F.count("*").alias("n")))
    band = signed.where("asked <> 0").select("grp", "klass", "sets", "asked", F.explode("sets").alias("m")).withColumn("v", F.filter("m.v", lambda v: v != 0)).where(F.size("v") > 0)
    band = band.select("grp", "klass", "sets", "asked", F.col("m.i").alias("i"), (F.array_max("v") * 0.8 * (1 - 1e-9)).alias("low"), (F.array_min("v") * 1.2 * (1 + 1e-9)).alias("high"), F.when(F.size("v") == 1, F.get("v", F.lit(0))).alias("only"))
    band = band.where("low <= high").withColumn("bin", F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high")))))
    held = signed.select("grp", F.col("klass").alias("other"), "n", F.col("mask").alias("theirs"), F.col("sets").alias("values"), F.explode("sets").alias("t"))
    held = held.select("grp", "other", "n", "theirs", "values", F.col("t.i").alias("i"), F.array_min("t.v").alias("least"), F.array_max("t.v").alias("most")).where("least > 0").withColumn("bin", _bin(F.col("least")))
    shared = F.col("asked").bitwiseAND(F.col("theirs"))
    unit = F.pow(F.lit(2.0), F.col("i")).cast("int")
    first, within = shared.bitwiseAND(-shared) == unit, lambda v: F.abs(F.col("only") - F.col(v)) / F.col("only") <= 0.2
    one = F.col("only").isNull() | within("least") & within("most")
    near = band.join(held, ["grp", "i", "bin"]).where(F.col("least").between(F.col("low"), F.col("high")) & ~opposite & first & one)
    of = lambda i: F.get(F.filter("values", lambda y: y["i"] == i), F.lit(0))["v"]
    conflict = F.exists("sets", lambda x: F.exists(x["v"], lambda a: _apart(a, of(x["i"]))))
    near = near.where(F.col("only").isNotNull() & (shared == unit) | ~F.coalesce(conflict, F.lit(False)))
    agreeing = near.groupBy("grp", "klass", "sets").agg(F.sum("n").alias("agreeing"), n_of(differ).alias("differing_agreeing"))
    # An evidence isn't one of its own others, which matters where its own values are apart.
    itself = F.coalesce(F.exists("sets", lambda x: F.exists(x["v"], lambda a: _apart(a, x["v"]))), F.lit(False)).cast("int")
    out = rows.join(common, kind, "left").join(agreeing, ["grp", "klass", "sets"], "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    value = F.when(F.col("klass").isNotNull(), count("sharing") - count("agreeing") - itself).otherwise(0)
    out = out.withColumn("n_opposite", count("n_opposite").cast("long")).withColumn("n_value", value.cast("long"))
    out = out.withColumn("n_change", (count("differing") - count("differing_sharing") + count("differing_agreeing")).cast("long"))
    out = out.withColumn("penalty", (F.col("n_opposite") * 0.6 + F.col("n_value") * 0.7 + F.col("n_change") * 0.5) * 0.1)
    return out.drop("sets", "klass", "mask", "asked", "differing", "sharing", "differing_sharing", "agreeing", "differing_agreeing")


def contradictions(evidence: DataFrame) -> DataFrame:
    """grp, id, n_opposite, n_value, n_change, penalty of evidence (grp, id, text), ids being different in a group.

    Of the others of its group: how many have the opposite polarity (a tenth of 0.6 each); else a value of a shared unit
    more than a fifth of this evidence's value away (0.7); else alone speak of a change, or alone are negated in Korean
    (0.5). penalty is their sum, uncut. Null and empty texts, and those
    of a null group, contradict nothing.
    """
    rows = polarity(evidence.select("grp", "id", "text")).select("grp", "id", "text", "polarity")
    return _contradicted(rows).select("grp", "id", "n_opposite", "n_value", "n_change", "penalty")


def adjusted(evidence: DataFrame) -> DataFrame:
    """grp, id, polarity, polarity_confidence, n_negations, penalty, adjusted, supports of evidence (grp, id, text, query, score).

    A negative text keeps 0.85 of its score, an uncertain one 0.95; contradictions take 0.3 of it at most. Each negation
    of two or more words of the query adds 0.1 to the confidence, up to 0.95.
    """
    rows = polarity(evidence.select("grp", "id", "text", "query", "score"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    rows = rows.withColumn("asked_words", words("query")).withColumn("scopes", negated(F.when((F.col("n_negations") > 0) & F.col("query").isNotNull(), F.col("text"))))
    n_hits = F.size(F.filter("scopes", lambda s: F.size(F.array_intersect("asked_words", words(s))) >= 2))
    rows = _contradicted(rows.withColumn("n_hits", n_hits).select("grp", "id", "text", "score", "n_negations", "polarity", "polarity_confidence", "n_hits"))
    factor = F.when(F.col("polarity") == "NEGATIVE", 0.85).when(F.col("polarity") == "UNCERTAIN", 0.95).otherwise(1.0)
    score = F.col("score") * factor * (1.0 - F.least(F.lit(0.3), F.col("penalty")))
    sure = F.when(F.col("n_hits") > 0, F.least(F.lit(0.95), F.col("polarity_confidence") + F.col("n_hits") * 0.1)).otherwise(F.col("polarity_confidence"))
    return rows.select("grp", "id", "polarity", sure.alias("polarity_confidence"), "n_negations", "penalty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("adjusted"), (F.col("polarity") != "NEGATIVE").alias("supports"))
