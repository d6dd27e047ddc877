"""Time expressions of a text as columns: dates, months, quarters, years, decades, about-years, and words of order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of time expressions, words of order, and each kind's confidence.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
MONTH_YEAR = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"
MONTH_YEAR_KO = r"\d{4}년\s*\d{1,2}월"
QUARTER = r"\b[Qq][1-4]\s+\d{4}\b|\b\d{4}\s+[Qq][1-4]\b"
DECADE = r"\b(?:1[89]\d0|20[0-2]0)s?\b|\b(?:1[89]\d0|20[0-2]0)년대\b"
ABOUT = r"\b(?:around|approximately|about|circa|roughly|nearly)\s+\d{4}\b|약\s*\d{4}년|\d{4}년경"
YEAR = r"\b(?:1[89]\d{2}|20[0-9]{2})\b"
RELATIVE = r"\b(?:last|next|this|previous|following|past|recent|current)\s+(?:week|month|year|decade|quarter|century)\b"
RELATIVE_KO = "지난|다음|이번|작년|올해|내년|최근|현재|당시|그때"
BEFORE, BEFORE_KO = r"\b(?:before|prior to|preceding|earlier than|until)\b", "전에|이전에|앞서|~전|보다 먼저"
AFTER, AFTER_KO = r"\b(?:after|following|since|subsequent to|later than|from)\b", "후에|이후에|뒤에|~후|부터|다음에"
DURING, DURING_KO = r"\b(?:during|while|throughout|amid|in the course of)\b", "동안|중에|사이에|~중"
CONFIDENCE = {"exact_date": 1.0, "month": 0.95, "quarter": 0.9, "year": 0.85, "decade": 0.8, "approximate": 0.7, "relative": 0.6}


def _found(text: Column, pattern: str, flags: str = "U") -> Column:
    """Whole matches; U gives letters and word ends their Unicode meaning."""
    return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(0))


def _day(year: Column, month: Column | int, day: int) -> Column:
    month = F.lit(month) if isinstance(month, int) else month
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit(f"{day:02d}")).try_cast("date")


def _number(x: Column) -> Column:
    return F.regexp_extract(x, r"(\d{4})", 1).cast("int")


def _item(kind: str, raw: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), start.alias("start"), end.alias("end"), F.lit(CONFIDENCE[kind]).alias("confidence"))


def _english_month(m: Column) -> Column:
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(m, "^([A-Za-z]+)", 1)))
    return _item("month", m, _day(_number(m), number, 1), _day(_number(m), number, 28))


def _korean_month(m: Column) -> Column:
    number = F.regexp_extract(m, r"(\d{1,2})월", 1).cast("int")
    return _item("month", m, _day(_number(m), number, 1), _day(_number(m), number, 28))


def _quarter(m: Column) -> Column:
    last = F.regexp_extract(m, "[Qq]([1-4])", 1).cast("int") * 3
    return _item("quarter", m, _day(_number(m), last - 2, 1), _day(_number(m), last, 28))


def _span(kind: str, before: int, after: int):
    return lambda m: _item(kind, m, _day(_number(m) - before, 1, 1), _day(_number(m) + after, 12, 31))


def expressions(text: Column) -> Column:
    """Dated expressions (kind, raw, start, end, confidence), the most certain kinds first, in text order within a kind.

    Months and quarters end on day 28. A year ending in 0 is a decade. A year is its own expression, once, unless
    another begins in it. Matches that are no dates are dropped. Null and empty texts have none.
    """
    text = F.coalesce(text, F.lit(""))
    exact = F.transform(_found(text, ISO_DATE), lambda m: _item("exact_date", m, m.try_cast("date"), m.try_cast("date")))
    months = F.concat(F.transform(_found(text, MONTH_YEAR, "iU"), _english_month), F.transform(_found(text, MONTH_YEAR_KO), _korean_month))
    quarters = F.transform(_found(text, QUARTER), _quarter)
    decades = F.transform(_found(text, DECADE), _span("decade", 0, 9))
    about = F.transform(_found(text, ABOUT, "iU"), _span("approximate", 2, 2))
    dated = lambda items: F.filter(items, lambda e: F.year(e["start"]) > 0)
    taken = F.transform(dated(F.concat(exact, months, quarters, decades, about)), lambda e: F.year(e["start"]))
    lone = F.filter(F.array_distinct(_found(text, YEAR)), lambda y: ~F.array_contains(taken, y.cast("int")))
    return F.concat(dated(F.concat(exact, months, quarters)), F.transform(lone, _span("year", 0, 0)), dated(F.concat(decades, about)))


def relative_words(text: Column) -> Column:
    """Expressions such as "last year", which have no date of their own."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(_found(text, RELATIVE, "iU"), _found(text, RELATIVE_KO))


def primary(text: Column) -> Column:
    """The first of the most certain dated expressions; null if there is none."""
    return F.get(expressions(text), F.lit(0))


def orders(text: Column) -> Column:
    """Which of BEFORE, AFTER and DURING the text's words speak of."""
    text = F.coalesce(text, F.lit(""))
    kinds = (("BEFORE", BEFORE, BEFORE_KO), ("AFTER", AFTER, AFTER_KO), ("DURING", DURING, DURING_KO))
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?iU){en}") | text.rlike(ko), name) for name, en, ko in kinds)))
