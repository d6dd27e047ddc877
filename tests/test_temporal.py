"""Time expressions against known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from cinderpath.functions import temporal as T


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2020", [("decade", datetime.date(2020, 1, 1), datetime.date(2029, 12, 31))]),
        ("about 1951", [("year", datetime.date(1951, 1, 1), datetime.date(1951, 12, 31)), ("approximate", datetime.date(1949, 1, 1), datetime.date(1953, 12, 31))]),
        ("2024년 3월", [("month", datetime.date(2024, 3, 1), datetime.date(2024, 3, 28))]),
        ("1990년대", [("decade", datetime.date(1990, 1, 1), datetime.date(1999, 12, 31))]),
        ("2024 q4, MAY 2024", [("month", datetime.date(2024, 5, 1), datetime.date(2024, 5, 28)), ("quarter", datetime.date(2024, 10, 1), datetime.date(2024, 12, 28))]),
        ("on 0000-01-01 or 2023-13-01", [("year", datetime.date(2023, 1, 1), datetime.date(2023, 12, 31))]),
        ("", []),
        (None, []),
    ],
)
def test_expressions(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").select(T.expressions(F.col("text")).alias("e")).first()
    assert [(e["kind"], e["start"], e["end"]) for e in row["e"]] == want


def test_orders_and_relative_words(spark):
    rows = spark.createDataFrame([("Until last year, since then",), ("지난 동안",), (None,)], "text string")
    got = [tuple(r) for r in rows.select(T.orders(F.col("text")), F.size(T.relative_words(F.col("text")))).collect()]
    assert got == [(["BEFORE", "AFTER"], 1), (["DURING"], 1), ([], 0)]
