"""Recursive pieces, and column functions with known answers."""

import random

from pyspark.sql import functions as F

from cinderpath.functions import classify
from cinderpath.operators import chunking


def test_recursive_pieces_fit_and_lose_nothing():
    rng = random.Random(1)
    for size, overlap in [(50, 10), (30, 0), (1000, 200)]:
        for _ in range(60):
            text = "".join(rng.choice(["word", "longerword" * rng.randrange(1, 9), " ", " ", ". ", "\n", "\n\n", "é"]) for _ in range(rng.randrange(0, 300)))
            pieces = chunking.split_text(text, size, overlap)
            assert all(0 < len(p) <= size for p in pieces)
            at = 0
            for p in pieces:  # each piece is in the text, where the last one began or later
                at = text.find(p, at)
                assert at >= 0
            if overlap == 0:
                squeeze = lambda s: "".join(s.split())
                assert squeeze("".join(pieces)) == squeeze(text)
            else:
                assert set("".join(pieces).split()) or not text.strip()


def test_elements_and_chunks_of_a_text(spark):
    text = "# A\n\nfirst\nline\n\nsecond\n## B\n```py\n# no heading\n```\n> q\n|a|\n|-|"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    parts = chunking.elements(docs)
    got = [(r.kind, r.level, r.text) for r in parts.orderBy("element").collect()]
    assert got == [("heading", 1, "# A"), ("paragraph", 0, "first\nline"), ("paragraph", 0, "second"), ("heading", 2, "## B"), ("code_block", 0, "```py\n# no heading\n```"), ("quote", 0, "> q"), ("table", 0, "|a|\n|-|")]
    chunks = [(r.kind, r.section) for r in chunking.packed(parts).orderBy("chunk").collect()]
    assert chunks == [("mixed", "A"), ("heading", "A > B"), ("code_block", "A > B"), ("quote", "A > B"), ("table", "A > B")]


def test_classes(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    kind = lambda q: one(classify.question_type(F.lit(q)))
    assert kind("Who is the CEO of Apple?") == "yesno" and kind("What is machine learning?") == "definition" and kind("Why does it rain?") == "cause_effect"
    assert one(classify.escape_search(F.lit("a+b (c)"))) == "a\\+b \\(c\\)"
    assert one(classify.censored(F.create_map(F.lit("My_Token"), F.lit("x"), F.lit("name"), F.lit("y")))) == {"My_Token": "***REDACTED***", "name": "y"}
    assert one(classify.format_of(F.lit("a/b.HTM"))) == "html" and one(classify.format_of(F.lit("x"))) == "unknown"
    assert [tuple(x) for x in one(classify.named(F.lit("Rust, rust and Go at 20 GB")))] == [("TECHNOLOGY", "Rust"), ("TECHNOLOGY", "Go"), ("METRIC", "20 GB")]
