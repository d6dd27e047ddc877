"""The written text index against scoring every posting, and what it reads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cinderpath.operators import text_index as X


def _brute(docs, asked, k, least=0.0):
    out = set()
    words = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()]
    for q, label, text in asked:
        own = {i: words(t) for lab, i, t in docs if lab == label and i is not None}
        if not own or q is None:
            continue
        mean = sum(map(len, own.values())) / len(own)
        df = Counter(w for ws in own.values() for w in set(ws))
        scored = []
        for i, ws in own.items():
            c = Counter(ws)
            s = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words(text)) if w in c)
            if s > 0 and round(s, 6) >= least:
                scored.append((-round(s, 6), i))
        out |= {(q, label, i, round(-s, 4), p) for p, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(rng.choice(["A", "A", "B"]), i, text(rng.choice([3, 20, 80]))) for i in range(1500)] + [("A", 5000, None), (None, 1, "w1"), ("B", None, "w1"), ("A", 5001, "")]
    asked = [(i, rng.choice("AB"), text(rng.randint(1, 15))) for i in range(25)] + [(90, "A", "nowhere"), (91, "C", "w1"), (None, "A", "w1"), (92, "A", None), (93, "B", "w0 w1 w2 w399")]
    return docs, asked


@pytest.mark.parametrize(("block", "k", "least"), [(16, 5, 0.0), (128, 3, 2.0)])
def test_search_equals_scoring_every_posting(spark, tmp_path, monkeypatch, corpus, block, k, least):
    monkeypatch.setattr(X, "BLOCK", block)
    docs, asked = corpus
    index = X.write_index(spark.createDataFrame(docs, "label string, id long, text string").repartition(3), str(tmp_path / "i"))
    found = X.search(index, spark.createDataFrame(asked, "query_id long, label string, text string"), k, least)
    assert {(r.query_id, r.label, r.id, round(r.score, 4), r.pick) for r in found.rows.collect()} == _brute(docs, asked, k, least)


def test_search_reads_few_postings(spark, tmp_path, monkeypatch, corpus):
    monkeypatch.setattr(X, "BLOCK", 16)
    docs, _ = corpus
    index = X.write_index(spark.createDataFrame(docs, "label string, id long, text string"), str(tmp_path / "i"))
    asked = [(1, "A", "w0 w1 w350"), (2, "A", "w2 w380 w390")]
    found = X.search(index, spark.createDataFrame(asked, "query_id long, label string, text string"), 2)
    assert {(r.query_id, r.label, r.id, round(r.score, 4), r.pick) for r in found.rows.collect()} == _brute(docs, asked, 2)
    terms = [w for _, _, t in asked for w in t.split()]
    there = index.blocks.where("label = 'A'").where(F.col("term").isin(terms)).agg(F.sum("n")).first()[0]
    assert 0 < found.read.agg(F.sum("n")).first()[0] < 0.5 * there


def test_labels_have_their_caps(spark, tmp_path):
    docs = [("A", i, "red " * (i + 1)) for i in range(30)] + [("B", i, "red blue") for i in range(28, 60)] + [("C", 100, "blue")]
    index = X.write_index(spark.createDataFrame(docs, "label string, id long, text string"), str(tmp_path / "i"))
    rows = X.search_all(index, spark.createDataFrame([(1, "red")], "query_id int, text string"), 20, ["A", "B", "C"]).collect()
    assert Counter(r.label for r in rows) == {"A": 8, "B": 8} or len({r.id for r in rows}) == len(rows) >= 14
    assert sorted(r.pick for r in rows) == list(range(1, len(rows) + 1))


def test_communities_by_text_and_by_members(spark, tmp_path):
    docs = spark.createDataFrame([("Community", c, t) for c, t in [("k1", "red stones"), ("k2", "blue stones"), ("k3", "green sand")]], "label string, id string, text string")
    index = X.write_index(docs, str(tmp_path / "i"))
    members = spark.createDataFrame([("e1", "k1"), ("e2", "k3"), ("e3", "k2")], "id string, community string")
    graphs = spark.createDataFrame([(1, "e1", 0), (1, "e2", 1), (1, "e3", 2)], "query_id int, id string, place int")
    got = X.community_search(index, spark.createDataFrame([(1, "red")], "query_id int, text string"), members, graphs, entities=2).collect()
    assert {(r.id, r.source) for r in got} == {("k1", "community_search"), ("k3", "connected_community")} and {r.score for r in got if r.id == "k3"} == {0.7}
