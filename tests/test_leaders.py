"""Leader clustering, the set-similarity join and Jaro-Winkler against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cinderpath.functions import text as T
from cinderpath.operators import leaders


def _jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, taken, mine = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    m, other = len(mine), [ch for ch, t in zip(b, taken, strict=True) if t]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, other, strict=True)) / 2) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcdé😀") for _ in range(rng.choice([0, 1, 2, 5, 12, 40])))
    a, b = [text() for _ in range(3000)], [text() for _ in range(3000)]
    assert T.jaro_winkler_pairs(a, b).tolist() == pytest.approx([_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], abs=1e-12)
    assert T.jaro_winkler_pairs([], []).tolist() == []


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _norm(s):
    return re.sub(r"^(the|a|an) ", "", re.sub(r"\s+", " ", s.lower().strip(" ")))


def _tokens(s):
    t = f"^{s}$"
    return {t[i : i + 2] for i in range(len(t) - 1)}


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return -1.0
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else -1.0


def _cross(a, b):
    x, y = (sum(ord(c) < 128 for c in s) / max(1, len(s)) for s in (a, b))
    return x > 0.8 and y < 0.5 or y > 0.8 and x < 0.5


def _stage(x, y, vx, vy):
    a, b = _tokens(x), _tokens(y)
    if len(a & b) >= math.ceil(0.5 * max(len(a), len(b)) - 1e-9) and max(1 - _edit(x, y) / max(len(x), len(y), 1), _jaro_winkler(x, y)) >= 0.85:
        return 2
    c = _cosine(vx, vy)
    return 3 if c >= 0.9 else 4 if c >= 0.88 and _cross(x, y) else None


def _clusters(rows, vectors):
    """The sequential rule, by nested loops."""
    names, out = {}, {}
    for i, kind, name in rows:
        if i is not None and name is not None:
            key = (kind or "", _norm(name))
            names[key] = min(names.get(key, i), i)
    led = []
    for key in sorted(names, key=lambda k: hashlib.md5(f"{k[0]}:{k[1]}".encode()).hexdigest()):
        found = [(s, at) for at, lead in enumerate(led) if lead[0] == key[0] and (s := _stage(key[1], lead[1], vectors.get(names[key]), vectors.get(names[lead])))]
        if found:
            stage, at = min(found)
            out[key] = (names[led[at]], {2: "fuzzy", 3: "embedding", 4: "cross_lingual"}[stage])
        else:
            out[key] = (names[key], "leader")
            led.append(key)
    result = set()
    for i, kind, name in rows:
        if i is None:
            continue
        if name is None:
            result.add((i, i, "leader"))
        else:
            key = (kind or "", _norm(name))
            cluster, stage = out[key]
            result.add((i, cluster, stage if names[key] == i else "exact"))
    return result


@pytest.mark.parametrize("first", [4, 1024])
def test_leader_clusters_equal_the_sequential_rule(spark, monkeypatch, first):
    monkeypatch.setattr(leaders, "FIRST", first)
    monkeypatch.setattr(leaders, "PIVOTS", 3)
    rng = random.Random(7)
    bases = ["Customer#000000", "green widget", "레드팀", "Red Team", "a", "", "acme holdings", "x" * 30]
    rows, vectors = [], {}
    for i in range(90):
        name = rng.choice(bases)
        if rng.random() < 0.7:
            name += str(rng.randint(0, 40))
        if rng.random() < 0.2 and name:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("qz ") + name[at + 1 :]
        rows.append((f"e{i:03}", rng.choice(["ORG", None]), rng.choice([name, name, f" The  {name.upper()} "])))
        base = [rng.gauss(0, 1) for _ in range(6)] if rng.random() < 0.3 or not vectors else rng.choice([*vectors.values()])
        if rng.random() < 0.6:
            vectors[rows[-1][0]] = [x + rng.gauss(0, 0.2) for x in base]
    rows += [("k1", "ORG", "적색팀"), ("k2", "ORG", "wholly other name")]
    vectors |= {"k1": [1.0] + [0.0] * 7, "k2": [0.89, math.sqrt(1 - 0.89**2)] + [0.0] * 6}
    rows += [("n1", "ORG", None), (None, "ORG", "green widget"), rows[3]]
    bad = {"e001": [0.0] * 6, "e002": [float("nan")] * 6, "e004": [1.0, 2.0], "e005": None}
    vectors |= bad
    frame = spark.createDataFrame(rows, "id string, type string, name string").repartition(3)
    known = spark.createDataFrame([*vectors.items()], "id string, vector array<double>")
    got = {tuple(r) for r in leaders.leader_clusters(frame, known).collect()}
    want = _clusters(rows, vectors)
    assert got == want
    assert {s for _, _, s in want} == {"leader", "exact", "fuzzy", "embedding", "cross_lingual"}


def test_a_family_of_similar_names_is_not_compared_with_itself(spark, monkeypatch):
    monkeypatch.setattr(leaders, "FIRST", 32)
    counted = []
    plain = leaders.candidates

    def counting(left, right, *a):
        found = plain(left, right, *a)
        counted.append(found.count())
        return found

    monkeypatch.setattr(leaders, "candidates", counting)
    n = 1200
    frame = spark.range(n).select(F.concat(F.lit("C:"), "id").alias("id"), F.lit("ORG").alias("type"), F.format_string("Customer#%09d", "id").alias("name"))
    out = leaders.leader_clusters(frame)
    assert out.select("cluster").distinct().count() == 1 and out.count() == n
    assert sum(counted) < 6 * n


def test_leader_clusters_of_an_empty_table(spark):
    assert leaders.leader_clusters(spark.createDataFrame([], "id string, type string, name string")).count() == 0


def test_a_name_is_compared_with_earlier_leaders_once(spark, monkeypatch):
    monkeypatch.setattr(leaders, "FIRST", 32)
    counted = []
    plain = leaders.candidates

    def counting(left, right, *a):
        found = plain(left, right, *a)
        counted.append(found.count())
        return found

    monkeypatch.setattr(leaders, "candidates", counting)
    n = 1200
    frame = spark.range(n).select(F.concat(F.lit("C:"), "id").alias("id"), F.lit("ORG").alias("type"), F.format_string("Customer#%09d", "id").alias("name"))
    assert leaders.leader_clusters(frame).count() == n
    assert sum(counted) < 1.6 * n


def test_normalised_names_are_not_normalised_again(spark):
    rows = [("a", "ORG", "the the doves"), ("b", "ORG", "doves"), ("c", "ORG", "an a doves")]
    got = {tuple(r) for r in leaders.leader_clusters(spark.createDataFrame(rows, "id string, type string, name string")).collect()}
    assert got == _clusters(rows, {})
    assert ("a", "a", "leader") in got


@pytest.mark.parametrize("known", [0, 3])
def test_tokens_of_unknown_frequency_lose_no_pair(spark, monkeypatch, known):
    monkeypatch.setattr(leaders, "KNOWN", known)
    rng = random.Random(3)
    rows = [(f"e{i:03}", rng.choice(["ORG", "P"]), "".join(rng.choices("ab é😀", k=rng.randint(1, 9)))) for i in range(60)]
    got = {tuple(r) for r in leaders.leader_clusters(spark.createDataFrame(rows, "id string, type string, name string")).collect()}
    assert got == _clusters(rows, {})
