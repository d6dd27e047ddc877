"""Lexical search, BPE and phrases against brute force, SQL and the tokenizer itself."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cinderpath.llm import bpe, phrases, queries, ranked

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
#: Extra columns whose names clash with those that the operators make.
CLASH = "id long, text string, lang string, term string, times long, bucket int, blob binary, a long, rank int"


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _rows(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en", None, "de"])[i % 3] if langs is None else langs[i], "x", 1, 2, b"", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH).withColumnRenamed("id", "doc_id")


def _oracle(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return sorted(con.sql(queries.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op13_phrase_collocations"])
def test_query_equals_sql(spark, name):
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, DATA).collect()) == _oracle(name)


# ranked search


def _brute_search(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(d, Counter(pattern.findall(_lower(t)))) for d, t in docs if d is not None]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_words = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            wanted[i].update(pattern.findall(_lower(t)))
    out = []
    for item, want in wanted.items():
        scored = []
        for d, c in terms:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_words
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in want.items() if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def _corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [*(f"w{i}" for i in range(40)), "Straße", "É", "ünïcodewordthatislong" * 2, "x" * 17 + "A", "x" * 17 + "B"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda k: rng.choice([" ", "-", "_, "]).join(rng.choices(vocabulary, weights, k=k))
    texts = [text(rng.randint(1, 40)) for _ in range(n)]
    texts += [texts[3]] * 30 + [None, "", " .,\n", text(5000)]
    return texts, [text(rng.randint(1, 12)) for _ in range(12)] + [None, "", "unknownword", "w0 w0 w0 W0"]


@pytest.mark.parametrize("long", [0.0, 0.125, 2.0])
def test_search_equals_brute_force(spark, monkeypatch, long):
    texts, items = _corpus(4)
    docs = [*enumerate(texts), (None, "w1 w2"), (7, "w3 w4 w5")]
    wanted = [*enumerate(items), (None, "w1"), (2, "w9 w9")]
    rows = lambda pairs: spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], "id long, text string, term string, rank int")
    for k, bound in ((3, ranked.BLOCK_QUERY_BYTES), (10, 300)):
        monkeypatch.setattr(ranked, "BLOCK_QUERY_BYTES", bound)
        monkeypatch.setattr(ranked, "LONG", long)
        got = ranked.search(rows(docs).repartition(3), rows(wanted), k, id_col="id", item_col="id")
        assert sorted(tuple(r) for r in got.collect()) == _brute_search(docs, wanted, k)


def test_search_skips_documents():
    texts, items = _corpus(8, 4000)
    plan = ranked.Plan(np.array([0]), np.array([0, 2]), np.array([0, 1]), np.array([1, 1]), np.array([5000, 100]), 4000, 40000)
    search = ranked.Searcher(plan, 5)
    rng = np.random.default_rng(1)
    every = []
    for s in range(8):
        n, rare = rng.integers(5, 40, 500), np.sort(rng.choice(500, 6, replace=False))
        search.add(np.arange(500) + 500 * s, n, np.array([0, 1]), np.array([6, 500]), np.concatenate([rare, np.arange(500)]), np.ones(506, np.int64))
        score = lambda w, d: w * (10**9 // (1000 + 8 * (25 + 75 * n[d] * 4000 // 40000)))
        every += [(-int(score(100, d) + (score(5000, d) if d in rare else 0)), 500 * s + d) for d in range(500)]
    ids, scores = search.best[0]
    assert [*zip(scores.tolist(), ids.tolist(), strict=True)] == [(-s, d) for s, d in sorted(every)[:5]]
    assert search.scored < 0.2 * len(every)


def test_terms_with_equal_hashes_are_told_apart(monkeypatch):
    flat = ranked.words

    def clashing(*a):
        h, *rest = flat(*a)
        return (h % np.uint64(3), *rest)

    monkeypatch.setattr(ranked, "words", clashing)
    terms = ranked.Terms([b"one", b"two", b"three", b"four", b"five"])
    data = np.frombuffer(b"five six one TWO twos four", np.uint8)
    h, start, end, _ = clashing(data, np.array([0, len(data)]), ranked.ALNUM)
    place, term = terms.find(data, h, start, end)
    assert place.tolist() == [0, 2, 3, 5] and term.tolist() == [4, 0, 1, 3]


def test_search_of_empty_tables(spark):
    docs, none = _rows(spark, ["a b"]), _rows(spark, ["a"]).limit(0)
    for d, q in ((docs, none), (none, docs), (none, none)):
        assert ranked.search(d, q, item_col="doc_id").count() == 0


# BPE


def _hostile(n=3000):
    rng = random.Random(3)
    pool = [*"abcdefghijklmnopqrstuvwxyzABCXYZ  \t\n\x0b\x1c\x1f\x85\xa0 '’.,!?0123456789éèñßüΣσςİıǺ̈ǅﬁ中文字한글👍🏽‍\u0000͸<|>/w_-"]
    pool += ["<|endoftext|>", "<|startoftext|>", "</w>", "'s", "'LL", "don't", "the ", "Ⅷ", "½", "\U0001e4d0"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(n)]
    texts += ["".join(rng.choices("aeinthrso", k=rng.randint(1, 40))) for _ in range(n)]
    return [*texts, "a" * 5000, "ab" * 3000, "thethe" * 2000, "", " ", None, "the the"]


def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_tokenizer(spark):
    texts, t = _hostile(), _tokenizer()
    docs = _rows(spark, texts).repartition(3)
    ids = {r.doc_id: list(r.ids) for r in bpe.encode(docs, PATH).collect()}
    text = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    short = {r.doc_id: tuple(r)[1:] for r in bpe.digest(docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, s in enumerate(texts):
        want = t.encode(s or "", add_special_tokens=False).ids
        decoded = t.decode(want, skip_special_tokens=False)
        assert ids[i] == want and text[i] == decoded, repr(s)
        assert short[i] == (len(want), sha(" ".join(map(str, want))), sha(decoded))


def test_bpe_of_odd_rows(spark):
    assert bpe.digest(_rows(spark, ["a"]).limit(0), PATH).count() == 0
    rows = spark.createDataFrame([(None, "the"), (1, None), (1, "the")], "doc_id long, text string")
    assert sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(rows, PATH).collect()), key=str) == [(1, [518]), (1, []), (None, [518])]
    lists = spark.createDataFrame([(1, [518, 99_999_999, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(lists, PATH).collect()} == {1: "the</w>", 2: "", 3: ""}


def _merge(word, rank):
    """Plain merging by rank, the leftmost pair first."""
    parts = [*word]
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_cutting_equals_merging(seed):
    rng = random.Random(seed)
    tokens, merges = [*"abc"], []
    for _ in range(rng.randint(1, 25)):  # any order of merges, so that some tokens are lost
        pair = rng.choice(tokens), rng.choice(tokens)
        if sum(map(len, pair)) <= 9 and "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    cutter = bpe.PairCutter({t: i for i, t in enumerate(tokens)}, merges)
    rank = {p: i for i, p in enumerate(merges)}
    for _ in range(200):
        word = "".join(rng.choices("abc", k=rng.randint(1, 30)))
        assert [tokens[i] for i in cutter.ids[cutter.cut(word)]] == _merge(word, rank)


# phrases


def _brute_phrases(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def _prose(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "c", "dd", "é", "\x00", "e\x1f", *(f"w{i}" for i in range(12))]
    weights = [20, 10, 4, 3, 2, 2, 1, 1, *[1] * 12]
    join = lambda: rng.choices([" ", "\t ", ". ", "\n", ",", "?!"], [30, 3, 2, 1, 1, 1])[0]
    texts = ["".join(w + join() for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for _ in range(200)]
    return [*texts, *[texts[0]] * 10, None, "", "a a a a a", "a b " * 700, "x" * 5000]


@pytest.mark.parametrize(("flush", "bucket", "each", "small"), [(3_000_000, 2_000_000, 8, 256), (500, 50, 1, 2), (1500, 3000, 1, 8)])
def test_phrases_equal_brute_force(spark, monkeypatch, flush, bucket, each, small):
    for name, value in (("FLUSH", flush), ("BUCKET_WORDS", bucket), ("BUCKETS_EACH", each), ("SMALL", small)):
        monkeypatch.setattr(phrases, name, value)
    texts = _prose(6)
    rng = random.Random(1)
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    docs = _rows(spark, texts, langs).repartition(3)
    for least, share, top in ((3, 50, 2000), (10, 60, 7)):
        got = phrases.collocations(docs, least, share, top)
        assert sorted(tuple(r) for r in got.collect()) == _brute_phrases(list(zip(langs, texts, strict=True)), least, share, top)


def test_suffixes_with_and_without_a_packed_key():
    words, last = np.arange(40, dtype=np.int64) % 7, np.arange(40) % 9 == 8
    lang = np.zeros(40, np.int64)
    wide = 1 << 20
    packed, sorted_ = phrases._suffixes(words, lang, last, 7), phrases._suffixes(words * wide, lang, last, 7 * wide)
    assert (8 * wide) ** 3 >= 1 << 63
    assert [x.tolist() for x in packed[1:4]] == [(x // wide).tolist() for x in sorted_[1:4]] and packed[4].tolist() == sorted_[4].tolist()


def test_common_words_are_bounded():
    assert phrases.COMMON * phrases.COMMON_BYTES <= 64 << 20


def test_phrases_of_odd_tables(spark):
    assert phrases.collocations(_rows(spark, ["a"]).limit(0)).count() == 0
    assert phrases.collocations(_rows(spark, [None, "", ".,;"])).count() == 0


def test_exact_scores(spark):
    big = 10**15
    row = spark.range(1).selectExpr(f"{big - 7}L as a", f"{big - 3}L as l", f"{big - 1}L as r").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * (big - 7) ** 2 // ((big - 3) * (big - 1))


def test_three_way_quicksort_counts_prefixes():
    rng = np.random.default_rng(3)
    keys = np.vstack([np.zeros(4000, np.int64), rng.zipf(1.5, (3, 4000)) % 30]).astype(np.int32)
    keys[3, rng.random(4000) < 0.2] = -1
    n = rng.integers(1, 4, 4000)
    got = {(d, *keys[: d + 1, p].tolist()): s for ps, ss, d in phrases.frequent_prefixes(keys, n, 25, 1) for p, s in zip(ps.tolist(), ss.tolist(), strict=True)}
    want = Counter()
    for i in range(4000):
        for d in (1, 2, 3):
            if keys[d, i] >= 0:
                want[(d, *keys[: d + 1, i].tolist())] += int(n[i])
    assert got == {k: v for k, v in want.items() if v >= 25}


def test_words_of_pieces():
    raw = "Ab c.\td,,é\x0be".encode()
    names, last, text = phrases._split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert pa.array(names.to_pylist()).to_pylist() == [b"ab", b"c", b"d", "é".encode(), b"e"] and last.tolist() == [False, True, True, True, True]


# pages


def _text(html):
    from cinderpath.llm import html_extract

    return "\n\n".join(b.text for b in html_extract.main_part(html_extract.parse(html)))


def test_a_paragraph_that_is_one_link_stays_where_no_part_is_named():
    assert _text("<body><p>First.</p><p><a href='x'>A whole linked paragraph.</a></p><nav><a>Home</a></nav></body>") == "First.\n\nA whole linked paragraph."


def test_main_keeps_what_stands_beside_its_article():
    html = "<body><div>Outside.</div><main><h1>Title</h1><p>Introduction.</p><article><p>Story.</p></article><aside>More</aside></main></body>"
    assert _text(html) == "Title\n\nIntroduction.\n\nStory."
    assert _text("<body><div>Outside.</div><article><p>Story.</p></article></body>") == "Story."


def test_vague_first_parts_of_names_stay_in_an_article():
    html = "<article><p class='form-factor'>Small.</p><div class='menu-item-recipe'>Soup.</div><div class='comment-list'>No.</div><div class='ad-slot'>No.</div><div class='search-form'>No.</div><div class='share'>No.</div></article>"
    assert _text(html) == "Small.\n\nSoup."
    assert _text("<body><div class='menu-item'>Home</div><p>Text.</p></body>") == "Text."


# near duplicates


def test_a_stranger_in_a_hot_bucket_costs_few_rows(spark):
    from cinderpath.llm import minhash

    n = 50_000
    rest = spark.range(n + 1).selectExpr("0L as bucket", "0L as hub", "id as doc_id", f"case when id = {n} then id else 0L end as comp")
    rows = minhash.block_roles(rest)
    assert rows.count() <= n + 2 * -(-n // minhash.BLOCK_ROWS) + 2
    assert rows.groupBy("block").count().agg({"count": "max"}).first()[0] < 3 * minhash.BLOCK_ROWS


def test_blocks_hold_every_pair_of_different_components_once(spark, monkeypatch):
    from itertools import combinations

    from cinderpath.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    rng = random.Random(4)
    rest = [(b, 0, d, rng.choice([1, 1, 1, 2, 3, 4])) for b in range(4) for d in range(2 + 9 * b)]
    got = Counter()
    blocks = defaultdict(list)
    for r in minhash.block_roles(spark.createDataFrame(rest, "bucket long, hub long, doc_id long, comp long")).collect():
        blocks[r.block].append(r)
    for rows in blocks.values():
        for x in (r for r in rows if r.role not in (2, 4)):
            for y in (r for r in rows if r.role not in (1, 3)):
                if x.comp != y.comp and (rows[0].role >= 3 or x.doc_id < y.doc_id):
                    got[frozenset((x.doc_id, y.doc_id)), ] += 1
    want = Counter()
    for b in range(4):
        own = [(d, c) for bb, _, d, c in rest if bb == b]
        if len(own) > 2:
            want.update((frozenset((x, y)),) for (x, p), (y, q) in combinations(own, 2) if p != q)
    assert got == want
