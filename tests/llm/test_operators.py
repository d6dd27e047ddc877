"""The corpus operators against brute force, round trips and the exact SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from cinderpath.llm import chat, decontaminate, html_extract, lattice, licenses, minhash, mixing, substrings, suffix_groups, token_output, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def _docs(spark, texts, source=lambda i: f"src{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


def _texts(seed=1, n=40, words=60):
    """Texts with exact and near copies, nulls, blanks, repeated passages and one long text."""
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = make(40)
    out = []
    for i in range(n):
        t = make(words)
        if i % 5 == 1:
            t = out[-1] or ""
        if i % 5 == 2 and out[-1]:
            parts = out[-1].split()
            parts[rng.randrange(len(parts))] = "edited"
            t = " ".join(parts)
        if i % 7 == 3:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        out.append(t)
    return [*out, None, "", "   \n", "one", "one two", make(4000), "é" * 90, "x" + "é" * 90]


def _sets(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def _components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, k, percent):
    texts = _texts()
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, texts), k, percent).collect()}
    sets = [_sets(t, k) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (n := len(sets[i] & sets[j])) and 100 * n >= percent * len(sets[i] | sets[j])]
    comp = _components(range(len(texts)), links)
    assert len({*comp.values()}) < len(texts)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in range(len(texts))}


def test_minhash_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = []
    for i in range(30):
        t = list(base)
        for _ in range(i % 9):
            t[rng.randrange(200)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(t))
    sets = [_sets(t, 3) for t in texts]
    links = [(i, j) for i in range(30) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = _components(range(30), links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(_docs(spark, texts), 3, 85).collect()}
    assert got == comp


def test_lattice_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 32)).astype(np.float32)
    x[40:60] = x[:20] + 0.12 * rng.normal(size=(20, 32))
    x[60:64] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(200, None, 0), (201, [0.0] * 32, 0), (202, [float("nan")] * 32, 1), (203, [None] + [1.0] * 31, 1), (204, [float("inf")] * 32, 1), (205, [], 1)]
    got = {r.vec_id: r for r in lattice.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = _components(range(120), [(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    assert near.sum() > 40
    for i in range(120):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), comp[i], comp[i] == i)
    for i in range(200, 206):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_lattice_links_each_width_and_finds_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, want, n = [], set(), 0
    for width in (64, 8, 16):
        for _ in range(300):
            a = rng.normal(size=width)
            a /= np.linalg.norm(a)
            b = rng.normal(size=width)
            b -= (a @ b) * a
            b /= np.linalg.norm(b)
            c = rng.uniform(0.9505, 0.97)  # planted pairs just over the threshold
            rows += [(n, a.tolist()), (n + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
            want.add((n, n + 1))
            n += 2
    rng.shuffle(rows)
    rows = [(int(i), [float(y) for y in x]) for i, x in rows]
    got = {r.vec_id: r.component_id for r in lattice.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == n and sum(got[a] == got[b] for a, b in want) >= 0.995 * len(want)
    size = {int(i): len(x) for i, x in rows}
    assert all(size[i] == size[c] for i, c in got.items())


def test_nearest_lattice_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(50, 8)) * 2
    own = lattice.nearest_e8(x)
    assert (own.sum(axis=1) % 2 == 0).all()
    around = ((x[:, None] - own[:, None] - lattice._ROOTS) ** 2).sum(axis=2).min(axis=1)
    assert (((x - own) ** 2).sum(axis=1) <= around + 1e-9).all()


def test_tokens_round_trip(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [*_texts(), "Hello, World!! it's 3.14\t\nÜber-straße 你好 <|endoftext|> end</w>", "don't   stop... ©®"]
    got = {r.doc_id: r for r in token_output.encode_and_read_back(_docs(spark, texts), path, 2).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_chunk_encoder_with_a_warm_cache_equals_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_output.ChunkEncoder(path, 2)
    bits = ["foo", "Bar", "[1]", '"', "'s", "don't", "ÜBER", "straße", "Σας", "İ", "e\u0301", "\u0301", ".", ",", "!", "...", "(", ")", "]", "你好", "²", "\u00a0", "\u3000", "\t", "\r\n", "\x1c", "<|endoftext|>", "</w>", "क़", "ﬁ", "&", "7", "A", "\u0338", "🙂", "\x00"]
    rng = random.Random(6)
    fixed = ["[1]", "[1].", '"word"', '"word".', "foo]", "foo].", "-", "-.", "a-", "a-,", ""]
    for _ in range(60):
        texts = fixed + ["".join(rng.choice(bits) + (" " if rng.random() < 0.35 else "") for _ in range(rng.randrange(25))) for _ in range(20)]
        ids, n = encoder(pa.array(texts, pa.large_string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_decontamination_equals_brute_force(spark):
    import re

    texts = [t if t is None else t.replace("w1", "W1").replace(" w3", ", w3") for t in _texts(4)]
    items = [(0, texts[3][:120]), (1, "one two"), (2, "w2 w3"), (3, None), (4, "..."), (5, texts[0]), (6, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = find(t)
        for at in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[at : at + 10]), set()).add(i)
    whole = decontaminate.digest(decontaminate.scan(_docs(spark, texts), bench))
    split = decontaminate.digest(decontaminate.scan(_docs(spark, texts), bench, block_windows=20))
    want = {}
    for d, t in enumerate(texts):
        w = find(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[tuple(w[at : at + size])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())
    for out in (whole, split):
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == want


def test_decontamination_in_blocks_cuts_the_same(spark):
    texts = [*_texts(4), "ü w1, W2 é w3"]
    docs = _docs(spark, texts)
    docs = docs.union(docs.where("doc_id < 9")).union(docs.where("doc_id = 3").selectExpr("5L", "text", "lang", "source", "n_chars")).union(docs.where("doc_id in (0, 3)").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    bench = spark.createDataFrame([(0, texts[3][:120]), (1, "w2 w3"), (2, texts[0]), (3, "w1 w2")], "item_id long, text string")
    rows = lambda **more: sorted((r.doc_id is None, r.doc_id or 0, r.n_words, str(r.spans), str(r["items"]), r.clean_text) for r in decontaminate.scan(docs, bench, **more).collect())
    whole = rows()
    assert rows(block_windows=20) == whole and len(whole) == docs.count() and any(w[3] != "[]" for w in whole)


def test_suffix_arrays_are_sorted_suffixes():
    rng = np.random.default_rng(1)
    for n, letters in [(0, 2), (1, 1), (2, 1), (30, 1), (60, 2), (200, 3), (300, 30)]:
        text = rng.integers(0, letters, n)
        assert suffix_groups.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("crowded", [10_000, 6, 1])
def test_substrings_equal_brute_force(spark, crowded):
    texts = _texts(7, 24)
    texts[-3] = " ".join((texts[-3] or "").split()[:300])
    got = {r.doc_id: r for r in substrings.deduplicate_substrings(_docs(spark, texts), key_rows=crowded).collect()}
    first = {}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], d)
    removed = 0
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        gone = gone[:-1]
        removed += int(gone.sum())
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone])[:-1]).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    assert removed > 1000


def test_license_scan_equals_sql(spark):
    texts = [f"{a} {t[1]} {b}" for t, a, b in zip(licenses.TEMPLATES, ["", "some words before", "x y z"] * 9, ["and after it", "", "more text here"] * 9, strict=False)]
    texts += [None, "", "no license here", "permission is hereby granted, free of charge, to any person obtaining a copy", " ".join(WORDS * 20) + licenses.TEMPLATES[7][1]]
    docs = _docs(spark, texts)
    got = sorted(tuple(r) for r in licenses.scan(docs, licenses.templates(spark)).collect())
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    want = sorted(con.sql(licenses.oracle_sql()).fetchall())
    assert got == want and sum(r[1] > 0 for r in got) >= len(licenses.TEMPLATES)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies</div><article><h1>Head &amp; line {i}</h1><p>First   paragraph
of <b>page</b> {i}.</p><script>var x = "<p>no</p>";</script><p>Second &eacute; {i}</p><div class="share-buttons">Share this</div></article>
<aside class="sidebar">Side</aside><section id="comments"><p>Nice!</p></section><footer>Copyright</footer></body></html>"""


def test_html_keeps_the_article_alone(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i)) for i in range(6)] + [(6, None, None), (7, "x", ""), (8, "http://b.example", "<p>Only &lt;this&gt;<br>text")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"Head & line {i}\n\nFirst paragraph of page {i}.\n\nSecond é {i}"
    assert got[6].text == got[7].text == "" and got[8].text == "Only <this> text"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_style_tree_drops_what_a_host_repeats(spark):
    page = "<html><body><div class=a><p>{}</p></div><div class=b><p>Read our house rules before you write to us</p></div></body></html>"
    texts = [" ".join(random.Random(i).choice(WORDS) for _ in range(60)) for i in range(8)]
    rows = [(i, f"http://c.example/{i}", page.format(t)) for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(texts))


def test_style_tree_alone_removes_unnamed_parts(spark):
    page = "<html><body><div class=ka><span>Home</span> <span>News of today</span></div><div class=kb><p>{}</p><p>{}</p></div><div class=kc><p>Buy two of our fine kettles and get one more</p></div><div class=kd>All rights are ours</div></body></html>"
    rng = random.Random(4)
    texts = [[" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(2)] for _ in range(9)]
    rows = [(i, f"http://d.example/{i}", page.format(*t)) for i, t in enumerate(texts)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: "\n\n".join(t) for i, t in enumerate(texts)}
    assert all(r.tree_blocks == 3 and r.markup_blocks == 0 for r in got.values())


def test_parser_is_linear_on_hostile_pages():
    import time

    n = 60_000
    start = time.process_time()
    for page in ("<b>" * n + "</i>" * n, "<p><table><td>" + "<b>" * n + "<div></div>" * n, "<ul><li>" + "<i>" * n + "<li>" * n, '<a "' * n, "<script>" * n, "<div>" * n + "x"):
        html_extract.parse(page)
    assert time.process_time() - start < 30
    deep = "<div class=a>" * 300
    assert len({html_extract.parse(f"{deep}<p class={c}>x</p>")[0].node for c in "bc"} | {html_extract.parse("<div class=z>" + deep + "<p class=b>x</p>")[0].node}) == 3


def test_viterbi_in_blocks_equals_whole(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(3, 30)):
            role = "user" if t % 2 == 0 else "assistant"
            text = f"{rng.choice(WORDS)} {rng.choice(WORDS)}?" if role == "user" else "\n".join(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(3))
            rows.append((c, t, role, text))
    rows += [(20, 0, None, "User: hi there\nAssistant: hello\nUser: thanks"), (21, 0, None, None), (None, 0, "user", "x"), (22, None, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.turn, r.seg): (r.speaker, r.rendered) for r in chat.format_chats(frame).collect()}
    monkeypatch.setattr(chat, "BLOCK", 4)
    split = {(r.conv_id, r.turn, r.seg): (r.speaker, r.rendered) for r in chat.format_chats(frame).collect()}
    assert whole == split
    assert [whole[20, 0, s][0] for s in range(3)] == ["user", "assistant", "user"]
    assert whole[20, 0, 1][1] == "<|assistant|>\nhello<|end|>\n"
    held = [(k, v) for k, v in whole.items() if k[0] < 12 and zlib.crc32(str(k[0]).encode()) % 5 == 0]
    assert held and all(v[0] == ("user" if k[1] % 2 == 0 else "assistant") for k, v in held)


def test_viterbi_equals_every_sequence(spark, monkeypatch):
    import itertools

    rng = random.Random(9)
    rows = [(c, t + (600 if c == 4 else 0), "user" if t % 2 == 0 else "assistant", f"{rng.choice(WORDS)} {rng.choice(WORDS)}{'?' * (rng.random() < 0.6)}" + "\nmore" * rng.randrange(3)) for c in range(8) for t in range(rng.randrange(2, 8))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.segments(frame)
    model = chat.Speakers(parts)
    by = {}
    for r in sorted(parts.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text, r.seg)):
        by.setdefault(r.conv_id, []).append(model.emission([r[f] for f in chat.FEATURES]))
    score = lambda e, path: model.start[path[0]] + sum(x[s] for x, s in zip(e, path, strict=True)) + sum(model.step[a, b] for a, b in itertools.pairwise(path))
    for block in (512, 3):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = {}
        for r in sorted(chat.format_chats(frame).collect(), key=lambda r: (r.conv_id, r.turn, r.seg)):
            got.setdefault(r.conv_id, []).append(chat.ROLES.index(r.speaker))
        for c, e in by.items():
            assert score(e, got[c]) == pytest.approx(max(score(e, p) for p in itertools.product(range(3), repeat=len(e))))


def test_toxicity_network_gradients():
    rng = np.random.default_rng(3)
    network = toxicity.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, mask = rng.normal(size=(5, 4, toxicity.INPUTS)), np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    x *= mask[..., None]
    weights = rng.normal(size=4)
    traces = {}
    network.forward(x, mask, traces)
    grads = network.backward(traces, weights)
    for name, p in network.p.items():
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            was, ends = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = was + step
                ends.append(float(network.forward(x, mask) @ weights))
            p[at] = was
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float(np.asarray(grads[name])[at]), rel=0.02, abs=2e-3)


def test_toxicity_learns_from_texts_of_any_length(spark):
    """Only long labelled texts: they are used whole, wherever the telling word stands; and the characters are bounded."""
    filler = "the quiet river runs past a green hill and a small town "
    rows = [(i, filler * 500 + ("vilex grunx " * 3 if i % 2 else "kind words ") + filler * 200, i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and any(r.held_out for r in got)
    before = toxicity.CHARS_PER_CLASS
    try:
        toxicity.CHARS_PER_CLASS = 1
        assert toxicity.fit(docs, labels).share == toxicity.fit(docs, labels).share
    finally:
        toxicity.CHARS_PER_CLASS = before


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    good, bad = scored.score[scored.toxic == 1], scored.score[scored.toxic == 0]
    auc = (good.to_numpy()[:, None] > bad.to_numpy()).mean()
    assert auc > 0.9 and (scored.predicted == scored.toxic).mean() > 0.9
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS[:30] if i % 4 else WORDS[30:]) for _ in range(40)) for i in range(200)]
    docs = _docs(spark, texts, lambda i: "a" if i % 4 else "b")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, weights={"a": 0.5, "b": 0.5}).toPandas()
    assert len(out) == 200 and (out.rate >= 0).all()
    tokens = (out.rate * out.n_tokens).groupby(out.doc_id % 4 == 0).sum()
    share = tokens[True] / tokens.sum()
    assert 0.35 < share < 0.6  # 0.25 before
    domains, table = mixing.posteriors(docs, labels)
    p = table.toPandas()
    k = len(domains)
    n, post = p.n_tokens.to_numpy(float), p[[f"p{i}" for i in range(k)]].to_numpy()
    aim = np.array([{"a": 0.5, "b": 0.5}.get(d, 0.0) for d in domains])
    # No rate is zero here: the solution nearest to one, by a dense solver.
    weight = post * (n / n.sum())[:, None]
    nearest = 1 + post @ np.linalg.lstsq(weight.T @ post, aim - weight.sum(axis=0), rcond=None)[0]
    assert (nearest > 0).all()
    got = mixing.balance(table, k, aim.tolist()).toPandas().set_index("doc_id").rate.reindex(p.doc_id).to_numpy()
    assert np.allclose(got, nearest, atol=1e-6)
    mixed = mixing.mixed_documents(docs, spark.createDataFrame(out[["doc_id", "copies"]]))
    assert mixed.columns == docs.columns and mixed.count() == out.copies.sum()


def test_mixed_documents_take_any_column_names(spark):
    docs = spark.createDataFrame([(0, "a", 7, 1, 2, 3, 4), (1, "b", 8, 1, 2, 3, 4), (None, "c", 9, 1, 2, 3, 4), (2, "d", 9, 1, 2, 3, 4), (2, "d", 9, 1, 2, 3, 4)], "doc_id long, text string, copies int, time int, mixed_id int, id int, `a.b` int")
    mixture = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "doc_id long, copies int")
    got = mixing.mixed_documents(docs, mixture)
    assert got.columns == docs.columns and sorted((r.text, r.copies) for r in got.collect()) == [("a", 7), ("a", 7), ("c", 9), ("d", 9), ("d", 9)]


def test_mixing_meets_skewed_targets(spark):
    rng = random.Random(5)
    vocabulary = {"a": [f"a{i}" for i in range(30)], "b": [f"b{i}" for i in range(30)], "c": [f"c{i}" for i in range(30)]}
    sources = ["b" if i % 50 == 1 else "c" if i % 100 == 2 else "a" for i in range(600)]  # .97, .02, .01
    docs = _docs(spark, [" ".join(rng.choice(vocabulary[s]) for _ in range(40)) for s in sources], lambda i: sources[i])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.8, "b": 0.1, "c": 0.1}, {"c": 1}):
        domains, table = mixing.posteriors(docs, labels)
        aim = [weights.get(d, 0) / sum(weights.values()) for d in domains]
        out = mixing.balance(table, len(domains), aim).toPandas().merge(table.drop("n_tokens").toPandas(), on="doc_id")
        tokens = out.rate * out.n_tokens
        assert (out.rate >= 0).all() and [(tokens * out[f"p{i}"]).sum() / out.n_tokens.sum() for i in range(len(domains))] == pytest.approx(aim, rel=2e-3, abs=2e-5)
        by = (out := mixing.mix(docs, labels, weights=weights).toPandas()).assign(t=out.rate * out.n_tokens).groupby(out.doc_id.map(sources.__getitem__)).t.sum()
        assert [by[d] / by.sum() for d in domains] == pytest.approx(aim, abs=0.01)


def test_projected_gradient_reaches_what_a_dense_solver_reaches(spark):
    rng = np.random.default_rng(2)
    post = rng.dirichlet([0.15] * 5, 400)
    n = rng.integers(1, 200, 400)
    table = spark.createDataFrame([(i, int(n[i]), *map(float, post[i])) for i in range(400)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double, p3 double, p4 double")
    for aim in ([0.2] * 5, [0.9, 0.025, 0.025, 0.025, 0.025], [0.45, 0.5, 0.02, 0.02, 0.01]):
        out = mixing.balance(table, 5, aim).toPandas().set_index("doc_id").sort_index()
        have = (out.rate.to_numpy() * n) @ post / n.sum()
        # Plain projected gradient on the same squares, until it stands still.
        rate, w = np.ones(400), n / n.sum()
        for _ in range(20000):
            rate = np.maximum(0, rate - 3.0 * post @ ((rate * w) @ post - aim))
        assert np.abs((rate * w) @ post - aim).max() < 1e-5
        assert (out.rate >= 0).all() and np.abs(have - aim).max() <= 1.1e-3
    assert (out.rate == 0).any()
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.balance(table.where("p0 < 0.9"), 5, [1.0, 0, 0, 0, 0])


def test_posteriors_equal_plain_naive_bayes(spark):
    rng = random.Random(9)
    sources = [rng.choice("aab") for _ in range(120)]
    texts = [" ".join(rng.choice(WORDS[:20] if s == "a" else WORDS[15:40]) for _ in range(rng.randint(0, 60))) for s in sources]
    docs = _docs(spark, texts, lambda i: sources[i])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    buckets = {r.w: r.b for r in spark.createDataFrame([(w,) for w in WORDS], "w string").selectExpr("w", f"cast(pmod(xxhash64(w), {mixing.BUCKETS}) as int) as b").collect()}
    learn = range(0, 120, 2)
    counts = {d: np.ones(mixing.BUCKETS) for d in "ab"}
    for i in learn:
        for w in texts[i].split():
            counts[sources[i]][buckets[w]] += 1
    prior = {d: (sum(sources[i] == d for i in learn) + 1) / (len(learn) + 2) for d in "ab"}
    domains, table = mixing.posteriors(docs, labels)
    for r in table.collect():
        words = texts[r.doc_id].split()
        soft = min(1.0, mixing.EVIDENCE / max(1, len(words)))
        s = np.array([np.log(prior[d]) + soft * sum(np.log(counts[d][buckets[w]] / counts[d].sum()) for w in words) for d in domains])
        p = np.exp(s - s.max())
        assert r.n_tokens == len(words) and [r.p0, r.p1] == pytest.approx((p / p.sum()).tolist(), abs=1e-9)


def test_mixing_keeps_every_labelled_domain(spark, monkeypatch):
    texts = [" ".join(f"s{i % 30}x{j}" for j in range(30)) for i in range(90)]
    docs = _docs(spark, texts, lambda i: f"src{i % 30}")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(mixing, "SAMPLE", 10)
    domains, _ = mixing.posteriors(docs, labels)
    assert sorted(domains) == sorted(f"src{i}" for i in range(30))
    out = mixing.mix(docs, labels, weights={f"src{i}": 10 if i == 29 else 1 for i in range(30)}).toPandas()
    tokens = out.rate * out.n_tokens
    assert tokens[out.doc_id % 30 == 29].sum() / tokens.sum() == pytest.approx(10 / 39, abs=0.01)
    for weights in ({"nowhere": 1.0}, {"src0": 1.0, "other": 1.0}, {"src0": -1.0}, {"src0": 0.0}):
        with pytest.raises(ValueError):
            mixing.mix(docs, labels, weights=weights)


def _operators(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "w1 w2")], "item_id long, text string")
    return {
        "mixing": lambda d: mixing.mix(d, labels),
        "minhash": lambda d: minhash.near_duplicates(d),
        "tokens": lambda d: token_output.encode_and_read_back(d, public_tokenizers.path("word_bpe_49k.json")),
        "licenses": lambda d: licenses.scan(d, licenses.templates(spark)),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "decontamination": lambda d: decontaminate.digest(decontaminate.scan(d, bench)),
        "substrings": lambda d: substrings.deduplicate_substrings(d),
    }


CLASHING = "key long, rep long, bucket string, component string, n_words string, s string, hash string"
NAMES = ["mixing", "minhash", "tokens", "licenses", "toxicity", "decontamination", "substrings"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert _operators(spark)[name](spark.createDataFrame([], f"{DOCS}, {CLASHING}")).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls_and_clashing_columns(spark, name):
    rows = [(i, t, None, None, None, *[None] * 7) for i, t in enumerate([None, "", "w1 w2 w3", "w1 w2 w3", "a" * 5000])]
    frame = spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")
    assert sorted(r.doc_id for r in _operators(spark)[name](frame).select("doc_id").collect()) == [0, 1, 2, 3, 4]


def test_other_empty_tables(spark):
    assert lattice.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, rep long, cell long")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, host string, low string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, seg int")).count() == 0
