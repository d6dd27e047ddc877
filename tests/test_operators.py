"""Operators on small tables with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from cinderpath.functions import text as T
from cinderpath.operators import graph, lifecycle, ontology, quality, resolve, search
from cinderpath.sources import backup, loaders
from cinderpath.streaming import state


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    assert _one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert _one(spark, T.entity_id(F.lit("CONCEPT"), F.lit(" Foo "))) == "aa2a533fdc98dad5"
    assert _one(spark, T.normalize_predicate(F.lit(" works-for  us "))) == "WORKS_FOR_US"
    assert _one(spark, T.normalize_name(F.lit("  The  Big   One "))) == "big one"
    assert _one(spark, T.ngram_similarity(F.lit("night"), F.lit("nacht"))) == pytest.approx(1 / 7)
    assert _one(spark, T.language(F.lit("서울 대학교"))) == "ko"
    assert _one(spark, T.language(F.lit("12 34"))) == "unknown"
    assert _one(spark, T.mask_ip(F.lit("10.20.30.40"))) == "10.20.xxx.xxx"
    assert _one(spark, T.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA"))) == pytest.approx(0.9611, abs=1e-4)
    assert _one(spark, T.jaro_winkler(F.lit(""), F.lit("a"))) == 0.0


def _both(spark, pairs):
    return spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "a string, b string")


def test_paths_and_components(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    square = _both(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("D", "A")])
    paths = {tuple(r.path) for r in graph.simple_paths(square, ids("A"), ids("C"), 5).collect()}
    assert paths == {("A", "B", "C"), ("A", "D", "C")}
    assert graph.bridges(graph.simple_paths(square, ids("A"), ids("C"), 5)).count() == 0
    assert graph.shortest_paths(square, ids("A"), ids("C"), 5).first()["path"] == ["A", "B", "C"]
    parts = _both(spark, [("1", "2"), ("2", "3"), ("4", "5")])
    got = {r.id: r.component for r in graph.components(parts, ids("1", "2", "3", "4", "5", "6")).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "6"}
    chain = _both(spark, [(f"{i:03}", f"{i + 1:03}") for i in range(40)])
    assert {r.component for r in graph.components(chain, ids(*(f"{i:03}" for i in range(41)))).collect()} == {"000"}


def test_hierarchy_faults(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 5), (5, 4)], "id long, parent long")
    assert {(r.id, r.fault) for r in graph.hierarchy_faults(tree).collect()} == {(3, "undefined_parent"), (4, "cycle"), (5, "cycle")}


def test_upsert_and_retry(spark):
    day = datetime.date(2024, 1, 1)
    old = spark.createDataFrame([(1, "a", day, None, 1), (2, "b", day, None, 4)], "id long, name string, created_at date, updated_at date, version int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, name string")
    now = datetime.date(2024, 2, 1)
    got = {r.id: (r.name, r.created_at, r.updated_at, r.version) for r in lifecycle.upsert(old, new, ["id"], now).collect()}
    assert got == {1: ("a", day, None, 1), 2: ("c", day, now, 5), 3: ("d", now, now, 1)}
    at = datetime.datetime(2024, 1, 1, 12)
    items = spark.createDataFrame([("x", "pending", 1, 3, at), ("y", "pending", 2, 3, at), ("z", "resolved", 0, 3, at)], "id string, status string, retry_count int, max_retries int, next_retry timestamp")
    got = {r.id: (r.status, r.retry_count, r.next_retry) for r in lifecycle.retry_queue(items, at).collect()}
    assert got["x"] == ("pending", 2, at + datetime.timedelta(minutes=20)) and got["y"][:2] == ("abandoned", 3) and got["z"] == ("resolved", 0, at)


def test_soft_delete_policies(spark):
    nodes = spark.createDataFrame([("a", None), ("b", None), ("c", True), ("d", False)], "id string, is_deleted boolean")
    edges = spark.createDataFrame([("a", "b", "R")], "src string, dst string, rel_type string")
    ids = spark.createDataFrame([("a",), ("c",), ("x",)], "id string")
    outcome = lambda policy: {r.id: r.outcome for r in lifecycle.soft_delete(nodes, edges, ids, policy)[2].collect()}
    assert outcome("RESTRICT") == {"a": "restricted", "c": "already_deleted", "x": "not_found"}
    assert outcome("ORPHAN")["a"] == "deleted"
    gone = lambda policy: {r.id for r in lifecycle.soft_delete(nodes, edges, ids, policy)[0].where("is_deleted").collect()}
    assert gone("ORPHAN") == {"a", "c"} and gone("CASCADE") == {"a", "b", "c"}
    with pytest.raises(ValueError):
        lifecycle.soft_delete(nodes, edges, ids, "ALL")


def test_resolution(spark):
    rows = [("1", "ORG", "Acme Corporation"), ("2", "ORG", "the acme corporation"), ("3", "ORG", "Acme Corporatiom"), ("4", "ORG", "Globex"), ("5", "PER", "Acme Corporation"), ("6", "ORG", None)]
    got = {r.id: r.cluster for r in resolve.resolve(spark.createDataFrame(rows, "id string, type string, name string")).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5", "6": "6"}


@pytest.mark.parametrize("crowd", [1, 1000])
def test_resolution_finds_all_similar_pairs(spark, monkeypatch, crowd):
    import random

    monkeypatch.setattr(resolve, "CROWD", crowd)
    rng = random.Random(2)
    names = [f"customer#{i:09}" for i in range(0, 400, 9)] + ["acme corp intl", "acme corp. intl", "xcme corp intl"]
    for base in [*names[:12], "a", "abcdefg", "northern light trading company of bergen"]:
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(1, 7)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
            names.append("".join(w))
    nodes = spark.createDataFrame([("ORG", n) for n in sorted({n for n in names if n})], "type string, norm string")
    x, y = nodes.select("type", F.col("norm").alias("x")), nodes.select("type", F.col("norm").alias("y"))
    want = {(r.x, r.y) for r in x.join(y, "type").where("x < y").where(T.edit_similarity("x", "y") >= 0.85).collect()}
    got = [(r.x, r.y) for r in resolve._pairs(nodes, 0.85).collect()]
    assert set(got) == want and len(got) == len(want) and ("acme corp intl", "acme corp. intl") in want


def test_vector_search_takes_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, None), (5, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.id) for r in search.nearest(vectors, vectors.where("vec_id in (0, 2, 4)"), 1).collect()}
    assert got == {(0, 1), (2, 3)}


def test_vector_search_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in search.nearest(vectors, vectors.where("vec_id < 9"), 4).collect()}
    monkeypatch.setattr(search, "BLOCK_VALUES", 6)
    assert {tuple(r) for r in search.nearest(vectors, vectors.where("vec_id < 9"), 4).collect()} == whole and len(whole) == 36


def test_inverse_predicates(spark):
    edges = spark.createDataFrame([("a", "b", "PARENT_OF")], "src string, dst string, rel_type string")
    inverse = spark.createDataFrame([("PARENT_OF", "CHILD_OF")], "rel_type string, inverse string")
    assert {tuple(r) for r in ontology.with_inverses(edges, inverse).collect()} == {("a", "b", "PARENT_OF"), ("b", "a", "CHILD_OF")}


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello\nthere")
    (tmp_path / "b.csv").write_text("name,age\nAnn,3\n,\nBob,\n")
    (tmp_path / "c.json").write_text('[{"text": "one", "n": 1}, {"n": 2, "in": {"k": [1, 2]}}]')
    (tmp_path / "d.jsonl").write_text('{"body": "x"}\nbroken{\n{"body": "y"}\n')
    (tmp_path / "e.html").write_text("<html><script>x</script><p>A &amp; b</p></html>")
    (tmp_path / "f.xml").write_text("<rows><row id='1'><t>word</t></row></rows>")
    (tmp_path / "g.md").write_text("# T\nuse `x` now\n```\ncode\n```\n")
    read = lambda name: sorted(r.content for r in loaders.load(spark, str(tmp_path / name)).collect())
    assert read("a.txt") == ["Hello\nthere"]
    assert read("b.csv") == ["name: Ann\nage: 3", "name: Bob"]
    assert read("c.json") == ["in.k: 1, 2\nn: 2", "one"]
    assert read("d.jsonl") == ["x", "y"]
    assert read("e.html") == ["A b"]
    assert read("f.xml") == ["_id: 1\nt: word"]
    assert read("g.md") == ["# T\nuse  now\n\n"]
    with pytest.raises(ValueError):
        loaders.load(spark, "x.unknown")
    docs = spark.createDataFrame([("d", "intro\n# One\ntext\n## Two\nmore\n### Deep\nend")], "doc_id string, content string")
    assert [(r.title, r.content) for r in loaders.markdown_sections(docs).orderBy("pos").collect()] == [("Introduction", "intro"), ("One", "text"), ("Two", "more\n### Deep\nend")]
    assert docs.select(loaders.markdown_headings("content").alias("h")).first()["h"] == ["h1: One", "h2: Two", "h3: Deep"]


def test_backup(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2)
    nodes = spark.createDataFrame([("a", "T", at, None), ("b", "U", at, at + datetime.timedelta(days=2))], "id string, type string, created_at timestamp, updated_at timestamp")
    edges = spark.createDataFrame([("a", "b", "R")], "src string, dst string, rel_type string")
    folder = str(tmp_path)
    backup.export(nodes, edges, folder, "one", at)
    backup.export(nodes, edges, folder, "two", at + datetime.timedelta(days=1), since=at + datetime.timedelta(days=1))
    assert {r.backup_id: r.nodes for r in backup.manifest(spark, folder).collect()} == {"one": 2, "two": 1}
    assert all(r.valid for r in backup.verify(spark, folder).collect())
    assert [r.backup_id for r in backup.expired(backup.manifest(spark, folder), at + datetime.timedelta(days=3), 30, 1).collect()] == ["one"]
    only, links = backup.restore(spark, folder, "one", ["T"])
    assert only.count() == 1 and links.count() == 0


def test_breaker_on_tables_and_streams(spark, tmp_path):
    outcomes = [True] * 3 + [False] + [False] * 4 + [True]
    times = [0.0, 1.0, 2.0, 3.0, 40.0, 41.0, 42.0, 43.0, 44.0]
    rows = [("k", i, t, f) for i, (t, f) in enumerate(zip(times, outcomes, strict=True))]
    schema = "key string, id long, at double, failed boolean"
    want = ["closed", "closed", "open", "rejected", "half_open", "half_open", "closed", "closed", "closed"]
    frame = spark.createDataFrame(rows, schema)
    assert [r.outcome for r in state.breaker(frame, limit=3).orderBy("id").collect()] == want
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = state.breaker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), limit=3)
    q = out.writeStream.format("memory").queryName("breaker_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.outcome for r in spark.table("breaker_out").orderBy("id").collect()] == want


def test_alert_cooldown(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=m), r, 1.0) for r, m in [("a", 0), ("a", 10), ("a", 31), ("b", 10), ("a", 50)]]
    got = state.cooled(spark.createDataFrame(rows, "start timestamp, rule string, value double"), 1800).collect()
    assert sorted((r.rule, r.start.minute) for r in got) == [("a", 0), ("a", 31), ("b", 10)]


def test_percentiles_by_pieces(spark):
    """Against sorting: a large group, one value alone, a hot value, a null key."""
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"big": rng.normal(size=3000), "one": np.array([4.5]), "hot": np.concatenate([np.full(900, 1.0), rng.normal(size=50)]), None: rng.integers(0, 9, 40).astype(float)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r for r in quality.latency(rows, ["k"], "v").collect()}
    cut = {r.k: r for r in quality.index_percentiles(rows, ["k"], "v", (50, 99)).collect()}
    assert set(got) == set(cut) == set(groups)
    for k, vs in groups.items():
        for p in (50, 75, 90, 95, 99):
            assert got[k][f"p{p}"] == pytest.approx(np.percentile(vs, p), abs=2e-6)
        for p in (50, 99):
            assert cut[k][f"p{p}"] == np.sort(vs)[min(len(vs) - 1, int(len(vs) * p / 100))]


def test_nearest_keeps_the_best_of_all_batches(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(5).integers(-2, 3, (300, 4)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    with np.errstate(all="ignore"):
        unit = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    monkeypatch.setattr(search, "BLOCK_VALUES", 40)
    try:
        got = search.nearest(vectors, vectors.where("vec_id % 10 = 0"), 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(0, 300, 10):
        scores = unit @ unit[q]
        scores[q] = -3
        mine = [r.score for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pick)]
        assert np.allclose(mine, np.sort(scores)[::-1][:5])


def test_text_search_is_the_same_in_blocks(spark, monkeypatch):
    import math
    import random

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("red green blue Iron salt-sea x9".split()) for _ in range(rng.randrange(9)))) for i in range(80)] + [(80, None), (81, ""), (82, "iron Iron")]
    asked = [(0, "iron SALT"), (1, "x9"), (2, None), (3, "nothing known"), (4, "red red green sea")]
    documents, queries = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    words = lambda t: [w for w in __import__("re").split("[^a-z0-9]+", (t or "").lower()) if w]
    lists = {i: words(t) for i, t in docs}
    mean = sum(map(len, lists.values())) / len(lists)
    want = {}
    for q, t in asked:
        scores = []
        for i, ws in lists.items():
            total = 0.0
            for w in set(words(t)):
                df, tf = sum(w in x for x in lists.values()), ws.count(w)
                total += math.log(1 + (len(lists) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if total:
                scores.append((-round(total, 6), i))
        want[q] = sorted(scores)[:6]
    for terms in (200_000, 1):
        monkeypatch.setattr(search, "BLOCK_TERMS", terms)
        got = {q: [] for q, _ in asked}
        for r in search.bm25(documents, queries, 6).orderBy("query_id", "pick").collect():
            got[r.query_id].append((-round(r.score, 6), r.id))
        assert got == want
    assert search.bm25(documents.where("false"), queries, 6).count() == 0
    assert search.bm25(documents, queries.where("false"), 6).count() == 0


def test_ancestors_go_on_to_the_end_and_cycles_end(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id int, parent int")
    assert {tuple(r) for r in graph.ancestors(chain).collect()} == {(i, j, i - j) for i in range(40) for j in range(i)}
    assert graph.ancestors(chain, 2).count() == 39 + 38
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 0), (None, 3), (5, 0)], "id int, parent int")
    assert {tuple(r) for r in graph.ancestors(ring).collect()} == {(a, b, (b - a - 1) % 3 + 1) for a in range(3) for b in range(3)} | {(5, 0, 1), (5, 1, 2), (5, 2, 3)}


def test_a_deny_at_the_root_of_a_long_chain_reaches_every_role(spark):
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(15)], "role int, parent int")
    grants = spark.createDataFrame([(0, "x", "deny")] + [(i, "x", "allow") for i in range(1, 15)], "role int, permission string, effect string")
    assert {r.role: r.effect for r in quality.role_grants(parents, grants).collect()} == dict.fromkeys(range(15), "deny")


def test_a_cluster_must_name_a_shared_checkpoint_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        graph.shared_folder(Session())


def test_all_seventeen_patterns_of_names(spark):
    from cinderpath.functions import classify

    assert len(classify.NAMED) == 17
    text = "Django and PyTorch run at Acme Data Holdings by the Banker Algorithm, 15%x and x$20M or 5 GB in Q1 2024"
    got = {(x["kind"], x["text"]) for x in _one(spark, classify.named(F.lit(text)))}
    assert {("TECHNOLOGY", "Django"), ("TECHNOLOGY", "PyTorch"), ("ORGANIZATION", "Acme Data Holdings"), ("CONCEPT", "Banker Algorithm"), ("METRIC", "15%"), ("METRIC", "$20M"), ("METRIC", "5 GB"), ("DATE", "Q1 2024")} <= got
