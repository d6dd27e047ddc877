"""The corpus pipeline, stage by stage, on its own inputs."""

import corpus_pipeline
from cinderpath.llm import decontaminate, minhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]

    a = stages["toxicity"](spark, docs, SF)
    gone = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert a.columns == columns and ids(a) == [i for i in ids(docs) if i not in gone]

    b = stages["near_duplicates"](spark, a, SF)
    kept = {r.doc_id for r in minhash.near_duplicates(a, 5, 80).where("kept").collect()}
    assert b.columns == columns and ids(b) == sorted(kept) and len(kept) < a.count()

    c = stages["decontamination"](spark, b, SF)
    hit = {r.doc_id for r in decontaminate.digest(decontaminate.scan(b, bench)).where("contaminated").collect()}
    assert c.columns == columns and ids(c) == [i for i in ids(b) if i not in hit]

    d = stages["mixing"](spark, c, SF)
    assert d.columns == columns and set(ids(d)) <= set(ids(c)) and d.count() > 0

    e = stages["token_output"](spark, d, SF)
    assert e.count() == d.count() and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(e.columns)


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else None


def test_stages_take_clashing_names_null_ids_and_repeated_rows(spark):
    names = ["text", "copies", "time", "mixed_id", "id", "component_id", "rate", "key", "bucket", "kept", "n_tokens", "label", "predicted", "row", "col", "start"]
    rows = [(i, f"clean words about river number {i} and hill {i * 7} near the town of {i % 13} fields") for i in range(60)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, "a text without an id"), (None, None), (61, None), (62, "")]
    docs = spark.createDataFrame([(i, t, *(["x"] * (len(names) - 1)), "web") for i, t in rows], ", ".join(["doc_id long", *(f"{n} string" for n in names), "source string"]))
    last = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = [r.doc_id for r in out.select("doc_id").collect()]
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert out.columns == docs.columns
            # Nothing here is toxic, near another text or in the benchmark; equal rows of one id are one document.
            assert sorted(got, key=str) == sorted((i for i, _ in rows), key=str), name
            docs = out
        elif name == "mixing":
            assert out.columns == docs.columns and got.count(None) == 2
            docs = out
        else:
            last = out
    assert last.count() == docs.where("doc_id is not null").count()  # files of tokens are ordered by id
