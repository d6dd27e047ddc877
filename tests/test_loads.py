"""Incremental loads: streams that fail between write and commit against one batch, changes, late ends, compaction."""

import datetime as dt
import json

import pytest

from cinderpath.streaming import loads

COLUMNS = [c.split()[0] for c in loads.RECORDS.split(", ")]


def _record(kind, at=0, **values):
    return {"kind": kind, "loaded_at": dt.datetime(2024, 1, 1) + dt.timedelta(hours=at)} | values


def _frame(spark, records):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in records], loads.RECORDS)


def _entity(i, at=0, **values):
    return _record("entity", at, **({"id": f"e{i}", "name": f"name {i}", "type": "T", "confidence": 0.5, "embedding": [float(i), 1.0], "chunk_ids": [f"c{i % 3}", f"c{i}"]} | values))


def _graph(n):
    """Relations come before their ends, and links before their chunks."""
    relations = [_record("relation", 0, src=f"e{i}", dst=f"e{(i * 7 + 1) % (n + 2)}", predicate="P", confidence=0.4) for i in range(n)]
    return relations + [_entity(i) for i in range(n)] + [_record("chunk", 0, id=f"c{i}", doc_id="d", position=i, text=f"text {i}") for i in range(0, n, 2)]


def _tables(spark, path):
    return {t: sorted(map(repr, (r.asDict() for r in loads.stored(spark, path, t).collect()))) for t in loads.TABLES}


def _stream(spark, folder, path, checkpoint):
    source = spark.readStream.schema(loads.RECORDS).option("maxFilesPerTrigger", 1).json(folder)
    loads.stream_load(source, path, "files", checkpoint).awaitTermination(120)


@pytest.mark.parametrize("marked", [False, True])
def test_stream_stopped_between_write_and_commit_equals_one_batch(spark, tmp_path, monkeypatch, marked):
    records = _graph(24)
    (tmp_path / "in").mkdir()
    for part in range(3):
        rows = [json.dumps(r, default=lambda d: d.isoformat()) for r in records[part::3]]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(rows))
    commit, calls = loads._commit, []

    def failing(spark, path, mark):
        calls.append(mark)
        if len(calls) == 2:
            if marked:
                commit(spark, path, mark)
            raise OSError("lost")
        commit(spark, path, mark)

    monkeypatch.setattr(loads, "_commit", failing)
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="lost"):
        _stream(spark, str(tmp_path / "in"), store, checkpoint)
    assert len(loads.commits(spark, store)) == 1 + marked
    _stream(spark, str(tmp_path / "in"), store, checkpoint)
    assert [m.batch for m in loads.commits(spark, store)] == [0, 1, 2]
    whole = str(tmp_path / "whole")
    loads.load(_frame(spark, records), whole, "all", 0)
    got, want = _tables(spark, store), _tables(spark, whole)
    assert got == want and all(want.values())
    # every relation with both ends is there, the others wait
    assert len(want["relation"]) == sum((i * 7 + 1) % 26 < 24 for i in range(24))


def test_changes_versions_and_compaction(spark, tmp_path):
    path = str(tmp_path)
    load = lambda batch, records: loads.load(_frame(spark, records), path, "s", batch)
    first = [_entity(i) for i in range(5)] + [_record("relation", 0, src="e0", dst=f"e{i}", predicate="P", confidence=0.5) for i in (1, 2)]
    assert load(0, first + [_record("entity", 0, name="no id"), _record("noise"), _record(None)])
    second = [
        _entity(0, 1),  # the same
        _entity(1, 1, name="other"),
        _entity(1, 2, name="last"),  # the later of two
        _entity(2, 1, embedding=[9.0]),
        _entity(3, 1, embedding=None),  # no vector, the same content: unchanged
        _entity(4, 1, description="more", embedding=None),  # modified: the vector goes as well
        _entity(5, 1),
        _record("relation", 1, src="e0", dst="e1", predicate="P", confidence=0.58),
        _record("relation", 1, src="e0", dst="e2", predicate="P", confidence=0.7),
    ]
    assert load(1, second)
    assert not load(1, first) and not load(0, second)
    counts = {(r.number, r.kind, r.change): r.n for r in loads.report(spark, path).collect()}
    assert counts[0, "entity", "NEW"] == 5 and counts[0, "entity", "NO_KEY"] == 1 and counts[0, "other", "IGNORED"] == 2
    assert {k[2]: n for k, n in counts.items() if k[:2] == (1, "entity")} == {"UNCHANGED": 2, "MODIFIED": 2, "EMBEDDING_ONLY": 1, "NEW": 1, "WITH_VECTOR": 5}
    assert {k[2]: n for k, n in counts.items() if k[:2] == (1, "relation")} == {"UNCHANGED": 1, "MODIFIED": 1}
    rows = {r.id: r for r in loads.stored(spark, path, "entity").collect()}
    assert [rows[f"e{i}"].version for i in range(6)] == [1, 2, 1, 1, 2, 1]
    assert rows["e1"].name == "last" and rows["e1"].created_at.hour == 0 and rows["e1"].updated_at.hour == 2
    assert rows["e2"].embedding == [9.0] and rows["e3"].embedding == [3.0, 1.0] and rows["e4"].embedding is None
    before = _tables(spark, path) if load(2, [_record("chunk", 3, id="c1", doc_id="d", position=1, text="x")]) else None
    for batch in (3, 4, 5):
        loads.compact(spark, path)
        loads.compact(spark, path)
        assert _tables(spark, path) == before
        assert not load(batch - 1, first)
        assert load(batch, [_entity(0, batch)])
    assert loads._names(spark, f"{path}/bases") and len(loads._names(spark, f"{path}/entity")) <= 4


def test_empty_loads(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        loads.stored(spark, str(tmp_path), "entity")
    assert loads.load(_frame(spark, []), str(tmp_path), "s", 0)
    assert all(v == [] for v in _tables(spark, str(tmp_path)).values()) and loads.report(spark, str(tmp_path)).count() == 0


def test_two_sources_of_one_store_keep_their_own_numbers(spark, tmp_path):
    assert loads.load(_frame(spark, [_entity(1)]), str(tmp_path), "a-b", 0)
    assert loads.load(_frame(spark, [_entity(2)]), str(tmp_path), "c", 0)
    assert loads.commits(spark, str(tmp_path)) == [(0, "a-b", 0), (1, "c", 0)]
    assert loads.stored(spark, str(tmp_path), "entity").count() == 2
