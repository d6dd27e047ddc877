"""Incremental loads: a stored graph of Parquet folders that micro-batches of a stream, or tables, are added to.

A load appends the rows that it changes as <table>/load=<number> and at last leaves a mark in commits/, named after its
number, its source and its batch. Readers see marked loads alone, so a load shows whole or not at all. A batch that is
replayed before its mark overwrites what it left; after its mark it changes nothing. Nothing is updated in place:
a key's newest row counts, and compact() folds all loads into one base. One load or compaction at a time writes a store.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import shuffles_removed

#: Columns of a record; which of them count depends on its kind: chunk, entity or relation.
RECORDS = (
    "kind string, id string, name string, type string, description string, confidence double, embedding array<float>, chunk_ids array<string>, "
    "src string, dst string, predicate string, doc_id string, position long, text string, loaded_at timestamp"
)

#: The tables of a store: key and values; what a row of each carries besides.
TABLES = {
    "chunk": (["id"], ["doc_id", "position", "text"]),
    "entity": (["id"], ["name", "type", "description", "confidence", "embedding"]),
    "link": (["chunk_id", "entity_id"], []),
    "relation": (["src", "predicate", "dst"], ["description", "confidence"]),
}
CHANGES = ("NEW", "MODIFIED", "EMBEDDING_ONLY", "UNCHANGED", "NO_KEY")
_STATE = ["content_hash", "embedding_hash", "version", "created_at", "updated_at"]
_KINDS = {"position": "long", "confidence": "double", "embedding": "array<float>", "version": "int", "created_at": "timestamp", "updated_at": "timestamp"}


class Mark(NamedTuple):
    """A committed load."""

    number: int
    source: str
    batch: int


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _mark(spark: SparkSession, path: str) -> None:
    """An empty file, there at once or not at all."""
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def commits(spark: SparkSession, path: str) -> list[Mark]:
    """Marked loads by number; after a compaction, the last one of each source and those since."""
    parts = (n.split("-", 2) for n in _names(spark, f"{path}/commits"))
    return sorted(Mark(int(number), source, int(batch)) for number, batch, source in parts)


def _base(spark: SparkSession, path: str) -> int | None:
    return max(map(int, _names(spark, f"{path}/bases")), default=None)


def _rows(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All rows of a table with the number of their load, or of the last load in their base; None before the first load."""
    base = _base(spark, path)
    folders = [] if base is None else [f"{path}/{name}/base={base}"]
    folders += [f"{path}/{name}/load={m.number}" for m in commits(spark, path) if base is None or m.number > base]
    if not folders:
        return None
    keys, values = TABLES[name]
    schema = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in keys + values + _STATE)
    number = F.regexp_extract("_metadata.file_path", r"/(?:load|base)=(\d+)/[^/]*$", 1).cast("int")
    return spark.read.schema(schema).parquet(*folders).withColumn("load", number)


def _newest(rows: DataFrame, keys: list[str], columns: list[str], by: Column) -> DataFrame:
    """One row a key, the greatest by an order; combined before it is shuffled."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("v")).select(*keys, "v.*")


def _stored(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame | None:
    keys, values = TABLES[name]
    rows = _rows(spark, path, name)
    return None if rows is None else _newest(rows, keys, values + _STATE if columns is None else columns, F.col("load"))


def stored(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the store: key, values, content_hash, embedding_hash, version, created_at, updated_at; or the key and some columns.

    Relations and links show once both their ends are stored, in whatever order loads brought them.
    """
    rows = _stored(spark, path, name, columns)
    if rows is None:
        raise ValueError(f"nothing was loaded to {path}")
    ends = {"relation": {"src": "entity", "dst": "entity"}, "link": {"chunk_id": "chunk", "entity_id": "entity"}}
    for column, of in ends.get(name, {}).items():
        rows = rows.join(_rows(spark, path, of).select(F.col("id").alias(column)), column, "left_semi")
    return rows.select(*TABLES[name][0], *(TABLES[name][1] + _STATE if columns is None else columns))


def report(spark: SparkSession, path: str) -> DataFrame:
    """number, kind, change, n of all loads since the last compaction."""
    base, schema = _base(spark, path), "number int, kind string, change string, n long"
    folders = [f"{path}/report/load={m.number}" for m in commits(spark, path) if base is None or m.number > base]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _digest(columns: list[str]) -> Column:
    """A hash of canonical JSON; confidences count to four digits."""
    shown = [F.round(c, 4).alias(c) if c == "confidence" else F.col(c) for c in columns if c != "embedding"]
    return F.sha2(F.to_json(F.struct(*shown)), 256) if shown else F.lit("")


def _incoming(records: DataFrame, name: str) -> DataFrame:
    """A batch's rows of a table, the latest of each key (ties: by their hashes), with hashes and keyed.

    Keys with a null are no keys: keyed is false, and such rows are counted, not loaded.
    """
    keys, values = TABLES[name]
    if name == "link":
        rows = records.where("kind = 'entity'").select(F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"), F.col("id").alias("entity_id"), "loaded_at")
    else:
        rows = records.where(F.col("kind") == name).select(*keys, *values, "loaded_at")
    embedding = F.when(F.size("embedding") > 0, F.sha2(F.to_json("embedding"), 256)) if "embedding" in values else F.lit(None).cast("string")
    # Rows are shuffled without hashes, which don't compress. Those by which they are ordered are bytes, which sort as their digits do.
    order = F.struct("loaded_at", F.unhex(_digest(keys + values)).alias("content"), F.unhex(embedding).alias("vector"))
    newest = _newest(rows.repartition(*keys), keys, values + ["loaded_at"], order).withColumn("content_hash", _digest(keys + values)).withColumn("embedding_hash", embedding)
    return newest.withColumn("keyed", reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))


def changes(new: DataFrame, old: DataFrame | None, name: str, least: float = 0.1) -> DataFrame:
    """Incoming rows with their change (NEW, MODIFIED, EMBEDDING_ONLY, UNCHANGED or NO_KEY), version and times.

    Entities and chunks are compared by hashes, so no stored text or vector is read; a relation is modified when its
    confidence moves by the least change. A new row has version 1, a modified one the next; a new vector alone moves
    updated_at. A modified entity takes the incoming vector, also where that is null.
    """
    keys, values = TABLES[name]
    moved, vector = F.col("content_hash") != F.col("_content"), F.col("embedding_hash").isNotNull() & ~F.col("embedding_hash").eqNullSafe(F.col("_vector"))
    state = "_content string, _vector string, _version int, _created timestamp"
    held = {"_content": "content_hash", "_vector": "embedding_hash", "_version": "version", "_created": "created_at"}
    if name == "relation":
        moved = F.coalesce(F.abs(F.col("confidence") - F.col("_confidence")) >= least, ~F.col("confidence").eqNullSafe(F.col("_confidence")))
        vector = F.lit(False)
        state = "_version int, _created timestamp, _confidence double"
        held = {"_version": "version", "_created": "created_at", "_confidence": "confidence"}
    if old is None:
        both = new.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in state.split(", ")))
    else:
        both = new.join(old.select(*keys, *(F.col(c).alias(n) for n, c in held.items())), keys, "left")
    change = F.when(~F.col("keyed"), "NO_KEY").when(F.col("_version").isNull(), "NEW").when(moved, "MODIFIED").when(vector, "EMBEDDING_ONLY").otherwise("UNCHANGED")
    version = F.coalesce("_version", F.lit(0)) + F.col("change").isin("NEW", "MODIFIED").cast("int")
    return both.withColumn("change", change).select(
        *keys, *values, "content_hash", "embedding_hash", version.cast("int").alias("version"), F.coalesce("_created", "loaded_at").alias("created_at"), F.col("loaded_at").alias("updated_at"), "change"
    )


def load(records: DataFrame, path: str, source: str, batch: int, least: float = 0.1) -> bool:
    """Add a batch of RECORDS to a store: chunks, entities, their links, then relations. False if it was there already.

    A batch counts as there by its source and number, which only grow. Records with a null or another kind are counted in the
    report alone. The batch is read once and kept beside the store for the load, in batch/. What is shuffled for a table
    goes when the table is written; what changed is counted on the way, so that no table is kept besides.
    """
    spark = records.sparkSession
    done = commits(spark, path)
    if any(m.source == source and m.batch >= batch for m in done):
        return False
    number = max((m.number for m in done), default=-1) + 1
    batch_path = f"{path}/batch/load={number}"
    with shuffles_removed(spark):
        records.select(*(c.split()[0] for c in RECORDS.split(", "))).write.mode("overwrite").option("compression", "zstd").parquet(batch_path)
        rows = spark.read.schema(RECORDS).parquet(batch_path)
        counts = rows.where("kind is null or kind not in ('chunk', 'entity', 'relation')").groupBy().agg(F.count("*").alias("n")).select(F.lit("other").alias("kind"), F.lit("IGNORED").alias("change"), "n")
        covered = rows.where("kind = 'entity' and size(embedding) > 0").groupBy().agg(F.count("*").alias("n")).select(F.lit("entity"), F.lit("WITH_VECTOR"), "n")
        counts = counts.unionAll(covered)
        told = []
        for name in TABLES:
            # Relations are compared by their confidence, so their hashes stay where they are.
            narrow = ["version", "created_at"] + (["confidence"] if name == "relation" else ["content_hash", "embedding_hash"])
            seen = Observation()
            found = changes(_incoming(rows, name), _stored(spark, path, name, narrow), name, least).observe(seen, *(F.count_if(F.col("change") == c).alias(c) for c in CHANGES))
            found.where("change in ('NEW', 'MODIFIED', 'EMBEDDING_ONLY')").drop("change").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/load={number}")
            told += [(name, c, n) for c, n in seen.get.items()]
        counts = counts.unionAll(spark.createDataFrame(told, "kind string, change string, n long"))
        counts.where("n > 0").select(F.lit(number).alias("number"), "kind", "change", "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/report/load={number}")
    fs, p = _fs(spark, f"{path}/batch")
    fs.delete(p, True)
    _commit(spark, path, Mark(number, source, batch))
    return True


def _commit(spark: SparkSession, path: str, mark: Mark) -> None:
    _mark(spark, f"{path}/commits/{mark.number}-{mark.batch}-{mark.source}")


def stream_load(records: DataFrame, path: str, source: str, checkpoint: str, least: float = 0.1) -> StreamingQuery:
    """Load what a stream of RECORDS has now, by micro-batches, and stop; run again with the same checkpoint for what came since."""
    write = records.writeStream.foreachBatch(lambda rows, batch: load(rows, path, source, batch, least))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str) -> None:
    """Fold all loads into one base, then remove what the base before it stood for.

    The loads just folded stay until the next compaction, for readers that began before. A compaction that is lost
    halfway leaves no mark and is done again. Reports of folded loads go with them.
    """
    done, before = commits(spark, path), _base(spark, path)
    if not done or done[-1].number == before:
        return
    number = done[-1].number
    for name in TABLES:
        _stored(spark, path, name).write.mode("overwrite").parquet(f"{path}/{name}/base={number}")
    _mark(spark, f"{path}/bases/{number}")
    if before is None:
        return
    for name in [*TABLES, "report"]:
        for folder in _names(spark, f"{path}/{name}"):
            kind, n = folder.split("=")
            if int(n) < before or (kind == "load" and int(n) == before):
                fs, p = _fs(spark, f"{path}/{name}/{folder}")
                fs.delete(p, True)
    last = {m.source: m for m in done}
    for m in done:
        if m.number < before and m != last[m.source]:
            fs, p = _fs(spark, f"{path}/commits/{m.number}-{m.batch}-{m.source}")
            fs.delete(p, False)
