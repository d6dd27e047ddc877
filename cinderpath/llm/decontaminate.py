"""Benchmark decontamination: a broadcast set of test n-grams, scanned against every token window."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _U, ALNUM, save, sequence_hash, text_blocks, tune, words

#: Windows in one broadcast set: some 100 bytes each. A larger benchmark is scanned in blocks of this many.
BLOCK_WINDOWS = 200_000


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """item_id, length in words, hash and normalised text of each n-word window; a shorter item is one window."""

    def run(batches):
        for batch in batches:
            out = {"item_id": [], "length": [], "hash": [], "gram": []}
            for i, _, data, offsets in text_blocks(batch.column(1)):
                hashes, start, end, first = words(data, offsets, ALNUM)
                lowered = _LOWER[data].tobytes()
                for row in range(len(first) - 1):
                    a, b = int(first[row]), int(first[row + 1])
                    k = min(n, b - a)
                    if b - a < max(1, min_words):
                        continue
                    grams = sequence_hash(hashes[a:b], k)
                    for at in range(b - a - k + 1):
                        out["item_id"].append(batch.column(0)[i + row].as_py())
                        out["length"].append(k)
                        out["hash"].append(int(grams[at].astype(np.int64)))
                        out["gram"].append(b" ".join(lowered[start[w] : end[w]] for w in range(a + at, a + at + k)))
            yield pa.RecordBatch.from_pydict(
                out, pa.schema([("item_id", pa.int64()), ("length", pa.int32()), ("hash", pa.int64()), ("gram", pa.binary())])
            )

    source = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "item_id long, length int, hash long, gram binary")


def _cut(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, spans, items, clean_text: the text without the words of its spans."""

    def run(batches):
        for batch in batches:
            n_words, texts = [], []
            spans = batch.column(2).to_pylist()
            for i, _, data, offsets in text_blocks(batch.column(1)):
                _, start, end, first = words(data, offsets, ALNUM)
                raw = data.tobytes()
                for row in range(len(first) - 1):
                    a = int(first[row])
                    n_words.append(int(first[row + 1]) - a)
                    text, last = [], int(offsets[row])
                    for s in spans[i + row]:
                        text.append(raw[last : start[a + s["start"]]])
                        last = int(end[a + s["end"] - 1])
                    texts.append(b"".join([*text, raw[last : offsets[row + 1]]]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), batch.column(2), batch.column(3), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "spans", "items", "clean_text"],
            )

    return documents.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<long>, clean_text string")


def _scan(documents: DataFrame, windows: DataFrame, cut: bool = True) -> DataFrame:
    """doc_id, n_words, merged word spans that windows cover, items whose windows occur, text without those words.

    Without cut, clean_text is the SHA-256 of the text.
    """
    spark = documents.sparkSession
    held = windows.toArrow()
    lengths = {}
    for k in sorted(set(held["length"].to_pylist())):
        part = held.filter(pa.compute.equal(held["length"], k))
        grams: dict[tuple[int, bytes], set[int]] = {}
        for h, g, item in zip(part["hash"].to_pylist(), part["gram"].to_pylist(), part["item_id"].to_pylist(), strict=True):
            grams.setdefault((h, g), set()).add(item)
        lengths[k] = np.unique(np.array([h for h, _ in grams], np.int64)), grams
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        sets = shared.value
        for batch in batches:
            n_words, spans, items, texts = [], [], [], []
            for _, _, data, offsets in text_blocks(batch.column(1)):
                hashes, start, end, first = words(data, offsets, ALNUM)
                row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                cover = np.zeros(len(hashes) + 1, np.int64)
                found: dict[int, set[int]] = {}
                lowered = _LOWER[data].tobytes()
                for k, (known, grams) in sets.items():
                    windows_ = sequence_hash(hashes, k).view(np.int64)
                    if not len(windows_):
                        continue
                    at = np.searchsorted(known, windows_)
                    hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == windows_)
                    hits = hits[row_of[hits] == row_of[hits + k - 1]]
                    for w in hits.tolist():
                        gram = b" ".join(lowered[start[x] : end[x]] for x in range(w, w + k))
                        got = grams.get((int(windows_[w]), gram))
                        if got:
                            cover[w] += 1
                            cover[w + k] -= 1
                            found.setdefault(int(row_of[w]), set()).update(got)
                hit = np.cumsum(cover[:-1]) > 0
                raw = data.tobytes()
                for row in range(len(first) - 1):
                    a, b = int(first[row]), int(first[row + 1])
                    n_words.append(b - a)
                    items.append(sorted(found.get(row, ())))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                    if not cut:
                        texts.append(hashlib.sha256(raw[offsets[row] : offsets[row + 1]]).hexdigest())
                        continue
                    text, last = [], int(offsets[row])
                    for x, y in edges.reshape(-1, 2):
                        text.append(raw[last : start[a + x]])
                        last = int(end[a + y - 1])
                    texts.append(b"".join([*text, raw[last : offsets[row + 1]]]).decode())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64())), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "spans", "items", "clean_text"],
            )

    schema = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<long>, clean_text string"
    return documents.mapInArrow(run, schema)


def _merge(spans: str):
    """Merge sorted spans that overlap or touch."""
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))).cast(kind),
    )


def scan(documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_words: int = 1, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans (covered words), items, clean_text (without those words) for every document.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. The windows
    of the benchmark go to the executors as one broadcast set; more than block_windows of them are split by
    their hash into blocks of about that size, each scanned against all documents, and each document's
    findings are merged before its words are cut. Hits are verified against the words themselves.

    Null or empty texts have no words, spans or items. An empty benchmark hits nothing; repeated items all
    count. Items of under min_words words are left out. A repeated doc_id gives a row each.
    """
    spark = tune(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    windows = save(benchmark_windows(benchmark, n, item_col, "text", min_words))
    blocks = -(-windows.count() // block_windows)
    if blocks <= 1:
        return _scan(docs, windows)
    out = None
    for i in range(blocks):
        part = _scan(docs, windows.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == i), cut=False).where(F.size("spans") > 0)
        part = part.select("doc_id", "clean_text", "spans", "items")
        out = save(part) if out is None else out.unionByName(save(part))
    # Rows that repeat an id may have different texts: findings belong to the id and a hash of the text.
    merged = out.groupBy("doc_id", F.col("clean_text").alias("mark")).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = merged.select(F.col("doc_id").alias("found_id"), "mark", _merge("spans").alias("spans"), "items")
    rows = docs.join(found, docs["doc_id"].eqNullSafe(F.col("found_id")) & (F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col("mark")), "left")
    kinds = "array<struct<start:int,end:int>>"
    return _cut(rows.select("doc_id", "text", F.coalesce("spans", F.array().cast(kinds)).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items")))


def digest(scanned: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
