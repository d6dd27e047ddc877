"""Search: exact vector neighbours in blocks of queries, and BM25 in blocks of query words."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import top_per_group

#: Doubles of one broadcast block of queries: 32 MB. More queries run in more blocks, each a scan of the vectors.
BLOCK_VALUES = 1 << 22
#: Queries that meet a batch of vectors in one matrix product.
STEP_QUERIES = 1024
#: Words of queries of one broadcast block, some 100 bytes each.
BLOCK_TERMS = 200_000


def cosine(a, b):
    """Cosine of two array columns in double precision; 0 for a missing, empty, zero or differently long one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, pick: the k vectors of the greatest cosine for each query, itself left out, among those of its length.

    Queries are broadcast in blocks of a fixed size. A task keeps the best k rows a query of all that it
    reads, so what is shuffled for the last ranking is k rows a query and task.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).cast("long"), vector_col).where(F.col(vector_col).isNotNull()).orderBy(id_col)
    blocks = asked.toLocalIterator(prefetchPartitions=True)
    out, held = None, []

    def one(rows):
        """A block's queries against all vectors of their own length."""
        found = None
        for width in sorted({len(r[1]) for r in rows}):
            same = [r for r in rows if len(r[1]) == width]
            shared = spark.sparkContext.broadcast((np.array([r[0] for r in same], np.int64), _unit(np.array([r[1] for r in same], np.float64).reshape(len(same), width))))
            part = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == width)
            part = part.mapInArrow(_best(shared, k, least), "query_id long, id long, score double")
            found = part if found is None else found.unionByName(part)
        return found

    size = 0
    for row in blocks:
        held.append(row)
        size += len(row[1])
        if size >= BLOCK_VALUES:
            part, held, size = one(held), [], 0
            out = part if out is None else out.unionByName(part)
    if held or out is None:
        part = one(held) if held else spark.createDataFrame([], "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    return top_per_group(out, ["query_id"], "score", "id", k)


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.nan_to_num(x)


def _best_of(parts, k):
    """Of (query, id, score) the k of each query with the greatest scores, ties by id."""
    query, own, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((own, -score, query))
    query, own, score = query[order], own[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[keep], own[keep], score[keep]


def _rows(found):
    for at in range(0, len(found[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in found], ["query_id", "id", "score"])


def _best(shared, k, least):
    def run(batches):
        ids, q = shared.value
        held, size = [], 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            x = _unit(np.array(batch.column(1).to_pylist(), np.float64).reshape(len(own), -1))
            n = min(k, len(own))
            for at in range(0, len(ids), STEP_QUERIES):
                asked = ids[at : at + STEP_QUERIES]
                score = q[at : at + STEP_QUERIES] @ x.T
                score[own[None] == asked[:, None]] = -2
                bound = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
                i, j = np.nonzero((score >= bound) & (score >= least))
                held.append((asked[i], own[j], score[i, j]))
                size += len(i)
                if size > max(1 << 20, 4 * k * len(ids)):
                    held = [_best_of(held, k)]
                    size = len(held[0][0])
        if held:
            yield from _rows(_best_of(held, k))

    return run


def tokens(text):
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def bm25(documents: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, pick for documents (id, text) and queries (query_id, text), ids being integers.

    One pass counts documents and the queries' words in them; a second scores each document against a
    broadcast block of BLOCK_TERMS words of queries and keeps the best k rows a query and task, so no row is made
    for a pair that merely shares a word. idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    Null texts have no words and count in N. Rows without an id are left out.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("id").cast("long"), "text").where("id is not null")
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).distinct()
    seen = documents.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    df = seen.groupBy("w").agg(F.count("*").alias("df"))
    whole = documents.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("mean")).first()
    terms = asked.join(df, "w").select("query_id", "w", F.log(1 + (whole["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).orderBy("query_id", "w")
    texts = documents.select("id", F.lower("text").alias("text"))
    out, held, last = None, [], None

    def one(rows):
        shared = spark.sparkContext.broadcast(_postings(rows))
        return texts.mapInArrow(_matches(shared, k, k1, b, whole["mean"] or 1.0), "query_id long, id long, score double")

    for row in terms.toLocalIterator(prefetchPartitions=True):
        if len(held) >= BLOCK_TERMS and row[0] != last:  # a query's words stay in one block
            part, held = one(held), []
            out = part if out is None else out.unionByName(part)
        held.append(row)
        last = row[0]
    if held or out is None:
        part = one(held) if held else spark.createDataFrame([], "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    return top_per_group(out, ["query_id"], "score", "id", k)


def _postings(rows):
    """(query ids, number of each word, first posting of each word, query and idf of each posting)."""
    ids, query = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(r[1], len(vocabulary)) for r in rows], np.int64)
    order = np.argsort(word, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(vocabulary)))])
    return ids, vocabulary, start, query[order], np.array([r[2] for r in rows])[order]


def _matches(shared, k, k1, b, mean):
    def run(batches):
        ids, vocabulary, start, query, idf = shared.value
        rows = max(1, (1 << 22) // len(ids))
        held, size = [], 0
        for batch in batches:
            own, texts = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, len(own), rows):
                few = own[at : at + rows]
                doc, word, weight = [], [], []
                for i in range(len(few)):
                    found = re.findall("[a-z0-9]+", texts[at + i].as_py() or "")
                    length = k1 * (1 - b + b * len(found) / mean)
                    for w, n in Counter(found).items():
                        number = vocabulary.get(w)
                        if number is not None:
                            doc.append(i)
                            word.append(number)
                            weight.append(n * (k1 + 1) / (n + length))
                if not doc:
                    continue
                doc, word, weight = np.array(doc), np.array(word), np.array(weight)
                many = start[word + 1] - start[word]
                post = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[word], many)
                cell = query[post] * len(few) + np.repeat(doc, many)
                score = np.bincount(cell, idf[post] * np.repeat(weight, many), len(ids) * len(few)).reshape(len(ids), len(few)).round(6)
                n = min(k, len(few))
                i, j = np.nonzero((score >= -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]) & (score > 0))
                held.append((ids[i], few[j], score[i, j]))
                size += len(i)
                if size > max(1 << 20, 4 * k * len(ids)):
                    held = [_best_of(held, k)]
                    size = len(held[0][0])
        if held:
            yield from _rows(_best_of(held, k))

    return run
