"""Ranked lexical search: an index in shards of documents, searched by accumulators of short lists and skipping over long ones.

Documents become shards of posting lists of the queries' terms, written once. A task reads its shards in turn. For each
query the short lists of a shard are summed, a term at a time, into accumulators; these are then one more iterator, with
bounds of its own, beside the long lists, which are read a document at a time: blocks of documents, then documents, whose
bound is below the k-th score found so far are skipped. Each task keeps k documents a query; the best of all are the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, ALNUM, drop, save, text_blocks, tune, words

#: Bytes of the terms of one block of queries, which is broadcast; more queries are searched in several blocks.
BLOCK_QUERY_BYTES = 16 << 20
#: A list with more than this share of a shard's documents is long; documents whose bounds are kept together.
LONG, SKIP = 0.125, 64


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, times of each different term of each query; rows that repeat an id are one query."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1)):
                _, start, end, first = words(data, offsets, ALNUM)
                low = _LOWER[data].tobytes()
                terms = pa.array([low[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), np.diff(first)))), terms], ["item_id", "term"])

    source = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    return source.mapInArrow(run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))


class Terms:
    """Finds the numbers of given terms among words: by hash, then by the bytes themselves."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        hashes, start, end, _ = words(data, ends, ALNUM)
        self.number = {t: i for i, t in enumerate(terms)}
        self.hash, at, same = np.unique(hashes, return_index=True, return_counts=True)
        self.term, self.alone = at.astype(np.int64), same == 1
        self.size = (end - start)[at]
        self.head, self.tail = (x[at] for x in self._edges(data, start, end))

    @staticmethod
    def _edges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last eight bytes of each word, all of a shorter one twice."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        size = np.minimum(end - start, 8).astype(np.uint64)
        mask = np.where(size == 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (size % np.uint64(8)))) - np.uint64(1))
        return eight[start] & mask, eight[np.maximum(start, end - 8)] & mask

    def find(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, numbers of the terms)."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        place = np.flatnonzero(self.hash[at] == hashes)
        at, a, b = at[place], start[place], end[place]
        low = _LOWER[data]
        head, tail = self._edges(low, a, b)
        same = (b - a == self.size[at]) & (head == self.head[at]) & (tail == self.tail[at])
        term = np.where(same & self.alone[at], self.term[at], -1)
        for i in np.flatnonzero(~self.alone[at] | (same & (b - a > 16))).tolist():
            term[i] = self.number.get(low[a[i] : b[i]].tobytes(), -1)
        return place[term >= 0], term[term >= 0]


_SHARD = "doc_ids array<long>, n array<long>, terms array<int>, sizes array<int>, docs array<int>, tf array<int>"


def index(documents: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: its documents with terms, how many terms each has, and the posting lists of given terms.

    Lists come in order of the term, their documents (places in doc_ids) ascend.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Terms(terms))

    def run(batches):
        wanted = shared.value
        for batch in batches:
            n, docs, found = [], [], []
            for i, _, data, offsets in text_blocks(batch.column(1)):
                hashes, start, end, first = words(data, offsets, ALNUM)
                n.append(np.diff(first))
                place, term = wanted.find(data, hashes, start, end)
                docs.append(np.searchsorted(first, place, "right") - 1 + i)
                found.append(term)
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            held = np.flatnonzero(n)
            if not len(held):
                continue
            where = np.cumsum(n > 0) - 1
            key, tf = np.unique(np.concatenate(found) * len(held) + where[np.concatenate(docs)], return_counts=True)
            term, doc = np.divmod(key, len(held))
            terms_, sizes = np.unique(term, return_counts=True)
            columns = [batch.column(0).take(pa.array(held)).to_numpy(), n[held].astype(np.int64), *(x.astype(np.int32) for x in (terms_, sizes, doc, tf))]
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, k)) for c, k in zip(columns, kinds, strict=True)], [p.split()[0] for p in _SHARD.split(", ")])

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return docs.mapInArrow(run, _SHARD)


@dataclass
class Plan:
    """A block of queries with the corpus's numbers: item ids, the first entry of each, terms, times; weights of terms, N, L."""

    items: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray
    documents: int
    words: int


class Searcher:
    """The k best documents of each query over the shards that it is given, and how many documents it scored in full."""

    def __init__(self, plan: Plan, k: int):
        self.plan, self.k = plan, k
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(plan.items)
        self.least = np.ones(len(plan.items), np.int64)
        self.scored = 0

    def add(self, doc_ids: np.ndarray, n: np.ndarray, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> None:
        plan, count = self.plan, len(doc_ids)
        m = 25 + (75 * n * plan.documents) // plan.words
        tf = tf.astype(np.int64)
        impact = np.repeat(plan.weight[terms], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        begin = np.cumsum(sizes) - sizes
        # Long lists lie flat, so that a document's entry is found without reading those before it.
        is_long = sizes > LONG * count
        long_at = np.cumsum(is_long) - 1
        blocks = -(-count // SKIP)
        flat = np.zeros((int(is_long.sum()), blocks * SKIP), np.int64)
        of = np.repeat(is_long, sizes)
        flat[np.repeat(long_at, sizes)[of], docs[of]] = impact[of]
        tops = flat.reshape(len(flat), blocks, SKIP).max(axis=2)
        where = np.full(len(plan.weight), -1, np.int64)
        where[terms] = np.arange(len(terms))
        lists, hit = where[plan.term], where[plan.term] >= 0
        for q in range(len(plan.items)):
            part = slice(plan.first[q], plan.first[q + 1])
            mine, times = lists[part][hit[part]], plan.times[part][hit[part]]
            short = ~is_long[mine]
            summed = self._accumulate(begin[mine[short]], sizes[mine[short]], times[short], docs, impact, blocks * SKIP)
            self._merge(q, summed, flat, tops, long_at[mine[~short]], times[~short], doc_ids)

    @staticmethod
    def _accumulate(begin, size, times, docs, impact, count) -> np.ndarray:
        """A term at a time: the sums of short lists by document."""
        out = np.zeros(count, np.int64)
        if len(begin):
            at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
            np.add.at(out, docs[at], impact[at] * np.repeat(times, size))
        return out

    def _merge(self, q: int, summed, flat, tops, long, times, doc_ids) -> None:
        """A document at a time, by blocks: the accumulators and the long lists, in order of their bounds, skipping what can't reach the k-th score."""
        least = self.least[q]
        bounds = tops[long] * times[:, None]
        reach = summed.reshape(-1, SKIP).max(axis=1) + bounds.sum(axis=0)
        open_ = np.flatnonzero(reach >= least)
        if not len(open_):
            return
        block = np.repeat(open_, SKIP)
        docs = block * SKIP + np.tile(np.arange(SKIP), len(open_))
        score, rest = summed[docs], bounds[:, block].sum(axis=0)
        for i in np.argsort(-bounds.max(axis=1), kind="stable") if len(long) else ():
            go = score + rest >= least
            if not go.all():
                docs, block, score, rest = docs[go], block[go], score[go], rest[go]
            if not len(docs):
                return
            score = score + flat[long[i], docs] * times[i]
            rest = rest - bounds[i, block]
        good = score >= least
        if not good.any():
            return
        self.scored += int(good.sum())
        ids = np.concatenate([self.best[q][0], doc_ids[docs[good]]])
        score = np.concatenate([self.best[q][1], score[good]])
        order = np.lexsort((ids, -score))[: self.k]
        self.best[q] = ids[order], score[order]
        if len(order) == self.k:
            self.least[q] = score[order[-1]]


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def best(shards: DataFrame, plan: Plan, k: int) -> DataFrame:
    """item_id, doc_id, score: at least the k best of each query, from every task k at most."""
    shared = shards.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        search = Searcher(shared.value, k)
        for batch in batches:
            for row in range(len(batch)):
                search.add(*(_numbers(batch, name, row) for name in batch.schema.names))
        size = [len(ids) for ids, _ in search.best]
        both = [np.concatenate([b[i] for b in search.best] or [np.zeros(0, np.int64)]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(search.plan.items, size)), *map(pa.array, both)], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")


def _search(documents: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = documents.sparkSession
    rows = sorted((r["item_id"], bytes(r["term"]), r["times"]) for r in rows)
    terms = sorted({t for _, t, _ in rows})
    number = {t: i for i, t in enumerate(terms)}
    shards = save(index(documents, terms, id_col, text_col))
    total = shards.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    count, n_words = total[0] or 0, total[1] or 0
    lists = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    weight = np.zeros(len(terms), np.int64)
    for t, df in lists.collect():  # as many rows as the block has terms
        weight[t] = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
    items, first = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True)
    plan = Plan(items, np.append(first, len(rows)), np.array([number[t] for _, t, _ in rows], np.int64), np.array([x for _, _, x in rows], np.int64), weight, count, max(1, n_words))
    out = save(best(shards, plan, k))
    drop(spark, shards)
    return out


def search(documents: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each query.

    Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. A term weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))); a document has the sum of w * (10^9 tf div (1000 tf + 8m)) over the
    query's terms, repeats included, with m = 25 + (75 n N) div L. Equal scores rank by ascending doc_id.

    Null and empty texts have no terms and don't count in N. Documents and queries without an id are left out; rows
    that repeat a doc_id are documents of their own, rows that repeat an item_id are one query with the terms of all.
    Queries without a known term, and empty tables, have no rows. Other columns are ignored.
    """
    tune(documents.sparkSession)
    wanted = save(query_terms(queries, item_col, query_col))
    size = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_QUERY_BYTES)
    out = None
    for b in range(max(1, blocks)):
        part = wanted if blocks <= 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _search(documents, part.collect(), k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with d as (
  select row_number() over () as r, doc_id, {terms} as t from documents where text is not null and doc_id is not null
), docs as (select r, doc_id, len(t)::bigint as n from d where len(t) > 0),
stats as (select count(*) as n_docs, sum(n)::bigint as n_words from docs),
tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) group by all),
items as (select item_id, term, count(*) as times from (select item_id, unnest({terms}) as term from benchmark where item_id is not null) group by all),
weights as (
  select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, stats where term in (select term from items) group by term, n_docs
), scores as (
  select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::bigint as score
  from items join weights using (term) join tf using (term) join docs using (r), stats group by all
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
