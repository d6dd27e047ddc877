"""Phrase collocation mining: multikey three-way quicksort of suffix pointers, routed by their leading words.

Every word of a piece begins a suffix of up to three words. Blocks of text send their suffixes, equal ones as one with
their number, to the bucket of their leading words; a bucket sorts them by one word after the other, and the size of a
partition of suffixes equal in their first words is the number of times these words occur. Partitions smaller than the
least count are abandoned, with all that they hold. A leading word with more than a bucket's share of all words doesn't
decide alone: the next word does too, and a pair of such words is counted apart from its third words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _U, mix, prefix_hash, save, span_hash, text_blocks, tune

#: Words that a task gathers before it sends their suffixes; words of a bucket, about; buckets for each shuffle partition, at least.
FLUSH, BUCKET_WORDS, BUCKETS_EACH = 3_000_000, 2_000_000, 8
#: There are at most so many common words (each has a larger share of all words than one of so many), of at most so many
#: bytes: what is broadcast is bounded. A longer word that is as frequent has its own bucket.
COMMON, COMMON_BYTES = 1 << 18, 256
#: Partitions up to this size are sorted plainly.
SMALL = 256
_NONE = -1

_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of texts, whether each ends a piece, and each one's text."""
    lower = _LOWER[data]
    kind = ~(_GAP | _BREAK)[lower]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = kind.copy()
    begins[1:] &= ~kind[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    ends = kind.copy()
    ends[:-1] &= ~kind[1:] | edge[1:-1]
    end = np.flatnonzero(ends) + 1
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    names = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(lower[kind])])
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_BREAK[data], out=breaks[1:])
    text = np.searchsorted(offsets, start, "right") - 1
    last = np.ones(len(start), bool)
    last[:-1] = (breaks[start[1:]] > breaks[end[:-1]]) | (text[1:] > text[:-1])
    return names.dictionary_encode(), last, text


def _documents(documents: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


class _Gathered:
    """Words of blocks of texts under one dictionary, with their languages."""

    def __init__(self):
        self.words: list[pa.DictionaryArray] = []
        self.langs: list[pa.Array] = []
        self.last: list[np.ndarray] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch):
        """Takes a batch's texts, and yields itself whenever it holds enough."""
        for i, _, data, offsets in text_blocks(batch.column(1)):
            words, last, text = _split(data, offsets)
            if len(last):
                self.words.append(words)
                self.langs.append(batch.column(0).take(pa.array(text + i)).dictionary_encode())
                self.last.append(last)
                self.n += len(last)
            if self.n >= FLUSH:
                yield self

    def take(self) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Names and number of each word, names and number of each language, ends of pieces; then it is empty."""
        words, langs = (pa.chunked_array(x).unify_dictionaries().combine_chunks() for x in (self.words, self.langs))
        last = np.concatenate(self.last)
        self.__init__()
        return words.dictionary, words.indices.to_numpy(), langs.dictionary, langs.indices.to_numpy().astype(np.int64), last


def word_counts(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, f of each word of each language."""

    def counted(got: _Gathered) -> pa.RecordBatch:
        names, word, langs, lang, _ = got.take()
        key, f = np.unique(lang * len(names) + word, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(key // len(names))).cast(pa.string()), names.take(pa.array(key % len(names))).cast(pa.large_string()).cast(pa.string()), pa.array(f)], ["lang", "word", "f"]
        )

    def run(batches):
        got = _Gathered()
        for batch in batches:
            for full in got.add(batch):
                yield counted(full)
        if got.n:
            yield counted(got)

    rows = _documents(documents, lang_col, text_col).mapInArrow(run, "lang string, word string, f long")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _hash(names: pa.Array) -> np.ndarray:
    """A hash of each of some binary names."""
    out = [np.zeros(0, _U)]
    for _, _, data, offsets in text_blocks(names):
        out.append(span_hash(prefix_hash(data), offsets[:-1], offsets[1:]))
    return np.concatenate(out)


def _fused(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), _U)
    for p in parts:
        out = mix(out + p)
    return out


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)


def _packed(**columns: pa.Array) -> bytes:
    table = pa.table({name: _one(values) for name, values in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows of sorted columns begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _suffixes(words: np.ndarray, lang: np.ndarray, last: np.ndarray, none: int) -> tuple[np.ndarray, ...]:
    """The different suffixes of two or three words: language, the words (none for a missing third), how often each occurs, sorted."""
    second, third = np.full((2, len(words)), none, np.int64)
    second[:-1] = np.where(last[:-1], none, words[1:])
    third[:-1] = np.where(last[:-1], none, second[1:])
    at = np.flatnonzero(second < none)
    lang, first, second, third = lang[at], words[at].astype(np.int64), second[at], third[at]
    base = none + 1
    if (int(lang.max(initial=0)) + 1) * base**3 < 1 << 63:
        key, n = np.unique(((lang * base + first) * base + second) * base + third, return_counts=True)
        key, third = np.divmod(key, base)
        key, second = np.divmod(key, base)
        lang, first = np.divmod(key, base)
        return lang, first, second, third, n
    order = np.lexsort((third, second, first, lang))
    columns = [c[order] for c in (lang, first, second, third)]
    at = _runs_of(*columns)
    return *(c[at] for c in columns), np.diff(np.append(at, len(order)))


#: Kinds of suffixes: their pairs and triples are counted in one bucket, only their triples, only their pairs.
_WHOLE, _TRIPLE, _PAIR = range(3)


def _blobs(got: _Gathered, buckets: int, common: pa.Array) -> pa.RecordBatch:
    """bucket, blob: the different suffixes of gathered words and how often each occurs, packed for every bucket that has some."""
    names, words, langs, lang, last = got.take()
    none = len(names)
    lang, a, b, c, n = _suffixes(words, lang, last, none)
    often = np.append(pc.is_in(names, common).to_numpy(zero_copy_only=False), False)
    both = often[a] & often[b]
    at = np.flatnonzero(both)
    first = at[_runs_of(lang[at], a[at], b[at])] if len(at) else at
    pairs = np.add.reduceat(np.where(both, n, 0), first) if len(first) else first
    keep = ~both | (c < none)
    kind = np.concatenate([np.where(both[keep], _TRIPLE, _WHOLE), np.full(len(first), _PAIR)]).astype(np.int8)
    n = np.concatenate([n[keep], pairs])
    lang, a, b = (np.concatenate([v[keep], v[first]]) for v in (lang, a, b))
    c = np.concatenate([c[keep], np.full(len(first), none)])
    hashes, of_lang = np.append(_hash(names), _U(0)), _hash(langs.cast(pa.binary()))
    second = np.where(often[a], mix(hashes[b] + _U(1)), _U(0))
    third = np.where(kind == _TRIPLE, mix(hashes[c] + _U(2)), _U(0))
    bucket = (_fused(of_lang[lang], hashes[a], second, third) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begin = _runs_of(bucket[order]).tolist() if len(order) else []
    out: dict[str, list] = {"bucket": [], "blob": []}
    for i, j in zip(begin, [*begin[1:], len(order)], strict=True):
        rows = order[i:j]
        used, local = np.unique(np.stack([a[rows], b[rows], c[rows]]), return_inverse=True)
        local = local.reshape(3, -1).astype(np.int32)
        if used[-1] == none:
            used = used[:-1]
            local[local == len(used)] = _NONE
        blob = _packed(
            words=names.take(pa.array(used)), langs=langs, lang=pa.array(lang[rows].astype(np.int32)), kind=pa.array(kind[rows]),
            a=pa.array(local[0]), b=pa.array(local[1]), c=pa.array(local[2]), n=pa.array(n[rows].astype(np.int64)),
        )
        out["bucket"].append(int(bucket[rows[0]]))
        out["blob"].append(blob)
    return pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))


def frequent_prefixes(keys: np.ndarray, n: np.ndarray, least: int, from_depth: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Multikey three-way quicksort of pointers to rows of keys, (depths, rows): (pointers, sizes, depth) of the partitions
    of rows equal up to a depth, each by one of its pointers, whose rows' n sum to `least` at least; smaller ones are
    abandoned. A negative key ends a row. Depths before from_depth only sort.
    """
    out = []
    stack = [(np.arange(keys.shape[1]), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 1 or n[rows].sum() < least:
            continue
        if len(rows) <= SMALL:
            rows = rows[np.lexsort(keys[:depth - 1 if depth else None:-1, rows])]
            for d in range(max(depth, from_depth), len(keys)):
                begin = _runs_of(*keys[depth : d + 1, rows])
                size = np.add.reduceat(n[rows], begin)
                good = (size >= least) & (keys[d, rows[begin]] >= 0)
                if good.any():
                    out.append((rows[begin[good]], size[good], d))
            continue
        key = keys[depth, rows]
        sample = np.sort(key[:: max(1, len(key) // 9)])
        pivot = sample[len(sample) // 2]
        below, above = key < pivot, key > pivot
        stack += [(rows[below], depth), (rows[above], depth)]
        equal = rows[~(below | above)]
        size = n[equal].sum()
        if pivot >= 0 and size >= least:
            if depth >= from_depth:
                out.append((equal[:1], np.array([size]), depth))
            if depth + 1 < len(keys):
                stack.append((equal, depth + 1))
    return out


_PHRASES = "lang string, w1 string, w2 string, w3 string, a long"


def _bucket_phrases(blobs: pa.Table, least: int) -> pa.Table:
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs["blob"].combine_chunks()]
    flat = lambda name: [p[name].chunk(0).flatten() for p in parts]

    def renumbered(names: list[pa.Array], columns: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
        every = pa.chunked_array(names).dictionary_encode().combine_chunks()
        to, at, out = every.indices.to_numpy(), 0, []
        for own, column in zip(names, columns, strict=True):
            out.append(np.where(column < 0, _NONE, to[at : at + len(own)][column]))
            at += len(own)
        return every.dictionary, out

    three = [np.stack([p[k].chunk(0).flatten().to_numpy() for k in "abc"]) for p in parts]
    names, three = renumbered(flat("words"), three)
    langs, lang = renumbered(flat("langs"), [x.to_numpy() for x in flat("lang")])
    kind = np.concatenate([x.to_numpy() for x in flat("kind")]).astype(np.int32)
    lead = np.concatenate(lang) * 3 + kind
    keys = np.vstack([lead[None], np.concatenate(three, axis=1)]).astype(np.int32)
    n = np.concatenate([x.to_numpy() for x in flat("n")])
    out = {name: [] for name in ("lang", "w1", "w2", "w3", "a")}
    string = lambda i: names.take(i).cast(pa.large_string()).cast(pa.string())
    for depth, other in ((2, _TRIPLE), (3, _PAIR)):
        found = [(p, s) for p, s, d in frequent_prefixes(keys, n, least, 2) if d == depth]
        rows = np.concatenate([p for p, _ in found] or [np.zeros(0, np.int64)])
        size = np.concatenate([s for _, s in found] or [np.zeros(0, np.int64)])
        fits = kind[rows] != other
        rows = rows[fits]
        out["lang"].append(langs.take(pa.array(keys[0, rows] // 3)).cast(pa.string()))
        for q in (1, 2, 3):
            out[f"w{q}"].append(string(pa.array(keys[q, rows])) if q <= depth else pa.nulls(len(rows), pa.string()))
        out["a"].append(pa.array(size[fits].astype(np.int64)))
    return pa.table({name: pa.chunked_array(columns) for name, columns in out.items()})


def phrase_counts(documents: DataFrame, words: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, w1, w2, w3 (null in pairs), a of the phrases of two and three words with a >= least; words as word_counts gives."""
    spark = documents.sparkSession
    total = words.agg(F.sum("f")).first()[0] or 0
    buckets = max(BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WORDS))
    rare = total / min(COMMON, 2 * buckets)
    often = words.where((F.col("f") > rare) & (F.octet_length("word") <= COMMON_BYTES)).select("word").distinct()
    common = spark.sparkContext.broadcast([r[0].encode() for r in often.collect()])

    def run(batches):
        often, got = pa.array(common.value, pa.large_binary()), _Gathered()
        for batch in batches:
            for full in got.add(batch):
                yield _blobs(full, buckets, often)
        if got.n:
            yield _blobs(got, buckets, often)

    blobs = _documents(documents, lang_col, text_col).mapInArrow(run, "bucket int, blob binary")
    return blobs.groupBy("bucket").applyInArrow(lambda table: _bucket_phrases(table, least), _PHRASES)


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact up to counts of 10 ** 15."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"(cast(cast(1000000 as decimal(7, 0)) * cast({wide(a)} * {wide(a)} as decimal(30, 0)) as decimal(38, 0)) div ({wide(l)} * {wide(r)}))")


def collocations(documents: DataFrame, least: int = 10, share: int = 50, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to three words.

    Words are runs of anything but spaces and tabs in the pieces between .,;:!? and line ends, A-Z in lower case. A
    phrase that occurs `least` times is a candidate; its score is that of the cut into two parts with the lowest
    floor(1000000 * a * a / (l * r)), the first of equal ones. Pairs that a triple holds in `share` percent of their
    occurrences are dropped. Ranks go by score, then a, both from the highest, then the phrase's bytes; top=None keeps all.

    Null texts have no words; a null language is `und`. Repeated rows count each. An empty table gives no phrases, and
    other columns are ignored.
    """
    spark = tune(documents.sparkSession)
    words = save(word_counts(documents, lang_col, text_col))
    found = save(phrase_counts(documents, words, least, lang_col, text_col))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = words.where(F.col("f") >= least)
    pairs, triples = found.where("w3 is null").drop("w3"), found.where("w3 is not null")
    f = lambda word, name: single.select("lang", F.col("word").alias(word), F.col("f").alias(name))
    holds = (
        triples.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
        .groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))
        .agg(F.max("a").alias("most"))
    )
    two = (
        pairs.join(holds, ["lang", "w1", "w2"], "left")
        .where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
        .join(f("w1", "l"), ["lang", "w1"])
        .join(f("w2", "r"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    )
    cut = lambda l, r: F.struct(_score("a", l, r).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    three = (
        triples.join(f("w1", "l1"), ["lang", "w1"])
        .join(f("w3", "r2"), ["lang", "w3"])
        .join(pairs.select("lang", "w1", "w2", F.col("a").alias("l2")), ["lang", "w1", "w2"])
        .join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["lang", "w2", "w3"])
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut("l1", "r1").alias("x"), cut("l2", "r2").alias("y"))
        .withColumn("cut", F.when(F.col("y.score") < F.col("x.score"), F.col("y")).otherwise(F.col("x")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    best = two.unionByName(three)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The query's rows in plain SQL, with all n-grams as joins of numbered words."""
    return r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(range(len(p))) as piece, unnest(p) as text
  from (select lang, row_number() over () as doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents)
), words as (
  select lang, doc_id, piece, unnest(range(len(w))) as i, unnest(w) as w from (select lang, doc_id, piece, regexp_extract_all(text, '[^\x20\x09]+') as w from pieces)
), threes as (
  select lang, w as w1, lead(w) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by lang, doc_id, piece order by i)
), f1 as (select lang, w1, count(*) as f from threes group by all),
f2 as (select lang, w1, w2, count(*) as a from threes where w2 is not null group by all having count(*) >= 10),
f3 as (select lang, w1, w2, w3, count(*) as a from threes where w3 is not null group by all having count(*) >= 10),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
kept2 as (
  select * from f2 where not exists (select 1 from f3 where f3.lang = f2.lang and f3.w1 = f2.w1 and f3.w2 = f2.w2 and 100 * f3.a >= 50 * f2.a)
  and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w2 = f2.w1 and f3.w3 = f2.w2 and 100 * f3.a >= 50 * f2.a)
), cuts as (
  select k.lang, k.w1 || ' ' || k.w2 as phrase, k.a, 1 as k, x.f as l, y.f as r from kept2 k join f1 x on x.lang = k.lang and x.w1 = k.w1 join f1 y on y.lang = k.lang and y.w1 = k.w2
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 1, x.f, y.a from f3 t join f1 x on x.lang = t.lang and x.w1 = t.w1 join f2 y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 2, x.a, y.f from f3 t join f2 x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join f1 y on y.lang = t.lang and y.w1 = t.w3
), scored as (
  select lang, phrase, a, l, r, k, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best
)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join n on n.lang = ranked.lang where rank <= 2000
"""
