"""Exact substring deduplication: repeated byte strings across documents, by suffix arrays of anchored contexts.

Every string of LENGTH bytes holds one anchor: the GRAM-byte string in it with the least hash. Equal
strings hold equal anchors at equal places, so strings only need to be compared within an anchor's key.
Around an anchor lies its context, the bytes that strings with this anchor can reach. Equal contexts settle each
other; different ones are cut down to what the nearest other context of the key shares with them on either side, and a
suffix array of what is left tells which strings they share. Bytes decide, never hashes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, drop, mix, prefix_hash, save, text_blocks, tune, _Powers
from .suffix_groups import suffix_array

#: Bytes of a string, and of its anchor.
LENGTH, GRAM = 50, 20
#: Anchors of one key that meet in one task at most (some 20 MB of contexts, and ten times that while they are solved); those of
#: larger keys are compared by aggregations of their strings, with the same result.
KEY_ROWS = 200_000
#: Rows that are solved together (whole keys), letters that are sorted at a time, and bytes whose anchors are sought at a time.
SOLVE_ROWS, SORT_LETTERS, ANCHOR_BYTES = 40_000, 200_000, 1 << 17


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of that width, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the anchors of all strings within rows; ties within a string are all anchors."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = prefix_hash(data)
    h = (prefix[gram:] - prefix[:-gram]) * _Powers.down[: n - gram + 1]
    order = (h >> _U(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(order, width, np.minimum)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    least[row[: n - length + 1] != row[length - 1 :]] = 0
    pad = np.zeros(width - 1, np.uint32)
    found = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == order)
    return found, mix(h[found]).view(np.int64)


def _anchor_rows(length: int, gram: int, places: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, offsets in text_blocks(batch.column(1), ANCHOR_BYTES):
                found, keys = anchors(data, offsets, length, gram)
                row = np.searchsorted(offsets, found, "right") - 1
                cols = [pa.array(keys), pa.array(ids[i + row])] + ([pa.array((found - offsets[row]).astype(np.int32))] if places else [])
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "pos"][: len(cols)])

    return run


CONTEXT = "key long, doc_id long, pos int, left int, context binary"


def _contexts(length: int, gram: int, crowded: bool):
    """From (doc_id, text, places: twice the anchor's position, and one more in a crowded key) the contexts of one kind of key."""
    reach = length - gram

    def run(batches):
        for batch in batches:
            ids, texts, places = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            keys, contexts, lefts, docs, found = [], [], [], [], []
            for row in range(batch.num_rows):
                at = np.unique(places[row].values.to_numpy()).astype(np.int64)
                at = at[(at & 1) == crowded] >> 1
                if not len(at):
                    continue
                raw = texts[row].as_py().encode()
                at = at[at + gram <= len(raw)]
                contexts += [raw[p - reach if p > reach else 0 : p + gram + reach] for p in at.tolist()]
                letters = np.frombuffer(raw, np.uint8)
                h = np.zeros(len(at), _U)
                for j in range(gram):
                    h = h * _U(0x9E3779B97F4A7C15) + letters[at + j] + _U(1)
                keys.append(mix(h).view(np.int64))
                lefts.append(np.minimum(at, reach).astype(np.int32))
                docs.append(np.full(len(at), ids[row]))
                found.append(at.astype(np.int32))
            if keys:
                cols = [*(pa.array(np.concatenate(x)) for x in (keys, docs, found, lefts)), pa.array(contexts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "pos", "left", "context"])

    return run


def _side(data: np.ndarray, first: np.ndarray, step: int, size: np.ndarray, width: int) -> np.ndarray:
    """For each row the bytes at first, first + step, ... (size of them), then zeros."""
    at = np.arange(width)
    inside = at < size[:, None]
    return data[np.where(inside, first[:, None] + step * at, 0)] * inside


def _numbers(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows of columns together, and the number of each sorted row's run; bytes are read eight at a time."""
    keys = []
    for c in columns:
        keys += [np.ascontiguousarray(c).view(">u8")[:, i].astype(_U) for i in range(c.shape[1] // 8)] if c.ndim == 2 else [c]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new) - 1


def _shared(unit: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading bytes of a side at most a row shares with another one of its unit; -1 if it is alone there."""
    order, _ = _numbers(unit, side)
    s, u, n = side[order], unit[order], size[order]
    differ = s[1:] != s[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    same = np.where(u[1:] == u[:-1], np.minimum(same, np.minimum(n[1:], n[:-1])), -1)
    out = np.full(len(order), -1)
    out[order[1:]] = same
    out[order[:-1]] = np.maximum(out[order[:-1]], same)
    return out


def suffix_shared(unit: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, docs: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest number of bytes before the anchor with which a string of each context (a row) also occurs, in the same
    unit, in a context of a lower document; the first is above the second where none does. Rows are sorted by unit.

    The contexts are written one after the other, the anchor as one letter for each unit, and their suffixes are sorted;
    equal strings are then neighbours.
    """
    low, high = np.full(len(unit), reach + 1), np.full(len(unit), -1)
    size = n_before + n_after + 2
    i = 0
    while i < len(unit):
        j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), SORT_LETTERS, "right")) + i)
        if j < len(unit):
            j = int(np.searchsorted(unit, unit[j], "left"))
            j = j if j > i else int(np.searchsorted(unit, unit[i], "right"))
        n, l, r = size[i:j], n_before[i:j], n_after[i:j]
        at = np.cumsum(n) - n
        row = np.repeat(np.arange(j - i), n)
        k = np.arange(len(row)) - at[row] - l[row]  # place of a letter from its anchor
        text = np.full(len(row), 1)
        text[k < 0] = before[i:j][row, np.maximum(-k - 1, 0)][k < 0].astype(np.int64) + 2
        text[k == 0] = 258 + unit[i:j] - unit[i]
        right = (k > 0) & (k <= r[row])
        text[right] = after[i:j][row[right], k[right] - 1].astype(np.int64) + 2
        start = np.flatnonzero((k <= 0) & (r[row] - reach >= k))
        order = suffix_array(text)
        which = np.zeros(len(text), bool)
        which[start] = True
        s = order[which[order]]
        if len(s):
            same = np.ones(len(s) - 1, bool)
            for step in range(reach + 1):
                same &= text[s[1:] + step] == text[s[:-1] + step]
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            own = docs[i:j][row[s]]
            hit = s[own > np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(s))))]
            np.minimum.at(low, i + row[hit], -k[hit])
            np.maximum.at(high, i + row[hit], -k[hit])
        i = j
    return low, high


def solve(rows: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """doc_id, start, end: bytes to remove, for all anchors (CONTEXT) of some keys."""
    reach = length - gram
    width = -(-reach // 8) * 8
    column = rows["context"].combine_chunks()
    data, at = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    key, doc, pos, left = (rows[c].to_numpy() for c in ("key", "doc_id", "pos", "left"))
    left = left.astype(np.int64)
    right = at[1:] - at[:-1] - left - gram
    before, after = _side(data, at[:-1] + left - 1, -1, left, width), _side(data, at[:-1] + left + gram, 1, right, width)
    anchor = _side(data, at[:-1] + left, 1, np.full(len(left), gram), -(-gram // 8) * 8)
    # Rows with equal contexts are one, of the least document.
    order, one = _numbers(key, anchor, before, after, left, right)
    first = np.flatnonzero(np.diff(one, prepend=-1))
    least = np.minimum.reduceat(doc[order], first)
    some = order[first]
    _, unit = _numbers(key[some], anchor[some])  # sorted so already
    b, a, nb, na = before[some], after[some], left[some], right[some]
    nb, na = _shared(unit, b, nb), _shared(unit, a, na)
    live = np.flatnonzero((nb >= 0) & (na >= 0) & (nb + na >= reach))
    low, high = np.full(len(some), reach + 1), np.full(len(some), -1)
    if len(live):
        u, nb, na = unit[live], nb[live], na[live]
        steps = np.arange(width)
        b, a = b[live] * (steps < nb[:, None]), a[live] * (steps < na[:, None])
        # What may be shared, if equal, is one again.
        o2, part = _numbers(u, b, a, nb, na)
        f2 = np.flatnonzero(np.diff(part, prepend=-1))
        top = o2[f2]
        lowest = np.minimum.reduceat(least[live][o2], f2)
        several = np.flatnonzero(np.bincount(u[top], minlength=unit[-1] + 1)[u[top]] > 1)
        low2, high2 = np.full(len(top), reach + 1), np.full(len(top), -1)
        t = top[several]
        low2[several], high2[several] = suffix_shared(u[t], b[t], nb[t], a[t], na[t], lowest[several], reach)
        above = least[live][o2] > lowest[part]
        low[live[o2]] = np.where(above, reach - na[o2], low2[part])
        high[live[o2]] = np.where(above, nb[o2], high2[part])
    above = doc[order] > least[one]
    lo = np.where(above, np.maximum(0, reach - right[order]), low[one])
    hi = np.where(above, np.minimum(left[order], reach), high[one])
    hit = np.flatnonzero(lo <= hi)
    p = pos[order[hit]].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc[order[hit]]), pa.array((p - hi[hit]).astype(np.int32)), pa.array((p - lo[hit] + length).astype(np.int32))], ["doc_id", "start", "end"])


def _solved(length: int, gram: int):
    """solve() on runs of whole keys of batches sorted by key."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < SOLVE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if cut:
                yield solve(table.slice(0, cut), length, gram)
            held = table.slice(cut).to_batches()
            n -= cut
        if n:
            yield solve(pa.Table.from_batches(held), length, gram)

    return run


def _strings(length: int, gram: int):
    """cid, back, string, doc: each string of the contexts of crowded keys."""
    reach = length - gram

    def run(batches):
        for batch in batches:
            out = {"cid": [], "back": [], "string": [], "doc": []}
            for cid, c, left, doc in zip(*(batch.column(x).to_pylist() for x in ("cid", "context", "left", "doc")), strict=True):
                for o in range(max(0, reach - (len(c) - left - gram)), min(left, reach) + 1):
                    out["cid"].append(cid)
                    out["back"].append(o)
                    out["string"].append(c[left - o : left - o + length])
                    out["doc"].append(doc)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("cid", pa.int64()), ("back", pa.int32()), ("string", pa.binary()), ("doc", pa.int64())]))

    return run


def _settled(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, start, end for the anchors (CONTEXT) of crowded keys, whatever their number.

    Equal contexts are one by an aggregation, which combines before it shuffles; so are equal strings of the different
    ones. Both are compared as bytes.
    """
    reach = length - gram
    spark = rows.sparkSession
    rows = save(rows)
    # Numbered once, in a written table.
    contexts = save(rows.groupBy("context", "left").agg(F.min("doc_id").alias("doc")).withColumn("cid", F.monotonically_increasing_id()))
    strings = save(contexts.mapInArrow(_strings(length, gram), "cid long, back int, string binary, doc long"))
    first = strings.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("string", "least")
    hits = strings.join(first, "string").where("least < doc").groupBy("cid").agg(F.min("back").alias("lo"), F.max("back").alias("hi"))
    verdict = save(contexts.join(hits, "cid", "left").select(F.col("context"), F.col("left"), "doc", "lo", "hi"))
    right = F.octet_length("context") - F.col("left") - gram
    later = F.col("doc_id") > F.col("doc")
    lo, hi = F.when(later, F.greatest(F.lit(0), reach - right)).otherwise(F.col("lo")), F.when(later, F.least("left", F.lit(reach))).otherwise(F.col("hi"))
    out = rows.join(verdict, ["context", "left"]).select("doc_id", (F.col("pos") - hi).alias("start"), (F.col("pos") - lo + length).alias("end"), lo.alias("lo"), hi.alias("hi"))
    out = save(out.where("lo <= hi").select("doc_id", "start", "end"))
    for table in (rows, contexts, strings, verdict):
        drop(spark, table)
    return out


def _pairs(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's list of longs; None for a null."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    for i, known in enumerate(column.is_valid().to_numpy(zero_copy_only=False).tolist()):
        yield values[at[i] : at[i + 1]] if known else None


def _cut(batches):
    """From (doc_id, text, found: start and end in the halves of a long) what is left of each text."""
    for batch in batches:
        size, removed, spans, sha, kept = [], [], [], [], []
        for text, found in zip(batch.column(1).to_pylist(), _pairs(batch.column(2)), strict=True):
            raw = (text or "").encode()
            rest, gone, runs = raw, 0, 0
            if found is not None and len(raw):
                start, end = np.minimum(found >> 32, len(raw)), np.minimum(found & 0xFFFFFFFF, len(raw))
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                a, b = start[new], reach[np.append(new[1:], len(start)) - 1]
                a, b = a[a < b], b[a < b]
                gone, runs = int((b - a).sum()), len(a)
                rest = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            size.append(len(raw))
            removed.append(gone)
            spans.append(runs)
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def deduplicate_substrings(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for every document.

    Removed is every byte covered by a string of `length` bytes of the document that also starts in a document
    with a lower doc_id; strings are judged on the input.

    Only keys and places of anchors are shuffled for all of the corpus (about one anchor in fifteen bytes);
    contexts follow for keys of several documents. A key with more than key_rows anchors never meets in one task: see
    _settled. Texts are placed by doc_id twice, to cut contexts and to cut the texts themselves.

    A null text counts as empty; documents shorter than `length` keep all. Rows with a null id are dropped. Rows
    that repeat an id and its text get the same result each; an id with different texts has no defined result
    beyond not failing. Other columns are ignored. An empty table gives an empty result.
    """
    tune(documents.sparkSession)
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long_ = docs.where(F.octet_length("text") >= length)
    spark = documents.sparkSession
    keys = long_.mapInArrow(_anchor_rows(length, gram, False), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    keys = save(keys.where("lo < hi").select("key", (F.col("n") > key_rows).cast("int").alias("crowded")))
    places = long_.mapInArrow(_anchor_rows(length, gram, True), "key long, doc_id long, pos int").join(keys.hint("shuffle_hash"), "key")
    places = save(places.groupBy("doc_id").agg(F.collect_list(F.col("pos") * F.lit(2).cast("long") + F.col("crowded")).alias("places")))
    placed = save(long_.join(places, "doc_id").select("doc_id", "text", "places"))
    drop(spark, places)
    rows = placed.mapInArrow(_contexts(length, gram, False), CONTEXT).repartition("key").sortWithinPartitions("key")
    found = save(rows.mapInArrow(_solved(length, gram), "doc_id long, start int, end int"))
    if not keys.where("crowded = 1").isEmpty():
        found = found.unionByName(_settled(placed.mapInArrow(_contexts(length, gram, True), CONTEXT), length, gram))
    found = found.groupBy("doc_id").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")).alias("found"))
    for table in (keys, placed):
        drop(spark, table)
    out = docs.join(found, "doc_id", "left").select("doc_id", "text", "found")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
