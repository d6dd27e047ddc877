"""Near-duplicate documents: MinHash bands, exact verification, components by large-star and small-star."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, NOT_SPACE, local_roots, mix, save, sequence_hash, text_blocks, tune, words
from .components import connected_components

#: Hashes computed for a document at most, and the chance that a pair at the threshold shares no band.
PERMUTATIONS, MISS = 160, 1e-5
#: Documents of a bucket that are compared in one block; larger buckets are split into pairs of blocks.
BLOCK_ROWS = 500
#: Ids that are broadcast to pick their texts (16 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at the threshold is missed with a chance under MISS."""
    s = percent / 100
    best = None
    for rows in range(1, 33):
        if s >= 1:
            return 1, 8
        bands = math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
        if bands * rows <= PERMUTATIONS:
            best = bands, rows
    return best or (PERMUTATIONS, 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, of all of them as one."""
    for i, j, data, offsets in text_blocks(column):
        hashes, _, _, first = words(data, offsets, NOT_SPACE)
        grams = sequence_hash(hashes, k)
        for row in range(j - i):
            a, b = first[row], first[row + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield sequence_hash(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, _U)


def signatures(documents: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, two fingerprints of the set, one key a band, and a byte of each minimum."""

    def run(batches):
        rng = np.random.default_rng(7919)
        a = rng.integers(0, 1 << 62, bands * rows, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        b = rng.integers(0, 1 << 62, bands * rows, dtype=np.int64).astype(_U)
        c = rng.integers(0, 1 << 62, rows, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        for batch in batches:
            n, fp1, fp2, keys, ends, minima = [], [], [], [], [0], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                fp1.append(np.add.reduce(mix(s ^ _U(0xA5A5A5A5)), dtype=_U) if len(s) else _U(0))
                fp2.append(np.add.reduce(mix(s + _U(0x51ED27)), dtype=_U) if len(s) else _U(0))
                if len(s):
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, _U)
                    for at in range(0, len(s), 1024):
                        low = np.minimum(low, (s[at : at + 1024, None] * a + b).min(axis=0))
                    minima.append((low >> _U(40)).astype(np.uint8).tobytes())
                    low = (low >> _U(20)).reshape(bands, rows)
                    keys.append(mix((mix(low) * c).sum(axis=1, dtype=_U)))
                else:
                    minima.append(b"")
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(fp1, _U).view(np.int64)),
                    pa.array(np.array(fp2, _U).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.array(minima, pa.binary()),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "keys", "minima"],
            )

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, minima binary")


def agreeing(n: int, percent: int) -> float:
    """Of n minima, how many agree at least in all but one of a million pairs at the threshold."""
    p = percent / 100
    return n * p - 4.8 * math.sqrt(n * p * (1 - p))


def _likely(pairs: DataFrame, sigs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree enough to be worth counting whole sets."""
    least = agreeing(n, percent)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    left = sigs.select(F.col("doc_id").alias("a"), F.col("minima").alias("x"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("minima").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]: one by one, or by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    column, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[inverse] > 1
    number = np.cumsum(times > 1) - 1
    row, cols = row[shared], number[inverse[shared]]
    width = int((times > 1).sum())
    if (sizes[a] + sizes[b]).sum() * 30 < len(sets) ** 2 * width / 5 + 1e4:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    order = np.argsort(cols, kind="stable")
    row, cols = row[order], cols[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, width, 2048):
        s, e = np.searchsorted(cols, [at, at + 2048])
        x = np.zeros((len(sets), min(2048, width - at)), np.float32)
        x[row[s:e], cols[s:e] - at] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def _blocks(n: int, percent: int, k: int):
    """Compare two blocks of a bucket: pairs of different components whose signatures agree enough are counted on
    their whole sets; out come the linked documents, each with the local root of its links."""
    least = agreeing(n, percent)

    def candidates(part):
        role = part["role"]
        left, right = np.flatnonzero((role != 2) & (role != 4)), np.flatnonzero((role != 1) & (role != 3))
        crossed = bool(len(role)) and role[0] >= 3  # the sides have no document in common
        doc, comp, hub, sig = part["doc_id"], part["comp"], part["hub"], part["minima"]
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            fit = (comp[rows, None] != comp[right]) & (crossed | (doc[rows, None] < doc[right])) & (doc[rows] != hub[rows])[:, None] & (doc[right] != hub[right])
            i, j = np.nonzero(fit)
            for x in range(0, len(i), 1 << 15):
                p, q = rows[i[x : x + (1 << 15)]], right[j[x : x + (1 << 15)]]
                good = (sig[p] == sig[q]).sum(axis=1) >= least
                yield p[good], q[good]

    def linked(part):
        found = list(candidates(part))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if not len(a):
            return None
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        sets = list(shingle_sets(pa.array([part["text"][i] for i in used.tolist()], pa.string()), k))
        size = np.array([len(s) for s in sets])
        both = _intersections(sets, a, b)
        ok = (both > 0) & (100 * both >= percent * (size[a] + size[b] - both))
        if not ok.any():
            return None
        roots = local_roots(len(used), a[ok], b[ok])
        far = np.flatnonzero(roots != np.arange(len(used)))
        doc = part["doc_id"][used]
        return pa.RecordBatch.from_arrays([pa.array(doc[roots[far]]), pa.array(doc[far])], ["a", "b"])

    def run(batches):
        def emit(part):
            cut = np.flatnonzero(np.diff(part["block"])) + 1
            for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(part["block"])]]), strict=True):
                out = linked({c: v[s:e] for c, v in part.items()})
                if out is not None:
                    yield out

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "role", "doc_id", "comp", "hub")}
            part["minima"] = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint8).reshape(-1, n)
            part["text"] = np.array(batch.column("text").to_pylist(), object)
            if rest is not None:
                part = {c: np.concatenate([rest[c], part[c]]) for c in part}
            last = int(np.searchsorted(part["block"], part["block"][-1], "left"))
            rest = {c: v[last:] for c, v in part.items()}
            if last:
                yield from emit({c: v[:last] for c, v in part.items()})
        if rest is not None:
            yield from emit(rest)

    return run


def block_roles(rest: DataFrame) -> DataFrame:
    """block, role, doc_id, comp, hub of (bucket, hub, doc_id, comp): for buckets with several components, the blocks in
    which all pairs of different components meet.

    Documents of a bucket's largest component need meet no other of it: blocks of BLOCK_ROWS of them meet blocks of the
    others, and these meet each other. So n documents of one component and a stranger make n rows and one for each of
    their blocks, whatever n is.
    """
    sizes = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("big"), F.count("*").alias("comps")).where("comps > 1 and all > 2")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    split = save(split.select("bucket", F.col("big.comp").alias("big"), blocks(F.col("big.n")).alias("many"), blocks(F.col("all") - F.col("big.n")).alias("few")))
    role = lambda kind, i, j, r: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(r).alias("role"))
    mine = lambda parts: F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int")
    each = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    among = F.when(F.col("few") == 1, F.array(role(0, F.lit(0), F.lit(0), 0))).otherwise(F.concat(F.transform(each("few"), lambda x: role(0, mine("few"), x, 1)), F.transform(each("few"), lambda x: role(0, x, mine("few"), 2))))
    roles = F.when(F.col("comp") == F.col("big"), F.transform(each("few"), lambda x: role(1, mine("many"), x, 3))).otherwise(F.concat(F.transform(each("many"), lambda x: role(1, x, mine("few"), 4)), among))
    rows = rest.join(split, "bucket").withColumn("r", F.explode(roles))
    return rows.select(F.xxhash64("bucket", "r.kind", "r.i", "r.j").alias("block"), "r.role", "doc_id", "comp", "hub")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            last_text, last = None, None
            left, right = batch.column(2), shingle_sets(batch.column(3), k)
            for row, y in enumerate(right):
                t = left[row].as_py()
                if t != last_text or last is None:
                    last_text, last = t, next(shingle_sets(pa.array([t], pa.string()), k))
                both = len(np.intersect1d(last, y, assume_unique=True))
                ok[row] = bool(both) and 100 * both >= percent * (len(last) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is percent/100
    or more, as counted on the whole sets; a component's id is its least doc_id.

    Documents with the same set are merged first (one aggregation), so copies of any number cost one row
    each. The others meet in the buckets of MinHash bands. In a bucket the least document is a hub, and every
    other one that its signature admits is verified against it; that leaves few components in a bucket.
    Buckets that still hold several are compared whole, signature by signature, in pairs of blocks, where
    pairs of different components that the signatures admit are counted on their sets; only linked documents
    come out, with a local root. So each pair that shares a bucket is compared or known to be connected, and
    no task or row set grows with a group's square.

    A text that is null, empty or blank has an empty set: n_shingles 0, a component of its own, kept.
    Ids must not be null or repeat: rows with a null id are dropped, repeated ids count as one document
    if their texts agree. Other columns are ignored. An empty table gives an empty result.
    """
    tune(documents.sparkSession)
    bands, rows = bands_for(percent)
    documents = documents.where(F.col(id_col).isNotNull())
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = save(signatures(documents, k, bands, rows, id_col, text_col))
    sets = ["n_shingles", "fp1", "fp2"]
    same = save(sigs.where("n_shingles > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep")))
    member = sigs.select("doc_id", *sets).join(same, sets, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    entries = sigs.where("n_shingles > 0").join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.posexplode("keys").alias("band", "key"))
    entries = save(entries.select("doc_id", F.xxhash64("band", "key").alias("bucket")))
    hub = save(entries.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub < other").select("bucket", "hub"))

    def picked(ids: DataFrame) -> DataFrame:
        ids = save(ids.distinct())
        return save(texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"))

    pairs = entries.join(hub, "bucket").where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = save(_likely(pairs, sigs, bands * rows, percent))
    links = save(verified(pairs, picked(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), k, percent))
    comps = connected_components(links)

    rest = entries.join(hub, "bucket").join(comps, F.col("doc_id") == F.col("node"), "left")
    rest = save(rest.select("bucket", "hub", "doc_id", F.coalesce("component", "doc_id").alias("comp")))
    live = block_roles(rest)
    if not live.isEmpty():
        live = save(live)
        bodies = picked(live.select("doc_id")).join(sigs.select("doc_id", "minima"), "doc_id")
        live = live.join(bodies, "doc_id").select("block", "role", "doc_id", "comp", "hub", "minima", "text")
        more = save(live.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks(bands * rows, percent, k), "a long, b long").distinct())
        if not more.isEmpty():
            comps = connected_components(links.unionByName(more))
    component = F.coalesce("component", "rep")
    return member.join(comps, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )
