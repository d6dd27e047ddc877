"""Near-duplicate embeddings: E8 lattice cells of random projections, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, local_roots, mix, save, tune
from .components import connected_components

#: A pair at cosine 0.95 meets in a table with a chance near 0.72; in none of eight with one near 4e-5.
TABLES, PROBES, SCALE = 8, 2, 0.65
#: Rows of a cell that are compared in one block; larger cells are split into pairs of blocks.
CELL_ROWS = 2000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: neighbours of a lattice point."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1.0, -1.0):
                for t in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    signs = np.where((np.arange(256)[:, None] >> np.arange(8)) & 1, 0.5, -0.5)
    return np.concatenate([np.array(out), signs[(signs < 0).sum(axis=1) % 2 == 0]])


_ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: the nearer of those in D8 and in D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """For each vector the key of its own cell and those of the neighbouring cells that it is nearest to."""
    g = np.random.default_rng(1009 + table).normal(size=(unit.shape[1], 8)) * SCALE
    x = unit @ g
    own = nearest_e8(x)
    near = np.argpartition(-((x - own) @ _ROOTS.T), PROBES, axis=1)[:, :PROBES]
    points = np.concatenate([own[:, None], own[:, None] + _ROOTS[near]], axis=1)
    whole = np.rint(2 * points).astype(np.int64).view(_U)
    key = np.full(whole.shape[:2], _U(table + 1 + TABLES * unit.shape[1]))
    for i in range(8):
        key = mix(key * _U(0x9FB21C651E98DF25) + whole[..., i])
    return key.view(np.int64)


def _fixed(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    start, end = column.offsets[0].as_py(), column.offsets[-1].as_py()
    return column.values.slice(start, end - start).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entries(batches):
    """The cells of vectors without null, zero or non-finite ones; lengths may differ."""
    for batch in batches:
        widths = np.diff(batch.column(2).offsets.to_numpy())
        for width in np.unique(widths).tolist():
            small = batch.take(pa.array(np.flatnonzero(widths == width)))
            unit = _unit(_fixed(small.column(2)))
            for table in range(TABLES):
                keys = cells(unit, table)
                n, k = keys.shape
                take = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.tile(np.arange(k) == 0, n)), *(small.column(i).take(take) for i in range(3))],
                    ["cell", "home", "vec_id", "copies", "embedding"],
                )


def _compare(group: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, ...] | None:
    """Of one block of one cell: (node, its local root, links counted here) for each node that has a link."""
    left, right = np.flatnonzero(group["home"] & (group["role"] != 2)), np.flatnonzero(group["role"] != 1)
    if not len(left) or len(right) < 2 and (group["role"] == 0).all():
        return None
    ids, x = group["vec_id"], _unit(group["embedding"])
    i, j = np.nonzero(x[left] @ x[right].T >= cosine)
    a, b = left[i], right[j]
    # Two at home meet as (a, b) and as (b, a), and a row meets itself.
    keep = np.where(group["home"][b], ids[a] < ids[b], ids[a] != ids[b])
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    # A pair counts in the first table where it meets; there at home, else in the cell of the lower id.
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pa_, pb_ = at[: len(a)], at[len(a) :]
    here, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
    for table in range(TABLES):
        keys = cells(x[used], table)
        same = keys[pa_, 0] == keys[pb_, 0]
        a_home = (keys[pa_, :1] == keys[pb_, 1:]).any(axis=1)
        b_home = (keys[pb_, :1] == keys[pa_, 1:]).any(axis=1)
        first = open_ & (same | a_home | b_home)
        place = np.where(same | (a_home & (~b_home | (ids[a] < ids[b]))), keys[pa_, 0], keys[pb_, 0])
        here |= first & (place == group["cell"])
        open_ &= ~first
    degree = np.bincount(pa_[here], group["copies"][b[here]], len(used)) + np.bincount(pb_[here], group["copies"][a[here]], len(used))
    roots = local_roots(len(used), pa_, pb_)
    return ids[used], ids[used][roots], degree.astype(np.int64)


def _blocks(cosine: float):
    def run(batches):
        names = ["cell", "home", "role", "vec_id", "copies", "embedding"]

        def emit(part):
            key = part["block"]
            cut = np.flatnonzero(np.diff(key)) + 1
            found = []
            for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]]), strict=True):
                if e - s > 1:
                    g = {n: part[n][s:e] for n in names}
                    # Keys of cells are 64-bit hashes; two cells under one block key are told apart here.
                    for c in np.unique(g["cell"]):
                        one = g["cell"] == c
                        found.append(_compare({n: v[one] for n, v in g.items()} | {"cell": c}, cosine))
            found = [f for f in found if f]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], ["node", "root", "links"])

        def parts():
            """Each batch's runs of one vector length."""
            for batch in batches:
                widths = np.diff(batch.column("embedding").offsets.to_numpy())
                bounds = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    if j > i:
                        yield {n: (_fixed(c.slice(i, j - i)) if n == "embedding" else c.slice(i, j - i).to_numpy(zero_copy_only=False)) for n in ["block", *names] for c in [batch.column(n)]}

        rest = None
        for part in parts():
            if rest is not None and rest["embedding"].shape[1] != part["embedding"].shape[1]:
                yield from emit(rest)
                rest = None
            if rest is not None:
                part = {n: np.concatenate([rest[n], part[n]]) for n in part}
            last = int(np.searchsorted(part["block"], part["block"][-1], "left"))
            rest = {n: v[last:] for n, v in part.items()}
            if last:
                yield from emit({n: v[:last] for n, v in part.items()})
        if rest is not None:
            yield from emit(rest)

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector.

    Equal vectors are merged first and count as many times as there are copies. Each of the others goes
    to its own E8 cell and the nearest neighbouring cells in several tables of random projections; those
    at home in a cell are compared with all rows of it by blocked matrix products, in double precision.
    Large cells are split into pairs of blocks, so no task holds a hot cell. A block reports its nodes
    with their local root and degree, never pairs; a pair counts in the first table where it meets.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths never link with each other. Rows with a null id are dropped. Other columns are ignored. An empty table gives an empty result.
    """
    tune(vectors.sparkSession)
    v = F.col("embedding")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding")).where("vec_id is not null")
    fine = v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = source.where(F.coalesce(fine, F.lit(False)))
    same = save(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    entries = same.select("rep", "copies", "embedding").mapInArrow(_entries, "cell long, home boolean, vec_id long, copies long, embedding array<float>")
    hot = save(entries.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts")))
    parts, own = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))
    others = F.sequence(F.lit(0), parts - 1)
    roles = F.when(parts == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("role")))).otherwise(
        F.concat(
            F.when(F.col("home"), F.transform(others, lambda x: F.struct(own.alias("i"), x.cast("long").alias("j"), F.lit(1).alias("role")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,role:int>>")),
            F.transform(others, lambda x: F.struct(x.cast("long").alias("i"), own.alias("j"), F.lit(2).alias("role"))),
        )
    )
    placed = (
        entries.join(hot, "cell", "left")
        .withColumn("r", F.explode(roles))
        .select(F.xxhash64("cell", "r.i", "r.j").alias("block"), "cell", "home", "r.role", "vec_id", "copies", "embedding")
    )
    found = save(placed.repartition("block").sortWithinPartitions(F.size("embedding"), "block").mapInArrow(_blocks(cosine), "node long, root long, links long"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    reps = save(same.join(degree, F.col("rep") == F.col("node"), "left").drop("node").join(comps, F.col("rep") == F.col("node"), "left").select("embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(reps, "embedding").select("vec_id", "n_links", "component_id")
    alone = source.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
