"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word brings five inputs, learned as smoothed log-odds of hashed features: the word itself, its
first four and first five characters, and the mean and greatest of its character trigrams. A window of
words runs through a GRU in both directions; attention pools its states into one logit, and a document
has the greatest of its windows' logits, calibrated to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _U, ALNUM, prefix_hash, span_hash, text_blocks, tune, words

#: Buckets of each hashed feature; words a window and the step to the next; units a direction; inputs a word.
BUCKETS, WINDOW, STEP, UNITS, INPUTS = 1 << 16, 64, 32, 8, 5
#: The classifier is fitted on at most so many labelled ids of each class, as long as those before them in the order of
#: their hashes have fewer characters than this together. An id whose texts have more than CHARS_PER_ID characters is left
#: out of the fit, so that the driver holds CHARS_PER_CLASS + CHARS_PER_ID characters of a class at most; it is scored as any other.
ROWS_PER_CLASS, CHARS_PER_CLASS, CHARS_PER_ID = 2000, 8_000_000, 1_000_000
FOLDS, EPOCHS, BATCH, RATE, PRIOR = 5, 8, 64, 0.02, 0.4


@dataclass
class Words:
    """Of a block of texts: bucket numbers of each word's features, and the first word of each text."""

    word: np.ndarray
    four: np.ndarray
    five: np.ndarray
    tri: np.ndarray
    tri_at: np.ndarray
    tri_n: np.ndarray
    first: np.ndarray


def featurize(data: np.ndarray, offsets: np.ndarray) -> Words:
    hashes, start, end, first = words(data, offsets, ALNUM)
    prefix = prefix_hash(_LOWER[data])
    bucket = lambda h, salt: ((h ^ _U(salt)) % _U(BUCKETS)).astype(np.int32)
    n = np.maximum(1, end - start - 2)
    at = np.cumsum(n) - n
    pos = np.arange(int(n.sum())) - np.repeat(at, n) + np.repeat(start, n)
    tri = span_hash(prefix, pos, np.minimum(pos + 3, np.repeat(end, n)))
    return Words(bucket(hashes, 1), bucket(span_hash(prefix, start, np.minimum(start + 4, end)), 2), bucket(span_hash(prefix, start, np.minimum(start + 5, end)), 3), bucket(tri, 4), at, n, first)


def inputs(f: Words, odds: np.ndarray) -> np.ndarray:
    """(words, INPUTS) under the given tables of log-odds, of shape (4, BUCKETS)."""
    x = np.zeros((len(f.word), INPUTS), np.float32)
    if len(f.word):
        x[:, 0], x[:, 1], x[:, 2] = odds[0][f.word], odds[1][f.four], odds[2][f.five]
        t = odds[3][f.tri]
        x[:, 3] = np.maximum.reduceat(t, f.tri_at)
        x[:, 4] = np.add.reduceat(t, f.tri_at) / f.tri_n
    return x


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each window; a text without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return text, first[:-1][text] + at, np.minimum(WINDOW, n[text] - at)


def gather(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, windows, INPUTS), zero beyond a window's end, and the mask of its words."""
    step = np.arange(WINDOW)[:, None]
    mask = step < size
    if not len(x):
        return np.zeros((*mask.shape, x.shape[1]), x.dtype), mask
    out = x[np.where(mask, start + step, 0)]
    out[~mask] = 0
    return out, mask


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        u = UNITS
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.5, (INPUTS, 3 * u)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.2, (u, 3 * u)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(3 * u, np.float32)
        self.p["att"] = rng.normal(0, 0.2, 2 * u).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.5, 2 * u).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, trace):
        u, p = UNITS, self.p
        gates = x @ p[f"x{d}"] + p[f"c{d}"]
        h = np.zeros((x.shape[1], u), np.float32)
        states = np.zeros((len(x), x.shape[1], u), np.float32)
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            a = h @ p[f"h{d}"]
            zr = _sigmoid(gates[t, :, : 2 * u] + a[:, : 2 * u])
            z, r = zr[:, :u], zr[:, u:]
            n = np.tanh(gates[t, :, 2 * u :] + r * a[:, 2 * u :])
            m = mask[t][:, None]
            new = np.where(m, (1 - z) * n + z * h, h)
            if trace is not None:
                trace.append((t, h, z, r, n, a[:, 2 * u :], m))
            h = states[t] = new
        return states

    def forward(self, x: np.ndarray, mask: np.ndarray, traces: dict | None = None) -> np.ndarray:
        s = np.concatenate([self._run(x, mask, d, None if traces is None else traces.setdefault(d, [])) for d in "fb"], axis=2)
        e = np.where(mask, s @ self.p["att"], -1e9)
        w = np.exp(e - e.max(axis=0)) * mask
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[..., None] * s).sum(axis=0)
        if traces is not None:
            traces |= {"s": s, "w": w, "pooled": pooled, "x": x}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, traces: dict, dlogit: np.ndarray) -> dict:
        u, p = UNITS, self.p
        s, w, pooled, x = (traces[k] for k in ("s", "w", "pooled", "x"))
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["out"]
        dw = (s * dpooled).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["att"] = np.einsum("tn,tnk->k", de, s)
        ds = w[..., None] * dpooled + de[..., None] * p["att"]
        for i, d in enumerate("fb"):
            dstate, carry = ds[..., i * u : (i + 1) * u], np.zeros((s.shape[1], u), np.float32)
            gx, gh, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"]), np.zeros_like(p[f"c{d}"])
            for t, h, z, r, n, an, m in reversed(traces[d]):
                dh = dstate[t] + carry
                live = dh * m
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn], axis=1)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                gx += x[t].T @ dgate
                gc += dgate.sum(axis=0)
                gh += h.T @ da
                carry = np.where(m, live * z, dh) + da @ p[f"h{d}"].T
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return g


def _log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From texts of either class with a bucket, (2, 4, BUCKETS), and texts of either class: shrunken log-odds, a quarter."""
    share = (counts.sum(axis=0) + 0.5) / (n.sum() + 1)
    rate = [(counts[c] + PRIOR * share * 10) / (n[c] + PRIOR * 10) for c in (0, 1)]
    return (np.clip(np.log(rate[1]) - np.log(rate[0]), -6, 6) / 4).astype(np.float32)


@dataclass
class Model:
    odds: np.ndarray
    network: Network
    slope: float
    offset: float
    share: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f = featurize(data, offsets)
        top = _greatest(self.network, inputs(f, self.odds), f.first)
        return np.where(np.diff(f.first) > 0, _sigmoid(self.slope * top.astype(np.float64) + self.offset), self.share)


def _greatest(network: Network, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest logit over all windows of each text."""
    text, start, size = windows(first)
    out = np.full(len(first) - 1, -np.inf, np.float32)
    for i in range(0, len(text), 2048):
        part = slice(i, i + 2048)
        np.maximum.at(out, text[part], network.forward(*gather(x, start[part], size[part])))
    return out


def train(texts: pa.Array, labels: np.ndarray, share: float, seed: int = 11) -> Model:
    """Fit on bounded samples of both classes; share is that of class 1 among all labelled rows."""
    labels = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(labels)) % FOLDS
    # Features of a block are made twice rather than kept.
    parts = lambda: ((i, j, featurize(d, o)) for i, j, d, o in text_blocks(texts))
    first = np.zeros(len(labels) + 1, np.int64)
    counts, n = np.zeros((FOLDS, 2, 4, BUCKETS), np.float32), np.zeros((FOLDS, 2), np.float32)
    np.add.at(n, (fold, labels), 1)
    for i, j, f in parts():
        first[i + 1 : j + 1] = first[i] + f.first[1:]
        for row in range(j - i):
            a, b = f.first[row], f.first[row + 1]
            if b > a:
                to = counts[fold[i + row], labels[i + row]]
                tri = f.tri[f.tri_at[a] : f.tri_at[b - 1] + f.tri_n[b - 1]]
                for k, v in enumerate((f.word[a:b], f.four[a:b], f.five[a:b], tri)):
                    to[k, np.unique(v)] += 1
    # A text's inputs come from the other folds' counts, so that it doesn't vouch for its own rare words.
    held = [_log_odds(counts.sum(axis=0) - counts[k], n.sum(axis=0) - n[k]) for k in range(FOLDS)]
    x = np.zeros((first[-1], INPUTS), np.float32)
    for i, j, f in parts():
        of = np.repeat(fold[i:j], np.diff(f.first))
        for k in range(FOLDS):
            x[first[i] : first[j]][of == k] = inputs(f, held[k])[of == k]
    text, start, size = windows(first)
    # Each epoch sees every text by its two windows with the strongest inputs and one at random.
    strength = np.concatenate([[0], np.cumsum(x[:, :4].max(axis=1))]) if len(x) else np.zeros(1)
    strength = strength[start + np.maximum(size, 0)] - strength[start]
    order = np.lexsort((-strength, text))
    begin = np.searchsorted(text, np.arange(len(labels)))
    many = np.bincount(text, minlength=len(labels))
    network, m, v, step = Network(), {}, {}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(labels), BATCH):
            rows = shuffled[at : at + BATCH]
            pick = [order[begin[rows]], order[begin[rows] + np.minimum(1, many[rows] - 1)], begin[rows] + (rng.random(len(rows)) * many[rows]).astype(np.int64)]
            pick = np.concatenate(pick)
            traces: dict = {}
            logit = network.forward(*gather(x, start[pick], size[pick]), traces).reshape(3, -1)
            best = logit.argmax(axis=0)
            error = (_sigmoid(logit.max(axis=0)) - labels[rows]) / len(rows)
            d = np.zeros_like(logit)
            d[best, np.arange(len(rows))] = error
            step += 1
            for k, grad in network.backward(traces, d.reshape(-1).astype(np.float32)).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                v[k] = 0.99 * v.get(k, 0) + 0.01 * grad * grad
                network.p[k] = (network.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # Calibrate on whole texts, weighted to the classes' shares.
    top = _greatest(network, x, first).astype(np.float64)
    have = np.bincount(labels, minlength=2)
    w = np.where(labels == 1, share / max(1, have[1]), (1 - share) / max(1, have[0]))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * top + offset)
        r, q = w * (p - labels), w * np.maximum(p * (1 - p), 1e-6)
        a, b, c = (q * top * top).sum() + 1e-4, (q * top).sum(), q.sum() + 1e-6
        g1, g0 = (r * top).sum() + 1e-4 * (slope - 1), r.sum()
        det = a * c - b * b
        ds, do = (c * g1 - b * g0) / det, (a * g0 - b * g1) / det
        scale = min(1.0, 1.0 / max(abs(ds), abs(do), 1e-9))
        slope, offset = slope - scale * ds, offset - scale * do
    return Model(_log_odds(counts.sum(axis=0), n.sum(axis=0)), network, max(slope, 1e-3), offset, share)


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on ROWS_PER_CLASS labelled rows of each class at most, none of them held out.

    Ids are chosen by a hash, from labels that are 0 or 1 and texts of CHARS_PER_ID characters at most; a class's ids
    end with the one that brings them to CHARS_PER_CLASS characters, so what the driver holds is bounded.
    Without labelled rows of both classes the score is the share of class 1 (0.0 without labels).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    # The broadcast sides have at most 2 * ROWS_PER_CLASS rows of a few numbers (repeated ids: one row each).
    sizes = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).where(F.col("n") <= CHARS_PER_ID)
    before = F.sum("n").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("n")
    used = sizes.withColumn("before", before).where(F.col("before") < CHARS_PER_CLASS).select("doc_id", "label")
    rows = docs.join(F.broadcast(used), "doc_id").select("doc_id", "text", "label").toArrow()
    rows = rows.sort_by("doc_id")
    y = rows["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        flat = Network()
        return Model(np.zeros((4, BUCKETS), np.float32), flat, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), share)
    return train(rows["text"].combine_chunks(), y, min(max(share, 1e-3), 1 - 1e-3))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row: all overlapping windows of the whole text. Null texts count as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = [shared.value.scores(d, o) for _, _, d, o in text_blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], ["doc_id", "score"])

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Every row is scored on its whole text alone. Null, empty and wordless texts have the share of
    class 1 among the labelled rows. Repeated ids have a row each; null ids are scored and counted as not held out. Other columns
    are ignored. An empty table gives an empty result.
    """
    tune(documents.sparkSession)
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
