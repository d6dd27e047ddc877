"""Chat formatting: a hidden Markov model over marker and line features recovers speakers by Viterbi."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, tune

ROLES = ("system", "user", "assistant")
#: Words that introduce a speaker at the start of a line.
MARKERS = {"system": ("system", "instructions", "context"), "user": ("user", "human", "question", "customer", "q", "me"), "assistant": ("assistant", "ai", "bot", "answer", "agent", "a", "model")}
_ANY = "|".join(w for ws in MARKERS.values() for w in ws)
_LINE = rf"(?i)^[ \t]*[#*\[<|]{{0,3}}({_ANY})[\]>|*]{{0,3}}[ \t]*[:>：][ \t]*"
#: Segments of a block; blocks of a superblock. Only boundaries of blocks meet in one task.
BLOCK = 512


def segments(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, seg, role, text, body, and a feature column each, of transcript rows split at speaker markers."""
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null and turn is not null").distinct()
    parts = F.split("text", rf"(?im)\n(?=[ \t]*[#*\[<|]{{0,3}}(?:{_ANY})[\]>|*]{{0,3}}[ \t]*[:>：])")
    rows = rows.select("conv_id", "turn", "role", F.posexplode(parts).alias("seg", "text"))
    said = F.lower(F.regexp_extract("text", _LINE, 1))
    marker = F.lit("none")
    for role, words in MARKERS.items():
        marker = F.when(said.isin(*words), role).otherwise(marker)
    body = F.trim(F.regexp_replace("text", _LINE, ""))
    lines = F.size(F.split("text", "\n"))
    return rows.select(
        "conv_id", "turn", "seg", "role", "text",
        F.when(said != "", body).otherwise(F.trim("text")).alias("body"),
        F.concat(F.lit("marker="), marker).alias("f0"),
        F.concat(F.lit("lines="), F.least(lines, F.lit(6))).alias("f1"),
        F.concat(F.lit("size="), F.floor(F.log2(F.length("text") + 1.0))).alias("f2"),
        F.concat(F.lit("first="), (F.col("turn") == 0) & (F.col("seg") == 0)).alias("f3"),
        F.concat(F.lit("asks="), F.trim("text").endswith("?")).alias("f4"),
        F.concat(F.lit("line="), F.floor(F.log2(F.length("text") / lines + 1.0))).alias("f5"),
    )


FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5")


class Speakers:
    """Log-probabilities of the first role, of the next role, and of each feature's value."""

    def __init__(self, parts: DataFrame):
        train = parts.where(F.lower("role").isin(*ROLES) & (F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(5)) != 0)).withColumn("role", F.lower("role"))
        counts = train.select("role", F.explode(F.array(*FEATURES)).alias("value")).groupBy("role", "value").count().collect()
        near = train.where("seg = 0").select("conv_id", "turn", "role").distinct()
        after = near.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
        steps = near.join(after, ["conv_id", "turn"]).groupBy("before", "role").count().collect()
        first = near.where("turn = 0").groupBy("role").count().collect()
        k = len(ROLES)
        at = {r: i for i, r in enumerate(ROLES)}
        a = np.full((k, k), 0.5) + np.eye(k) * 0.1
        for r in steps:
            a[at[r["before"]], at[r["role"]]] += r["count"]
        p = np.full(k, 0.5)
        for r in first:
            p[at[r["role"]]] += r["count"]
        values: dict[str, np.ndarray] = {}
        for r in counts:
            values.setdefault(r["value"], np.full(k, 0.5))[at[r["role"]]] += r["count"]
        # A marker names its speaker, whether or not the labelled rows have any.
        for role in ROLES:
            values.setdefault(f"marker={role}", np.full(k, 0.5))[at[role]] += 1000
        values.setdefault("marker=none", np.full(k, 0.5))
        sums: dict[str, np.ndarray] = {}
        for v, c in values.items():
            sums.setdefault(v.split("=")[0], np.zeros(k)).__iadd__(c)
        self.start, self.step = np.log(p / p.sum()), np.log(a / a.sum(axis=1, keepdims=True))
        self.emit = {v: np.log(c / (sums[v.split("=")[0]] + 1)) for v, c in values.items()}

    def emission(self, values: list[str]) -> np.ndarray:
        out = np.zeros(len(ROLES))
        for v in values:
            if v in self.emit:
                out += self.emit[v]
        return out


def best_path(matrices: list[np.ndarray], entry: int, end: int | None) -> list[int]:
    """The states after each max-plus step, from a given state and, if given, to one."""
    score = matrices[0][entry]
    back = []
    for m in matrices[1:]:
        all_ = score[:, None] + m
        back.append(all_.argmax(axis=0))
        score = all_.max(axis=0)
    state = int(score.argmax()) if end is None else end
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def _grouped(keys: int, done):
    """Call done on each run of rows with equal first columns, of sorted batches."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cols = [table.column(i).to_numpy() for i in range(keys)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            bounds = [0, *change.tolist()]
            out = [done(table.slice(a, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield from (b for t in out for b in t.to_batches())
            held = table.slice(cut)
        if held is not None:
            yield from done(held).to_batches()

    return run


def format_chats(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, seg, role (as given), speaker (recovered), rendered: each segment of every transcript.

    A row is a turn, or a raw transcript whose lines begin with speaker markers and is split there. Given
    roles are never inputs of a row's own decoding; those of four fifths of the conversations (crc32 of the id mod
    5 is not 0) train the model. rendered is <|speaker|>, a line end, the text without its marker, <|end|>.

    Conversations of any length are decoded in blocks: max-plus products of blocks, and of superblocks of
    blocks, tell the states between them, then each block is decoded on its own. Order is by turn, then role and text.
    Rows that repeat a turn exactly count once; rows with a null conv_id or turn are dropped; null texts are empty.
    Without labelled rows all roles are alike but for markers. An empty table gives an empty result.
    """
    spark = tune(transcripts.sparkSession)
    parts = save(segments(transcripts))
    model = spark.sparkContext.broadcast(Speakers(parts))
    k = len(ROLES)
    keyed = parts.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("super", F.floor(F.col("turn") / (BLOCK * BLOCK)))

    def matrices(t: pa.Table) -> list[np.ndarray]:
        m = model.value
        values = zip(*(t.column(f).to_pylist() for f in FEATURES), strict=True)
        return [m.step + m.emission(list(v)) for v in values]

    def opening(mats: list[np.ndarray]) -> list[np.ndarray]:
        m = model.value
        first = mats[0] - m.step + m.start  # every entry state stands for the beginning
        return [first, *mats[1:]]

    long_ids = save(keyed.groupBy("conv_id").agg(F.min("block").alias("opening"), F.max("block").alias("closing")).where("opening < closing").select("conv_id", "opening"))
    short, long_ = keyed.join(long_ids, "conv_id", "left_anti"), keyed.join(long_ids, "conv_id")
    schema = "conv_id long, turn long, seg int, role string, speaker string, rendered string"

    def rendered(t: pa.Table, states: list[int]) -> pa.Table:
        speakers = [ROLES[s] for s in states]
        text = [f"<|{s}|>\n{b}<|end|>\n" for s, b in zip(speakers, t.column("body").to_pylist(), strict=True)]
        return pa.table({"conv_id": t.column("conv_id"), "turn": t.column("turn"), "seg": t.column("seg"), "role": t.column("role"), "speaker": pa.array(speakers, pa.string()), "rendered": pa.array(text, pa.string())})

    def decode(t: pa.Table) -> pa.Table:
        return rendered(t, best_path(opening(matrices(t)), 0, None))

    columns = ["conv_id", "block", "super", "turn", "seg", "role", "body", *FEATURES]
    opens = lambda t: t.column("block")[0].as_py() == t.column("opening")[0].as_py()
    order = ["conv_id", "block", "turn", "role", "text", "seg"]
    near = short.repartition("conv_id").sortWithinPartitions(*order).select(*columns).mapInArrow(_grouped(1, decode), schema)

    # Long conversations: products of blocks, the states between superblocks, between blocks, then within them.
    def up(t: pa.Table) -> pa.Table:
        mats = matrices(t)
        if opens(t):
            mats = opening(mats)
        return pa.table({"conv_id": t.column("conv_id")[:1], "super": t.column("super")[:1], "block": t.column("block")[:1], "m": pa.array([product(mats).ravel().tolist()])})

    square = lambda row: np.array(row).reshape(k, k)
    again = lambda df, *keys: df.repartition(*keys[:2]).sortWithinPartitions(*keys)
    ups = save(again(long_, "conv_id", "block", "turn", "role", "text", "seg").select(*columns, "opening").mapInArrow(_grouped(2, up), "conv_id long, super long, block long, m array<double>"))
    supers = again(ups, "conv_id", "super", "block").mapInArrow(
        _grouped(2, lambda t: pa.table({"conv_id": t.column("conv_id")[:1], "super": t.column("super")[:1], "m": pa.array([product([square(x) for x in t.column("m").to_pylist()]).ravel().tolist()])})),
        "conv_id long, super long, m array<double>",
    )

    def between(key: str, fixed: bool):
        def run(t: pa.Table) -> pa.Table:
            mats = [square(x) for x in t.column("m").to_pylist()]
            entry, end = (t.column("entry")[0].as_py(), t.column("end")[0].as_py()) if fixed else (0, None)
            states = best_path(mats, entry, end)
            return pa.table({"conv_id": t.column("conv_id"), key: t.column(key), "entry": pa.array([entry, *states[:-1]], pa.int32()), "end": pa.array(states, pa.int32())})

        return run

    outer = supers.repartition("conv_id").sortWithinPartitions("conv_id", "super").mapInArrow(_grouped(1, between("super", False)), "conv_id long, super long, entry int, end int")
    inner = again(ups.join(save(outer), ["conv_id", "super"]), "conv_id", "super", "block").select("conv_id", "super", "block", "m", "entry", "end")
    inner = save(inner.mapInArrow(_grouped(2, between("block", True)), "conv_id long, block long, entry int, end int"))

    def within(t: pa.Table) -> pa.Table:
        mats = matrices(t)
        if opens(t):
            mats = opening(mats)
        return rendered(t, best_path(mats, t.column("entry")[0].as_py(), t.column("end")[0].as_py()))

    far = again(long_.join(inner, ["conv_id", "block"]), "conv_id", "block", "turn", "role", "text", "seg").select(*columns, "opening", "entry", "end").mapInArrow(_grouped(2, within), schema)
    return near.unionByName(far)
