"""Token-ID output: Parquet list columns in document order, with offsets that allow selective reads."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, tune

#: Dictionary encoding for ids; delta encoding (of the second version's writer) for the ascending columns.
#: Row groups of 32 MB and pages of 64 KB, 1,000 rows at most, each in the column and offset indexes.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: Distinct words and other chunks that a worker remembers, and bytes of text that are split at a time.
PIECES, SPLIT_BYTES = 300_000, 2 << 20
#: ASCII punctuation that is a word of its own after letters; an apostrophe isn't.
_TAIL = ".,;:!?%&*#$()"


def _is_letters(word: str) -> bool:
    """Whether the tokenizer's normalizing steps leave nothing but letters of a word."""
    return "\u03a3" not in word and unicodedata.normalize("NFC", word).lower().isalpha()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Encodes texts chunk by chunk between ASCII white space, which no token spans, and each different chunk once a call.

    A chunk of letters and then ASCII punctuation is two words to the tokenizer: its letters, in lower case, and its
    punctuation are pieces that are encoded apart; any other chunk is a piece as it stands. Which pieces a chunk has
    depends on the chunk alone. Pieces are remembered between calls. New pieces of letters are encoded many at a time by
    the same model without the tokenizer's normalizing and splitting, which are done already, and told apart by the ends
    of words that the vocabulary marks.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        # One model in memory: its steps before the model are exchanged for those that the pieces at hand need.
        self.whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.ascii = (None, pre_tokenizers.WhitespaceSplit())
        self.letters = (None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)  # where each piece's ids begin; they end where the next one's do
        self.used = 0

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.pieces.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def use(self, steps: tuple) -> None:
        """Set what the tokenizer does before its model: normalizing and splitting."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps

    def learn(self, pieces: list[str], letters=None) -> None:
        """Remember new pieces; those of letters come with the steps for them."""
        for i in range(0, len(pieces), 512):
            part = pieces[i : i + 512]
            if letters is not None:
                self.use(letters)
                ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.int32)
                self.use(self.whole)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(part):
                    self.add(part, ids, np.diff(ends, prepend=0))
                    continue
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            self.add(part, np.fromiter((i for e in each for i in e), np.int32, int(sizes.sum())), sizes)

    def numbers(self, pieces: list[str], letters=None) -> np.ndarray:
        """The numbers of pieces, known or new."""
        known = self.pieces
        self.learn(list({p for p in pieces if p not in known}), letters)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def lists(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each of some different chunks, and last the end id alone."""
        words = pc.ascii_rtrim(chunks, _TAIL)
        plain = pc.or_(pc.ascii_is_alpha(words), pc.equal(words, "")).to_numpy(zero_copy_only=False)
        pieces = np.zeros((len(chunks), 2), np.int64)
        lower = pc.ascii_lower(words.filter(pa.array(plain))).dictionary_encode()
        pieces[plain, 0] = self.numbers(_strings(lower.dictionary), self.ascii)[lower.indices.to_numpy()]
        other = np.flatnonzero(~plain)
        found = words.take(pa.array(other)).dictionary_encode()
        names = [unicodedata.normalize("NFC", w).lower() if _is_letters(w) else "" for w in _strings(found.dictionary)]
        number = self.numbers(names, self.letters)[found.indices.to_numpy()]
        pieces[other, 0] = number
        whole = other[number == 0]
        pieces[whole, 0] = self.numbers(_strings(chunks.take(pa.array(whole))))
        length = pc.utf8_length(words).to_numpy()
        tailed = length < pc.utf8_length(chunks).to_numpy()
        tailed[whole] = False
        more = np.flatnonzero(tailed)
        pieces[more, 1] = self.numbers([c[n:] for c, n in zip(_strings(chunks.take(pa.array(more))), length[more].tolist(), strict=True)])
        start, size = self.at[pieces], self.at[pieces + 1] - self.at[pieces]
        ends = np.cumsum(size.ravel())
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(start.ravel() - (ends - size.ravel()), size.ravel())]
        bounds = np.concatenate([[0], ends[1::2], [total + 1]])
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.append(ids, np.int32(self.end_id))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each with the end id, and how many each has."""
        if len(self.pieces) > PIECES:
            self.clear()
        chunks = pc.ascii_split_whitespace(texts)
        found = chunks.flatten().dictionary_encode()
        at = chunks.offsets.to_numpy().astype(np.int64)
        last = at[1:] - at[0] + np.arange(len(texts))
        which, inner = np.full(len(found) + len(texts), len(found.dictionary), np.int32), np.ones(len(found) + len(texts), bool)
        inner[last] = False
        which[inner] = found.indices.to_numpy()
        out = self.lists(found.dictionary).take(pa.array(which))
        return out.values.to_numpy(), np.diff(out.offsets.to_numpy()[np.append(0, last + 1)])


def _runs(column: pa.Array) -> Iterator[pa.Array]:
    """The texts, null as empty, in runs of about SPLIT_BYTES; one longer text is a run of its own."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(column).to_numpy())
    i = 0
    while i < len(column):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, "right")))
        yield column.slice(i, j - i)
        i = j


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def tokenize(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, tokens for (doc_id, text); the end id closes each document. Null counts as empty."""

    def run(batches):
        encoder = _ENCODERS.get((tokenizer, end_id)) or _ENCODERS.setdefault((tokenizer, end_id), ChunkEncoder(tokenizer, end_id))
        for batch in batches:
            done = [encoder(texts) for texts in _runs(batch.column(1))]
            n = np.concatenate([n for _, n in done]) if done else np.zeros(0, np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([ids for ids, _ in done]) if done else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), tokens], ["doc_id", "n_tokens", "tokens"])
            del done, n, ends, tokens
            pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>")


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, n_tokens, tokens, shard; shards are ranges of doc_id and rows ascend within them.

    The text is shuffled once, as text (it is smaller than its ids), and encoded after it is in place.
    Null ids are dropped; repeated ids are written each. Empty and null texts have the end id alone.
    """
    tune(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    placed = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    tokens = tokenize(placed, tokenizer, end_id).withColumn("shard", F.spark_partition_id())
    tokens.write.options(**WRITER).mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The written rows with lo <= doc_id < hi; the bounds reach row groups and pages through their indexes."""
    rows = spark.read.schema("doc_id long, n_tokens long, tokens array<int>, shard int").parquet(path)
    if lo is not None:
        rows = rows.where(F.col("doc_id") >= lo)
    if hi is not None:
        rows = rows.where(F.col("doc_id") < hi)
    return rows


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of written rows: a running sum within shards, and one over shards."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            ends = column.offsets.to_numpy()
            ids = column.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "shard", "n_tokens", "ids_crc32"])

    per_row = rows.select("doc_id", "tokens", "shard").mapInArrow(run, "doc_id long, shard int, n_tokens long, ids_crc32 long")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return (
        per_row.withColumn("within", F.coalesce(running, F.lit(0)))
        .join(before, "shard")
        .select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_and_read_back(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = documents.sparkSession
    path = scratch(spark)
    write_tokens(documents, path, tokenizer, end_id)
    return digest(read_tokens(spark, path))
