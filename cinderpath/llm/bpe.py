"""BPE encoding and decoding: an Aho-Corasick automaton of longest tokens and a table of pairs that merging keeps apart.

Merging a word's symbols by rank gives the one sequence of tokens in which every two neighbours are what merging their
joined text gives. So a word is cut from left to right: the longest token at a position, or a shorter one where its pair
with the token before isn't kept; a position from which no token works is never tried again, which makes time linear.
The last symbol of a word is a symbol of its own, as in the vocabulary, so no token spans two words and many words are
encoded as one sequence.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .token_output import ChunkEncoder, _runs

#: Remembered pairs of tokens, and words encoded as one sequence.
PAIRS, WORDS = 1 << 20, 4096
#: The vocabulary's mark of a word's last symbol, and what is added to that symbol here.
_END, _LAST = "</w>", 0x400


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where Latin-1 prints it, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) for b in range(256)]
    for n, b in enumerate(sorted({*range(256)} - {*shown})):
        out[b] = chr(256 + n)
    return out


class PairCutter:
    """Cuts sequences of symbols into the tokens that merging by rank would leave."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        made = {a + b for a, b in merges}
        names = [t for t in vocabulary if t not in made and len(t.removesuffix(_END) or t) == 1]
        number = {t: i for i, t in enumerate(names)}
        text = [chr(ord(t[0]) + _LAST) if t != t.removesuffix(_END) else t for t in names]
        #: Of each token, in order of rank: the pair it is merged from (itself, if a symbol), and the token of each merged pair;
        #: a merged token's number is its rank among merges, after the symbols.
        self.left, self.right = [*range(len(names))], [*range(len(names))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a not in number or b not in number:
                continue
            if a + b in number:
                raise ValueError(f"two pairs make the token {a + b!r}")
            x, y = number[a], number[b]
            number[a + b] = self.merged[x, y] = len(names)
            names.append(a + b)
            text.append(text[x] + text[y])
            self.left.append(x)
            self.right.append(y)
        self.ids = np.array([vocabulary[t] for t in names], np.int32)
        self.size = [*map(len, text)]
        self.kept: dict[int, bool] = {}
        # A token is in no result if merging its own text takes another way before the pair that makes it.
        real = []
        for i, (x, y) in enumerate(zip(self.left, self.right, strict=True)):
            real.append(x == y == i or (real[x] and real[y] and self.keeps(x, y, i)))
        at = {t: i for i, t in enumerate(text) if real[i]}
        self.shorter = [next((at[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in at), -1) for t in text]
        self.automaton = ahocorasick.Automaton()
        for t, i in at.items():
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()

    def keeps(self, x: int, y: int, before: int | None = None) -> bool:
        """Whether merging the text of two tokens gives just those two (before a merge): none across their border precedes what made them.

        Undoing the merges of both from the last on shows each pair that once met at the border.
        """
        limit = len(self.left) if before is None else before
        while True:
            if self.merged.get((x, y), limit) < limit:
                return False
            if x > y:
                limit, x = x, self.right[x]
                if x == limit:
                    limit, y = y + 1, self.left[y]
                    if y + 1 == limit:
                        return True
            else:
                limit, y = y + 1, self.left[y]
                if y + 1 == limit:
                    limit, x = x, self.right[x]
                    if x == limit:
                        return True

    def cut(self, symbols: str) -> list[int]:
        """The numbers of the tokens of a sequence whose symbols the vocabulary has."""
        n = len(symbols)
        longest = [-1] * (n + 1)
        # Over the reversed text, what ends at a place begins there; the longest comes first.
        for end, token in self.automaton.iter(symbols[::-1]):
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        kept, shorter, size, shift = self.kept, self.shorter, self.size, len(self.left)
        if len(kept) > PAIRS:
            kept.clear()
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if open_[end]:
                    if last < 0:
                        break
                    pair = last * shift + token
                    good = kept.get(pair)
                    if good is None:
                        good = kept[pair] = self.keeps(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at]
            else:
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return out


class Backtracker(ChunkEncoder):
    """Encodes chunks of texts by backtracking; the tokenizer's own parts only normalize and split what isn't plain letters."""

    def __init__(self, path: str):
        super().__init__(path, 0)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.cutter = PairCutter(data["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.symbol = byte_symbols()
        self.latin = str.maketrans({chr(b): s for b, s in enumerate(self.symbol)})
        #: Offset table of the vocabulary: the text of every id.
        names = [""] * (max([*data["model"]["vocab"].values(), *self.special.values()]) + 1)
        for t, i in [*data["model"]["vocab"].items(), *self.special.items()]:
            names[i] = t
        self.names = pa.array(names, pa.large_string())
        self.decimals = pa.array(map(str, range(len(names))), pa.large_string())

    def _words(self, piece: str) -> Iterator[str | int]:
        """The words of a piece in the symbols of their bytes, and the ids of special tokens."""
        at = 0
        for m in [*self.split_special.finditer(piece), None]:
            part = piece[at : m.start() if m else len(piece)]
            if part:
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    yield word
            if m:
                yield self.special[m.group()]
                at = m.end()

    def learn(self, pieces: list[str], letters=None) -> None:
        """Remember new pieces; those that come with a tokenizer for letters are single words in lower case."""
        for i in range(0, len(pieces), WORDS):
            part = pieces[i : i + WORDS]
            if letters is self.ascii:
                items = [[p] for p in part]
            elif letters is not None:
                items = [[p.encode().decode("latin-1").translate(self.latin)] for p in part]
            else:
                items = [[*self._words(p)] for p in part]
            flat = [w for words in items for w in words if isinstance(w, str)]
            tokens = self.cutter.cut("".join(w[:-1] + chr(ord(w[-1]) + _LAST) for w in flat))
            ids = self.cutter.ids[tokens] if tokens else np.zeros(0, np.int32)
            ends = np.cumsum(np.fromiter((self.cutter.size[t] for t in tokens), np.int64, len(tokens)))
            word_ends = np.cumsum([len(w) for w in flat])
            bounds = np.searchsorted(ends, word_ends) + 1 if len(flat) else np.zeros(0, np.int64)
            if letters is not None:
                self.add(part, ids, np.diff(bounds, prepend=0))
                continue
            lists, k, before = [], 0, 0
            for words in items:
                mine: list[int] = []
                for w in words:
                    if isinstance(w, int):
                        mine.append(w)
                    else:
                        mine.extend(ids[before : bounds[k]].tolist())
                        before, k = int(bounds[k]), k + 1
                lists.append(mine)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.add(part, np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        ids, n = super().__call__(texts)
        if not len(n):
            return ids, n
        return np.delete(ids, np.cumsum(n) - 1), n - 1  # without the id that closes each

    def joined(self, table: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """For each text, the entries of a table for its ids, joined by one space."""
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int64))
        return pc.binary_join(pa.LargeListArray.from_arrays(ends, table.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


_BACKTRACKERS: dict[str, Backtracker] = {}


def _backtracker(path: str) -> Backtracker:
    return _BACKTRACKERS.get(path) or _BACKTRACKERS.setdefault(path, Backtracker(path))


def _documents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tune(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row's whole text, as the tokenizer encodes it without special tokens of its own.

    Null and empty texts have no ids. Null and repeated doc_ids have a row each; other columns are ignored.
    """

    def run(batches):
        encoder = _backtracker(tokenizer)
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(1)):
                ids, n = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])
                at += len(texts)

    return _documents(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of lists of ids: the vocabulary's texts, joined by one space. Null and empty lists give empty texts; unknown ids nothing."""

    def run(batches):
        coder = _backtracker(tokenizer)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.schema.types[1]))
            ids, n = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            known = (ids >= 0) & (ids < len(coder.names))
            row = np.repeat(np.arange(len(n)), n)
            text = coder.joined(coder.names, ids[known].astype(np.int64), np.bincount(row[known], minlength=len(n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], ["doc_id", "text"])

    tune(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.filter(F.col(ids_col).cast("array<int>"), lambda i: i.isNotNull()).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def _hashes(texts: pa.Array) -> list[str]:
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def digest(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() of every row in one pass, without moving ids or texts."""

    def run(batches):
        coder = _backtracker(tokenizer)
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(1)):
                ids, n = coder(texts)
                shown, decoded = (_hashes(coder.joined(t, ids, n)) for t in (coder.decimals, coder.names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n.astype(np.int64)), pa.array(shown, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    return _documents(documents, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
